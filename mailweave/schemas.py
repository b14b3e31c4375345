"""Fixed table shapes. Column names are part of the exchange format."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


CONTACTS = T.StructType(
    [T.StructField("id", T.StringType(), False)]
    + _strings(
        "source_url", "full_name", "first_name", "last_name", "email_found", "email_generated", "method"
    )
    + [T.StructField("confidence", T.DoubleType()), T.StructField("notes", T.StringType())]
)

PROFILES = T.StructType(
    [T.StructField("source_url", T.StringType(), False)]
    + _strings("full_name", "first_name", "last_name", "university", "department")
)

CRM = T.StructType(
    _strings("id", "Nombre", "Apellidos", "Email", "Universidad", "Departamento", "Desuscrito", "Enviado")
    + [T.StructField("open_count", T.IntegerType())]
    + _strings("first_open", "last_open")
    + [T.StructField("click_count", T.IntegerType())]
    + _strings("first_click", "last_click", "last_ip", "last_ua", "last_clicked_url")
)

# Department ids stay strings so that the id -> name map applies to them.
DEPARTMENT_CONTACTS = T.StructType(_strings("departamento", "profesor", "email"))

DEPARTMENT_MAP = T.StructType(_strings("dep_id", "nombre"))

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), *_strings("url", "html")]
)

ROBOTS_RULES = T.StructType(
    _strings("host", "agent", "path_prefix")
    + [T.StructField("allow", T.BooleanType()), T.StructField("rule_no", T.IntegerType())]
)

# One DOM entry. ``t_from``/``t_to`` delimit the entry's own visible text inside
# the page's ``chunks`` and ``c_from``/``c_to`` inside ``clean``, so subtree text is a slice and never a join; ``last_id`` is
# its last descendant, so its descendants are a slice of the DOM array and ``[node_id, last_id]`` is its interval. The
# last four point to the nearest table row, table, list and box (div, span, p) above, -1 for none.
NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("id_attr", T.StringType()),
        T.StructField("classes", T.ArrayType(T.StringType())),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("prev_id", T.IntegerType()),
        T.StructField("next_id", T.IntegerType()),
        T.StructField("last_id", T.IntegerType()),
        T.StructField("t_from", T.IntegerType()),
        T.StructField("t_to", T.IntegerType()),
        T.StructField("c_from", T.IntegerType()),
        T.StructField("c_to", T.IntegerType()),
        T.StructField("row_id", T.IntegerType()),
        T.StructField("table_id", T.IntegerType()),
        T.StructField("list_id", T.IntegerType()),
        T.StructField("box_id", T.IntegerType()),
    ]
)

DOM_FIELDS = [
    T.StructField("nodes", T.ArrayType(NODE)),
    T.StructField("chunks", T.ArrayType(T.StringType())),  # visible text as it stands
    T.StructField("clean", T.ArrayType(T.StringType())),  # the same, each chunk trimmed, blank ones dropped
    T.StructField("_error", T.StringType()),
]
