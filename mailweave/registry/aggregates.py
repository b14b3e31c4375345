"""Aggregates (A*) and sorted limits (L*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import emails as em
from ..functions import text as t
from ..operators import extract as X
from ..operators import report
from ..plans import curate
from . import sqlkit as q
from .core import DERIVED, derived, load, query

# documents with their labels, a table with real gaps
DERIVED["labelled"] = "SELECT d.doc_id, d.source, d.lang, l.quality FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id"
# final contact rows: departamento may be missing, profesor too
DERIVED["final"] = """
SELECT k AS seq, CASE WHEN dep % 7 = 3 THEN NULL ELSE concat('Dep ', CAST(dep AS STRING)) END AS departamento,
       CASE WHEN k % 3 = 0 THEN NULL WHEN k % 31 = 1 THEN 'Departamento' ELSE concat(first_name, ' ', last_name) END AS profesor,
       CASE WHEN k % 41 = 5 THEN concat(email, '.ficha') ELSE email END AS email FROM {@people}"""


@query("a1_row_count", "SELECT count(*) AS n FROM {lineitem}")
def a1(spark, d):
    return report.row_count(load(spark, d, "lineitem"))


@query("a2_distinct_counts", "SELECT count(DISTINCT quality) AS quality, count(DISTINCT source) AS source, count(DISTINCT lang) AS lang FROM {@labelled}")
def a2(spark, d):
    return report.distinct_counts(derived(spark, d, "{@labelled}"), "quality", "source", "lang")


@query("a3_null_counts", "SELECT count(quality) AS with_value, count(*) - count(quality) AS without_value FROM {@labelled}")
def a3(spark, d):
    return report.null_counts(derived(spark, d, "{@labelled}"), "quality")


@query("a4_distinct_values", "SELECT DISTINCT departamento FROM {@final}")
def a4(spark, d):
    return report.distinct_values(derived(spark, d, "{@final}"), "departamento")


@query("a5_frequencies", "SELECT departamento, count(*) AS n FROM {@final} WHERE departamento IS NOT NULL GROUP BY departamento ORDER BY n DESC, departamento")
def a5(spark, d):
    return report.frequencies(derived(spark, d, "{@final}"), "departamento")


_COVER = """SELECT departamento, round_even(100.0::DOUBLE * count(profesor) / count(*), 1) AS "%_con_nombre", count(email) AS total FROM {@final} WHERE departamento IS NOT NULL GROUP BY departamento"""


@query("a6_coverage", _COVER)
def a6(spark, d):
    return report.coverage(derived(spark, d, "{@final}"))


@query("ud4_percent_aggregate", _COVER)
def ud4(spark, d):
    """The percent-non-null aggregate, native."""
    return report.coverage(derived(spark, d, "{@final}"))


@query("l5_sort_by_coverage", _COVER + ' ORDER BY "%_con_nombre" DESC, departamento')
def l5(spark, d):
    return report.coverage(derived(spark, d, "{@final}"))


@query("a7_top_groups", "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 5")
def a7(spark, d):
    return report.top_k(load(spark, d, "events"), "user_id", 5)


@query("l3_top_k", "SELECT departamento, count(*) AS n FROM {@final} WHERE departamento IS NOT NULL GROUP BY departamento ORDER BY n DESC, departamento LIMIT 10")
def l3(spark, d):
    return report.top_k(derived(spark, d, "{@final}"), "departamento", 10)


@query("l4_bottom_k", "SELECT departamento, count(*) AS n FROM {@final} WHERE departamento IS NOT NULL GROUP BY departamento ORDER BY n, departamento DESC LIMIT 10")
def l4(spark, d):
    return report.bottom_k(derived(spark, d, "{@final}"), "departamento", 10)


@query("a9_run_counters", """
SELECT CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
       CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_value FROM {events}""")
def a9(spark, d):
    kind = F.col("event_type")
    return report.counters(load(spark, d, "events"), views=kind == "view", errors=kind == "error", no_value=F.col("value").isNull())


@query("a10_named_counts", "SELECT count(*) FILTER (WHERE profesor <> '' AND profesor <> 'Departamento') AS con_nombre, count(*) FILTER (WHERE coalesce(profesor, '') IN ('', 'Departamento')) AS sin_nombre FROM {@final}")
def a10(spark, d):
    return report.named_counts(derived(spark, d, "{@final}"))


@query("a11_before_after", f"SELECT count(*) AS before, count({q.clean_email('email')}) AS after, count(*) - count({q.clean_email('email')}) AS removed FROM {{@contacts}}")
def a11(spark, d):
    raw = derived(spark, d, "{@contacts}")
    return report.counted_step(raw, curate.cleaned)[1]


@query("a12_quality_summary", """
SELECT count(*) AS total_registros, count(DISTINCT email) AS emails_unicos, count(profesor) AS profesores_con_nombre,
       count(*) - count(profesor) AS profesores_sin_nombre, count(DISTINCT departamento) AS departamentos_unicos FROM {@final}""")
def a12(spark, d):
    return report.quality_summary(derived(spark, d, "{@final}"))


@query("a14_inferred_count", f"""
SELECT count(*) AS inferred FROM {{@contacts}} WHERE {q.clean_name('profesor')} IS NULL AND {q.infer(q.clean_email('email'))} IS NOT NULL""")
def a14(spark, d):
    rows = curate.cleaned(derived(spark, d, "{@contacts}")).withColumn("guess", t.infer_name(F.col("email_clean")))
    return report.inferred_count(rows, "profesor_clean", "guess")


@query("l1_sort_by_email", f"SELECT {q.clean_email('email')} AS email, seq FROM {{@contacts}} ORDER BY email, seq")
def l1(spark, d):
    return derived(spark, d, "{@contacts}").select(em.clean_email(F.col("email")).alias("email"), "seq").orderBy("email", "seq")


@query("l2_sort_nulls_last", "SELECT departamento, profesor, email FROM {@final} ORDER BY departamento, profesor NULLS LAST")
def l2(spark, d):
    return curate.in_order(curate.final_columns(derived(spark, d, "{@final}"), "departamento", "profesor", "email"))


@query("l6_head_rows", "SELECT seq, email FROM {@final} ORDER BY seq LIMIT 15")
def l6(spark, d):
    return report.head(derived(spark, d, "{@final}"), ["seq"], 15).select("seq", "email")


@query("l7_cap_profiles", "SELECT source_url, pos FROM (SELECT source_url, min(seq) AS pos FROM {@stored} GROUP BY source_url) ORDER BY pos LIMIT 1000")
def l7(spark, d):
    """At most so many profiles, in the order their links were found."""
    links = derived(spark, d, "{@stored}").groupBy("source_url").agg(F.min("seq").alias("pos"))
    return report.head(links, ["pos"], 1000)


@query("l9_sort_in_array", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ' | ') AS priorities FROM {orders} GROUP BY o_custkey")
def l9(spark, d):
    sets = X.url_sets(load(spark, d, "orders"), "o_custkey", "o_orderpriority")
    return sets.select(F.col("email").alias("o_custkey"), F.array_join("urls", " | ").alias("priorities"))
