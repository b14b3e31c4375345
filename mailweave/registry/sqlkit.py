"""SQL fragments for the checks (DuckDB dialect), written apart from the Spark expressions."""

from __future__ import annotations

from ..functions.text import WS, WS_CHARS  # fixed values shared by both sides

TEXT_EMAIL = r"[a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9.-]+\.)+[a-zA-Z]{2,}"
ANY_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def title(x: str) -> str:
    runs = rf"regexp_extract_all(lower({x}), '\p{{L}}+|\P{{L}}+')"
    return f"array_to_string(list_transform({runs}, lambda r: upper(substr(r, 1, 1)) || substr(r, 2)), '')"


def symbols(x: str) -> str:
    return strip(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_{WS_CHARS}\-.,]', '', 'g')")


def clean_email(x: str) -> str:
    return f"nullif(lower(regexp_extract({x}, '{TEXT_EMAIL}', 0)), '')"


def ascii_(x: str) -> str:
    for a, b in (("ß", "ss"), ("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("þ", "th"), ("Þ", "Th"), ("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"strip_accents({x})"


def infer(x: str) -> str:
    parts = f"string_split(string_split({x}, '@')[1], '.')"
    kept = f"list_transform(list_filter(({parts})[1:3], lambda p: length(p) > 2), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2)))"
    return f"CASE WHEN len({parts}) >= 2 AND len({kept}) >= 2 THEN array_to_string({kept}, ' ') END"


def clean_name(x: str) -> str:
    s = squeeze(strip(x))
    n = f"len({words(s)})"
    return f"CASE WHEN lower({s}) <> 'departamento' AND {n} BETWEEN 2 AND 8 THEN {title(s)} END"


def normal_name(x: str) -> str:
    s = squeeze(strip(x))
    n = f"len({words(s)})"
    out = f"trim({title(s)}, '.,;:()[]{{}}')"
    return f"CASE WHEN lower({s}) NOT IN ('departamento', 'dept', 'depto') AND {n} BETWEEN 2 AND 8 AND length({out}) > 3 THEN {out} END"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def uuid5(x: str) -> str:
    d = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({x}))"
    nibble = f"substr('89ab', (position(substr({d}, 17, 1) IN '0123456789abcdef') - 1)::INT % 4 + 1, 1)"
    return (
        f"concat(substr({d}, 1, 8), '-', substr({d}, 9, 4), '-5', substr({d}, 14, 3), '-', {nibble}, substr({d}, 18, 3), '-', substr({d}, 21, 12))"
    )
