"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..siteprofile import PROFILE_URL_PARTS
from . import text as t

# fixed values: suffixes under which names are registered, for hosts deeper than one label
PUBLIC_SUFFIXES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "es", "de", "fr", "it", "pt", "uk", "us", "eu",
    "nl", "be", "ch", "at", "se", "no", "dk", "fi", "ie", "pl", "mx", "ar", "cl", "co", "br", "jp", "cn", "in",
    "au", "nz", "ca", "za", "co.uk", "ac.uk", "gov.uk", "org.uk", "com.es", "org.es", "edu.es", "gob.es",
    "com.mx", "edu.mx", "com.ar", "edu.ar", "com.br", "edu.br", "com.au", "edu.au", "co.jp", "ac.jp", "co.nz",
    "ac.nz", "co.in", "ac.in", "edu.cn", "com.cn", "co.za", "ac.za", "edu.co", "com.co",
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def netloc(url: Column) -> Column:
    """F8: host with port, ``''`` when the URL has none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", ""))


def path_and_query(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^#]*)", 1)
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def _resolve_dots(path: Column, rel: bool) -> Column:
    """Resolve ``.`` and ``..`` segments of a slash-separated path."""
    segs = F.split(path, "/")
    if rel:
        # duplicate slashes inside a merged path vanish, the leading and the last segment stay
        n = F.size(segs)
        segs = F.filter(segs, lambda s, i: (s != "") | (i == 0) | (i == n - 1))
    stack = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(stack, "/"), tail)
    # more ".." than segments end at the root
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def url_join(base: Column, href: Column) -> Column:
    """resolve ``href`` against the page it was found on."""
    href = F.when(href.rlike(r"[\x00-\x20]"), F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", "")).otherwise(href)
    sch = scheme(href)
    base_scheme = scheme(base)
    root = F.concat(base_scheme, F.lit("://"), netloc(base))
    base_path = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    base_no_frag = F.substring_index(base, "#", 1)
    base_no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    dotted = r"(^|/)\.\.?(/|$)"
    rooted = F.when(href_path.rlike(dotted), _resolve_dots(href_path, False)).otherwise(href_path)
    merged = F.concat(
        F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, r"[^/]*$", "")), href_path
    )
    merged = F.when(merged.rlike(dotted + "|//"), _resolve_dots(merged, True)).otherwise(merged)
    joined = (
        F.when(href.isNull() | (href == ""), base)
        .when(sch != "", href)
        .when(href.startswith("//"), F.concat(base_scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, rooted, href_rest))
        .when(href.startswith("?"), F.concat(base_no_query, href))
        .when(href.startswith("#"), F.concat(base_no_frag, href))
        .otherwise(F.concat(root, merged, href_rest))
    )
    return F.when(joined.rlike(r"[?#]$"), F.regexp_replace(joined, r"\??#?$", "")).otherwise(joined)


def registered_domain(url: Column, suffixes=PUBLIC_SUFFIXES) -> Column:
    """Longest matching suffix plus one label; the last two labels when no suffix matches.

    ``suffixes`` follow the public list's rules: ``*.x`` makes every name below x a suffix, ``!y.x`` makes y.x an
    exception to that (see :func:`mailweave.sources.tables.read_suffixes`). The rules are constants, so each test
    is a hash-set look-up, and a host of any depth is cut at all its dots.
    """
    exact = [s for s in suffixes if s[0] not in "*!"]
    below = [s[2:] for s in suffixes if s.startswith("*.")]
    except_ = [s[1:] for s in suffixes if s.startswith("!")]
    labels = F.split(host(url), r"\.")
    n = F.size(labels)

    def tail(i: Column) -> Column:
        return F.array_join(F.slice(labels, n - i + 1, i), ".")

    def is_suffix(i: Column) -> Column:
        test = tail(i).isin(*exact) if exact else F.lit(False)
        if below:
            test = test | ((i > 1) & tail(i - 1).isin(*below) & ~(tail(i).isin(*except_) if except_ else F.lit(False)))
        if except_:
            test = test | tail(i + 1).isin(*except_)
        return test

    longest = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), n - 1), is_suffix)), F.lit(1))
    return F.when(n > 1, tail(longest + 1)).otherwise(host(url))


def same_registered_domain(url: Column, domain: str, suffixes=PUBLIC_SUFFIXES) -> Column:
    """P1."""
    return registered_domain(url, suffixes) == domain.lower()


def is_internal(url: Column, domain: str, strict: bool = True) -> Column:
    """The host is the domain or below it; without ``strict`` a mere ending is enough."""
    if not strict:
        return netloc(url).endswith(domain)
    h = host(url)
    return (h == domain) | h.endswith("." + domain)


def under_base(url: Column, base_url: str) -> Column:
    """P3."""
    return url.startswith(base_url)


def same_host(url: Column, other: Column) -> Column:
    """P4."""
    return netloc(url) == netloc(other)


def mentions_domain(url: Column, domain: str) -> Column:
    """P5."""
    return F.contains(url, F.lit(domain))


def profile_like(url: Column) -> Column:
    """P6."""
    return F.lower(url).rlike("|".join(PROFILE_URL_PARTS))


def usable_href(href: Column) -> Column:
    """Neither empty nor a pure fragment."""
    return href.isNotNull() & (href != "") & ~href.startswith("#")


def has_keyword(keywords, *columns: Column) -> Column:
    """One of the words occurs in one of the (lower-cased) columns."""
    pattern = "|".join(_quote(k.lower()) for k in keywords)
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.lower(c), F.lit("")).rlike(pattern)
    return test


def _quote(word: str) -> str:
    return "".join("\\" + ch if not (ch.isalnum() or ch in " _@/") else ch for ch in word)


def internal_and_specific(url: Column, href: Column, base_url: str, link_words, min_length: int = 20) -> Column:
    """P9."""
    return under_base(url, base_url) & has_keyword(link_words, href) & (F.length(href) > min_length)


def second_last_segment(url: Column) -> Column:
    """P27."""
    return F.try_element_at(F.split(url, "/"), F.lit(-2))


def department_id(url: Column, marker: str) -> Column:
    """the digits after the department marker, NULL when absent."""
    return t.blank_to_null(F.regexp_extract(url, _quote(marker) + r"/(\d+)", 1))


def without_site_suffix(title: Column, site_suffix: str) -> Column:
    """drop `` - SITE…`` from a page title."""
    return F.regexp_replace(title, rf"(?i){t.WS}*-{t.WS}*{_quote(site_suffix)}.*", "")


def expand_templates(base_url: Column, templates: Column) -> Column:
    """fill ``{base}`` in an array of URL templates."""
    return F.transform(templates, lambda x: F.replace(x, F.lit("{base}"), base_url))
