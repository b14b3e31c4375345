"""E-mail address expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t

# --- fixed values: the address patterns (group 1 is the address) ------------------
ANY_EMAIL = r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
TEXT_EMAIL = r"([a-zA-Z0-9._%+-]+@(?:[a-zA-Z0-9.-]+\.)+[a-zA-Z]{2,})"
# ---------------------------------------------------------------------------------


def domain_email_pattern(domain: str) -> str:
    """Addresses at exactly ``domain``, on Unicode word boundaries, any case."""
    word = r"[\p{L}\p{N}_]"
    return rf"(?i)(?:(?<!{word})(?={word})|(?<={word})(?!{word}))([A-Za-z0-9._%+\-]+@{re.escape(domain)})(?!{word})"


def find_all(c: Column, pattern: str = TEXT_EMAIL) -> Column:
    """Every address in order, duplicates kept, case kept."""
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def find_distinct_lower(c: Column, pattern: str = ANY_EMAIL) -> Column:
    return F.array_distinct(F.transform(find_all(c, pattern), F.lower))


def clean_email(c: Column) -> Column:
    """the first address in the text, lower case; NULL when there is none."""
    return t.blank_to_null(F.lower(F.regexp_extract(c, TEXT_EMAIL, 1)))


def at_domains(email: Column, domains, strict: bool = True) -> Column:
    """P10: is the address at one of the domains?

    ``strict`` takes the domains and what is below them (:func:`_below`); otherwise look-alikes
    with a longer ending pass too.
    """
    tests = [_below(email, d) if strict else F.contains(email, F.lit("@" + d)) for d in domains]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _below(email: Column, domain: str) -> Column:
    """The one rule for institutions: the part after ``@`` is the domain, or ends with a dot and the domain."""
    host = F.substring_index(email, "@", -1)
    return (host == domain) | host.endswith("." + domain)


def clean_domain_email(c: Column, domains, strict: bool = True) -> Column:
    """F1 restricted to the institution's domains."""
    email = clean_email(c)
    return F.when(at_domains(email, domains, strict), email)


def foreign(email: Column, domain: str, strict: bool = True) -> Column:
    """Not an address of the institution (sub-domains count as its own)."""
    if not strict:
        return ~F.coalesce(email, F.lit("")).rlike("@" + domain)
    return ~_below(F.coalesce(email, F.lit("")), domain)


def malformed(email: Column, suffixes) -> Column:
    """Text from a neighbouring element was glued to the address."""
    return email.rlike(r"\.(" + "|".join(suffixes) + ")")


def generate_email(first: Column, last: Column, domain: str) -> Column:
    """initial + surname at the domain; a guess, never to be taken for a published address."""
    initial = F.substring(t.to_ascii(F.lower(t.strip(first))), 1, 1)
    surname = F.regexp_replace(t.to_ascii(F.lower(t.strip(last))), "[^a-z0-9]", "")
    return F.when((initial != "") & (last != ""), F.concat(initial, surname, F.lit("@" + domain)))
