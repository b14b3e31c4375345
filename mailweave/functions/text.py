"""Text expressions. All native: they stay in the JVM and need no Python worker."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..siteprofile import LINE_LABELS, PLACEHOLDER_NAMES

# The characters that Python's str.split()/strip() and re's \s treat as white space.
WS_CHARS = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_CHARS}]"
# The same characters one by one, and without the blank as a class that most other characters leave at the second test.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BUT_BLANK = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
# runs of white space other than a single blank
_UNEVEN = f"[{_BUT_BLANK}][ {_BUT_BLANK}]*| [ {_BUT_BLANK}]+"


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; lambda bodies have no common-subexpression step."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lit_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def collapse_ws(c: Column) -> Column:
    """runs of white space become one space."""
    return F.regexp_replace(c, _UNEVEN, " ")


def words(c: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(collapse_ws(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    """F19."""
    return F.size(words(c))


def last_words(c: Column, n: int = 4) -> Column:
    """the last ``n`` words joined with one space."""
    w = words(c)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - (n - 1), F.lit(1)), F.lit(n)), " ")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def title_case(c: Column) -> Column:
    """upper-case every letter run's first letter (``O'Neil-Gómez``, ``2Nd``).

    ``initcap`` only looks at spaces, so it is not the same function.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), ""
    )


def capitalize(c: Column) -> Column:
    """one word, first letter upper, rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def strip_symbols(c: Column) -> Column:
    """keep letters, digits, ``_``, white space, ``-``, ``.`` and ``,``; then trim."""
    return strip(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{WS_CHARS}\-.,]", ""))


def text_before(text: Column, needle: Column) -> Column:
    """F16: the text before the first case-insensitive hit; NULL where there is none."""
    at = F.instr(F.lower(text), F.lower(needle))
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1))


def text_without(text: Column, needle: Column) -> Column:
    """the text with every occurrence of ``needle`` taken out, trimmed."""
    return strip(F.replace(text, needle, F.lit("")))


@lru_cache(maxsize=1)
def _ascii_table() -> tuple[str, str]:
    """Latin letters whose decomposition has an ASCII base letter, as two strings."""
    source, target = [], []
    for code in range(0xA1, 0x2B0):
        _add(chr(code), source, target)
    for code in range(0x1E00, 0x1F00):
        _add(chr(code), source, target)
    # fixed values: letters without a decomposition
    for char, base in (("ø", "o"), ("Ø", "O"), ("ł", "l"), ("Ł", "L"), ("đ", "d"), ("Đ", "D"),
                       ("ð", "d"), ("ħ", "h"), ("Ħ", "H"), ("ı", "i"), ("ĸ", "k"), ("ŧ", "t"), ("Ŧ", "T")):
        source.append(char)
        target.append(base)
    return "".join(source), "".join(target)


def _add(char: str, source: list[str], target: list[str]) -> None:
    if unicodedata.category(char)[0] != "L":
        return
    base = unicodedata.normalize("NFD", char)[0]
    if base != char and base.isascii():
        source.append(char)
        target.append(base)


# fixed values: letters that become two
_DIGRAPHS = (("ß", "ss"), ("ẞ", "SS"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th"), ("Þ", "Th"),
             ("ŋ", "ng"), ("Ŋ", "NG"), ("ĳ", "ij"), ("Ĳ", "IJ"))
# fixed values: letters of other alphabets, and what stands for them in ASCII
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
_CYRILLIC_ASCII = ("a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia").split(" ")
_GREEK = "αβγδεζηθικλμνξοπρςστυφχψω"
_GREEK_ASCII = "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(" ")


def to_ascii(c: Column) -> Column:
    """transliterate to ASCII; anything still outside ASCII is dropped."""
    source, target = _ascii_table()
    pairs = list(_DIGRAPHS)
    for letters, ascii_forms in ((_CYRILLIC, _CYRILLIC_ASCII), (_GREEK, _GREEK_ASCII)):
        for letter, form in zip(letters, ascii_forms):
            if len(form) > 1:
                pairs += [(letter, form)]
                pairs += [(letter.upper(), form.capitalize())] if letter.upper() != letter else []
            else:
                source += letter + letter.upper()
                target += form + form.upper()
    extra = F.translate(c, source, target)
    for letter, form in pairs:
        extra = F.replace(extra, F.lit(letter), F.lit(form))
    other = F.regexp_replace(extra, r"[^\x00-\x7f]", "")
    # Most values are ASCII already: test once, skip the chain of replacements.
    return F.when(c.rlike(r"[^\x00-\x7f]"), other).otherwise(c)


def short_key(c: Column, legacy: bool = False) -> Column:
    """lower-case key without blanks, colons and commas.

    ``legacy`` maps only é and á, so keys like ``economia`` miss their accented names.
    """
    low = F.lower(c)
    if legacy:
        return F.translate(low, "éá :,", "ea")
    return F.translate(to_ascii(low), " :,", "")


def split_first_last(c: Column) -> Column:
    """struct of the first and last word; both NULL when there are fewer than two."""
    w = words(c)
    ok = F.size(w) >= 2
    return F.struct(
        F.when(ok, F.try_element_at(w, F.lit(1))).alias("first_name"),
        F.when(ok, F.try_element_at(w, F.lit(-1))).alias("last_name"),
    )


def normalize_name(c: Column) -> Column:
    """title-case a 2-8 word name; placeholders and leftovers of <= 3 letters are NULL."""

    def named(s: Column) -> Column:
        # trimmed and collapsed: a blank between any two words
        wanted = F.size(F.split(s, " ")).between(2, 8) & ~F.lower(s).isin(*PLACEHOLDER_NAMES)
        return F.when(wanted, let(F.btrim(title_case(s), F.lit(".,;:()[]{}")), lambda out: F.when(F.length(out) > 3, out)))

    return let(collapse_ws(strip(c)), named)


def clean_name(c: Column) -> Column:
    """The curation variant; one placeholder, no trimming of punctuation, no length rule."""
    s = collapse_ws(strip(c))
    return F.when((F.lower(s) != "departamento") & word_count(s).between(2, 8), title_case(s))


def infer_name(email: Column) -> Column:
    """``ana.perez@…`` gives ``Ana Perez``; needs two of the first three parts longer than 2."""
    parts = F.split(F.substring_index(email, "@", 1), r"\.")
    kept = F.transform(F.filter(F.slice(parts, 1, 3), lambda p: F.length(p) > 2), capitalize)
    return F.when((F.size(parts) >= 2) & (F.size(kept) >= 2), F.array_join(kept, " "))


def good_name_length(c: Column) -> Column:
    """P15."""
    return F.length(c).between(3, 99)


def plausible_line(c: Column) -> Column:
    """Could this line be a person's name? ``c`` is trimmed already."""
    numeric = F.regexp_replace(c, r"[.,\-]", "").rlike(r"^\p{N}+$")
    labelled = F.lower(c).rlike("^(" + "|".join(LINE_LABELS) + ")")
    return good_name_length(c) & ~F.contains(c, F.lit("@")) & ~numeric & ~labelled
