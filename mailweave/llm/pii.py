"""Personal data: Aho-Corasick anchors, expanded and validated by local parsers."""

from __future__ import annotations

import hashlib
import ipaddress
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, map_slices, plain, texts

#: Order of kinds in every list of spans. The first four are also the base.
KINDS = ("email", "ip", "card", "phone", "account", "address")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "account": "[ACCOUNT]", "address": "[ADDRESS]"}
CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "number", "acct": "number", "passport": "document", "licence no": "document", "license no": "document"}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WIDE_DOMAIN = re.compile(r"[^\W_][\w-]*+(?:\.[^\W_][\w-]*+)*\.([^\W\d_]{2,}+)(?![\w-])")
_LEAD = r"(?:\s*(?:no|nr|number|num|id)\b\.?)?[\s:#=.]{1,3}"
_IBAN = re.compile(r"(?:\s*(?i:no|nr|number|num|id)\b\.?)?[\s:#=.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Characters of an IBAN by its country.
_IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
_SSN = re.compile(_LEAD + r"((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])", re.I)
_NUMBER = re.compile(_LEAD + r"([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.I)
_DOCUMENT = re.compile(_LEAD + r"([A-Z]{0,2}[0-9]{6,9}+)(?![A-Za-z0-9])", re.I)
_USER = re.compile(r"[A-Za-z0-9._~%!$&'*+,;=-]++(?::[^\s@/?#]*+)?+(?=@)")
_IP6 = re.compile(r"(?:[^\s@/?#\[\]]*+@)?+\[([0-9A-Fa-f:.]{2,45})\]")

Span = tuple[str, int, int]


@cache
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "://", *"0123456789", *(f"+{d}" for d in range(10))):
        found.add_word(mark, (mark[0], len(mark)))
    for cue in CUES:
        found.add_word(cue, (cue, len(cue)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _iban(text: str, at: int) -> tuple[int, int] | None:
    m = _IBAN.match(text, at)
    if not m:
        return None
    start, stop = m.span(1)
    length = _IBAN_LENGTHS.get(m[1][:2])
    for end in range(stop, start, -1):  # at most 63: the longest first
        if text[end - 1] == " " or text[end : end + 1].isascii() and text[end : end + 1].isalnum():
            continue
        code = text[start:end].replace(" ", "")
        if len(code) < 15:
            return None
        if length in (None, len(code)) and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return start, end
    return None


def _lowered(text: str) -> str:
    """Lower case, character by character: a dotted capital I would become two."""
    return text.replace("\u0130", "I").lower()


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and spans that the anchors add, as ``(kind, start, end)`` in code points, the end exclusive.

    One pass of the automaton gives the anchors in order. Each kind keeps its own end, so base spans are those of a
    leftmost scan that does not overlap within a kind; a match that fails validation is dropped and not tried again.
    Work is linear in the text: a local parser reads its run once.
    """
    base: list[Span] = []
    more: list[Span] = []
    mail_end = ip_end = card_end = wide_end = 0
    run_end = -1
    for last, (mark, length) in _anchors().iter(_lowered(text)):
        at = last - length + 1
        if "0" <= mark <= "9" and len(mark) == 1:
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = _digits(m[0])
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    base.append(("card", at, card_end))
            begins, run_end = at != run_end, at + 1
            if begins and at >= ip_end and (m := _IP.match(text, at)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                    base.append(("ip", at, ip_end))
        elif mark == "@":
            start = at
            while start > mail_end and _LOCAL.match(text, start - 1):
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                mail_end = m.end()
                base.append(("email", start, mail_end))
            wide = at
            while wide > wide_end and (text[wide - 1].isalnum() or text[wide - 1] in "._%+-"):
                wide -= 1
            if wide < at and (w := _WIDE_DOMAIN.match(text, at + 1)):
                wide_end = w.end()
                if not w[0].isascii() or not text[wide:at].isascii():
                    end = max(wide_end, m.end()) if m else wide_end
                    more.append(("email", min(wide, start), end))
        elif mark == "+":
            if m := _PHONE.match(text, at):
                if 9 <= len(_digits(m[0])) <= 15:
                    base.append(("phone", at, m.end()))
        elif mark == ":":
            if m := _USER.match(text, last + 1):
                more.append(("account", last + 1, m.end()))
            if m := _IP6.match(text, last + 1):
                try:
                    ipaddress.IPv6Address(m[1])
                    more.append(("address", *m.span(1)))
                except ValueError:
                    pass
        elif not (text[at - 1 : at].isalnum() or text[last + 1 : last + 2].isalnum() and mark != "iban"):
            kind = CUES[mark]
            if kind == "iban":
                span = _iban(text, last + 1)
            else:
                m = {"ssn": _SSN, "number": _NUMBER, "document": _DOCUMENT}[kind].match(text, last + 1)
                span = m.span(1) if m else None
            if span:
                more.append(("account", *span))
    known = set(base)
    return _ordered(base), _ordered([s for s in dict.fromkeys(more) if s not in known])


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the mask of its first, longest span."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], MASKS[kind]]
        at = max(at, end)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans in each whole text (``doc_id, text``): counts of the base kinds, a digest of the base spans, and all spans.

    Base: e-mail, IPv4, card and phone. Anchors add: addresses with letters beyond ASCII (at-signs), user names and IPv6
    hosts in links (schemes), and bank, tax, account and document numbers after their cues. Null and empty
    texts have no spans; texts of any length are read whole; repeated rows are read each; an empty table gives no rows; other columns are not read.
    """

    def run(rows):
        out = []
        for doc, text in zip(rows.column("doc_id").to_pylist(), texts(rows)):
            base, more = find(text)
            kinds = [s[0] for s in base]
            digest = hashlib.sha256(written_spans(base).encode()).hexdigest()
            out.append((doc, *(kinds.count(k) for k in KINDS[:4]), digest, written_spans(_ordered(base + more))))
        types = [pa.int64()] * 5 + [pa.string()] * 2
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return map_slices(plain(docs, "doc_id", "text"), run, schema)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """All documents and columns, the spans in ``text`` masked and ``n_chars``, where there is one, counted again; null stays null."""

    def run(rows):
        found = [t if t is None else masked(t, sum(find(t), [])) for t in rows.column("text").to_pylist()]
        columns = {n: rows.column(n) for n in rows.schema.names}
        columns["text"] = pa.array(found, rows.schema.field("text").type)
        if "n_chars" in columns:
            same = rows.column("n_chars").to_pylist()
            columns["n_chars"] = pa.array([n if t is None else len(t) for n, t in zip(same, found)], rows.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return map_slices(docs, run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(load(spark, sf_dir, "documents"))
