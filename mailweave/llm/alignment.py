"""Alignment of two tokenizers: groups between common token ends, and links between tokens that overlap."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import load, plain, slices, text_bytes, written
from .tokens import default_path

SLICE_BYTES = 6 << 20
#: Longer texts are cut to byte ranges of this size, which different tasks read
CHUNK_BYTES = 64 << 10
#: Fragments that one task composes in a round
FAN = 8
CACHE_UNITS = 100_000

#: Places before a space where neither tokenizer joins what stands on both sides
_SAFE = re.compile(r"(?<=\S)(?= )|(?<=[^\S ])(?= \S)")
_UNSAFE = re.compile(r"  |[^\S ] (?:\s|$)")
_SPACE = "▁"
#: A link's code is the first token's id, shifted, and the second's
_SHIFT = 20


def units(text: str) -> list[str]:
    """``" " + text`` cut where neither tokenizer joins, each unit without the space it begins with.

    Tokens of the first kind stop before white space that follows other signs, those of the second kind before a space
    that follows anything but spaces.
    """
    if _UNSAFE.search(" " + text):
        return [u[1:] for u in _SAFE.split(" " + text)]
    return text.split(" ")


@dataclass(slots=True)
class Unit:
    """Tokens of a unit with their byte ends. ``good``: both kinds spell the unit."""

    a: Sequence[int]
    a_ends: Sequence[int]
    b: Sequence[int]
    b_ends: Sequence[int]
    good: bool


class Pair:
    """The two tokenizers and their tokens' lengths in bytes; one per Python worker."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        signs = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        n_a = self.a.get_vocab_size()
        self.a_bytes = [bytes(signs[c] for c in self.a.id_to_token(i)) if set(self.a.id_to_token(i)) <= set(signs) else b"" for i in range(n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(n_a, len(pieces)) > 1 << _SHIFT:
            raise ValueError("too many tokens for a pair code")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("a piece joins a space to what stands before it")
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in spelling]) for spelling in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(_SPACE)
        kinds = ((",", n_a), ("|", n_a), (",", len(pieces)), (";", len(pieces)), ("\n", len(pieces)))
        self.written = [f"{i}{sign}" for sign, n in kinds for i in range(n)]

    def encode(self, keys: list[str]) -> list[Unit]:
        """The units' tokens; a key is a unit without its first space."""
        out = []
        firsts = self.a.encode_batch([" " + k for k in keys], add_special_tokens=False)
        seconds = self.b.encode(keys, num_threads=1)
        for key, first, b in zip(keys, firsts, seconds):
            a, b = first.ids, b if key else [self.space]
            spelt = b"".join([self.a_bytes[i] for i in a]), b"".join([self.b_bytes[i] for i in b])
            out.append(Unit(tuple(a), self.ends(a, self.a_bytes), tuple(b), self.ends(b, self.b_bytes), spelt == (2 * (b" " + key.encode(),))))
        return out

    def word_entries(self, keys: list[str]) -> list[tuple]:
        """Entries of words (:func:`is_word`), as :func:`entry_of` has them: they never join, so they are
        tokenised as one text, and cut, grouped and linked by their ends all at once."""
        text = " ".join(keys)
        whole = (" " + text).encode()
        a = np.array(self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text), np.int64)
        if any(b"".join([spelling[i] for i in ids.tolist()]) != whole for ids, spelling in ((a, self.a_bytes), (b, self.b_bytes))):
            return [unit_entry(u) for u in self.encode(keys)]
        stops = np.append(np.flatnonzero(np.frombuffer(whole, np.uint8)[1:] == 32) + 1, len(whole))
        a_ends, b_ends = np.cumsum(self.a_lengths[a]), np.cumsum(self.b_lengths[b])
        ends = np.union1d(a_ends, b_ends)
        links = (a[np.searchsorted(a_ends, ends)] << _SHIFT) + b[np.searchsorted(b_ends, ends)]
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        counts = np.stack([np.diff(np.searchsorted(x, stops, "right"), prepend=0) for x in (a_ends, b_ends, common, ends)], axis=1)
        # tokens in the order of the groups' text, each with the sign that follows it
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        in_last = np.append(common[a_group] == a_ends, False)[: len(a)]
        b_sign = np.where(np.isin(b_ends, stops), 2, (common[b_group] == b_ends).astype(np.int64))
        pieces = np.concatenate([a + in_last * len(self.a_bytes), 2 * len(self.a_bytes) + b + b_sign * len(self.b_bytes)])[order]
        groups = "".join(map(self.written.__getitem__, pieces.tolist())).split("\n")
        codes, at = links.tobytes(), [0, *(8 * np.cumsum(counts[:, 3])).tolist()]
        return [((*c, 0), g, codes[i:j]) for c, g, i, j in zip(counts.tolist(), groups, at, at[1:])]

    @staticmethod
    def ends(ids: Iterable[int], spelling: list[bytes]) -> tuple[int, ...]:
        at, out = 0, []
        for i in ids:
            at += len(spelling[i])
            out.append(at)
        return tuple(out)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


@dataclass(frozen=True)
class Open:
    """Tokens with their byte ends, between two common ends of which at least one is not known yet."""

    a: tuple[int, ...] = ()
    a_ends: tuple[int, ...] = ()
    b: tuple[int, ...] = ()
    b_ends: tuple[int, ...] = ()

    def __add__(self, other: Open) -> Open:
        return Open(self.a + other.a, self.a_ends + other.a_ends, self.b + other.b, self.b_ends + other.b_ends)

    def links(self) -> list[tuple[int, int]]:
        """Pairs whose byte ranges overlap: one for each stretch between two neighbouring ends of either kind."""
        i = j = 0
        out = [(self.a[0], self.b[0])]
        while self.a_ends[i] != self.b_ends[j] or i + 1 < len(self.a):
            x, y = self.a_ends[i], self.b_ends[j]
            i, j = i + (x <= y), j + (y <= x)
            out.append((self.a[i], self.b[j]))
        return out

    def __str__(self) -> str:
        return ",".join(map(str, self.a)) + "|" + ",".join(map(str, self.b))


@dataclass(frozen=True)
class Fragment:
    """What a byte range of a text tells about its alignment; ranges next to each other compose associatively.

    ``head`` holds the tokens up to the first common end in the range, ``closed`` the groups between common ends,
    ``tail`` the tokens after the last. Without a common end (``whole``) everything is ``head``. ``home`` is the number of the
    range in which ``head`` ends. Closed groups come as (home, group), so they can be left where they arose.
    """

    head: Open = Open()
    closed: tuple[tuple[int, Open], ...] = ()
    tail: Open = Open()
    whole: bool = True
    home: int = -1

    def __add__(self, other: Fragment) -> Fragment:
        if self.whole and other.whole:
            return Fragment(self.head + other.head)
        if self.whole:
            return Fragment(self.head + other.head, other.closed, other.tail, False, other.home)
        if other.whole:
            return Fragment(self.head, self.closed, self.tail + other.head, False, self.home)
        seam = ((other.home, self.tail + other.head),)
        return Fragment(self.head, self.closed + seam + other.closed, other.tail, False, self.home)


def fragment(tokens: Open, home: int) -> Fragment:
    """The fragment of tokens that follow each other."""
    groups, i, j = [], 0, 0
    common = sorted(set(tokens.a_ends) & set(tokens.b_ends))
    for end in common:
        k, m = i, j
        while tokens.a_ends[i] != end:
            i += 1
        while tokens.b_ends[j] != end:
            j += 1
        i, j = i + 1, j + 1
        groups.append(Open(tokens.a[k:i], tokens.a_ends[k:i], tokens.b[m:j], tokens.b_ends[m:j]))
    rest = Open(tokens.a[i:], tokens.a_ends[i:], tokens.b[j:], tokens.b_ends[j:])
    if not groups:
        return Fragment(rest)
    return Fragment(groups[0], tuple((home, g) for g in groups[1:]), rest, False, home)


def is_word(key: str) -> bool:
    """Units that may stand side by side in any order: without spaces, and no white space at either end."""
    return key != "" and " " not in key and not (key[0].isspace() or key[-1].isspace())


class _Numbers(dict):
    """Keys numbered as they come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class UnitTable:
    """Units met in a slice, numbered; what each adds to a text: counts, its groups as text, its links as pair codes."""

    def __init__(self, pair: Pair, cache: dict):
        self.pair, self.cache = pair, cache
        self.numbers = _Numbers()

    def codes(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, keys), np.uint32, len(keys))

    def finish(self, uses: np.ndarray | None = None) -> None:
        """Entries of all units; those used more than once in the slice are kept for later ones, up to a number."""
        found, words, others = {}, [], []
        for key in self.numbers:
            known = self.cache.get(key)
            if known is not None:
                found[key] = known
            else:
                (words if is_word(key) else others).append(key)
        for at in range(0, len(words), 5_000):
            some = words[at : at + 5_000]
            found.update(zip(some, self.pair.word_entries(some)))
        for at in range(0, len(others), 5_000):
            some = others[at : at + 5_000]
            found.update(zip(some, map(unit_entry, self.pair.encode(some))))
        entries = [found[k] for k in self.numbers]
        if uses is not None:
            if len(self.cache) > CACHE_UNITS:
                self.cache.clear()
            often = np.bincount(uses, minlength=len(entries)) > 1
            self.cache.update((k, e) for k, e, o in zip(self.numbers, entries, often.tolist()) if o)
        self.counts = np.array([e[0] for e in entries], np.int64).reshape(-1, 5)
        self.groups = [e[1] for e in entries]
        self.links = np.frombuffer(b"".join([e[2] for e in entries]), "<i8")


def unit_entry(unit: Unit) -> tuple[tuple[int, ...], str, bytes]:
    """Tokens of both kinds, groups, links and whether it is misspelt; groups as text; links. One pass over both
    kinds' ends: a link for each stretch between two ends, a new group after each common end."""
    if not unit.good:
        return (0, 0, 0, 0, 1), "", b""
    a, a_ends, b, b_ends = unit.a, unit.a_ends, unit.b, unit.b_ends
    links, text = array("q"), []
    i = j = first_a = first_b = 0
    while i < len(a):
        links.append((a[i] << _SHIFT) + b[j])
        x, y = a_ends[i], b_ends[j]
        if x <= y:
            i += 1
        if y <= x:
            j += 1
            if x == y:
                text.append(",".join(map(str, a[first_a:i])) + "|" + ",".join(map(str, b[first_b:j])))
                first_a, first_b = i, j
    return (len(a), len(b), len(text), len(links), 0), ";".join(text), links.tobytes()


def entry_of(groups: list[Open]) -> tuple[tuple[int, ...], str, bytes]:
    """The same for groups."""
    links = [(a << _SHIFT) + b for g in groups for a, b in g.links()]
    counts = sum(len(g.a) for g in groups), sum(len(g.b) for g in groups), len(groups), len(links), 0
    return counts, ";".join(map(str, groups)), np.array(links, "<i8").tobytes()


_CACHE: dict[str, tuple] = {}
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_PART = "doc_id array<long>, seq array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, groups array<string>"
#: ``row`` is null for texts in one range, which have a ``digest``; ranges of longer ones have the text of their ``groups``
_SLICES = f"slice long, row long, {_PART}, use_count array<long>, uses binary, link_count binary, links binary"
_NAMES = [f.split()[0] for f in _SLICES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 6, pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 3]


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _slice_row(number, row, doc_ids, seqs, counts, digests, groups, use_count, uses, link_count, links) -> pa.RecordBatch:
    values = [number, row, doc_ids, seqs, *np.asarray(counts, np.int64).reshape(-1, 4).T.tolist(), digests, groups, use_count]
    values += [_packed(uses.astype("<u4")), _packed(np.asarray(link_count).astype("<u4")), _packed(links)]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES)], names=_NAMES)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of ``counts`` values, which may be empty."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _short(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Slices of texts that lie in one range each."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in slices(batch, most=SLICE_BYTES):
                table = UnitTable(pair_of(*paths), _CACHE)
                codes = [table.codes(units(t)) if t else np.zeros(0, np.uint32) for t in rows.column("text").to_pylist()]
                n = np.array([len(c) for c in codes], np.int64)
                uses = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
                table.finish(uses)
                counts = _sums(table.counts[uses], n) if len(uses) else np.zeros((len(n), 5), np.int64)
                bad = counts[:, 4] > 0
                counts[bad] = 0
                digests = []
                for i, c in enumerate(codes):
                    text = "" if bad[i] or not len(c) else ";".join(map(table.groups.__getitem__, c.tolist()))
                    digests.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
                uses, n = uses[np.repeat(~bad, n)], np.where(bad, 0, n)
                doc_ids = rows.column("doc_id").cast(pa.int64()).to_pylist()
                yield _slice_row(number, None, doc_ids, [0] * len(n), counts[:, :4], digests, None, n.tolist(), uses, table.counts[:, 3], table.links)
                number += 1

    return docs.mapInArrow(run, _SLICES)


_OPEN = "struct<a:array<int>,a_ends:array<long>,b:array<int>,b_ends:array<long>>"
_FRAGMENT = f"row long, doc_id long, chunk int, good boolean, whole boolean, home int, head {_OPEN}, tail {_OPEN}, seams array<struct<home:int,group:{_OPEN}>>"
_OPEN_TYPE = pa.struct([("a", pa.list_(pa.int32())), ("a_ends", pa.list_(pa.int64())), ("b", pa.list_(pa.int32())), ("b_ends", pa.list_(pa.int64()))])
_FRAGMENT_TYPE = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("good", pa.bool_()), ("whole", pa.bool_()), ("home", pa.int32()),
        ("head", _OPEN_TYPE), ("tail", _OPEN_TYPE), ("seams", pa.list_(pa.struct([("home", pa.int32()), ("group", _OPEN_TYPE)]))),
    ]
)
_RANGES = "row long, doc_id long, chunk int, begin long, low long, high long, keys array<string>"
_RANGE_TYPE = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), *((c, pa.int64()) for c in ("begin", "low", "high")), ("keys", pa.list_(pa.string()))]
)


def _ranges(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Long texts as byte ranges (``low``, ``high``], with the units that a range touches, the first one at ``begin``.

    A range ends every ``chunk_bytes``, often within a unit or a token; a unit longer than that stays in one range.
    """

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist()):
                keys = units(text)
                sizes = np.array([len(k.encode()) + 1 for k in keys])
                ends = np.cumsum(sizes)
                cuts = np.arange(chunk_bytes, int(ends[-1]), chunk_bytes)
                holds = np.searchsorted(ends, cuts, "left")
                cuts = np.unique(np.append(np.where(sizes[holds] > chunk_bytes, ends[holds], cuts), [0, ends[-1]]))
                for chunk, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                    first, last = int(np.searchsorted(ends, low, "right")), int(np.searchsorted(ends, high, "left"))
                    begin = int(ends[first] - sizes[first])
                    found = {"row": row, "doc_id": doc_id, "chunk": chunk, "begin": begin, "low": low, "high": high, "keys": keys[first : last + 1]}
                    yield pa.RecordBatch.from_pylist([found], schema=_RANGE_TYPE)
                row += 1

    return docs.mapInArrow(run, _RANGES)


def _as_open(x: dict) -> Open:
    return Open(*(tuple(x[c]) for c in ("a", "a_ends", "b", "b_ends")))


def _as_row(row: int, doc_id: int | None, chunk: int, good: bool, found: Fragment) -> dict:
    seams = [{"home": home, "group": vars(group)} for home, group in found.closed]
    return {
        "row": row, "doc_id": doc_id, "chunk": chunk, "good": good, "whole": found.whole, "home": found.home,
        "head": vars(found.head), "tail": vars(found.tail), "seams": seams,
    }


def _within(unit: Unit, begin: int, low: int, high: int) -> Open:
    """The tokens of a unit at byte ``begin`` that end after ``low`` and not after ``high``."""
    a = [(i, e + begin) for i, e in zip(unit.a, unit.a_ends) if low < e + begin <= high]
    b = [(i, e + begin) for i, e in zip(unit.b, unit.b_ends) if low < e + begin <= high]
    return Open(tuple(i for i, _ in a), tuple(e for _, e in a), tuple(i for i, _ in b), tuple(e for _, e in b))


def _read_ranges(ranges: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Each range as a fragment without closed groups, and as a slice of its closed groups."""

    def one(x: dict, number: int) -> pa.RecordBatch:
        pair, keys = pair_of(*paths), x["keys"]
        edge = pair.encode(keys[:1] + keys[1:][-1:])
        begins = [x["begin"], x["high"]]
        if len(edge) > 1:
            begins[1] = x["begin"] + sum(len(k.encode()) + 1 for k in keys[:-1])
        parts = [fragment(_within(u, at, x["low"], x["high"]), x["chunk"]) for u, at in zip(edge, begins)]
        table = UnitTable(pair, _CACHE)
        uses = table.codes(keys[1:-1])
        table.finish()
        good = all(u.good for u in edge) and not table.counts[:, 4].any()
        whole = reduce(Fragment.__add__, parts) if good else Fragment()
        # inner units stand after the first unit's groups and before the last one's
        before = [g for _, g in parts[0].closed] if good else []
        after = [g for _, g in whole.closed][len(before) :]
        entries = [entry_of(before), entry_of(after)]
        middle = [table.groups[i] for i in uses.tolist()] if good else []
        text = ";".join(t for t in (entries[0][1], *middle, entries[1][1]) if t)
        counts = _sums(table.counts[uses], np.array([len(uses)]))[0] + np.array([e[0] for e in entries]).sum(axis=0)
        n = len(table.groups)
        uses = np.append(uses, [n, n + 1]).astype(np.uint32)
        link_count = np.append(table.counts[:, 3], [e[0][3] for e in entries])
        links = np.frombuffer(table.links.tobytes() + entries[0][2] + entries[1][2], "<i8")
        piece = _slice_row(number, x["row"], [x["doc_id"]], [2 * x["chunk"] + 1], counts[None, :4], [None], [text], [len(uses)], uses, link_count, links)
        left = Fragment(whole.head, (), whole.tail, whole.whole, whole.home)
        row = pa.RecordBatch.from_pylist([_as_row(x["row"], x["doc_id"], x["chunk"], good, left)], schema=_FRAGMENT_TYPE)
        return pa.RecordBatch.from_arrays([*piece.columns, pa.StructArray.from_arrays(row.columns, fields=list(_FRAGMENT_TYPE))], names=[*_NAMES, "fragment"])

    def run(batches):
        number = (TaskContext.get().partitionId() << 40) + (1 << 38)
        for batch in batches:
            for x in batch.to_pylist():
                yield one(x, number)
                number += 1

    return ranges.mapInArrow(run, StructType.fromDDL(_SLICES).add("fragment", StructType.fromDDL(_FRAGMENT)))


def _compose(group: pa.Table) -> pa.Table:
    """Neighbouring fragments of a text as one; the groups that close between them are its ``seams``."""
    rows = sorted(group.to_pylist(), key=lambda x: x["chunk"])
    parts = [Fragment(_as_open(x["head"]), (), _as_open(x["tail"]), x["whole"], x["home"]) for x in rows]
    found = reduce(Fragment.__add__, parts)
    first = rows[0]
    return pa.Table.from_pylist([_as_row(first["row"], first["doc_id"], first["chunk"] // FAN, all(x["good"] for x in rows), found)], schema=_FRAGMENT_TYPE)


def _seam_slices(composed: DataFrame) -> DataFrame:
    """The groups that closed between ranges, as slices."""

    def run(batches):
        number = (TaskContext.get().partitionId() << 40) + (2 << 38)
        for batch in batches:
            for x in batch.to_pylist():
                if x["seams"]:
                    entries = [entry_of([_as_open(s["group"])]) for s in x["seams"]]
                    n = len(entries)
                    counts = np.array([e[0] for e in entries], np.int64)
                    yield _slice_row(
                        number, x["row"], [x["doc_id"]] * n, [2 * s["home"] for s in x["seams"]], counts[:, :4], [None] * n, [e[1] for e in entries],
                        [1] * n, np.arange(n), counts[:, 3], np.frombuffer(b"".join(e[2] for e in entries), "<i8"),
                    )
                    number += 1

    return composed.select("row", "doc_id", "seams").mapInArrow(run, _SLICES)


def _long(docs: DataFrame, paths: tuple[str, str], chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Slices of long texts, and the rows of those that are misspelt. Fragments are composed ``FAN`` at a time, each
    round in tasks of its own, until a text is one fragment."""
    ranges = written(_read_ranges(_ranges(docs, chunk_bytes).repartition("row", "chunk"), paths), "ranges")
    level = ranges.select("fragment.*")
    most = ranges.agg(F.max("fragment.chunk")).first()[0]
    found = [ranges.drop("fragment")]
    while most is not None:
        near = level.groupBy("row", F.floor(F.col("chunk") / FAN))
        level = written(near.applyInArrow(_compose, _FRAGMENT), "fragments")
        found.append(_seam_slices(level))
        most = most // FAN if most else None
    # what is left is the group from the text's begin to its first common end
    ends = level.where("NOT whole").select("row", "doc_id", F.array(F.struct("home", F.col("head").alias("group"))).alias("seams"))
    found.append(_seam_slices(ends))
    bad = level.where("NOT good").select("row", "doc_id")
    all_of = reduce(DataFrame.unionByName, found)
    return written(all_of.join(bad, "row", "left_anti").select(*_NAMES), "long"), bad


_MEASURED = "doc_id long, row long, seq long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, digest string, groups string"


def _pair_counts(found: DataFrame) -> DataFrame:
    """How often each slice links two ids: ``slice, pair, n``."""

    def run(batches):
        for batch in batches:
            for x in batch.to_pylist():
                link_count, links = _unpacked(x["link_count"], "<u4").astype(np.int64), _unpacked(x["links"], "<i8")
                times = np.bincount(_unpacked(x["uses"], "<u4"), minlength=len(link_count))
                pairs, where = np.unique(links, return_inverse=True)
                n = np.bincount(where, weights=np.repeat(times, link_count), minlength=len(pairs)).astype(np.int64)
                pairs, n = pairs[n > 0], n[n > 0]
                for at in range(0, len(pairs), 50_000):
                    some = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pairs[some]), x["slice"])), pa.array(pairs[some]), pa.array(n[some])], names=["slice", "pair", "n"]
                    )

    return found.select("slice", "uses", "link_count", "links").mapInArrow(run, "slice long, pair long, n long")


def _measure(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each part of a slice with the counts of its links summed."""
    x = left.to_pylist()[0]
    pair, total, best = (right.column(c).to_numpy() for c in ("pair", "total", "best"))
    order = np.argsort(pair)
    pair, values = pair[order], np.stack([best[order].astype(np.int64), total[order]], axis=1)
    links, link_count = _unpacked(x["links"], "<i8"), _unpacked(x["link_count"], "<u4").astype(np.int64)
    # links of units that no good text uses have no count
    at = np.minimum(np.searchsorted(pair, links), max(len(pair) - 1, 0))
    per_link = np.where((pair[at] == links)[:, None], values[at], 0) if len(pair) else np.zeros((len(links), 2), np.int64)
    per_unit = _sums(per_link, link_count)
    uses = _unpacked(x["uses"], "<u4")
    sums = _sums(per_unit[uses], np.array(x["use_count"], np.int64)) if len(uses) else np.zeros((len(x["seq"]), 2), np.int64)
    n = len(x["seq"])
    return pa.table(
        {
            "doc_id": pa.array(x["doc_id"], pa.int64()),
            "row": pa.array([x["row"]] * n, pa.int64()),
            **{c: pa.array(x[c], pa.int64()) for c in ("seq", *_NUMBERS)},
            "n_best": pa.array(sums[:, 0]),
            "count_sum": pa.array(sums[:, 1]),
            "digest": pa.array(x["digest"], pa.string()),
            "groups": pa.array(x["groups"] or [None] * n, pa.string()),
        }
    )


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SUMMED = (*_NUMBERS, "n_best", "count_sum")


def _joined(parts: DataFrame) -> DataFrame:
    """Long texts from their parts in order."""

    def run(batches):
        now = doc_id = sha = None
        sums = np.zeros(len(_SUMMED), np.int64)

        def done():
            return pa.RecordBatch.from_pylist([{"doc_id": doc_id, **dict(zip(_SUMMED, sums.tolist())), "groups_sha256": sha.hexdigest()}], schema=_RESULT_TYPE)

        for batch in batches:
            for x in batch.to_pylist():
                if x["row"] != now:
                    if sha:
                        yield done()
                    now, doc_id, sha, begun = x["row"], x["doc_id"], hashlib.sha256(), False
                    sums = np.zeros(len(_SUMMED), np.int64)
                sums = sums + [x[c] for c in _SUMMED]
                if x["groups"]:
                    sha.update(((";" if begun else "") + x["groups"]).encode())
                    begun = True
        if sha:
            yield done()

    return parts.repartition("row").sortWithinPartitions("row", "seq").mapInArrow(run, _RESULT)


_RESULT_TYPE = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in _SUMMED), ("groups_sha256", pa.string())])


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """How a byte-level and a piece tokenizer cut each text: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Both read ``" " + text``. Byte offsets at which tokens of both end cut them into groups; tokens whose bytes overlap
    are linked. A pair of ids counts its links in the whole corpus; ``n_best`` are a text's links whose count is the
    highest of their second id, ``count_sum`` adds up the counts of all its links.

    Texts are read in units between which neither tokenizer joins, so units met before need no second look. Texts over
    ``chunk_bytes`` are cut to byte ranges anywhere; a range yields an open prefix, closed groups and an open suffix, and
    :class:`Fragment` composes neighbours associatively in a tree of Spark tasks. Only open parts go up the tree;
    closed groups stay where they arose and are hashed in order in the end. A slice of the corpus sends a
    pair of ids once with its count.

    Null and empty texts, and those that a tokenizer does not spell back (they hold U+2581), have zeros and '' and add to no
    count. Rows are texts of their own, also where a doc_id repeats or is null. A unit longer than ``chunk_bytes`` is read
    by one task. An empty table gives no rows; other columns are not read.
    """
    paths = a_path, b_path
    docs = plain(docs, "doc_id", "text")
    is_long = text_bytes() >= chunk_bytes
    short = written(_short(docs.where(~is_long), paths), "aligned")
    long, bad = _long(docs.where(is_long), paths, chunk_bytes)
    found = short.unionByName(long)
    sent = _pair_counts(found)
    second = F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    highest = F.max("total").over(Window.partitionBy(second))
    totals = sent.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("best", F.col("total") == highest)
    answers = sent.select("slice", "pair").join(totals, "pair")
    parts = found.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_measure, _MEASURED)
    parts = written(parts, "measured")
    names = [f.split()[0] for f in _RESULT.split(", ")]
    out = parts.where("row IS NULL").withColumnRenamed("digest", "groups_sha256").select(*names)
    out = out.unionByName(_joined(parts.where("row IS NOT NULL")))
    zeros = bad.select("doc_id", *(F.lit(0).cast("long").alias(c) for c in names[1:-1]), F.lit("").alias(names[-1]))
    return out.unionByName(zeros)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(load(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"))
