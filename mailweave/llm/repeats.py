"""Removal of repeated byte strings: suffix arrays over shards in which equal strings are sure to meet."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, load, plain, raw_texts, slices, written
from .induced import permuted_prefixes, suffix_array

LENGTH = 100
#: Anchors are substrings of so many bytes; each window of ``LENGTH`` bytes is dealt by one of its own.
GRAM = 32
PART_BYTES = 1 << 20
SHARD_BYTES = 2 << 20
#: An anchor with more different pieces than this is dealt by whole windows instead
HOT = 2_000
#: Stands for null ids while the least one is sought
_LATE = np.iinfo(np.int64).max
#: No UTF-8 text holds this byte.
_BETWEEN = 0xFF

_ODD, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Windows that are hashed at a time
_BLOCK = 1 << 16
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_LISTS = ("doc_id", "row", "doc_bytes", "start", "own", "bytes")
_SLICES = f"slice long, {', '.join(f'{name} array<long>' for name in _LISTS)}, text binary"
_DEALT = "key long, doc_id long, row long, start long, slice long, place int, at int, windows int, text binary"
_GONE = "slice long, place int, at int, windows int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    size = 1 << max(n, 1).bit_length()
    if size not in _POWERS:
        _POWERS.clear()
        found = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            found.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[size] = found[0], found[1]
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


class Pieces:
    """The windows of some texts, cut to pieces: neighbours dealt by the same anchor lie in one piece.

    A window's anchor is the substring of ``gram`` bytes in it that has the smallest hash, the leftmost of equal ones.
    It depends on the window's bytes alone, so equal windows have equal anchors wherever they stand.
    ``first`` and ``windows`` are the pieces' first windows and their numbers; ``gram`` and ``content`` hash a piece's anchor
    and its bytes.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        n, gram = len(text), min(gram, length)
        inside = np.ones(n + 1, bool)  # windows that stay within their text
        for end, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
            inside[max(end - length + 1, end - size) : end] = False
        found = [_cut(text[at : at + _BLOCK + length - 1], inside[at : at + _BLOCK], at, length, gram) for at in range(0, n - length + 1, _BLOCK)]
        none = [np.zeros(0, np.int64)] * 4
        self.first, self.windows, self.gram, self.content = map(np.concatenate, zip(*(found or [none])))


def _cut(text: np.ndarray, inside: np.ndarray, at: int, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Pieces of a block, small enough for the processor's cache: first windows, numbers of windows, hashes."""
    power, inverse = _powers(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[: len(text)], out=sums[1:])
    hashed = _mixed((sums[gram:] - sums[:-gram]) * inverse[: len(text) - gram + 1])
    least = (hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64)
    width, span = 1, length - gram + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = inside[: len(anchor)]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(fresh)
    windows = np.diff(np.append(first, len(anchor)))
    first, windows = first[inside[first]], windows[inside[first]]
    content = _mixed((sums[first + windows + length - 1] - sums[first]) * inverse[first])
    return first + at, windows, hashed[anchor[first]].view(np.int64), content.view(np.int64)


def _parts(docs: DataFrame, length: int, part_bytes: int, slice_bytes: int) -> DataFrame:
    """The texts in slices, one compressed row each. A text goes in parts of ``part_bytes`` of its own, from its byte
    ``start`` on, with the ``length - 1`` bytes after them, so that each window lies whole in one part."""
    names = ["slice", *_LISTS, "text"]

    def packed(number: int, parts: list[tuple], texts: list[bytes]) -> pa.RecordBatch:
        lists = [pa.array([c], pa.list_(pa.int64())) for c in zip(*parts)]
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([blob], pa.binary())], names=names)

    def parts_of(batches) -> Iterator[tuple[tuple, bytes]]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in slices(batch):
                for doc_id, text in zip(rows.column("doc_id").cast(pa.int64()).to_pylist(), raw_texts(rows)):
                    for start in range(0, max(len(text), 1), part_bytes):
                        part = text[start : start + part_bytes + length - 1]
                        yield (doc_id, row, len(text), start, min(part_bytes, len(text) - start), len(part)), part
                    row += 1

    def run(batches):
        number, size, parts, texts = TaskContext.get().partitionId() << 40, 0, [], []
        for part, text in parts_of(batches):
            parts.append(part)
            texts.append(text)
            size += len(text)
            if size >= slice_bytes or len(parts) >= 20_000:
                yield packed(number, parts, texts)
                number, size, parts, texts = number + 1, 0, [], []
        if parts:
            yield packed(number, parts, texts)

    return plain(docs, "doc_id", "text").mapInArrow(run, _SLICES)


def _opened(table: pa.Table | pa.RecordBatch, i: int = 0) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A slice's lists and its bytes. A null doc_id has ``none`` set and 0 as its number."""
    lists = {}
    for name in _LISTS:
        values = pa.array(table.column(name)[i].values)
        if name == "doc_id":
            lists["none"] = values.is_null().to_numpy(zero_copy_only=False)
            values = values.fill_null(0)
        lists[name] = values.to_numpy(zero_copy_only=False)
    data = zstandard.ZstdDecompressor().decompress(table.column("text")[i].as_py())
    return lists, np.frombuffer(data, np.uint8)


def _anchors(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """One row for each anchor of a slice: how many different pieces it has there, whether it stands there more than
    once, the piece's hash if there is one only, and the earliest document."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                lists, text = _opened(batch, i)
                found = Pieces(text, lists["bytes"], length, gram)
                order = np.lexsort((found.content, found.gram))
                key, content = found.gram[order], found.content[order]
                starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                other = np.append(True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])) if len(key) else np.zeros(0, bool)
                n = np.add.reduceat(other.astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32)
                again = np.diff(np.append(starts, len(key))) > 1
                doc = np.where(lists["none"], _LATE, lists["doc_id"])[np.searchsorted(np.cumsum(lists["bytes"]), found.first[order], "right")]
                doc = np.minimum.reduceat(doc, starts) if len(starts) else doc
                for at in range(0, len(starts), 50_000):
                    some = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key[starts[some]]),
                            pa.array(np.full(len(starts[some]), batch.column("slice")[i].as_py())),
                            pa.array(n[some], pa.int32()),
                            pa.array(again[some]),
                            pa.array(content[starts[some]], mask=n[some] > 1),
                            pa.array(doc[some], mask=doc[some] == _LATE),
                        ],
                        names=["gram", "slice", "n", "again", "content", "doc_id"],
                    )

    return parts.mapInArrow(run, "gram long, slice long, n int, again boolean, content long, doc_id long")


def _repeated(anchors: DataFrame, hot: int) -> DataFrame:
    """The anchors that stand at two places or more, for each slice that holds them: ``slice, gram, kind``.

    A slice has counted its own, so an anchor that is everywhere has one row for each slice here. An anchor that has
    the same piece everywhere is decided: its first slice keeps it (``kind`` 1), the others have copies (0). Other
    anchors go to a shard, by pieces (2) or, if there are more than ``hot``, by windows (3).
    """
    all_of = Window.partitionBy("gram")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "slice")
    one_piece = (F.max("n").over(all_of) == 1) & (F.min("content").over(all_of) == F.max("content").over(all_of))
    mine = F.min(order).over(all_of)["slice"] == F.col("slice")
    kind = F.when(one_piece, mine.cast("int")).otherwise(F.when(F.sum("n").over(all_of) > hot, 3).otherwise(2))
    places = F.count("*").over(all_of) + F.max(F.col("again").cast("int")).over(all_of)
    return anchors.withColumn("kind", kind).withColumn("places", places).where("places > 1").select("slice", "gram", "kind")


def _first_of_each(order: np.ndarray, text: list[bytes]) -> np.ndarray:
    """Whether each piece is the first with its bytes, going through them in ``order``."""
    seen: set[bytes] = set()
    first = np.zeros(len(text), bool)
    for i in order.tolist():
        if text[i] not in seen:
            seen.add(text[i])
            first[i] = True
    return first


def _deal(left: pa.Table, right: pa.Table, length: int, gram: int) -> pa.Table:
    """Pieces of one slice whose anchor is repeated. Of pieces with the same bytes only the first goes on to a
    shard; the windows of the others are repeats already. Pieces of hot anchors go as single windows."""
    lists, text = _opened(left)
    found = Pieces(text, lists["bytes"], length, gram)
    wanted, kinds = right.column("gram").to_numpy(), right.column("kind").to_numpy()
    order = np.argsort(wanted)
    wanted, kinds = wanted[order], kinds[order]
    at = np.minimum(np.searchsorted(wanted, found.gram), max(len(wanted) - 1, 0))
    chosen = np.flatnonzero(wanted[at] == found.gram) if len(wanted) else np.zeros(0, np.int64)
    kind = kinds[at[chosen]] if len(chosen) else np.zeros(0, np.int32)
    first, windows, key, content = (x[chosen] for x in (found.first, found.windows, found.gram, found.content))
    hot = kind == 3
    single = np.repeat(first[hot] - np.cumsum(windows[hot]) + windows[hot], windows[hot]) + np.arange(windows[hot].sum())
    data = text.tobytes()
    by_bytes = [int.from_bytes(hashlib.blake2b(data[a : a + length], digest_size=8).digest(), "little", signed=True) for a in single.tolist()]
    # a hot anchor's pieces fall into windows, dealt by all their bytes
    first, windows = np.append(first[~hot], single), np.append(windows[~hot], np.ones(len(single), np.int64))
    key, kind = np.append(key[~hot], np.array(by_bytes, np.int64)), np.append(kind[~hot], np.full(len(single), 2))
    ends = np.cumsum(lists["bytes"])
    place = np.searchsorted(ends, first, "right")
    offset = first - (ends - lists["bytes"])[place]
    start = lists["start"][place] + offset
    order = np.lexsort((start, lists["row"][place], lists["doc_id"][place], lists["none"][place]))
    # in their order, the first piece of a decided anchor stays where its first slice is, that of others goes on
    stays = np.zeros(len(first), bool)
    decided = order[kind[order] == 1]
    stays[decided[np.unique(key[decided], return_index=True)[1]]] = True
    sent: dict[bytes, int] = {}
    for i in order[kind[order] == 2].tolist():
        sent.setdefault(data[first[i] : first[i] + windows[i] + length - 1], i)
    stays[list(sent.values())] = True
    cut: list[bytes | None] = [None] * len(first)
    for piece, i in sent.items():
        cut[i] = piece
    number = left.column("slice")[0].as_py()
    table = pa.table(
        {
            "key": pa.array(key, pa.int64()),
            "doc_id": pa.array(lists["doc_id"][place], pa.int64(), mask=lists["none"][place]),
            "row": pa.array(lists["row"][place], pa.int64()),
            "start": pa.array(start, pa.int64()),
            "slice": pa.array(np.full(len(first), number), pa.int64()),
            "place": pa.array(place, pa.int32()),
            "at": pa.array(offset, pa.int32()),
            "windows": pa.array(windows, pa.int32()),
            "text": pa.array(cut, pa.binary()),
        }
    )
    # neighbouring repeats are one run
    gone = np.flatnonzero(~stays)
    gone = gone[np.argsort(first[gone], kind="stable")]
    new = np.append(True, (first[gone][1:] != (first + windows)[gone][:-1]) | (place[gone][1:] != place[gone][:-1])) if len(gone) else np.zeros(0, bool)
    runs = gone[new]
    n = np.add.reduceat(windows[gone], np.flatnonzero(new)) if len(gone) else np.zeros(0, np.int64)
    local = pa.table(
        {
            "slice": pa.array(np.full(len(runs), number), pa.int64()),
            "place": pa.array(place[runs], pa.int32()),
            "at": pa.array(offset[runs], pa.int32()),
            "windows": pa.array(n, pa.int32()),
        }
    )
    return pa.concat_tables([table.take(pa.array(list(sent.values()), pa.int64())), local], promote_options="default").select(table.column_names)


def _judge(pieces: pa.Table, length: int) -> pa.Table:
    """Windows of a shard's pieces that also start earlier: ``slice, place, at, windows``.

    The pieces stand in the order of their texts, so the smallest place in the shard is the earliest start.
    """
    text = pieces.column("text").to_pylist()
    none = pieces.column("doc_id").is_null().to_numpy()
    doc_id = pieces.column("doc_id").fill_null(0).to_numpy()
    windows = pieces.column("windows").to_numpy().astype(np.int64)
    order = np.lexsort((pieces.column("start").to_numpy(), pieces.column("row").to_numpy(), doc_id, none))
    stays = _first_of_each(order, text)
    copies, kept = np.flatnonzero(~stays), order[stays[order]]
    # the windows of one piece all differ, so a piece needs company under its anchor
    key = pieces.column("key").to_numpy()[kept]
    values, of, n = np.unique(key, return_inverse=True, return_counts=True)
    kept = kept[n[of] > 1]
    if not len(kept):
        return _gone(pieces, copies, np.zeros(len(copies), np.int64), windows[copies])
    size = windows[kept] + length - 1
    begin = np.cumsum(size + 1) - size - 1
    data = np.frombuffer(bytes([_BETWEEN]).join([text[i] for i in kept.tolist()]), np.uint8)
    piece = np.repeat(np.arange(len(kept)), size + 1)[: len(data)]
    offset = np.arange(len(data)) - begin[piece]
    sa = suffix_array(data, 256)
    common = permuted_prefixes(data, sa, length + int(size.max()) + 8, begin)
    # whole windows that are equal are neighbours: a suffix between them would be such a window, too
    sa = sa[offset[sa] < windows[kept][piece[sa]]]
    starts = np.flatnonzero(common[sa] < length)
    starts = starts if len(starts) and starts[0] == 0 else np.append(0, starts)
    oldest = np.minimum.reduceat(sa, starts)
    late = np.zeros(len(data) + 1, np.int8)
    late[sa[sa > np.repeat(oldest, np.diff(np.append(starts, len(sa))))]] = 1
    edges = np.flatnonzero(np.diff(late, prepend=0))
    low, high = edges[::2], edges[1::2]
    which = np.concatenate([copies, kept[piece[low]]])
    at = np.concatenate([np.zeros(len(copies), np.int64), offset[low]])
    return _gone(pieces, which, at, np.concatenate([windows[copies], high - low]))


def _gone(pieces: pa.Table, which: np.ndarray, at: np.ndarray, windows: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "slice": pa.array(pieces.column("slice").to_numpy()[which], pa.int64()),
            "place": pa.array(pieces.column("place").to_numpy()[which], pa.int32()),
            "at": pa.array(pieces.column("at").to_numpy()[which] + at, pa.int32()),
            "windows": pa.array(windows, pa.int32()),
        }
    )


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
#: Parts of texts that lie in several
_LONG = "row long, start long, at array<long>, windows array<long>, own binary"


def _cover(size: int, runs: list[tuple[int, int]]) -> np.ndarray:
    """Which of ``size`` bytes lie in one of the runs (first byte, end)."""
    steps = np.zeros(size + 1, np.int32)
    for a, b in runs:
        steps[min(a, size)] += 1
        steps[min(b, size)] -= 1
    return np.cumsum(steps[:-1]) > 0


class _Text:
    """What is known of a text, part after part: removed bytes, spans, the kept bytes and their hash."""

    def __init__(self, length: int, keep: bool):
        self.length, self.keep = length, keep
        self.sha, self.kept = hashlib.sha256(), []
        self.bytes = self.removed = self.spans = self.over = 0
        self.open = False

    def add(self, own: bytes, runs: np.ndarray, windows: np.ndarray) -> None:
        """A part's own bytes and the runs of removed windows that start in it."""
        pairs = [(0, self.over), *zip(runs.tolist(), (runs + windows + self.length - 1).tolist())]
        gone = _cover(len(own), pairs)
        kept = np.frombuffer(own, np.uint8)[~gone].tobytes()
        self.sha.update(kept)
        if self.keep:
            self.kept.append(kept)
        self.bytes += len(own)
        self.removed += int(gone.sum())
        self.spans += int((np.diff(gone.astype(np.int8), prepend=np.int8(self.open)) == 1).sum())
        self.over = max(0, max(b for _, b in pairs) - len(own))
        self.open = bool(gone[-1]) if len(own) else self.open

    def row(self, doc_id) -> tuple:
        return doc_id, self.bytes, self.removed, self.spans, self.sha.hexdigest(), b"".join(self.kept) if self.keep else None


def _result(rows: list[tuple], more: list[tuple] = ()) -> pa.Table:
    names = [f.split()[0] for f in (_RESULT + ", " + _LONG).split(", ")]
    types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    rows = [(*r, None, None, None, None, None) for r in rows] + [(r[0], None, None, None, None, None, *r[1:]) for r in more]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _finish(left: pa.Table, right: pa.Table, length: int, keep: bool) -> pa.Table:
    """Results of the texts that lie in one part; parts of longer ones with their runs, to be put together."""
    lists, text = _opened(left)
    place, at, windows = (right.column(c).to_numpy().astype(np.int64) for c in ("place", "at", "windows"))
    order = np.argsort(place, kind="stable")
    place, at, windows = place[order], at[order], windows[order]
    edge = np.searchsorted(place, np.arange(len(lists["row"]) + 1))
    data, ends = text.tobytes(), np.cumsum(lists["bytes"])
    done, parts = [], []
    for i in range(len(lists["row"])):
        begin = int(ends[i] - lists["bytes"][i])
        own = data[begin : begin + int(lists["own"][i])]
        runs, n = at[edge[i] : edge[i + 1]], windows[edge[i] : edge[i + 1]]
        doc_id = None if lists["none"][i] else int(lists["doc_id"][i])
        if lists["doc_bytes"][i] == lists["own"][i]:
            one = _Text(length, keep)
            one.add(own, runs, n)
            done.append(one.row(doc_id))
        else:
            parts.append((doc_id, int(lists["row"][i]), int(lists["start"][i]), runs.tolist(), n.tolist(), own))
    return _result(done, parts)


def _joined(parts: DataFrame, length: int, keep: bool) -> DataFrame:
    """Long texts, their parts read in order."""

    def run(batches):
        now, doc_id, text = None, None, None
        for batch in batches:
            for part in batch.to_pylist():
                if part["row"] != now:
                    if text:
                        yield _result([text.row(doc_id)]).select(range(6)).to_batches()[0]
                    now, doc_id, text = part["row"], part["doc_id"], _Text(length, keep)
                text.add(part["own"], np.array(part["at"], np.int64), np.array(part["windows"], np.int64))
        if text:
            yield _result([text.row(doc_id)]).select(range(6)).to_batches()[0]

    return parts.repartition("row").sortWithinPartitions("row", "start").mapInArrow(run, _RESULT)


def repeated_removed(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    part_bytes: int = PART_BYTES,
    slice_bytes: int = SLICE_BYTES,
    shard_bytes: int = SHARD_BYTES,
    hot: int = HOT,
    keep: bool = False,
) -> DataFrame:
    """For each document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, and with ``keep`` the ``kept`` bytes.

    A byte goes where a string of ``length`` bytes that covers it also starts earlier: in a text with a smaller
    doc_id, or earlier in the same text. Strings are judged on the input and do not cross documents.

    Every window of ``length`` bytes has an anchor, a substring chosen by its bytes alone, and equal windows have
    equal anchors at equal distances. Anchors that stand only once in the corpus take their windows out. The rest is cut to
    pieces with one anchor each, whose windows all differ. Where an anchor has the same piece everywhere (two 64-bit hashes), the
    earliest stays and its copies go. Where its pieces differ, they are dealt by it to shards of about ``shard_bytes``; a
    shard's suffix array is made by induced sorting, its permuted common prefixes show which windows are equal, and all
    but the earliest go.

    Hot groups: a slice of the input sends an anchor once and equal pieces once, the earliest of them. Pieces of an
    anchor with over ``hot`` different pieces are dealt window by window, by all their bytes, so that a passage common
    to many different texts meets only its equals. Texts over ``part_bytes`` go in parts that know the next ``length - 1`` bytes.

    Null and empty texts have 0 bytes and the hash of nothing; shorter ones than ``length`` lose nothing. Rows that share a
    doc_id are ordered by their place in the input, null ids come last. An empty table gives no rows; other
    columns are not read.
    """
    parts = written(_parts(docs, length, part_bytes, slice_bytes), "parts")
    repeated = _repeated(_anchors(parts, length, gram), hot)

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        return _deal(left, right, length, gram)

    by_slice = parts.groupBy("slice")
    dealt = written(by_slice.cogroup(repeated.groupBy("slice")).applyInArrow(deal, _DEALT), "dealt")
    pieces = dealt.where("text IS NOT NULL")
    total = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))

    def judge(group: pa.Table) -> pa.Table:
        return _judge(group, length)

    late = pieces.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(judge, _GONE)
    gone = dealt.where("text IS NULL").select("slice", "place", "at", "windows").unionByName(late)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return _finish(left, right, length, keep)

    found = written(by_slice.cogroup(gone.groupBy("slice")).applyInArrow(finish, f"{_RESULT}, {_LONG}"), "found")
    short = found.where("row IS NULL").select(*(f.split()[0] for f in _RESULT.split(", ")))
    out = short.unionByName(_joined(found.where("row IS NOT NULL"), length, keep))
    return out if keep else out.drop("kept")


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_removed(load(spark, sf_dir, "documents"))
