"""Toxicity: class-conditional Kneser-Ney models over the letters of words, with shared backoff."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property, reduce
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .calibrate import Logistic, Share, fitted_over, labelled_sample, remainder
from .common import load, map_slices, plain, texts, written

ORDER = 5
DISCOUNT = 0.75
WORD_DISCOUNT = 2.5
#: Words whose counts or values are broadcast at once, 16 bytes each (24 in training); more go in rounds
MOST_WORDS = 4_000_000
#: N-grams whose probabilities are broadcast at once, 36 bytes each (52 in training); more are joined
MOST_GRAMS = 1_000_000
LETTERS = 1 / 256
WINDOWS = (1, 4, 16)
CACHE_WORDS, CACHE_GRAMS = 500_000, 1_000_000
TASK_WORDS = 300_000
SEED = 2
FOLDS, HELD_OUT = 5, 0

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@cache
def _is_letter() -> np.ndarray:
    """For each code point whether words consist of it."""
    out = np.zeros(0x110000, bool)
    for run in _WORD.finditer("".join(map(chr, range(len(out))))):
        out[run.start() : run.end()] = True
    return out


def split(some: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`words_of` finds in the texts, many at a time: the different words; which of them the words are, text after text; and where each text's words
    begin and the last ones end."""
    lower = [t.lower() for t in some]
    letters = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le"), np.uint32)
    inside = _is_letter()[letters]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # a word begins, ends, the next begins
    begins, sizes = edges[::2], edges[1::2] - edges[::2]
    texts_begin = np.cumsum([1, *(len(t) + 1 for t in lower)])
    letters = letters[inside]
    spelled = letters.tobytes().decode("utf-32-le").encode()
    if len(spelled) > len(letters):
        longer = (letters >= 0x80).view(np.uint8) + (letters >= 0x800) + (letters >= 0x10000)
        sizes = sizes + np.add.reduceat(longer, np.cumsum(sizes) - sizes, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    words = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(spelled)).dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False), words.indices.to_numpy(), np.searchsorted(begins, texts_begin)


def grams(word: str, order: int = ORDER) -> list[str]:
    """The word's letter n-grams, with its begin and end marked."""
    padded = "^" * (order - 1) + word + "$"
    return [padded[i : i + order] for i in range(len(word) + 1)]


class Counts:
    """What training counts of one class: letter n-grams, in how many texts each word occurs (two at least), and the words of one text only."""

    def __init__(self, grams: dict[str, int] | None = None, words: dict[str, int] | None = None, single: int = 0):
        self.grams, self.words, self.single = grams or {}, words or {}, single

    def __add__(self, other: Counts) -> Counts:
        return Counts(dict(Counter(self.grams) + Counter(other.grams)), dict(Counter(self.words) + Counter(other.words)), self.single + other.single)


class KneserNey(dict):
    """Word -> toxic minus ordinary log-likelihood.

    Words are counted for each class, by the texts they occur in. What their discount frees goes to spelling, letter by letter:
    its highest order is counted for each class too, and what that frees goes to lower orders, which both classes share:
    continuation counts (in how many longer n-grams one occurs) over the n-grams of either class. So a rare expression,
    which neither class has counts for, is about as likely in both.
    """

    def __init__(self, counts: dict[int, Counts]):
        self.counts = counts
        self.total = {c: Counter() for c in counts}
        self.kinds = {c: Counter() for c in counts}
        for c, table in counts.items():
            for gram, n in table.grams.items():
                self.total[c][gram[:-1]] += n
                self.kinds[c][gram[:-1]] += 1
        self.mass = {c: sum(t.words.values()) + t.single + 1 for c, t in counts.items()}
        # a word gives up its discount, or all it has if that is less, so that all words together have probability 1
        self.free = {c: (sum(min(n, WORD_DISCOUNT) for n in t.words.values()) + t.single + 1) / self.mass[c] for c, t in counts.items()}
        self.shared: Counter = Counter()
        self.shared_total: Counter = Counter()
        self.shared_kinds: Counter = Counter()
        longer = set().union(*(t.grams for t in counts.values()))
        while longer and len(next(iter(longer))) > 1:
            level = Counter(g[1:] for g in longer)
            for gram, n in level.items():
                self.shared_total[gram[:-1]] += n
                self.shared_kinds[gram[:-1]] += 1
            self.shared.update(level)
            longer = set(level)
        self.lower: dict[str, float] = {}
        self.spelled: dict[str, tuple[float, float]] = {}

    def __reduce__(self):
        return KneserNey, (self.counts,)

    def _lower(self, gram: str) -> float:
        if not gram:
            return LETTERS
        p = self.lower.get(gram)
        if p is None:
            p, total = self._lower(gram[1:]), self.shared_total.get(gram[:-1], 0)
            if total:
                p = (max(self.shared.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * self.shared_kinds[gram[:-1]] * p) / total
            self.lower[gram] = p
        return p

    def _spelled(self, gram: str) -> tuple[float, float]:
        both = self.spelled.get(gram)
        if both is None:
            back, found = self._lower(gram[1:]), []
            for c in (0, 1):
                total = self.total[c].get(gram[:-1], 0)
                found.append(log((max(self.counts[c].grams.get(gram, 0) - DISCOUNT, 0) + DISCOUNT * self.kinds[c][gram[:-1]] * back) / total if total else back))
            both = self.spelled[gram] = (found[0], found[1])
        return both

    def __missing__(self, word: str) -> float:
        sides = []
        for c, letters in enumerate(zip(*map(self._spelled, grams(word)))):
            rest, seen = log(self.free[c]) + sum(letters), (self.counts[c].words.get(word, 0) - WORD_DISCOUNT) / self.mass[c]
            sides.append(rest + log1p(seen * exp(-rest)) if seen > 0 and rest > -600 else log(seen) if seen > 0 else rest)
        value = sides[1] - sides[0]
        if len(word) <= 64:
            self[word] = value
        if len(self.lower) + len(self.spelled) > CACHE_GRAMS:
            self.lower.clear()
            self.spelled.clear()
        return value

    def features(self, text: str) -> list[float]:
        """Length-normalised differences: of the whole text, of its three strongest words, of its strongest runs of 1, 4 and 16 words; and the length."""
        if len(self) > CACHE_WORDS:
            self.clear()
        return features(words_of(text), self.__getitem__)


def features(words: list[str], value: Callable[[str], float]) -> list[float]:
    """What :meth:`KneserNey.features` says, from the values of the words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return _features(np.array([number[w] for w in words], np.int64), np.fromiter(map(value, words), float, len(words)))


def _features(words: np.ndarray, values: np.ndarray) -> list[float]:
    """:func:`features` of a text, from numbers that stand for its words, and the words' values."""
    if not len(words):
        return [0.0] * (len(WINDOWS) + 3)
    so_far = np.zeros(len(words) + 1)
    np.cumsum(values, out=so_far[1:])
    strongest, others = [], values
    while len(strongest) < 3 and others[i := others.argmax()] > -np.inf:
        strongest.append(float(values[i]))
        others = np.where(words == words[i], -np.inf, others)
    best = [sum(strongest) / 3]
    for size in WINDOWS:
        n = min(size, len(words))
        best.append(float((so_far[n:] - so_far[:-n]).max()) / size)
    return [so_far[-1] / len(words), *best, log(1 + len(words))]


def _keys(words: list[str]) -> np.ndarray:
    """64 bits of a hash of each word; they stand for the words in tables."""
    return _sums_of(*_windows(words)[:2])


def _sums_of(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """:func:`_keys` from the hashes of the words' n-grams."""
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff(starts, append=len(hashes)))
    return np.add.reduceat(_mixed(hashes + place.astype(np.uint64)), starts).view(np.int64) if len(starts) else np.array([], np.int64)


def _key(word: str) -> int:
    return int(_keys([word])[0])


@dataclass
class Tables:
    """What training counts, as Spark tables: ``words`` (key, in how many texts of fold f and class c: ``t<f><c>``) and ``grams`` (gram, occurrences ``n<f><c>``);
    and by model (0, 1: that fold alone, 2: both) and class the mass of all words and the share that their discounts free."""

    words: DataFrame
    grams: DataFrame
    mass: dict[tuple[int, int], float]
    free: dict[tuple[int, int], float]


class ToxicityModel:
    def __init__(self, tables: Tables | None, calibration: Logistic | Share):
        self.tables, self.calibration = tables, calibration


_CELLS = [(f, c) for f in (0, 1) for c in (0, 1)]


def _of_model(name: str, m: int, c: int) -> Column:
    """The count of class c in model m."""
    return F.col(f"{name}{m}{c}") if m < 2 else F.col(f"{name}0{c}") + F.col(f"{name}1{c}")


def _grams_of(words: DataFrame) -> DataFrame:
    """``key, gram, k``: the letter n-grams of each word and how often it has them."""

    def run(rows):
        out = [(key, gram, k) for key, word in zip(rows.column("key").to_pylist(), rows.column("word").to_pylist()) for gram, k in Counter(grams(word)).items()]
        kinds = {"key": pa.int64(), "gram": pa.string(), "k": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=[*kinds])

    return written(map_slices(words.select("key", "word", F.col("word").alias("text")), run, "key long, gram string, k long"), "spelling")


def _windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], list[str]]]:
    """The n-grams (:func:`grams`) of the words, word after word: 64 bits of a hash of each; the first of each word; and a function that gives some as strings."""
    marked = "".join([f"{'^' * (ORDER - 1)}{w}$" for w in words])
    letters = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(np.arange(len(words)) * (ORDER - 1), sizes)
    rows = np.lib.stride_tricks.sliding_window_view(letters, ORDER)
    return _hashes([letters[at + i] for i in range(ORDER)]), starts, lambda some: rows[at[some]].view(f"<U{ORDER}").ravel().tolist()


def _hashes(letters: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(letters[0]), np.uint64)
    for at in range(0, len(letters), 3):  # three letters of 21 bits
        for i, column in enumerate(letters[at : at + 3]):
            h ^= column.astype(np.uint64) << np.uint64(21 * i)
        h = _mixed(h)
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _different(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different hash, and which of them each hash is."""
    coded = pa.array(hashes).dictionary_encode()
    which = coded.indices.to_numpy()
    places = np.zeros(len(coded.dictionary), np.int64)
    places[which] = np.arange(len(which))
    return places, which


def _hashes_of(found: list[str]) -> np.ndarray:
    return _hashes(list(np.array(found, f"<U{ORDER}").view(np.uint32).reshape(len(found), ORDER).T)) if found else np.array([], np.uint64)


def _counted_grams(words: DataFrame) -> DataFrame:
    """``gram, n<f><c>``: the letter n-grams of the words and how often they occur; summed where the words are read, before any shuffle."""
    cells = [f"n{f}{c}" for f, c in _CELLS]

    def run(rows):
        hashes, starts, strings = _windows(rows.column("word").to_pylist())
        each, at = _different(hashes)
        sums = []
        for cell in cells:
            n = np.zeros(len(each), np.int64)
            np.add.at(n, at, np.repeat(rows.column(cell).to_numpy(), np.diff(starts, append=len(hashes))))
            sums.append(pa.array(n))
        return pa.RecordBatch.from_arrays([pa.array(strings(each), pa.string()), *sums], names=["gram", *cells])

    parts = map_slices(words.select("word", *cells, F.col("word").alias("text")), run, "gram string, " + ", ".join(f"{c} long" for c in cells))
    return written(parts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in cells]), "grams")


def _count(sample: DataFrame) -> Tables:
    """Count whole texts. Words are counted first, n-grams once for each different word."""

    def run(rows):
        words, which, begins = split(texts(rows))
        if not len(words):
            return None
        cells = rows.column("fold").to_numpy().astype(np.int64) * 2 + rows.column("label").to_numpy()  # as in _CELLS
        text = np.repeat(np.arange(len(cells)), np.diff(begins))
        once = np.sort(text * len(words) + which)
        once = once[np.flatnonzero(np.diff(once, prepend=-1))]
        times, texts_with = (np.bincount(w * 4 + cells[t], minlength=4 * len(words)) for t, w in ((text, which), (once // len(words), once % len(words))))
        found = np.flatnonzero(times)
        fold, label = (pa.array(x, pa.int32()) for x in (found % 4 // 2, found % 2))
        columns = [pa.array(words[found // 4], pa.string()), fold, label, pa.array(texts_with[found]), pa.array(times[found])]
        return pa.RecordBatch.from_arrays(columns, names=["word", "fold", "label", "t", "n"])

    parts = map_slices(plain(sample, "fold", "label", "text"), run, "word string, fold int, label int, t long, n long")
    sums = [
        F.coalesce(F.sum(F.when((F.col("fold") == f) & (F.col("label") == c), F.col(x))), F.lit(0)).alias(f"{x}{f}{c}") for x in "tn" for f, c in _CELLS
    ]
    words = parts.groupBy("word").agg(*sums)

    def keyed(rows):
        return pa.RecordBatch.from_arrays([pa.array(_keys(rows.column("word").to_pylist())), *rows.columns[:-1]], names=["key", *rows.schema.names[:-1]])

    cells = ", ".join(f"{x}{f}{c} long" for x in "tn" for f, c in _CELLS)
    words = written(map_slices(words.select("*", F.col("word").alias("text")), keyed, f"key long, word string, {cells}"), "words")
    found = _counted_grams(words)
    kinds = [(m, c) for m in (0, 1, 2) for c in (0, 1)]
    mass = [F.coalesce(F.sum(_of_model("t", m, c)), F.lit(0)).alias(f"mass{m}{c}") for m, c in kinds]
    given = [F.coalesce(F.sum(F.least(_of_model("t", m, c).cast("double"), F.lit(WORD_DISCOUNT))), F.lit(0.0)).alias(f"free{m}{c}") for m, c in kinds]
    row = words.agg(*mass, *given).first()
    total = {(m, c): row[f"mass{m}{c}"] + 1.0 for m, c in kinds}
    return Tables(words, found, total, {(m, c): (row[f"free{m}{c}"] + 1) / total[m, c] for m, c in kinds})


def _spelled(wanted: DataFrame, counted: DataFrame) -> DataFrame:
    """``m, gram, s0, s1``: for each n-gram of ``wanted`` and ``counted`` the logarithm of its last letter's probability in both classes, as
    :class:`KneserNey` has it, from the shortest context to the longest. ``wanted``: ``m, gram``; ``counted``: ``m, gram, n0, n1``."""
    none = F.lit(0).cast("long")
    both = counted.select("m", "gram", "n0", "n1").unionByName(wanted.select("m", "gram", none.alias("n0"), none.alias("n1")))
    levels = [written(both.groupBy("m", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "level")]
    shorter = F.expr("substring(gram, 2)")
    while len(levels) < ORDER:
        seen = F.count_if(F.col("n0") + F.col("n1") > 0) if len(levels) == 1 else F.count_if(F.col("n") > 0)
        levels.append(written(levels[-1].groupBy("m", shorter.alias("gram")).agg(seen.alias("n")), "level"))
    context = Window.partitionBy("m", F.expr("substring(gram, 1, length(gram) - 1)"))

    def share(n: str) -> Column:
        total, kinds = F.sum(n).over(context), F.count_if(F.col(n) > 0).over(context)
        p = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * F.col("p")) / F.nullif(total, F.lit(0))
        return F.coalesce(p, F.col("p"))

    back = None
    for level in reversed(levels[1:]):
        rows = level.withColumn("p", F.lit(LETTERS)) if back is None else level.withColumn("short", shorter).join(back, ["m", "short"])
        back = written(rows.select("m", F.col("gram").alias("short"), share("n").alias("p")), "shorter")
    rows = levels[0].withColumn("short", shorter).join(back, ["m", "short"])
    return rows.select("m", "gram", *[F.log(share(f"n{c}")).alias(f"s{c}") for c in (0, 1)])


def _letters(found: DataFrame, tables: Tables, models: tuple[int, ...]) -> DataFrame:
    """``m, gram, s0, s1`` (:func:`_spelled`) of the n-grams of ``found`` (gram), and of those that are counted, in the models."""
    each = F.inline(F.array(*[F.struct(F.lit(m).alias("m"), _of_model("n", m, 0).alias("n0"), _of_model("n", m, 1).alias("n1")) for m in models]))
    counted = tables.grams.select("gram", each).where("n0 + n1 > 0")
    return _spelled(found.select("gram", F.explode(F.array(*map(F.lit, models))).alias("m")), counted)


def word_values(words: DataFrame, tables: Tables, models: tuple[int, ...]) -> DataFrame:
    """``key, v<m>…``: of each word (key, word) toxic minus ordinary log-likelihood in the models, as :class:`KneserNey` has it, by joins."""
    spelling = _grams_of(words)
    letters = spelling.join(_letters(written(spelling.select("gram").distinct(), "wanted"), tables, models), "gram")
    sums = [F.sum(F.when(F.col("m") == m, F.col("k") * F.col(f"s{c}"))).alias(f"l{m}{c}") for m in models for c in (0, 1)]
    rows = letters.groupBy("key").agg(*sums).join(tables.words.drop("word"), "key", "left")

    def side(m: int, c: int) -> Column:
        rest = F.lit(log(tables.free[m, c])) + F.col(f"l{m}{c}")
        seen = (F.coalesce(_of_model("t", m, c), F.lit(0)) - WORD_DISCOUNT) / F.lit(tables.mass[m, c])
        return F.when((seen > 0) & (rest > -600), rest + F.log1p(seen * F.exp(-rest))).when(seen > 0, F.log(seen)).otherwise(rest)

    return rows.select("key", *[(side(m, 1) - side(m, 0)).alias(f"v{m}") for m in models])


@dataclass
class _Model:
    """What the values of words come from, in memory: ``grams``, sorted hashes, with ``letters``: the logarithms of their last letters' probabilities, and ``keys``,
    sorted, of the words that occur in more texts than the discount takes, with the numbers of ``texts``; both by model and class."""

    grams: np.ndarray
    letters: dict[tuple[int, int], np.ndarray]
    keys: np.ndarray
    texts: dict[tuple[int, int], np.ndarray]
    mass: dict[tuple[int, int], float]
    free: dict[tuple[int, int], float]
    models: tuple[int, ...]

    def __post_init__(self):
        self.known: list[dict[str, float]] = [{} for _ in self.models]

    @cached_property
    def first(self) -> tuple[np.uint64, np.ndarray]:
        """Where in ``grams`` to look for a hash: from the place that its first bits have, all but those shifted out."""
        bits = len(self.grams).bit_length()
        shift = np.uint64(64 - bits)
        return shift, np.searchsorted(self.grams, np.arange(1 << bits, dtype=np.uint64) << shift)

    def values(self, words: list[str]) -> list[np.ndarray]:
        """For each model the different words' toxic minus ordinary log-likelihoods, as :class:`KneserNey` has them."""
        if len(self.known[0]) > TASK_WORDS - len(words):
            for table in self.known:
                table.clear()
        new = [w for w in words if w not in self.known[0]]
        for table, found in zip(self.known, self._worked_out(new) if new else ()):
            table.update(zip(new, found.tolist()))
        return [np.fromiter(map(table.__getitem__, words), float, len(words)) for table in self.known]

    def _worked_out(self, words: list[str]) -> list[np.ndarray]:
        hashes, starts, _ = _windows(words)
        shift, first = self.first
        place = first[hashes >> shift]
        while len(off := np.flatnonzero(self.grams[place] != hashes)):
            place[off] += 1
        keys = _sums_of(hashes, starts)
        row = np.searchsorted(self.keys, keys)
        row[row == len(self.keys)] = 0
        often = np.flatnonzero(self.keys[row] == keys) if len(self.keys) else np.array([], np.int64)

        def side(m: int, c: int) -> np.ndarray:
            out = log(self.free[m, c]) + np.add.reduceat(self.letters[m, c][place], starts)
            seen = (self.texts[m, c][row[often]] - WORD_DISCOUNT) / self.mass[m, c]
            which, seen = often[seen > 0], seen[seen > 0]
            rest = out[which]
            out[which] = np.where(rest > -600, rest + np.log1p(seen * np.exp(-np.maximum(rest, -600))), np.log(seen))
            return out

        return [side(m, 1) - side(m, 0) for m in self.models]


def _different_grams(rows: DataFrame) -> DataFrame:
    """``gram``: the n-grams of the rows' words; a task skips words that it has met."""
    met: set[str] = set()

    def run(part):
        new = [w for w in split(texts(part))[0].tolist() if w not in met]
        if len(met) > TASK_WORDS:
            met.clear()
        met.update(w for w in new if len(w) <= 64)
        if new:
            hashes, _, strings = _windows(new)
            return pa.RecordBatch.from_arrays([pa.array(strings(_different(hashes)[0]), pa.string())], names=["gram"])

    return written(map_slices(plain(rows, "text"), run, "gram string").distinct(), "wanted")


def _in_memory(rows: DataFrame, tables: Tables, models: tuple[int, ...], most: int, counted: bool) -> _Model | None:
    """What the words of the rows need; None where that are more than ``MOST_GRAMS`` n-grams or more than ``most`` words of many texts.
    ``counted``: the tables come from the same rows, so they have all n-grams."""
    pairs = [(m, c) for m in models for c in (0, 1)]
    often = tables.words.where(F.greatest(*[_of_model("t", m, c) for m, c in pairs]) > WORD_DISCOUNT)
    if often.count() > most or tables.grams.count() > MOST_GRAMS:
        return None
    spelled = _letters(tables.grams if counted else _different_grams(rows), tables, models)
    each = [F.max(F.when(F.col("m") == m, F.col(f"s{c}"))).alias(f"l{m}{c}") for m, c in pairs]
    spelled = written(spelled.groupBy("gram").agg(*each), "letters")
    if spelled.count() > MOST_GRAMS:
        return None
    spelled = spelled.toArrow()  # at most ``MOST_GRAMS``
    hashes = _hashes_of(spelled.column("gram").to_pylist())
    order = np.argsort(hashes)
    letters = {(m, c): spelled.column(f"l{m}{c}").to_numpy()[order] for m, c in pairs}
    counts = often.select("key", *[_of_model("t", m, c).cast("int").alias(f"t{m}{c}") for m, c in pairs]).orderBy("key").toArrow()  # at most ``most``
    numbers = {(m, c): counts.column(f"t{m}{c}").to_numpy() for m, c in pairs}
    return _Model(hashes[order], letters, counts.column("key").to_numpy(), numbers, tables.mass, tables.free, models)


def _vocabulary(rows: DataFrame) -> DataFrame:
    """``key, word``: the different words of the rows."""

    def run(part):
        words = split(texts(part))[0]
        return pa.RecordBatch.from_arrays([pa.array(_keys(words.tolist())), pa.array(words, pa.string())], names=["key", "word"])

    return written(map_slices(plain(rows, "text"), run, "key long, word string").distinct(), "vocabulary")


def _featured(rows: DataFrame, tables: Tables, models: tuple[int, ...], keep: dict[str, str], most: int, depth: int = 0, before: int = 0) -> DataFrame:
    """The columns ``keep`` (with their types) of ``rows`` and ``x``, the features of each whole text.

    The probabilities of all n-grams of the rows and the words of many texts are broadcast, and each task works out its words.
    Where either are too many (``MOST_GRAMS``, ``most``), the values of all words come from joins and are broadcast, sorted by
    key; where these are more than ``most``, the rows are split by a hash and done in rounds, each with its own words, down to
    groups that one text's words fill. A row with ``fold`` is looked at by the model of the other fold.
    """
    model = _in_memory(rows, tables, models, most, "fold" in keep) if depth == 0 else None
    if model is None:
        words = _vocabulary(rows)
        n = words.count()
        if n > most and n != before and depth < 16:
            ways = min(64, -(-2 * n // most))
            place = F.pmod(F.xxhash64(F.lit(depth), "doc_id", "text"), F.lit(ways))
            return reduce(DataFrame.unionByName, [_featured(rows.where(place == i), tables, models, keep, most, depth + 1, n) for i in range(ways)])
        table = written(word_values(words, tables, models), "values").orderBy("key").toArrow()  # at most ``most`` words, or those of one text
        model = table.column("key").to_numpy(), [table.column(f"v{m}").to_numpy() for m in models]
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(part):
        words, which, begins = split(texts(part))
        words = words.tolist()
        if isinstance(held.value, _Model):
            by_model = held.value.values(words)
        else:
            keys, values = held.value
            at = np.searchsorted(keys, _keys(words))
            by_model = [v[at] for v in values]
        models = [1 - f for f in part.column("fold").to_pylist()] if "fold" in keep else [0] * part.num_rows
        own = [which[a:b] for a, b in zip(begins[:-1], begins[1:])]
        x = [_features(some, by_model[m][some]) for some, m in zip(own, models)]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return map_slices(plain(rows, *keep, "text"), run, ", ".join(f"{c} {t}" for c, t in keep.items()) + ", x array<double>")


def train_toxicity(
    docs: DataFrame, labels: DataFrame, rows: int | None = None, most_grams: int | None = None, seed: int = SEED, most_words: int = MOST_WORDS
) -> ToxicityModel:
    """Learn from all labelled documents (``labels``: doc_id, toxic), whole texts, copies once.

    Each half of them is scored by the model of the other half, which calibrates the differences; the final model
    has the counts of both. Counts stay Spark tables. A caller may bound the documents of a class (``rows``); more
    different n-grams and words than ``most_grams``, where given, are an error.
    """
    sample, sizes = labelled_sample(docs, labels, "toxic", rows, seed)
    tables = _count(sample)
    if most_grams is not None and tables.words.count() + tables.grams.count() > most_grams:
        raise ValueError(f"the sample has more than {most_grams} n-grams: take fewer rows or allow more n-grams")
    if min(tables.mass[2, c] for c in (0, 1)) <= 1:
        return ToxicityModel(None, Share(sizes))
    found = _featured(sample, tables, (0, 1), {"label": "int", "fold": "int"}, most_words)
    return ToxicityModel(tables, fitted_over(written(found, "features"), sizes))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, most_words: int = MOST_WORDS) -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: toxic likelier) of each whole text.

    Null, empty and wordless texts get the score of an empty text; texts of any length are read whole; repeated rows are scored each; an empty table gives no
    rows; no other column is read.
    """
    calibration = model.calibration
    docs = plain(docs, "doc_id", "text")
    if model.tables is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(calibration(np.zeros((1, 1)))[0])).alias("score"))
    found = _featured(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model.tables, (2,), {"doc_id": "long"}, most_words)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("x").flatten(), float).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(calibration(x))], names=["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = train_toxicity(docs, labels.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT))
    held_out = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return toxicity_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
