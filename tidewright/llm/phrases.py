"""Collocations: phrases whose words keep together more than their counts let expect, per language."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Words of the longest phrase.
LONGEST = 5
#: Words that a shard counts at once, and windows that a range should hold: what a task needs in memory goes with these.
SHARD, SPAN = 1 << 21, 1 << 21
#: Documents that tell where ranges begin (they only say which task adds up what), and paths that come to the driver.
SAMPLE, SAMPLE_TASKS, SAMPLE_PATHS = 4000, 16, 8000
#: Pieces end at these characters, words at spaces and tabs too.
_TOKENS = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+").findall
_ENDS = frozenset(b".,;:!?\x0A\x0B\x0C\x0D")

Path = tuple[bytes, ...]


class Counts:
    """A weighted acyclic automaton over words: every path of up to five words weighs how often it begins at some word.

    Paths are kept sorted, as rows of word numbers (from 1, in the order of ``words``; 0 after the end of a piece), so
    rows with one beginning stand together and are one state. ``states`` walks them level by level: the weight of a
    state is the sum over the paths through it, and that is the count of the phrase that leads there. ``packed`` stores
    each state once, with its label and its number of successors."""

    def __init__(self, words: list[bytes], rows: np.ndarray, weights: np.ndarray):
        self.words, self.rows, self.weights = words, rows, weights

    @classmethod
    def of(cls, words: list[bytes], rows: np.ndarray, weights: np.ndarray) -> Counts:
        """Of words and rows in any order, weights of equal rows added up."""
        order = sorted(range(len(words)), key=words.__getitem__)
        place = np.zeros(len(words) + 1, np.int32)
        place[np.array(order, np.int64) + 1] = np.arange(1, len(words) + 1)
        rows = place[rows]
        bits = len(words).bit_length()
        if bits <= 21:  # three numbers fit one sort key
            wide = rows.astype(np.int64)
            by = np.lexsort([wide[:, 3] << bits | wide[:, 4], (wide[:, 0] << bits | wide[:, 1]) << bits | wide[:, 2]])
            del wide
        else:
            by = np.lexsort([rows[:, i] for i in range(LONGEST - 1, -1, -1)])
        rows, weights = rows[by], weights[by]
        first = np.flatnonzero(_changes(rows, LONGEST))
        return cls([words[i] for i in order], rows[first], np.add.reduceat(weights, first) if len(first) else weights)

    @classmethod
    def union(cls, many: list[Counts]) -> Counts:
        """Paths of all, weights of equal ones added up."""
        number: dict[bytes, int] = {}
        rows = []
        for c in many:
            rows.append(np.array([0] + [number.setdefault(w, len(number) + 1) for w in c.words], np.int32)[c.rows])
        return cls.of(list(number), np.concatenate(rows), np.concatenate([c.weights for c in many]))

    def states(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words: the first path through each state, and the weights of states."""
        for d in range(1, LONGEST + 1):
            first = np.flatnonzero(_changes(self.rows, d))
            weight = np.add.reduceat(self.weights, first) if len(first) else self.weights
            here = self.rows[first, d - 1] > 0
            yield d, first[here], weight[here]

    def path(self, row: int, d: int = LONGEST) -> Path:
        return tuple(self.words[i - 1] for i in self.rows[row, :d].tolist() if i)

    def split(self, limits: list[Path]) -> Iterator[tuple[int, Counts]]:
        """The paths from one limit (included) to the next, with the number of limits up to them."""
        at = [bisect_left(range(len(self.rows)), x, key=self.path) for x in limits]
        for i, (a, b) in enumerate(zip([0, *at], [*at, len(self.rows)], strict=True)):
            if a < b:
                yield i, Counts(self.words, self.rows[a:b], self.weights[a:b])

    def packed(self) -> tuple[int, bytes]:
        """Bytes before compression, and compressed: the words in use, then level by level numbers of successors and labels
        of states, the weights of whole paths last."""
        used = np.unique(self.rows)
        used = used[used > 0]
        to = np.zeros(len(self.words) + 1, np.int32)
        to[used] = np.arange(1, len(used) + 1)
        rows = to[self.rows]
        names = b" ".join([self.words[i - 1] for i in used.tolist()])
        parts, before = [np.array([len(names), len(used)], "<i8").tobytes(), names], None
        for d in range(1, LONGEST + 1):
            first = np.flatnonzero(_changes(rows, d))
            if before is not None:
                parts += _bytes(np.diff(np.append(np.searchsorted(first, before), len(first))))
            parts += _bytes(rows[first, d - 1])
            before = first
        whole = b"".join([*parts, *_bytes(self.weights)])
        return len(whole), pa.compress(whole, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, size: int, data: bytes) -> Counts:
        whole = memoryview(pa.decompress(data, size, codec="zstd", asbytes=True))
        n, k = np.frombuffer(whole[:16], "<i8").tolist()
        words, at, rows = bytes(whole[16:16 + n]).split(b" ") if k else [], 16 + n, None
        for d in range(LONGEST):
            if rows is not None:
                successors, at = _numbers(whole, at)
                rows = np.repeat(rows, successors, axis=0)
            labels, at = _numbers(whole, at)
            if rows is None:
                rows = np.zeros((len(labels), LONGEST), np.int32)
            rows[:, d] = labels
        return cls(words, rows, _numbers(whole, at)[0])


def _changes(rows: np.ndarray, d: int) -> np.ndarray:
    """Where the first ``d`` columns differ from those of the row before."""
    out = np.ones(len(rows), bool)
    out[1:] = (rows[1:, :d] != rows[:-1, :d]).any(axis=1)
    return out


def _bytes(x: np.ndarray) -> list[bytes]:
    """Numbers in as many bytes as the largest needs, lowest bytes of all first: they compress better so."""
    width = max(1, int(x.max(initial=0)).bit_length() + 7 >> 3)
    return [np.array([width, len(x)], "<i8").tobytes(), x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]


def _numbers(data: memoryview, at: int) -> tuple[np.ndarray, int]:
    width, n = np.frombuffer(data[at:at + 16], "<i8").tolist()
    out, end = np.zeros((n, 8), np.uint8), at + 16 + width * n
    out[:, :width] = np.frombuffer(data[at + 16:end], np.uint8).reshape(width, n).T
    return out.view("<i8").reshape(-1), end


class Shard:
    """Counts texts as they come; holds their words as numbers until it is asked for the counts."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        number = self.number
        # zero after each piece, and after the text
        out = [0 if t[0] in _ENDS else number.setdefault(t, len(number) + 1) for t in _TOKENS(text.encode("utf-8", "replace").lower())]
        self.held.append(np.array([*out, 0], np.int32))
        self.size += len(out)

    def counts(self) -> Counts:
        numbers = np.concatenate([*self.held, np.zeros(LONGEST, np.int32)])
        n = len(numbers) - LONGEST + 1
        rows = np.stack([numbers[i:i + n] for i in range(LONGEST)], axis=1)
        for i in range(1, LONGEST):
            rows[rows[:, i - 1] == 0, i] = 0
        rows = rows[rows[:, 0] > 0]
        return Counts.of(list(self.number), rows, np.ones(len(rows), np.int64))


def _counted(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[tuple[str, Counts]]:
    """Counts of the texts (lang, text) of a task, a shard at a time: the largest language goes when all are full together."""
    held: dict[str, Shard] = defaultdict(Shard)
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if text:
                held[lang].add(text)
            if sum(s.size for s in held.values()) >= shard:
                lang = max(held, key=lambda x: held[x].size)
                yield lang, held.pop(lang).counts()
    for lang, s in held.items():
        yield lang, s.counts()


def _limits(texts: DataFrame, span: int) -> dict[str, list[Path]]:
    """Paths at which ranges of about ``span`` windows begin, by language, from a sample of the documents. More of them come
    to the driver only as there are more windows, one for each range."""
    part = min(1.0, SAMPLE / max(1, texts.count()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(_counted(batches, 1 << 62))
        for lang, c in found:
            at = np.unique(np.linspace(0, len(c.rows) - 1, min(len(c.rows), max(1, SAMPLE_PATHS // len(found)))).astype(int)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([b" ".join(c.path(i)) for i in at], pa.binary()),
                                              pa.array([len(c.rows) / max(1, len(at))] * len(at), pa.float64())], ["lang", "path", "n"])

    rows = texts.sample(part, 5).repartition(SAMPLE_TASKS).mapInArrow(spread, "lang string, path binary, n double").collect()
    out: dict[str, list[Path]] = {}
    by_lang: dict[str, dict[Path, float]] = defaultdict(lambda: defaultdict(float))
    for lang, path, n in rows:
        by_lang[lang][tuple(bytes(path).split(b" "))] += n / part
    for lang, paths in by_lang.items():
        ordered = sorted(paths)
        upto = list(accumulate(paths[x] for x in ordered))
        ranges = int(upto[-1] // span) + 1
        out[lang] = sorted({ordered[bisect_left(upto, upto[-1] * i / ranges)] for i in range(1, ranges)})
    return out


def phrase_counts(df: DataFrame, lang: str, text: str, least: int = 100, shard: int = SHARD, span: int = SPAN) -> DataFrame:
    """Columns lang, d, phrase, n: phrases of 1 to 5 words that occur at least ``least`` times within pieces of a language, and
    for d = 0 and an empty phrase the number of all its words. Null languages are ``und``; null texts have no words.

    Every task counts its texts into automata, a shard at a time, and cuts them at the same limits. The parts of one
    range meet in one task, which unites them: a phrase is a beginning of sorted paths, so its paths lie in one range,
    but for those at the edges, which each range hands on whatever their weight; all are added up last."""
    texts = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    limits = _limits(texts, span)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, counts in _counted(batches, shard):
            for i, c in counts.split(limits.get(name, [])):
                size, data = c.packed()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())],
                                                 ["lang", "range", "size", "counts"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counts] = []
        key = None

        def phrases() -> pa.RecordBatch:
            c = Counts.union(held)
            found = [(0, "", int(c.weights.sum()))]
            for d, first, weight in c.states():
                edge = np.zeros(len(first), bool)
                edge[[0, -1] if len(first) else []] = True
                for i in np.flatnonzero((weight >= least) | edge).tolist():
                    found.append((d, b" ".join(c.path(first[i], d)).decode(), int(weight[i])))
            d, phrase, n = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(d)), pa.array(d, pa.int32()), pa.array(phrase), pa.array(n, pa.int64())], ["lang", "d", "phrase", "n"])

        for b in batches:
            for name, i, size, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (name, i):
                    if held:
                        yield phrases()
                    held, key = [], (name, i)
                held.append(Counts.unpacked(size, data))
        if held:
            yield phrases()

    ranges = sum(len(x) + 1 for x in limits.values())
    parts = texts.mapInArrow(count, "lang string, range int, size long, counts binary").repartition(max(1, ranges), "lang", "range")
    found = parts.sortWithinPartitions("lang", "range").mapInArrow(unite, "lang string, d int, phrase string, n long")
    return found.groupBy("lang", "d", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("d") == 0))


def _words(phrase: str, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


def collocations(df: DataFrame, lang: str, text: str, least: int = 100, top: int | None = 2000, percent: int = 100) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n, score: phrases of two to five words, best first in each language.

    a counts the phrase, l and r the parts that its worst cut leaves, n all words of the language; score is
    floor(1000 a n / (l r)), exact up to 10**16 words. The worst cut is that of the smallest score, then the first. A
    phrase within a longer one that occurs at least ``percent`` in 100 as often goes; then ``top`` (or all) are ranked
    by score, count and phrase (UTF-8 bytes). A part of a phrase is at least as frequent as the phrase, so all counts
    that cuts ask for are at hand: the joins below compose them. An empty table gives no rows; other columns aren't read."""
    counts = written(phrase_counts(df, lang, text, least))
    many = counts.where("d >= 2").select("lang", "d", "phrase", F.col("n").alias("a"))
    cut = many.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("d") - 1)))
    cut = cut.withColumn("left", _words("phrase", F.lit(1), F.col("k"))).withColumn("right", _words("phrase", F.col("k") + 1, F.col("d") - F.col("k")))
    part = lambda name, as_: counts.where("d > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(as_))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cut = cut.join(counts.where("d = 0").select("lang", F.col("n")), "lang")
    big = lambda x: F.col(x).cast("decimal(16,0)")
    exact = cut.withColumn("over", F.lit(1000).cast("decimal(4,0)") * (big("a") * big("n"))).withColumn("under", big("l") * big("r"))
    worst = exact.withColumn("score", F.expr("over div under")).groupBy("lang", "phrase", "d", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    inner = many.where("d > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("d") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("d") - F.col("m") + 1)))
    inner = inner.groupBy("lang", _words("phrase", F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where(~F.coalesce(F.col("longer") * 100 >= F.col("a") * percent, F.lit(False)))
    best = Window.partitionBy("lang").orderBy(F.desc("worst.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)) if top is None else kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
