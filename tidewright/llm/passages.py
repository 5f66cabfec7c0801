"""Passages that repeat anywhere in a corpus: windows of words, counted exactly in buckets of their minimisers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import mixed
from .store import written

#: Words a window; words a minimiser looks at. Windows of a text that share their minimiser make one super-k-mer.
WINDOW, SEED = 35, 8
#: Strings of a minimiser at more places than this are counted without a bucket, so that no task sees all of it.
HOT = 512
_MEMO = 1 << 18
_PRIME = 0x9E3779B97F4A7C15


class _Hasher:
    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        return np.fromiter((memo[w] if w in memo else memo.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` values from each place on, in as many steps as the width has binary digits."""
    out, have, power, size = None, 0, h, 1
    while width:
        if width & 1:
            out = power if out is None else out[:len(power) - have] * np.uint64(pow(_PRIME, size, 1 << 64)) + power[have:] if len(power) > have else out[:0]
            have += size
        width >>= 1
        if width:
            power = power[:-size] * np.uint64(pow(_PRIME, size, 1 << 64)) + power[size:] if len(power) > size else power[:0]
            size *= 2
    return mixed(out)


def super_kmers(h: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window, number of windows and times the minimiser stands in it, of each super-k-mer of one text's
    word hashes. The minimiser of a window is the least hash of the runs of ``seed`` words in it, a property of its words
    alone. Equal windows of one super-k-mer hold the minimiser at two places."""
    n = len(h) - window + 1
    if n < 1:
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    runs = rolled(h, seed)
    least, size, span = runs, 1, window - seed + 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[:size - span], least[span - size:])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    times = np.ones(len(first), np.int64)
    if len(np.unique(runs)) < len(runs):
        times = np.array([np.count_nonzero(runs[f:f + c + span - 1] == least[f]) for f, c in zip(first, count, strict=True)], np.int64)
    return least[first], first, count, times


def _arrow(columns: list, names: list[str], types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names)


def _seeds(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, names, types = _Hasher(), ["id", "hash", "minimiser", "times"], [pa.int64()] * 4
        for b in batches:
            ids, hashes, minimisers, times = [], [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, x, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                m, _, _, k = super_kmers(of(split(t)), window, seed)
                ids += [i] * len(m)
                hashes += [x] * len(m)
                minimisers.append(m.view(np.int64))
                times.append(k)
            yield _arrow([ids, hashes, np.concatenate(minimisers), np.concatenate(times)], names, types)

    return run


def _packed(window: int, seed: int):
    """From rows (id, hash, text, minimisers wanted, those of them that are hot): packed strings (bucket, id, hash, start,
    words); those of hot minimisers have no bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, names = _Hasher(), ["bucket", "id", "hash", "start", "words"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i, x, t, wanted, hot in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                words, hot = split(t), set(hot)
                m, first, count, _ = super_kmers(of(words), window, seed)
                keys = m.view(np.int64)
                for k in np.flatnonzero(np.isin(keys, np.array(wanted, np.int64))):
                    key, s, c = int(keys[k]), int(first[k]), int(count[k])
                    packed = b" ".join(words[s:s + c + window - 1])
                    for column, value in zip(out, (None if key in hot else key, i, x, s, packed), strict=True):
                        column.append(value)
                    size += len(packed)
                if size > 1 << 22:
                    yield _arrow(out, names, types)
                    out, size = [[], [], [], [], []], 0
            yield _arrow(out, names, types)

    return run


def _repeats(window: int):
    """Within each bucket of sorted rows: windows sorted by their words, and runs of those that occur more than once as
    (id, hash, start, length). Equal packed strings, as of copied texts, are unpacked once."""

    def runs(group: dict[bytes, list[tuple]]) -> Iterator[tuple]:
        windows, flags = [], []
        for number, (packed, places) in enumerate(group.items()):
            words = packed.split(b" ")
            n = len(words) - window + 1
            windows += [(b" ".join(words[k:k + window]), number, k) for k in range(n)]
            flags.append(np.full(n, len(places) > 1))
        windows.sort()
        for a, b in zip(windows, windows[1:], strict=False):
            if a[0] == b[0]:
                flags[a[1]][a[2]] = flags[b[1]][b[2]] = True
        for places, f in zip(group.values(), flags, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8)))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                for i, x, start in places:
                    yield i, x, start + s, e - s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["id", "hash", "start", "length"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        group: dict[bytes, list[tuple]] = {}
        bucket, out = None, []
        for b in batches:
            for key, i, x, start, packed in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if key != bucket:
                    out += runs(group)
                    group, bucket = {}, key
                    if len(out) > 20_000:
                        yield _arrow(list(zip(*out, strict=True)), names, types)
                        out = []
                group.setdefault(packed, []).append((i, x, start))
        out += runs(group)
        yield _arrow(list(zip(*out, strict=True)) or [[], [], [], []], names, types)

    return run


def _windows(window: int):
    """Each window of packed strings, as a 128-bit digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["id", "hash", "start", "k", "digest"], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for i, x, start, k, packed in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                words = packed.split(b" ")
                n = len(words) - window + 1
                for column, values in zip(out, ([i] * n, [x] * n, range(start, start + n), [k] * n,
                                                [xxhash.xxh3_128_digest(b" ".join(words[j:j + window])) for j in range(n)]), strict=True):
                    column.extend(values)
            yield _arrow(out, names, types)

    return run


def _hot_repeats(strings: DataFrame, window: int) -> DataFrame:
    """Runs of repeated windows in the strings of hot minimisers. Equal strings, as of copied texts, are first counted
    where they are: all windows of a string that occurs twice are repeated, so its places need no unpacking. Each
    different string is unpacked once, and its windows are counted by partial sums."""
    different = written(strings.groupBy("words").agg(F.count("*").alias("k"), F.min("id").alias("id"), F.min("hash").alias("hash"), F.min("start").alias("start")))
    copied = strings.join(different.where("k > 1").select("words"), "words")
    copied = copied.select("id", "hash", "start", (F.size(F.split(F.decode("words", "UTF-8"), " ")) - (window - 1)).alias("length"))
    windows = different.select("id", "hash", "start", "k", "words").mapInArrow(_windows(window), "id long, hash long, start int, k long, digest binary")
    twice = windows.groupBy("digest").agg(F.sum("k").alias("n")).where("n > 1").select("digest")
    single = windows.where("k = 1").join(twice, "digest").select("id", "hash", "start", F.lit(1).alias("length"))
    return copied.unionByName(single)


def drop_repeated_passages(df: DataFrame, id: str, text: str, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Columns id, n_words, n_removed and kept (the kept words, joined by one space) of every row.

    A word goes if a window of ``window`` words that covers it has a word sequence that also starts elsewhere in the
    table, in the same text or another; windows are judged on the texts as given. Consecutive windows of a text with the
    same minimiser travel as one packed string to the bucket of that minimiser, where windows are sorted and counted by
    their words. First only minimisers are counted: one that stands at a single place of the corpus has no repeated
    windows, and its strings stay where they are. Strings of a minimiser at very many places are counted by
    partial sums, equal strings first and then the windows of different ones, so no task meets all of it. Ids are long; they may be
    null and needn't be distinct, as rows are told apart by id and text; repeated rows repeat each other. Null texts
    have no words. An empty table gives no rows.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    key = ["id", "hash"]
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["hash"] == b["hash"])
    seeds = written(rows.mapInArrow(_seeds(window, seed), "id long, hash long, minimiser long, times long"))
    often = seeds.groupBy("minimiser").agg(F.sum("times").alias("k")).where("k > 1").select("minimiser", (F.col("k") > HOT).alias("hot"))
    wanted = (seeds.select(*key, "minimiser").join(often, "minimiser").groupBy(*key)
              .agg(F.collect_set("minimiser").alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("minimiser"))).alias("hot")))
    strings = written(rows.join(wanted, same(rows, wanted)).select(rows["id"], rows["hash"], "text", "wanted", "hot")
                      .mapInArrow(_packed(window, seed), "bucket long, id long, hash long, start int, words binary"))
    cold = (strings.where("bucket is not null").repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(_repeats(window), "id long, hash long, start int, length int"))
    repeats = cold.unionByName(_hot_repeats(strings.where("bucket is null"), window))
    repeats = repeats.groupBy(*key).agg(F.collect_list(F.struct("start", "length")).alias("runs"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, left = [], [], []
            for t, runs in zip(*(b.column(k).to_pylist() for k in (1, 2)), strict=True):
                words = split(t)
                change = np.zeros(len(words) + 1, np.int64)
                if runs:
                    np.add.at(change, [r["start"] for r in runs], 1)
                    np.add.at(change, [r["start"] + r["length"] + window - 1 for r in runs], -1)
                covered = np.cumsum(change)[:len(words)] > 0
                n.append(len(words))
                removed.append(int(covered.sum()))
                left.append(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c) if runs else b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())],
                                             ["id", "n_words", "n_removed", "kept"])

    return (rows.join(repeats, same(rows, repeats), "left").select(rows["id"], "text", "runs")
            .mapInArrow(kept, "id long, n_words long, n_removed long, kept string"))
