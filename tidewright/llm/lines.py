"""Lines that repeat, word for word or nearly, across and within texts."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, contract
from .neardup import connect, mixed
from .store import WORD, written

#: Characters a shingle; bands of MinHash values. A pair of similarity 0.8 shares no band with probability 0.00003;
#: bands of three values would tie together lines that share a common phrase only.
WIDTH, BANDS, ROWS = 8, 20, 4
#: Bytes that name a line among the candidates. Names and bands that agree by chance only bring lines together that are
#: then compared exactly.
NAMED = 5
_FACTORS = np.random.default_rng(7).integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _steps(factors: np.ndarray) -> list[np.uint32]:
    """What leads from the values under one factor to those under the next."""
    return [np.uint32(int(f) * pow(int(g), -1, 1 << 32) % (1 << 32)) for g, f in zip([1, *factors], factors, strict=False)]


_STEPS = _steps(_FACTORS)
#: Bands of more values that take large groups apart, as many values at once as above. A pair of similarity 0.8 shares none with
#: probability 0.0000004, one of 0.3 does with 0.005; the bands above tie the latter with 0.15.
FINE_ROWS = 8
_FINE = [_steps(x) for x in np.random.default_rng(8).integers(1, 1 << 31, (8, BANDS * ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)]
_PRIME, _SMALL = 0x9E3779B97F4A7C15, 0x9E3779B1
#: Characters hashed at once, shingles of a column and columns of a block whose minima are taken together.
CHUNK, COLUMN, BLOCK = 1 << 20, 32, 2048
#: Lines whose bands are sorted and sent at once, lines a task remembers to have sketched, and lines a part of a band.
SENT, MET, PART = 1 << 16, 200_000, 1 << 17
_ENTRY = np.dtype([("band", "<u4"), ("line", "u1", NAMED)])
_TIE = np.dtype([("a", "u1", NAMED), ("b", "u1", NAMED)])


def _hashes(points: np.ndarray) -> np.ndarray:
    """Hash of the WIDTH code points from each place on, by those of half the length (the last places stand for less)."""
    h, k = points.astype(np.uint64) + np.uint64(1), 1
    while k < WIDTH:
        h[:-k] = h[:-k] * np.uint64(pow(_PRIME, k, 1 << 64)) + h[k:]
        k *= 2
    return mixed(h)


def shingles(line: str) -> np.ndarray:
    """The set of a line's hashed shingles; a shorter line is one shingle as a whole."""
    h = _hashes(np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32))
    return _distinct(h[:max(1, len(h) - WIDTH + 1)])


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)  # several times faster than np.unique
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _values(points: np.ndarray, span: int = 1 << 15) -> np.ndarray:
    """As _hashes, in 32 bits for sketches; ``span`` places at a time, which stay in the processor's cache."""
    out, spare = np.empty(len(points), np.uint32), np.empty(span + WIDTH, np.uint32)
    for at in range(0, len(points), span):
        h = points[at:at + span + WIDTH - 1] + np.uint32(1)
        k = 1
        while k < min(WIDTH, len(h)):
            t = np.multiply(h[:-k], np.uint32(pow(_SMALL, k, 1 << 32)), out=spare[:len(h) - k])
            np.add(t, h[k:], out=h[:-k])
            k *= 2
        h = h[:span]
        t = spare[:len(h)]
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.bitwise_xor(h, np.right_shift(h, np.uint32(shift), out=t), out=h)
            np.multiply(h, np.uint32(factor), out=h)
        np.bitwise_xor(h, np.right_shift(h, np.uint32(16), out=t), out=out[at:at + span])
    return out


def _sketches(lines: list[str], steps: list[np.uint32] = _STEPS, rows: int = ROWS) -> np.ndarray:
    """Band hashes of lines (not empty), from MinHash values made of the hashes of all of them at once. A line's hashes fill
    columns of COLUMN rows, the last one up with its last hash, so that minima are taken along rows of a block."""
    joined = "\n".join(lines)
    values = _values(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32))
    length = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    for i in np.flatnonzero(length < WIDTH):  # what follows a short line isn't part of it
        values[starts[i]] = np.uint32(int(shingles(lines[i])[0]) >> 32)
    use = np.maximum(1, length - WIDTH + 1)
    columns = -(-use // COLUMN)
    first = np.concatenate([[0], np.cumsum(columns)[:-1]])
    begin = np.repeat(starts - COLUMN * first, columns) + COLUMN * np.arange(columns.sum())
    last = np.repeat(starts + use - 1, columns)
    least = np.empty((len(steps), len(begin)), np.uint32)
    for at in range(0, len(begin), BLOCK):
        cut = slice(at, at + BLOCK)
        block = values[np.minimum(begin[cut] + np.arange(COLUMN)[:, None], last[cut])]
        for step, out in zip(steps, least[:, cut], strict=True):
            np.minimum.reduce(np.multiply(block, step, out=block), axis=0, out=out)
    least = np.minimum.reduceat(least, first, axis=1)
    out = np.zeros((len(steps) // rows, len(lines)), np.uint64)
    for i, low in enumerate(least):
        out[i // rows] = mixed(out[i // rows] * np.uint64(_PRIME) + low)
    return out.T.copy()


def _finer(members: DataFrame) -> DataFrame:
    """Columns class and bands: the finer bands of the members' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, at = b.column(1).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and size < CHUNK // 8:
                    size += len(texts[to])
                    to += 1
                bands = np.concatenate([_sketches(texts[at:to], steps, FINE_ROWS) for steps in _FINE], axis=1)
                flat = pa.array(bands.view(np.int64).ravel())
                ends = pa.array(np.arange(to - at + 1, dtype=np.int32) * np.int32(bands.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.ListArray.from_arrays(ends, flat)], ["class", "bands"])
                at = to

    return members.select("class", "text").mapInArrow(run, "class long, bands array<long>")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, ...]]:
    """Ids, hashes, line numbers, lines and their fingerprints: those with a word, about CHUNK characters at once."""
    has_word, fingerprint = re.compile(WORD).search, xxhash.xxh3_128_digest
    for b in batches:
        held, size = [], 0
        for i, h, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            for number, line in enumerate((t or "").split("\n")):
                if has_word(line):
                    held.append((i, h, number, line, fingerprint(line.encode("utf-8", "replace"))))
                    size += len(line) + 1
                    if size > CHUNK:
                        yield tuple(zip(*held, strict=True))
                        held, size = [], 0
        if held:
            yield tuple(zip(*held, strict=True))


def _name(fingerprint: bytes) -> int:
    return int.from_bytes(fingerprint[:NAMED], "little")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where lines are. Of equal ones in a chunk all but the first in order lose their fingerprint, so that a line in very
    many texts is sent on once a chunk; a first place whose row repeats isn't told again."""
    for ids, hashes, numbers, lines, prints in _chunks(batches):
        place = lambda j: (ids[j] is not None, ids[j] or 0, hashes[j], numbers[j])
        first: dict[bytes, int] = {}
        sent, tell = list(prints), [True] * len(prints)
        for j, p in enumerate(prints):
            if (k := first.setdefault(p, j)) != j:
                if place(j) < place(k):
                    first[p], sent[k] = j, None
                elif place(j) > place(k):
                    sent[j] = None
                else:
                    tell[j] = False
        rows = pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int32()), pa.array([len(x) for x in lines], pa.int64()),
            pa.array(sent, pa.binary()), pa.array([_name(p) for p in prints], pa.int64())], ["id", "hash", "line", "n", "fingerprint", "name"])
        yield rows if all(tell) else rows.filter(pa.array(tell))


def _bytes_of(names: np.ndarray) -> np.ndarray:
    return names.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAMED]


def _names_of(packed: np.ndarray) -> np.ndarray:
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :NAMED] = packed
    return out.view("<u8").ravel().astype(np.int64)


def _banded(parts: int) -> Callable:
    """Bands of lines, packed: a row for each part of each band (its lines by band hash), and rows of lines tied already, as
    of those that share a band within one lot only one is sent."""

    def packed(sketches: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)
        for i in range(BANDS):
            h = sketches[:, i]
            key = ((h >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
            order = np.argsort(key)
            key, own = key[order], names[order]
            again = np.flatnonzero(key[1:] == key[:-1])
            tied = np.empty(len(again), _TIE)
            tied["a"], tied["b"] = _bytes_of(own[again]), _bytes_of(own[again + 1])
            key, own = np.delete(key, again + 1), np.delete(own, again + 1)
            entries = np.empty(len(key), _ENTRY)
            entries["band"], entries["line"] = key.astype(np.uint32), _bytes_of(own)
            cuts = np.searchsorted(key, bounds)
            rows = [(i * parts + p, entries[lo:hi].tobytes()) for p, (lo, hi) in enumerate(itertools.pairwise(cuts.tolist())) if hi > lo]
            if len(tied):
                rows.append((-1 - int(own[0]) % (BANDS * parts), tied.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()  # lines whose bands this task has sent; once is enough
        sketches, names, n = [], [], 0
        for *_, lines, prints in _chunks(batches):
            if len(met) > MET:
                met.clear()
            new = [j for j, p in enumerate(prints) if p not in met and not met.add(p)]
            if new:
                sketches.append(_sketches([lines[j] for j in new]))
                names.append(np.array([_name(prints[j]) for j in new], np.int64))
                n += len(new)
            if n >= SENT:
                yield from packed(np.concatenate(sketches), np.concatenate(names))
                sketches, names, n = [], [], 0
        if n:
            yield from packed(np.concatenate(sketches), np.concatenate(names))

    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of lines (a, b) next to each other in a bucket; holds the entries of one part of a band at once."""
    rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    for part, group in itertools.groupby(rows, key=lambda r: r[0]):
        packed = b"".join(r[1] for r in group)
        if part < 0:
            a, b = (_names_of(np.frombuffer(packed, _TIE)[k]) for k in "ab")
        else:
            entries = np.frombuffer(packed, _ENTRY)
            band = entries["band"].copy()
            order = np.argsort(band)
            band, own = band[order], _names_of(entries["line"])[order]
            same = band[1:] == band[:-1]
            a, b = own[1:][same], own[:-1][same]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return contract(_ties(batches))


class LineShingles:
    def __call__(self, text: str) -> np.ndarray:
        return shingles(text)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sets of several lines, hashed at once."""
        h, at, out = _hashes(np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)), 0, []
        for x in texts:
            out.append(_distinct(h[at:at + len(x) - WIDTH + 1]) if len(x) >= WIDTH else shingles(x))
            at += len(x) + 1
        return out


def drop_repeated(df: DataFrame, id: str, text: str, percent: int = 80) -> DataFrame:
    """``df`` with the column ``text`` without repeated lines, and n_lines and n_removed (long).

    Lines with a word are alike if their sets of shingles of eight characters have ``percent`` in 100 of their union in
    common, and equal lines of any length. Of every component of alike lines the first stays: that of the smallest id,
    in a document the upper one. Lines without a word stay as they are; a text loses a removed line with one line break,
    and is empty if none is left. Equal lines are one to every step, known by a fingerprint. MinHash bands tell which
    lines may be alike; those are read once more, compared exactly, and joined into components over the whole cluster.
    Null texts stay null and have no lines. Null ids are an id like others (the first); repeated rows of one id and text
    count as one document and stay alike. Input columns n_lines and n_removed are replaced.
    """
    src = df.drop("n_lines", "n_removed").withColumn("_hash", F.xxhash64(F.col(text)))
    narrow = src.select(F.col(id).cast("long").alias("id"), F.col("_hash").alias("hash"), F.col(text).alias("text"))
    place, told = F.struct("id", "hash", "line"), F.col("fingerprint").isNotNull()
    equal = Window.partitionBy("fingerprint", F.when(~told, F.xxhash64("id", "hash", "line"))).orderBy("id", "hash", "line")
    first = F.first(place).over(equal.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = (narrow.mapInArrow(_places, "id long, hash long, line int, n long, fingerprint binary, name long")
            .withColumn("own", told & (F.row_number().over(equal) == 1)).withColumn("again", told & first.eqNullSafe(place)))
    rows = written(rows.where("own or not again").select("id", "hash", "line", "n", "name", "own", F.monotonically_increasing_id().alias("class")))
    classes = rows.where("own").drop("own")
    parts = max(1, math.ceil(classes.count() / PART))
    bands = narrow.mapInArrow(_banded(parts), "part int, entries binary").repartition("part").sortWithinPartitions("part")
    near = components(bands.mapInArrow(_tied, "a long, b long"), contracted=True).select(F.col("node").alias("name"), F.col("component").alias("group"))
    groups = written(classes.join(near, "name").drop("name"))

    def texts(members: DataFrame) -> DataFrame:
        of = narrow.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "text")
        at = members.join(of, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).drop("_id", "_hash")
        return at.withColumn("text", F.get(F.split("text", "\n"), F.col("line")))

    found = written(connect(groups, texts, LineShingles, percent, _finer).join(groups, "class").select("component", place.alias("place")))
    stays = found.groupBy("component").agg(F.min("place").alias("stays"))
    later = found.join(stays, "component").where("place <> stays").select("place.*")
    gone = rows.where("not own").select("id", "hash", "line").unionByName(later).groupBy("id", "hash").agg(F.collect_set("line").alias("_gone"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        def one(t, g):
            if t is None or g is None:
                return None
            g = set(g)
            return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)

        return pd.Series([one(t, g) for t, g in zip(texts, gone, strict=True)], dtype=object)

    without = without.asNondeterministic()  # else a caller's filter on the text has it run once more, in a worker of its own
    out = src.join(gone, F.col(id).cast("long").eqNullSafe(gone["id"]) & (F.col("_hash") == gone["hash"]), "left").drop(gone["id"]).drop(gone["hash"])
    return (out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long"))
            .withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0)).cast("long"))
            .withColumn(text, F.coalesce(without(F.when(F.col("_gone").isNotNull(), F.col(text)), F.col("_gone")), F.col(text)))
            .select(*[c for c in df.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed"))
