"""Spelling variants: words one edit apart, found by products of letter-count blocks, and grouped under the usual form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, written

#: Maximal runs of these characters are words; only A-Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
#: Classes of letters that a block is named by, and rows of a block that are multiplied at once.
CLASSES, TILE = 8, 2048


def occurrences(df: DataFrame, id: str, text: str, least: int = 5, drop_one_in: int = 97) -> DataFrame:
    """Columns word and n: words of at least ``least`` code points and how often they occur.

    A run of letters at id d has the hash crc32("d:run"), run in lower case; if ``drop_one_in`` divides it, the run's code
    point at hash modulo length is left out, as a slip of the pen would. Null texts have no runs; a null id reads
    as nothing before the colon. Words are counted where texts are read before anything is shuffled."""
    runs = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({RUN})"), F.lit(1)))
    rows = df.select(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit(":")).alias("place"), runs.alias("run"))
    rows = rows.withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hashed = rows.withColumn("h", F.crc32(F.concat("place", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    short = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % drop_one_in == 0, short).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))


def _counts(words: list[str]) -> np.ndarray:
    """Letter counts of words (one at least, none empty), one row each and one column for each letter that occurs."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(w) for w in words])
    letters, column = np.unique(points, return_inverse=True)
    at = np.repeat(np.arange(len(words)), size) * len(letters) + column
    counts = np.bincount(at, minlength=len(words) * len(letters)).reshape(len(words), len(letters))
    return counts.astype("f4" if counts.max() < 1000 else "f8")  # squares are exact


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return i < len(b) and len(b) - n <= 1 and a[i + (len(b) == n):] == b[i + 1:]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with the blocks it belongs to: ``whole`` that of its own letter classes, and for each class it has, that of
    its classes with one letter of this class less."""
    for b in batches:
        for start in range(0, b.num_rows, 8192):
            part = b.slice(start, 8192)
            words = part.column(0).to_pylist()
            if not words:
                continue
            points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
            owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
            have = np.bincount(owner * CLASSES + points % CLASSES, minlength=len(words) * CLASSES).reshape(-1, CLASSES)
            at, less = [np.arange(len(words))], [have]
            for c in range(CLASSES):
                rows = np.flatnonzero(have[:, c])
                at.append(rows)
                less.append(have[rows] - (np.arange(CLASSES) == c))
            whole = np.repeat([True] + [False] * CLASSES, [len(x) for x in at])
            at, keys = np.concatenate(at), np.minimum(np.concatenate(less), 65535).astype("<u2")
            yield pa.RecordBatch.from_arrays([
                pa.array([k.tobytes() for k in keys], pa.binary()), part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array(whole)],
                ["block", "word", "n", "whole"])


def _near(short: list[str], long: list[str], same: bool, block: bytes) -> Iterator[tuple[int, int]]:
    """Pairs of the two lists whose letter counts have a squared distance of at most two and that are one edit apart.
    ``same``: one list with itself, each pair once. Of two words of one length only the block without the letters that
    differ says so, as they may share several."""
    counts = _counts(short + long)
    a, b = counts[:len(short)], counts[len(short):]
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    rows, columns = np.nonzero(square <= 2)
    for i, j in zip(rows.tolist(), columns.tolist()):
        x, y = short[i], long[j]
        if same and x >= y or not one_edit(x, y):
            continue
        if len(x) == len(y):
            k = next(k for k in range(len(x)) if x[k] != y[k])
            if _without(x, k) != block:
                continue
        yield i, j


def _without(word: str, k: int) -> bytes:
    have = np.bincount(np.frombuffer((word[:k] + word[k + 1:]).encode("utf-32-le"), np.uint32) % CLASSES, minlength=CLASSES)
    return np.minimum(have, 65535).astype("<u2").tobytes()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of each block (or of two tiles of a large one), both ways; rows come sorted by block and tiles."""
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "near", "near_n"])

    def pairs(held: list[tuple]) -> None:
        block, t, u = held[0][:3]
        sides = [[[], []], [[], []]]  # by tile, then less one letter or whole
        for _, _, _, tile, whole, word, n in held:
            sides[0 if tile == t else 1][whole].append((word, n))
        (less, whole), other = sides[0], sides[1]
        todo = [(less, less, True), (whole, less, False)] if t == u else [(less, other[0], False), (whole, other[0], False), (other[1], less, False)]
        for x, y, same in todo:
            for i in range(0, len(x), TILE):
                for j in range(i if same else 0, len(y), TILE):
                    p, q = x[i:i + TILE], y[j:j + TILE]
                    for k, m in _near([w for w, _ in p], [w for w, _ in q], same and i == j, block):
                        out.append((*p[k], *q[m]))
                        out.append((*q[m], *p[k]))

    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                pairs(held)
                held = []
                if len(out) > 20_000:
                    yield table()
                    out.clear()
            held.append(row)
    if held:
        pairs(held)
    yield table()


def near_pairs(words: DataFrame) -> DataFrame:
    """Columns word, n, near, near_n: all ordered pairs of words (distinct, with their counts n) one edit apart.

    Words are blocked by how many letters of each of eight classes they have, in the form that two words one edit apart
    share: both lack one letter of a common block, or one lacks it and the other is it, so blocks are of one length or
    of adjacent ones. Within a block the product of the letter-count matrices gives all squared distances at once; pairs
    at most two apart are verified letter by letter. A block of many words is dealt into tiles, each pair of which is a
    task's work, so that no task holds more than two tiles."""
    blocks = written(words.select("word", "n").mapInArrow(_blocks, "block binary, word string, n long, whole boolean"))
    sizes = blocks.groupBy("block").agg(F.count("*").alias("k"), F.min("whole").alias("alone")).where("k > 1 and not alone")
    tiles = sizes.select("block", F.ceil(F.col("k") / (4 * TILE)).cast("int").alias("tiles"))
    at = blocks.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    at = at.withColumn("other", other).select("block", F.least("tile", "other").alias("t"), F.greatest("tile", "other").alias("u"), "tile",
                                              F.col("whole").cast("int").alias("whole"), "word", "n")
    return (at.repartition("block", "t", "u").sortWithinPartitions("block", "t", "u").mapInArrow(_compare, "word string, n long, near string, near_n long"))


def _rooted(forms: DataFrame) -> DataFrame:
    """Columns word and root for words with a form: forms of forms, twice as far with each round. Counts at least double
    from word to form, so there are no circles, and a few rounds reach every root."""
    up = written(forms.select("word", F.col("form").alias("root")))
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("_far"))
        after = written(up.join(far, "root", "left").select("word", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved")))
        dropped(up)
        if not after.where("moved").head(1):
            return after.select("word", "root")
        up = after.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """Columns word, n, n_near (words one edit apart), form, form_n (the near word that occurs most often, the smallest in
    code-point order of such, if it occurs at least twice as often; else null) and root (the last of the forms from the
    word on; the word itself without a form). ``words``: distinct words and their counts n. No words give no rows."""
    words = written(words)
    best = F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    found = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    usual = F.when(-F.col("best.col1") >= 2 * F.col("n"), F.col("best"))
    found = written(found.select("word", "n_near", usual["near"].alias("form"), (-usual["col1"]).alias("form_n")))
    roots = _rooted(found.where("form is not null"))
    return (words.join(found, "word", "left").join(roots, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")))


def spelling_variants(df: DataFrame, id: str, text: str, least: int = 5, seldom: int = 3) -> DataFrame:
    """Groups the words of whole texts that occur at least ``seldom`` times, as ``variants`` does. Other columns aren't read;
    repeated rows count each time; an empty table gives no rows."""
    return variants(occurrences(df, id, text, least).where(F.col("n") >= seldom))

