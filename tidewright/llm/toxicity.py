"""Toxicity of whole texts: a small convolutional classifier over hashed words, trained on all labelled rows by rounds over
shards whose steps are averaged."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mix import random_key
from .store import written

BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 16, 16, 16, (1, 2, 3)
BATCH, RATE = 32, 0.01
#: Rows that train one after another between two averages, and texts and words of them held at once.
SHARD, LOT, LOT_WORDS = 8192, 2048, 1 << 20
#: Every text is seen between 3 and 10 times; more than 3 times where there are few, to see so many in all.
SEEN = 24_000
#: Steps are summed as whole numbers of this part, so that a sum doesn't depend on its order.
UNIT = 1 << 32
#: Logits are counted in steps of 1 / FINE between -LIMIT and LIMIT for the calibration.
FINE, LIMIT = 1024, 64
#: Words convolved at once; longer texts go in parts that overlap, and the maxima of the parts are merged.
CHUNK = 1 << 16
_MEMO = 1 << 18
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() or chr(c) in "'*@" else 32 for c in range(256))


def split(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PLAIN).split()


def buckets(word: bytes) -> tuple[int, int, int]:
    """A word is its own bucket, and those of its beginnings of four and seven bytes."""
    return zlib.crc32(word) % BUCKETS, zlib.crc32(b"4" + word[:4]) % BUCKETS, zlib.crc32(b"7" + word[:7]) % BUCKETS


@dataclass
class Model:
    """Hashed embeddings, filters of several widths with their maxima over the text, and a logistic layer on top.
    ``scale`` and ``shift`` turn its output into a probability; ``cut`` holds the calibrated threshold per language.
    ``rows`` tells how many labelled rows trained and how many calibrated it."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    top: np.ndarray
    top_bias: float
    scale: float = 1.0
    shift: float = 0.0
    cut: dict | None = None
    rows: tuple[int, int] = (0, 0)

    @classmethod
    def start(cls, seed: int = 1) -> Model:
        r = np.random.default_rng(seed)
        f = [(r.standard_normal((WIDTH * k, FILTERS)) / np.sqrt(WIDTH * k)).astype("f4") for k in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return cls((r.standard_normal((BUCKETS, WIDTH)) * 0.3).astype("f4"), f, [np.zeros(FILTERS, "f4") for _ in WIDTHS],
                   (r.standard_normal(n) / np.sqrt(n)).astype("f4"), 0.0)

    def matrix(self) -> np.ndarray:
        """All parameters as rows of WIDTH: the embeddings, then the others."""
        rest = np.concatenate([p.ravel() for p in (*self.filters, *self.bias, self.top)] + [np.array([self.top_bias], "f4")])
        return np.concatenate([self.embedding, np.resize(np.concatenate([rest, np.zeros(-len(rest) % WIDTH, "f4")]), (-(-len(rest) // WIDTH), WIDTH))]).astype("f4")

    @classmethod
    def of(cls, matrix: np.ndarray) -> Model:
        rest, at, parts = matrix[BUCKETS:].ravel(), 0, []
        n = FILTERS * len(WIDTHS)
        for shape in (*[(WIDTH * k, FILTERS) for k in WIDTHS], *[(FILTERS,) for _ in WIDTHS], (n,)):
            parts.append(rest[at:at + int(np.prod(shape))].reshape(shape).copy())
            at += parts[-1].size
        k = len(WIDTHS)
        return cls(matrix[:BUCKETS].copy(), parts[:k], parts[k:2 * k], parts[-1], float(rest[at]))

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return self.embedding[ids].sum(axis=1)

    def windows(self, x: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Filter outputs at each place of x; places that aren't ``real`` give 0."""
        out = np.empty((len(x), FILTERS * len(WIDTHS)), "f4")
        for i, k in enumerate(WIDTHS):
            c = x @ self.filters[i][:WIDTH] + self.bias[i]
            for j in range(1, k):
                c[:-j] += x[j:] @ self.filters[i][WIDTH * j:WIDTH * (j + 1)]
            out[:, i * FILTERS:(i + 1) * FILTERS] = c
        np.maximum(out, 0, out=out)
        out[~real] = 0
        return out


PAD = max(WIDTHS) - 1


def _padded(part: np.ndarray) -> np.ndarray:
    return np.concatenate([part, np.zeros((PAD, *part.shape[1:]), part.dtype)])


def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all parts; which of them begin windows (all but the last PAD of each part); where parts start."""
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    real = np.ones(lengths.sum(), bool)
    for j in range(1, PAD + 1):
        real[starts + lengths - j] = False
    return np.concatenate(parts), real, starts


def _batches(size: np.ndarray, r: np.random.Generator) -> list[np.ndarray]:
    """Texts of like length together, in random order; BATCH at most, and fewer where they are long."""
    order = r.permutation(len(size))
    order = order[np.argsort(size[order] // 200, kind="stable")]
    out, at = [], 0
    while at < len(order):
        most = np.searchsorted(np.cumsum(size[order[at:at + BATCH]] + PAD), CHUNK, "right")
        out.append(order[at:at + max(1, int(most))])
        at += len(out[-1])
    return [out[i] for i in r.permutation(len(out))]


def train(model: Model, lots: Iterable[tuple[list[np.ndarray], np.ndarray]], seed) -> np.ndarray:
    """One pass of Adam on the logistic loss over lots of texts (buckets of their words, three each) and labels; a maximum
    passes its gradient to the one window it came from. Changes the model; gives how often each bucket was changed, and
    the number of steps."""
    r = np.random.default_rng(seed)
    dense = [*model.filters, *model.bias, model.top]
    m, v = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    em, ev = np.zeros_like(model.embedding), np.zeros_like(model.embedding)
    step, changed = 0, np.zeros(BUCKETS + 1, np.int64)
    for ids, labels in lots:
        y_all = labels.astype("f4")
        for b in _batches(np.array([len(i) for i in ids]), r):
            step += 1
            idx, real, starts = _joined([_padded(ids[i]) for i in b])
            x = model.vectors(idx)
            x[~real] = 0
            c = model.windows(x, real)
            pooled = np.maximum.reduceat(c, starts)
            z = pooled @ model.top + model.top_bias
            g = (1 / (1 + np.exp(-z)) - y_all[b]) / len(b)
            g_top = pooled.T @ g
            g_pooled = np.outer(g, model.top) * (pooled > 0)
            seg = np.repeat(np.arange(len(b)), np.diff([*starts, len(x)]))
            at = np.maximum.reduceat(np.where(c == pooled[seg], -np.arange(len(c), dtype=np.int32)[:, None], np.int32(-len(c))), starts) * -1
            g_x, g_filters, g_bias = {}, [], []
            for i, k in enumerate(WIDTHS):
                s = slice(i * FILTERS, (i + 1) * FILTERS)
                where, gp = np.minimum(at[:, s], len(x) - k), g_pooled[:, s]
                own = np.concatenate([x[where + j] for j in range(k)], axis=2)  # texts, filters, k * WIDTH
                g_filters.append(np.einsum("bf,bfd->df", gp, own).astype("f4"))
                g_bias.append(gp.sum(axis=0).astype("f4"))
                back = gp[:, :, None] * model.filters[i].T[None]
                for j in range(k):
                    g_x.setdefault("at", []).append((where + j).ravel())
                    g_x.setdefault("g", []).append(back[:, :, j * WIDTH:(j + 1) * WIDTH].reshape(-1, WIDTH))
            places, grads = np.concatenate(g_x["at"]), np.concatenate(g_x["g"])
            use = real[places] & (np.abs(grads).sum(axis=1) > 0)
            rows = idx[places[use]].ravel()
            touched, back_to = np.unique(rows, return_inverse=True)
            g_e = np.zeros((len(touched), WIDTH), "f4")
            np.add.at(g_e, back_to, np.repeat(grads[use], 3, axis=0))
            for p, gr, a, q in zip(dense, [*g_filters, *g_bias, g_top.astype("f4")], m, v, strict=True):
                a += 0.1 * (gr - a)
                q += 0.001 * (gr * gr - q)
                p -= RATE * 0.3 * (a / (1 - 0.9 ** step)) / (np.sqrt(q / (1 - 0.999 ** step)) + 1e-8)
            model.top_bias -= RATE * float(g.sum())
            em[touched] += 0.1 * (g_e - em[touched])
            ev[touched] += 0.05 * (g_e * g_e - ev[touched])
            model.embedding[touched] -= RATE * em[touched] / (np.sqrt(ev[touched]) + 1e-8)
            changed[touched] += 1
    changed[-1] = step
    return changed


class Scorer:
    """Scores texts under a model, remembering the vectors of words met (a bounded number)."""

    def __init__(self, model: Model):
        self.model, self.memo, self.rows = model, {}, np.empty((1024, WIDTH), "f4")

    def ids(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        new = [w for w in set(words) if w not in memo]
        if new:
            if len(memo) + len(new) > _MEMO:
                memo.clear()
                new = list(set(words))
            first = len(memo)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[first:first + len(new)] = self.model.vectors(np.array([buckets(w) for w in new], np.int32))
            memo.update(zip(new, range(first, first + len(new)), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def met(self, words: list[bytes]) -> np.ndarray:
        at = self.ids(words)
        return self.rows[at]

    def logits(self, texts: Iterator[str]) -> np.ndarray:
        return self._logits((split(t or "") for t in texts), self.met)

    def logits_of(self, ids: Iterator[np.ndarray]) -> np.ndarray:
        """Of texts whose words are given by their buckets."""
        return self._logits(ids, self.model.vectors)

    def _logits(self, texts: Iterator, vectors) -> np.ndarray:
        pooled, parts, owner, held, n = [], [], [], 0, 0

        def flush():
            nonlocal parts, owner, held
            if parts:
                x, real, starts = _joined(parts)
                pooled.append((np.array(owner), np.maximum.reduceat(self.model.windows(x, real), starts)))
                parts, owner, held = [], [], 0

        for n, words in enumerate(texts, 1):
            for a in range(0, max(len(words), 1), CHUNK):
                part = words[a:a + CHUNK + PAD]
                if held + len(part) > CHUNK:
                    flush()
                at = vectors(part)
                # the words that a part shares with the next end its windows, but begin none
                parts.append(at if a + CHUNK < len(words) else _padded(at))
                owner.append(n - 1)
                held += len(parts[-1])
        flush()
        best = np.zeros((n, FILTERS * len(WIDTHS)), "f4")
        for own, values in pooled:
            np.maximum.at(best, own, values)
        return best @ self.model.top + self.model.top_bias

    def scores(self, texts) -> np.ndarray:
        m = self.model
        return 1 / (1 + np.exp(-np.clip(m.scale * self.logits(texts).astype("f8") + m.shift, -500, 500)))


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, as the buckets of its words: three unsigned 16-bit integers each, compressed."""
    memo: dict[bytes, bytes] = {}

    def of(word: bytes) -> bytes:
        if len(memo) >= _MEMO:
            memo.clear()
        memo[word] = found = pack("<3H", *buckets(word))
        return found

    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            coded = [zlib.compress(b"".join([memo.get(w) or of(w) for w in split(t)]), 1) for t in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(coded, pa.binary())], [*part.schema.names[:-1], "ids"])


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), "<u2").reshape(-1, 3).astype(np.int32)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Shard, texts and labels of rows (shard, y, ids), in lots of bounded size that don't cross shards."""
    shard, ids, y, words = None, [], [], 0
    for b in batches:
        for s, label, packed in zip(*(b.column(i) for i in range(3)), strict=True):
            s = s.as_py()
            if ids and (s != shard or len(ids) >= LOT or words >= LOT_WORDS):
                yield shard, ids, np.array(y)
                ids, y, words = [], [], 0
            shard = s
            ids.append(_ids(packed.as_py()))
            y.append(label.as_py())
            words += len(ids[-1])
    if ids:
        yield shard, ids, np.array(y)


def _round(rows: DataFrame, model: Model, seed: int, number: int) -> Model:
    """The model after every shard of ``rows`` (shard, y, ids) has been passed once, each from ``model`` on. A parameter
    moves by the mean of the shards' moves, weighted by how often each changed it, so a word of one shard keeps its move."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model.matrix())
    names = ["row", "weight", *[f"m{i}" for i in range(WIDTH)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        base = shared.value
        weight, moves = np.zeros(len(base), np.int64), np.zeros(base.shape, np.int64)
        for shard, lots in groupby(_lots(batches), lambda x: x[0]):
            own = Model.of(base)
            changed = train(own, ((ids, y) for _, ids, y in lots), [seed, number, shard])
            w = np.concatenate([changed[:-1], np.full(len(base) - BUCKETS, changed[-1])])
            weight += w
            moves += np.rint((own.matrix().astype("f8") - base) * w[:, None] * UNIT).astype(np.int64)
        at = np.flatnonzero(weight)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weight[at]), *[pa.array(np.ascontiguousarray(moves[at, i])) for i in range(WIDTH)]], names)

    moves = rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))
    total = moves.groupBy("row").agg(*[F.sum(n).alias(n) for n in names[1:]]).toArrow()  # one row a parameter row at most
    shared.unpersist()
    at, weight = total.column("row").to_numpy(), total.column("weight").to_numpy()
    out = model.matrix().astype("f8")
    out[at] += np.stack([total.column(f"m{i}").to_numpy() for i in range(WIDTH)], axis=1) / UNIT / weight[:, None]
    return Model.of(out.astype("f4"))


def _counted(rows: DataFrame, model: Model) -> DataFrame:
    """Rows by language, label and logit, the latter in steps of 1 / FINE: columns lang, y, bin, k."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                z = Scorer(shared.value).logits_of(map(_ids, part.column(2).to_pylist()))
                bins = np.rint(np.clip(z.astype("f8"), -LIMIT, LIMIT) * FINE).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bins)], ["lang", "y", "bin"])

    return rows.select("lang", "y", "ids").mapInArrow(run, "lang string, y int, bin int").groupBy("lang", "y", "bin").agg(F.count("*").alias("k"))


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Scale and shift by logistic regression on rows (lang, y, ids) that weren't trained on; per language the threshold of
    the best F1 on them, or 0.3 where there are fewer than 20 toxic ones. Counts of logits reach the driver, whose
    number is bounded whatever the number of rows, and counts by threshold of each such language."""
    counted = written(_counted(rows, model))
    t = counted.groupBy("y", "bin").agg(F.sum("k").alias("k")).toPandas().sort_values(["y", "bin"])
    z, y, k = t.bin.to_numpy() / FINE, t.y.to_numpy().astype("f8"), t.k.to_numpy() / t.k.sum()
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([(k * (p - y) * z).sum() + 1e-6 * (a - 1), (k * (p - y)).sum()])
        w = k * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum()]])
        d = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -3, 3)
    model.scale, model.shift = (float(a), float(b)) if a > 0 else (1.0, 0.0)
    share = 1 / (1 + F.exp(-(F.lit(model.scale) * F.col("bin") / FINE + F.lit(model.shift))))
    reached = F.least(F.greatest(F.floor((share - 0.05) * 100 + 1e-9) + 1, F.lit(0)), F.lit(91))
    enough = counted.where("lang is not null").groupBy("lang").agg(F.sum(F.col("k") * F.col("y")).alias("n")).where("n >= 20").select("lang")
    per = counted.join(enough, "lang").groupBy("lang", reached.alias("reached")).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("y")).alias("hits"))
    model.cut = {}
    for code, own in per.toPandas().groupby("lang"):
        n, hits = np.zeros(92), np.zeros(92)
        n[own.reached.to_numpy()], hits[own.reached.to_numpy()] = own.n.to_numpy(), own.hits.to_numpy()
        above, found = np.cumsum(n[::-1])[::-1][1:], np.cumsum(hits[::-1])[::-1][1:]
        model.cut[code] = float(np.linspace(0.05, 0.95, 91)[int(np.argmax(2 * found / (above + hits.sum())))])


def fit(docs: DataFrame, labels: DataFrame, id: str, text: str, lang: str, label: str, seed: int = 1) -> Model:
    """A model from all rows of ``labels`` (id, label) that have a document. By a hash of their ids a fifth calibrates and
    the others train, shard by shard: a round passes all shards once and takes the mean of what they learned. Only the
    model, whose size is fixed, is sent out and comes back. Rows of null labels or ids don't count (of several labels the
    largest does); without rows of both labels the score is the share of toxic rows. Only texts and labels teach the score;
    languages are for the thresholds beside it."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max(label).cast("int").alias("y"))
    narrow = docs.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key = random_key(seed, "id")
    ids = narrow.select("id").join(known, "id").groupBy("y", (key % 5 == 0).alias("held")).count().collect()
    n = {(r["y"], r["held"]): r["count"] for r in ids}
    if len({y for y, _ in n}) < 2:
        model = Model.start(seed)
        model.top[:] = 0
        share = sum(k for (y, _), k in n.items() if y == 1) / max(1, sum(n.values()))
        model.shift, model.cut = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), {}
        return model
    apart = len(n) == 4  # else all rows do both
    learn = sum(k for (_, held), k in n.items() if not (held and apart))
    shards = -(-learn // SHARD)
    # by shuffle at any size: labels grow with the texts, so they aren't sent whole to every task
    own = narrow.join(known.hint("merge"), "id").select("lang", "y", key.alias("key"), "text")
    coded = own.mapInArrow(_coded, "lang string, y int, key long, ids binary").withColumn("held", F.col("key") % 5 == 0)
    coded = coded.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    rows = written(coded.repartition(4 * shards, "shard").sortWithinPartitions("shard", "key", "ids"))
    teach = (rows.where("not held") if apart else rows).select("shard", "y", "ids")
    model = Model.start(seed)
    for number in range(max(3, min(10, round(SEEN / learn)))):
        model = _round(teach, model, seed, number)
    _calibrate(model, rows.where("held") if apart else rows)
    model.rows = (learn, sum(k for (_, held), k in n.items() if held or not apart))
    return model


def score(text: Column, model: Model, spark) -> Column:
    """The probability, 0 to 1, that whole texts are toxic. Null and empty texts have that of a text without words;
    repeated rows score alike. The model goes to the executors once; its size is fixed by its parameters (4 MB)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(s.scores(texts.tolist()), index=texts.index, dtype="float64")

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return scored(text)


def classify(df: DataFrame, model: Model, text: str, lang: str) -> DataFrame:
    """Adds score, and toxic: whether it reaches the threshold of the row's language (0.3 for others and for null)."""
    cut = F.coalesce(F.create_map(*[F.lit(x) for kv in model.cut.items() for x in kv])[F.col(lang)], F.lit(0.3)) if model.cut else F.lit(0.3)
    return df.withColumn("score", score(F.col(text), model, df.sparkSession)).withColumn("toxic", F.col("score") >= cut)
