"""Near-duplicate texts: sketches find who may be alike, whole sets decide."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, contract
from .store import dropped, written

#: SetSketch: registers and their spacing (the published settings: base 1.001, rate 20, 16-bit registers).
ROWS, BASE, RATE = 5, 1.001, 20.0
#: Chance at most that a pair at the least similarity shares no band, and the most registers there are hashes for.
MISSED, MOST = 1e-5, 1000
_TOP = (1 << 16) - 1
_R = np.random.default_rng(20)
_FACTORS = _R.integers(1, 1 << 63, MOST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _R.integers(0, 1 << 63, MOST, dtype=np.uint64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MEMO = 1 << 18
#: A group that is compared in one task holds at most so many texts, and shingles; larger groups go in blocks.
MEMBERS, SHINGLES, PIVOTS = 2048, 4_000_000, 16
#: Members from which on shingles that occur together are counted as one, and usual ones for so many members at once.
MANY = 64
#: Blocks from which on a group is first taken apart by finer bands, where there are any.
WIDE = 4
#: Characters of small groups whose sets are made at once.
LOT = 1 << 14


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class WordShingles:
    """Sets of hashed shingles of ``width`` words, A-Z in lower case. With fewer words, the whole sequence is the only
    shingle; without words the set is empty. Hashes have 64 bits; words met are remembered, a bounded number."""

    def __init__(self, width: int):
        self.width, self.memo = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        h = np.fromiter((memo[w] if w in memo else memo.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width if width < self.width else 0, np.uint64)
        for i in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i])
        return np.unique(out)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        return [self(t) for t in texts]


def bands_for(percent: int) -> int:
    """Bands of ROWS registers so that a pair of just this similarity shares none with a chance of MISSED at most: 20 at 85
    (missed with 8e-6), 29 at 80 (missed with 1e-5)."""
    return min(MOST // ROWS, max(1, math.ceil(math.log(MISSED) / math.log1p(-min(0.999999, percent / 100) ** ROWS))))


def registers(sets: list[np.ndarray], n: int) -> np.ndarray:
    """``n`` SetSketch registers of each set (not empty). Each register sees every element under a hash of its own, as the
    exponential variate of its uniform value; the smallest, on a logarithmic scale truncated at both ends, is kept. The
    registers of a union are the larger of each two, so sketches of parts merge."""
    values, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    least = np.empty((len(sets), n), np.uint64)
    for j in range(n):
        least[:, j] = np.minimum.reduceat(values * _FACTORS[j] + _OFFSETS[j], starts)
    x = -np.log1p(-np.minimum(least.astype("f8") / 2.0**64, 1 - 2.0**-53)) / RATE
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(x) / math.log(BASE))
    return np.clip(np.where(np.isfinite(k), k, _TOP), 0, _TOP).astype("<u2")


def estimate(above: np.ndarray, below: np.ndarray, equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets of n and m elements of which so many registers of the first lie above, below and at
    those of the second: the maximum of their joint likelihood, by ternary search (it is concave)."""
    u = n / (n + m)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    def loss(j):
        up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
        return above * np.log(up) + below * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        better = loss(a) < loss(b)
        lo, hi = np.where(better, a, lo), np.where(better, hi, b)
    return (lo + hi) / 2


def sketched(df: DataFrame, id: str, text: str, shingles: Callable[[], Callable], bands: int) -> DataFrame:
    """Columns id, n (set size), fingerprint (128 bits of the set; null if empty) and registers of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shingles()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [of(t) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                regs = dict(zip(full, registers([sets[i] for i in full], bands * ROWS), strict=True)) if full else {}
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([regs[i].tobytes() if i in regs else None for i in range(len(sets))], pa.binary())], ["id", "n", "fingerprint", "registers"])

    return df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, fingerprint binary, registers binary")


def buckets(bands: int) -> Column:
    """The bands of the registers as an array of hashes."""
    return F.array(*[F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(bands)])


def coarse(classes: DataFrame, bands: Column) -> DataFrame:
    """Columns class, group: classes of equal sets that share a bucket of any band, directly or through others. Buckets
    are exchanged once and sorted; every member is tied to the one before it, which takes no memory however large a
    bucket is. Linked classes are in one group but for the chance that no band agrees (see ``bands_for``)."""
    rows = classes.select("class", F.explode(bands).alias("bucket"))
    before = F.lag("class").over(Window.partitionBy("bucket").orderBy("class"))
    ties = rows.select(F.col("class").alias("a"), before.alias("b")).where("b is not null")
    return components(ties).select(F.col("node").alias("class"), F.col("component").alias("group"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _few(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect a few sets, each pair counted that nothing connects yet."""
    forest, out = _Forest(len(sets)), []
    for j in range(1, len(sets)):
        for i in range(j):
            n, m = len(sets[i]), len(sets[j])
            if min(n, m) * 100 >= max(n, m) * percent and forest.root(i) != forest.root(j):
                both = np.sort(np.concatenate([sets[i], sets[j]]))
                shared = np.count_nonzero(both[1:] == both[:-1])
                if shared * 100 >= percent * (n + m - shared):
                    forest.join(i, j)
                    out.append((i, j))
    return out


def linked_within(sets: list[np.ndarray], regs: np.ndarray | None, percent: int, known: list[int] | None = None, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect the members of a group as all links of at least ``percent`` would. Pairs whose registers'
    likelihood puts them within six standard deviations of that are looked at if nothing connects them yet; a member's
    overlaps with all others come from an index of shingles at once, and exact counts decide. Where too few of
    a member's shingles occur twice here, it is linked with nothing. ``known`` gives
    components found before; with ``queries`` only pairs with one of those are looked at; without registers all pairs
    of fitting sizes that nothing connects are counted."""
    n = len(sets)
    if n <= 6 and regs is None and known is None and queries is None:
        return _few(sets, percent)
    size = np.array([len(s) for s in sets])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(dense, kind="stable")
    owner = np.repeat(np.arange(n), size)[order]
    often = np.bincount(dense)
    first = np.concatenate([[0], np.cumsum(often)])
    common = np.diff(np.concatenate([[0], np.cumsum(often[dense] > 1)])[starts])
    weight = np.ones(len(often), np.int64)
    if n > MANY:  # of shingles that the same members have, as those around one changed word, one stands for all
        marks = np.add.reduceat(mixed(np.arange(1, n + 1, dtype=np.uint64))[owner], first[:-1])
        _, one, kind, count = np.unique(marks, return_index=True, return_inverse=True, return_counts=True)
        weight = np.where((one[kind] == np.arange(len(often))) & (often > 1), count[kind], 0)
    # those that a quarter of the members have are multiplied out, a few members with all at once
    usual = np.flatnonzero((weight > 0) & (often * 4 > n)) if n > MANY and size.max() < 1 << 24 else np.empty(0, np.int64)
    held, worth = np.zeros((n, len(usual)), np.float32), weight[usual].astype(np.float32)
    for k, x in enumerate(usual):
        held[owner[first[x]:first[x + 1]], k] = 1
    weight[usual] = 0
    out = []
    # which component each member is in: read for all others at once, rewritten only where two components join
    label = np.arange(n) if known is None else np.unique(np.array(known), return_inverse=True)[1]
    count = 1 if regs is None else regs.shape[1]
    spread = math.sqrt(percent / 100 * (1 - percent / 100) / count)
    least, agree = percent / 100 - 6 * spread, count * (percent / 100 - 8 * spread)
    asked = np.arange(n) if queries is None else queries
    for k, i in enumerate(asked):
        if k % MANY == 0:
            together = (held[asked[k:k + MANY]] * worth) @ held.T
        lo = i + 1 if queries is None else 0
        others = np.arange(lo, n)
        others = others[(label[others] != label[i]) & (np.minimum(size[others], size[i]) * 100 >= np.maximum(size[others], size[i]) * percent) & (others != i)]
        others = others[np.minimum(common[others], common[i]) * (100 + percent) >= percent * (size[others] + size[i])]
        if regs is not None and len(others):
            others = others[(regs[others] == regs[i]).sum(axis=1) >= agree]
        if regs is not None and len(others):
            equal, above = (regs[others] == regs[i]).sum(axis=1), (regs[i] > regs[others]).sum(axis=1)
            others = others[estimate(above, count - above - equal, equal, np.full(len(others), size[i], "f8"), size[others].astype("f8")) >= least]
        if not len(others):
            continue
        own = dense[starts[i]:starts[i + 1]]
        own = own[weight[own] > 0]
        lengths = often[own]
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[at], np.repeat(weight[own], lengths), minlength=n)[others] + together[k % MANY][others]
        for j in others[shared * 100 >= percent * (size[i] + size[others] - shared)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                out.append((int(i), int(j)))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows of sorted batches, by their first columns; holds one group at a time."""
    held, key = [], None
    for b in batches:
        for row in b.to_pylist():
            k = tuple(list(row.values())[:keys])
            if held and k != key:
                yield held
                held = []
            key = k
            held.append(row)
    if held:
        yield held


def _with_sets(groups: Iterator[list[dict]], of: Callable) -> Iterator[tuple[list[dict], list[np.ndarray]]]:
    """Groups, a row for each class, and the sets of their texts; those of small groups are made LOT characters at once."""
    held, size = [], 0

    def made():
        sets = iter(of.sets([r["text"] for group in held for r in group]))
        return [(group, list(itertools.islice(sets, len(group)))) for group in held]

    for group in groups:
        group.sort(key=lambda r: (r["class"], not r["asks"]))
        held.append([r for i, r in enumerate(group) if i == 0 or group[i - 1]["class"] != r["class"]])
        size += sum(len(r["text"] or "") for r in held[-1])
        if size > LOT:
            yield from made()
            held, size = [], 0
    if held:
        yield from made()


def _link(rows: DataFrame, keys: list[str], shingles: Callable[[], Callable], percent: int) -> DataFrame:
    """Links (a, b) within each group of rows (keys, class, registers, text, component, asks), as a task contracts its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, a, b = shingles(), [], []
        for group, sets in _with_sets(_groups(batches, len(keys)), of):
            regs = None
            if "registers" in group[0]:
                regs = np.frombuffer(b"".join(r["registers"] for r in group), "<u2").reshape(len(group), -1)
            known = [r["component"] for r in group] if group[0]["component"] is not None else None
            asks = np.flatnonzero([r["asks"] for r in group]) if any(r["asks"] for r in group) else None
            for i, j in linked_within(sets, regs, percent, known, asks):
                a.append(group[i]["class"])
                b.append(group[j]["class"])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = rows.select(*keys, "class", *[c for c in rows.columns if c == "registers"], "text", "component", "asks")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: contract(run(batches)), "a long, b long")


def _blocks(groups: DataFrame) -> DataFrame:
    """Blocks in which each group is compared."""
    return (groups.groupBy("group").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
            .select("group", F.greatest(F.ceil(F.col("k") / MEMBERS), F.ceil(F.col("s") / SHINGLES)).alias("blocks")))


def _apart(members: DataFrame, finer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The members with those of wide groups in the groups that finer bands give; whom these tie to nobody is linked with nobody."""
    wide = members.where(F.col("blocks") > WIDE)
    groups = coarse(finer(wide), F.col("bands")).withColumn("group", -1 - F.col("group"))  # not the name of another group
    groups = written(groups.join(wide.select("class", "n").distinct(), "class"))
    again = wide.drop("group", "blocks", "block").join(groups.drop("n").join(_blocks(groups), "group"), "class")
    again = again.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    out = written(members.where(F.col("blocks") <= WIDE).unionByName(again.select(*members.columns)))
    dropped(members)
    return out


def connect(groups: DataFrame, texts: Callable[[DataFrame], DataFrame], shingles: Callable[[], Callable], percent: int,
            finer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Columns class, component over the classes that are linked to others at all.

    ``groups``, a written table: group, class and n of classes that share a bucket with others, directly or through others
    (see ``coarse``); registers help to compare, if there are any. ``texts`` adds a column text to rows with the columns of
    ``groups``. Only texts of these classes are
    moved. A group that fits one task is compared there. A larger one, such as the near copies of one text that fill a
    third of all rows, is dealt into blocks by hash, each with the same few pivots of the group; nearly all its members
    then hang together through the pivots, and the rest is compared, in blocks, with every block. No pair that could be
    linked is left out, and no task holds more than a few blocks. As that comparison grows with the square of a group, and
    ever more groups hang together by weak ties the more rows there are, groups of more than WIDE blocks are taken apart
    first where ``finer`` adds a column bands to the members' classes, which linked ones surely share."""
    sizes = written(_blocks(groups))
    empty = F.lit(None).cast("long")
    members = texts(groups.join(sizes, "group")).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    members = members.withColumn("component", empty).withColumn("asks", F.lit(False))
    if not sizes.where("blocks > 1").head(1):
        return components(_link(members, ["group"], shingles, percent), contracted=True).select(F.col("node").alias("class"), "component")
    members = written(members)
    if finer and sizes.where(F.col("blocks") > WIDE).head(1):
        members = _apart(members, finer)
    large = members.where("blocks > 1")
    by_hash = F.struct(F.xxhash64(F.lit("pivot"), "class"), F.col("class"))
    pivots = _smallest(large, by_hash)
    spread = large.select("group", "blocks").distinct().withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    copies = pivots.drop("block", "blocks").join(spread, "group").select(*members.columns)
    links = written(_link(members.unionByName(copies), ["group", "block"], shingles, percent))
    found = written(components(links, contracted=True))
    label = F.coalesce(F.col("l"), F.col("class"))
    named = large.join(found.select(F.col("node").alias("class"), F.col("component").alias("l")), "class", "left").withColumn("component", label).drop("l")
    count = named.groupBy("group", "component").agg(F.count("*").alias("k"))
    main = count.groupBy("group").agg(F.max(F.struct("k", "component")).alias("m")).select("group", F.col("m.component").alias("main"))
    rest = named.join(main, "group").where(F.col("component") != F.col("main")).drop("main").withColumn("asks", F.lit(True))
    parts = rest.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / SHINGLES)).alias("parts"))
    rest = rest.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts"))).drop("parts")
    asked = rest.drop("block").join(spread.select("group", "block"), "group")
    among = named.join(parts, "group").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    more = _link(asked.unionByName(among.select(*asked.columns)), ["group", "block", "part"], shingles, percent)
    return components(links.unionByName(more), contracted=True).select(F.col("node").alias("class"), "component")


def _smallest(rows: DataFrame, by_hash) -> DataFrame:
    """The PIVOTS rows of each group with the smallest hashes; tasks pass on so many per group at most."""
    nth = F.row_number().over(Window.partitionBy("group").orderBy(by_hash))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= PIVOTS).drop("_nth")


def near_duplicates(df: DataFrame, id: str, text: str, width: int = 5, percent: int = 80) -> DataFrame:
    """Columns id, n (shingles in the set), component (the smallest id reachable over links, itself included).

    Two texts are linked if their sets of word shingles have at least ``percent`` in 100 of their union in common. Texts
    of equal sets form a class, found by a fingerprint of the whole set and known by its smallest id; sketches, buckets
    and comparisons are of classes, so thousands of copies cost one. Ids are long, distinct and not null (of rows with
    one id, one decides; rows of null ids are linked with nothing). Null texts and texts without words have the empty
    set and are linked with nothing. An empty table gives no rows; other columns aren't read."""
    how, bands = lambda: WordShingles(width), bands_for(percent)
    rows = written(sketched(df, id, text, how, bands))
    classes = written(rows.where("n > 0 and id is not null").groupBy("fingerprint")
                      .agg(F.min("id").alias("class"), F.max("n").alias("n"), F.max("registers").alias("registers")))
    texts = df.select(F.col(id).cast("long").alias("class"), F.col(text).alias("text"))
    groups = written(coarse(classes, buckets(bands)).join(classes.drop("fingerprint"), "class"))
    found = written(connect(groups, lambda rows: rows.join(texts, "class"), how, percent))
    named = (classes.select("fingerprint", "class").join(found, "class", "left")
             .select("fingerprint", F.coalesce("component", "class").alias("component")))
    return (rows.join(named, "fingerprint", "left")
            .select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id")).alias("component")))


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without those whose component has a smaller id; rows of null ids stay."""
    gone = near_duplicates(df, id, text, width, percent).where("component <> id").select(F.col("id").alias("_gone"))
    return df.join(gone, F.col(id) == F.col("_gone"), "left_anti")
