"""Repeated lines against all pairs compared one by one."""

import random

import numpy as np
import pyarrow as pa
import xxhash

from tidewright.llm import lines, neardup
from tidewright.llm.store import table

SF = "/root/testdata/sf0.001"


def grams(x):
    return frozenset(x[i:i + 8] for i in range(max(1, len(x) - 7)))


def brute(rows, percent=80):
    """rows: (id, text) of distinct ids."""
    seen = {}
    for i, t in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, x in enumerate(t.split("\n")):
            if x.strip(" \t\n\r\x0b\x0c"):
                seen.setdefault(x, []).append((i, k))
    own = list(seen)
    sets, up, by = [grams(x) for x in own], list(range(len(own))), {}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for a, b in {(a, b) for v in by.values() for x, a in enumerate(v) for b in v[x + 1:]}:
        n = len(sets[a] & sets[b])
        if n * 100 >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    key = lambda p: (p[0] is not None, p[0] or 0, p[1])
    stays = {}
    for i, x in enumerate(own):
        stays[root(i)] = min([*seen[x], *([stays[root(i)]] if root(i) in stays else [])], key=key)
    gone = {p for i, x in enumerate(own) for p in seen[x] if p != stays[root(i)]}
    return {i: (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows}


def result(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_whole_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = lines.drop_repeated(docs, "doc_id", "text")
    assert result(got) == brute(rows)
    for r in got.join(docs.withColumnRenamed("text", "old"), "doc_id").collect():
        left = r["text"].count("\n") + 1 if r["text"] or r["n_removed"] < r["n_lines"] else 0
        assert (r["n_lines"], r["n_lines"] - r["n_removed"]) == (r["old"].count("\n") + 1, left)


def test_odd_rows(spark):
    r = random.Random(4)
    base = " ".join(f"word{r.randrange(9999)}" for _ in range(30))
    rows = [(5, base + "\n\nshort\n" + base), (2, None), (3, ""), (None, "short\nown line of a row without id"), (7, base.replace("word", "Word", 1) + "\nab\nab"),
            (8, "ab\nabc"), (9, "x" * 300_000 + "\n" + "x" * 300_000), (10, "é" * 50 + "\n" + "é" * 51), (11, " \n\t\n")]
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, n_lines int, hash string")
    got = lines.drop_repeated(df, "doc_id", "text")
    assert got.columns == ["doc_id", "text", "hash", "n_lines", "n_removed"]
    assert result(got) == brute(rows)
    assert lines.drop_repeated(df.limit(0), "doc_id", "text").count() == 0
    twice = lines.drop_repeated(df.where("doc_id = 5").union(df.where("doc_id = 5")), "doc_id", "text").collect()
    assert [x["text"] for x in twice] == [base + "\n\nshort"] * 2


def test_pairs_at_the_threshold_share_a_band():
    """Thousands of pairs of similarity just above 0.8: none may go without a common band."""
    r = random.Random(9)
    missed = n = 0
    for _ in range(20):
        pairs = []
        for _ in range(500):
            x = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
            pairs += [x, x[:179]]  # 172 of 193 shingles
            y = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200))
            pairs += [y, y[:162]]  # 155 of 193 shingles
        s = lines._sketches(pairs).reshape(len(pairs), lines.BANDS, -1)
        same = (s[::2] == s[1::2]).all(axis=2).any(axis=1)
        missed, n = missed + int((~same).sum()), n + len(same)
    assert n == 20_000 and missed <= 3


def batch(*texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([7] * len(texts), pa.int64()), pa.array(texts)], ["id", "hash", "text"])


def test_bands_are_sent_once_and_packed():
    """A line costs nine bytes a band, its copies nothing; ties are those of all pairs of lines with a common band."""
    r = random.Random(3)
    own = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(20, 300))) + "z" for _ in range(300)]
    own += [x[:-3] + "y" for x in own[:150]] + [own[0] + "!" * k for k in range(5)] + ["short", "tiny"]
    packets = list(lines._banded(3)(iter([batch("\n".join(own), *own[:200]), batch(*own)])))
    assert sum(len(e) for b in packets for e in b.column("entries").to_pylist()) <= 10 * lines.BANDS * len(own)
    rows = sorted(r for b in packets for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    cut = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), (pa.int32(), pa.binary()), strict=True)], ["part", "entries"])
           for part in (rows[:7], rows[7:])]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for b in lines._ties(iter(cut)):
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up[root(x)] = root(y)
    names = [lines._name(xxhash.xxh3_128_digest(x.encode())) for x in own]
    got = {x for x in names if sum(root(x) == root(y) for y in names) > 1}
    s = lines._sketches(own)
    alike = {(i, j) for i in range(len(own)) for j in range(i) if (s[i] == s[j]).any()}
    assert got == {names[i] for p in alike for i in p} and len(got) >= 290
    assert all(root(names[i]) == root(names[j]) for i, j in alike)


def test_places_of_equal_lines(monkeypatch):
    """Only the first place of a line in a chunk keeps its fingerprint, and isn't told again where its row repeats."""
    ids = [5, 3, None, None, 9]
    b = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([1, 2, 3, 3, 4], pa.int64()), pa.array(["x\ny", "x", "x", "x", "x\nx"])], ["id", "hash", "text"])
    rows = [r for out in lines._places(iter([b])) for r in out.to_pylist()]
    assert [(r["id"], r["line"], r["fingerprint"] is not None) for r in rows] == [(5, 0, False), (5, 1, True), (3, 0, False), (None, 0, True), (9, 0, False), (9, 1, False)]
    assert len({r["name"] for r in rows}) == 2
    monkeypatch.setattr(lines, "CHUNK", 0)
    assert all(r["fingerprint"] for out in lines._places(iter([b])) for r in out.to_pylist())


def test_short_and_long_lines_keep_their_sketch():
    """A sketch depends on the line alone, whatever else is sketched with it."""
    own = ["a", "ab\tc", "x" * 7, "x" * 8, "abcdefghi" * 9000, "é" * 41, "q"]
    together = lines._sketches(own)
    assert all((lines._sketches([x])[0] == together[i]).all() for i, x in enumerate(own))
    assert all((a == lines.shingles(x)).all() for a, x in zip(lines.LineShingles().sets(own), own, strict=True))
    values = {x: np.unique(lines._values(np.frombuffer(x.encode("utf-32-le"), np.uint32))[:len(x) - 7]) for x in own if len(x) > 7}
    for x, v in values.items():
        band = np.zeros(1, np.uint64)
        for f in lines._FACTORS[:lines.ROWS]:
            band = lines.mixed(band * np.uint64(lines._PRIME) + (v * f).min())
        assert band[0] == together[own.index(x)][0]


def test_weak_ties_do_not_make_wide_groups(spark, monkeypatch):
    """Lines that have a quarter in common hang together by bands of four values; they were all compared with all."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    common = letters(100)
    own = [common + letters(150) for _ in range(200)]
    near = [x[:-1] + "#" for x in own[:60]]
    rows = [(i, x) for i, x in enumerate(own + near)]
    rng.shuffle(rows)
    compared, link = [], neardup._link

    def counted(rows, *rest):
        compared.append(rows.count())
        return link(rows, *rest)

    monkeypatch.setattr(neardup, "MEMBERS", 16)
    monkeypatch.setattr(neardup, "_link", counted)
    got = lines.drop_repeated(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert result(got) == brute(rows)
    assert sum(compared) < 4 * len(rows)


def test_finer_bands_are_those_of_equal_sets(spark):
    texts = ["one line of some length, and more", "x", "abcdefgh" * 9, "abcdefgh" * 12, "another line of some length, and more"] + ["y" * 200_000] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "class long, text string").coalesce(1)
    bands = {r["class"]: r["bands"] for r in lines._finer(df).collect()}
    assert len(bands) == len(texts) and {len(b) for b in bands.values()} == {80}
    assert bands[2] == bands[3] and bands[5] == bands[6]
    assert len(set(bands[0]) & set(bands[4])) < 80 and not set(bands[0]) & set(bands[1])
