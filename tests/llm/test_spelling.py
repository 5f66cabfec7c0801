"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidewright.llm import spelling


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def by_hand(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if distance_one(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        out[w] = (n, len(near), best if best is not None and counts[best] >= 2 * n else None)
    rows = {}
    for w, (n, k, form) in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        rows[w] = (n, k, form, None if form is None else counts[form], root)
    return rows


def compare(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in spelling.variants(df).collect()}
    assert got == by_hand(counts)
    return got


def words(r, n):
    base = ["".join(r.choice("abcdeéxyz") for _ in range(r.randrange(5, 9))) for _ in range(n // 8)]
    out = set(base)
    while len(out) < n:
        w = list(r.choice(sorted(out)))
        i = r.randrange(len(w))
        w[i:i + 1] = r.choice([[], [r.choice("abÀß")], [w[i], r.choice("cdÿ")]])
        if len(w) >= 5:
            out.add("".join(w))
    return sorted(out)


def test_all_pairs(spark):
    r = random.Random(3)
    got = compare(spark, {w: r.choice([3, 4, 7, 20, 55, 400]) for w in words(r, 900)})
    assert sum(x[2] is not None for x in got.values()) > 100 and any(got[x[4]][2] is None and x[4] != x[2] and x[2] for x in got.values())


def test_large_blocks_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 8)
    r = random.Random(4)
    compare(spark, {"".join(r.sample("abcdefgh", 8)[:6]): r.randrange(3, 90) for _ in range(500)} | {w: 5 for w in words(r, 300)})


def test_chains_ties_and_long_words(spark):
    long = "ab" * 4000
    got = compare(spark, {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "zzzzz": 3, "zzzzy": 6, "zzzzx": 6, "kkkkk": 9, long: 3, long + "c": 6, "d" + long: 6})
    assert got["aaaaa"][4] == "abbbb" and got["zzzzz"][2] == "zzzzx" and got[long][2] == long + "c"


def test_occurrences(spark):
    r = random.Random(5)
    texts = [(i, " ".join(r.choice(["Straße", "häuser-BAUM", "l'école", "tokens1tokens", "abc", "ÄRGER", "ærø×ærø", "x" * 300]) for _ in range(40))) for i in range(60)]
    texts += [(60, None), (61, ""), (None, "Straße Straße")]
    want = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                want[run] += 1
    df = spark.createDataFrame(texts, "run long, text string").withColumn("word", F.lit(1))  # names that the operator uses itself
    got = {x["word"]: x["n"] for x in spelling.occurrences(df, "run", "text").collect()}
    assert got == want and any(len(w) == 299 for w in want)


def test_no_words(spark):
    df = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    assert spelling.spelling_variants(df, "doc_id", "text").collect() == []
    assert spelling.spelling_variants(df.where("false"), "doc_id", "text").collect() == []
    df = spark.createDataFrame([(1, "hello hello hello")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.spelling_variants(df, "doc_id", "text").collect()] == [("hello", 3, 0, None, None, "hello")]
