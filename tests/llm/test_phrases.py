"""Collocations and their count automata against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidewright.llm import phrases
from tidewright.llm.phrases import Counts, Shard


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for p in re.split(r"[.,;:!?\x0A-\x0D]", low) if (w := re.findall(r"[^\x20\x09]+", p))]


def counted(texts):
    out = defaultdict(Counter)
    for lang, t in texts:
        for w in pieces(t):
            for d in range(1, 6):
                out["und" if lang is None else lang].update(" ".join(w[i:i + d]) for i in range(len(w) - d + 1))
    return out


def by_hand(texts, least, top):
    rows = []
    for lang, f in counted(texts).items():
        n = sum(v for k, v in f.items() if " " not in k)
        cand = {k: v for k, v in f.items() if " " in k and v >= least}
        kept = []
        for p, a in cand.items():
            if any(f" {p} " in f" {q} " and b >= a for q, b in cand.items() if q != p):
                continue
            w = p.split(" ")
            s, k = min((1000 * a * n // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            kept.append((-s, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        rows += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(rows)


def texts(r, n=300):
    vocab = ["New", "york", "the", "of", "état", "ÉTAT", "a.b", "x,y", " z", "\U0001F600"]
    out = [(r.choice(["en", "en", "en", "de", None]), "".join(r.choice(vocab) + r.choice([" ", " ", " ", "\t", ", ", ".\n", "\r", "\x0b"]) for _ in range(r.randrange(0, 40)))) for _ in range(n)]
    return out + [("en", None), ("en", ""), ("de", " ,, "), ("fr", "lone"), ("en", "buffalo " * 2000), ("en", "in front of the house " * 30 + "z")]


def run(spark, rows, least, top, **how):
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "lang string, text string, n long, phrase int").repartition(4)
    return sorted(tuple(x) for x in phrases.collocations(df, "lang", "text", least, top, **how).collect())


def test_like_plain_counting(spark):
    rows = texts(random.Random(1))
    got = run(spark, rows, 8, 20)
    assert got == by_hand(rows, 8, 20) and len({x[0] for x in got}) >= 3 and max(x[1] for x in got) == 20


def test_many_shards_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 700)
    rows = texts(random.Random(2))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = {(x["lang"], x["phrase"]): x["n"] for x in phrases.phrase_counts(df, "lang", "text", 5, shard=700, span=60).collect()}
    want = {(lang, p): n for lang, f in counted(rows).items() for p, n in f.items() if n >= 5}
    want |= {(lang, ""): sum(v for k, v in f.items() if " " not in k) for lang, f in counted(rows).items()}
    assert got == want


def test_automata_merge_and_pack():
    r, shards, all_rows = random.Random(3), [], []
    for _ in range(6):
        s = Shard()
        for _ in range(30):
            t = " ".join(r.choice(["a", "b", "c", "ü", "dd,"]) for _ in range(r.randrange(0, 30)))
            s.add(t)
            all_rows.append(("x", t))
        shards.append(s.counts())
    for c in shards:
        again = Counts.unpacked(*c.packed())
        assert [again.path(i) for i in range(len(again.rows))] == [c.path(i) for i in range(len(c.rows))] and (again.weights == c.weights).all()
    whole = Counts.union(shards)
    paths = [whole.path(i) for i in range(len(whole.rows))]
    assert paths == sorted(paths) and len(set(paths)) == len(paths)
    got = {b" ".join(whole.path(i, d)).decode(): w for d, first, weight in whole.states() for i, w in zip(first, weight)}
    assert got == dict(counted(all_rows)["x"])
    limits = [paths[3], paths[10], (b"\xff",)]
    parts = dict(whole.split(limits))
    assert sum(len(p.rows) for p in parts.values()) == len(paths) and parts[1].path(0) == paths[3] and 3 not in parts
    assert np.array_equal(Counts.union(list(parts.values())).rows, whole.rows)


def test_products_beyond_64_bits(spark, monkeypatch):
    n = 4 * 10**14
    counts = spark.createDataFrame([("en", 0, "", n), ("en", 1, "a", n // 2), ("en", 1, "b", n // 4), ("en", 2, "a b", n // 4 - 1)], "lang string, d int, phrase string, n long")
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: counts)
    (row,) = phrases.collocations(counts, "lang", "phrase").collect()
    assert row["score"] == 1000 * (n // 4 - 1) * n // (n // 2 * (n // 4))


def test_nothing(spark):
    df = spark.createDataFrame([("en", None), ("en", "")], "lang string, text string")
    assert phrases.collocations(df, "lang", "text").collect() == [] and phrases.collocations(df.where("false"), "lang", "text").collect() == []
