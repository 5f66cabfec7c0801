"""Quality measures against plain Python, verdicts by their rule; the pipeline against its stages done by hand."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from tidewright.llm import quality
from tidewright.llm.store import table

from .test_lines import brute as lines_by_hand
from .test_neardup import brute as near_by_hand

SF = "/root/testdata/sf0.001"


def measures(text):
    w = (text or "").encode().split()
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    full = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), len(b"".join(w).decode()), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered)


def test_measures(spark):
    r = random.Random(2)
    own = [t[0] for t in table(spark, SF, "documents").select("text").collect()]
    own += [None, "", " \n ", "a", "a " * 8, "a " * 9, "b c " * 40, "é" * 100_000, "x y z " * 20_000, "one\ntwo\none\n\n\none", "a b"]
    own += [" ".join(r.choice("ab") for _ in range(r.randint(5, 40))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(own)], "doc_id int, text string, lang string, n_words int")
    for g in quality.measure(df, "text").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect():
        assert tuple(g)[1:] == measures(own[g["doc_id"]]), repr((own[g["doc_id"]] or "")[:80])


def test_limits_follow_the_data(spark):
    """Documents of a source whose words are long are fine there and out of place elsewhere."""
    r = random.Random(3)
    text = lambda k, n=60: " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(k - 1, k + 1))) for _ in range(n))
    rows = [(i, text(5), "en", "news") for i in range(150)] + [(200 + i, text(14), "en", "names") for i in range(150)]
    rows += [(500, text(14), "en", "news"), (501, text(5), "en", "names"), (502, text(5), "en", "tiny"), (503, text(5).replace(" ", "### "), "en", "news"),
             (504, None, None, None), (505, text(5), None, None)]
    df = spark.createDataFrame([(*x, True) for x in rows], "doc_id int, text string, lang string, source string, kept boolean")
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    assert {x["doc_id"] for x in kept.collect()} == {x[0] for x in rows} - {500, 501, 503, 504}
    assert quality.keep_good(df.limit(0)).count() == 0


def test_each_rule_has_limits_of_its_group(spark):
    """Two sources that differ in every measure get different limits for every rule, and a document that is usual in one is
    out by each rule in the other; a group of one document goes by its language."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(5))

    def odd():
        w = [word() for _ in range(40)]
        phrase = [word().upper() + word() + "#" for _ in range(9)]
        return "\n".join([" ".join(w + phrase + [word() * 3] + phrase), "ABCDEFGHI# " * 20, "ABCDEFGHI# " * 20])

    rows = [(i, " ".join(word() for _ in range(60)), "en", "plain") for i in range(200)] + [(300 + i, odd(), "en", "odd") for i in range(200)]
    rows += [(600, odd(), "en", "plain"), (601, odd(), "en", "single")]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    measured = quality.measure(df, "text")
    limits = {x["source"]: x["limits"] for x in quality.learn(measured, "lang", "source").collect()}
    for rule in quality.RULES:
        assert limits["plain"][rule]["upper"] < limits["odd"][rule]["upper"], rule
    out = {x["doc_id"]: x for x in quality.judge(measured, quality.learn(measured, "lang", "source"), "lang", "source").collect()}
    assert set(out[600]["broken"]) >= {"symbols", "repeats", "lines", "capitals", "per_distinct"}
    assert sum(bool(out[i]["broken"]) for i in range(200)) <= 12 and sum(bool(out[300 + i]["broken"]) for i in range(200)) <= 12
    assert all(abs(limits["single"][x]["upper"] - limits["odd"][x]["upper"]) < 60 for x in quality.RULES)


def test_bins_are_a_sketch():
    values = np.random.default_rng(1).lognormal(0, 2, 10_000)
    bins = np.ceil(np.log(values) / np.log(quality.GAMMA))
    for q in (0.25, 0.5, 0.75, 0.99):
        assert abs(quality.GAMMA ** np.quantile(bins, q, method="inverted_cdf") / np.quantile(values, q, method="inverted_cdf") - 1) <= quality.GAMMA - 1


def test_stages_by_hand(spark):
    docs = table(spark, SF, "documents").select(corpus_pipeline.COLUMNS)
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    given, kept = rows(docs), rows(corpus_pipeline.quality_rules(spark, docs, SF))
    assert all(given[i] == t for i, t in kept.items()) and not any(measures(given[i])[0] < 20 for i in kept)
    cleaned = corpus_pipeline.line_dedup(spark, docs, SF)
    whole = lines_by_hand(list(given.items()))
    assert rows(cleaned) == {i: t for i, t in whole.items() if t == given[i] or t.encode().split()}
    left = rows(corpus_pipeline.near_dedup(spark, docs, SF))
    assert set(left) == {i for i, _, c in near_by_hand(list(given.items()), 5, 80) if i == c}
    mixed = corpus_pipeline.mixed(spark, docs, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS
    taken, size = Counter(), Counter()
    for r in mixed.collect():
        assert given[r["doc_id"]].split()[:len(r["text"].split())] == r["text"].split()
        taken[r["source"]] += len(r["text"].split())
    for r in docs.collect():
        size[r["source"]] += len(r["text"].split())
    from .test_mix import fill

    assert dict(taken) == {s: int(t) for s, t in fill(size).items() if int(t)}
    coded = {r["doc_id"]: r for r in corpus_pipeline.encoded(spark, docs, SF).collect()}
    assert all(coded[i]["text"] == t and len(coded[i]["ids"]) == 4 * coded[i]["n_tokens"] for i, t in given.items())


def test_near_copies_that_share_most_lines_go(spark):
    """Near copies lose their common lines before whole documents are compared; none of them is left as an empty rest."""
    r = random.Random(8)
    line = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(16))
    own = [[line() for _ in range(6)] for _ in range(12)]
    rows, copies = [(i, "\n".join(x)) for i, x in enumerate(own)], set()
    for i, x in enumerate(own[:6]):
        y = [t.replace(" ", "  ", 1) if k % 2 else t for k, t in enumerate(x)]
        y[3] = y[3][:-1] + "z"
        rows.append((100 + i, "\n".join(y)))
        copies.add(100 + i)
    rows += [(200, None), (201, ""), (202, "\n \n")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.line_dedup(spark, docs, SF)
    assert {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, left, SF).collect()} == {i for i, _ in rows} - copies


def test_stages_with_odd_tables(spark):
    """Null and empty texts, repeated rows, no rows at all, and columns that stages use themselves."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_removed int, component string, ids string, size int"
    good = " ".join(f"word{i} stands here" for i in range(30))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, good, "en", "a", 9), (3, good, "en", "a", 9), (None, good + " more", None, "b", 1), (5, " \n\n ", "en", "a", 3)]
    df = spark.createDataFrame([(*x, True, 1, "c", "i", 2) for x in rows], kinds)
    for docs in (df, df.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n <= 8 and (n > 0 or docs is not df), name
            assert name == "encoding" or out.columns == corpus_pipeline.COLUMNS


def test_run_is_its_stages(spark):
    docs = table(spark, SF, "documents").select(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda df: sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "text")) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(docs)
