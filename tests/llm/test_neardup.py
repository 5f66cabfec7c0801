"""Near duplicates against all pairs compared one by one."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidewright.llm import graph, lines, neardup
from tidewright.llm.graph import components
from tidewright.llm.store import table

SF = "/root/testdata/sf0.01"


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    pairs = {(a, b) for own in by.values() for x, a in enumerate(own) for b in own[x + 1:]}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if shared * 100 >= percent * (len(sets[a]) + len(sets[b]) - shared):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return sorted((i, len(sets[i]), root(i)) for i in sets)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert result(neardup.near_duplicates(docs, "doc_id", "text", 3, 85)) == brute(rows, 3, 85)


def chain(n, seed=1):
    """Texts that each differ from the one before in a word, and copies."""
    r = random.Random(seed)
    words = [f"w{r.randrange(10**6)}" for _ in range(60)]
    out = []
    for i in range(n):
        words[r.randrange(60)] = f"x{i}"
        out.append((i, " ".join(words)))
        if i % 5 == 0:
            out.append((n + i, " ".join(words).upper()))
    return out


@pytest.mark.parametrize("members", [2048, 16])
def test_chain_in_blocks(spark, monkeypatch, members):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rows = chain(80) + chain(40, 2)[:1] + [(1000 + i, f"other text number {i} of its own kind entirely {i * 7}") for i in range(20)]
    rows = [(i, t) for i, t in dict(rows).items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(neardup.near_duplicates(df, "doc_id", "text", 3, 85)) == brute(rows, 3, 85)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three four"), (7, "é " * 30_000), (8, "é " * 29_999), (9, "a" * 200_000)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, component string, n int")
    assert result(neardup.near_duplicates(df, "doc_id", "text", 3, 85)) == brute(rows, 3, 85)
    assert result(neardup.near_duplicates(df.limit(0), "doc_id", "text")) == []
    kept = neardup.keep_one(df, "doc_id", "text", 3, 85)
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 9}


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    up = {x: x for p in links for x in p if p[0] != p[1]}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert result(got) == sorted((i, root(i)) for i in up)
    assert result(components(spark.createDataFrame([], "a long, b long"))) == []


def test_components_in_rounds_and_in_one_task_agree(spark, monkeypatch):
    r = random.Random(8)
    links = spark.createDataFrame([(r.randrange(900), r.randrange(900)) for _ in range(500)] + [(1000, i) for i in range(1001, 1100)], "a long, b long").repartition(6)
    at_once = result(components(links))
    monkeypatch.setattr(graph, "EDGES", 0)
    assert result(components(links)) == at_once and len(at_once) > 100


def python_operators(plan):
    """Of all stages the most operators whose Python workers run beside each other in a task."""
    most = 0

    def within(node):
        nonlocal most
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            return within(node.initialPlan())
        children = node.children()
        below = sum(within(children.apply(i)) for i in range(children.size()))
        if "Exchange" in node.nodeName():
            return 0
        most = max(most, n := below + (node.nodeName() in ("MapInArrow", "ArrowEvalPython")))
        return n

    within(plan._jdf.queryExecution().executedPlan())
    return most


@pytest.mark.parametrize("members", [2048, 16])
def test_a_task_has_one_python_worker(spark, monkeypatch, members):
    """Every stage of the pipeline's comparisons, as they are planned: workers of a task add up in an executor's memory."""
    monkeypatch.setattr(neardup, "MEMBERS", members)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    plans, write = [], neardup.written

    def written(df):
        plans.append(python_operators(df))
        return write(df)

    for module in (graph, lines, neardup):
        monkeypatch.setattr(module, "written", written)
    rows = [(i, t, "en", "web", len(t)) for i, t in dict(chain(60)).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup):
        plans.append(python_operators(stage(spark, docs, None)))
    assert len(plans) > 12 and max(plans) == 1


@pytest.mark.parametrize("families", [1, 4])
def test_many_members_as_all_pairs(families):
    """Groups above MANY members: sets that stand for several, usual ones multiplied out, others from the index."""
    rng = np.random.default_rng(families)
    sets = []
    for f in range(families):
        base = rng.integers(0, 1 << 60, 60, dtype=np.uint64)
        for _ in range(240 // families):
            s = base[rng.random(60) > rng.choice([0, 0.05, 0.1, 0.15])]
            sets.append(np.unique(np.concatenate([s, rng.integers(0, 1 << 60, int(rng.integers(0, 8)), dtype=np.uint64)])))
    whole = [frozenset(s.tolist()) for s in sets]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if len(whole[i] & whole[j]) * 100 >= 80 * len(whole[i] | whole[j])}

    def parts(links):
        up = neardup._Forest(len(sets))
        for i, j in links:
            up.join(i, j)
        return [up.root(i) for i in range(len(sets))]

    first = neardup.linked_within(sets[:120], None, 80)
    assert all((max(x), min(x)) in near for x in first)
    assert parts(first) == parts([p for p in near if max(p) < 120])
    known = parts(first)
    asked = np.arange(120, len(sets))
    assert parts([*first, *neardup.linked_within(sets, None, 80, known, asked)]) == parts(near)
