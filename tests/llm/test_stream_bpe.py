"""Streaming merges against the tokenizers library, and how far ahead they look."""

import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from tidewright.llm import stream_bpe
from tidewright.llm.queries import QUERIES
from tidewright.llm.stream_bpe import Merges, Transducer, WordBpe

WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "<|endoftext|>a<|startoftext|>", "a<|endoftext|><|endoftext|", "<|endof text|>", "'street 's 'S don't we'LL", "áb́ ̀́ ̀",
       "ÉCOLE Σίσυφος ΣΑΣ İ ı ſ ǅ", "\x1c\x1d a\x85b   x​z", "日本語テスト12345 각각", "👩‍👩‍👧 !!'s'll", "ª²½×÷µ", "a" * 5000, "ab" * 3000 + "c",
       "!" * 3000 + "?" * 2000, "é" * 4000 + "é" * 1000, "x\n\n\ty" * 50]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_like_the_library(name):
    path = public_tokenizers.path(name)
    own, lib, r = WordBpe(path), tokenizers.Tokenizer.from_file(path), random.Random(5)
    alpha = "abAB' 1²½é́̀ͅßΣσİ<|>.!\n\x0b\x1c 　字\U0001F600가"
    texts = ODD + ["".join(r.choice(alpha) for _ in range(r.randrange(1, 40))) for _ in range(3000)]
    texts += ["".join(r.choice("theingand") for _ in range(20000)), "".join(r.choice("éèaüß") for _ in range(9000))]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        assert own.encode(t) == packed, t[:60]
        assert "".join(own.texts(packed)) == lib.decode(ids, skip_special_tokens=False)


def random_merges(r, letters="abc", n=40):
    """A list as training gives it: both parts of a merge are letters or made before."""
    tokens, out = list(letters), []
    while len(out) < n:
        a, b = r.choice(tokens), r.choice(tokens)
        if a + b not in tokens and len(a + b) <= 8:
            out.append((a, b))
            tokens.append(a + b)
    return out


def slow(merges, symbols):
    s = list(symbols)
    for a, b in merges:
        out, i = [], 0
        while i < len(s):
            if s[i:i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out
    return s


def test_lookahead_suffices_and_memory_stays():
    r = random.Random(7)
    for _ in range(60):
        merges = random_merges(r)
        m = Merges(merges)
        t = Transducer(m)
        t.full = 2 * (m.lookahead + 1)  # as little as it can do with
        text = "".join(r.choice("abc") for _ in range(1500))
        out, most, at = [], 0, 0
        while at < len(text):
            step = r.randrange(1, 60)
            out += list(t.feed(text[at:at + step]))
            most, at = max(most, len(t.held)), at + step
        out += t.finish()
        assert out == slow(merges, text)
        assert most <= t.full
        # any longer text keeps the tokens that end a lookahead before the end
        start, longer, end = m.apply(list(text[:300])), m.apply(list(text[:300] + text[700:900])), 0
        for x, y in zip(start, longer):
            end += len(x)
            assert end > 300 - m.lookahead or x == y


def test_small_lookaheads():
    assert Merges([("a", "b")]).lookahead == 1
    assert Merges([("b", "c"), ("a", "b")]).lookahead == 2  # c takes b from a
    assert Merges([("ab", "c"), ("a", "b")]).lookahead is None  # used before it is made: settled at the end only
    t = Transducer(Merges([("ab", "c"), ("a", "b")]))
    assert list(t.feed("abab")) == []
    assert len(t.finish()) <= 4


def test_long_words_are_not_held():
    own = WordBpe(WORD)
    t, most, n = own.machine, 0, 0
    for _ in range(400):
        for _ in t.feed("thinkingandbeing" * 10):
            n += 1
        most = max(most, len(t.held))
    n += len(t.finish())
    assert most <= 4 * (own.merges.lookahead + 1) and n > 1000


def test_memory_forgets_but_answers_alike():
    m = stream_bpe.Memory(lambda k: k.encode(), 5)
    assert all(m[str(i % 13)] == str(i % 13).encode() for i in range(200)) and len(m) <= 5


def test_nulls_empties_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the cat"), (3, "the cat")], "ids long, text string")
    got = df.select("ids", stream_bpe.encode(F.col("text"), WORD).alias("x")).select("ids", "x", stream_bpe.decode(F.col("x"), WORD).alias("t")).collect()
    assert [(r["ids"], len(r["x"]), r["t"]) for r in sorted(got, key=lambda r: r["ids"])] == [(1, 0, ""), (2, 0, ""), (3, 8, "the</w> cat</w>"), (3, 8, "the</w> cat</w>")]
    empty = df.where("false").select(stream_bpe.encode(F.col("text"), WORD).alias("x"))
    assert empty.count() == 0


def test_query_on_documents(spark):
    import hashlib

    sf_dir = "/root/testdata/sf0.001"
    lib = tokenizers.Tokenizer.from_file(WORD)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op11_stream_bpe_round_trip"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
