"""Token counts and byte-level BPE against the libraries, on whole texts and odd ones."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tidewright.llm import bpe, token_counts
from tidewright.llm.store import table

RANKS, PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a" * 3000, " " * 3000, "x" + " " * 700 + "y", "\n" * 2000 + "z", "don't  we'll 'sabc ", "é¿漢字🙂🙂 ①  x", "1234 56  7\t8\r\n",
       "word " * 40_000, "<s> </s> <|endoftext|>", " " * 600 + "q", "\x1c\x1d a\x85b"]


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(spark):
    return [r[0] for r in table(spark, "/root/testdata/sf0.001", "documents").select("text").collect()] + ODD


def test_encode_and_decode(spark, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "PART", 64)
    own = texts(spark)
    df = spark.createDataFrame(list(enumerate(own)), "n int, text string")
    how = RANKS, public_tokenizers.PATTERN
    coded = df.select("n", bpe.encode(F.col("text"), *how).alias("ids")).withColumn("raw", bpe.decode(F.col("ids"), *how)).withColumn("k", bpe.token_count(F.col("ids")))
    split = regex.compile(public_tokenizers.PATTERN)
    for r in coded.collect():
        text = own[r["n"]] or ""
        want = [i for m in split.finditer(text) for i in encoding._encode_single_piece(m[0])]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want and r["k"] == len(want), repr(text[:50])
        assert bytes(r["raw"]) == text.encode()
        if len(text) < 600:
            assert want == encoding.encode_ordinary(text)


def test_parts_anywhere(encoding):
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["a", "B", "7", " ", "  ", "\n", "'s", "é", "-", "\t", " the", " " * 520]) for _ in range(40))
        split = regex.compile(public_tokenizers.PATTERN)
        want = [i for m in split.finditer(text) for i in encoding._encode_single_piece(m[0])]
        assert np.frombuffer(bpe._pack(encoding, text, 5), "<u4").tolist() == want


def library():
    """The scored pieces as a unigram model of a library that adds scores in double precision."""
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = [("<unk>", 0.0)] + [(m.id_to_piece(i), 0.0 if m.is_byte(i) else m.get_score(i)) for i in range(3, m.get_piece_size())]
    return Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))


def test_unigram_counts(spark):
    own, model = [t for t in texts(spark)], library()
    df = spark.createDataFrame(list(enumerate(own)), "n int, text string")
    for r in df.select("n", token_counts.count_tokens(F.col("text"), PIECES).alias("k")).collect():
        text = own[r["n"]]
        want = len(model.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
        assert r["k"] == want, repr((text or "")[:50])


def test_ties_and_other_vocabularies():
    """Equal scores: the longest piece wins; pieces over space marks turn counting by word off."""
    r = random.Random(6)
    for _ in range(200):
        pieces = {"".join(r.choice("ab▁") for _ in range(r.randint(1, 4))): float(-r.randint(0, 3)) for _ in range(12)} | {"b": -3.0}
        own, lib = token_counts.UnigramCounter(pieces, False), Tokenizer(models.Unigram([("<unk>", min(pieces.values())), *pieces.items()], unk_id=0, byte_fallback=False))
        text = "".join(r.choice("ab b") for _ in range(30))
        ids = lib.encode("▁" + text.replace(" ", "▁")).ids
        # the library joins neighbouring unknown characters into one token, we count each
        got = own.count(text)
        assert got >= len(ids) and (got == len(ids) or 0 in ids)
