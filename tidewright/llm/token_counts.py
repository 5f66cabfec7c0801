"""How many tokens a unigram tokenizer makes of a text, without making them."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = "▁"
#: What an unknown character costs beyond the worst score (fixed value of unigram tokenizers).
_UNKNOWN_COST = 10.0
_MEMO = 1 << 18


class UnigramCounter:
    """Best segmentation by score, counted only.

    An Aho-Corasick automaton names every vocabulary piece ending at each character. Best score and piece count are
    carried from left to right. Rules of ties: a later candidate must be strictly better, and candidates come by
    earlier start, so the longest piece wins; a character without a piece of its own may stand alone at the worst
    score less 10, and counts its bytes (byte fallback) or one. Where no piece goes on into a space mark or holds a
    newline, a text is counted by word, with a bounded memory of words already counted; the sum is the same.
    """

    def __init__(self, pieces: dict[str, float], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - _UNKNOWN_COST
        self.byte_fallback = byte_fallback
        by_word = not any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        by_line = not any("\n" in p for p in pieces)
        pattern = {(True, True): f"{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+|\n", (True, False): f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+",
                   (False, True): "[^\n]+|\n", (False, False): "(?s).+"}[by_word, by_line]
        self.parts = re.compile(pattern).findall
        self.memo: dict[str, int] = {}

    def best(self, s: str) -> int:
        n = len(s)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        found, last = None, -1
        matches = self.automaton.iter(s)
        found = next(matches, None)
        for end in range(1, n + 1):
            top, pieces = None, 0
            while found is not None and found[0] == end - 1:  # longest first
                length, value = found[1]
                if (x := score[end - length] + value) > top if top is not None else True:
                    top, pieces = score[end - length] + value, count[end - length] + 1
                found = next(matches, None)
            if s[end - 1] not in self.single and (top is None or score[end - 1] + self.unknown > top):
                top = score[end - 1] + self.unknown
                pieces = count[end - 1] + (len(s[end - 1].encode()) if self.byte_fallback else 1)
            score[end], count[end] = top, pieces
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a text: a space mark stands before it and for each space in it. An empty text has none."""
        if not text:
            return 0
        memo, total = self.memo, 0
        for part in self.parts(_SPACE + text.replace(" ", _SPACE)):
            if (n := memo.get(part)) is None:
                n = self.best(part)
                if len(part) <= 64:
                    if len(memo) >= _MEMO:
                        memo.clear()
                    memo[part] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    """Scored pieces of a model file; control, unknown and byte pieces aren't matched in texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    own = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return UnigramCounter({model.id_to_piece(i): model.get_score(i) for i in own}, any(map(model.is_byte, ids)))


def count_tokens(text: Column, path: str) -> Column:
    """Tokens of each whole text under the unigram model of a file's scored pieces (at the same place on every
    executor). Null and empty texts have none; scores add up in double precision; repeated rows count alike."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        c = counter(path)
        return texts.map(lambda t: c.count(t) if t else 0).astype("int64")

    return counted(text)
