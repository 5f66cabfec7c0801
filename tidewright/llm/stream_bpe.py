"""BPE as a transducer: symbols in, token ids out as soon as nothing that follows can change them, and back to text."""

from __future__ import annotations

import codecs
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs between these six characters are encoded by themselves where the tokenizer drops white space.
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+").findall
#: The pattern of the public word-end vocabulary (a fixed value), and the same for printable ASCII and Latin-1 letters,
#: which no normal form changes, in lower case.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_LATIN_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
#: Tokens read back at once, and the longest run whose ids are remembered.
PART, SHORT = 1 << 16, 48
#: Runs, and words within runs, of which two such lots at most are remembered.
RUNS, WORDS = 300_000, 240_000


class Memory(dict):
    """Results by string, worked out when first asked for. Holds twice ``room`` at most: when as many are new, the old
    ones go but for those asked for since."""

    def __init__(self, work, room: int):
        self.work, self.room, self.old = work, room, {}

    def __missing__(self, key: str) -> bytes:
        if (out := self.old.get(key)) is None:
            out = self.work(key)
        if len(key) <= SHORT:
            if len(self) >= self.room:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for themselves,
    the others from U+0100 on, in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """A merge list over symbols: ranks of pairs, and how far ahead one must see before tokens are settled.

    ``lookahead`` is the number of symbols that suffices: tokens of a text that end so far before its end are those of
    every text it begins. What follows a text changes its tokens from the right: a merge of small rank takes a symbol
    away from a merge of larger rank on its left, which frees the left part of that one for a merge of still larger
    rank, and so on. Each step goes over the left part of a merge, which must be the beginning of the right part of
    the next one. The longest such chain of rising ranks is found from the last merge to the first.
    It is None if a merge uses a token that is made after it: such lists have no such order."""

    def __init__(self, merges: Iterable[tuple[str, str]], size=len):
        self.ranks: dict[tuple[str, str], int] = {}
        made: dict[str, int] = {}
        parts: dict[str, tuple[str, str]] = {}
        ordered = True
        for i, (a, b) in enumerate(merges):
            self.ranks.setdefault((a, b), i)
            if a + b in made:  # made twice: its rank isn't known from the token
                ordered = False
            made.setdefault(a + b, i)
            parts.setdefault(a + b, (a, b))
        ordered = ordered and all(made.get(x, -1) < i for (a, b), i in self.ranks.items() for x in (a, b))
        self.lookahead = self._lookahead(parts, size) if ordered else None

    def _lookahead(self, parts: dict[str, tuple[str, str]], size) -> int:
        reach: dict[str, int] = {}
        far = 0
        for (a, b), _ in sorted(self.ranks.items(), key=lambda x: -x[1]):
            f = size(a) + reach.get(a, 0)
            far = max(far, f)
            while True:  # whatever b begins with may have been freed before
                reach[b] = max(reach.get(b, 0), f)
                if b not in parts:
                    break
                b = parts[b][0]
        return far

    def apply(self, symbols: list[str]) -> list[str]:
        """All merges, the smallest rank first and of equal ones the leftmost."""
        n, ranks = len(symbols), self.ranks
        if n <= 64:
            s, none, get = list(symbols), len(ranks), ranks.get
            r = [get(x, none) for x in zip(s, s[1:])]
            while r and (low := min(r)) != none:
                i = r.index(low)
                s[i:i + 2] = [s[i] + s[i + 1]]
                del r[i]
                if i:
                    r[i - 1] = get((s[i - 1], s[i]), none)
                if i < len(r):
                    r[i] = get((s[i], s[i + 1]), none)
            return s
        s, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if s[i] is None or j >= n or ranks.get((s[i], s[j])) != r:
                continue
            s[i], s[j] = s[i] + s[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := ranks.get((s[i], s[k]))) is not None:
                    heapq.heappush(heap, (x, i))
            if (p := before[i]) >= 0 and (x := ranks.get((s[p], s[i]))) is not None:
                heapq.heappush(heap, (x, p))
        return [x for x in s if x is not None]


class Transducer:
    """One word, given in pieces of any length. Holds the symbols whose tokens aren't settled, some four lookaheads at
    most, whatever the length of the word."""

    def __init__(self, merges: Merges, ending: str = "", size=len):
        self.merges, self.ending, self.size, self.held = merges, ending, size, []
        self.full = None if merges.lookahead is None else max(64, 4 * (merges.lookahead + 1))

    def feed(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens that are settled by now."""
        it, room = iter(symbols), self.full
        while True:
            self.held.extend(islice(it, room and room - len(self.held)))
            if not room or len(self.held) < room:
                return
            yield from self._settled()

    def _settled(self) -> Iterator[str]:
        # the last symbol may still get the ending of the word, so it counts as unseen
        sure, at = len(self.held) - 1 - self.merges.lookahead, 0
        for t in self.merges.apply(self.held[:-1]):
            if at + self.size(t) > sure:
                break
            at += self.size(t)
            yield t
        del self.held[:at]

    def finish(self) -> list[str]:
        """The rest, the last symbol with the ending of words; ready for the next word afterwards."""
        held, self.held = self.held, []
        if held:
            held[-1] += self.ending
        return self.merges.apply(held)


class WordBpe:
    """A BPE tokenizer from a tokenizers library file: its normaliser and pattern are the library's, merges are ours."""

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("a BPE model with plain merges is needed")
        self.ending = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        own = tokenizers.Tokenizer.from_file(path)
        self.normal, self.split = own.normalizer, own.pre_tokenizer
        self.letters = _byte_letters()
        if any(x + end not in self.vocab for x in self.letters for end in {"", self.ending}):
            raise ValueError("a vocabulary with all bytes is needed")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(pairs, self.size)
        self.machine = Transducer(self.merges, self.ending, self.size)
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        # of tokens that begin at one place the longest is taken
        self.find = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        kinds = json.dumps(told.get("pre_tokenizer"))
        #: no token reaches over white space, and each run between is encoded alike wherever it stands
        self.by_run = '"behavior": "Removed", "invert": true' in kinds and not any(re.search(r"\s", x) for x in self.special)
        self.names = {i: x for x, i in self.vocab.items()} | {i: x for x, i in self.special.items()}
        decoder = told.get("decoder")
        if decoder and decoder["type"] != "ByteLevel":
            raise ValueError("only files without decoder or with that of byte letters can be read back")
        code = {x: i for i, x in enumerate(self.letters)}
        self.bytes = {i: bytes(map(code.get, x)) if all(c in code for c in x) else x.encode() for i, x in self.names.items()} if decoder else None
        self.runs, self.words = Memory(self._run, RUNS), Memory(self._word, WORDS)
        normal = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        self.latin = self.by_run and normal == ["NFC", "Replace", "Lowercase"] and json.dumps({"Regex": _WORD_PATTERN}) in kinds
        self.as_letters = str.maketrans(dict(enumerate(self.letters)))

    def size(self, token: str) -> int:
        return len(token) - len(self.ending) if self.ending and token.endswith(self.ending) else len(token)

    def _word(self, word: str) -> bytes:
        """Ids of what the pattern matches, given in byte letters; a long word goes through in pieces."""
        of, t = self.vocab, self.machine
        ids = [of[x] for x in t.feed(word)]
        ids += [of[x] for x in t.finish()]
        return pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        normal = self.normal.normalize_str(text) if self.normal else text
        return b"".join([self.words[w] for w, _ in self.split.pre_tokenize_str(normal)])

    def _run(self, run: str) -> bytes:
        """Ids of a text in which special tokens may stand; they are found before anything is normalised."""
        if self.latin and _LATIN(run) and not self.find.search(run):
            low = run.lower()
            if not low.isascii():  # cut as characters, then named by bytes
                return b"".join([self.words[w.encode().decode("latin-1").translate(self.as_letters)] for w in _LATIN_WORDS(low)])
            return self.words[low] if low.isalpha() else b"".join([self.words[w] for w in _LATIN_WORDS(low)])
        if not self.find:
            return self._plain(run)
        out, at = [], 0
        for m in self.find.finditer(run):
            out += [self._plain(run[at:m.start()]), pack("<I", self.special[m.group()])]
            at = m.end()
        return b"".join([*out, self._plain(run[at:])])

    def encode(self, text: str) -> bytes:
        """Packed ids. Where white space is dropped, runs between it are looked up first: most were met before."""
        if not self.by_run:
            return self._run(text) if text else b""
        runs = self.runs
        return b"".join([runs[x] for x in _CHUNK(text)])

    def texts(self, ids: bytes) -> Iterator[str]:
        """The decoded text piece by piece. Byte letters become bytes and bytes characters by a state machine that keeps
        an unfinished character until its next byte; without a decoder tokens are joined by spaces."""
        machine = codecs.getincrementaldecoder("utf-8")("replace") if self.bytes else None
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), PART):
            part = numbers[at:at + PART].tolist()
            if machine is None:
                yield (" " if at else "") + " ".join([self.names[i] for i in part])
            else:
                yield machine.decode(b"".join([self.bytes[i] for i in part]))
        if machine:
            yield machine.decode(b"", final=True)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode(text: Column, path: str) -> Column:
    """Token ids of whole texts as the tokenizers library makes them from a file (at the same place on every executor)
    without added special tokens, truncation or padding, packed as little-endian unsigned 32-bit integers (binary).
    Special tokens that stand in a text become their ids. Null and empty texts give no ids; repeated rows give equal
    ids; other columns don't matter. A very long word is held only as far as its tokens aren't settled."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return texts.map(lambda x: t.encode(x) if x else b"")

    return packed(text)


def decode(ids: Column, path: str) -> Column:
    """The text behind packed ids, special tokens included. Null gives the empty text; an unknown id fails."""

    @F.pandas_udf("string")
    def joined(packed: pd.Series) -> pd.Series:
        t = tokenizer(path)
        return packed.map(lambda b: "".join(t.texts(b)) if b else "")

    return joined(ids)
