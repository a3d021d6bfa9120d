"""BPE by dynamic programming over prefixes, exact with respect to merging by rank.

A piece is a string of base symbols. In its BPE encoding every prefix has one last token, and the
encoding of a prefix is that of a shorter prefix followed by that token. So for each prefix, from
the shortest on, the tokens that end there are tried: one is the last token exactly if, placed
after the last token of the prefix it leaves, no merge would join symbols across the two. One
automaton over all tokens, whose suffix links lead from a match to the shorter ones, lists the
tokens that end at each place. Following the stored tokens back from the end emits the ids.

A pair test looks only at the tokens that border on the cut at some time while both sides are being
merged: the right-hand spine of the left token and the left-hand spine of the right one. A merge of
rank r joins two of them if both are there when its turn comes, that is, if neither has gone into
its parent before. Of equal ranks the one further left goes first.

Tokens that no merge makes, and tokens whose own symbols merge into something else, are never used,
as in merging by rank. Special tokens are cut out of a text first. Decoding joins the tokens by a
blank, as a tokenizer without a decoder does.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from struct import pack

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stormledger.llm.arrow import add_columns
from stormledger.llm.encode import BYTE_CHARS, CACHED_PIECES, PATTERNS, PLAIN, Kept

CACHED_PAIRS, CACHED_CHUNKS = 400_000, 60_000
LAST = 256  # symbol number of a byte that ends a word: byte + LAST
ENCODED = [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]


class Merges:
    """Tokens as symbol strings, and how each comes about."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        import ahocorasick

        self.symbols: dict[int, str] = {}  # token id: its symbols
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}  # token id: rank of the merge that makes it
        for byte, char in BYTE_CHARS.items():
            for text, symbol in ((char, chr(byte)), (char + suffix, chr(byte + LAST))):
                if suffix or symbol == chr(byte):
                    if text in vocab:
                        self.symbols[vocab[text]] = symbol
        for rank, (left, right) in enumerate(merges):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            if whole not in self.symbols:
                self.symbols[whole] = self.symbols[a] + self.symbols[b]
                self.parts[whole] = a, b
                self.made[whole] = rank
        self.single = {s: t for t, s in self.symbols.items() if len(s) == 1}
        self.made_by = {rank: token for token, rank in self.made.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.joined: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for token, symbols in self.symbols.items():
            if self.by_rank(symbols) == [token]:
                self.matches.add_word(symbols, (token, len(symbols)))
        self.matches.make_automaton()

    def by_rank(self, symbols: str) -> list[int]:
        """Merging by rank, one merge at a time: only to test the tokens themselves."""
        found, none = [self.single[s] for s in symbols], len(self.rank)
        while len(found) > 1:
            ranks = [self.rank.get(p, none) for p in zip(found, found[1:])]
            best = min(ranks)
            if best not in self.made_by:
                break
            at = ranks.index(best)
            found[at:at + 2] = [self.made_by[best]]
        return found

    def spine(self, token: int, side: int) -> tuple[tuple[int, int], ...]:
        """(token, rank of the merge that takes it into its parent), outermost first; side 0: left."""
        found = self.spines[side].get(token)
        if found is None:
            steps, until = [], len(self.rank)
            at = token
            while True:
                steps.append((at, until))
                if at not in self.parts:
                    break
                until = self.made[at]
                at = self.parts[at][side]
            found = self.spines[side][token] = tuple(steps)
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether the two stay two tokens when placed side by side."""
        pair = left << 32 | right
        known = self.joined.get(pair)
        if known is not None:
            return known
        rank, never = self.rank, len(self.rank)
        stays = not any(
            (r := rank.get((x, y), never)) < x_until and r <= y_until and r < never
            for x, x_until in self.spine(left, 1) for y, y_until in self.spine(right, 0)
        )
        if len(self.joined) >= CACHED_PAIRS:
            self.joined.clear()
        self.joined[pair] = stays
        return stays

    def encode(self, symbols: str) -> list[int]:
        last: list[int] = [-1] * (len(symbols) + 1)  # of each prefix: its last token
        size: list[int] = [0] * (len(symbols) + 1)
        for end, (token, length) in self.matches.iter(symbols):
            start = end + 1 - length
            if start == 0 or last[start] >= 0 and self.apart(last[start], token):
                last[end + 1] = token
                size[end + 1] = length
        found = []
        at = len(symbols)
        while at:
            found.append(last[at])
            at -= size[at]
        return found[::-1]


class Bpe:
    """Encodes and decodes whole texts by the vocabulary file of a word-level BPE tokenizer."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, self.suffix)
        # The library only prepares texts outside PLAIN: it normalises them and cuts them into pieces.
        rules = Tokenizer.from_file(path)
        self.normal, self.split = rules.normalizer, rules.pre_tokenizer
        special = {t.content: i for i, t in rules.get_added_tokens_decoder().items()}
        self.special = special
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in special.items()}
        self.byte_of = {ord(c): chr(b) for b, c in BYTE_CHARS.items()}
        self.pieces = Kept(self._piece, CACHED_PIECES)
        self.chunks = Kept(self._chunk, CACHED_CHUNKS)

    def _piece(self, octets: str) -> bytes:
        """octets: the piece's bytes, one character each."""
        symbols = octets[:-1] + chr(ord(octets[-1]) + LAST) if self.suffix else octets
        found = self.merges.encode(symbols)
        return pack(f"<{len(found)}I", *found)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.pieces[p.encode().decode("latin-1")] for p in PATTERNS["word"].findall(chunk)])

    def _plain_or_not(self, text: str) -> bytes:
        if PLAIN.fullmatch(text):
            return b"".join(map(self.chunks.__getitem__, text.lower().split()))
        cut = self.split.pre_tokenize_str(self.normal.normalize_str(text))
        return b"".join([self.pieces[p.translate(self.byte_of)] for p, _ in cut if p])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is the empty text."""
        text = text or ""
        if not self.special_pattern or not self.special_pattern.search(text):
            return self._plain_or_not(text)
        found, at = [], 0
        for m in self.special_pattern.finditer(text):
            found += [self._plain_or_not(text[at:m.start()]), pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*found, self._plain_or_not(text[at:])])

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    """One per worker process."""
    return Bpe(path)


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with ids (binary: little-endian unsigned 32-bit integers) and decoded, the ids' text.

    A null or empty text has no ids and decodes to the empty text. Rows are encoded alone, whole,
    whatever their length. Columns ids and decoded are replaced.
    """

    def make(texts: list) -> list[list]:
        coder = bpe(path)
        ids = [coder.encode(t) for t in texts]
        return [ids, [coder.decode(i) for i in ids]]

    return add_columns(df, text, ENCODED, make)
