"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

A BPE tokenizer first cuts a text into pieces and then encodes every piece by itself. Texts made of
characters on which all Unicode tables agree (PLAIN) are cut here by the tokenizer's own pattern,
and the library encodes only pieces that a worker does not hold. Every other text, and any
that spells a special token, goes to the library as a whole. Both ways give the same ids.

`batch` cuts the texts of a whole Arrow column at once where pieces are byte-level, by the classes of
neighbouring bytes, and looks up each of its distinct pieces once.
"""

from __future__ import annotations

import re
from functools import lru_cache
from struct import pack

CACHED_PIECES, CACHED_CHARS = 400_000, 24  # bounds on a worker's memory: so many pieces, of so many characters each

#: Printable Latin letters and signs, without those that are numbers but not digits, and white space.
PLAIN = re.compile("[\t\n\r -~¡-±´-¸º»¿-įı-ɏ]*")
# Letters, digits and signs of PLAIN texts, in lower case too, as plain ranges: faster than Unicode classes.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ\u2c65\u2c66"
_L, _N, _OTHER = f"[{_LETTERS}]", "[0-9]", rf"[^\s0-9{_LETTERS}]"
# The contractions and the order of alternatives are those of the two tokenizers.
PATTERNS = {
    "byte": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{_L}+| ?{_N}+| ?{_OTHER}+|\s+(?!\S)|\s+"),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_L}+|{_N}|{_OTHER}+"),
}


#: Byte-level BPE writes each byte as a printable character: itself, or one from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {
    b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))
}


def byte_level(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_CHARS)


class Kept(dict):
    """What `make` gives for a key, made once; beyond `most` keys all are forgotten, long keys are not held."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class PieceEncoder:
    """kind: "byte" (byte-level pieces) or "word" (lower-cased words, white space dropped)."""

    def __init__(self, path: str, kind: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.kind = kind
        self.cut = PATTERNS[kind].findall
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.pieces, self.older = Kept(self._piece, CACHED_PIECES), {}

    def _piece(self, piece: str) -> bytes:
        found = [t.id for t in self.model.tokenize(byte_level(piece))]
        return pack(f"<{len(found)}I", *found)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null is the empty text."""
        text = text or ""
        if not PLAIN.fullmatch(text) or self.special and self.special.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return pack(f"<{len(found)}I", *found)
        text = text.lower() if self.kind == "word" else text
        return b"".join(map(self.pieces.__getitem__, self.cut(text)))


    def batch(self, texts):
        """The ids of a string column's texts (null is the empty text), one after the other, and their number per text."""
        import numpy as np
        import pyarrow as pa

        if self.kind != "byte":
            own = list(map(self.ids, texts.to_pylist()))
            return np.frombuffer(b"".join(own), "<u4"), np.array(list(map(len, own)), np.int64) // 4
        rows = [t or "" for t in texts.to_pylist()]
        whole = {}  # of the texts that are not cut here
        for k, text in enumerate(rows):
            if not PLAIN.fullmatch(text) or self.special and self.special.search(text):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                rows[k] = ""
        column = pa.array(rows, pa.large_string())
        text_at = np.frombuffer(column.buffers()[1], np.int64, len(rows) + 1)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8, int(text_at[-1]))
        starts = byte_level_starts(data, text_at[:-1])
        cut = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)
        ).dictionary_encode()
        distinct = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.pieces.get, distinct))
        absent = [k for k, own in enumerate(found) if own is None]
        for k in absent:
            found[k] = self.older.get(distinct[k])
        missed = [k for k in absent if found[k] is None]
        # One pass writes all of them byte by byte; no PLAIN text holds the character between them.
        shown = byte_level("\0".join(distinct[k] for k in missed)).split(BYTE_CHARS[0])
        for k, piece in zip(missed, shown):
            own = [t.id for t in self.model.tokenize(piece)]
            found[k] = pack(f"<{len(own)}I", *own)
        for k in absent:
            if len(distinct[k]) <= CACHED_CHARS:
                self.pieces[distinct[k]] = found[k]
        if len(self.pieces) > CACHED_PIECES // 4:  # what is not asked for until this happens again is forgotten
            self.pieces, self.older = Kept(self._piece, CACHED_PIECES), self.pieces
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids, first = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        piece = cut.indices.to_numpy()
        taken = sizes.take(piece)
        ends = np.concatenate([[0], np.cumsum(taken)])  # ids before each piece, and all of them
        small = np.int32 if ends[-1] < 1 << 31 else np.int64
        at = np.repeat((first.take(piece) - ends[:-1]).astype(small), taken)
        at += np.arange(ends[-1], dtype=small)
        ids = ids.take(at)
        del at
        before = ends[np.searchsorted(starts, text_at)]
        counts = np.diff(before)
        if whole:
            cuts = np.split(ids, before[1:-1])
            cuts = [whole.get(k, own) for k, own in enumerate(cuts)]
            ids, counts = np.concatenate(cuts), np.array([len(own) for own in cuts])
        return ids, counts


_SPACE, _BLANK, _LETTER, _DIGIT, _SIGN = range(5)


@lru_cache(maxsize=1)
def _classes():
    """The classes of one-byte characters, and of two-byte characters by their code point."""
    import numpy as np

    found = [_SIGN] * 0x250
    for code in range(0x250):
        if re.match(f"[{_LETTERS}]", chr(code)):
            found[code] = _LETTER
    for code in b"0123456789":
        found[code] = _DIGIT
    for code in b"\t\n\r":
        found[code] = _BLANK
    found[ord(" ")] = _SPACE
    return np.array(found[:128] + [_SIGN] * 128, np.uint8), np.array(found, np.uint8)


def byte_level_starts(data, text_at):
    """Where the pieces of PATTERNS["byte"] start in the UTF-8 bytes of PLAIN texts, which start at text_at."""
    import numpy as np

    single, double = _classes()
    kind = single.take(data)
    lead = np.flatnonzero(data >= 0xC0)
    kind[lead] = kind[lead + 1] = double.take((data[lead].astype(np.int64) & 31) << 6 | data[lead + 1] & 63)
    new_text = np.zeros(len(data) + 1, bool)
    new_text[text_at] = True
    blank = kind <= _BLANK
    start = new_text[:-1].copy()
    # Letters, digits and signs take the space before them along.
    start[1:] |= (kind[1:] != kind[:-1]) & ~blank[1:] & (kind[:-1] != _SPACE)
    start[1:] |= blank[1:] & ~blank[:-1]
    # The last of a run of white space stands apart, unless it ends the text.
    start[:-1] |= blank[:-1] & ~blank[1:] & ~new_text[1:-1]
    # A contraction starts where a piece does, and the piece after it where it ends.
    mark = np.flatnonzero(data == ord("'"))
    before = kind.take(mark - 1, mode="clip")
    mark = mark[new_text[mark] | (before != _SIGN) & (before != _SPACE)]
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = padded[mark + 1], padded[mark + 2]
    long = np.isin(one.astype(np.int64) << 8 | two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
    long &= ~new_text[mark + 1] & ~new_text[np.minimum(mark + 2, len(data))]
    short = np.isin(one, list(b"stmd")) & ~new_text[mark + 1]
    start[mark[short | long] + 1] = False
    ends = np.concatenate([mark[short] + 2, mark[long] + 3])
    start[ends[ends < len(data)]] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> PieceEncoder:
    """One per worker process, so that its pieces serve all tasks the worker runs."""
    return PieceEncoder(path, kind)
