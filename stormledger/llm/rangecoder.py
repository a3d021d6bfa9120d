"""Token ids as compressed segments: an adaptive, context-mixing range coder over many blocks at once.

A segment holds a run of ids, cut into blocks of BLOCK ids. Each block is coded by itself: its
models start anew, and its checksum is verified on reading. Per id, three predictions are mixed:

* order 2: the id that last followed the two ids before, with a confidence that hits raise
* order 1: the id that last followed the id before, likewise
* order 0: the frequencies of the segment's ids, stored once in its head

The joint confidence of orders 2 and 1 (and whether they agree) picks a pair of weights; the order-2
id gets the first, the order-1 id the second, and what is left goes to all ids by order 0. The
weights are adaptive: each id moves those used towards the predictions that were right. The mixed
distribution gives the id's interval, by which one step of a range coder narrows its range. All
models and the coder use whole numbers, so reading repeats writing on any machine.

The blocks of a segment are coded in step, one numpy operation for all of them, so a segment costs
BLOCK rounds. Segment: MAGIC, the number of ids, of distinct ids and of blocks; the distinct ids and
their frequencies, deflated; (words, checksum) per block; the blocks' 16-bit words.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

MAGIC = b"IDS2"
BLOCK = 2048
TOTAL_BITS = 24  # of the mixed distribution
ORDER0_BITS = 20  # of the order-0 frequencies; at most 2^19 distinct ids in a segment
TOTAL = 1 << TOTAL_BITS
SLOT_BITS = 11  # slots of the order-1 and of the order-2 table of a block
HASH_SHIFT = np.uint32(32 - SLOT_BITS)
SURE = 15  # the highest confidence
MOST_TWO, MOST_ONE, LEAST = TOTAL // 4 * 3, TOTAL // 16 * 3, 1 << 10
RATE = 4
#: Where both weights move: nothing was right, order 1 only, order 2 (or both).
TARGETS = np.array([two << 32 | one for two, one in ((LEAST, LEAST), (LEAST, MOST_ONE), (MOST_TWO, LEAST), (MOST_TWO, LEAST))])
#: What is added to a confidence, by (hit << 4) + confidence.
CONFIDENCE = np.array([max(k >> 1, 1) - k for k in range(SURE + 1)] + [int(k < SURE) for k in range(SURE + 1)], np.int32)
MOST_COUNTED = 1 << 22  # ids below it are numbered by a table of counts, without a sort
LOW_BITS = 32  # the coder's range stays from 2^32 to 2^48: whole numbers that a double holds exactly, as do quotients
RANGE = 1 << LOW_BITS + 16
FACTOR, PAIR_FACTOR = np.uint32(2654435761), np.uint32(30011)


class CorruptBlock(ValueError):
    """A block's ids do not have the checksum that was written with them."""


class _Order0(NamedTuple):
    ids: np.ndarray  # the distinct ids, ascending
    freq: np.ndarray
    cum: np.ndarray  # before each id
    end: np.ndarray  # cum + freq


def _order0(ids: np.ndarray, counts: np.ndarray) -> _Order0:
    """Frequencies of at least 1 that add up to 2^ORDER0_BITS."""
    whole = 1 << ORDER0_BITS
    if 2 * len(ids) > whole:
        raise ValueError("too many distinct ids in a segment")
    freq = 1 + counts.astype(np.int64) * (whole - len(ids)) // max(1, int(counts.sum()))
    freq[np.argmax(freq)] += whole - freq.sum()
    return _table(ids, freq)


def _table(ids: np.ndarray, freq: np.ndarray) -> _Order0:
    freq = freq.astype(np.int64)
    end = np.cumsum(freq)
    return _Order0(ids, freq, end - freq, end)


class _Models:
    """The state of all blocks of a segment and what one id does to it; rows 0 and 1 are orders 1 and 2."""

    def __init__(self, blocks: int) -> None:
        lane = np.arange(blocks)
        self.slots = np.zeros(2 * blocks << SLOT_BITS, np.int32)  # (id's number << 4) + confidence
        contexts = 2 << 8
        # The weight of order 2 in the upper half, that of order 1 in the lower.
        self.weights = np.full(blocks * contexts, TOTAL // 8 << 32 | TOTAL // 16, np.int64)
        self.lanes, self.lane_mix = np.array([lane, lane + blocks]) << SLOT_BITS, lane * contexts
        self.context = np.zeros((2, blocks), np.uint32)  # the last id, and the last two

    def predict(self, n: int) -> None:
        """For the first n blocks: the ids orders 1 and 2 expect, and their shares of TOTAL."""
        # 32-bit products wrap around, alike on any machine.
        self.at = (self.context[:, :n] * FACTOR >> HASH_SHIFT).astype(np.int64)
        self.at += self.lanes[:, :n]
        self.held = self.slots.take(self.at, mode="clip")
        self.ids, self.sure = self.held >> 4, (self.held & SURE).astype(np.int64)
        agree = (self.ids[0] == self.ids[1]).astype(np.int64)
        self.at_mix = (self.sure[1] << 4 | self.sure[0]) + self.lane_mix[:n] + (agree << 8)
        self.own = self.weights.take(self.at_mix, mode="clip")
        self.two = self.own >> 32
        self.one = self.own & (agree - 1) & 0xFFFFFFFF
        self.both = self.two + self.one

    def learn(self, n: int, number: np.ndarray, hit: np.ndarray) -> None:
        """number: the ids that came, as numbers among the segment's distinct ids; hit: whether they were expected."""
        came = hit.astype(np.int64)
        halves = self.own.view(np.int32)
        moved = TARGETS.take(came[0] + (came[1] << 1), mode="clip").view(np.int32) - halves
        moved >>= RATE
        moved += halves
        self.weights[self.at_mix] = moved.view(np.int64)
        case = (came << 4) + self.sure
        # A missed id of the least confidence gives way.
        self.slots[self.at] = np.where(case <= 1, (number << 4) + 1, self.held + CONFIDENCE.take(case, mode="clip"))
        last, pair = self.context[:, :n]
        np.multiply(last, PAIR_FACTOR, out=pair)
        last[:] = number
        pair += last


def _columns(n_ids: int) -> tuple[int, int]:
    """Blocks, and ids of the last one."""
    blocks = -(-n_ids // BLOCK)
    return blocks, n_ids - (blocks - 1) * BLOCK


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, every id's number among them, and their counts."""
    if not len(ids) or int(ids.max()) >= MOST_COUNTED:
        distinct, numbers, counts = np.unique(ids, return_inverse=True, return_counts=True)
        return distinct, numbers.astype(np.int32), counts
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    return distinct.astype("<u4"), place.take(ids), counts[distinct]


def encode(ids: np.ndarray) -> bytes:
    """A segment of these ids (unsigned, below 2^32); no ids give a segment without blocks."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    blocks, rest = _columns(len(ids))
    distinct, numbers, counts = _numbered(ids)
    order0 = _order0(distinct, counts) if len(ids) else _table(distinct, np.zeros(0, np.int64))
    numbers.resize(blocks * BLOCK, refcheck=False)
    by_round = np.ascontiguousarray(numbers.reshape(blocks, BLOCK).T)
    del numbers
    models = _Models(blocks)
    low, size = np.zeros(blocks, np.int64), np.full(blocks, RANGE, np.int64)
    words = np.zeros((blocks, BLOCK * 3 // 2 + 8), np.uint32)  # 17 bits each, until carries are settled
    flat, begin = words.reshape(-1), np.arange(blocks) * words.shape[1]
    place = begin.copy()

    def put(which: np.ndarray) -> None:
        own = low[which]
        flat[place[which]] = own >> LOW_BITS
        place[which] += 1
        low[which] = (own & ((1 << LOW_BITS) - 1)) << 16

    for at in range(BLOCK if blocks > 1 else rest if blocks else 0):
        n = blocks if at < rest else blocks - 1
        number = by_round[at, :n]
        models.predict(n)
        two, both = models.two, models.both
        hit = models.ids == number
        left = TOTAL - both
        wide = number.astype(np.int64)
        first = order0.cum.take(wide, mode="clip") * left >> ORDER0_BITS
        share = (order0.end.take(wide, mode="clip") * left >> ORDER0_BITS) - first
        start = np.where(hit[1], 0, np.where(hit[0], two, first + both))
        share = np.where(hit[1], two, np.where(hit[0], models.one, share))
        step = size[:n] >> TOTAL_BITS
        low[:n] += step * start
        size[:n] = step * share
        # Every block writes its word; only those whose range is narrow move on from it.
        narrow = size[:n] < (1 << LOW_BITS)
        flat[place[:n]] = low[:n] >> LOW_BITS
        place[:n] += narrow
        low[:n] = np.where(narrow, (low[:n] & ((1 << LOW_BITS) - 1)) << 16, low[:n])
        size[:n] = np.where(narrow, size[:n] << 16, size[:n])
        narrow = np.flatnonzero(size[:n] < (1 << LOW_BITS))
        while len(narrow):
            put(narrow)
            size[narrow] <<= 16
            narrow = narrow[size[narrow] < (1 << LOW_BITS)]
        models.learn(n, number, hit)
    for _ in range(3):
        put(np.arange(blocks))
    filled = place - begin
    for at in range(0, blocks, 64):
        some = words[at:at + 64, : int(filled[at:at + 64].max())]
        while (carry := some >> 16).any():
            some &= 0xFFFF
            some[:, :-1] += carry[:, 1:]

    head = zlib.compress(distinct.astype("<u4").tobytes() + order0.freq.astype("<u4").tobytes(), 6)
    out = [MAGIC, struct.pack("<4I", len(ids), len(distinct), blocks, len(head)), head]
    for block in range(blocks):
        own = ids[block * BLOCK:(block + 1) * BLOCK]
        out.append(struct.pack("<2I", int(filled[block]), zlib.crc32(own.tobytes())))
    out += [words[block, : filled[block]].astype("<u2").tobytes() for block in range(blocks)]
    return b"".join(out)


def decode(segment: bytes) -> np.ndarray:
    """The ids of a segment; CorruptBlock if a block's checksum fails or the segment is cut short."""
    if segment[:4] != MAGIC or len(segment) < 20:
        raise CorruptBlock("not a segment")
    n_ids, n_distinct, blocks, head_size = struct.unpack_from("<4I", segment, 4)
    head = np.frombuffer(zlib.decompress(segment[20:20 + head_size]), "<u4")
    order0 = _table(head[:n_distinct], head[n_distinct:].astype(np.int64))
    directory = np.frombuffer(segment, "<u4", 2 * blocks, 20 + head_size).reshape(blocks, 2)
    sizes = directory[:, 0].astype(np.int64)
    data_at = 20 + head_size + 8 * blocks
    if len(segment) != data_at + 2 * int(sizes.sum()):
        raise CorruptBlock("a segment of another size than its head says")
    data = np.concatenate([np.frombuffer(segment, "<u2", offset=data_at), np.zeros(8, np.uint16)])
    next_word = np.cumsum(sizes) - sizes
    code = np.zeros(blocks, np.int64)  # 48 bits, relative to low: three words
    for _ in range(3):
        code = code << 16 | data.take(next_word, mode="clip")
        next_word += 1
    slots = np.repeat(np.arange(n_distinct, dtype=np.uint16 if n_distinct <= 1 << 16 else np.int32), order0.freq)
    _, rest = _columns(n_ids)
    by_round = np.zeros((BLOCK, blocks), np.int32)
    models = _Models(blocks)
    size = np.full(blocks, RANGE, np.int64)
    for at in range(BLOCK if blocks > 1 else rest if blocks else 0):
        n = blocks if at < rest else blocks - 1
        models.predict(n)
        two, both = models.two, models.both
        left = TOTAL - both
        step = size[:n] >> TOTAL_BITS
        # Quotients of doubles, cut to whole numbers: exact, as all numbers are below 2^48.
        value = (code[:n] / step).astype(np.int64)
        in_two, in_both = value < two, value < both
        slot = ((((value - both + 1) << ORDER0_BITS) - 1) / left).astype(np.int64)
        number = slots.take(slot, mode="clip").astype(np.int32)
        number = np.where(in_two, models.ids[1], np.where(in_both, models.ids[0], number))
        wide = number.astype(np.int64)
        first = order0.cum.take(wide, mode="clip") * left >> ORDER0_BITS
        share = (order0.end.take(wide, mode="clip") * left >> ORDER0_BITS) - first
        start = np.where(in_two, 0, np.where(in_both, two, first + both))
        share = np.where(in_two, two, np.where(in_both, models.one, share))
        code[:n] -= step * start
        size[:n] = step * share
        narrow = size[:n] < (1 << LOW_BITS)
        code[:n] = np.where(narrow, code[:n] << 16 | data.take(next_word[:n], mode="clip").astype(np.int64), code[:n])
        next_word[:n] += narrow
        size[:n] = np.where(narrow, size[:n] << 16, size[:n])
        narrow = np.flatnonzero(size[:n] < (1 << LOW_BITS))
        while len(narrow):
            code[narrow] = code[narrow] << 16 | data.take(next_word[narrow], mode="clip")
            next_word[narrow] += 1
            size[narrow] <<= 16
            narrow = narrow[size[narrow] < (1 << LOW_BITS)]
        by_round[at, :n] = number
        models.learn(n, number, models.ids == number)
    numbers = by_round.T.reshape(-1)[:n_ids]
    ids = order0.ids[numbers] if n_ids else np.zeros(0, "<u4")
    for block in range(blocks):
        if zlib.crc32(ids[block * BLOCK:(block + 1) * BLOCK].tobytes()) != int(directory[block, 1]):
            raise CorruptBlock(f"block {block}")
    return ids
