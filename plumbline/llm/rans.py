"""Static range asymmetric numeral system for token ids.

One table of symbol frequencies, counted over the whole corpus, is shared by all files. A file holds whole documents
one after another; its ids are cut into blocks of equal length, and each block into interleaved lanes (id i belongs to
lane i mod lanes). Every lane has a state of its own; all lanes of a block share one stream of 32-bit words. Blocks
are independent of each other, and at checkpoints within a block the states and the place in the stream are stored,
so that the stretches between checkpoints can be decoded side by side, which numpy does here for a whole file at once.
Checksums cover the ids of each block and the file's head.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PRECISION = 20  # frequencies sum to 2**PRECISION, so the vocabulary may have as many ids at most
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
LANES = 32
BLOCK = 32_768  # ids of a block, at most
CHECKPOINT = 256  # steps, of one id in each lane, between checkpoints
MAGIC = b"RANSTOK1"
_HEAD = struct.Struct("<8sIIQIII")


class Table:
    """Frequencies of the symbols 0.., summing to 2**PRECISION; symbols that never occur have none."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.common = int(np.argmax(freq))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Scaled so that every symbol that occurs keeps a frequency of 1 at least."""
        whole, total = 1 << PRECISION, int(counts.sum())
        if (counts > 0).sum() > whole:
            raise ValueError("too many symbols for the precision")
        if not total:
            return cls(np.array([whole], dtype=np.int64))
        freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (whole / total))), 0).astype(np.int64)
        over = int(freq.sum()) - whole
        if over < 0:
            freq[np.argmax(freq)] -= over
        for k in np.argsort(-freq, kind="stable") if over > 0 else []:
            take = min(over, int(freq[k]) - (int(freq[k]) + 1) // 2)
            freq[k] -= take
            over -= take
            if not over:
                break
        return cls(freq)


def pack(doc_ids: list[int | None], docs: list[np.ndarray], table: Table) -> bytes:
    """A file of the given documents."""
    lengths = np.array([len(x) for x in docs], dtype="<u4")
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    blocks = max(1, -(-len(ids) // BLOCK))
    steps = max(1, -(-len(ids) // (blocks * LANES)))
    grid = np.full(blocks * steps * LANES, table.common, dtype=np.uint32)
    grid[: len(ids)] = ids
    sums = [zlib.crc32(grid[k * steps * LANES : (k + 1) * steps * LANES].tobytes()) for k in range(blocks)]
    lanes = grid.reshape(blocks, steps, LANES).transpose(1, 0, 2).reshape(steps, blocks * LANES)
    freq, start = table.freq[lanes], table.start[lanes]
    if not freq.all():
        raise ValueError("an id that the table doesn't have")
    state = np.full(blocks * LANES, LOW, dtype=np.uint64)
    words, sent, marks = np.zeros(lanes.shape, np.uint32), np.zeros(lanes.shape, bool), []
    p, top = np.uint64(PRECISION), np.uint64(63 - PRECISION)
    for t in range(steps - 1, -1, -1):
        f = freq[t]
        big = state >= f << top
        sent[t] = big
        words[t] = state.astype(np.uint32)
        state = np.where(big, state >> np.uint64(32), state)
        q = state // f
        state = (q << p) + (state - q * f) + start[t]
        if t % CHECKPOINT == 0:
            marks.append(state.reshape(blocks, LANES))
    marks = np.array(marks[::-1], dtype="<u8")  # checkpoint, block, lane
    sent, words = (x.reshape(steps, blocks, LANES).transpose(1, 0, 2) for x in (sent, words))
    counts = sent.sum(axis=2)  # block, step
    upto = np.concatenate([np.zeros((blocks, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
    offsets = upto[:, 0:steps:CHECKPOINT].astype("<u4")
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    numbers = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    head = _HEAD.pack(MAGIC, len(docs), table.crc, len(ids), blocks, steps, len(marks))
    index = zlib.compress(known.tobytes() + numbers.tobytes() + lengths.tobytes(), 1)
    body = b"".join([struct.pack("<I", len(index)), index, np.array(sums, dtype="<u4").tobytes(), upto[:, -1].astype("<u4").tobytes(), offsets.tobytes(), marks.transpose(1, 0, 2).tobytes()])
    return head + body + struct.pack("<I", zlib.crc32(head + body)) + words[sent].astype("<u4").tobytes()


def unpack(data: bytes, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids of a file, checked against its checksums."""
    magic, n_docs, crc, n, blocks, steps, marks = _HEAD.unpack_from(data)
    if magic != MAGIC or crc != table.crc:
        raise ValueError("not a file of this table")
    at = _HEAD.size
    (size,) = struct.unpack_from("<I", data, at)
    index = zlib.decompress(data[at + 4 : at + 4 + size])
    at += 4 + size

    def take(kind: str, *shape: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape)
        at += out.nbytes
        return out

    sums, sent, offsets, states = take("<u4", blocks), take("<u4", blocks), take("<u4", blocks, marks), take("<u8", blocks, marks, LANES)
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the head's checksum is wrong")
    words = np.frombuffer(data, "<u4", -1, at + 4)
    base = (np.cumsum(sent, dtype=np.int64) - sent)[:, None] + offsets
    grid = np.empty((blocks, steps, LANES), np.uint32)
    whole = steps // CHECKPOINT
    if whole:
        got = _stretch(states[:, :whole].reshape(-1, LANES), base[:, :whole].reshape(-1), words, CHECKPOINT, table)
        grid[:, : whole * CHECKPOINT] = got.reshape(CHECKPOINT, blocks, whole, LANES).transpose(1, 2, 0, 3).reshape(blocks, -1, LANES)
    if steps > whole * CHECKPOINT:
        got = _stretch(states[:, whole], base[:, whole], words, steps - whole * CHECKPOINT, table)
        grid[:, whole * CHECKPOINT :] = got.transpose(1, 0, 2)
    for k in range(blocks):
        if zlib.crc32(grid[k].tobytes()) != sums[k]:
            raise ValueError(f"the checksum of block {k} is wrong")
    known, numbers, lengths = np.frombuffer(index, np.uint8, n_docs), np.frombuffer(index, "<i8", n_docs, n_docs), np.frombuffer(index, "<u4", n_docs, 9 * n_docs)
    return [int(x) if k else None for k, x in zip(known, numbers, strict=True)], lengths, grid.reshape(-1)[:n]


def _stretch(states: np.ndarray, base: np.ndarray, words: np.ndarray, steps: int, table: Table) -> np.ndarray:
    """steps ids of each lane of many stretches: (step, stretch, lane). base: where each stretch's words begin."""
    state, at = states.astype(np.uint64), base.astype(np.int64)
    out = np.empty((steps, *state.shape), np.uint32)
    p, mask, slots, freq, start = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1), table.slots, table.freq, table.start
    words = words.astype(np.uint64) if len(words) else np.zeros(1, np.uint64)
    at = at[:, None] - 1
    for t in range(steps):
        slot = state & mask
        symbol = slots[slot.view(np.int64)].astype(np.int64)
        out[t] = symbol
        state = freq[symbol] * (state >> p) + slot - start[symbol]
        need = state < LOW
        rank = np.cumsum(need, axis=1)
        state = np.where(need, (state << np.uint64(32)) | words[at + rank], state)  # lanes without need read in vain
        at += rank[:, -1:]
    return out
