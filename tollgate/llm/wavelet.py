"""Wavelet matrix over a token sequence, as one file per shard.

Ids are numbered densely per shard, so a shard needs ceil(log2(distinct ids)) bit-planes. A plane
keeps its bits in 64-bit words and the number of ones before every word. From the file alone,
single tokens, counts up to a place and the places of a token can be had without decoding it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TGWM1\0\0\0"
HEAD = struct.Struct("<8s5Q")


class Plane:
    """Bits with rank and select."""

    def __init__(self, words: np.ndarray, before: np.ndarray, n: int):
        self.words, self.before, self.n = words, before, n
        self.zeros = n - int(before[-1])

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(n // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        before = np.zeros(len(words) + 1, "<u4")
        np.cumsum(np.bitwise_count(words), out=before[1:])
        return cls(words, before, n)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place 0..n."""
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6].astype(np.int64) + np.bitwise_count(self.words[at >> 6] & mask)

    def select(self, k: np.ndarray, bit: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero, for those that exist."""
        ends = self.before[1:].astype(np.int64)
        if not bit:
            ends = 64 * np.arange(1, len(ends) + 1, dtype=np.int64) - ends
        word = np.searchsorted(ends, k, side="right")
        rest = k - np.where(word > 0, ends[word - 1], 0)
        one = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
        return 64 * word + (np.cumsum(one, axis=1) == rest[:, None] + 1).argmax(axis=1)


class WaveletMatrix:
    def __init__(self, alphabet: np.ndarray, planes: list[Plane], n: int):
        self.alphabet, self.planes, self.n = alphabet, planes, n

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        seen = np.bincount(ids, minlength=1) > 0
        alphabet = np.flatnonzero(seen).astype("<u4")
        codes = (np.cumsum(seen) - 1).astype(np.uint16 if len(alphabet) <= 65_536 else np.uint32)[ids]
        planes = []
        for bit in reversed(range(max(0, len(alphabet) - 1).bit_length())):
            ones = codes & codes.dtype.type(1 << bit) != 0
            planes.append(Plane.of(ones))
            codes = np.concatenate([codes[~ones], codes[ones]])
        return cls(alphabet, planes, len(ids))

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        codes = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            ones, before = plane.bits(), np.empty_like(codes)
            before[~ones], before[ones] = codes[: plane.zeros], codes[plane.zeros :] | codes.dtype.type(1 << level)
            codes = before
        return self.alphabet[codes] if self.n else np.empty(0, "<u4")

    def access(self, at: np.ndarray) -> np.ndarray:
        at, code = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane in self.planes:
            one, ones = plane.get(at), plane.ones(at)
            code = 2 * code + one
            at = np.where(one, plane.zeros + ones, at - ones)
        return self.alphabet[code]

    def _code(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token before ``end`` lie after the last plane."""
        code = self._code(token)
        if code is None:
            return 0, 0
        ends = np.array([0, min(end, self.n)], np.int64)
        for level, plane in enumerate(self.planes):
            ones = plane.ones(ends)
            ends = plane.zeros + ones if code >> (len(self.planes) - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of a token before ``end``."""
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def places(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the occurrences number ``first`` to ``last`` (exclusive) of a token."""
        lo, hi = self._range(token, self.n)
        at = np.arange(lo + first, hi if last is None else min(hi, lo + last), dtype=np.int64)
        code = self._code(token)
        for level, plane in enumerate(reversed(self.planes)):
            bit = bool(code >> level & 1) if code is not None else False
            at = plane.select(at - plane.zeros if bit else at, bit)
        return at


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's file: documents (ids, token counts) and the wavelet matrix of their tokens."""
    m = WaveletMatrix.of(ids)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    parts = [
        HEAD.pack(MAGIC, len(doc_ids), len(ids), len(m.alphabet), len(m.planes), 0),
        known.tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.asarray(lengths, "<u8").tobytes(),
        m.alphabet.tobytes(),
    ]
    for p in m.planes:
        parts += [p.words.tobytes(), p.before.tobytes()]
    return b"".join(parts)


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    magic, docs, n, letters, levels, _ = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    known, doc_ids, lengths = take("u1", docs), take("<i8", docs), take("<u8", docs)
    alphabet = take("<u4", letters)
    planes = [Plane(take("<u8", n // 64 + 1), take("<u4", n // 64 + 2), n) for _ in range(levels)]
    ids = [int(x) if k else None for x, k in zip(doc_ids, known)]
    return ids, lengths.astype(np.int64), WaveletMatrix(alphabet, planes, n)
