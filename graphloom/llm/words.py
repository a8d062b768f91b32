"""Words of many texts at once, as 64-bit numbers.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return;
those are single bytes in UTF-8, so texts are handled as bytes. A word's number is a polynomial of its bytes modulo
2**64, taken from running sums over a piece of text, then mixed. Two words of one run collide with
probability near n**2 / 2**65.
"""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
U64 = np.uint64
#: bytes of text that one call of the hasher should get; longer single texts are allowed
SLICE = 2 << 20


class Words(NamedTuple):
    hashes: np.ndarray  # of each word
    starts: np.ndarray  # byte offsets in buf
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the number of words at the end
    buf: bytes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHasher:
    def __init__(self, piece: int = 1 << 18):
        self.piece = piece
        self.power = np.full(piece + 1, U64(BASE))
        self.inverse = np.full(piece + 1, U64(pow(BASE, -1, 1 << 64)))
        for table in (self.power, self.inverse):
            table[0] = 1
            np.multiply.accumulate(table, out=table)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def __call__(self, texts: list[bytes | None]) -> Words:
        texts = [t or b"" for t in texts]
        buf = b"\n".join(texts) + b"\n"
        codes = np.frombuffer(buf, np.uint8)
        space = self.space[codes]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edges = np.concatenate([[0], edges])
        starts, ends = edges[::2], edges[1::2]
        hashes = self.numbers(codes, starts, ends)
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(length)]))
        return Words(hashes, starts, ends, first, buf)

    def numbers(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the byte spans; both arrays rise."""
        hashes = np.empty(len(starts), U64)
        at = 0
        while at < len(starts):
            base = starts[at]
            to = int(np.searchsorted(ends, base + self.piece, "right"))
            if to <= at:  # a word longer than a piece
                hashes[at] = self._long(codes[base : ends[at]])
                at += 1
                continue
            sums = np.zeros(ends[to - 1] - base + 1, U64)
            np.cumsum((codes[base : ends[to - 1]].astype(U64) + U64(1)) * self.power[: len(sums) - 1], out=sums[1:])
            lo = starts[at:to] - base
            hashes[at:to] = (sums[ends[at:to] - base] - sums[lo]) * self.inverse[lo]
            at = to
        return mix(hashes)

    def _long(self, codes: np.ndarray) -> np.uint64:
        total = 0
        for at in range(0, len(codes), self.piece):
            part = codes[at : at + self.piece].astype(U64) + U64(1)
            total += int((part * self.power[: len(part)]).sum()) * pow(BASE, at, 1 << 64)
        return U64(total % (1 << 64))


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, list]]:
    """Ranges of rows of about ``most`` bytes of text, and their texts; a longer text stands alone."""
    length = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    total = np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()
        lo = hi


def windows(hashes: np.ndarray, first: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all runs of ``k`` words inside a text, their first words, and where each text's runs begin.

    With ``short``, a text of fewer than ``k`` words, but at least one, has one run: the whole text.
    """
    n = len(hashes)
    counts = np.diff(first)
    length = np.full(len(counts), k)
    if short:
        length = np.where((counts > 0) & (counts < k), counts, k)
    runs = np.maximum(counts - length + 1, 0)
    begin = np.concatenate([[0], np.cumsum(runs)])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], runs)
    size = np.repeat(length, runs)
    out = mix(size.astype(U64) * U64(BASE))
    padded = np.concatenate([hashes, np.zeros(k, U64)]) if n else np.zeros(k, U64)
    for step in range(k):
        inside = padded[at + step]
        if short:
            inside = np.where(size > step, inside, U64(0))
        out = out * U64(BASE) + inside
    return mix(out), at, begin


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker, so later tasks of the worker find it filled.

    A worker keeps the state of one operator at a time; that of the one before is dropped and its memory given back.
    """
    module = sys.modules.setdefault("graphloom_worker_state", types.ModuleType("graphloom_worker_state"))
    states = module.__dict__.setdefault("states", {})
    if name not in states:
        states.clear()
        states[name] = {}
        give_back()
    return states[name]


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library gives it back by itself


def checksum(numbers: np.ndarray) -> bytes:
    """128 bits that tell sorted sets of 64-bit numbers apart."""
    index = np.arange(1, len(numbers) + 1, dtype=U64)
    a = (mix(numbers ^ (index * U64(BASE)))).sum(dtype=U64)
    b = (mix(numbers + index * U64(0xD6E8FEB86659FD93)) * (U64(2) * index + U64(1))).sum(dtype=U64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")
