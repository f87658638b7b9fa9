"""A public byte-level BPE vocabulary as broadcastable tables.

The vocabulary file is read once on the driver; what is shipped to the tasks is bounded
by the vocabulary (50,256 entries, about 3 MB), never by the data.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass, field

import numpy as np

DEFAULT_VOCABULARY = os.path.join(
    os.environ.get("TOPOSPARK_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHAR = np.uint64(0xD6E8FEB86659FD93)
_LENGTH = np.uint64(0xA0761D6478BD642F)
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """``BASE ** i`` modulo 2**64 for i < n at least; grown on demand, shared by a worker."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 2 * len(_powers), 1024), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hash_spans(code_points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; spans must tile the array without gaps."""
    offset = np.arange(len(code_points), dtype=np.int64)
    offset -= np.repeat(starts, lengths)
    terms = (code_points.astype(np.uint64) + np.uint64(1)) * _CHAR
    terms ^= terms >> np.uint64(29)
    terms *= powers(int(lengths.max(initial=1)))[offset]
    return mix(np.add.reduceat(terms, starts) + lengths.astype(np.uint64) * _LENGTH)


@dataclass
class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: displacement per bucket, one slot per key."""

    displacement: np.ndarray
    keys: np.ndarray  # key in each slot
    values: np.ndarray  # value in each slot

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> PerfectHash:
        n = len(keys)
        buckets = max(1, n // 4)
        bucket = (mix(keys) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=buckets)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        displacement = np.zeros(buckets, dtype=np.uint32)
        taken = np.zeros(n, dtype=bool)
        slot_of = np.empty(n, dtype=np.int64)
        tries = np.arange(48, dtype=np.uint64)
        free: list[int] | None = None
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            members = order[first[b] : first[b] + sizes[b]]
            if sizes[b] == 1:  # a lone key takes any free slot, named directly
                if free is None:
                    free = np.flatnonzero(~taken).tolist()
                slot = free.pop()
                displacement[b] = np.uint32(0x80000000 | slot)
                taken[slot] = True
                slot_of[members[0]] = slot
                continue
            base = 0
            while True:
                slots = cls._slots(keys[members][:, None], tries[None, :] + np.uint64(base), n)
                good = ~taken[slots].any(axis=0)
                if len(members) > 1:
                    ordered = np.sort(slots, axis=0)
                    good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                hit = int(np.argmax(good))
                if good[hit]:
                    break
                base += len(tries)
            displacement[b] = base + hit
            taken[slots[:, hit]] = True
            slot_of[members] = slots[:, hit]
        table, held = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        table[slot_of] = keys
        held[slot_of] = values
        return cls(displacement, table, held)

    @staticmethod
    def _slots(keys: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
        return (mix(keys ^ (displacement * _BASE)) % np.uint64(n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where the key is not in the table."""
        n = len(self.keys)
        if not n:
            return np.full(len(keys), -1, dtype=np.int64)
        d = self.displacement[(mix(keys) % np.uint64(len(self.displacement))).astype(np.int64)]
        direct = d >= np.uint32(0x80000000)
        slots = np.where(
            direct, (d & np.uint32(0x7FFFFFFF)).astype(np.int64), self._slots(keys, d.astype(np.uint64), n)
        )
        return np.where(self.keys[slots] == keys, self.values[slots], -1)


@dataclass
class Vocabulary:
    """Ranks by bytes, and a perfect hash from the hash of a token's text to its id."""

    ranks: dict[bytes, int]
    whole: PerfectHash
    text_of: dict[int, str] = field(repr=False)

    @classmethod
    def read(cls, path: str = DEFAULT_VOCABULARY) -> Vocabulary:
        """Reads a file of ``base64(token) rank`` lines."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        text_of = {}
        for token, rank in ranks.items():
            try:
                text_of[rank] = token.decode()
            except UnicodeDecodeError:
                continue  # a fragment of a character is never a whole pre-token
        texts = list(text_of.values())
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        keys = hash_spans(points, starts, lengths)
        return cls(ranks, PerfectHash.build(keys, np.fromiter(text_of, dtype=np.int64)), text_of)
