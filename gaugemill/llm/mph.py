"""A minimal perfect hash in numpy: levels of bit arrays in which a key owns a bit if no other key of
its level hits it; keys that collide go on to the next level. A key's slot is the rank of its bit."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def key_words(digests: np.ndarray) -> np.ndarray:
    """n x 32 bytes to one 64-bit word each, of all their bytes."""
    w = np.ascontiguousarray(digests).view("<u8")
    out = w[:, 0].copy()
    for i in range(1, w.shape[1]):
        out = mixed(out, i) ^ w[:, i]
    return out


class PerfectHash:
    """``sizes``: bits of each level; ``bits``: all levels' bits as bytes of 0 and 1, packed when stored."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        """``keys``: distinct 64-bit words."""
        sizes, levels, level = [], [], 0
        while len(keys):
            m = max(8, int(len(keys) * gamma))
            at = (mixed(keys, level + 1) % _U(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(alone)
            keys, level = keys[~alone[at]], level + 1
            if level > 200:
                raise ValueError("keys are not distinct")
        return cls(sizes, np.concatenate(levels).astype(np.uint8) if levels else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each member; of others some slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(rest):
                break
            at = (mixed(keys[rest], level + 1) % _U(m)).astype(np.int64) + self.starts[level]
            hit = self.bits[at] == 1
            out[rest[hit]] = self.rank[at[hit]]
            rest = rest[~hit]
        return out

    def packed(self) -> tuple[list[int], bytes]:
        return self.sizes, np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, sizes: list[int], bits: bytes) -> PerfectHash:
        n = int(sum(sizes))
        return cls(list(sizes), np.unpackbits(np.frombuffer(bits, np.uint8), count=n) if n else np.zeros(0, np.uint8))
