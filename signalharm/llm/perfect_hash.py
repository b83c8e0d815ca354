"""A minimal perfect hash of distinct 64-bit keys: cascading bitmaps with ranks.

On each level every key left hashes to a bit; keys that are alone on theirs stay
there, the others go on to the next level.  A key's number is the rank of its
bit.  Other keys get some number too, or none: look at the key at that number.
"""

import numpy as np

#: Bits of a level for each key left.
GAMMA = 2.0
A, B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    h = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * A
    h = (h ^ (h >> np.uint64(27))) * B
    return h ^ (h >> np.uint64(31))


def build(keys: np.ndarray) -> list[np.ndarray]:
    """The bitmaps (arrays of bool) of distinct keys, level by level."""
    left, levels = keys.astype(np.uint64), []
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        at = (mixed(left, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


def numbers(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The number of each key, from 0; -1 for keys that no level holds."""
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    keys = keys.astype(np.uint64)
    for level, alone in enumerate(levels):
        at = (mixed(keys[open_], level) % np.uint64(len(alone))).astype(np.int64)
        rank = base + np.cumsum(alone) - 1
        found = alone[at]
        out[open_[found]] = rank[at[found]]
        base, open_ = base + int(alone.sum()), open_[~found]
    return out


def packed(levels: list[np.ndarray]) -> tuple[list[int], bytes]:
    """Sizes of the levels and their bits."""
    return [len(x) for x in levels], np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool)).tobytes()


def unpacked(sizes: list[int], bits: bytes) -> list[np.ndarray]:
    whole = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
    return np.split(whole, np.cumsum(sizes)[:-1]) if sizes else []
