"""Signatures packed into longs, a lane for each hash function, and their Hamming distance in plain expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

#: By the bits of a lane: the shifts that fold a lane into its lowest bit, and the mask of those bits.
FOLDS = {16: ((8, 4, 2, 1), 0x0001000100010001), 8: ((4, 2, 1), 0x0101010101010101)}


def lanes_apart(x, y, bits: int):
    """How many lanes of two longs differ."""
    shifts, mask = FOLDS[bits]
    folded = x.bitwiseXOR(y)
    for k in shifts:
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, k))
    return F.bit_count(folded.bitwiseAND(F.lit(mask)))


def distance(pairs: list[tuple], bits: int):
    """Differing lanes over pairs of longs."""
    return reduce(lambda a, b: a + b, (lanes_apart(x, y, bits) for x, y in pairs))


def lane_mask(lane: int, bits: int = 16) -> int:
    """A long with the bits of all lanes but one, as a signed number."""
    value = ((1 << 64) - 1) ^ (((1 << bits) - 1) << (bits * lane))
    return value - (1 << 64) if value >= 1 << 63 else value
