"""How many bits of a key each level of a radix partitioning takes.

The plan has two parts. The first tells n evenly spread keys apart until a leaf holds at most LEAF of them: it needs
ceil(log2(n / LEAF)) bits. The second serves keys that share those bits and takes the rest of the key. Each part has as
few levels as MOST_BITS allows, of even widths, wider ones first. Together they take every bit of the key once, so keys
that are still together after the last level are equal.
"""

from __future__ import annotations

from ..errors import StreamError

#: Keys that a leaf may hold, and bits that one level takes at most.
LEAF, MOST_BITS = 8, 8
WIDTHS = (8, 16, 32, 64)


def even(bits: int) -> list[int]:
    """Bits over as few levels as MOST_BITS allows."""
    levels = -(-bits // MOST_BITS)
    return [(bits + levels - 1 - k) // levels for k in range(levels)]


def plan_splits(n: int, key_bits: int = 64) -> list[int]:
    """Bit widths, first level first; empty if n keys fit a leaf."""
    if n < 0 or key_bits not in WIDTHS:
        raise StreamError("n must not be negative, key_bits 8, 16, 32 or 64")
    leaves = -(-n // LEAF)
    if leaves <= 1:
        return []
    front = min(key_bits, (leaves - 1).bit_length())
    return even(front) + even(key_bits - front)


def shifts(widths: list[int], key_bits: int = 64) -> list[int]:
    """The right shift of each level's digit, for a key in the high key_bits of its word's width."""
    ends = [sum(widths[: k + 1]) for k in range(len(widths))]
    return [max(0, key_bits - e) for e in ends]
