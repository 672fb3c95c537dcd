"""Edit distances of many pairs at once: rows of the table of distances as bits of numbers, a batch of pairs side by side.

Spark's own distance works out each cell of a pair's table by itself; here 64 cells are one number (Myers' scheme, in
blocks by Hyyrö), and one numpy step does a column's block of all pairs of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Blocks of a batch, and numbers that its table of masks holds, at most (more only for one pair that has more).
BLOCKS, MOST = 8192, 1 << 20


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _batch(pairs: list[tuple[str, str]], letters: np.ndarray) -> np.ndarray:
    """Distances of pairs of texts, none empty, the first no shorter, in falling order of their steps (blocks and columns).

    Block w of a pair works off column j in step w + j, so that all blocks of all pairs go side by side; what a block hands
    down is there for the next in the next step. Before its first column a block stays as it is, as it gets zeros.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    blocks = -(-n // 64)
    first = np.cumsum(blocks) - blocks
    pair, unit = np.repeat(np.arange(len(pairs)), blocks), np.arange(int(blocks.sum()))
    w = unit - first[pair]
    size, none = len(letters) + 1, len(letters)
    # masks: where each letter stands in each block of the first text
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    owner = np.repeat(np.arange(len(pairs)), n)
    at = (first[owner] + place // 64) * size + np.searchsorted(letters, _codes([p[0] for p in pairs]))
    masks = np.zeros(len(unit) * size, np.uint64)
    np.add.at(masks, at, np.uint64(1) << (place % 64).astype(np.uint64))  # each bit once
    # the second texts, as many blanks before and behind as their pair has blocks
    room = m + 2 * blocks
    start = np.cumsum(room) - room
    flat = np.full(int(room.sum()), none)
    owner = np.repeat(np.arange(len(pairs)), m)
    flat[start[owner] + blocks[owner] + np.arange(len(owner)) - (np.cumsum(m) - m)[owner]] = np.searchsorted(letters, _codes([p[1] for p in pairs]))
    base, table = start[pair] + blocks[pair] - w, unit * size
    steps = m + blocks - 1
    going = np.searchsorted(-steps, -np.arange(int(steps[0])), side="left")  # pairs that go on at a step
    upto = np.append(first, len(unit))
    up, down = np.full(len(unit), ~np.uint64(0)), np.zeros(len(unit), np.uint64)
    given_plus, given_minus = np.zeros(len(unit) + 1, np.uint64), np.zeros(len(unit) + 1, np.uint64)
    one, top = np.uint64(1), np.uint64(63)
    last, bit, score = first + blocks - 1, ((n - 1) % 64).astype(np.uint64), n.astype(np.int64)
    for t in range(int(steps[0])):
        k = int(going[t])
        e = int(upto[k])
        u, d = up[:e], down[:e]
        eq = masks.take(flat.take(base[:e] + t) + table[:e])
        given_plus[first[:k]], given_minus[first[:k]] = one, 0  # a first block gets one a column
        vertical = eq | d
        eq |= given_minus[:e]
        diagonal = eq & u
        diagonal += u
        diagonal ^= u
        diagonal |= eq
        plus = diagonal | u
        np.invert(plus, plus)
        plus |= d
        minus = diagonal
        minus &= u
        score[:k] += (plus[last[:k]] >> bit[:k] & one).astype(np.int64) - (minus[last[:k]] >> bit[:k] & one).astype(np.int64)
        next_plus, next_minus = plus >> top, minus >> top
        plus <<= one
        plus |= given_plus[:e]
        minus <<= one
        minus |= given_minus[:e]
        np.bitwise_and(plus, vertical, out=d)
        vertical |= plus
        np.invert(vertical, vertical)
        np.bitwise_or(minus, vertical, out=u)
        given_plus[1 : e + 1], given_minus[1 : e + 1] = next_plus, next_minus
    return score


def distances(a: list[str | None], b: list[str | None]) -> list[int | None]:
    """The edit distance of each pair, by characters; null if either is null."""
    out: list[int | None] = [None] * len(a)
    left = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        if x is None or y is None:
            continue
        if len(x) < len(y):
            x, y = y, x
        if not y or x == y:
            out[k] = 0 if y else len(x)
        else:
            left.append((len(y) - (-len(x) // 64) - 1, -(-len(x) // 64), k, x, y))
    left.sort(key=lambda p: -p[0])
    held: list[tuple] = []

    def flush() -> None:
        while held:
            letters = np.unique(_codes([p[3] + p[4] for p in held]))
            most, total, part = MOST // (len(letters) + 1), 0, 0
            while part < len(held) and (not part or total + held[part][1] <= most):
                total, part = total + held[part][1], part + 1
            for p, v in zip(held[:part], _batch([p[3:] for p in held[:part]], letters).tolist(), strict=True):
                out[p[2]] = v
            del held[:part]

    total = 0
    for p in left:
        if held and total + p[1] > BLOCKS:
            flush()
            total = 0
        held.append(p)
        total += p[1]
    flush()
    return out


@F.arrow_udf(IntegerType())
def _edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(distances(a.to_pylist(), b.to_pylist()), pa.int32())


def edits(a: Column | str, b: Column | str) -> Column:
    """The edit distance of two strings, as F.levenshtein; for many and long ones."""
    return _edits(a, b)
