"""Edit distance of many pairs of texts at once, by bit vectors on Arrow buffers.

Common ends are cut off first, which ends most pairs of like texts. Of the rest the shorter text stands upright in blocks of
64 characters, each a pair of bit vectors of vertical differences; a step moves every open block of every pair one column
on. A block depends on the one above it in the same column, so block b is one column behind block b - 1 and all blocks of a
step are independent. Only blocks within `bound` diagonals are open; a distance of at most the bound is exact, other pairs
are done again with the bound doubled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of a group of pairs (its texts side by side); a longer pair is a group of its own.
CELLS = 1 << 21
#: The first bound, in diagonals. A step works on OPEN blocks in nearly the time of one, so few pairs get a wider bound.
BOUND, OPEN = 64, 128
_ONE, _ALL = np.uint64(1), ~np.uint64(0)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and where each begins (with the end of all)."""
    rows = texts.to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    return np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), starts


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places starts[k] .. starts[k] + sizes[k] - 1 of all k, and where each k begins among them."""
    begin = np.cumsum(sizes) - sizes
    return np.repeat(starts - begin, sizes) + np.arange(sizes.sum()), begin


def _alike(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, sizes: np.ndarray, step: int) -> np.ndarray:
    """How many of `sizes` characters agree from a_at and b_at on, forwards or (step -1) backwards."""
    out = sizes.copy()
    some = np.flatnonzero(sizes)
    if len(some):
        offset, begin = _spread(np.zeros(len(some), np.int64), sizes[some])
        own = np.repeat(some, sizes[some])
        differ = np.flatnonzero(a[a_at[own] + step * offset] != b[b_at[own] + step * offset])
        first = np.searchsorted(differ, begin)
        hit = first < len(differ)
        at = differ[np.minimum(first, max(len(differ) - 1, 0))] if len(differ) else np.zeros(len(some), np.int64)
        hit &= at < begin + sizes[some]
        out[some[hit]] = (at - begin)[hit]
    return out


def _bounds(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, n: np.ndarray, m: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the distance of some pairs is at most, by character for character from the front or from the back, and at least, by
    the characters that one text has more of than the other. Most pairs of a text and its edited copy meet."""
    most, least = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
    ends = np.cumsum(n[some] + m[some])
    begin = 0
    while begin < len(some):  # groups of CELLS characters, for the memory of their counts
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CELLS, "right")))
        own = some[begin:end]
        short = np.minimum(n[own], m[own])
        differ = []
        for shift_a, shift_b in ((0, 0), (n[own] - short, m[own] - short)):
            x, first = _spread(a_at[own] + shift_a, short)
            y, _ = _spread(b_at[own] + shift_b, short)
            differ.append(np.add.reduceat((a[x] != b[y]).astype(np.int64), first))
        most[begin:end] = np.abs(n[own] - m[own]) + np.minimum(*differ)
        (x, _), (y, _), pair = _spread(a_at[own], n[own]), _spread(b_at[own], m[own]), np.arange(len(own))
        keys, at = np.unique(np.concatenate([np.repeat(pair, n[own]) << 21 | a[x], np.repeat(pair, m[own]) << 21 | b[y]]), return_inverse=True)
        more = np.bincount(at[: len(x)], minlength=len(keys)) - np.bincount(at[len(x) :], minlength=len(keys))
        sides = [np.bincount(keys >> 21, np.maximum(d, 0), len(own)) for d in (more, -more)]
        least[begin:end] = np.maximum(*sides).astype(np.int64)
        begin = end
    return most, least


def distances(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Edit distance of each pair of texts, neither of which is null."""
    (a, a0), (b, b0) = _points(left), _points(right)
    n, m = np.diff(a0), np.diff(b0)
    head = _alike(a, b, a0[:-1], b0[:-1], np.minimum(n, m), 1)
    tail = _alike(a, b, a0[1:] - 1, b0[1:] - 1, np.minimum(n, m) - head, -1)
    n, m = n - head - tail, m - head - tail
    out = np.maximum(n, m)
    open_ = np.flatnonzero(np.minimum(n, m) > 0)
    most, least = _bounds(a, b, a0[:-1] + head, b0[:-1] + head, n, m, open_)
    out[open_] = most
    open_ = open_[most > least]
    swap = n[open_] < m[open_]  # the longer one lies along the columns
    texts = np.concatenate([a, b])
    at_a, at_b = a0[:-1][open_] + head[open_], len(a) + b0[:-1][open_] + head[open_]
    long, short = np.where(swap, at_b, at_a), np.where(swap, at_a, at_b)
    n, m = np.maximum(n, m)[open_], np.minimum(n, m)[open_]
    bound = BOUND << np.maximum(0, np.ceil(np.log2(np.maximum(n - m, 1) / BOUND))).astype(np.int64)
    left_ = np.arange(len(open_))
    k = BOUND
    while len(left_):
        for group in _groups(left_[bound[left_] <= k], n, m):
            wide = max(k, 64 * (OPEN // len(group)))
            found = _group(texts, long[group], n[group], short[group], m[group], wide)
            out[open_[group]] = found
            bound[group] = np.where((found <= wide) | (wide >= n[group]), 0, 2 * k)
        left_ = left_[bound[left_] > 0]
        k *= 2
    return out


def _groups(some: np.ndarray, n: np.ndarray, m: np.ndarray):
    """Pairs of much the same number of blocks, CELLS cells together, those that end last first."""
    some = some[np.argsort(m[some], kind="stable")]
    blocks = (m[some] + 63) // 64
    i = 0
    while i < len(some):
        j = int(np.searchsorted(blocks, blocks[i] + max(1, blocks[i] // 4), "left"))
        cells = np.maximum.accumulate(n[some[i:j]] + 64 * blocks[i:j]) * np.arange(1, j - i + 1)
        j = i + max(1, int(np.searchsorted(cells, CELLS, "right")))
        yield some[i:j][np.argsort(-(n[some[i:j]] + blocks[i:j]), kind="stable")]
        i = j


def _matches(texts: np.ndarray, short: np.ndarray, m: np.ndarray, long: np.ndarray, n: np.ndarray, w: int):
    """codes: the columns' characters as numbers, a row per column (0: not in its pair's upright text), and a function from
    numbers and blocks to the bits at which the upright text has that character."""
    at, begin = _spread(short, m)
    pair = np.repeat(np.arange(len(m)), m)
    places = np.arange(len(at)) - begin[pair]
    chars, number = np.unique(pair << 21 | texts[at], return_inverse=True)
    key = (number + 1) * w + places // 64
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    masks = np.bitwise_or.reduceat(_ONE << (places[order] % 64).astype(np.uint64), first)
    at, begin = _spread(long, n)
    pair = np.repeat(np.arange(len(n)), n)
    wanted = pair << 21 | texts[at]
    found = np.minimum(np.searchsorted(chars, wanted), len(chars) - 1)
    codes = np.zeros((int(n.max()), len(n)), np.int64)
    codes[np.arange(len(at)) - begin[pair], pair] = np.where(chars[found] == wanted, found + 1, 0) * w
    if (len(chars) + 1) * w <= 2 * CELLS:
        table = np.zeros((len(chars) + 1) * w, np.uint64)
        table[keys] = masks
        return codes, lambda wanted: table[wanted]

    def sparse(wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, masks[at], np.uint64(0))

    return codes, sparse


def _group(texts: np.ndarray, long: np.ndarray, n: np.ndarray, short: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Distances of pairs, those that end last first; exact where they are at most k. Blocks below a pair's own last one
    are worked on for nothing."""
    own_last = (m - 1) // 64
    w, pairs, columns, ends = int(own_last.max()) + 1, len(n), int(n.max()), n + own_last
    codes, match = _matches(texts, short, m, long, n, w)
    up, down = np.full((w, pairs), _ALL), np.zeros((w, pairs), np.uint64)
    out_up, out_down = np.zeros((w, pairs), np.uint64), np.zeros((w, pairs), np.uint64)  # a block's difference at its lower edge
    score = np.minimum(64 * (np.arange(w)[:, None] + 1), m[None, :])
    edges = np.full((w, pairs), np.uint64(63))
    edges[own_last, np.arange(pairs)] = (m - 1) % 64
    result, size = np.zeros(pairs, np.int64), pairs
    top = -1  # the lowest block that has been opened
    before = 0  # the first open block of the step before
    for s in range(int(ends[0]) + 1):
        ended = size
        size = int(np.searchsorted(-ends, -s, "left"))  # those that end later
        if size < ended:
            gone = np.arange(size, ended)
            result[gone] = score[own_last[gone], gone]
        if not size:
            break
        lo, hi = max(0, s - columns + 1, -((63 + k - s) // 65)), min(w - 1, s, (s + k) // 65)
        if hi > top:
            if 64 * hi > k:  # a block opens late: below the one above it as that was a column ago, every difference +1
                above = hi - 1
                rows = np.minimum(64, m[:size] - 64 * hi)
                score[hi, :size] = score[above, :size] - out_up[above, :size].astype(np.int64) + out_down[above, :size].astype(np.int64) + rows
            top = hi
        own = slice(lo, hi + 1)
        b = np.arange(lo, hi + 1)
        in_up, in_down = np.ones((len(b), size), np.uint64), np.zeros((len(b), size), np.uint64)
        skip = int(lo == 0 or lo - 1 < before)  # nothing known above: difference +1
        if len(b) > skip:
            in_up[skip:], in_down[skip:] = out_up[lo - 1 + skip : hi, :size], out_down[lo - 1 + skip : hi, :size]
        eq = match(codes[s - b, :size] + b[:, None])
        v, neg = up[own, :size], down[own, :size]
        vertical = eq | neg
        eq |= in_down
        horizontal = (((eq & v) + v) ^ v) | eq
        plus, minus = neg | ~(horizontal | v), v & horizontal
        edge = edges[own, :size]
        o_up, o_down = (plus >> edge) & _ONE, (minus >> edge) & _ONE
        plus, minus = plus << _ONE | in_up, minus << _ONE | in_down
        up[own, :size], down[own, :size] = minus | ~(vertical | plus), plus & vertical
        out_up[own, :size], out_down[own, :size] = o_up, o_down
        score[own, :size] += o_up.astype(np.int64) - o_down.astype(np.int64)
        before = lo
    return result


def edit_distance(a: Column, b: Column) -> Column:
    """Least number of insertions, deletions and replacements of code points; null if one of the texts is null."""

    @F.arrow_udf(T.IntegerType())
    def measured(left: pa.Array, right: pa.Array) -> pa.Array:
        out = np.zeros(len(left), np.int32)
        both = left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False)
        some = pa.array(both)
        out[both] = distances(left.filter(some), right.filter(some))
        return pa.array(out, mask=~both)

    return measured(a, b)
