"""What the tokenizers share: maps over whole arrays, and a worker's memory of pieces that it has encoded before."""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, compress, count

import numpy as np

from regionspark.llm.common import mix

#: Entries of a worker's memory of pieces; it is emptied when full, so results never depend on it.
PIECES = 160_000
#: Characters of text whose pieces are gathered before new ones are encoded together.
GATHER = 1 << 20


class Lookup:
    """An unchanging map of distinct 64-bit keys to 32-bit values (0 or more) for whole arrays: -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.keys, self.values = np.uint64(size - 1), np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), (mix(keys) & self.mask).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.values[at] < 0)
            _, one = np.unique(at[free], return_index=True)  # of those that want a slot, one gets it
            got = free[one]
            self.keys[at[got]], self.values[at[got]] = keys[left[got]], values[left[got]]
            rest = np.delete(np.arange(len(left)), got)
            left, at = left[rest], (at[rest] + 1) & int(self.mask)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = (mix(keys) & self.mask).astype(np.int64)
        out = self.values[at]
        on = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(on):
            at[on] = (at[on] + 1) & int(self.mask)
            out[on] = self.values[at[on]]
            on = on[(out[on] >= 0) & (self.keys[at[on]] != keys[on])]
        return out


class Memory:
    """Splits texts with pieces() and encodes the pieces not met before with encode_many(), many at a time."""

    def pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        raise NotImplementedError

    def forget(self) -> None:
        """Empty the memory of pieces: piece to number, and by number where its ids are and how often it was met."""
        self.numbers, self.flat, self.at, self.met = defaultdict(count().__next__), np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def forget_rare(self) -> None:
        """Keep the half of the memory that was met most often."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: PIECES // 2])
        wanted = np.zeros(len(self.met), bool)
        wanted[keep] = True
        old, counts, met = list(compress(self.numbers, wanted.tolist())), np.diff(self.at)[keep], self.met[keep]
        flat = self.flat[np.repeat(self.at[keep] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        self.forget()
        self.numbers.update(zip(old, map(lambda _: self.numbers.default_factory(), old)))
        self.flat, self.at, self.met = flat, np.concatenate([[0], np.cumsum(counts)]), met // 2

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the pieces not met before are encoded together."""
        out, i = [], 0
        while i < len(texts):
            split, size = [], 0
            while i < len(texts) and size < GATHER:
                split.append(self.pieces(texts[i] or ""))
                size += len(texts[i] or "")
                i += 1
            if len(self.numbers) > PIECES:
                self.forget_rare()
            known, lengths = len(self.numbers), np.fromiter(map(len, split), np.int64, len(split))
            number = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, lengths.sum())
            flat, counts = self.encode_many(list(self.numbers)[known:])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, flat])
            self.met = np.append(self.met, np.zeros(len(counts), np.int64)) + np.bincount(number, minlength=len(self.numbers))
            first, many = self.at[number], self.at[number + 1] - self.at[number]
            ends = np.concatenate([[0], np.cumsum(many)])
            ids = self.flat[np.repeat(first - ends[:-1], many) + np.arange(ends[-1])].astype("<u4").tobytes()
            bounds = (4 * ends[np.concatenate([[0], np.cumsum(lengths)])]).tolist()
            out += [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_texts([text])[0]
