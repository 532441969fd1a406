"""Operator 11, SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. A round finds the lowest rank among the neighbouring pairs of each word
(one segmented minimum), merges the occurrences of it from the left, and compacts the array; it ends when no word has a pair
left. Words are cut where no piece of the vocabulary can reach across, so they merge independently.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionspark.llm.common import binaries, load, small_batches
from regionspark.llm.pieces import Lookup, Memory

SPACE = "▁"
# Fixed values of the model format: kinds of pieces, and the model type of byte-pair merges.
NORMAL, UNKNOWN, CONTROL, BYTE, BPE = 1, 2, 3, 6, 2
NEVER = np.iinfo(np.int32).max
#: Symbols that are merged together; a longer word is merged alone.
GROUP = 1 << 18
#: Rounds after which what is left (long words of many different merges) is finished by a heap, which costs n log n.
ROUNDS = 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        if key & 7 == 0:
            value, i = number(i)
        else:
            size, i = {1: (8, i), 5: (4, i)}.get(key & 7) or number(i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


def _bad_bytes(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("regionspark.bytes", _bad_bytes)


class Model(Memory):
    """A byte-pair model with byte fallback. One per Python worker and file.

    Symbols are numbers: a piece's id, len(pieces) and up for characters that occur in pieces only, and below zero for any
    other character (its code point, inverted), which no merge takes.
    """

    def __init__(self, path: str):
        pieces, trainer, normalizer = [], {}, {}
        with open(path, "rb") as f:
            for field, value in _fields(f.read()):
                if field == 1:
                    one = dict(_fields(value))
                    pieces.append((one[1].decode(), struct.unpack("<f", one.get(2, bytes(4)))[0], one.get(3, NORMAL)))
                elif field in (2, 3):
                    (trainer if field == 2 else normalizer).update(_fields(value))
        normal = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.byte_id = np.array([i for i, (_, _, kind) in enumerate(pieces) if kind == BYTE], np.int32)
        plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1)
        if trainer.get(3) != BPE or len(self.byte_id) != 256 or not plain or {k for *_, k in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("needs a byte-pair model with byte fallback, a leading space and no other normalisation or user symbols")
        if any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:])):
            raise ValueError("a piece reaches over the start of a word")
        self.n = len(pieces)
        inner = sorted({c for p in normal if len(p) > 1 for c in p})
        symbol = dict(normal) | {c: self.n + k for k, c in enumerate(c for c in inner if c not in normal)}
        self.extra = np.array([ord(c) for c in symbol if symbol[c] >= self.n], np.int64)
        self.of_char = np.full(0x110000, NEVER, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        missing = np.flatnonzero(self.of_char == NEVER)
        self.of_char[missing] = ~missing.astype(np.int32)
        best = {s: k for k, s in enumerate(sorted({-pieces[i][1] for i in normal.values()}))}
        splits = [(symbol[p[:k]], symbol[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        left, right, whole = (np.array(x, np.int64) for x in (zip(*splits) if splits else ([], [], [])))
        self.merged = Lookup((left << 32 | right).astype(np.uint64), whole.astype(np.int32))
        self.rank = np.full(self.n + 1, NEVER, np.int32)  # of what a merge makes; the last entry is for no merge (-1)
        for i in normal.values():
            self.rank[i] = best[-pieces[i][1]]
        letters = re.escape("".join(c for c in inner if c != SPACE))
        self.pattern = re.compile(rf" *[{letters}]+| +|[^{letters} ]+" if letters else r" +|[^ ]+")
        surface = [bytes([self.byte_id.tolist().index(i)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for i, (p, _, kind) in enumerate(pieces)]
        self.size_of = np.array([len(b) for b in surface], np.int64)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.letters = np.frombuffer(b"".join(surface), np.uint8)
        self.spaced = np.array([kind == NORMAL and p.startswith(SPACE) for p, _, kind in pieces], bool)
        self.forget()

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(" " + text.replace(SPACE, " ")) if text else []

    # --- merging ---

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of symbols becomes (-1: nothing), and its rank."""
        out = self.merged(left.astype(np.int64).astype(np.uint64) << np.uint64(32) | right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        out[(left < 0) | (right < 0)] = -1
        return out, self.rank[out]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of all words, and how many each word has."""
        sym = self.of_char[np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        own, done, rounds = np.repeat(np.arange(len(words)), counts), [], 0
        makes, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), NEVER, np.int32)
        inside = np.flatnonzero(own[1:] == own[:-1])
        makes[inside], rank[inside] = self.pairs(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sizes = np.diff(np.append(starts, len(sym)))
            lowest = np.minimum.reduceat(rank, starts)
            live = np.repeat(lowest < NEVER, sizes)
            if not live.all():
                done.append((own[~live], sym[~live]))
                sym, own, makes, rank = sym[live], own[live], makes[live], rank[live]
                sizes, lowest = sizes[lowest < NEVER], lowest[lowest < NEVER]
                if not len(sym):
                    break
            if rounds == ROUNDS:
                ends = np.cumsum(sizes)
                rest = [np.array(self.finished(sym[a:b].tolist()), np.int32) for a, b in zip(ends - sizes, ends)]
                done.append((np.repeat(own[ends - 1], [len(x) for x in rest]), np.concatenate(rest)))
                break
            sym, own, makes, rank = self.round(sym, own, makes, rank, np.repeat(lowest, sizes))
            rounds += 1
        if not done:
            return np.zeros(0, np.int32), counts
        word, sym = np.concatenate([w for w, _ in done]), np.concatenate([s for _, s in done])
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(words))

    def round(self, sym: np.ndarray, own: np.ndarray, makes: np.ndarray, rank: np.ndarray, lowest: np.ndarray) -> tuple[np.ndarray, ...]:
        """One round: in each word the occurrences of its lowest rank are merged from the left, those that overlap one before
        left out. The library merges one at a time, so a word's round ends with the first occurrence whose merge makes a
        pair of this rank or a lower one, as that pair would come before the next occurrence."""
        at = np.flatnonzero(rank == lowest)
        new_run = np.concatenate([[True], at[1:] != at[:-1] + 1])
        first = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        word, end = own[at], len(sym) - 1
        if (word[1:] == word[:-1]).any():
            before = np.maximum(at - 1, 0)
            beside = np.concatenate([[False], at[1:] == at[:-1] + 2])  # right after the occurrence before
            left = np.where(beside, np.concatenate([[0], makes[at[:-1]]]), sym[before])
            _, l_rank = self.pairs(left, makes[at])
            l_rank[(at == 0) | (own[before] != word)] = NEVER
            after = np.minimum(at + 2, end)
            _, r_rank = self.pairs(makes[at], sym[after])
            r_rank[(at + 2 > end) | (own[after] != word)] = NEVER
            stops = np.cumsum(np.minimum(l_rank, r_rank) <= rank[at])
            stops = np.concatenate([[0], stops[:-1]])  # before this occurrence
            of_word = np.maximum.accumulate(np.where(np.concatenate([[True], word[1:] != word[:-1]]), np.arange(len(at)), 0))
            at = at[stops == stops[of_word]]
        sym[at] = makes[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        new = place[at]
        sym, own, makes, rank = sym[keep], own[keep], makes[keep], rank[keep]
        touched = np.unique(np.concatenate([new, new[new > 0] - 1]))
        nxt = np.minimum(touched + 1, len(sym) - 1)
        made, worth = self.pairs(sym[touched], sym[nxt])
        apart = (nxt == touched) | (own[nxt] != own[touched])
        made[apart], worth[apart] = -1, NEVER
        makes[touched], rank[touched] = made, worth
        return sym, own, makes, rank

    def finished(self, sym: list[int]) -> list[int]:
        """One word's symbols merged to the end: lowest rank first, leftmost among equals, from a heap of pairs."""
        n = len(sym)
        left, right, size = list(range(-1, n - 1)), [*range(1, n), -1], [1] * n
        made, rank = self.pairs(np.array(sym[:-1], np.int32), np.array(sym[1:], np.int32))
        heap = [(r, i, i + 1, 2, m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist())) if m >= 0]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def add(a: int, b: int) -> None:
            if a < 0 or b < 0 or sym[a] < 0 or sym[b] < 0:
                return
            if (got := known.get((sym[a], sym[b]))) is None:
                m, r = self.pairs(np.array([sym[a]], np.int32), np.array([sym[b]], np.int32))
                got = known[sym[a], sym[b]] = (int(r[0]), int(m[0]))
            if got[1] >= 0:
                heapq.heappush(heap, (got[0], a, b, size[a] + size[b], got[1]))

        while heap:
            _, a, b, both, m = heapq.heappop(heap)
            if not size[a] or not size[b] or size[a] + size[b] != both:
                continue  # one of them has been merged since
            sym[a], size[a], size[b], right[a] = m, both, 0, right[b]
            if right[b] >= 0:
                left[right[b]] = a
            add(left[a], a)
            add(a, right[a])
        return [s for s, k in zip(sym, size) if k]

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has; characters without a piece become byte ids."""
        flat, counts, k = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        while k < len(pieces):
            first, size = k, 0
            while k < len(pieces) and (k == first or size + len(pieces[k]) <= GROUP):
                size += len(pieces[k])
                k += 1
            sym, n = self.symbols(pieces[first:k])
            odd = np.flatnonzero((sym < 0) | (sym >= self.n))
            if len(odd):
                points = np.where(sym[odd] < 0, ~sym[odd], self.extra[np.maximum(sym[odd] - self.n, 0)] if len(self.extra) else 0)
                coded = [self.byte_id[list(chr(p).encode())] for p in points.tolist()]
                times = np.ones(len(sym), np.int64)
                times[odd] = [len(c) for c in coded]
                n = np.bincount(np.repeat(np.arange(len(n)), n), times, minlength=len(n)).astype(np.int64)
                where = np.repeat((np.cumsum(times) - times)[odd], times[odd]) + np.concatenate([np.arange(len(c)) for c in coded])
                sym = np.repeat(sym, times)
                sym[where] = np.concatenate(coded)
            flat.append(sym)
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    # --- decoding ---

    def decode_many(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The text of each row ids[starts[k]:starts[k + 1]]: spaces for their mark, without the one that leads a text; each
        byte that is part of no character becomes U+FFFD."""
        size, begin = self.size_of[ids], self.start_of[ids]
        empty = np.concatenate([[0], np.cumsum(size == 0)])
        lead = starts[:-1].copy()
        while len(on := np.flatnonzero((lead < starts[1:]) & (empty[np.minimum(lead + 1, len(ids))] > empty[lead]))):
            lead[on] += 1  # past control symbols
        lead = lead[lead < starts[1:]]
        lead = lead[self.spaced[ids[lead]]]
        size[lead], begin[lead] = size[lead] - 1, begin[lead] + 1
        ends = np.concatenate([[0], np.cumsum(size)])
        packed = binaries(self.letters[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends[starts])
        try:
            return packed.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "regionspark.bytes") for b in packed.to_pylist()], pa.string())


@lru_cache(4)
def model(path: str) -> Model:
    return Model(path)


def _path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs with `out`: array<int>, the text's piece ids, without begin or end ids.

    Null and empty texts give an empty array. Long texts are encoded whole. Rows are independent: ties, repeated rows and
    empty tables need no rule; a column already named `out` is replaced. path: a model file that every executor can open.
    No shuffle.
    """
    path = _path(path)
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pa.Array) -> pa.Array:
        own, parts = model(path), []
        for k in range(0, len(texts), 500):
            coded = own.encode_texts(texts.slice(k, 500).to_pylist())
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with `out`: string, the text that the ids stand for; null ids, or none, give an empty text, null entries
    nothing. The library's marks come back as spaces, so a text that holds U+2581 itself comes back with a space there."""
    path = _path(path)

    @F.arrow_udf(T.StringType())
    def back(packed: pa.Array) -> pa.Array:
        own, parts = model(path), []
        for k in range(0, len(packed), 500):
            some = packed.slice(k, 500)
            counts = some.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            parts.append(own.decode_many(some.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return docs.withColumn(out, back(F.array_compact(F.col(ids))))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = decode(encode(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
