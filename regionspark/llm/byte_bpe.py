"""Operator 3, byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding: the token t whose remaining prefix
ends with a token p such that the bytes of p and t, merged on their own, give back p and t. Storing that last token for
each byte prefix gives the encoding by walking back from the end, keeps the table valid when bytes are appended, and
limits an edit to the pieces around it.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionspark.llm.common import binaries, load, mix, small_batches
from regionspark.llm.pieces import PIECES, Lookup, Memory

#: White space as the pattern's \s means it: the Unicode property, without the four ASCII separators that Python adds.
_SPACE = r"\p{White_Space}"
#: Texts of these characters alone are split by re, which is twice as fast; there the classes are plain ranges.
_OTHER = re.compile(r"[^\t-\r -~\xc0-\u024f]")
_LETTERS = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: Pieces up to so many bytes are encoded many at a time; slots of the memory of pairs of tokens.
SHORT, SLOTS = 64, 1 << 20
#: Pieces that are encoded at once; a power of two.
GROUP = 1 << 14


class Encoder(Memory):
    """Encodes pieces by ranks. One per Python worker and vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s+", _SPACE + "+"))
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\t-\r {_LETTERS}0-9]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")
        self.plain = re.compile(plain.replace(r"(?!\S)", r"(?![^\t-\r ])").replace(r"\s+", r"[\t-\r ]+"))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, int]]] = {}
        self._tables = None
        self.forget()

    @cached_property
    def ends(self) -> ahocorasick.Automaton:
        """All tokens that end at a place; only long pieces and prefix tables need it."""
        out = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            out.add_word(token.decode("latin-1"), (len(token), i))
        out.make_automaton()
        return out

    def pieces(self, text: str) -> list[str]:
        return (self.pattern if _OTHER.search(text) else self.plain).findall(text)

    def halves(self, piece: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge makes a token, found by merging lowest-ranked neighbours until two are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                raise ValueError("a token of the vocabulary cannot be reached by merges")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one edge of a token while it grows (side 0: left, 1: right), each with the rank of
        the merge that absorbs it; the whole token is never absorbed."""
        if (known := self.edges.get((token, side))) is None:
            known, part, until = [], self.tokens[token], 1 << 40
            while True:
                known.append((part, until))
                if (two := self.halves(part)) is None:
                    break
                until, part = self.ranks[part], two[side]
            self.edges[token, side] = known
        return known

    def fits(self, first: int, second: int) -> bool:
        """Whether no merge across the boundary comes before both sides are whole. Merges run in rank order, the
        leftmost first among equals, so an own merge of the left token wins a tie and one of the right token loses it."""
        key = (first, second)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 2 * PIECES:
                self.pairs.clear()
            rank, known = self.ranks.get, True
            for left, left_until in self.edge(first, 1):
                for right, right_until in self.edge(second, 0):
                    r = rank(left + right)
                    if r is not None and r < left_until and r <= right_until:
                        known = False
            self.pairs[key] = known
        return known

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The unique valid last token of each prefix; known: those of a prefix of the piece, which stay as they are."""
        last = [-1] * len(piece)
        last[: len(known or ())] = known or ()
        done, pairs = len(known or ()), self.pairs
        for end, (size, token) in self.ends.iter(piece.decode("latin-1")):
            if end < done or last[end] >= 0:
                continue
            if size > end:
                last[end] = token
                continue
            before = last[end - size]
            ok = pairs.get((before, token))
            if ok or ok is None and self.fits(before, token):
                last[end] = token
        if -1 in last:
            raise ValueError("the vocabulary lacks a byte")
        return last

    def walk(self, last: list[int] | np.ndarray) -> list[int]:
        out, end = [], len(last)
        while end:
            token = int(last[end - 1])
            out.append(token)
            end -= len(self.tokens[token])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk(self.last_tokens(piece))

    # --- many pieces at a time: the same tables for whole arrays ---

    def tables(self) -> None:
        """Trie of the tokens, mergeable pairs, token sizes, and the parts at both edges of a token (filled when needed)."""
        if self._tables:
            return
        nodes, ends, pairs, whole = {b"": 0}, {}, array("Q"), array("i")
        for token, i in self.ranks.items():
            for k in range(1, len(token) + 1):
                nodes.setdefault(token[:k], len(nodes))
            ends[nodes[token]] = i
            both = [self.ranks[token[:k]] << 32 | self.ranks[token[k:]] for k in range(1, len(token)) if token[:k] in self.ranks and token[k:] in self.ranks]
            pairs.extend(both)
            whole.extend([i] * len(both))
        keys = np.fromiter((nodes[n[:-1]] << 8 | n[-1] for n in nodes if n), np.uint64, len(nodes) - 1)
        self.child = Lookup(keys, np.arange(1, len(nodes), dtype=np.int32))
        self.token_of = np.full(len(nodes), -1, np.int32)
        self.token_of[list(ends)] = list(ends.values())
        self.merged = Lookup(np.frombuffer(pairs, np.uint64), np.frombuffer(whole, np.int32))
        most = max(self.tokens) + 1
        self.size_of = np.zeros(most, np.int64)
        for i, token in self.tokens.items():
            self.size_of[i] = len(token)
        self.start_of = np.concatenate([[0], np.cumsum(self.size_of)])
        self.letters = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(most)), np.uint8)
        self.chains = [np.full((most, 8), -1, np.int32) for _ in (0, 1)]  # right parts of a token, left parts of a token, whole first
        self.slots, self.fit = np.full(SLOTS, np.uint64(1 << 63), np.uint64), np.zeros(SLOTS, bool)
        self._tables = True

    def grown(self, tokens: np.ndarray, side: int) -> np.ndarray:
        """The parts that stand at one edge of each token while it grows, whole token first, -1 after the last."""
        for t in np.unique(tokens[self.chains[side][tokens, 0] < 0]).tolist():
            parts = [self.ranks[p] for p, _ in self.edge(t, 1 - side)]
            if len(parts) > self.chains[side].shape[1]:
                more = np.full((len(self.chains[side]), len(parts) - self.chains[side].shape[1]), -1, np.int32)
                self.chains[side] = np.concatenate([self.chains[side], more], axis=1)
            self.chains[side][t, : len(parts)] = parts
        return self.chains[side][tokens]

    def fit_many(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """fits() for arrays of tokens; a part's limit is the token that it became part of."""
        key = first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        at = (mix(key) & np.uint64(SLOTS - 1)).astype(np.int64)
        out, new = self.fit[at], np.flatnonzero(self.slots[at] != key)
        if len(new):
            _, one, back = np.unique(key[new], return_index=True, return_inverse=True)
            a, b = self.grown(first[new][one], 0), self.grown(second[new][one], 1)
            bad = np.zeros(len(one), bool)
            for i in range(a.shape[1]):
                for j in range(b.shape[1]):
                    on = np.flatnonzero((a[:, i] >= 0) & (b[:, j] >= 0) & ~bad)
                    if not len(on):
                        break
                    m = self.merged(a[on, i].astype(np.uint64) << np.uint64(32) | b[on, j].astype(np.uint64))
                    hit = m >= 0
                    hit &= True if i == 0 else m < a[on, i - 1]
                    hit &= True if j == 0 else m <= b[on, j - 1]
                    bad[on[hit]] = True
            out[new] = ~bad[back]
            self.slots[at[new]] = key[new]
            self.fit[at[new]] = out[new]
        return out

    def last_tokens_many(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The last token of each prefix of each piece; data: the pieces' bytes, starts: their places in it and its end."""
        self.tables()
        size = np.diff(starts)
        place = np.arange(len(data)) - np.repeat(starts[:-1], size)
        stop = np.repeat(starts[1:], size)
        place, found, at, node, length = place.astype(np.uint8), [], np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(at):  # walk the trie from every byte at once
            node = self.child(node.astype(np.uint64) << np.uint64(8) | data[at + length].astype(np.uint64))
            on = node >= 0
            at, node = at[on], node[on]
            length += 1
            whole = self.token_of[node]
            ok = np.flatnonzero(whole >= 0)
            found.append((at[ok], np.full(len(ok), length - 1), whole[ok]))
            on = at + length < stop[at]
            at, node = at[on], node[on]
        begin, length, token = (np.concatenate(x) for x in zip(*found))
        end = begin + length
        order = np.argsort(place[end], kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(place[end]))])
        last = np.full(len(data), -1, np.int32)
        for lo, hi in zip(bounds[:-1], bounds[1:]):  # by length of the prefix
            b, e, t = begin[lo:hi], end[lo:hi], token[lo:hi]
            alone = place[b] == 0
            last[e[alone]] = t[alone]
            rest = np.flatnonzero(~alone)
            before = last[b[rest] - 1]
            ok = self.fit_many(before, t[rest])
            last[e[rest[ok]]] = t[rest[ok]]
        if (last < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        return last

    def encode_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each has."""
        coded = [p.encode() for p in pieces]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        counts, parts = np.zeros(len(coded), np.int64), []
        for k in range(0, len(coded), GROUP):
            long = {i: np.array(self.encode_piece(coded[i]), np.int32) for i in (k + np.flatnonzero(size[k : k + GROUP] > SHORT)).tolist()}
            own = np.setdiff1d(np.arange(k, min(k + GROUP, len(coded))), list(long))
            starts = np.concatenate([[0], np.cumsum(size[own])]).astype(np.int64)
            last = self.last_tokens_many(np.frombuffer(b"".join([coded[i] for i in own.tolist()]), np.uint8), starts)
            live, end, steps = np.arange(len(own)), starts[1:].copy(), []
            while len(live):  # walk back from the ends of all pieces
                t = last[end[live] - 1]
                steps.append((live, t))
                end[live] -= self.size_of[t]
                live = live[end[live] > starts[live]]
            n = np.bincount(np.concatenate([x for x, _ in steps]), minlength=len(own)) if steps else np.zeros(0, np.int64)
            flat, ends = np.empty(n.sum(), np.int32), np.cumsum(n)
            for step, (live, t) in enumerate(steps):
                flat[ends[live] - 1 - step] = t
            if long:
                flat = np.split(flat, ends[:-1])
                both = dict(zip(own.tolist(), flat)) | long
                flat, counts[list(long)] = np.concatenate([both[i] for i in sorted(both)]), [len(x) for x in long.values()]
            counts[own] = n
            parts.append(flat)
        return np.concatenate([np.zeros(0, np.int32), *parts]), counts

    def decode_many(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each id's bytes start (with the end of all)."""
        self.tables()
        size = self.size_of[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        return self.letters[np.repeat(self.start_of[ids] - ends[:-1], size) + np.arange(ends[-1])], ends

    def decode(self, ids: bytes) -> bytes:
        return self.decode_many(np.frombuffer(ids, "<u4").astype(np.int64))[0].tobytes()

    def prefixes(self, text: str) -> bytes:
        """For each byte of the text the last token of its piece's prefix that ends there."""
        return np.array([t for p in self.pieces(text) for t in self.last_tokens(p.encode())], "<u4").tobytes()

    def edited(self, text: str, prefixes: bytes, start: int, end: int, new: str) -> tuple[str, bytes]:
        """Text and table after text[start:end] became new (code points); an append has start = end = len(text).

        Pieces that end before the edit keep their entries, but for the last two (the pattern looks ahead by one
        character and a piece may grow); after the edit the old table is used again from the first old piece boundary
        that is a boundary of the new text too, as splitting goes on alike from there.
        """
        table = np.frombuffer(prefixes, "<u4")
        after = text[:start] + new + text[end:]
        bounds = [m.end() for m in self.pattern.finditer(text)]
        before = [b for b in bounds if b <= start]
        resume = before[-3] if len(before) >= 3 else 0
        shift = len(new) - (end - start)
        olds, out, at = set(bounds), [table[: len(text[:resume].encode())]], resume
        for m in self.pattern.finditer(after, resume):
            out.append(np.array(self.last_tokens(m.group().encode()), "<u4"))
            at = m.end()
            if at - shift >= end and at - shift in olds:
                break
        rest = len(after[at:].encode())
        out.append(table[len(table) - rest :])
        return after, np.concatenate(out).astype("<u4").tobytes()


@lru_cache(4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _vocabulary(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path and pattern:
        return path, pattern
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with `out`: binary, the text's token ids as little-endian unsigned 32-bit integers (4 bytes a token).

    Null and empty texts give no ids (an empty binary). Long texts are encoded whole. Rows are independent: ties,
    repeated rows and empty tables need no rule; a column already named `out` is replaced. path: a rank file that
    every executor can open. No shuffle.
    """
    path, pattern = _vocabulary(path, pattern)
    small_batches(docs.sparkSession)

    @F.arrow_udf(T.BinaryType())
    def ids(texts: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        return pa.concat_arrays([pa.array([], pa.binary()), *[pa.array(own.encode_texts(texts.slice(k, 500).to_pylist()), pa.binary()) for k in range(0, len(texts), 500)]])

    return docs.withColumn(out, ids(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with `out`: binary, the bytes that the ids stand for; null ids give an empty binary."""
    path, pattern = _vocabulary(path, None)

    @F.arrow_udf(T.BinaryType())
    def back(packed: pa.Array) -> pa.Array:
        own, parts = encoder(path, pattern), []
        for k in range(0, len(packed), 500):
            some = packed.slice(k, 500).fill_null(b"").cast(pa.large_binary())
            starts = np.frombuffer(some.buffers()[1], np.int64)[some.offset : some.offset + len(some) + 1]
            flat = np.frombuffer(some.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]].view("<u4").astype(np.int64)
            letters, ends = own.decode_many(flat)
            parts.append(binaries(letters, ends[(starts - starts[0]) // 4]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return docs.withColumn(out, back(F.col(ids)))


def with_prefixes(docs: DataFrame, text: str = "text", out: str = "prefixes", path: str | None = None) -> DataFrame:
    """docs with `out`: binary, the last token of every byte prefix (4 bytes each), for later appends and edits."""
    path, pattern = _vocabulary(path, None)

    @F.pandas_udf(T.BinaryType())
    def table(texts: pd.Series) -> pd.Series:
        own = encoder(path, pattern)
        return pd.Series([own.prefixes(x or "") for x in texts], dtype=object)

    return docs.withColumn(out, table(F.col(text)))


def edit(docs: DataFrame, start: str, end: str, new: str, text: str = "text", prefixes: str = "prefixes", path: str | None = None) -> DataFrame:
    """docs with text[start:end] replaced by the column `new` (code points) and the prefix table brought up to date.
    Null text is empty, a null start is its end, a null end is the start and a null `new` is empty."""
    path, pattern = _vocabulary(path, None)

    @F.pandas_udf("text string, prefixes binary")
    def again(texts: pd.Series, tables: pd.Series, starts: pd.Series, ends: pd.Series, news: pd.Series) -> pd.DataFrame:
        own, rows = encoder(path, pattern), []
        for t, p, a, b, n in zip(texts, tables, starts, ends, news):
            t, n = t or "", n or ""
            a = len(t) if pd.isna(a) else min(max(int(a), 0), len(t))
            b = a if pd.isna(b) else min(max(int(b), a), len(t))
            rows.append(own.edited(t, p if t else b"", a, b, n))
        return pd.DataFrame(rows, columns=["text", "prefixes"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    done = docs.select(F.struct(row.alias("row"), again(text, prefixes, start, end, new).alias("new")).alias("both"))
    named = {text: "both.new.text", prefixes: "both.new.prefixes"}
    return done.select(*[F.col(named.get(c, f"both.row.`{c}`")).alias(c) for c in docs.columns])


def ids_of(docs: DataFrame, prefixes: str = "prefixes", text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """docs with `out`: the packed ids read off the prefix table by walking back inside each piece."""
    path, pattern = _vocabulary(path, None)

    @F.pandas_udf(T.BinaryType())
    def walked(texts: pd.Series, tables: pd.Series) -> pd.Series:
        own, rows = encoder(path, pattern), []
        for t, p in zip(texts, tables):
            table, at, ids = np.frombuffer(p or b"", "<u4"), 0, []
            for piece in own.pieces(t or ""):
                n = len(piece.encode())
                ids += own.walk(table[at : at + n])
                at += n
            rows.append(np.array(ids, "<u4").tobytes())
        return pd.Series(rows, dtype=object)

    return docs.withColumn(out, walked(text, prefixes))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = decode(encode(docs).drop("text"))
    size = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
