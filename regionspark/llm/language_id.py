"""Operator 2, language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's labelled sample. A text is parsed against it greedily: each
phrase is the longest match from where the last one ended. Few phrases mean a close language.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from regionspark.llm.common import load, small_batches

#: The sample of labelled rows: documents a label, letters taken of each, most and fewest letters a label, and letters of all
#: labels between these two. Every label is learnt; more than LABELS of them are no languages, and an error.
DOCUMENTS, PER_DOCUMENT, LETTERS, FEWEST, ALL_LETTERS, LABELS = 200, 1000, 40_000, 1000, 400_000, 5000
#: Symbols that get a column in the table of next states; the others are looked up in a sorted list.
COLUMNS = 48
#: Long texts are parsed in windows of so many letters side by side; see _Parser.phrases.
WINDOW = 256
#: Scale of the score: bits per letter become odds at this rate.
SHARP = 8
LANES = 2048

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def symbols(text: str) -> np.ndarray:
    """Lower-cased letters as code points; every run of other characters is one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    codes = np.where(_letters()[codes], codes, 32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def automaton(text: np.ndarray) -> np.ndarray:
    """Transitions (state, symbol, next state) of the suffix automaton of a sequence; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in text.tolist():
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.array([(s, c, t) for s, own in enumerate(step) for c, t in own.items()], np.int32).reshape(-1, 3)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", documents: int = DOCUMENTS, per_document: int = PER_DOCUMENT, letters: int = LETTERS) -> list[tuple[str, int, bytes]]:
    """A model per label: (label, letters learnt, packed transitions). Rows without text or label teach nothing.

    The sample is bounded: of each label the `documents` rows with the lowest hashes of their key (a filter by hash that
    keeps about twice as many comes first, so no label gathers in one task); of each row a span of per_document symbols
    from a place that its hash decides; `letters` a label, and fewer, but FEWEST at least, where the labels together would
    pass ALL_LETTERS. What reaches the driver is bounded by 3 transitions a letter. More than LABELS labels raise an error.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("turn"))
    top = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(LABELS + 1).collect()
    if len(top) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    counts = docs.sparkSession.createDataFrame(top, "lang string, n long")
    share = F.col("turn").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    some = rows.join(F.broadcast(counts), "lang").where(share * F.col("n") < 2 * documents + 20)
    first = F.row_number().over(W.partitionBy("lang").orderBy(share, "text"))
    some = some.withColumn("rank", first).where(F.col("rank") <= documents).select("lang", "rank", "turn", "text")
    most = min(letters, max(FEWEST, ALL_LETTERS // max(len(top), 1)))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for turn, t in pdf.sort_values("rank")[["turn", "text"]].itertuples(index=False):
            own = symbols(t)
            start = turn % max(len(own) - per_document + 1, 1)
            parts += [own[start : start + per_document], np.array([32], np.int32)]
        seen = np.concatenate(parts)[:most]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [len(seen)], "moves": [automaton(seen).tobytes()]})

    return sorted((r.lang, r.n, bytes(r.moves)) for r in some.groupBy("lang").applyInPandas(learn, "lang string, n long, moves binary").collect())


_NEW = 1 << 30


class _Parser:
    """All models in one table of next states: a column for each of the COLUMNS - 1 symbols that most transitions have, and
    sorted (state, symbol) keys for the other symbols, so a large alphabet does not widen the table. An entry with _NEW
    begins a phrase: the symbol that did not match is the first of the next one, or no part of any if the sample lacks it."""

    def __init__(self, models: list[tuple[str, int, bytes]]):
        moves, base = [], 0
        self.roots = []
        for _, _, packed in models:
            own = np.frombuffer(packed, np.int32).reshape(-1, 3).astype(np.int64)
            self.roots.append(base)
            own[:, [0, 2]] += base
            moves.append(own)
            base = int(own[:, [0, 2]].max(initial=base)) + 1
        own = np.concatenate([np.zeros((0, 3), np.int64), *moves])
        symbol, n = np.unique(own[:, 1], return_counts=True)
        usual = symbol[np.argsort(-n, kind="stable")[: COLUMNS - 1]]
        self.column = np.zeros(0x110000, np.uint8)  # 0: looked up in the sorted list
        self.column[usual] = np.arange(1, len(usual) + 1)
        root_of = np.repeat(np.array(self.roots, np.int64), np.diff(np.append(self.roots, base)).astype(np.int64)) if models else np.zeros(0, np.int64)
        self.root_of = root_of.astype(np.int32)
        table = np.full((base, COLUMNS), -1, np.int32)
        common = self.column[own[:, 1]] > 0
        table[own[common, 0], self.column[own[common, 1]]] = own[common, 2]
        for root, end in zip(self.roots, np.append(self.roots[1:], base).astype(np.int64)):
            again = np.where(table[root] >= 0, table[root], root) | _NEW
            part = table[root:end]
            np.copyto(part, again[None, :], where=part < 0)
        self.table = table.ravel()
        keys = own[~common, 0] << 21 | own[~common, 1]
        order = np.argsort(keys)
        self.keys, self.next = keys[order], own[~common, 2][order]

    def _rare(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        def find(s):
            key = s.astype(np.int64) << 21 | symbol
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            return np.where(self.keys[at] == key, self.next[at], -1) if len(self.keys) else np.full(len(key), -1)

        out, root = find(state), self.root_of[state]
        start = find(root)
        return np.where(out >= 0, out, np.where(start >= 0, start, root) | _NEW)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """(models, lanes) states and (lanes) symbols to entries."""
        column = self.column[symbol]
        entry = self.table[state * COLUMNS + column]
        if not column.all():
            rare = np.flatnonzero(column == 0)
            entry[:, rare] = self._rare(state[:, rare].ravel(), np.tile(symbol[rare], len(state))).reshape(len(state), -1)
        return entry

    def long_phrases(self, part: np.ndarray, lanes: int) -> np.ndarray:
        """phrases() of one text, (models, 1), in stretches of `lanes` windows that hand on each model's state."""
        total, came = np.zeros((len(self.roots), 1), np.int64), None
        for k in range(0, len(part), lanes * WINDOW):
            n, came = self.parsed([part[k : k + lanes * WINDOW]], came)
            total += n
        return total

    def phrases(self, parts: list[np.ndarray]) -> np.ndarray:
        """(models, texts): phrases of each text; a letter that a sample lacks ends one."""
        return self.parsed(parts)[0]

    def parsed(self, parts: list[np.ndarray], begun: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """phrases(), and the state of each model after the last text. begun: the states in which the one text goes on.

        All windows are parsed at once as if a phrase began with each. Then each window but a text's first is parsed again
        from where the window before ends, up to the first place at which both parses begin a phrase, as they are one from
        there on. In the rare window without such a place the next one follows letter by letter."""
        models = len(self.roots)
        cut = np.array([-(-len(p) // WINDOW) for p in parts])
        first = np.concatenate([[0], np.cumsum(cut)]).astype(np.int64)
        lanes = int(first[-1])
        grid, length = np.full(lanes * WINDOW, 32, np.int32), np.full(lanes, WINDOW)
        for p, a, b in zip(parts, first[:-1], first[1:]):
            grid[a * WINDOW : a * WINDOW + len(p)] = p
            length[b - 1] = len(p) - (b - a - 1) * WINDOW
        grid = np.ascontiguousarray(grid.reshape(lanes, WINDOW).T)
        state = np.repeat(np.array(self.roots, np.int64)[:, None], lanes, axis=1)
        begins = np.zeros((WINDOW, models, lanes), bool)
        for k, symbol in enumerate(grid):
            live = length > k
            if not live.any():
                break
            entry = self.step(state, symbol)
            state = np.where(live, entry & (_NEW - 1), state)
            begins[k] = (entry >= _NEW) & live
        after = begins.sum(axis=0)  # phrases that begin inside a window, after its first letter's
        inner = np.ones(lanes, bool)
        inner[first[:-1]] = begun is not None
        lane = np.tile(np.flatnonzero(inner), models)
        model = np.repeat(np.arange(models), int(inner.sum()))
        came = state[model, lane - 1]
        if begun is not None:
            came[lane == 0] = begun
        count, met = np.zeros(len(lane), np.int64), np.full(len(lane), -1)
        on, own = np.arange(len(lane)), came.copy()
        for k in range(WINDOW):
            on = on[length[lane[on]] > k]
            if not len(on):
                break
            symbol = grid[k, lane[on]]
            column = self.column[symbol]
            entry = self.table[own[on] * COLUMNS + column].astype(np.int64)
            if not column.all():
                rare = np.flatnonzero(column == 0)
                entry[rare] = self._rare(own[on][rare], symbol[rare])
            new = entry >= _NEW
            own[on] = entry & (_NEW - 1)
            count[on] += new
            both = new & (begins[k, model[on], lane[on]] if k else True)  # the fresh parse always begins at the first letter
            met[on[both]] = k
            on = on[~both]
        total = np.full((models, len(parts)), int(begun is None), np.int64)
        text = np.repeat(np.arange(len(parts)), cut)
        np.add.at(total, (np.tile(np.arange(models)[:, None], len(parts)), np.arange(len(parts))[None, :]), after[:, first[:-1]] if begun is None else 0)
        so_far = np.cumsum(begins, axis=0, dtype=np.int16)
        value = count + np.where(met >= 0, after[model, lane] - so_far[met, model, lane], 0)
        lost = np.flatnonzero(met < 0)
        fixed: dict[tuple[int, int], tuple[int, int]] = {}
        for i in sorted(lost.tolist(), key=lambda i: (model[i], lane[i])):  # these windows' ends differ from the fresh ones
            m, at, now = int(model[i]), int(lane[i]), int(own[i])
            if (m, at) in fixed:
                continue  # an earlier window's correction went through it
            while at + 1 < lanes and inner[at + 1]:
                n, now, joined = self._one(grid[: length[at + 1], at + 1], now, begins[:, m, at + 1])
                fixed[m, at + 1] = (n, now)
                at += 1
                if joined:
                    break
        np.add.at(total, (model, text[lane]), value)
        place = {(int(m), int(x)): i for i, (m, x) in enumerate(zip(model, lane))} if fixed else {}
        for (m, at), (n, _) in fixed.items():
            total[m, text[at]] += n - int(value[place[m, at]])
        last = state[:, -1].copy()
        for i in lost[lane[lost] == lanes - 1].tolist():
            last[model[i]] = own[i]
        for (m, at), (_, now) in fixed.items():
            if at == lanes - 1:
                last[m] = now if now >= 0 else state[m, -1]
        return total, last

    def _one(self, symbols_: np.ndarray, state: int, begins: np.ndarray) -> tuple[int, int, bool]:
        """A window letter by letter from `state`: phrases that begin in it, the state at its end, whether it met the fresh parse."""
        n = 0
        for k, symbol in enumerate(symbols_.tolist()):
            entry = int(self.step(np.array([[state]]), np.array([symbol]))[0, 0])
            state = entry & (_NEW - 1)
            if entry >= _NEW:
                n += 1
                if k == 0 or begins[k]:
                    n += int(begins[k + 1 :].sum())
                    return n, -1, True
        return n, state, False


#: The parser that this worker made last, by the mark of its models.
_PARSERS: dict[str, _Parser] = {}


def identify(docs: DataFrame, models: list[tuple[str, int, bytes]], text: str = "text") -> DataFrame:
    """docs with lang_pred (a label of the models; `und` if the text is null or has no letter, or without models) and
    score (0 to 1: the label's share when 2^(-8 * bits per letter) are made odds; 0 for `und`).

    Bits per letter are phrases / letters of the text, times log2 of the letters that the largest model has learnt: a
    pointer costs the same in all models, so a label of a few letters does not win by cheap ones. The label with fewest
    wins, ties go to the first by code point. Columns of these names are replaced, others stay. Whole texts are parsed,
    very long ones in stretches, so memory grows with neither their length nor the labels times it; no shuffle.
    """
    small_batches(docs.sparkSession)
    shared, mark = docs.sparkSession.sparkContext.broadcast(models), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if mark not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[mark] = _Parser(shared.value)
        own = _PARSERS[mark]
        names = np.array([m[0] for m in shared.value], object)
        pointer = np.log2(max([2, *[m[1] for m in shared.value]]))
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        wait, rows, lanes = [], [], 0

        def flush():
            bits = own.phrases(wait) * pointer / np.array([len(p) for p in wait])
            odds = np.exp2(-SHARP * (bits - bits.min(axis=0)))
            best = bits.argmin(axis=0)
            pred[rows], score[rows] = names[best], odds[best, np.arange(len(rows))] / odds.sum(axis=0)

        for i, t in enumerate(texts):
            if not isinstance(t, str) or not len(names):
                continue
            part = symbols(t)
            if not (part != 32).any():
                continue
            if -(-len(part) // WINDOW) * len(names) > 8 * LANES:  # a long text goes through in stretches
                bits = own.long_phrases(part, max(1, 4 * LANES // len(names))) * pointer / len(part)
                pred[i], score[i] = names[bits.argmin()], 1 / np.exp2(-SHARP * (bits - bits.min())).sum()
                continue
            wait.append(part)
            rows.append(i)
            lanes += -(-len(part) // WINDOW)
            if lanes * len(names) >= 4 * LANES:
                flush()
                wait, rows, lanes = [], [], 0
        if wait:
            flush()
        return pd.DataFrame({"lang_pred": pred, "score": score})

    kept, found = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")], f"found_{mark}"
    return docs.select("*", predict(F.col(text)).alias(found)).select(*kept, f"{found}.lang_pred", f"{found}.score")


def held_out(key: str = "doc_id"):
    """Rows that are never learnt from."""
    return F.crc32(F.col(key).cast("string")) % 4 == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    models = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), models)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
