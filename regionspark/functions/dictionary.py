"""Matching a table of terms in texts (A6, A25, B10): one automaton finds the terms of a text, however many there are.

The automaton (Aho-Corasick) runs over folded texts, one character for one, and finds every place that could match; a place is
then held against the term's own rule. Terms that are one word, where the rule asks for whole words, are looked up by the words of
the text instead. Terms reach the tasks as a broadcast table of a checked size; a larger table is cut into shards that each pass
over the texts by themselves. Matches leave a task in batches of OUT rows, however many a text or an Arrow batch has.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters of all terms of a shard; the automaton takes about 60 bytes for each.
SHARD_CHARS = 2_000_000
#: Matches that a task holds before it hands them on, and texts that it takes out of an Arrow batch at a time.
OUT, TEXTS = 20_000, 100
#: What stands around a match. brand (A25): a term of ASCII stands alone among ASCII letters, digits and _, others touch what is
#: around them; word (A6): letters, digits and _ of any script; literal (B10): anything, and case counts.
#: What a whole word is to a rule, and the letters beyond ASCII that match one of ASCII in any case.
WORDS = {"brand": re.compile(r"[A-Za-z0-9_]+"), "word": re.compile(r"\w+")}
_ODD = re.compile("[\u0130\u0131\u017f\u212a]")
RULES = {"brand": r"(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])", "word": r"(?<!\w){}(?!\w)", "literal": "{}"}


def fold(text: str) -> str:
    """One character for each; characters that match each other in any case fold to the same one (others may, too)."""
    return text.lower() if text.isascii() else "".join(_folded(c) for c in text)


@lru_cache(1 << 16)
def _folded(c: str) -> str:
    return c.lower()[0].upper().lower()[0]


class Dictionary:
    """The terms of one shard, ready for matching."""

    def __init__(self, terms: list[str], rule: str):
        self.terms, self.rule, self.cased = terms, rule, rule == "literal"
        self.reach = 1 + max(map(len, terms), default=0)
        self.same: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            if term:
                self.same.setdefault(term if self.cased else fold(term), []).append(i)
        self.words = WORDS.get(rule)
        self.by_word = {k: n for k, n in self.same.items() if self.words and all(re.fullmatch(r"[A-Za-z0-9_]+", terms[i]) for i in n)}
        self.places = self._automaton([k for k in self.same if k not in self.by_word])
        self._inert: list[bool] | None = None
        self._calm: bool | None = None
        self.pattern = lru_cache(4096)(self._pattern)

    def _automaton(self, keys: list[str]) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for key in keys:
            out.add_word(key, (len(key), tuple(self.same[key])))
        if keys:
            out.make_automaton()
        return out

    @cached_property
    def all_places(self) -> ahocorasick.Automaton:
        return self._automaton(list(self.same))

    def inert(self, to: list[str]) -> list[bool]:
        """Whether a term's replacement leaves all other places as they are: it shares no letter with a term, so no match holds a
        part of it, and terms begin and end inside words, so none lies beside another. Worked out once for the terms' `to`."""
        if self._inert is None:
            letters = set().union(*self.same)
            inside = self.rule == "word" and all(re.match(r"\w", t[0]) and re.match(r"\w", t[-1]) for t in self.terms if t)
            self._inert = [inside and bool(x) and letters.isdisjoint(fold(x)) for x in to]
        return self._inert

    def calm(self, to: list[str]) -> bool:
        if self._calm is None:
            self._calm = all(self.inert(to))
        return self._calm

    def _pattern(self, i: int) -> re.Pattern:
        term = self.terms[i]
        rule = "{}" if self.rule == "brand" and not term.isascii() else RULES[self.rule]
        return re.compile(rule.replace("{}", re.escape(term)), 0 if self.cased else re.I)

    def fits(self, i: int, text: str, start: int, end: int) -> bool:
        """Whether the term's rule holds for a place whose folded characters are the term's."""
        if self.cased:
            return True
        if self.terms[i].isascii() and text[max(start - 1, 0) : end + 1].isascii():  # both rules are plain here
            return not (start and (text[start - 1].isalnum() or text[start - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] == "_"))
        return self.pattern(i).match(text, start) is not None

    def _hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the term) of every place that fits, in the order of ends of words, then of the others."""
        folded, places = text if self.cased else fold(text), self.places
        if self.by_word:
            if self.rule == "brand" and not text.isascii() and _ODD.search(text):  # a match may reach beyond the word
                places = self.all_places
            else:
                for m in self.words.finditer(text):
                    for i in self.by_word.get(folded[m.start() : m.end()], ()):
                        if self.rule == "brand" or self.fits(i, text, m.start(), m.end()):
                            yield m.start(), m.end(), i
        if len(places):
            for at, (size, numbers) in places.iter(folded):
                for i in numbers:
                    if self.fits(i, text, at + 1 - size, at + 1):
                        yield at + 1 - size, at + 1, i

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the term) of every match; the matches of one term do not overlap, the first one wins."""
        last = {}
        for start, end, i in self._hits(text):
            if start >= last.get(i, 0):
                last[i] = end
                yield start, end, i

    def find(self, text: str) -> list[tuple[int, int, int]]:
        return list(self.matches(text))

    def counts(self, text: str) -> dict[int, int]:
        """The terms that a text holds, with how many matches each has; a text's words are counted before they are looked up."""
        if self.rule != "brand" or len(self.places) or not text.isascii() and _ODD.search(text):
            return Counter(i for _, _, i in self.matches(text))
        out = Counter()
        for word, n in Counter(self.words.findall(text)).items():
            for i in self.by_word.get(word.lower(), ()):
                out[i] += n
        return out

    def held(self, text: str) -> Iterator[int]:
        """The terms that a text holds, each once."""
        if self.cased:
            found = {numbers for _, (_, numbers) in self.places.iter(text)} if len(self.places) else ()
            return (i for numbers in found for i in numbers)
        return iter({i for _, _, i in self._hits(text)})


#: Automata of this worker, the newest two.
_BUILT: dict[str, Dictionary] = {}


def _shipped(spark: SparkSession, terms: list[str], rule: str) -> Callable[[], Dictionary]:
    """A broadcast table of terms; each worker builds its automaton once."""
    shared, mark = spark.sparkContext.broadcast(terms), uuid.uuid4().hex

    def own() -> Dictionary:
        from regionspark.functions.dictionary import _BUILT as built  # the worker's, not a copy that came with the function

        if mark not in built:
            while len(built) > 1:
                del built[next(iter(built))]
            built[mark] = Dictionary(shared.value, rule)
        return built[mark]

    return own


def shards(terms: DataFrame, column: str = "term") -> Iterator[list[str]]:
    """The distinct terms, each list of about SHARD_CHARS characters, so that one fits the driver and every task."""
    rows = terms.select(F.col(column).alias("term")).where("length(term) > 0").distinct()
    chars = rows.agg(F.sum(F.length("term"))).collect()[0][0] or 0
    n = -(-chars // SHARD_CHARS)
    for k in range(n):
        yield [r.term for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k)).toLocalIterator()]


def _scanned(df: DataFrame, keys: list[str], text: str, terms: DataFrame, rule: str, column: str, found: Callable, own: T.StructType) -> DataFrame:
    """keys and the columns that found(dictionary, text) gives rows of, batch by batch."""
    rows = df.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*df.select(*keys).schema.fields, *own.fields])
    arrow, out = to_arrow_schema(own), None

    def scan(dictionary: Callable[[], Dictionary]):
        def packed(batch: pa.RecordBatch, at: list[int], made: list[tuple]) -> pa.RecordBatch:
            columns = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            columns += [pa.array(values, field.type) for values, field in zip(zip(*made), arrow)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = dictionary()
            for batch in batches:
                at, made = [], []
                for begin in range(0, batch.num_rows, TEXTS):
                    for n, t in enumerate(batch.column(len(keys)).slice(begin, TEXTS).to_pylist(), begin):
                        for row in found(words, t) if t else ():
                            at.append(n)
                            made.append(row)
                            if len(made) >= OUT:
                                yield packed(batch, at, made)
                                at, made = [], []
                if made:
                    yield packed(batch, at, made)

        return run

    for some in shards(terms, column):
        part = rows.mapInArrow(scan(_shipped(df.sparkSession, some, rule)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], schema)


def term_matches(df: DataFrame, keys: list[str], text: str, terms: DataFrame, rule: str = "brand", column: str = "term") -> DataFrame:
    """(keys, term, start, end): every match of every term, offsets in code points. Null texts and terms match nothing,
    repeated terms count once. The texts are read once a shard of the terms and never shuffled."""
    found = lambda words, t: ((words.terms[i], a, b) for a, b, i in words.matches(t))
    return _scanned(df, keys, text, terms, rule, column, found, T.StructType.fromDDL("term string, start int, end int"))


def term_counts(df: DataFrame, keys: list[str], text: str, terms: DataFrame, rule: str = "brand", column: str = "term") -> DataFrame:
    """(keys, term, n): the number of matches of each term that a text holds, counted before they leave it."""
    found = lambda words, t: ((words.terms[i], n) for i, n in words.counts(t).items())
    return _scanned(df, keys, text, terms, rule, column, found, T.StructType.fromDDL("term string, n long"))


def holds(df: DataFrame, keys: list[str], text: str, terms: DataFrame, column: str = "term") -> DataFrame:
    """(keys, term), each once, for the literals that a text holds. A term leaves a text once, however often it is there."""
    found = lambda words, t: ((words.terms[i],) for i in words.held(t))
    return _scanned(df, keys, text, terms, "literal", column, found, T.StructType.fromDDL("term string")).distinct()


_SPLIT = re.compile(r"(\w+)")


def _words_replaced(text: str, words: Dictionary, to: list[str]) -> tuple[str, bool]:
    """replaced() where every term is one word and no replacement makes a match: each word goes to its first term."""
    parts, changed = _SPLIT.split(text), False
    for k in range(1, len(parts), 2):
        word = parts[k]
        for i in words.by_word.get(word.lower() if word.isascii() else fold(word), ()):
            if word.isascii() or words.pattern(i).fullmatch(word):
                parts[k], changed = to[i], changed or word != to[i]
                break
    return "".join(parts), changed


def replaced(text: str, words: Dictionary, to: list[str]) -> tuple[str, bool]:
    """A6 on a text without placeholders: term after term, each replaced everywhere before the next one is looked for, and
    whether one changed anything. A term that is not found cannot change the text, so only those found are tried; a replacement
    may make a later term, so what is around it is scanned again. Where no replacement can (see inert), each place of the
    text goes to its first term in one pass."""
    if not len(words.places) and words.calm(to):
        return _words_replaced(text, words, to)
    hits = sorted((i, start, end) for start, end, i in words._hits(text))
    wanted, changed = sorted({i for i, _, _ in hits}), False
    if all(map(words.inert(to).__getitem__, wanted)):
        gone, made, parts, at = bytearray(len(text)), [], [], 0
        for i, start, end in hits:
            if gone.find(1, start, end) < 0:
                gone[start:end] = b"\1" * (end - start)
                made.append((start, end, i))
        for start, end, i in sorted(made):
            parts += [text[at:start], to[i]]
            at, changed = end, changed or text[start:end] != to[i]
        return "".join([*parts, text[at:]]), changed
    while wanted:
        i, parts, at = wanted.pop(0), [], 0
        made, length = [], 0
        for m in words.pattern(i).finditer(text):
            parts += [text[at : m.start()], to[i]]
            length += m.start() - at
            made.append(length)
            length, at, changed = length + len(to[i]), m.end(), changed or m[0] != to[i]
        if parts:
            text = "".join([*parts, text[at:]])
            new = {j for p in made for _, _, j in words.find(text[max(p - words.reach, 0) : p + len(to[i]) + words.reach]) if j > i}
            wanted = sorted(new.union(wanted)) if new - set(wanted) else wanted
    return text, changed


def translate_by_glossary(masked: Column, target: str, glossary: DataFrame) -> Column:
    """A6 with a glossary table (source, to): the longest source first, equal ones in their own order, whole words in any case,
    outside placeholders; a text without a term is marked. One source has one translation, the least. The table has to
    be one shard, as terms act one after another; a larger one raises an error."""
    rows = glossary.where("length(source) > 0 and to is not null").groupBy("source").agg(F.min("to").alias("to"))
    if (rows.agg(F.sum(F.length("source") + F.length("to"))).collect()[0][0] or 0) > SHARD_CHARS:
        raise ValueError("the glossary is too large for one automaton")
    pairs = sorted(((r.source, r.to) for r in rows.collect()), key=lambda p: (-len(p[0]), p[0]))  # SHARD_CHARS at most
    own, to = _shipped(glossary.sparkSession, [s for s, _ in pairs], "word"), [t for _, t in pairs]
    mark, parts = f"【模拟 {target}】", re.compile(r'(<x id="\d+"/>)')

    @F.pandas_udf(T.StringType())
    def swapped(texts: pd.Series) -> pd.Series:
        words, out = own(), []
        for t in texts:
            done = None if t is None else [(p, False) if parts.fullmatch(p) else replaced(p, words, to) for p in parts.split(t)]
            out.append(done and ("" if any(c for _, c in done) else mark) + "".join(p for p, _ in done))
        return pd.Series(out, dtype=object)

    return swapped(masked)
