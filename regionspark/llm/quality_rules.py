"""Operator 1, quality rules: a ledger of failure bits and measurements, versioned policies over it, ablations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.llm.common import SPACE, WORD, let, load, words

#: Symbols that prose seldom holds (fixed values of the contract).
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Rules in bit order: bit k of fail_bits is set when the k-th condition holds. Never reorder; only append.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "upper_case": "100 * n_upper > 50 * word_chars",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 40 * n_words",
    "short_words": "word_chars < 2 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A named version: the rules that reject a document."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base-1", ("too_few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("prose-1", (*BASE.rules, "symbols", "upper_case", "repeated_lines")))}
CURRENT = POLICIES["prose-1"]


def repeat_words(found: Column) -> Column:
    """Words inside 5-word windows that occur twice or more. Sorting (hash, position) puts equal windows side by side;
    consecutive repeated windows overlap, so each adds the distance to the next, five at most."""
    hashes = F.transform(found, lambda w: F.xxhash64(w))

    def windows(h):
        return F.transform(F.slice(h, 1, F.size(h) - (WINDOW - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(w):
        def positions(s):
            same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.get(s, i + 1)["h"] == x["h"], F.get(s, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["p"]))

        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
        return let(ordered, lambda s: let(positions(s), lambda p: total(steps(p))))

    some = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)
    return F.when(F.size(found) <= WINDOW, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), some)))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Evaluate every rule once: the columns in keep (all by default), the measurements (long) and fail_bits (long).

    A null text measures as an empty one (0 words). Repeated rows stay separate rows. Columns of the input that
    clash with a measurement are replaced by it. An empty table gives an empty ledger. One narrow pass: no shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    measures = [
        *[let(words(body), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words"))).alias("_w")],
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("_l"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    ]
    names = ["n_words", "word_chars", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "n_upper"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {*names, "fail_bits"}]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], *measures)
    out = out.select(*[F.col(f"`{c}`") for c in kept], "_w.*", "_l.*", "n_symbols", "n_upper")
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    total = bits[0].cast("long")
    for b in bits[1:]:
        total = total.bitwiseOR(b.cast("long"))
    return out.withColumn("fail_bits", total)


def failed(policy: Policy, bits: Column | str = "fail_bits") -> Column:
    """Whether a rule of the policy is set in the ledger's bits."""
    return (F.col(bits) if isinstance(bits, str) else bits).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(docs: DataFrame, policy: Policy = CURRENT, text: str = "text") -> DataFrame:
    """The documents that no rule of the policy rejects, with their own columns unchanged, clashing names included."""
    plain = docs.select(F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    return ledger(plain, "_text", ("_doc",)).where(~failed(policy)).select("_doc.*")


def ablations(rows: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """(rule, n_documents, n_rejected, n_only_by_it, kept_without_it) from a ledger: one count per distinct bit pattern
    (at most 2^rules rows, combined before the shuffle), then bitwise sums."""
    mask, names = policy.mask, list(RULES)
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules])
    each = counts.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum("n").alias("n_documents"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_by_it"),
        F.sum(F.when(without == 0, F.col("n")).otherwise(0)).alias("kept_without_it"),
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(load(spark, sf_dir, "documents").select("doc_id", "text"), keep=("doc_id",))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "fail_bits", failed(BASE).alias("base_failed"), (~failed(BASE) & ~failed(CURRENT)).alias("kept"))


_BITS = " | ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, rule in enumerate(RULES.values()))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(t, '{WORD}')) AS w, generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) AS i FROM d),
v AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v WHERE g IS NOT NULL) WHERE c > 1),
s AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_words, coalesce(c.chars, 0)::BIGINT AS word_chars,
             len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(s.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n_lines, 0)::BIGINT AS n_lines, len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS n_upper
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT *, (fail_bits & {BASE.mask}) <> 0 AS base_failed, (fail_bits & {BASE.mask | CURRENT.mask}) = 0 AS kept FROM b
"""
