"""Terms of a table against one pattern a term."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from regionspark.functions import dictionary as d
from regionspark.functions import spans as s

LETTERS = ["a", "b", "A", "_", "1", " ", "é", "É", "ß", "ẞ", "ſ", "s", "S", "K", "k", "İ", "i", "ı", "字", "-", "."]
RULES = {"brand": lambda t: rf"(?<![A-Za-z0-9_]){re.escape(t)}(?![A-Za-z0-9_])" if t.isascii() else re.escape(t), "word": lambda t: rf"(?<!\w){re.escape(t)}(?!\w)", "literal": re.escape}


def case(seed, terms=40, texts=120):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, n)))
    return sorted({make(4) for _ in range(terms)}), [*(make(40) for _ in range(texts)), "", None]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("shard", [2_000_000, 12])
def test_every_match_of_every_term(spark, monkeypatch, rule, shard):
    monkeypatch.setattr(d, "SHARD_CHARS", shard)
    terms, texts = case(len(rule))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("term", F.lit("clash"))
    table = spark.createDataFrame([(t,) for t in [*terms, terms[0], "", None]], "term string")
    got = sorted(map(tuple, d.term_matches(df, ["id"], "text", table, rule).collect()))
    flags = 0 if rule == "literal" else re.I
    assert got == sorted((i, w, m.start(), m.end()) for i, t in enumerate(texts) if t for w in terms for m in re.compile(RULES[rule](w), flags).finditer(t))
    assert d.term_matches(df, ["id"], "text", table.limit(0), rule).count() == 0


def test_glossary_equals_term_after_term(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "Alpha beta", "gamma", "delta", "x1"]
    glossary = [("alpha beta", "gamma ray"), ("alpha", "beta"), ("beta", "alpha x1"), ("gamma", r"\1 $0"), ("x1", "x1"), ("dèlta", "D")]
    texts = [" ".join(rng.choice([*words, '<x id="0"/>', '<x id="12"/>', "alphabeta", "dÈlta", ","]) for _ in range(rng.randint(0, 7))) for _ in range(200)] + [None, ""]
    ordered = sorted(glossary, key=lambda g: (-len(g[0]), g[0]))

    def brute(text):
        parts, changed = re.split(r'(<x id="\d+"/>)', text), False
        for i in range(0, len(parts), 2):
            for source, to in ordered:
                new = re.sub(rf"(?<!\w){re.escape(source)}(?!\w)", lambda m: to, parts[i], flags=re.I)
                parts[i], changed = new, changed or new != parts[i]
        return ("" if changed else "【模拟 fr】") + "".join(parts)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    table = spark.createDataFrame([*glossary, ("alpha", "zz"), ("", "no"), (None, "no"), ("q", None)], "source string, to string")
    for r in df.select("t", d.translate_by_glossary(F.col("t"), "fr", table).alias("out")).collect():
        assert r.out == (None if r.t is None else brute(r.t))


def test_brand_candidates_per_term(spark):
    df = spark.createDataFrame([("Foo Bar Foo",)], "t string")
    assert sorted((c.start, c.end) for c in s.find_spans(df, "t", ["Foo", "Foo Bar"]).collect()[0].candidates) == [(0, 3), (0, 7), (8, 11)]


def test_many_terms(spark):
    rng = random.Random(1)
    terms = list({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) for _ in range(100_000)})
    texts = [" ".join(rng.choice(terms) if rng.random() < 0.5 else "other" for _ in range(50)) for _ in range(2000)]
    own = d.Dictionary(terms, "brand")
    began = time.time()
    found = sum(len(own.find(t)) for t in texts)
    assert found == sum(len([w for w in t.split() if w != "other"]) for t in texts) and time.time() - began < 20


def test_matches_leave_in_bounded_batches(spark, monkeypatch):
    """A text of very many matches is handed on in pieces, and a literal leaves it once."""
    texts = [(1, "a b " * 30_000), (1, "a b " * 30_000), (2, None), (3, "K\u212ab a")]
    words = d.Dictionary(["a", "b"], "literal")
    assert sorted(words.held(texts[0][1])) == [0, 1]
    df, terms = spark.createDataFrame(texts, "id long, text string").coalesce(1), spark.createDataFrame([("a",), ("b",), ("k",)], "term string")
    assert sorted(map(tuple, d.holds(df, ["id"], "text", terms).collect())) == [(1, "a"), (1, "b"), (3, "a"), (3, "b")]
    found = d.term_matches(df, ["id"], "text", terms)
    assert found.count() == 120_001 and not d.term_matches(df.where("id = 3"), ["id"], "text", terms).where("term <> 'a'").count()
    sizes = found.mapInArrow(lambda batches: (d.pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").agg(F.max("n")).collect()[0][0]
    assert sizes <= d.OUT


@pytest.mark.parametrize("seed", range(6))
def test_one_pass_glossary_equals_term_after_term(seed):
    """Replacements that share no letter with a term, in one pass; terms overlap each other and themselves."""
    rng = random.Random(seed)
    terms = sorted({"".join(rng.choice(["ab", "b", "a b", "A", "é", "s", "ſ", "K", "-"]) for _ in range(rng.randint(1, 4))) for _ in range(25)}, key=lambda t: (-len(t), t))
    terms = [t for t in terms if t[0] not in " -" and t[-1] not in " -"]
    to = [f"#{i}" for i in range(len(terms))]
    words = d.Dictionary(terms, "word")
    assert all(words.inert(to))
    for _ in range(300):
        text = "".join(rng.choice(["ab", "b", "a b", "A", "É", "S", "s", "\u212a", "-", " ", " ", "#1"]) for _ in range(rng.randint(0, 15)))
        want = text
        for t, x in zip(terms, to):
            want = re.sub(rf"(?<!\w){re.escape(t)}(?!\w)", x, want, flags=re.I)
        assert d.replaced(text, words, to) == (want, want != text)


def test_long_text_of_many_terms_is_one_pass():
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(4000)}, key=lambda t: (-len(t), t))
    words, text, began = d.Dictionary(terms, "word"), " ".join(rng.choice(terms) for _ in range(40_000)), time.time()
    assert d.replaced(text, words, ["#"] * len(terms))[0] == " ".join(["#"] * 40_000) and time.time() - began < 5


@pytest.mark.parametrize("rule", RULES)
def test_counts_and_words(spark, rule):
    terms, texts = case(7, 60)
    for some in (terms, [t for t in terms if re.fullmatch("[A-Za-z0-9_]+", t)]):
        words = d.Dictionary(some, rule)
        for t in filter(None, texts):
            assert words.counts(t) == {i: len(own) for i, w in enumerate(some) if (own := re.findall(RULES[rule](w), t, 0 if rule == "literal" else re.I))}
            if rule == "word" and len(some) < len(terms):
                some_to, want = [f"#{'!' * i}" for i in range(len(some))], t
                assert words.calm(some_to)
                for w, x in zip(some, some_to):
                    want = re.sub(RULES[rule](w), x, want, flags=re.I)
                assert d.replaced(t, words, some_to)[0] == want


def test_brand_spans_query_equals_sql(spark, tmp_path):
    """Whole texts that are a part of a brand, brands with one character between them, ids that repeat."""
    import duckdb

    from regionspark.catalog import units_streams as c

    rows = [(1, "Apache"), (2, "license"), (3, "the,the the"), (4, "the"), (5, None), (6, ""), (7, "Apache License,the\nthe-the-the"), (7, "THE x"), (8, "the\u017fe licen\u017fe apache licen\u017fe")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(c.ORACLES["a25_brand_spans"]).fetchall())
    assert sorted(map(tuple, c.QUERIES["a25_brand_spans"](spark, str(tmp_path)).collect())) == want and len(want) == 5
