"""Operators 11 to 13 against the library, against brute force, and on odd inputs."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionspark.llm import common, divergence, piece_bpe, vector_codes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string"
ALPHABET = ["a", "the ", " of", "1", "\n", "\t", "'s", "é", "!", "　", "字", "\x1c", "▁", "  ", "Zq", "⁇", "<s>", "<0x0A>", "аа", "привет", "=", "==", "    ", "ee", "тре", "\U0001f600", "�", "\x00"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def texts(n, seed=5):
    rng = random.Random(seed)
    some = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]
    many = ["".join(rng.choice(c) for _ in range(k)) for c, k in (("etaoinsrhl", 20000), ("et", 3000), ("ab ", 3000), ("=", 3000))]
    return some + many + [" " * k for k in (1, 15, 16, 17, 33, 4000)] + ["a" * 5000, "", None]


def test_pieces_equal_library(spark, library):
    rows = [(i, t, None, None) for i, t in enumerate(texts(1500))]
    df = piece_bpe.decode(piece_bpe.encode(spark.createDataFrame(rows, DOCS)))
    for r in df.collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids) and r.decoded == (r.text or "").replace("▁", " ")
    for r in piece_bpe.op11_piece_bpe(spark, SF).join(common.load(spark, SF, "documents").select("doc_id", "text"), "doc_id").collect():
        ids = library.encode(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_in_groups_and_by_heap(library, monkeypatch):
    own = piece_bpe.Model(piece_bpe._path(None))
    some = texts(300, seed=9)
    want = [library.encode(t or "") for t in some]
    for rounds, group in ((0, 1 << 18), (2, 40), (10**9, 500)):
        monkeypatch.setattr(piece_bpe, "ROUNDS", rounds)
        monkeypatch.setattr(piece_bpe, "GROUP", group)
        own.forget()
        assert [np.frombuffer(x, np.int32).tolist() for x in own.encode_texts(some)] == want


def test_pieces_decode_any_ids(spark, library):
    rng = random.Random(2)
    rows = [([rng.choice([1, 2, 0, 3, 4, 35, 200, 232, 231, 259, 264, 28705, 29871, rng.randrange(32000)]) for _ in range(rng.randint(0, 8))],) for _ in range(800)]
    out = piece_bpe.decode(spark.createDataFrame([*rows, (None,), ([None, 264],)], "ids array<int>")).collect()
    assert all(r.decoded == library.decode(r.ids) for r in out[:-2]) and [r.decoded for r in out[-2:]] == ["", library.decode([264])]


def test_pieces_odd_inputs(spark, library):
    df = spark.createDataFrame([(1, "x", "a", "b"), (1, "x", "a", "b"), (None, None, None, None)], DOCS).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(0))
    out = piece_bpe.decode(piece_bpe.encode(df)).orderBy("doc_id").collect()
    assert [(r.ids, r.decoded) for r in out] == [([], "")] + 2 * [(library.encode("x"), "x")]
    assert piece_bpe.decode(piece_bpe.encode(df.limit(0))).count() == 0


def codes_by_hand(rows):
    """rows (vec_id, vector, label) to {row number: (code, error)} and the digest of the codebooks, by comparing with all."""
    kept = [(k, v, [math.floor(1024 * x) for x in v]) for k, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = len(kept[0][2]) // 4
    parts = [[r[2][p * q : (p + 1) * q] for r in kept] for p in range(4)]
    books = [p[:256] for p in parts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p])) for x in parts[p]] for p in range(4)]

    for _ in range(4):
        chosen = assign()
        for p in range(4):
            mine = collections.defaultdict(list)
            for x, (_, i) in zip(parts[p], chosen[p]):
                mine[i].append(x)
            books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i])] if i in mine else e for i, e in enumerate(books[p])]
    chosen = assign()
    flat = ",".join(str(c) for b in books for e in b for c in e)
    return [(r[0], "".join(f"{chosen[p][k][1]:02x}" for p in range(4)), sum(chosen[p][k][0] for p in range(4))) for k, r in enumerate(kept)], hashlib.sha256(flat.encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int"


def test_codes_by_hand(spark):
    rng = random.Random(4)
    grid = [x / 8 for x in range(-6, 7)]  # coarse, so that many distances are equal
    rows = [(rng.randint(0, 500), [rng.choice(grid) for _ in range(8)], rng.choice([None, 0, 1])) for _ in range(420)]
    rows += [(rng.randint(0, 500), [float(np.float32(rng.gauss(0, 1))) for _ in range(8)], 2) for _ in range(80)]
    odd = [(None, [0.5] * 8, None), (3, None, 1), (4, [1.0, None] * 4, 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] * 8, 1), (7, [-float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows + odd, VECTORS).withColumn("code", F.lit(1)).withColumn("row", F.lit(2)).repartition(5)
    out = vector_codes.label_errors(vector_codes.compress(df)).collect()
    want, digest = codes_by_hand(rows + odd)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r["row"].vec_id, r.code, r.error) for r in out], key=key) == sorted(want, key=key) and {r.codebooks_sha256 for r in out} == {digest}
    per = collections.Counter()
    for r in out:
        per[r["row"].label] += r.error
    assert all(r.label_error == per[r["row"].label] for r in out)


def test_codes_odd_inputs(spark):
    few = [(1, [0.1] * 6, 0), (1, [0.1] * 6, 0), (2, [0.2] * 5, 0)]
    out = vector_codes.label_errors(vector_codes.compress(spark.createDataFrame(few, VECTORS))).orderBy("row.vec_id").collect()
    assert [(r.code, r.error, r.label_error) for r in out] == [("00000000", 0, 0), ("00000000", 0, 0), (None, None, 0)]
    for rows in ([], [(1, None, 0)]):
        empty = vector_codes.label_errors(vector_codes.compress(spark.createDataFrame(rows, VECTORS)))
        assert empty.count() == 0 and "codebooks_sha256" in empty.columns
    assert [r.code for r in vector_codes.compress(spark.createDataFrame([(1, [], 0)], VECTORS)).collect()] == ["00000000"]


def test_pivots_prune_and_lose_nothing():
    rng = np.random.default_rng(3)
    entries = rng.integers(-300, 300, (256, 16))
    parts = np.concatenate([rng.integers(-300, 300, (500, 16)), entries[rng.integers(0, 256, 500)] + rng.integers(-9, 9, (500, 16))])
    pivots = vector_codes.far_apart(entries, vector_codes.PIVOTS)
    seen, whole = [], vector_codes._squares
    index, best = vector_codes.nearest(parts, vector_codes.pivot_distances(parts, pivots), entries, pivots)
    full = whole(parts[:, None], entries[None])
    assert (index == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    try:
        vector_codes._squares = lambda a, b: seen.append(len(a)) or whole(a, b)
        vector_codes.nearest(parts, vector_codes.pivot_distances(parts, pivots), entries, pivots)
    finally:
        vector_codes._squares = whole
    assert sum(seen) < 0.6 * 1000 * 256


def audit_by_hand(rows, least, top):
    docs = [tuple(x or "" for x in r[1:]) for r in rows]
    split = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), lang, source) for t, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        held, n = collections.Counter(), collections.defaultdict(collections.Counter)
        for terms, own, source in split:
            if own == lang:
                held.update(set(terms))
                n[source].update(terms)
        vocabulary = [t for t in held if held[t] >= least]
        p = {}
        for source in n:
            total = sum(n[source][t] for t in vocabulary)
            p[source] = {t: 1 + 10**9 * (n[source][t] + 5) // (total + 5 * len(vocabulary)) for t in vocabulary}
        both = sum(n.values(), collections.Counter())
        q = {t: 1 + 10**9 * (both[t] + 5) // (sum(both[u] for u in vocabulary) + 5 * len(vocabulary)) for t in vocabulary}
        for source in n:
            pairs = sorted((-sum(abs(p[source][t] - p[other][t]) for t in vocabulary), other.encode()) for other in n if other != source)
            terms = sorted((q[t] - p[source][t], t.encode()) for t in vocabulary if n[source][t] and p[source][t] > q[t])[:top]
            out += [(lang, source, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block,tile,held", [(1 << 14, 16, 200_000), (3, 2, 5)])
def test_audit_by_hand(spark, monkeypatch, block, tile, held):
    for name, value in (("BLOCK", block), ("TILE", tile), ("HELD", held), ("SLICE", 7)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(8)
    words = ["Aa", "aa", "bß", "ß", "C", "dd", "字", "e\xa0f", "g1h", "_i_", "É", "k", "\x85"]
    rows = [(i, None if rng.random() < 0.05 else " ".join(rng.choice(words[: rng.randint(1, len(words))]) for _ in range(rng.randint(0, 30))), rng.choice(["x", "y", None, ""]), rng.choice(["a", "ä", "b", "B", None])) for i in range(150)]
    rows += [(900, "", "x", "no terms"), (901, "rare", "z", "a"), (902, None, "z", "b"), (903, "word " * 3000, "x", "a")]
    df = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("term", F.lit(1)).withColumn("at", F.lit(None))
    keep = divergence._tile
    if block == 3:  # workers import the module anew, so the sizes are carried by the function
        monkeypatch.setattr(divergence, "_tile", _tile_of(keep, block, tile))
    assert sorted(map(tuple, divergence.audit(df, least_docs=6, top=4).collect())) == audit_by_hand(rows, 6, 4)
    assert divergence.audit(df.limit(0)).count() == 0


def _tile_of(keep, block, tile):
    def run(rows):
        divergence.BLOCK, divergence.TILE = block, tile
        return keep(rows)

    return run


def test_clustering_saves_runs(spark):
    rows = divergence.kept_counts(divergence.term_counts(common.load(spark, SF, "documents").withColumn("source", F.substring("source", 1, 4))), 2)
    totals = rows.groupBy("lang", "source").agg(F.countDistinct("n").alias("kinds"))
    leads = totals.selectExpr("lang", "source", "row_number() over (partition by lang order by kinds, source) - 1 as lead").where(F.col("lead") < divergence.LEAD)

    def runs(at):
        columns = rows.join(at, ["lang", "term"]).withColumn("p", F.col("n"))
        return divergence.run_lengths(columns).select(F.sum(F.size("runs"))).collect()[0][0]

    by_name = rows.select("lang", "term").distinct().selectExpr("lang", "term", "row_number() over (partition by lang order by term) - 1 as at")
    assert runs(divergence.placed(rows, leads).select("lang", "term", "at")) < 0.8 * runs(by_name)
