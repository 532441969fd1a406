"""The ten operators against brute force, exact round trips and held-out accuracy, and on odd inputs."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionspark.llm import byte_bpe, chat_formatting, common, fingerprints, html_extraction, jaccard_join, language_id, line_dedup, mixing, quality_classifier, quality_rules, queries
from regionspark.plans import groups
from tests.oracle import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    rows = [(i, t, more.get("lang"), "s" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n ", "one", "same line here with many words\nsame line here with many words", "x " * 5000, "Ünïcode 字 \x1c end\r\n", "same line here with many words"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def test_odd_inputs(spark):
    for df in (docs(spark, ODD), docs(spark, ODD).limit(0), docs(spark, ODD).withColumn("size", F.lit("clash")).withColumn("n_words", F.lit("clash")).withColumn("ids", F.lit(1))):
        n = df.count()
        assert quality_rules.ledger(df).count() == n
        assert quality_rules.apply_policy(df).columns == df.columns
        assert jaccard_join.linked(df).count() == n
        assert line_dedup.without_repeats(df).count() == n
        assert mixing.mix(df).count() == n
        assert byte_bpe.encode(df).count() == n
        assert fingerprints.edited_fingerprints(df).count() == n
        assert fingerprints.simhash(df).count() == n
        models = language_id.fit(df)
        assert {r.lang_pred for r in language_id.identify(df, models).collect()} <= {"und"}
        assert quality_classifier.score(df, quality_classifier.train(df, spark.createDataFrame([(0, 1), (None, 0), (3, None)], "doc_id long, quality int"), rounds=1)).count() == n
        pages = df.withColumnRenamed("text", "html")
        assert html_extraction.extract(pages, html_extraction.learn(pages)).where("text is null").count() == 0
    chat = spark.createDataFrame([(1, 0, None, None), (1, 1, "a", "> \n>>\n"), (None, None, "u", "x"), (1, 1, "a", "twice")], "conv_id long, turn long, role string, text string")
    assert chat_formatting.conversations(chat).count() == 4 and chat_formatting.conversations(chat.limit(0)).count() == 0


def test_odd_values(spark):
    """What odd rows give, not only how many there are."""
    df = docs(spark, ODD)
    by_id = lambda rows, *c: [tuple(r[x] for x in c) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]
    sizes = [0, 0, 0, 1, 12, 5000, 4, 6]
    assert by_id(quality_rules.ledger(df), "n_words") == [(n,) for n in sizes]
    assert by_id(jaccard_join.linked(df), "n_shingles", "component_id") == [(n, i) for i, n in enumerate([0, 0, 0, 1, 6, 1, 1, 2])]
    assert {r.doc_id for r in jaccard_join.one_of_each(df.union(df)).collect()} == set(range(8))
    line = "same line here with many words"
    assert by_id(line_dedup.without_repeats(df), "text", "n_removed") == [(t, 0) for t in ODD[:4]] + [(line, 1), (ODD[5], 0), (ODD[6], 0), ("", 1)]
    mixed = by_id(mixing.mix(df), "size", "source_size", "target", "taken")
    assert [m[:2] for m in mixed] == [(n, 5007 if i % 2 else 16) for i, n in enumerate(sizes)]
    assert all(abs(m[2] - (7502.5 if i % 2 else 32)) < 1e-6 for i, m in enumerate(mixed))
    assert sum(m[3] for m in mixed[::2]) == 32 and abs(sum(m[3] for m in mixed[1::2]) - 7502.5) <= 1 and all(m[3] <= 2 * m[0] for m in mixed)
    coded = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert [bytes(r.decoded).decode() for r in sorted(coded, key=lambda r: r.doc_id)] == [t or "" for t in ODD]
    prints = [r[0] for r in by_id(fingerprints.simhash(df), "fingerprint")]
    assert prints[0] == prints[1] == prints[2] == "0" * 32 and len(set(prints[2:])) == 6
    edited = [r[0] for r in by_id(fingerprints.edited_fingerprints(df), "n_chars")]
    assert edited == [len(t or "") for t in ODD]


def test_quality_windows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["a b c d e f a b c d e g", "w " * 40]

    def brute(t):
        w, seen = t.split(), {}
        for i in range(len(w) - 4):
            seen.setdefault(tuple(w[i : i + 5]), []).append(i)
        return len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)})

    out = {r.doc_id: r.n_repeat_words for r in quality_rules.ledger(docs(spark, texts)).collect()}
    assert [out[i] for i in range(len(texts))] == [brute(t) for t in texts]


def test_ablations(spark):
    rows = quality_rules.ledger(common.load(spark, SF, "documents"))
    bits = [r.fail_bits for r in rows.select("fail_bits").collect()]
    p = quality_rules.CURRENT
    for r in quality_rules.ablations(rows, p).collect():
        bit = 1 << list(quality_rules.RULES).index(r.rule)
        assert (r.n_rejected, r.n_only_by_it, r.kept_without_it) == (sum(bool(b & bit) for b in bits), sum(b & p.mask == bit for b in bits), sum(not b & p.mask & ~bit for b in bits))


def test_language_held_out(spark):
    d = common.load(spark, "/root/testdata/sf0.01", "documents")
    out = language_id.op2_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(d.select("doc_id", "lang"), "doc_id")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).collect()[0]
    assert n > 200 and right >= 0.97 * n


def test_phrases_are_longest_matches():
    learnt = language_id.symbols("the cat sat on the mat and the hat")
    parser = language_id._Parser([("x", len(learnt), language_id.automaton(learnt).tobytes())])
    whole = "".join(map(chr, learnt))

    def brute(t):
        n, match = 1, ""
        for c in t:  # a letter that the sample lacks ends a phrase; the next one starts where it ends
            if match + c in whole:
                match += c
            else:
                n, match = n + 1, c if c in whole else ""
        return n

    for t in ("the hat", "zebra", "cat on the hat zz sat", "q"):
        part = language_id.symbols(t)
        assert parser.phrases([part])[0, 0] == brute("".join(map(chr, part)))


def test_bpe_equals_library(spark):
    import public_tokenizers as P
    import tiktoken

    path, pattern = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    own = byte_bpe.encoder(path, pattern)
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(5)
    alphabet = ["a", "the ", " of", "1", "\n", "\t", "'s", "é", "!", "　", "字", "\x1c", "\x85", "  ", "Zq"]
    texts = [r.text for r in common.load(spark, SF, "documents").collect()] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for t in texts:
        packed = own.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == lib.encode_ordinary(t) and own.decode(packed).decode() == t
    for t in texts[-300:]:
        a, b, new = rng.randint(0, len(t)), 0, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))
        b = rng.randint(a, len(t))
        after, table = own.edited(t, own.prefixes(t), a, b, new)
        assert after == t[:a] + new + t[b:] and table == own.prefixes(after)
    df = byte_bpe.with_prefixes(docs(spark, texts[:50] + [None, ""]).withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int")).withColumn("new", F.lit(" more'll")))
    rows = byte_bpe.encode(byte_bpe.ids_of(byte_bpe.edit(df, "start", "end", "new")), out="again").collect()
    assert all(r.ids == r.again and r.text.endswith(" more'll") for r in rows)


def test_fingerprints(spark):
    d = common.load(spark, SF, "documents").select("doc_id", "text")
    rows = sorted(d.collect(), key=lambda r: -r.doc_id)
    out = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, SF).collect()}
    for k, r in enumerate(rows):
        after, n = rows[(k + 1) % len(rows)].text, len(r.text) // 3
        assert out[r.doc_id].edited_sha256 == hashlib.sha256((r.text[: len(r.text) - n] + after[:n]).encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in out.values()) >= 0.97 * len(out)
    prints = fingerprints.simhash(d)
    found = fingerprints.near(prints, prints.where("doc_id % 20 = 0"), radius=4).collect()
    value = {r.doc_id: int(r.fingerprint, 16) for r in prints.collect()}
    want = {(q, x) for q in value if q % 20 == 0 for x in value if (value[q] ^ value[x]).bit_count() <= 4}
    assert {(r.query_id, r.doc_id) for r in found} == want and len(found) == len(want)
    for k, r in out.items():
        near = sum((value[k] ^ x).bit_count() <= fingerprints.RADIUS for x in value.values()) - 1
        assert r.near_docs == (near if k % 20 == 0 else None) and r.fingerprint == f"{value[k]:032x}"


def test_near_counts(spark):
    """Copies, near copies, no id, no fingerprint and no rows, against all pairs of rows."""
    rng = random.Random(8)
    base = [rng.getrandbits(128) for _ in range(6)]
    values = [base[0]] * 40 + [b ^ sum(1 << x for x in rng.sample(range(128), rng.randint(0, 6))) for b in base for _ in range(25)] + [None, None]
    rows = [(None if i % 17 == 0 else i // 2, None if v is None else f"{v:032x}", i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string, place int").withColumn("n", F.lit("clash")).withColumn("wanted", F.lit("clash"))
    got = fingerprints.with_near_counts(df, F.col("doc_id") % 5 == 0)
    assert got.columns == [*df.columns, "near_docs"] and fingerprints.with_near_counts(df.limit(0), F.col("doc_id") % 5 == 0).count() == 0
    out = got.collect()
    assert len(out) == len(rows) and all(r.n == r.wanted == "clash" for r in out)
    for r in out:
        v = values[r.place]
        near = None if v is None else sum(x is not None and (x ^ v).bit_count() <= fingerprints.RADIUS for x in values) - 1
        assert r.near_docs == (near if r.doc_id is not None and r.doc_id % 5 == 0 else None)


def _components(texts, linked):
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if linked(a, b):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("percent,k", [(80, 5), (90, 3), (60, 1)])
def test_jaccard_join(spark, percent, k):
    rng = random.Random(percent)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))] for _ in range(12)]
    texts = [None, "", "a", "A", "a b"]
    for words in base:
        for _ in range(8):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 400)}"
            texts.append(" ".join(own))

    def shingles(t):
        w = [x.lower() for x in (t or "").split()]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    want = _components(texts, lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    out = {r.doc_id: r for r in jaccard_join.linked(docs(spark, texts), percent, k).collect()}
    assert [out[i].component_id for i in range(len(texts))] == want and [out[i].n_shingles for i in range(len(texts))] == [len(x) for x in sets]


def test_jaccard_join_disk(spark, monkeypatch):
    """No write of the join leaves shuffle files larger than the sketches."""
    from pyspark.sql.readwriter import DataFrameWriter

    def size(tops, name):
        return sum(p.stat().st_size for top in tops for p in Path(top).rglob(name))

    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    grew, tables, write = [], [], DataFrameWriter.parquet

    def measured(self, path, *args, **more):
        before = size(local, "shuffle_*")
        write(self, path, *args, **more)
        grew.append(size(local, "shuffle_*") - before)
        tables.append(size([path.removeprefix("file:")], "part-*"))

    monkeypatch.setattr(common, "_CLEAN_UP", "spark.regionspark.none")  # a write's shuffle files stay until they are measured
    monkeypatch.setattr(DataFrameWriter, "parquet", measured)
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(300)) for _ in range(3000)]
    out = jaccard_join.linked(docs(spark, [*texts, texts[7] + " more"]), percent=80, k=5).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: i for i in range(3000)} | {3000: 7}
    assert max(tables) > 4_000_000 and max(grew) < max(tables)


def test_long_chains(spark):
    """Chains of 300 in falling and in shuffled order of ids, as components and as visual groups, need few rounds but no cap."""
    falling, shuffled = [0, *range(299, 0, -1)], list(range(1000, 1300))
    random.Random(2).shuffle(shuffled)
    edges = spark.createDataFrame([e for ids in (falling, shuffled) for e in zip(ids, ids[1:])], "a long, b long")
    assert {r.id: r.component for r in common.components(edges).collect()} == {i: 0 if i < 300 else 1000 for i in falling + shuffled}
    layers = edges.selectExpr("1 AS image_id", "a AS seq").union(edges.selectExpr("1", "b")).distinct()
    found = groups.visual_groups(layers, edges.selectExpr("1 AS image_id", "a", "b"))
    assert {r.seq: r.component for r in found.collect()} == {i: 0 if i < 300 else 1000 for i in falling + shuffled}


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "> Hello   THERE\nHi"), (1, 2, "user", ">> Hello there\n> Hi\nthanks"), (1, 3, "user", "new topic"), (1, 4, "user", "> second line\nlate"), (1, 5, "x", "> never said\nend")]
    out = {r.turn: r for r in chat_formatting.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.parent for k, r in out.items()} == {0: None, 1: 0, 2: 1, 3: None, 4: 0, 5: None}
    assert {k: r.thread for k, r in out.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 0, 5: 5} and out[2].text == "thanks" and out[2].n_quoted == 2


def test_mixing(spark):
    out = mixing.mix(common.load(spark, SF, "documents")).toPandas()
    by = out.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.taken.sum() - 1.5 * by["size"].sum()) <= len(by) + 1 and (abs(by.taken - by.target) <= 1).all() and (by.target <= 2 * by["size"] + 1e-6).all() and (out.taken <= 2 * out["size"]).all()
    want, left, free = {}, 1.5 * by["size"].sum(), dict(zip(sorted(by.index), [5, 2, 1] * len(by)))
    while free:  # give by weight, fix what is above its stop, again
        unit = left / sum(free.values())
        full = [s for s, w in free.items() if unit * w > 2 * by["size"][s]]
        for s in full or list(free):
            want[s] = min(unit * free[s], 2 * by["size"][s])
            left -= want[s]
            del free[s]
    assert all(abs(want[s] - by.target[s]) < 1e-6 for s in by.index)
    mixed = mixing.mixed_documents(common.load(spark, SF, "documents"))
    assert mixed.agg(F.sum(common.n_words(F.col("text")))).collect()[0][0] == out.taken.sum()


def test_html():
    cost = html_extraction.Weights()
    page = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><header><a href=x>Home</a> Site</header><nav><ul><li><a>One</a></ul></nav><div id="cookie-notice">We use cookies</div>
    <main><h1>Big  title</h1><p>First para &lt;b&gt; with <a href="y">a link</a>,<br>more.<p>Second&nbsp;one<div class="ad-slot">Buy now</div><form>Search <input></form><ul><li>one item<li>two items</ul></main>
    <aside>Related</aside><section class="comments"><p>I like it so much that I write a long comment here</section><footer>&copy; 2020</footer></body></html>"""
    assert html_extraction.article(page, cost) == "Big title\nFirst para <b> with a link, more.\nSecond one\none item\ntwo items"
    assert html_extraction.article("", cost) == "" and html_extraction.article("plain words", cost) == "plain words"


def test_html_keeps_the_rest():
    cost = html_extraction.Weights()
    text = lambda page: html_extraction.article(page, cost)
    for dropped in ('<svg class="i"/>', "<svg/>", '<svg width=1 />', '<svg class="i"><path d="M0"/><text>no</text></svg>', "<script>no</script>", "<title>no</title>"):
        assert text(f"<p>a</p>{dropped}<p>b c d</p>") == "a\nb c d", dropped
    assert text("<p>a</p><title-card>x</title-card><p>b</p><select-box>y</select-box>").split() == ["a", "x", "b", "y"]
    assert text("<p>one two <math><mi>x</mi><mo>=</mo><mn>2</mn></math> three</p><math/><p>four</p>") == "one two x=2 three\nfour"
    for mark in ("discussion", "related-work", "reviews", "responses", "social-policy", "share", "notice"):
        own = f'<section id="{mark}"><h2>Heading</h2><p>A text of the article with <a href="x">a link</a> in it.</p></section>'
        want = "Before it.\nHeading\nA text of the article with a link in it.\nAfter it."
        assert text(f"<main><p>Before it.</p>{own}<p>After it.</p></main>") == want, mark
        assert text(f"<article><p>Before it.</p>{own}<p>After it.</p></article>") == want, mark
        buttons = f'<div class="{mark}">See <a href="x">Some other page</a> <a href="y">And one more</a></div>'
        assert text(f"<main><p>Before it, a text.</p>{buttons}<p>After it.</p></main>") == "Before it, a text.\nAfter it.", mark
    assert text('<main><p>Before it.</p><section id="reviews"><p>Three more words.</p><div class="share"><a>Tell a friend of it</a></div></section></main>') == "Before it.\nThree more words."
    assert text('<main><p>Before it.</p><div class="related sidebar"><p>Some words in a side bar</p></div></main>') == "Before it."


def test_html_articles(spark):
    pages = common.load(spark, SF, "pages")
    out = {r.page_id: r.text for r in html_extraction.op8_html_extraction(spark, SF).collect()}
    import html

    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert out[r.page_id] == "\n".join(b for b in blocks if b)


def test_line_dedup(spark):
    rng = random.Random(11)
    base = [[f"v{rng.randint(0, 300)}" for _ in range(rng.randint(3, 60))] for _ in range(25)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            own = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 300)}"
            lines.append(" ".join(own))
        texts.append("\n".join(lines))
    seen, want = [], {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            w = set(line.lower().split())
            if len(line.split()) >= 5:
                if any(100 * len(w & x) >= 80 * len(w | x) for x in seen):
                    want.setdefault(i, []).append(k)
                seen.append(w)
    out = {r.doc_id: r.lines for r in line_dedup.repeated_lines(docs(spark, texts)).collect()}
    assert out == want


def test_quality_classifier_held_out(spark):
    """Accuracy on the fold whose labels neither teach nor calibrate."""
    sf, fold = "/root/testdata/sf0.1", quality_classifier.HELD_OUT
    d, labels = common.load(spark, sf, "documents"), common.load(spark, sf, "labels")
    held = labels.join(quality_classifier.score(d, quality_classifier.train(d, labels)), "doc_id").toPandas()
    held = held[[zlib.crc32(str(x).encode()) % quality_classifier.FOLDS == fold for x in held.doc_id]]
    assert ((held.score >= 0.5) == (held.quality == 1)).mean() > max(0.94, held.quality.mean() + 0.05)


def test_quality_classifier_brute_force(spark):
    """Odds of the first round counted with plain dictionaries, scores of the views, and pooled calibration."""
    from collections import Counter

    q = quality_classifier
    d, labels = common.load(spark, SF, "documents").select("doc_id", "text", "lang", "source"), common.load(spark, SF, "labels")
    views = q.train(d, labels, rounds=0)
    text, label = {r.doc_id: r.text for r in d.collect()}, {r.doc_id: r.quality for r in labels.collect()}
    code = lambda t: ((t[0] | t[1] << 8 | t[2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
    grams = {k: [code(t.encode()[i : i + 3]) for i in range(len(t.encode()) - 2)] for k, t in text.items()}
    counts = [Counter(), Counter()]
    for k, y in label.items():
        if zlib.crc32(str(k).encode()) % q.FOLDS not in (q.CALIBRATION, q.HELD_OUT):
            counts[y].update(grams[k])
    share = [{x: (c[x] + 1) / (sum(c.values()) + q.TEXT) for x in range(q.TEXT)} for c in counts]
    odds = [np.log(share[1][x]) - np.log(share[0][x]) for x in range(q.TEXT)]
    assert np.allclose(views[0].odds, odds)
    out = {r.doc_id: r.p_text for r in q.score(d, views).collect()}
    for k in list(text)[:60]:
        s = sum(odds[x] for x in grams[k]) / max(len(grams[k]), 1)
        assert abs(out[k] - views[0].chance[np.searchsorted(views[0].edges, s, "right")]) < 1e-9 or np.abs(views[0].edges - s).min() < 1e-9
    good, total = np.array([0, 3, 1, 0, 5.0]), np.array([2, 4, 4, 1, 5.0])
    best = q._isotonic(good, total)
    assert (np.diff(best) >= 0).all() and len(best) == 5 and np.allclose(best[1:4], best[1])


def test_quality_classifier_rounds_brute_force(spark):
    """Both views, two rounds of pseudo-labels and the combined score, with loops over documents and dictionaries of features."""
    import math

    import xxhash

    q = quality_classifier
    d, labels = common.load(spark, SF, "documents").select("doc_id", "text", "lang", "source"), common.load(spark, SF, "labels")
    known = {r.doc_id: int(r.quality > 0) for r in labels.collect()}
    fold = {k: zlib.crc32(str(k).encode()) % q.FOLDS for k in known}
    code = lambda t: ((t[0] | t[1] << 8 | t[2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 16
    band = lambda x: str(math.floor(math.log(x + 1) / math.log(1.5)))

    def hashed(name, value):
        return xxhash.xxh64_intdigest(value.encode(), xxhash.xxh64_intdigest(name.encode(), 42))

    features = {}
    for r in d.collect():
        t, n = r.text.encode(), r.text.count("\n") + 1
        named = {"source": r.source or "", "lang": r.lang or "", "length": band(len(r.text)), "lines": band(n), "line": band(len(r.text) / n)}
        meta = common.mix(np.array([hashed(k, v) for k, v in named.items()], np.uint64)) & np.uint64(q.META - 1)
        features[r.doc_id] = ([code(t[i : i + 3]) for i in range(len(t) - 2)], meta.tolist())

    def trained(rounds):
        views, taught = None, []
        for _ in range(rounds + 1):
            counts = [[{}, {}], [{}, {}]]  # view, class: feature -> weight
            told = 0
            for k, own in features.items():
                weight = [[0.0, 0.0], [0.0, 0.0]]
                if k in known and fold[k] not in (q.CALIBRATION, q.HELD_OUT):
                    weight[0][known[k]] = weight[1][known[k]] = 1.0
                elif k not in known and views:
                    sure = [chance(views, v, own[v]) for v in (0, 1)]
                    for v in (0, 1):
                        weight[v][1] += q.PSEUDO * (sure[1 - v] >= q.CONFIDENT)
                        weight[v][0] += q.PSEUDO * (sure[1 - v] <= 1 - q.CONFIDENT)
                        told += sum(weight[v]) > 0
                for v in (0, 1):
                    for c in (0, 1):
                        for x in own[v] if weight[v][c] else ():
                            counts[v][c][x] = counts[v][c].get(x, 0.0) + weight[v][c]
            taught.append(told)
            views = []
            for v, size in ((0, q.TEXT), (1, q.META)):
                total = [sum(c.values()) + size for c in counts[v]]
                odds = {x: math.log((counts[v][1].get(x, 0) + 1) / total[1]) - math.log((counts[v][0].get(x, 0) + 1) / total[0]) for x in set(counts[v][0]) | set(counts[v][1])}
                views.append([odds, math.log(1 / total[1]) - math.log(1 / total[0]), None, None])
                judged = sorted((k for k in known if fold[k] == q.CALIBRATION and k in features))
                scores = [mean(views[v], v, features[k][v]) for k in judged]
                edges = np.unique(np.quantile(scores, np.linspace(0, 1, q.BINS + 1)[1:-1]))
                good, n = np.zeros(len(edges) + 1), np.zeros(len(edges) + 1)
                for k, s in zip(judged, scores):
                    at = sum(e <= s for e in edges)
                    good[at] += known[k]
                    n[at] += 1
                views[v][2:] = edges, q._isotonic(good, n)
        return views, taught

    def mean(view, v, own):
        total = sum(view[0].get(x, view[1]) for x in own)
        return total if v else total / max(len(own), 1)

    def chance(views, v, own):
        return views[v][3][sum(e <= mean(views[v], v, own) for e in views[v][2])]

    for rounds in (1, 2):
        views, taught = trained(rounds)
        assert taught[0] == 0 and taught[-1] > 0  # pseudo-labels do teach
        got = q.train(d, labels, rounds=rounds)
        for mine, theirs in zip(views, got):
            seen = np.full(len(theirs.odds), mine[1])
            seen[list(mine[0])] = list(mine[0].values())
            assert np.allclose(seen, theirs.odds, atol=1e-9) and np.allclose(mine[2], theirs.edges) and np.allclose(mine[3], theirs.chance)
        logit = lambda p: math.log(p / (1 - p))
        spread = [float(np.std([logit(p) for p in v[3]])) for v in views]
        agree = 0
        for r in q.score(d, got).collect():
            p = [chance(views, v, features[r.doc_id][v]) for v in (0, 1)]
            if np.allclose([r.p_text, r.p_meta], p):  # a score on the very edge of a bin may fall to either side
                agree += 1
                assert abs(r.score - 1 / (1 + math.exp(-(spread[0] * logit(p[0]) + spread[1] * logit(p[1])) / sum(spread)))) < 1e-9
        assert agree >= 0.98 * len(features)
    assert not np.allclose(got[0].odds, q.train(d, labels, rounds=0)[0].odds)


CLASH = ["_id", "_gone", "_words", "_size", "_lang", "_edit", "row", "found", "both", "lines", "id", "other", "d", "s", "m", "mark", "words", "taken", "cut", "copies", "rank", "slot", "label", "meta", "size", "new", "own"]


def test_clashing_columns(spark):
    base = docs(spark, ["One line of some words here\nand one more line of words", None, "", "One line of some words here\nb"], lang="en")
    many = base.select("*", *[F.lit(f"keep {c}").alias(c) for c in CLASH])
    before = {r.doc_id: [r[c] for c in CLASH] for r in many.collect()}

    def same_columns(df, rows):
        got = df.collect()
        assert len(got) == rows and all([r[c] for c in CLASH] == before[r.doc_id] for r in got)

    same_columns(line_dedup.without_repeats(many), 4)
    same_columns(quality_rules.ledger(many), 4)
    assert mixing.mixed_documents(many).columns == many.columns and all([r[c] for c in CLASH] == before[r.doc_id] for r in mixing.mixed_documents(many).collect())
    same_columns(jaccard_join.one_of_each(many), 4)
    same_columns(byte_bpe.decode(byte_bpe.encode(many)), 4)
    same_columns(byte_bpe.edit(byte_bpe.with_prefixes(many.withColumns({"a": F.lit(0), "b": F.lit(0), "c": F.lit("x")})), "a", "b", "c"), 4)
    same_columns(language_id.identify(many, language_id.fit(many)), 4)
    same_columns(fingerprints.simhash(many), 4)
    same_columns(html_extraction.extract(many.withColumn("html", F.col("text")), html_extraction.Weights()), 4)
    assert jaccard_join.linked(many).count() == mixing.mix(many).count() == fingerprints.edited_fingerprints(many).count() == 4
    assert quality_classifier.score(many, quality_classifier.train(many, many.selectExpr("doc_id", "1 AS quality", "label"), rounds=1)).count() == 4
    chat = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "v", "> a\nb")], "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in (*CLASH, "level", "body", "thread", "parent", "spot", "stretch", "ahead")])
    assert chat_formatting.conversations(chat).count() == 2 and [r.turns for r in chat_formatting.threads(chat).collect()] == [[0, 1]]


def test_repeated_and_missing_ids(spark):
    """Rows that share an id, or have none, stay rows of their own in every operator."""
    rows = [(1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (1, "other words are here", "en", "s", 20), (None, "x y z", None, None, 5), (None, "x y z", None, None, 5), (2, "p q r s t u", "en", "t", 11)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df).collect()
    size = sum(len(r[1].split()) for r in rows)
    assert len(out) == 6 and all(0 <= r.taken <= 2 * r.size for r in out) and abs(sum(r.taken for r in out) - 1.5 * size) <= 6
    mixed = mixing.mixed_documents(df).collect()
    taken = sum(len(r.text.split()) for r in mixed)
    assert taken == sum(r.taken for r in out) and sum(r.doc_id is None for r in mixed) <= 4
    prints = fingerprints.edited_fingerprints(df).collect()
    assert len(prints) == 6 and sum(r.doc_id is None for r in prints) == 2
    again = fingerprints.edited_fingerprints(df.repartition(3)).collect()
    assert sorted(map(str, prints)) == sorted(map(str, again))
    assert line_dedup.without_repeats(df, min_words=1).count() == 6 and jaccard_join.linked(df.where("doc_id is not null")).count() == 4
    assert quality_classifier.score(df, quality_classifier.train(df, spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int"))).count() == 6


def test_mixing_cuts_keep_white_space(spark):
    text = "  one\n\ntwo \t three  four "
    df = docs(spark, [text] * 1 + ["w " * 40])
    for r in mixing.mixed_documents(df).collect():
        assert text.startswith(r.text) or ("w " * 40).startswith(r.text)
        assert r.n_chars == len(r.text)
    part = mixing.mixed_documents(df, share=0.03).collect()
    assert [r.text for r in part] in (["w"], ["  one"])


def test_fingerprints_brute_force():
    """The votes of a text's shingles with plain integers."""
    import math
    from collections import Counter

    import pyarrow as pa

    m = (1 << 64) - 1

    def mix(x):
        for _ in (0, 1):
            x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & m
        return x ^ x >> 32

    def word(w):
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode())
        return mix((sum(int(common._TABLE[c]) * pow(common._ODD, i, 1 << 64) for i, c in enumerate(b)) + len(b)) & m)

    def brute(text):
        h = [word(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        votes = [0.0] * 128
        grams = Counter()
        for i in range(max(len(h) - 4, min(len(h), 1))):
            g = h[i]
            for step, x in enumerate(h[i + 1 : i + 5], 1):
                g = mix((g * int(fingerprints._C1) + x * int(fingerprints._C2) + step) & m)
            grams[g] += 1
        for g, n in grams.items():
            for half in (0, 1):
                value = mix((g + half * int(fingerprints._C2)) & m).to_bytes(8, "little")
                for bit in range(64):
                    votes[64 * half + bit] += (1 + math.log2(n)) * (1 if value[bit // 8] >> (7 - bit % 8) & 1 else -1)
        return "".join("1" if v > 1e-4 else "0" for v in votes)

    texts = ["", " ", "one", "ONE", "one two three", "a b c d e f g h", "x " * 30 + "y", "Ünï côdé 字 word " * 3, "a b c d e a b c d e a b c d e f"]
    got = fingerprints.fingerprints(pa.array([*texts, None]))
    assert ["".join(f"{b:08b}" for b in row) for row in got] == [*map(brute, texts), "0" * 128]


def _longest_matches(learnt, text):
    n, match = 1, ""
    for c in text:
        if match + c in learnt:
            match += c
        else:
            n, match = n + 1, c if c in learnt else ""
    return n


def test_language_brute_force(spark):
    rng = random.Random(8)
    speak = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    alphabets = {"aa": "abcdea bc", "bb": "abxyzx yz", "cc": "mnopab "}
    rows = [(i, speak(alphabets[k], rng.choice([5, 80, 700])), k) for i, k in enumerate(list(alphabets) * 30)]
    df = spark.createDataFrame([*rows, (900, "a", "zz"), (901, None, "aa"), (902, "12 !", "aa"), (903, "ab", None)], "doc_id long, text string, lang string")
    models = language_id.fit(df.where("doc_id < 60 or doc_id >= 900"))
    assert [m[0] for m in models] == ["aa", "bb", "cc", "zz"]
    samples = {}
    for k, n, moves in models:  # the learnt text is the automaton's longest path
        step = {(int(a), int(c)): int(b) for a, c, b in np.frombuffer(moves, np.int32).reshape(-1, 3)}
        longest, into = {0: ""}, sorted(step.items(), key=lambda x: x[0])
        changed = True
        while changed:
            changed = False
            for (a, c), b in into:
                if a in longest and len(longest[a]) + 1 > len(longest.get(b, "")):
                    longest[b], changed = longest[a] + chr(c), True
        samples[k] = max(longest.values(), key=len)
        assert len(samples[k]) == n
    out = {r.doc_id: r.lang_pred for r in language_id.identify(df, models).collect()}
    for i, t, _ in rows[60:]:
        parsed = "".join(map(chr, language_id.symbols(t)))
        if any(c != " " for c in parsed):
            need = {k: _longest_matches(x, parsed) for k, x in samples.items()}
            assert out[i] == min(sorted(need), key=need.get)
    assert out[901] == out[902] == "und" and out[900] in samples


def test_language_windows_and_large_alphabets(spark):
    """Phrases reach over the windows of long texts; 3000 letters do not widen the table; any number of labels works."""
    rng = random.Random(4)
    wide = [chr(0x4E00 + rng.randrange(3000)) for _ in range(40_000)]
    models = []
    for label, sample in (("wide", "".join(wide)), ("slim", "".join(rng.choice("abcd ") for _ in range(40_000)).replace("  ", " "))):
        learnt = language_id.symbols(sample)
        models.append((label, len(learnt), language_id.automaton(learnt).tobytes()))
    parser = language_id._Parser(models)
    assert sum(x.nbytes for x in (parser.table, parser.keys, parser.next, parser.column, parser.root_of)) < 150e6
    text = "".join(wide[100:2000]) + "".join(rng.choice("abcdz ") for _ in range(1500)) + "".join(wide[30_000:33_000])
    part = language_id.symbols(text)
    seen, learnt = "".join(map(chr, part)), ["".join(wide), "".join(map(chr, language_id.symbols(sample)))]
    assert parser.phrases([part, part[:300]])[:, 0].tolist() == [_longest_matches(x, seen) for x in learnt]
    rng = random.Random(1)
    own = {i: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for i in range(450)}
    many = spark.createDataFrame([(2 * i + k, " ".join(rng.choice(own[i]) for _ in range(60)), f"l{i}") for i in own for k in range(2)], "doc_id long, text string, lang string")
    models = language_id.fit(many.where("doc_id % 2 = 0"))
    assert [m[0] for m in models] == sorted(f"l{i}" for i in own)
    out = language_id.identify(many.where("doc_id % 2 = 1"), models)
    assert out.where("lang = lang_pred").count() == 450


def test_long_texts_in_stretches(spark):
    """A text that goes through in stretches has the phrases of one that goes through at once, whatever the stretch."""
    rng = random.Random(1)
    learnt = [language_id.symbols("".join(rng.choice(al) for _ in range(n))) for al, n in (("abc de", 2000), ("abcdef g", 3000), ("xyz ", 900), ("abab c", 2500))]
    parser = language_id._Parser([(str(i), len(x), language_id.automaton(x).tobytes()) for i, x in enumerate(learnt)])
    for _ in range(25):
        part = language_id.symbols("".join(rng.choice(rng.choice(["abc de", "abab", "xyz", "qabcé "])) for _ in range(rng.randint(1, 6000))))
        for lanes in (1, 2, 5):
            assert (parser.long_phrases(part, lanes) == parser.phrases([part])).all()
    words = "der die und ist nicht " * 20, "the and of is not " * 20
    df = spark.createDataFrame([(i, words[i % 2], "de" if i % 2 == 0 else "en") for i in range(8)], "doc_id long, text string, lang string")
    long = spark.createDataFrame([(1, words[0] * 5000), (2, words[1] * 5000), (3, "1 2 3 " * 300_000)], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(long, language_id.fit(df)).orderBy("doc_id").collect()] == ["de", "en", "und"]


def test_threads(spark):
    rows = [(1, t, "user", ("> m%d\n" % (t - 1) if t else "") + f"m{t}") for t in range(10)] + [(1, 11, "user", "> m4\nlate"), (2, 0, None, "only"), (None, None, "u", "lost")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    part, stretch = chat_formatting.PART, chat_formatting.STRETCH
    chat_formatting.PART, chat_formatting.STRETCH = 4, 3
    try:
        out = {(r.conv_id, r.thread, r.part): r for r in chat_formatting.threads(messages).collect()}
    finally:
        chat_formatting.PART, chat_formatting.STRETCH = part, stretch
    assert [out[1, 0, k].turns for k in range(3)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 11]] and out[1, 0, 2].parents == [7, 8, 4]
    assert out[2, 0, 0].formatted == "<|user|>\nonly\n<|end|>\n" and out[None, None, 0].turns == [-1] and "> m" not in out[1, 0, 0].formatted
    quoted = chat_formatting.conversations(chat_formatting.quoted_surrogate(common.load(spark, "/root/testdata/sf0.01", "conversations")))
    linked, n = quoted.agg(F.count("parent"), F.count("*")).collect()[0]
    assert linked > n / 2


def test_line_sets_by_join(spark, monkeypatch):
    """With more candidate lines than the marks take, texts are joined to them, with the same result."""
    d = common.load(spark, SF, "documents")
    want = sorted(map(str, line_dedup.repeated_lines(d, min_words=1).collect()))
    monkeypatch.setattr(line_dedup, "MARKED", 0)
    assert sorted(map(str, line_dedup.repeated_lines(d, min_words=1).collect())) == want
    monkeypatch.setattr(line_dedup, "CELL", 3)  # most words are split into grids of cells
    monkeypatch.setattr(line_dedup, "PART", 500)
    monkeypatch.setattr(line_dedup, "PAIRS", 50)
    assert sorted(map(str, line_dedup.repeated_lines(d, min_words=1).collect())) == want


def test_html_region_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        scores = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(rng.randint(0, 25))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        first, end = html_extraction.best_region(scores)
        assert sum(scores[first:end]) == max([0.0, *sums.values()])


def test_html_weights_decide(spark):
    """Without marks, class names known to PRIOR or HTML5 elements, what is the article is learnt from other pages."""
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    shell = '<div class="zork"><p>{a}</p></div><div class="bar1"><a href="x">{b}</a></div>{open}<div class="frumious"><p>{c}</p><p>{d}</p></div>{close}<div class="zork"><p>{e}</p></div>'
    page = lambda mark: shell.format(a=say(12), b=say(3), c=say(30), d=say(20), e=say(25), open=f"<{mark}>" if mark else "", close=f"</{mark}>" if mark else "")
    marked = [page(rng.choice(["article", "main"])) for _ in range(40)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(marked)], "page_id long, html string")
    weights = html_extraction.learn(df)
    assert weights.score["div"] < weights.score["p"] < 0 < weights.score["w"]
    plain = page("")
    want = "\n".join(re.findall("<p>([^<]*)</p>", plain)[1:3])
    assert html_extraction.article(plain, weights) == want != html_extraction.article(plain, html_extraction.Weights())
    other = weights.score | {"div": -0.01, "a": -0.01}
    assert html_extraction.article(plain, html_extraction.Weights(other)) != want


def test_html_region_and_costs_decide(spark, monkeypatch):
    """On the given pages, without their marks and names too, the region finds the article; without it, or without the costs
    of tags, or before learning, most pages come out otherwise."""
    pages = common.load(spark, SF, "pages")
    weights, texts = html_extraction.learn(pages), [r.html for r in pages.collect()]
    want = [html_extraction.article(x, weights) for x in texts]
    bare = [re.sub(r'</?article>|\s(?:class|id|role)="[^"]*"', "", x) for x in texts]
    assert [html_extraction.article(x, weights) for x in bare] == want
    free = html_extraction.Weights({k: v if k[:2] in ("w", "w@") else 0.0 for k, v in weights.score.items()})
    for other in (free, html_extraction.Weights()):
        assert sum(html_extraction.article(x, other) != w for x, w in zip(texts, want)) > 0.9 * len(texts)
    monkeypatch.setattr(html_extraction, "best_region", lambda scores: (0, len(scores)))
    assert sum(html_extraction.article(x, weights) != w for x, w in zip(texts, want)) > 0.9 * len(texts)


def test_html_loses_no_text(spark):
    """Wrappers with names of other things, pages in a form, lists of links in an article, elements that nothing closes."""
    for weights in (html_extraction.Weights(), html_extraction.learn(common.load(spark, SF, "pages"))):
        text = lambda page: html_extraction.article(page, weights)  # noqa: B023, E731
        for wrap in ("<div class='page with-sidebar'>{}</div>", "<div class='ad-hoc-networks'>{}</div>", "<form id=aspnetForm><div>{}</div></form>", "<div class=sidebar>{}</div>", "<div class='page no-ads'>{}</div>"):
            assert text(wrap.format("<p>a b c d e f g</p>")) == "a b c d e f g", wrap
        for tag in ("svg", "canvas", "noscript", "select"):
            assert text(f"<p>one two three four five</p><{tag}><p>six seven eight nine ten</p>") == "one two three four five\nsix seven eight nine ten", tag
        assert text("<p>one two three</p><script>no more") == "one two three"
        assert text("<article><p>x y z w</p><ul><li><a href=1>l1</a><li><a href=2>l2</a></ul><p>end of article here</p></article>") == "x y z w\nend of article here"
        assert text("<main><p>one two three</p><div class=comments><p>" + "no " * 90 + "</p></div><footer>so long</footer></main>") == "one two three"
    assert text("<p>" + "word " * 30 + "</p><div id=foot><p>Copyright 2020 All rights</p></div>") == " ".join(["word"] * 30)


def test_html_without_marks(spark):
    """The pages' own articles are found when their article tags are taken away before scoring."""
    pages = common.load(spark, SF, "pages")
    weights = html_extraction.learn(pages)
    want = {r.page_id: r.text for r in html_extraction.op8_html_extraction(spark, SF).collect()}
    for r in pages.collect():
        bare = re.sub("</?article>", "", r.html)
        assert "<article" not in bare and html_extraction.article(bare, weights) == want[r.page_id]


def test_html_hostile_pages():
    import time

    w = html_extraction.Weights()
    pages = ["<a " * 350_000, "<a " * 350_000 + ">", '<a ">' * 200_000 + '"', "<div>" * 100_000 + "</p>" * 100_000, "<div><p><div>" + "<b>" * 60_000 + "<p></p>" * 60_000, "<script " * 100_000 + ">", "<svg " * 100_000, "<!--" * 200_000, "<ul><li>a" * 50_000, "<p>&#" + "9" * 10_000 + ";</p>", "".join(f'<div class="x{chr(97 + i % 26) * (i % 300)}">x' for i in range(20_000))]
    for page in pages:
        began = time.process_time()
        html_extraction.article(page, w)
        assert time.process_time() - began < 8  # quadratic scans take minutes
    assert html_extraction.article("<p>Win<img>dow</p>", w) == "Window" and html_extraction.article("<p>One two three four.</p><svg/><p>five</p>", w) == "One two three four.\nfive"
    assert html_extraction.article('<article><div class="review-body"><p>One two three four.</p></div><p class="notice">Five six</p></article>', w) == "One two three four.\nFive six"
