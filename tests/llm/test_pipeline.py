"""The pipeline's stages on their own inputs."""

import hashlib
import random
import re

import corpus_pipeline as p
from pyspark.sql import functions as F

from regionspark.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    first = docs = common.load(spark, SF, "documents")
    rows = {"documents": docs.collect()}
    for name, stage in p.STAGES:
        docs = common.written(stage(spark, docs, SF))
        if name != p.STAGES[-1][0]:
            assert docs.columns == first.columns
            assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        rows[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in rows.items()}
    assert ids["documents"] >= ids["quality_rules"] >= ids["line_dedup"] >= ids["jaccard_join"] >= ids["mixing"] >= ids["byte_bpe"]
    seen = set()
    for r in sorted(rows["line_dedup"], key=lambda r: r.doc_id):
        for line in r.text.split("\n"):
            words = frozenset(line.lower().split())
            assert len(line.split()) < 5 or words not in seen
            seen.add(words)
    total = sum(len(r.text.split()) for r in rows["jaccard_join"])
    assert abs(sum(len(r.text.split()) for r in rows["mixing"]) - 1.5 * total) <= 25
    assert len(rows["mixing"]) == len(rows["byte_bpe"]) and all(r.round_trip for r in rows["byte_bpe"])


def test_odd_input(spark):
    rng = random.Random(5)
    fine = " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(3, 8))) for _ in range(40))
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, fine, "en", "s", len(fine), "x"), (3, fine, "en", "s", len(fine), "x"), (4, "few words", "en", "s", 9, "x"), (None, fine[::-1], None, None, None, "x")], "doc_id long, text string, lang string, source string, n_chars long, size string")
    left = {}
    docs = odd
    for name, stage in p.STAGES:
        docs = common.written(stage(spark, docs, SF))
        left[name] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) if "text" in docs.columns else docs.collect()
    kept = [(3, fine), (3, fine), (None, fine[::-1])]  # rows of one id stand or fall together
    assert left["quality_rules"] == left["line_dedup"] == left["jaccard_join"] == kept
    # 180 words in all, by 5 to 2: 128.6 of the repeated rows' 80, 51.4 of the 40 of the source null
    assert sorted((str(i), len(t.split())) for i, t in left["mixing"]) == [("3", 24), ("3", 24), ("3", 40), ("3", 40), ("None", 11), ("None", 40)]
    assert all((fine if i else fine[::-1]).startswith(t) for i, t in left["mixing"])
    assert len(left["byte_bpe"]) == 6 and all(r.round_trip and r.n_tokens * 4 == len(r.ids) for r in left["byte_bpe"])
    docs = odd.limit(0)
    for _, stage in p.STAGES:
        docs = common.written(stage(spark, docs, SF))
        assert docs.count() == 0


def test_short_lines(spark):
    """Lines of any word count are compared, also a set of four words with one of five that holds it (4 / 5 = 0.8)."""
    rng = random.Random(7)
    texts = ["Read more\nk l m n o\nAll rights reserved\nx", "read MORE\nl m n o\nmore\nm n o", "x\nmore read", "Read", "\n\nall rights", "X\n\ny z\n"]
    texts += ["\n".join(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(0, 5))) for _ in range(40)]
    seen, want = [], {}
    for i, t in enumerate(texts):
        kept = []
        for line in t.split("\n"):
            w = set(line.lower().split())
            if not any(w and 100 * len(w & x) >= 80 * len(w | x) for x in seen):
                kept.append(line)
            seen.append(w)
        if "\n".join(kept).split() or len(kept) == len(t.split("\n")):
            want[i] = "\n".join(kept)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in p.lines(spark, docs, SF).collect()}
    assert {i: r.text for i, r in out.items()} == want and all(r.n_chars == len(r.text) for r in out.values())


def _kept_lines(rows):
    seen, out = [], []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        kept = []
        for line in (r["text"] or "").split("\n"):
            w = set(common_words(line))
            if not any(w and 100 * len(w & x) >= 80 * len(w | x) for x in seen):
                kept.append(line)
            seen.append(w)
        text = "\n".join(kept)
        if text == r["text"] or common_words(text):
            out.append(r | {"text": text})
    return out


def common_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))


def _one_of_each(rows):
    sets = {}
    for r in rows:
        w = common_words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return [r for r in rows if label[r["doc_id"]] == r["doc_id"]]


def _mixed(rows):
    size = {r["doc_id"]: len(common_words(r["text"])) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[r["doc_id"]] for r in rows if r["source"] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    left, free, target = 1.5 * sum(total.values()), dict(weight), {}
    while free:
        unit = left / sum(free.values())
        full = [s for s in free if unit * weight[s] > 2 * total[s]]
        for s in full or list(free):
            target[s] = min(unit * weight[s], 2.0 * total[s])
        left -= sum(target[s] for s in full)
        free = {s: w for s, w in free.items() if s not in full} if full else {}
    queue = []
    for s in sources:
        begin = 0
        turns = sorted((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]) for r in rows if r["source"] == s and size[r["doc_id"]])
        for epoch in (1, 2):
            for turn, k in turns:
                n = size[k]
                pieces = [(0, n)] if begin + n <= target[s] else [(i, 1) for i in range(n) if begin + i < target[s]]
                queue += [((begin + at + w) / target[s], s is None, s or "", turn, k, epoch, at, w) for at, w in pieces]
                begin += n
    taken, budget = {}, int(1.5 * sum(total.values()))
    for *_, k, _, _, w in sorted(queue):
        w = min(w, budget)
        budget -= w
        taken[k] = taken.get(k, 0) + w
    out = []
    for r in rows:
        n, t = size[r["doc_id"]], taken.get(r["doc_id"], 0)
        if t:
            ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"])]
            out += [r] * (t // n) + ([r | {"text": r["text"][: ends[t % n - 1]]}] if t % n else [])
    return out


def test_against_brute_force(spark, tmp_path):
    """All stages on a few documents against plain Python: the rules by their SQL, line and document sets compared pair by
    pair, one sorted queue, and the tokenizer's own library."""
    import duckdb
    import public_tokenizers
    import tiktoken

    from regionspark.llm import byte_bpe, quality_rules

    docs = common.load(spark, SF, "documents").where("doc_id < 90").unionByName(common.load(spark, SF, "documents").where("doc_id between 20 and 40").withColumns({"doc_id": F.col("doc_id") + 1000, "text": F.concat("text", F.lit(" and one more"))}))
    docs = docs.union(spark.createDataFrame([(2000, "Menu\nRead more\nof this text with ten words or more in the first line", "en", None, 70), (2001, "menu\nread  more\nanother first line that has more than ten words in it again", "en", "zz", 70)], docs.schema))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    rows = [r.asDict() for r in docs.collect() if r.doc_id in kept]
    own = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    want = sorted((r["doc_id"], lib.encode_ordinary(r["text"])) for r in _mixed(_one_of_each(_kept_lines(rows))))
    got = sorted((r.doc_id, [int.from_bytes(r.ids[i : i + 4], "little") for i in range(0, len(r.ids), 4)]) for r in p.run(spark, str(tmp_path)).collect())
    assert got == want and len(kept) > 40
