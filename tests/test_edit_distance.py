"""The bit-parallel edit distance against the table of all prefixes."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from regionspark.functions import edit_distance as e
from regionspark.operators.evaluate import character_errors


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def pairs(n, seed=0):
    rng = random.Random(seed)
    letters = lambda k, al: "".join(rng.choice(al) for _ in range(k))
    for _ in range(n):
        al = rng.choice(["ab", "abcdefgh", "aé字\U0001f600\x00z"])
        a = letters(rng.choice([0, 1, 3, 20, 63, 64, 65, 130, 200]), al)
        b = list(a)
        for _ in range(rng.choice([0, 1, 3, 30])):
            if b and rng.random() < 0.5:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randint(0, len(b)), rng.choice(al))
        yield a, "".join(b) if rng.random() < 0.5 else letters(rng.choice([0, 1, 3, 20, 63, 64, 65, 130, 200]), al)


@pytest.mark.parametrize("bound,wide,cells", [(64, 128, 1 << 21), (4, 0, 1 << 21), (1, 0, 500), (64, 0, 100)])
def test_equals_brute_force(monkeypatch, bound, wide, cells):
    for name, value in (("BOUND", bound), ("OPEN", wide), ("CELLS", cells)):
        monkeypatch.setattr(e, name, value)
    some = list(pairs(400))
    assert e.distances(pa.array([a for a, _ in some]), pa.array([b for _, b in some])).tolist() == [brute(a, b) for a, b in some]
    assert e.distances(pa.array([], pa.string()), pa.array([], pa.string())).tolist() == []


def test_long_texts_in_few_passes(monkeypatch):
    rng, seen, group = random.Random(1), [], e._group
    a = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    b = a[:5000] + "x" + a[5100:15000] + "q" * 300 + a[15000:]
    monkeypatch.setattr(e, "_group", lambda *x: seen.append(x[-1]) or group(*x))
    assert e.distances(pa.array([a]), pa.array([b])).tolist() == [400]
    assert len(seen) == 1


def test_column(spark):
    some = [*pairs(60, seed=3), (None, "a"), ("abc", None), (None, None), ("same", "same"), ("", None)]
    df = spark.createDataFrame(some, "a string, b string").repartition(3)
    for r in df.select("a", "b", character_errors(F.col("a"), F.col("b")).alias("n"), e.edit_distance(F.col("a"), F.col("b")).alias("d")).collect():
        want = None if r.a is None or r.b is None else brute(r.a, r.b)
        assert r.d == want and r.n == (max(1, len(r.a or "")) if r.b is None else want)


def test_bounds_that_meet_end_pairs(monkeypatch):
    """Replaced letters and an appended one need no bit vectors; pairs whose bounds differ still get them."""
    import random

    import pyarrow as pa

    from regionspark.functions import edit_distance as d

    rng = random.Random(5)
    texts = ["".join(rng.choice("aeio ü字") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    copies = [t.replace("e", "o") + "x" for t in texts]
    groups, own = [], d._group
    monkeypatch.setattr(d, "_group", lambda *a: groups.append(1) or own(*a))

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    assert d.distances(pa.array(texts), pa.array(copies)).tolist() == [plain(a, b) for a, b in zip(texts, copies)] and not groups
    others = texts[1:] + texts[:1]
    monkeypatch.setattr(d, "CELLS", 500)
    assert d.distances(pa.array(texts), pa.array(others)).tolist() == [plain(a, b) for a, b in zip(texts, others)] and groups
