import random

from cloakframe.llm import slices
from cloakframe.llm import substring_dedup as m


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(m.brute_force([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert rows(m.dedup(docs, 20_000, 3_000)) == want
    assert sum(r[2] > 0 for r in want) > 10


def test_random_overlaps(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    data = []
    for i in range(60):
        w = [f"d{i}x{k}" for k in range(rng.randrange(20))]
        for _ in range(rng.randrange(4)):
            a, n = rng.randrange(380), rng.choice([5, 12, 13, 14, 19, 20, 26, 60])
            w += base[a : a + n] + [f"s{rng.randrange(9)}"] * rng.randrange(15)
        data.append((rng.randrange(1000), rng.choice([" ", "\n", "\t  "]).join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(m.dedup(df, 2_000, 1_000)) == sorted(m.brute_force(data), key=repr)


def test_one_doc_id_for_many_rows(spark):
    """Slices end inside the rows of one doc_id, which are no sources for each other."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(50)}" for _ in range(300)]
    data = []
    for _ in range(400):
        a = rng.randrange(250)
        data.append((rng.choice([1, 7, 7, 7, 7, 7, 7, 7, 8, 9, 20]), " ".join(base[a : a + rng.randrange(40)])))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    sizes = [(r.slice, r.rank, len(r.text)) for r in slices.build_slices(df, 1, 1_500).collect()]
    assert len(sizes) > 20 and max(n for *_, n in sizes) < 1_800
    assert rows(m.dedup(df, 1_500)) == sorted(m.brute_force(data), key=repr)


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    data = [(5, None), (5, ""), (6, long), (7, long), (7, long), (None, long), (8, "a b c"), (9, "a b c"), (10, " ".join(["x"] * 40)), (11, " ".join(["x"] * 13)), (12, " ".join(["x"] * 12))]
    df = spark.createDataFrame([(*r, 3, b"t") for r in data], "doc_id long, text string, slice int, entries binary")
    assert rows(m.dedup(df)) == sorted(m.brute_force(data), key=repr)
    assert m.dedup(df.limit(0)).collect() == []
