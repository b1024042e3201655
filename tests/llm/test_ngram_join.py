import random

import duckdb

from cloakframe.llm import ngram_join as m


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_against_sql(spark, sf_dir):
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(m.sql()).fetchall(), key=repr)
    got = rows(m.op1_ngram_join(spark, sf_dir))
    assert got == want
    assert sum(r[0] != r[2] for r in want) > 3


def test_near_copies(spark, monkeypatch):
    """Groups of edited copies around the threshold, chains, shared passages and copies."""
    monkeypatch.setattr(m, "GROUP", 7)
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    data = []
    for group in range(4):
        base = [f"g{group}w{rng.randrange(200)}" for _ in range(120)]
        current = base
        for i in range(40):
            w = list(rng.choice([base, current]))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                w = w[: len(w) - rng.randrange(20)]
            current = w if rng.random() < 0.2 else current
            data.append(" ".join(w))
    data += [" ".join(passage + [f"u{i}x{k}" for k in range(rng.randrange(30))]) for i in range(40)]
    data += [rng.choice(data) for _ in range(30)] + ["a b", "A  b", "a", "a b c d", None, "", " "]
    rng.shuffle(data)
    ids = rng.sample(range(10_000), len(data))
    table = list(zip(ids, data))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    for k, percent in ((4, 85), (5, 80)):
        assert rows(m.jaccard_components(df, k, percent)) == sorted(m.brute_force(table, k, percent), key=repr)


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    data = [(5, None), (5, ""), (6, long), (7, long + " end"), (7, long), (7, "quite another text of words"), (None, long), (8, "a b c"), (9, "A B C")]
    df = spark.createDataFrame([(*r, 3, 4) for r in data], "doc_id long, text string, n int, node int")
    assert rows(m.jaccard_components(df)) == sorted(m.brute_force(data), key=repr)
    assert rows(m.jaccard_components(df.limit(0))) == []
