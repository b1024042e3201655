import duckdb
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import mixing as m


def test_against_sql(spark, sf_dir):
    duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'")
    want = sorted(duckdb.sql(m.sql()).fetchall())
    cols = ["doc_id", "topic", "n_tokens", "p", "keep"]
    got = sorted(tuple(r[c] for c in cols) for r in m.op6_mixing(spark, sf_dir).collect())
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-9)
    assert 0.1 < sum(x[4] for x in got) / len(got) < 1


def test_targets_are_met(spark):
    cells = spark.createDataFrame([(s, lang, t, 100 + 37 * i) for i, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 3, "b": 1}, "lang": {"x": 1, "y": 1}, "topic": {"p": 2, "q": 3}}
    frames = {k: spark.createDataFrame([(a, float(b)) for a, b in v.items()], "value string, weight double") for k, v in want.items()}
    rows = m.rake(cells, frames, rounds=30).collect()
    total = sum(r.raked for r in rows)
    for k, v in want.items():
        for value, weight in v.items():
            assert sum(r.raked for r in rows if r[k] == value) / total == pytest.approx(weight / sum(v.values()), abs=1e-6)
    assert max(r.p for r in rows) == pytest.approx(1)


def test_edges(spark):
    rows = [(1, "a b c", None, None), (1, "a b c", None, None), (None, None, "s", "en"), (2, "", "s", "en"), (3, "x | y", "s", None), (4, "w " * 50000, "t", "de")]
    df = spark.createDataFrame([(*r, "k", 0.5) for r in rows], "doc_id long, text string, source string, lang string, topic string, mix_p double")
    got = m.mix(df).collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"doc_id", "text", "source", "lang", "topic", "mix_topic", "mix_tokens", "mix_p", "mix_keep"}
    assert len({(r.mix_p, r.mix_keep) for r in got if r.doc_id == 1}) == 1
    assert {r.mix_tokens for r in got} == {0, 3, 50000}
    assert m.mix(df.limit(0)).collect() == []
    assert {r.mix_keep for r in m.mix(df.where("doc_id = 2")).collect()} == {False}


def test_default_targets_are_met_and_names_may_clash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cells = m.with_margins(docs).groupBy(*m.MARGINS).agg(F.sum("tokens").alias("tokens"))
    raked = m.rake(cells)
    assert max(m.residuals(raked).values()) < 1e-3
    missing = spark.createDataFrame([("no such source", 1.0), *[(r.source, 1.0) for r in cells.select("source").distinct().collect()]], "value string, weight double")
    assert m.residuals(m.rake(cells, {"source": missing}))["source"] < 1e-3  # the values that there are share the tokens
    none = spark.createDataFrame([(lang, float(lang == "en")) for lang in ("en", "de", "fr", "es", "")], "value string, weight double")
    source = cells.where("lang <> 'en'").select("source").distinct().crossJoin(spark.range(1)).selectExpr("source as value", "1.0D as weight")
    assert set(m.residuals(m.rake(cells, {"lang": none, "source": source}))) == set(m.MARGINS)
    odd = docs.limit(20).withColumns({"__mix_x": F.lit(1), "__mix_topic": F.lit("mine"), "topic": F.lit("t"), "rest": F.lit(0), "u": F.lit(9), "tokens": F.lit("z"), "mix_p": F.lit(5)})
    got = m.mix(odd)
    assert [c for c in got.columns if not c.startswith("mix_")] == [c for c in odd.columns if c != "mix_p"]
    assert {(r["__mix_x"], r["__mix_topic"], r["topic"], r["u"], r["tokens"]) for r in got.collect()} == {(1, "mine", "t", 9, "z")}


def test_a_rare_cell_does_not_press_the_rest(spark):
    """One token in a cell of its own is kept whole, and the others keep the budget's share."""
    rows = [(k, "a b c d", "s", "en") for k in range(2000)] + [(5000, "x", "rare", "xx")]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    p = {r.source: r.mix_p for r in got}
    assert p["rare"] == 1 and p["s"] == pytest.approx(0.9, abs=1e-3)
    assert sum(r.mix_keep for r in got) > 1700


def test_arrays_and_joins_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").union(spark.createDataFrame([(10**6, "one", "en", "odd", 3), (10**6 + 1, "", "zz", "src0", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    cells = m.with_margins(docs).groupBy(*m.MARGINS).agg(F.sum("tokens").alias("tokens"))
    for budget in (0.3, 0.9, 1.0):
        a, b = ({tuple(r[c] for c in m.MARGINS): (r.p, r.raked) for r in m.rake(cells, rounds=3, budget=budget, few=few).collect()} for few in (10**6, 0))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
        kept = sum(r.tokens * a[tuple(r[c] for c in m.MARGINS)][0] for r in cells.collect())
        assert kept == pytest.approx(budget * cells.agg(F.sum("tokens")).first()[0], rel=1e-6)
