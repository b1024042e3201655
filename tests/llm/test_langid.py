import numpy as np
from pyspark.sql import functions as F

from cloakframe.llm import langid as m


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = m.op3_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    bad = [r for r in got if r.lang != r.lang_pred]
    print(len(got), right, bad[:10])
    assert len(got) > 100 and right >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the and of", "en"), ("der die und", "de"), ("les des une", "fr"), ("que los para", "es")] * 6)]
    odd = [(None, None, None), (100, "", "en"), (101, "123 !!", "de"), (102, "the of and " * 20000, None), (102, "und der die", None)]
    df = spark.createDataFrame([(a, b, c, 1.0) for a, b, c in rows + odd], "doc_id long, text string, lang string, score double")
    model = m.fit(df)
    got = m.predict(df, model, ["doc_id", "lang"]).collect()
    assert len(got) == len(rows) + len(odd)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(None, "und"), (100, "und"), (101, "und"), (102, "en"), (102, "de")} <= by
    assert sum(r.lang == r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 24) == 24
    empty = df.limit(0)
    assert m.predict(empty, m.fit(empty), ["doc_id"]).collect() == []
    assert {r.lang_pred for r in m.predict(df, m.fit(empty), ["doc_id"]).collect()} == {"und"}
    only = m.fit(df.where("lang = 'en'"))
    assert {r.lang_pred for r in m.predict(df, only, ["doc_id"]).collect()} == {"und", "en"}


def test_against_plain_dictionaries(spark, sf_dir):
    """Decisions equal slow voting over n-gram counts in dictionaries, and clashing columns do no harm."""
    import math

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = m.fit(docs.where(~m.held_out()))
    some = docs.limit(60).withColumns({"score": F.lit("s"), "lang_pred": F.lit(1), "rest": F.lit(2.5)})
    got = {r.doc_id: r for r in m.predict(some, model, ["doc_id", "score", "rest", "lang_pred"]).collect()}
    assert {r.rest for r in got.values()} == {2.5}

    def counts(text):
        out = {}
        for x in m.feature_ids(np.frombuffer(text, np.uint8), np.zeros(min(1, len(text)), np.int64)):
            for k in x.tolist():
                out[k] = out.get(k, 0) + 1
        length = math.sqrt(sum(v * v for v in out.values())) or 1.0
        return {k: v / length for k, v in out.items()}

    def vote(names, margin):
        best = None
        for a in names:
            won, score = 0, 1.0
            for b in names:
                if a != b:
                    p = 1 / (1 + math.exp(-4 * (margin[a, b] if (a, b) in margin else -margin[b, a])))
                    won += (p >= 0.5 if (a, b) in margin else 1 - p < 0.5) + 1e-3 * p
                    score = min(score, p)
            best = max(best or (-1, None, 0), (won, a, score), key=lambda x: x[0])
        return best[1], best[2]

    for r in some.collect():
        x = counts(r.text.encode()) if r.text else {}
        margin = {p: sum(float(w[k]) * v for k, v in x.items()) + float(w[-1]) for p, w in zip(model.pairs, model.weights)}
        family, one = vote(model.families, margin)
        lang, two = vote([v for v in model.langs if m.FAMILY.get(v, v) == family], margin)
        if any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, round(got[r.doc_id].score, 4)) == (lang, round(one * two, 4))
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
