import random
import re
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cloakframe.llm import decontaminate, mixing, ngram_join, token_files
from cloakframe.llm.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "12 !!", "en", "s", 5), (-3, "a word", None, None, 6), (None, "no id here at all", "en", "src0", 3)], docs.schema)
    near = docs.limit(20).selectExpr("doc_id + 100000 as doc_id", "concat(text, ' tail') as text", "lang", "source", "n_chars")
    near = near.union(near)
    docs = materialize(docs.union(odd).union(near), "docs")
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = list({(r.doc_id, r.text): tuple(r) for r in docs.collect()}.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontaminate", "mix_sources", "token_output"]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf_dir), name)
        got = sorted((tuple(r) for r in out.collect()), key=repr)
        if name == "language_id":
            rows = [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
            assert out.columns == COLUMNS
            lang = {(r.doc_id, r.text): r.lang for r in out.collect()}
            assert None not in lang.values() and all(r[2] in (None, lang[r[:2]]) for r in rows) and len(lang) == len(rows)
            rows = [(*r[:2], lang[r[:2]], *r[3:]) for r in rows]
            docs = out
            continue
        if name == "near_duplicates":
            group = {d: c for d, _, c in ngram_join.brute_force([r[:2] for r in rows], 5, 80)}
            rows = [r for r in rows if r[0] is None or group[r[0]] == r[0]]
        elif name == "decontaminate":
            hit = {d for d, *_, bad in decontaminate.brute_force([r[:2] for r in rows], bench) if bad}
            rows = [r for r in rows if r[0] not in hit]
        elif name == "mix_sources":
            docs.toPandas().to_parquet(tmp_path / "d.parquet")
            table = f"(select doc_id::BIGINT as doc_id, text, lang, source from '{tmp_path}/d.parquet')"  # pandas has no null in integers
            keep = dict(duckdb.sql(f"select doc_id, keep from ({mixing.sql(docs=table)})").fetchall())
            rows = [r for r in rows if keep[r[0]]]
        else:
            t = Tokenizer.from_file(token_files.default_tokenizer())
            want, at = [], 0
            for r in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
                ids = np.array([*t.encode(r[1], add_special_tokens=False).ids, 2], "<u4")
                want.append((r[0], at, len(ids), zlib.crc32(ids.tobytes())))
                at += len(ids)
            assert got == sorted(want, key=repr)
            break
        assert out.columns == COLUMNS and got == sorted(rows, key=repr)
        docs = out
    assert len(rows) > 50


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_columns_that_clash(spark, sf_dir):
    names = ["score", "lang_pred", "__mix_topic", "rest", "spans", "items", "n_words", "topic"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    for name in names:
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == [*COLUMNS, *names]
        assert {tuple(r[c] for c in names) for r in docs.collect()} == {("x",) * len(names)}


def test_one_id_on_a_copy_and_a_clean_text(spark):
    """A row goes with its group, not with its doc_id."""
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b, c = words(60), words(60), words(60)
    rows = [(1, a), (2, a + " tail"), (2, b), (3, b + " end"), (4, c), (4, c + " more"), (4, c), (None, a), (5, None), (6, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    fours = [x for x in got if x[0] == 4]
    assert len(fours) == 1 and fours[0] in rows
    assert sorted((x for x in got if x[0] != 4), key=repr) == sorted([(1, a), (2, b), (None, a), (5, None), (6, "")], key=repr)
