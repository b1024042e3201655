"""The search for many literals against plain loops, and the merging of many items."""

import random

from pyspark.sql import functions as F

from cloakframe.operators import dictionary, merge, search
from cloakframe.operators.detect import KEYS

SEGMENT = "file_id string, sheet_index int, row int, col int, text string"


def segments(spark, texts):
    return spark.createDataFrame([("f", 0, k, 0, t) for k, t in enumerate(texts)], SEGMENT)


def places(texts, literals):
    return sorted((k, i, i + len(p), p) for k, t in enumerate(texts) if t for p in set(literals) if p for i in range(len(t) - len(p) + 1) if t.startswith(p, i))


def test_equals_plain_search(spark, monkeypatch):
    """Any lengths, shared prefixes, other scripts, pieces of long texts."""
    monkeypatch.setattr(search, "RUN_CHARS", 90)
    r = random.Random(4)
    alphabet = "ab é中🙂\x01"
    texts = ["".join(r.choices(alphabet, k=r.choice([0, 1, 7, 60, 400]))) for _ in range(60)] + [None, ""]
    literals = [t[i : i + r.choice([1, 2, 3, 5, 8, 17, 70, 130])] for t in texts if t for i in (r.randrange(len(t)),)] + ["", None, "zz", "ab" * 40]
    found = search.find_literals(segments(spark, texts).repartition(3), KEYS, "text", spark.createDataFrame([(x,) for x in literals * 2], "look string"))
    assert sorted((x.row, x.start, x.end, x.look) for x in found.collect()) == places(texts, literals)


def test_no_literals_and_no_texts(spark):
    none = spark.createDataFrame([], "look string")
    assert search.find_literals(segments(spark, ["a"]), KEYS, "text", none).collect() == []
    assert search.find_literals(segments(spark, []), KEYS, "text", spark.createDataFrame([("a",)], "look string")).collect() == []


def test_large_dictionary(spark):
    """200,000 entries with common beginnings, joined by a shuffle as well as by a broadcast."""
    entries = spark.range(200_000).selectExpr("cast(id as int) entry_idx", "concat('Customer#', lpad(cast(id as string), 9, '0')) text", "'Name' type", "'Exact' match_mode", "cast(null as string) replacement", "cast(null as string) language")
    texts = [f"of Customer#{k:09d}, CUSTOMER#{k:09d}" for k in range(0, 400_000, 4000)]
    found = dictionary.detect_dictionary(segments(spark, texts), entries)
    assert sorted((x.row, x.start, x.text, x.entry_idx) for x in found.collect()) == [(k, 3, f"Customer#{k * 4000:09d}", k * 4000) for k in range(50)]
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entries_that_overlap_themselves(spark):
    entries = spark.createDataFrame([(0, "aa", "T", "Exact", None, None), (1, "ABA", "U", "Fuzzy", None, None), (2, "aa", "V", "Exact", None, "en")], dictionary.ENTRY)
    got = sorted((x.row, x.start, x.text, x.type) for x in dictionary.detect_dictionary(segments(spark, ["aaaaa", "abAbaba"]), entries).collect())
    assert got == [(0, 0, "aa", "T"), (0, 0, "aa", "V"), (0, 2, "aa", "T"), (0, 2, "aa", "V"), (1, 0, "abA", "U"), (1, 4, "aba", "U")]


def test_merge_equals_fold(spark):
    r, rows = random.Random(9), []
    for row in range(30):
        for k in range(r.choice([0, 1, 5, 40])):
            s = r.randrange(60)
            rows.append(("f", 0, row, 0, k, s, s + r.randint(1, 9), f"t{k}", "T", r.choice(["Regex", "Dict", "Ner", "Manual"]), 1.0))
    df = spark.createDataFrame(rows, "file_id string, sheet_index int, row int, col int, ord int, start int, end int, text string, type string, source string, confidence double")
    want = []
    for row in range(30):
        own = sorted((x for x in rows if x[2] == row), key=lambda x: (["Regex", "Dict", "Ner", "Manual"].index(x[9]), x[4]))
        kept = [x for x in own if x[9] == "Regex"]
        for x in own:
            if x[9] != "Regex" and not any(x[5] < y[6] and y[5] < x[6] for y in kept):
                kept.append(x)
        want += [(row, k, x[5], x[7]) for k, x in enumerate(kept)]
    assert sorted((x.row, x.ord, x.start, x.text) for x in merge.merge_no_overlap(df).collect()) == sorted(want)


def test_many_items_in_one_segment(spark):
    """20,000 items of one segment: a sweep, no comparison of all with all."""
    items = spark.range(20_000).select(F.lit("f").alias("file_id"), F.lit(0).alias("sheet_index"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("id").alias("ord"), (F.col("id") * 3).cast("int").alias("start"), (F.col("id") * 3 + F.when(F.col("id") % 5 == 0, 4).otherwise(2)).cast("int").alias("end"), F.lit("x").alias("text"), F.lit("T").alias("type"), F.lit("Dict").alias("source"), F.lit(1.0).alias("confidence"))
    assert merge.merge_no_overlap(items).count() == 16_000
