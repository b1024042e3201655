"""The SQL functions of detection against the Column functions, and their cost on plain texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.spans import detect_spans
from cloakframe.functions.sqlfunctions import register
from cloakframe.operators.rules import rules_for

PIECES = ["12345", "12345-6789", "123-45-6789", "(555) 123-4567", "4111 1111 1111 1111", "AB123456", "10.0.0.1", "999.1.1.1", "a.b@c.de", "x@y.z1.com", "fe80::1", "1:2:3:4:5:6:7:8", "SW1A 1AA", "A123-4567-8901", "13812345678", "京A12345", "010-12345678", "11010519491231002X", "word", "é", "😀", " ", "-", ".", "\n", "\x01"]


@pytest.mark.parametrize("language", ["en", "zh"])
def test_same_spans_as_the_columns(spark, language):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(PIECES) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(40)))) for k in range(400)] + [(1_000, None), (1_001, ""), (1_002, "no digits")]
    register(spark)
    df = spark.createDataFrame(rows, "id long, text string")
    df.createOrReplaceTempView("detect_texts")
    got = {r.id: r.spans for r in spark.sql(f"SELECT id, detect_{language}(text) AS spans FROM detect_texts").collect()}
    want = {r.id: r.spans for r in detect_spans(df, "text", rules_for(language)).collect()}
    assert got == want and sum(map(len, got.values())) > 1_000


def seconds(spark, rows):
    register(spark)
    df = spark.createDataFrame(rows, "text string").coalesce(1).localCheckpoint()
    df.createOrReplaceTempView("detect_timed")
    query = "SELECT sum(size(detect_en(text))) AS n FROM detect_timed"
    spark.sql(query.replace("detect_timed", "(SELECT * FROM detect_timed LIMIT 1)")).collect()
    start = time.time()
    n = spark.sql(query).first().n
    return n, time.time() - start


def test_plain_texts_are_passed_over(spark):
    """Texts without a digit, '@' or ':' cost a few searches (8 MB took more than 20 s with every rule tried)."""
    n, took = seconds(spark, [("plain words of a text " * 400,)] * 900)
    assert n == 0 and took < 8
