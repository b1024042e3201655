import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from cloakframe.llm import importance_resampling as ir


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) by the rule, one row after the other."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    S, T, out = sum(s.values()), sum(t.values()), {}
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in s}
    for k, (doc_id, text) in enumerate(docs):
        words, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out[k] = [doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)]
    pool = sorted((k for k in out if out[k][5] >= 20), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, -out[k][1]))
    for rank, k in enumerate(pool[: 25 * len(pool) // 100], 1):
        out[k][4] = rank
    return sorted((tuple(x[:5]) for x in out.values()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("rest.doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equals_brute_force(spark):
    docs = [(k, " ".join(f"w{(k * j) % 37} É{j % 5}-B{j}" for j in range(k))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "..."), (None, "a b " * 15), (7, docs[39][1]), (103, "One"), (104, "x\u0000y Z" * 9)]
    target = ["w1 w2 É1 b5", None, "a b a b", "Z zz"]
    given = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id long, text string, weight string, n_features int").repartition(5)
    found = ir.resample(given, spark.createDataFrame([(t,) for t in target], "text string"))
    assert rows_of(found) == brute(docs, target)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ir, "RUN_BYTES", 50)
    text = " ".join(f"Wört{j % 11},x{j % 7}" for j in range(300)) + " " + "q" * 200 + " end"
    counter, words = ir.Counter(10_000, 2), features(text)
    at, n = counter.long_text(text.encode())
    want = Counter(zlib.crc32(f.encode()) % 10_000 for f in words[1])
    assert dict(zip(at.tolist(), n.tolist())) == {**want, -1: len(words[0])}
    assert [p for p, _ in ir.pieces(b"", 5, 1)] == []


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    found = ir.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "text string"))
    assert rows_of(found) == brute(rows, [])
