import random

import numpy as np
import pytest

from cloakframe.llm import suffix_tree_lm as m


def check(got, rows, **kinds):
    want = sorted(m.brute_force(rows, **kinds), key=lambda r: repr((r[:5], round(r[5], 6), round(r[6], 6))))
    got = sorted(map(tuple, got), key=lambda r: repr((r[:5], round(r[5], 6), round(r[6], 6))))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for k in (5, 6):
        assert [r[k] for r in got] == pytest.approx([r[k] for r in want], rel=1e-9)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = m.score(docs, slice_bytes=50_000, bucket_text=40_000).collect()
    check(got, [(r.doc_id, r.text) for r in docs.collect()])
    for held in (True, False):
        own = [r for r in got if r.held_out == held]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)


def chain(rng, n):
    """Sequences with contexts of one, two and three words that matter."""
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(40)):
            past = tuple(w[-3:])
            w.append(f"w{hash_(past) % 7}" if rng.random() < 0.6 else f"w{rng.randrange(7)}")
        out.append(" ".join(w))
    return out


def hash_(past):
    return sum((k + 3) * int(x[1:]) for k, x in enumerate(past))


def test_contexts_of_any_length_and_spread(spark):
    rng = random.Random(11)
    rows = [(i if i % 17 else None, t) for i, t in enumerate(chain(rng, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    scores = {}
    for kinds in ({"max_words": 1}, {"max_words": 4}, {"max_words": 4, "min_count": (3, 2)}, {"max_words": 3, "spread": 40}):
        got = m.score(df, slice_bytes=700, bucket_text=500, **kinds).collect()
        check(got, rows, **kinds)
        scores[str(kinds)] = sum(r.score for r in got if r.held_out)
    assert scores["{'max_words': 4}"] > scores["{'max_words': 1}"]


def test_repeated_documents_stand_out(spark):
    """What was seen twice is expected the second time."""
    rng = random.Random(2)
    texts = [" ".join(f"v{int(rng.paretovariate(0.3)) % 5000}" for _ in range(60)) for _ in range(200)]
    rows = list(enumerate(texts + texts[:20]))
    got = {r.doc_id: r for r in m.score(spark.createDataFrame(rows, "doc_id long, text string"), min_count=(2, 2)).collect()}
    gain = {i: (r.score - r.base_score) / r.n_tokens for i, r in got.items()}
    trained = [i for i in range(20) if not m.held_out(i) and not m.held_out(i + 200)]
    others = [gain[i] for i in range(20, 200)]
    assert len(trained) > 8 and np.median([gain[i] for i in trained]) > np.percentile(others, 95)


def test_distributions_add_up(spark):
    """The probabilities of all words after a context, and of one unknown, add up to one."""
    rows = [(k, t) for k, t in enumerate(["a b a b c", "b a c c a", "a b c b b a", "c a b a"] * 3)]
    words = ["a", "b", "c", "", "unknown"]
    rows = [r for r in rows if not m.held_out(r[0])]
    tests = [(k, f"a b {w}".strip()) for k, w in enumerate(words, 1_000)]
    extra = [i for i in range(5_000) if m.held_out(i)][: len(tests)]
    tests = [(i, t) for i, (_, t) in zip(extra, tests)]
    got = {r.doc_id: r for r in m.score(spark.createDataFrame(rows + tests, "doc_id long, text string")).collect()}
    check(got.values(), rows + tests)
    assert sum(10 ** (got[i].score) for i, t in tests if t == "a b") < 1


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "A b", 3), (3, "a  B\n", 4), (3, "a b", 5), (4, "x " * 30_000, 6), (5, "a b", 7), (10, "zz a b", 8)], "doc_id long, text string, slice int")
    check(m.score(df, slice_bytes=5).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert m.score(df.limit(0)).collect() == []
    alone = m.score(df.where("doc_id is null")).collect()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.train_tokens) for r in alone] == [(None, None, 3, 0)]
    hidden = [i for i in range(100) if m.held_out(i)][:3]
    none = m.score(spark.createDataFrame([(i, "a b c") for i in hidden], "doc_id long, text string")).collect()
    assert [r.score for r in none] == [0.0] * 3


def test_many_rows_without_doc_id(spark):
    rows = [(None, f"t{i % 50} a b")  for i in range(3_000)] + [(1, "t1 a b"), (2, "t1 a b")]
    got = m.score(spark.createDataFrame(rows, "doc_id long, text string"), slice_bytes=2_000).collect()
    assert len(got) == len(rows) and all(np.isfinite(r.score) for r in got)


def test_spreading_moves_work_and_no_result(spark):
    """Contexts dealt over many buckets are tested and smoothed as those in one."""
    rng = random.Random(3)
    rows = list(enumerate(chain(rng, 250) + ["z " * 40 + "y"] * 4 + ["q r"] * 60))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    scores = []
    for spread in (1 << 19, 40, 6):
        got = sorted(map(tuple, m.score(df, slice_bytes=900, bucket_text=300, spread=spread).collect()))
        check(got, rows)
        scores.append(got)
    assert scores[1] == scores[0] and scores[2] == scores[0]


def slice_row(number, texts):
    """A slice of these lists of word hashes."""
    words, at = np.unique(np.array([x for t in texts for x in t], np.uint64), return_inverse=True)
    counts = np.array([len(t) for t in texts])
    tokens = np.insert(at.reshape(-1).astype(np.uint8), np.cumsum(counts), len(words))
    columns = {"doc_ids": np.arange(len(texts)) * 5 + number, "counts": counts.astype(np.int32), "words": words, "tokens": tokens}
    return {"slice": number, **{k: m.to_planes(x) for k, x in columns.items()}}


def test_memory_is_given_back_once_in_a_task_and_small_numbers_take_one_byte(spark, monkeypatch):
    """To give memory back at each slice and to pad all numbers cost a large part of the CPU seconds."""
    from cloakframe.llm import slices

    calls = []
    monkeypatch.setattr(slices, "give_back", lambda: calls.append(1))
    rng = np.random.default_rng(5)
    hashes = rng.integers(1, 2**63, 30, dtype=np.uint64)
    rows = [slice_row(k, [rng.choice(hashes, 12).tolist() for _ in range(20)]) for k in range(5)]
    sent = list(m.send_words(iter([m.pa.RecordBatch.from_pylist(rows)]), 4))
    assert len(sent) == 5 and len(calls) == 1
    for batch in sent:
        for r in batch.to_pylist():
            assert len(r["counts"]) == len(r["keys"]) // 8


def test_narrow_numbers_come_back(spark):
    for kind, parts in (("u", [[0, 255], [256], [1 << 16, 3], [1 << 32, (1 << 64) - 1]]), ("i", [[-127, 127], [128, 0], [-128], [-(1 << 15), 5], [(1 << 31) - 1]])):
        arrays = [np.array(x, np.uint64 if kind == "u" else np.int64) for x in parts]
        got = m.widened([m.to_planes(m.narrow(x)) for x in arrays], [len(x) for x in arrays], kind)
        assert got.tolist() == [x for part in parts for x in part]
    assert m.narrow(np.array([3, 200], np.uint64)).itemsize == m.narrow(np.array([-3, 100])).itemsize == 1
    with pytest.raises(ValueError):
        m.widened([b"1"], [1, 1], "u")


def test_places_are_sorted_by_pairs_of_any_size(spark):
    rng = np.random.default_rng(6)
    number, token, at = rng.integers(0, 9, 500), rng.integers(0, 8, 500), rng.permutation(500)
    want = sorted(zip(number.tolist(), token.tolist()))
    for far in (0, 1 << 55):  # beyond one packed number
        places, code = m.sorted_places(number + far, token, at, 3)
        back = np.argsort(at)[places]
        assert [(int(number[k]), int(token[k])) for k in back] == want
        assert ((code >> 3) - far).tolist() == [x for x, _ in want] and (code & 7).tolist() == [y for _, y in want]
