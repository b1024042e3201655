from cloakframe.llm import decontaminate as m


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    d = [(r.doc_id, r.text) for r in docs.collect()]
    b = [(str(r.item_id), r.text) for r in bench.collect()]
    # the first words of some documents as short items
    b += [(f"s{k}", " ".join((t or "").split()[:k])) for k, (_, t) in enumerate(d[:9])]
    items = spark.createDataFrame(b, "item_id string, text string")
    want = sorted(m.brute_force(d, b), key=repr)
    data = spark.createDataFrame(d, "doc_id long, text string")
    assert rows(m.digest(m.decontaminate(data, items))) == want
    assert any(w[-1] for w in want)
    assert rows(m.digest(m.decontaminate(data, items, block_words=400))) == want


def test_edges(spark):
    words = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, "!!! ..."), (4, words), (4, words), (None, words.upper()), (5, "a b"), (6, "x " * 3000 + words.replace(" ", " , \n"))]
    items = [("i1", words), ("i2", words), ("i3", "a b"), ("i4", None), ("i5", "?"), (None, words), ("i6", " ".join(words.split()[5:15]))]
    d = spark.createDataFrame([(i, t, 7, "q") for i, t in docs], "doc_id long, text string, spans int, items string")
    b = spark.createDataFrame(items, "item_id string, text string")
    want = m.brute_force(docs, [x for x in items if x[0] is not None])
    assert rows(m.digest(m.decontaminate(d, b))) == sorted(want, key=repr)
    assert rows(m.digest(m.decontaminate(d.limit(0), b))) == []
    assert {r[2] for r in m.digest(m.decontaminate(d, b.limit(0))).collect()} == {0}
