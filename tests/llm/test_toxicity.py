import random

from pyspark.sql import functions as F

from cloakframe.llm import toxicity as tx


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(word, terms):
    found = []
    for k, t in enumerate(terms):
        ends = range(len(word) + 1) if t.endswith("*") else [len(word)]
        d = min(distance(word[:n], t.rstrip("*")) for n in ends)
        if d <= tx.edits_of(t):
            found.append((d, k))
    return min(found, default=None)


def test_automaton_equals_edit_distance():
    terms = ["scum", "idiot", "moron", "worthless", "disgusting", "lowei*", "abominab*", "idiots", "é"]
    r, a = random.Random(1), tx.Automaton(["scum", "idiot", "moron", "worthless", "disgusting", "lowei*", "abominab*", "idiots", "é"])
    words = ["", "é", "lowei", "loweiheit", "abominable", "abomnable", "xabominab", "abom"]
    for _ in range(4000):
        w = list(r.choice(terms).rstrip("*"))
        for _ in range(r.randrange(4)):
            at, c = r.randrange(len(w) + 1), r.choice("aeidmotsüx@")
            w[at : at + r.randrange(2)] = [c] * r.randrange(2)
        words.append("".join(w))
    for w in words:
        assert a.match(w) == nearest(w, terms), w


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(tx.Automaton, "MOST_STATES", 20)
    terms, a = ["idiot", "worthless"], tx.Automaton(["idiot", "worthless"])
    for w in ["idiot", "wortless", "idyot", "worthlesss", "wxrthlxss", "nothing", "idio"] * 3:
        assert a.match(w) == nearest(w, terms)


def test_context_and_offsets():
    find = tx.Finder(tx.Model(["idiot"], [0.95])).find
    assert find("İ you idiot") == [(6, 11, 0, 0, False)]
    assert [x[3:] for x in find("You IDI0T!")] == [(1, False)]
    assert [x[4] for x in find('He wrote "that idiot" in his letter')] == [True]
    assert [x[4] for x in find("the word idiot is old")] == [True]
    assert [x[4] for x in find("you said it, idiot")] == [False]
    assert find("") == [] and find("idle riot") == []


def make(n, seed=5):
    """Toxic texts hold a word of a set, or one of a family with a common stem; some clean texts hold a word near to one."""
    r, out = random.Random(seed), []
    for k in range(n):
        words = ["".join(r.choices(["an", "to", "re", "li"], k=r.randint(1, 3))) for _ in range(r.randint(5, 30))]
        toxic = r.random() < 0.3
        if toxic:
            words[r.randrange(len(words))] = r.choice(["idiot", "worthless", "vequ" + r.choice(["a", "éx", "onno", "tire", "la", "mo"])])
        elif r.random() < 0.2:
            words[0] = "idiom"
        out.append((k, " ".join(words), int(toxic)))
    return out


def test_learns_words_and_stems(spark):
    rows = make(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "idiot", "x"), (2000, None, "x"), (2001, "", "x"), (2002, "an worthles to", "x"), (2003, 'they said "idiot" to', "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 1), (0, None)], "doc_id long, toxic int")
    model = tx.fit(docs, labels.where(~tx.held_out()))
    assert sorted(model.terms) == ["idiot", "vequ*", "worthless"] and model.ordinary == {"idiom"}
    assert model.strength["quoted"] < 0.5
    found = {r["doc_id"]: r for r in tx.score_rows(docs, model).select("rest.doc_id", "score", "hits").collect()}
    assert len(found) == 905
    toxic = {i for i, _, y in rows if y}
    assert {i for i in range(900) if found[i]["score"] >= 0.7} == toxic
    assert found[2000]["score"] == found[2001]["score"] == model.base < 0.1
    assert found[None]["score"] >= 0.7 and found[2002]["score"] >= 0.7 and found[2003]["score"] < 0.7
    assert found[2002]["hits"][0].asDict() == {"start": 3, "end": 11, "term": "worthless", "edits": 1, "quoted": False}


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in tx.score_rows(docs, tx.fit(docs, none)).collect()] == [0.0, 0.0]
    own = tx.fit(docs, none, terms=["idiot"])
    assert sorted(r["score"] for r in tx.score_rows(docs, own).collect()) == [0.0, 0.95]
    assert tx.score_rows(docs.limit(0), own).count() == 0


def test_held_out_accuracy(spark):
    """On the given tables: ranked well above chance and clean documents left alone."""
    sf = "/root/testdata/sf0.1"
    found = tx.op11_toxicity(spark, sf)
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()
    n = {(r["toxic"], r["predicted"]): r["n"] for r in rows}
    assert n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0))
