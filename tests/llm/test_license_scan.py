import random
import re

from cloakframe.llm import license_scan as m
from cloakframe.llm.license_templates import TEMPLATES


def words(text):
    return re.findall(r"[a-z0-9\u0080-￿]+", text.lower())


def test_lines_of_the_table(spark):
    """Every exact line of a template is found at its place, and nothing else is."""
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in m.op10_license_scan(spark, sf).collect()}
    hits = 0
    for doc_id, text in texts.items():
        w = words(text)
        want = set()
        for name, t in TEMPLATES.items():
            p = words(t)
            if p[0] in w:
                want |= {(name, i, i + len(p)) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p}
        have = {(x.split(":")[0], int(x.split(":")[2]), int(x.split(":")[3])) for x in got[doc_id].spans.split(",") if x}
        assert have == want, (doc_id, have, want)
        hits += len(have)
    assert hits > 5 and len(got) == len(texts)


def test_edited_notice():
    rng = random.Random(3)
    index = m.Index(TEMPLATES)
    for name in ("mit", "isc", "zlib", "apache-2.0", "gpl-3.0"):
        p = words(TEMPLATES[name])
        edited = [x for i, x in enumerate(p) if i % 17 != 5]
        for k in range(3):
            edited.insert(20 * (k + 1), f"inserted{k}")
        before = [f"x{rng.random()}" for _ in range(50)]
        text = " ".join([*before, *edited, "tail", "words"]).replace(".", "")
        found = m.scan_words(m.words_of(text), index, 0.8, m.BAND)[0]
        assert [r[0] for r in found] == [name]
        assert abs(found[0][2] - 50) <= 2 and abs(found[0][3] - 50 - len(edited)) <= 2
        assert found[0][1] > 0.9


def test_edges(spark):
    t = TEMPLATES["mit-line"]
    rows = [(1, None), (2, ""), (3, t), (3, t), (None, f"{t} x {t}"), (4, "a " * 30000 + t), (5, "released under the moon")]
    df = spark.createDataFrame([(a, b, "z", 1) for a, b in rows], "doc_id long, text string, template string, n_words int")
    got = sorted(((r.doc_id, [(x.template, x.start, x.end) for x in r.matches]) for r in m.scan(df).collect()), key=repr)
    want = [(1, []), (2, []), (3, [("mit-line", 0, 5)]), (3, [("mit-line", 0, 5)]), (4, [("mit-line", 30000, 30005)]), (5, []), (None, [("mit-line", 0, 5), ("mit-line", 6, 11)])]
    assert got == sorted(want, key=repr)
    assert m.scan(df.limit(0)).collect() == []
    assert all(not r.matches for r in m.scan(df, {}).collect())


def test_all_rights_reserved():
    """The three words are found wherever they stand, as brute force finds them; the longer line keeps its own name."""
    rng = random.Random(7)
    index, p = m.Index(TEMPLATES), ["all", "rights", "reserved"]
    for k in range(300):
        body = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(12))]
        for _ in range(k % 3 + 1):
            at = rng.choice([0, len(body) // 2, len(body)])
            body[at:at] = p
        want = [(i, i + 3) for i in range(len(body) - 2) if body[i : i + 3] == p]
        found = m.scan_words(m.words_of(" ".join(body)), index, 0.8, m.BAND).get(0, [])
        assert [(r[0], r[2], r[3]) for r in found] == [("all-rights-reserved", *x) for x in want], body
    line = TEMPLATES["rights-reserved-line"]
    assert [r[0] for r in m.scan_words(m.words_of(f"a b {line} c d"), index, 0.8, m.BAND)[0]] == ["rights-reserved-line"]
    assert 0 not in m.scan_words(m.words_of("all rights are reserved and all rights"), index, 0.8, m.BAND)
