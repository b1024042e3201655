"""Workspaces as logs of commits, and the state of column mode, edits and streams."""

import threading

import pytest
from pyspark.sql import functions as F

from cloakframe.model import FAKE, REPLACE
from cloakframe.operators import columns, edits, entities
from cloakframe.plans import catalog
from cloakframe.plans.batch import Batch
from cloakframe.plans.pipeline import Options, run
from cloakframe.plans.workspace import TABLES, Workspace, list_workspaces
from cloakframe.streaming.detect import rewrite_batch

MAPPINGS = TABLES["mappings"]
SEGMENT = "file_id string, sheet_index int, row int, col int, text string"


def segments(spark, *texts):
    return spark.createDataFrame([("f", 0, k, 0, t) for k, t in enumerate(texts)], SEGMENT)


def values(df):
    return [r.text for r in df.orderBy("row").collect()]


def test_two_writers(spark, tmp_path):
    log = catalog.Log(spark, f"file://{tmp_path}", "w")
    rows = lambda *n: spark.createDataFrame([(str(k), k) for k in n], TABLES["counters"])
    base = log.snapshot()
    assert base.version == 0
    first = log.commit(base, {"counters": ("append", rows(1))})
    with pytest.raises(catalog.Conflict):
        log.commit(base, {"counters": ("append", rows(2))})
    assert log.read(log.snapshot(), "counters", TABLES["counters"]).count() == 1
    # the loser leaves neither data nor a commit behind
    assert len(list((tmp_path / "w" / "data").glob("counters-*"))) == 1 and log.versions() == [1]
    seen = []

    def again(s):
        seen.append(s.version)
        if len(seen) == 1:
            log.commit(first, {"counters": ("append", rows(3))})
        return {"counters": ("append", rows(4))}, {"config": {"k": 1}}

    done = log.update(again)
    assert seen == [1, 2] and done.version == 3 and done.config == {"k": 1}
    assert sorted(r.n for r in log.read(done, "counters", TABLES["counters"]).collect()) == [1, 3, 4]
    assert sorted(r.n for r in log.read(log.snapshot(1), "counters", TABLES["counters"]).collect()) == [1]


def test_many_writers_lose_nothing(spark, tmp_path):
    log, failed = catalog.Log(spark, f"file://{tmp_path}", "w"), []

    def write(k):
        try:
            log.update(lambda s: ({"counters": ("append", spark.createDataFrame([(str(k), k)], TABLES["counters"]))}, {}), tries=50)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and log.versions() == [1, 2, 3, 4, 5, 6]
    assert sorted(r.n for r in log.read(log.snapshot(), "counters", TABLES["counters"]).collect()) == list(range(6))


def test_compaction_and_vacuum(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "MOST_PARTS", 2)
    log = catalog.Log(spark, f"file://{tmp_path}", "w")
    for k in range(4):
        s = log.update(lambda s, k=k: ({"counters": ("append", spark.createDataFrame([(str(k), k)], TABLES["counters"]))}, {}))
    assert len(s.tables["counters"]) == 2 and log.read(s, "counters", TABLES["counters"]).count() == 4
    assert log.vacuum(keep_versions=1) == 0  # too young
    assert log.vacuum(keep_versions=1, older_than=0) == 2
    assert log.versions() == [4] and log.read(log.snapshot(), "counters", TABLES["counters"]).count() == 4


def test_list_rename_delete(spark, tmp_path):
    root = f"file://{tmp_path}/all"
    assert list_workspaces(spark, root).collect() == []
    a, b = Workspace.create(spark, root, "first"), Workspace.create(spark, root, "second", source="Clipboard", config={"seed": 5})
    a.rename("third")
    b.configure(style="Mou")
    assert b.snapshot().config == {"seed": 5, "style": "Mou"}
    record = a.add_record("x.txt", spark.createDataFrame([("o", "r", "T", "Replace", 2)], "original_text string, replaced_text string, type string, strategy string, occurrences long"))
    assert [(r.name, r.source, r.history_count) for r in list_workspaces(spark, root).collect()] == [("third", "File", 1), ("second", "Clipboard", 0)]
    b.delete()
    assert [r.name for r in list_workspaces(spark, root).collect()] == ["third"]
    with pytest.raises(ValueError):
        b.read("history")
    with pytest.raises(ValueError):
        Workspace(spark, root, "none").rename("x")
    more = spark.createDataFrame([("o", "r2", "T", "Replace", 2), ("p", "s", "T", "Mask", 3)], "original_text string, replaced_text string, type string, strategy string, occurrences long")
    a.update_record(record, more)
    assert [(r.sensitive_count, r.status) for r in a.read("history").collect()] == [(5, "Processed")]
    assert sorted(r.replaced_text for r in a.read("record_mappings").collect()) == ["r2", "s"]
    a.delete_record(record)
    assert a.read("history").count() == 0 and a.read("record_mappings").count() == 0 and a.snapshot().history_count == 0
    for f in (a.delete_record, lambda r: a.update_record(r, more)):
        with pytest.raises(ValueError):
            f(record)


def test_run_starts_again_after_another_writer(spark, tmp_path, monkeypatch):
    """Two runs from one state: the loser takes the winner's values and counters."""
    w = Workspace(spark, f"file://{tmp_path}", "w")
    options = Options(backend=entities.Lexicon({"Ann": "PER", "Bob": "PER"}))
    plain, calls = Workspace.record_changes, []

    def other_first(self, base, record, file_name, mappings):
        calls.append(base.version)
        if len(calls) == 1:
            monkeypatch.setattr(Workspace, "record_changes", plain)
            run(segments(spark, "Bob"), options, w, "other")
            monkeypatch.setattr(Workspace, "record_changes", other_first)
        return plain(self, base, record, file_name, mappings)

    monkeypatch.setattr(Workspace, "record_changes", other_first)
    mine = values(run(segments(spark, "Ann met Bob"), options, w, "mine").segments)[0].split(" met ")
    known = {r.original_text: r.replaced_text for r in w.read("mappings").collect()}
    assert calls == [0, 1] and mine == [known["Ann"], known["Bob"]] and len(set(mine)) == 2
    assert w.read("history").count() == 2


def test_batch_of_a_stream_run_twice(spark, tmp_path):
    w, out = Workspace(spark, f"file://{tmp_path}", "w"), str(tmp_path / "out")
    options = Options(backend=entities.Lexicon({"Ann": "PER", "Bob": "PER"}))
    batches = [segments(spark, "Ann"), segments(spark, "Bob", "Ann")]
    assert [rewrite_batch(b, k, w, out, options) for k, b in enumerate(batches)] == [True, True]
    read = lambda: sorted((r.batch, r.row, r.text) for r in spark.read.parquet(out).collect())
    first, state = read(), [sorted(map(str, w.read(t).collect())) for t in ("history", "mappings", "counters", "record_mappings")]
    assert [rewrite_batch(b, k, w, out, options) for k, b in enumerate(batches)] == [False, False]
    assert read() == first and state == [sorted(map(str, w.read(t).collect())) for t in ("history", "mappings", "counters", "record_mappings")]
    assert len(state[0]) == 2 and len({t for *_, t in first}) == 2


def test_alias_groups_are_safe(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}", "w")
    w.write("mappings", spark.createDataFrame([("Robert", "PersonName", "X", "Replace"), ("Bob", "PersonName", "Y", "Mask"), ("Bob", "OrgName", "Z", "Mask")], MAPPINGS))
    assert w.create_alias_group(["Robert", "Bob"], "PersonName") == "Robert"
    w.create_alias_group(["Ann", "Anna"], "PersonName")
    with pytest.raises(ValueError):
        w.add_alias("Robert", "Ann", "PersonName")
    groups = lambda: sorted((r.primary, r.members) for r in w.alias_groups().collect())
    assert groups() == [("Anna", ["Ann", "Anna"]), ("Robert", ["Robert", "Bob"])]
    known = lambda: {(r.original_text, r.type): (r.replaced_text, r.strategy) for r in w.read("mappings").collect()}
    assert known() == {("Robert", "PersonName"): ("X", "Replace"), ("Bob", "PersonName"): ("X", "Replace"), ("Bob", "OrgName"): ("Z", "Mask")}
    assert w.add_alias("Robert", "Rob", "PersonName") == "Robert" and known()["Rob", "PersonName"] == ("X", "Replace")
    assert w.add_alias("Robert", "Bertie", "PersonName") == "Bertie"  # the later of equals
    w.remove_alias("Bertie", "PersonName")
    assert groups()[1] == ("Robert", ["Robert", "Bob", "Rob"])


def test_column_mode_keeps_numbers(spark):
    rules = spark.createDataFrame([(0, 0, "PersonName", REPLACE, 0, 0, FAKE, True)], "sheet_index int, col int, type string, kind string, keep_prefix int, keep_suffix int, style string, reversible boolean")
    first = columns.desensitize_columns(segments(spark, "name", "Ann Lee", ""), rules)
    second = columns.desensitize_columns(segments(spark, "name", "Cy Dow", "Ann Lee"), rules, prior=first.state, counters=first.counters)
    a, b = values(first.segments)[1], values(second.segments)[1:]
    assert b[1] == a and b[0] not in (a, "Cy Dow")
    assert second.fresh.select("original_text").collect()[0][0] == "Cy Dow" and second.state.count() == 2


def test_undo_in_order(spark):
    schema = "file_id string, seq int, action string, id string, text string, value string"
    rows = [("a", 1, "remove", "x", None, None), ("a", 2, "ignore", None, "Anna", None), ("a", 3, "undo", None, None, None), ("a", 4, "undo", None, None, None), ("a", 5, "add", "m", "Anna", None), ("b", 1, "undo", None, None, None)]
    log = spark.createDataFrame(rows, schema)
    assert sorted((r.file_id, r.seq) for r in edits.effective(log).collect()) == [("a", 2), ("a", 5)]
    assert edits.ignored_texts(log).collect() == []
    deep = spark.createDataFrame([("a", k, "remove" if k < 60 else "undo", str(k), None, None) for k in range(120)] + [("a", 200, "remove", "last", None, None)], schema)
    assert sorted(r.seq for r in edits.effective(deep).collect()) == [*range(10), 200]
    assert edits.effective(log.limit(0)).collect() == []


def test_manual_item_after_ignore(spark):
    place = "file_id string, sheet_index int, row int, col int, start int, end int, text string, type string"
    items = spark.createDataFrame([("f", 0, 0, 0, 0, 4, "Anna", "PersonName"), ("f", 0, 1, 0, 0, 3, "Bob", "PersonName")], place).withColumns({"id": F.concat(F.lit("i"), "row"), "source": F.lit("Ner"), "confidence": F.lit(1.0)})
    log = lambda *rows: spark.createDataFrame([(s, a, i, t, v, "f", 0, 9, 0, 0, len(t), "PersonName") for s, a, i, t, v in rows], "seq int, action string, id string, text string, value string, file_id string, sheet_index int, row int, col int, start int, end int, type string")
    active = lambda *rows: sorted(r.id for r in edits.active_items(items, log(*rows)).collect())
    assert active((1, "ignore", None, "Anna", None), (2, "ignore", None, "bob", "Fuzzy")) == []
    assert active((1, "ignore", None, "Anna", None), (2, "add", "m", "Anna", None)) == ["i0", "i1", "m"]
    assert active((1, "add", "m", "Anna", None), (2, "ignore", None, "Anna", None)) == ["i1"]
    assert active((1, "ignore", None, "anna", "Fuzzy"), (2, "add", "m", "ANNA", None)) == ["i0", "i1", "m"]
    assert active((1, "ignore", None, "anna", None)) == ["i0", "i1"]


def test_batch_resumes_what_is_open(spark, tmp_path):
    """One file fails and does not stop the others; a later run reads only that one, and all share their values."""
    w = Workspace(spark, f"file://{tmp_path}/ws", "w")
    batch, reads, broken = Batch(w, "b1", str(tmp_path / "out"), Options(backend=entities.Lexicon({"Ann": "PER", "Bob": "PER"}))), [], {"c.txt"}
    batch.add(["a.txt", "b.txt", "c.txt", "a.txt"])
    batch.add(["a.txt"])
    with pytest.raises(ValueError):
        batch.add([f"{k}.txt" for k in range(18)])

    def read(name):
        reads.append(name)
        if name in broken:
            raise OSError("cannot read it")
        return spark.createDataFrame([(name, 0, 0, 0, f"Ann met Bob in {name}")], SEGMENT)

    state = lambda df: sorted((r.file_id, r.status, r.attempts, r.error) for r in df.collect())
    assert state(batch.status()) == [(f, "open", 0, None) for f in ("a.txt", "b.txt", "c.txt")]
    assert state(batch.run(read)) == [("a.txt", "done", 1, None), ("b.txt", "done", 1, None), ("c.txt", "failed", 1, "OSError: cannot read it")]
    broken.clear()
    assert state(batch.run(read))[2] == ("c.txt", "done", 2, None) and sorted(reads) == ["a.txt", "b.txt", "c.txt", "c.txt"]
    texts = {r.text.split(" in ")[0] for f in ("a.txt", "b.txt", "c.txt") for r in spark.read.parquet(batch.path(f)).collect()}
    assert len(texts) == 1 and w.read("history").count() == 3
    assert state(batch.run(read)) == state(batch.status()) and len(reads) == 4
