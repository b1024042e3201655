"""Paths that the queries do not cover: files, workspaces, streams, edge cases."""

import zipfile

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import fakes
from cloakframe.model import FAKE, MOU, REPLACE
from cloakframe.operators import desensitize, detect, dictionary, entities, merge, restore
from cloakframe.plans.pipeline import Options, file_report, find_items, run
from cloakframe.plans.workspace import Workspace
from cloakframe.sources import office, tables, text
from cloakframe.streaming import detect as stream

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def segments(spark, *texts):
    return spark.createDataFrame([("f", 0, k, 0, t) for k, t in enumerate(texts)], "file_id string, sheet_index int, row int, col int, text string")


def texts(df):
    return [r.text for r in df.orderBy("file_id", "sheet_index", "row", "col").collect()]


def test_empty_and_null(spark):
    s = segments(spark, None, "", "nothing here")
    done = desensitize.desensitize(s, detect.detect_patterns(s), language="en")
    assert texts(done.segments) == [None, "", "nothing here"]
    assert done.mappings.count() == 0
    assert {(r.type, r.n) for r in done.summary.collect()} <= {(None, 0)}


def test_sentinel_and_astral(spark):
    s = segments(spark, "😀\u0001 a@b.co 😀 x@y.org", "no. 12345-67890 and 12345")
    got = detect.detect_patterns(s).orderBy("row", "start").collect()
    assert [(r.start, r.end, r.text) for r in got] == [(3, 9, "a@b.co"), (12, 19, "x@y.org"), (20, 25, "12345")]


def test_numbers_follow_first_appearance(spark):
    names = [f"name {k % 7}" for k in range(50)]
    s = segments(spark, *names)
    items = s.select("file_id", "sheet_index", "row", "col", F.lit(0).alias("ord"), F.lit(0).alias("start"), F.char_length("text").alias("end"), "text", F.lit("OrgName").alias("type"), F.lit("Manual").alias("source"), F.lit(1.0).alias("confidence"))
    done = desensitize.desensitize(s, items, desensitize.strategies_table(spark, {"OrgName": (REPLACE, 0, 0, MOU)}))
    assert texts(done.segments) == ["Acme Co." + (f" {k % 7 + 1}" if k % 7 else "") for k in range(50)]
    assert [tuple(r) for r in done.counters.collect()] == [("mou_org_en_Co.", 7)]
    loose = desensitize.strategies_table(spark, {"OrgName": (REPLACE, 0, 0, MOU)}, {"OrgName"})
    last = desensitize.desensitize(s, items, loose)
    assert texts(last.segments)[43:] == [f"Acme Co. {k + 1}" for k in range(43, 50)]


def test_pools_do_not_repeat(spark):
    for (type_key, language), _ in fakes.POOLS.items():
        n = fakes.pool_size(type_key, language)
        got = [r.v for r in spark.range(2 * n).select(fakes.pooled(type_key, language, F.col("id"), 42).alias("v")).collect()]
        assert len(set(got)) == 2 * n


def test_custom_types_use_the_family(spark):
    s = segments(spark, "secret word")
    items = spark.createDataFrame([("f", 0, 0, 0, 0, 0, 6, "secret", "Custom:secret", "Dict", 1.0)], "file_id string, sheet_index int, row int, col int, ord int, start int, end int, text string, type string, source string, confidence double")
    assert texts(desensitize.desensitize(s, items).segments) == ["s****t word"]
    replaced = desensitize.desensitize(s, items, desensitize.strategies_table(spark, {"Custom": (REPLACE, 0, 0, FAKE)}))
    assert texts(replaced.segments) == [fakes.REDACTED_CUSTOM + " word"]
    assert merge.apply_enabled(items, ["Custom"]).count() == 1 and merge.apply_enabled(items, ["Email"]).count() == 0


def test_workspace_keeps_values(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}", "w1")
    backend = entities.Lexicon({"Ann Lee": "PER", "Bo Ray": "PER", "Ann": "PER"})
    options = Options(backend=backend)
    w.create_alias_group(["Ann", "Ann Lee"], "PersonName")
    first = texts(run(segments(spark, "Ann met Bo Ray", "Ann Lee left"), options, w, "a.txt").segments)
    name = first[1].removesuffix(" left")
    assert first[0].startswith(f"{name} met ") and "Ann" not in " ".join(first)
    second = run(segments(spark, "Bo Ray and Cy Fox and Ann"), Options(backend=entities.Lexicon({"Bo Ray": "PER", "Cy Fox": "PER", "Ann": "PER"})), w, "b.txt")
    out = texts(second.segments)[0]
    assert out.split(" and ")[0] == first[0].split(" met ")[1] and out.split(" and ")[2] == name and len(set(out.split(" and "))) == 3
    assert w.read("history").count() == 2
    patterns = restore.reverse_mappings(w.read("record_mappings"))
    back, _ = restore.restore(second.segments, patterns)
    assert texts(back) == ["Bo Ray and Cy Fox and Ann"]
    with pytest.raises(ValueError):
        w.create_alias_group(["Ann", "X"], "PersonName")
    with pytest.raises(ValueError):
        Workspace(spark, "x", "../up")
    w.remove_alias("Ann", "PersonName")
    assert w.read("aliases").count() == 0
    w.clear_mappings("PersonName")
    assert w.read("mappings").count() == 0


def test_dictionary_of_many_lengths(spark):
    s = segments(spark, "word7 and word19 aaaa", "Word3")
    rows = [(k, f"word{k}", "T", "Exact" if k % 2 else "Fuzzy", None, None) for k in range(30)] + [(30, "aa", "T", "Exact", None, None), (31, "WORD3", "T", "Fuzzy", None, None)]
    entries = spark.createDataFrame(rows, dictionary.ENTRY)
    got = sorted((r.row, r.ord, r.start, r.end, r.text) for r in dictionary.detect_dictionary(s, entries).collect())
    assert [(x[0], *x[2:]) for x in got] == [(0, 10, 15, "word1"), (0, 0, 5, "word7"), (0, 10, 16, "word19"), (0, 17, 19, "aa"), (0, 19, 21, "aa"), (1, 0, 5, "Word3")]


def test_report_and_degraded_entities(spark):
    s = segments(spark, "mail a@b.co")
    assert entities.detect_entities(s, None).count() == 0
    items = find_items(s, Options(builtin_dictionary=True))
    assert [tuple(r) for r in file_report(s, items).collect()] == [("f", 1, 1)]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿第一行\n\n第三行\n".encode())
    (tmp_path / "b.txt").write_bytes("电话13812345678".encode("gbk"))
    (tmp_path / "c.txt").write_bytes(b"\xff\xff\xff")
    got = text.read_txt(spark, str(tmp_path)).collect()
    by = {r.file_id[-5]: r for r in got}
    assert by["b"].encoding == "gbk" and by["c"].error and by["a"].text == "第一行\n\n第三行\n"
    rows = text.segments_of_lines(text.read_txt(spark, str(tmp_path)).where("error is null"))
    assert sorted((r.file_id[-5], r.row, r.text) for r in rows.collect()) == [("a", 0, "第一行"), ("a", 1, ""), ("a", 2, "第三行"), ("b", 0, "电话13812345678")]
    assert tables.to_text(rows.where("file_id like '%a.txt'")).first().text == "第一行\n\n第三行"
    with pytest.raises(ValueError):
        text.pasted(spark, "x" * 100_001)


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\r\nx,"a, ""b""\nc"\r\nonly\r\n', newline="")
    (tmp_path / "b.tsv").write_text("n\tm\n1\t2\n")
    cells = tables.read_csv(spark, str(tmp_path))
    got = sorted((r.file_id[-5], r.row, r.col, r.text) for r in cells.collect())
    assert got == [("a", 0, 0, "name"), ("a", 0, 1, "note"), ("a", 1, 0, "x"), ("a", 1, 1, 'a, "b"\nc'), ("a", 2, 0, "only"), ("b", 0, 0, "n"), ("b", 0, 1, "m"), ("b", 1, 0, "1"), ("b", 1, 1, "2")]
    out = {r.file_id[-5]: r.text for r in tables.to_csv(cells).collect()}
    assert out == {"a": 'name,note\nx,"a, ""b""\nc"\nonly,', "b": "n,m\n1,2"}
    assert tables.output_name("/d/a.xls", {"/d/a_脱敏.xlsx"}) == "/d/a_脱敏_1.xlsx"


def docx(body):
    import io

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("other.bin", b"\0\1")
    return out.getvalue()


def test_docx_files(spark, tmp_path):
    p = lambda t, style="": f"<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>"
    head = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = p("Title", head) + "<w:p/>" + p(" ") + p("mail a@b.co</w:t><w:tab/><w:t>x") + f"<w:tbl><w:tr><w:tc>{p('c1')}</w:tc><w:tc>{p('c2')}</w:tc></w:tr></w:tbl>"
    raw = docx(body)
    (tmp_path / "a.docx").write_bytes(raw)
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    got = office.read_docx(spark, str(tmp_path)).collect()
    rows = sorted((r.row, r.text, r.style, r.table_col, r.col_count) for r in got if r.error is None)
    assert rows == [(0, "Title", "heading1", None, None), (2, "mail a@b.co\tx", "normal", None, None), (3, "c1", "normal", 0, 2), (4, "c2", "normal", 1, 2)]
    assert sum(r.error is not None for r in got) == 1
    new = office.docx_rewrite(raw, {2: "mail *", 4: "C2"})
    assert [x["text"] for x in office.docx_paragraphs(new)] == ["Title", "mail *", "c1", "C2"]


def test_xlsx_round_trip(spark, tmp_path):
    cells = [(0, "one", 0, 0, "name", "Text", None), (0, "one", 1, 0, "a & b", "Text", None), (0, "one", 1, 27, "12", "Integer", None), (0, "one", 2, 1, "1.5", "Float", None), (1, "two", 0, 0, "true", "Boolean", None), (1, "two", 0, 1, "45000", "DateTime", 45000.0), (1, "two", 0, 2, "45000.5", "DateTime", 45000.5)]
    df = spark.createDataFrame([("f", *c) for c in cells], "file_id string, sheet_index int, sheet_name string, row int, col int, text string, cell_type string, serial double")
    (tmp_path / "a.xlsx").write_bytes(bytes(office.to_xlsx(df).first().content))
    got = office.read_xlsx(spark, str(tmp_path)).collect()
    assert sorted((r.sheet_index, r.sheet_name, r.row, r.col, r.text, r.cell_type, r.serial) for r in got) == sorted(cells)
    assert office.cells_to_segments(office.read_xlsx(spark, str(tmp_path))).count() == len(cells)


def test_stream(spark, tmp_path):
    schema = "file_id string, sheet_index int, row int, col int, text string"
    segments(spark, "mail a@b.co", "tel 555-123-4567").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.rewrite_stream(source, Workspace(spark, f"file://{tmp_path}", "s"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert texts(spark.read.parquet(str(tmp_path / "out")).drop("batch")) == ["mail a*****", "tel 5**********7"]


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "a@b.co"), ("2024-01-01 00:02:00", "c@d.org x@y.net"), ("2024-01-01 00:07:00", "a@b.co")]
    spark.createDataFrame(rows, "ts string, text string").selectExpr("cast(ts as timestamp) ts", "text").write.parquet(str(tmp_path / "ts"))
    source = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "ts"))
    q = stream.windowed_counts(source, "ts").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.sql("select * from counts").collect()) == [1, 3]


def test_restore_by_record_and_alias_groups(spark, tmp_path):
    w = Workspace(spark, f"file://{tmp_path}", "case")
    s = segments(spark, "Anna met Bob", "Bob left")
    items = spark.createDataFrame([("f", 0, 0, 0, 0, 4, "Anna"), ("f", 0, 0, 0, 9, 12, "Bob"), ("f", 0, 1, 0, 0, 3, "Bob")], "file_id string, sheet_index int, row int, col int, start int, end int, text string")
    items = items.withColumns({"type": F.lit("PersonName"), "source": F.lit("Ner"), "confidence": F.lit(1.0), "ord": F.col("start").cast("long")})
    done = desensitize.desensitize(s, items)
    record = w.add_record("f", done.mappings)
    assert [(r.original_text, r.idx) for r in w.read("record_mappings").orderBy("idx").collect()] == [("Anna", 0), ("Bob", 1)]
    back, positions = w.restore_record(record, done.segments)
    assert texts(back) == texts(s) and positions.count() == 3
    assert [(r.record_id, r.status) for r in w.read("history").collect()] == [(record, "Restored")]
    assert texts(w.restore_all(done.segments)[0]) == texts(s)
    with pytest.raises(ValueError):
        w.restore_record("none", s)
    with pytest.raises(ValueError):
        Workspace(spark, f"file://{tmp_path}", "empty").restore_all(s)
    assert w.create_alias_group(["Bob", "Rob"], "PersonName") == "Rob"
    assert w.add_alias("Rob", "Robert", "PersonName") == "Robert"
    assert [(r.primary, r.members) for r in w.alias_groups().collect()] == [("Robert", ["Bob", "Rob", "Robert"])]
    w.delete_alias_group("Robert", "PersonName")
    assert w.alias_groups().collect() == []


def test_folder_of_all_kinds(spark, tmp_path):
    from cloakframe.sources import files

    (tmp_path / "a.txt").write_text("one\ntwo\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('h,"x,y"\n1,2\n', encoding="utf-8")
    (tmp_path / "c.csv").write_bytes(b"\xff\xfe\xff,1\n")
    (tmp_path / "d.xlsx").write_bytes(office.xlsx_bytes([{"sheet_index": 0, "sheet_name": "S", "row": 0, "col": 0, "text": "cell", "cell_type": "text", "serial": None}]))
    (tmp_path / "e.xlsx").write_bytes(b"no workbook")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    got, errors = files.read(spark, f"file://{tmp_path}")
    name = F.substring_index("file_id", "/", -1).alias("f")
    assert sorted(map(tuple, got.select(name, "row", "col", "text").collect())) == [("a.txt", 0, 0, "one"), ("a.txt", 1, 0, "two"), ("b.csv", 0, 0, "h"), ("b.csv", 0, 1, "x,y"), ("b.csv", 1, 0, "1"), ("b.csv", 1, 1, "2"), ("d.xlsx", 0, 0, "cell")]
    assert sorted(r.f for r in errors.select(name).collect()) == ["c.csv", "e.xlsx", "f.pdf"]
    assert files.exists(spark, f"file://{tmp_path}/a.txt") and not files.exists(spark, f"file://{tmp_path}/z.txt")
    out = files.export(got)
    assert [r.text for r in out["txt"].collect()] == ["one\ntwo"] and [r.text for r in out["csv"].collect()] == ['h,"x,y"\n1,2']


def test_files_written_back(spark, tmp_path):
    """Text in the encoding it had, documents with their other parts, and an error for each file that cannot be written."""
    from cloakframe.sources import files
    from cloakframe.sources import text as texts_of

    source = tmp_path / "in"
    (source / "x").mkdir(parents=True)
    (source / "a.txt").write_bytes("电话 one\n二".encode("gbk"))
    (source / "b.txt").write_bytes("电话 b".encode("gbk"))
    (source / "x" / "a.txt").write_text("plain\n", encoding="utf-8")
    (source / "d.docx").write_bytes(docx("<w:p><w:r><w:t>first</w:t></w:r></w:p><w:p><w:r><w:t>mail a@b.co</w:t></w:r></w:p>"))
    (source / "p.pdf").write_bytes(b"%PDF")
    got, _ = files.read(spark, f"file://{source}")
    name = F.substring_index("file_id", "/", -1)
    changed = got.withColumn("text", F.when(name == "b.txt", F.concat("text", F.lit("\U0001f642"))).otherwise(F.replace("text", F.lit("a@b.co"), F.lit("a*****"))))
    originals = texts_of.read_files(spark, f"file://{source}", "*.docx").select("file_id", "content")
    out = files.export(changed.unionByName(spark.createDataFrame([("q.odt", 0, 0, 0, "x")], changed.schema)), None, originals, texts_of.read_txt(spark, f"file://{source}"))
    assert sorted((r.file_id.rsplit("/", 1)[-1], r.error) for r in out["errors"].collect()) == [("b.txt", "GBK lacks a character of the text; write it as UTF-8"), ("q.odt", "a kind of file that is not written")]
    written = files.write_back(out["txt"].select("file_id", "content").unionByName(out["docx"]), f"file://{tmp_path}/out")
    assert written.count() == 3
    made = {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir() if not f.name.endswith(".crc")}
    assert sorted(made) == ["a_脱敏.txt", "a_脱敏_1.txt", "d_脱敏.docx"]
    assert {made["a_脱敏.txt"], made["a_脱敏_1.txt"]} == {"电话 one\n二".encode("gbk"), b"plain"}
    assert [x["text"] for x in office.docx_paragraphs(made["d_脱敏.docx"])] == ["first", "mail a*****"]
