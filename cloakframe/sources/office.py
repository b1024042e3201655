"""Office documents through the standard library: DOCX paragraphs and XLSX cells, and their writers.

One file is one task's work; files spread over the cluster.  Files that cannot be read give a row
with an error instead of failing the job; encrypted ones give ``ENCRYPTED:<ext>``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources.text import read_files

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PARAGRAPH = "file_id string, row int, text string, style string, table_index int, table_row int, table_col int, col_count int, error string"
CELL = "file_id string, sheet_index int, sheet_name string, row int, col int, text string, cell_type string, serial double, error string"
#: Number formats that show a serial number as a date (built-in ids of the format).
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _run_text(p: ET.Element) -> str:
    out = []
    for x in p.iter():
        if x.tag == f"{WORD}t":
            out.append(x.text or "")
        elif x.tag == f"{WORD}tab":
            out.append("\t")
        elif x.tag == f"{WORD}br":
            out.append("\n")
    return "".join(out)


def normal_style(style: str | None) -> str:
    low = (style or "").lower().replace(" ", "")
    if m := re.fullmatch(r"heading([1-4])", low):
        return f"heading{m[1]}"
    return "listParagraph" if low == "listparagraph" else "normal"


def docx_paragraphs(raw: bytes) -> list[dict]:
    """Paragraphs in document order; blank ones are dropped but keep their index."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        if names & {"EncryptedPackage", "EncryptionInfo"}:
            return [{"error": "ENCRYPTED:docx"}]
        root = ET.fromstring(z.read("word/document.xml"))
    out, index = [], 0

    def add(p: ET.Element, place: tuple | None) -> None:
        nonlocal index
        if not len(p):
            return  # an empty element has no index
        text = _run_text(p)
        if text.strip():
            style = p.find(f"{WORD}pPr/{WORD}pStyle")
            row = {"row": index, "text": text, "style": normal_style(None if style is None else style.get(f"{WORD}val"))}
            if place:
                row |= dict(zip(("table_index", "table_row", "table_col", "col_count"), place))
            out.append(row)
        index += 1

    tables = 0
    for node in root.find(f"{WORD}body") if root.find(f"{WORD}body") is not None else root:
        if node.tag == f"{WORD}p":
            add(node, None)
        elif node.tag == f"{WORD}tbl":
            for r, tr in enumerate(node.findall(f"{WORD}tr")):
                cells = tr.findall(f"{WORD}tc")
                for c, tc in enumerate(cells):
                    for p in tc.iter(f"{WORD}p"):
                        add(p, (tables, r, c, len(cells)))
            tables += 1
    return out


def to_docx(segments: DataFrame, originals: DataFrame) -> DataFrame:
    """file_id and content of documents (file_id, content) with the paragraphs of segments written in; a paragraph's number is its row."""
    texts = segments.where("text is not null").groupBy("file_id").agg(F.collect_list(F.struct("row", "text")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                content = docx_rewrite(r["content"], {x["row"]: x["text"] for x in r["texts"]})
                yield pa.RecordBatch.from_arrays([pa.array([r["file_id"]], pa.string()), pa.array([content], pa.binary())], names=["file_id", "content"])

    return originals.join(texts, "file_id").select("file_id", "content", "texts").mapInArrow(run, "file_id string, content binary")


def docx_rewrite(raw: bytes, texts: dict[int, str]) -> bytes:
    """The document with the text of paragraphs replaced; all other parts are copied as they are."""
    source, out = zipfile.ZipFile(io.BytesIO(raw)), io.BytesIO()
    ET.register_namespace("w", WORD[1:-1])
    root = ET.fromstring(source.read("word/document.xml"))
    index = 0
    for p in root.iter(f"{WORD}p"):
        if not len(p):
            continue
        if index in texts:
            first = True
            for run in p.iter(f"{WORD}r"):
                for x in list(run):
                    if x.tag in (f"{WORD}br", f"{WORD}tab"):
                        run.remove(x)
                    elif x.tag == f"{WORD}t":
                        x.text = texts[index] if first else ""
                        x.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
                        first = False
        index += 1
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for item in source.infolist():
            z.writestr(item, ET.tostring(root, xml_declaration=True, encoding="UTF-8") if item.filename == "word/document.xml" else source.read(item.filename))
    return out.getvalue()


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def _typed(value: str, kind: str, is_date: bool) -> tuple[str, str, float | None]:
    if kind == "b":
        return ("true" if value == "1" else "false"), "Boolean", None
    if kind == "e":
        return f"#ERROR: {value}", "Text", None
    if kind == "d":
        return value, "DateTimeIso", None
    number = float(value)
    if is_date:
        return str(number).rstrip("0").rstrip("."), "DateTime", number
    return (str(int(number)), "Integer", None) if number.is_integer() and abs(number) < 1e15 else (repr(number), "Float", None)


def xlsx_cells(raw: bytes) -> list[dict]:
    """Cells of all sheets; row 0 is the header."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        if names & {"EncryptedPackage", "EncryptionInfo"}:
            return [{"error": "ENCRYPTED:xlsx"}]
        strings = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{SHEET}si")]
        dates = []
        if "xl/styles.xml" in names:
            styles = ET.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in styles.iter(f"{SHEET}numFmt")}
            for xf in styles.findall(f"{SHEET}cellXfs/{SHEET}xf"):
                n = int(xf.get("numFmtId") or 0)
                dates.append(n in DATE_FORMATS or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(n, "")), re.I)))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for k, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet")):
            target = rels[sheet.get(f"{REL}id")].lstrip("/")
            root = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            for r, row in enumerate(root.iter(f"{SHEET}row")):
                for c in row.findall(f"{SHEET}c"):
                    kind, v, inline = c.get("t") or "n", c.find(f"{SHEET}v"), c.find(f"{SHEET}is")
                    if inline is not None:
                        typed = ("".join(t.text or "" for t in inline.iter(f"{SHEET}t")), "Text", None)
                    elif v is None or v.text is None:
                        continue
                    elif kind in ("s", "str"):
                        typed = (strings[int(v.text)] if kind == "s" else v.text, "Text", None)
                    else:
                        style = int(c.get("s") or 0)
                        typed = _typed(v.text, kind, style < len(dates) and dates[style])
                    out.append({"sheet_index": k, "sheet_name": sheet.get("name"), "row": int(row.get("r") or r + 1) - 1, "col": _column(c.get("r")), **dict(zip(("text", "cell_type", "serial"), typed))})
    return out


def xlsx_bytes(cells: list[dict]) -> bytes:
    """A workbook with the given cells (sheet_index, sheet_name, row, col, text, cell_type, serial)."""
    sheets: dict[int, tuple[str, dict]] = {}
    for c in cells:
        sheets.setdefault(c["sheet_index"], (c.get("sheet_name") or f"Sheet{c['sheet_index'] + 1}", {}))[1][c["row"], c["col"]] = c

    def ref(row: int, col: int) -> str:
        name = ""
        col += 1
        while col:
            col, x = divmod(col - 1, 26)
            name = chr(65 + x) + name
        return f"{name}{row + 1}"

    def one(c: dict) -> str:
        place, kind = ref(c["row"], c["col"]), c.get("cell_type") or "Text"
        if kind in ("Integer", "Float"):
            return f'<c r="{place}"><v>{escape(c["text"])}</v></c>'
        if kind == "Boolean":
            return f'<c r="{place}" t="b"><v>{int(c["text"] == "true")}</v></c>'
        if kind == "DateTime" and c.get("serial") is not None:
            return f'<c r="{place}" s="{1 if float(c["serial"]).is_integer() else 2}"><v>{c["serial"]}</v></c>'
        return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(c["text"] or "")}</t></is></c>'

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel, types = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/content-types"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        order = sorted(sheets)
        for n, k in enumerate(order, 1):
            rows: dict[int, list[str]] = {}
            for (r, _), c in sorted(sheets[k][1].items()):
                rows.setdefault(r, []).append(one(c))
            body = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in rows.items())
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        names = "".join(f'<sheet name="{escape(sheets[k][0])}" sheetId="{n}" r:id="r{n}"/>' for n, k in enumerate(order, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts count="2"><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/><numFmt numFmtId="171" formatCode="yyyy-mm-dd hh:mm:ss"/></numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        links = "".join(f'<Relationship Id="r{n}" Type="{rel}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(order) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}<Relationship Id="rs" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in range(1, len(order) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{types}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
    return out.getvalue()


def _reader(spark: SparkSession, path: str, glob: str, parse, ddl: str) -> DataFrame:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    rows = parse(r["content"]) if r["content"] is not None else [{"error": r["error"]}]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError) as e:
                    old = r["content"][:4] == b"\xd0\xcf\x11\xe0"  # the older binary format, also of encrypted files
                    rows = [{"error": "ENCRYPTED or an older binary format, which is not read" if old else f"{type(e).__name__}: {e}"}]
                rows = [{**dict.fromkeys(schema.names), "file_id": r["file_id"], **x} for x in rows]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return read_files(spark, path, glob).mapInArrow(run, ddl)


def read_docx(spark: SparkSession, path: str, glob: str = "*.docx") -> DataFrame:
    return _reader(spark, path, glob, docx_paragraphs, PARAGRAPH)


def read_xlsx(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    return _reader(spark, path, glob, xlsx_cells, CELL)


def paragraphs_to_segments(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where("error is null").select("file_id", F.lit(0).alias("sheet_index"), "row", F.lit(0).alias("col"), "text")


def cells_to_segments(cells: DataFrame) -> DataFrame:
    return cells.where("error is null").select("file_id", "sheet_index", "row", "col", "text")


def to_xlsx(cells: DataFrame) -> DataFrame:
    """file_id and content of a workbook for each file; a file's cells are one task's work, as a workbook is."""

    def build(table: pa.Table) -> pa.Table:
        return pa.table({"file_id": table.column("file_id").slice(0, 1), "content": pa.array([xlsx_bytes(table.to_pylist())], pa.binary())})

    return cells.groupBy("file_id").applyInArrow(build, "file_id string, content binary")
