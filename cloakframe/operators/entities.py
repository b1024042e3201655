"""The pluggable entity engine: decoders as native folds, and backends as Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.detect import KEYS

#: Labels of common models and the types they stand for.
LABELS = {"PER": "PersonName", "PERSON": "PersonName", "ORG": "OrgName", "ORGANIZATION": "OrgName", "LOC": "Address", "LOCATION": "Address", "GPE": "Address", "TITLE": "Title"}
ENTITY = "array<struct<label:string,start:int,end:int,conf:double>>"


class Backend(Protocol):
    """Finds raw entities (label, start, end, confidence) in a batch of texts; picklable."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]: ...


class Lexicon:
    """A backend that knows a list of names by label; stands in where no model is at hand."""

    def __init__(self, names: dict[str, str]):
        self.names = dict(sorted(names.items(), key=lambda x: -len(x[0])))

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        out = []
        for t in texts:
            own, at = [], 0
            while at < len(t):
                hit = next((n for n in self.names if t.startswith(n, at)), None)
                if hit:
                    own.append((self.names[hit], at, at + len(hit), 0.9))
                at += len(hit) if hit else 1
            out.append(own)
        return out


def detect_entities(segments: DataFrame, backend: Callable | None, labels: dict[str, str] = LABELS) -> DataFrame:
    """Items of a backend; without one there are none (never an error).  Unknown labels are dropped."""
    schema = "start int, end int, text string, type string, source string, confidence double"
    if backend is None:
        return segments.sparkSession.createDataFrame([], "file_id string, sheet_index int, row int, col int, ord int, " + schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for row, found in zip(rows, backend([r["text"] for r in rows])):
                for k, (label, s, e, conf) in enumerate(found):
                    out.append({**{c: row[c] for c in KEYS}, "ord": k, "start": s, "end": e, "text": row["text"][s:e], "label": label, "confidence": conf})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=raw)

    raw = pa.schema([("file_id", pa.string()), ("sheet_index", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("ord", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("label", pa.string()), ("confidence", pa.float64())])
    found = segments.where("text is not null and text <> ''").select(*KEYS, "text").mapInArrow(run, "file_id string, sheet_index int, row int, col int, ord int, start int, end int, text string, label string, confidence double")
    named = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return found.withColumn("type", named[F.col("label")]).where("type is not null").select(*KEYS, "ord", "start", "end", "text", "type", F.lit("Ner").alias("source"), "confidence")


def argmax_confidence(logits: Column) -> tuple[Column, Column]:
    """Index (from 0) and softmax probability of the largest logit."""
    top = F.array_max(logits)
    return F.array_position(logits, top) - 1, 1 / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))


def is_bio(labels: list[str]) -> bool:
    return any(x.startswith("B-") for x in labels)


def decode(tokens: Column, scheme: str = "bio") -> Column:
    """Entities from tokens (label, conf, start, end).

    bio: B- opens, I- extends an open entity of its type, and one without such is dropped.
    io: I- of another type (or after a gap of O) opens.  A token with offsets (0, 0), O, or a
    dropped I- closes.  An entity's confidence is the mean of its tokens'.
    """
    empty = F.expr(f"cast(array() as {ENTITY})")
    none = F.expr("cast(null as struct<label:string,start:int,end:int,total:double,n:int>)")
    start = F.struct(none.alias("now"), empty.alias("out"))

    def flush(a: Column) -> Column:
        now = a["now"]
        done = F.struct(now["label"].alias("label"), now["start"].alias("start"), now["end"].alias("end"), (now["total"] / now["n"]).alias("conf"))
        return F.when(now.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(done)))

    def step(a: Column, x: Column) -> Column:
        name = F.substring(x["label"], 3, 1000)
        prefix = F.left(x["label"], F.lit(2))
        special = (x["start"] == 0) & (x["end"] == 0)
        same = a["now"].isNotNull() & (a["now"]["label"] == name)
        fresh = F.struct(name.alias("label"), x["start"].alias("start"), x["end"].alias("end"), x["conf"].alias("total"), F.lit(1).alias("n"))
        longer = F.struct(name.alias("label"), a["now"]["start"].alias("start"), x["end"].alias("end"), (a["now"]["total"] + x["conf"]).alias("total"), (a["now"]["n"] + 1).alias("n"))
        opened = F.struct(fresh.alias("now"), flush(a).alias("out"))
        closed = F.struct(none.alias("now"), flush(a).alias("out"))
        extended = F.struct(longer.alias("now"), a["out"].alias("out"))
        if scheme == "bio":
            return F.when(special, closed).when(prefix == "B-", opened).when((prefix == "I-") & same, extended).otherwise(closed)
        return F.when(special, closed).when((prefix == "I-") & same, extended).when(prefix == "I-", opened).otherwise(closed)

    return F.aggregate(tokens, start, step, flush)
