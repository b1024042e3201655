"""Page layout: text objects to lines, and spans to rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_GAP, SPACE_GAP = 1.2, 0.15
OBJECT = "file_id string, page int, text string, left double, top double, right double, bottom double, font_size double"


def page_lines(objects: DataFrame) -> DataFrame:
    """file_id, page, line, text, objects: objects by page, from top to bottom, left to right.

    An object is on the line while its top differs from that of the line's first object by at most
    LINE_GAP of its own font size; a gap over SPACE_GAP of the font size becomes a blank.
    """
    o = F.struct((-F.col("top")).alias("down"), "left", "top", "right", "bottom", "font_size", "text")
    pages = objects.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(o)).alias("all"))
    piece = "struct<text:string,left:double,top:double,right:double,bottom:double,char_offset:int>"
    line = f"struct<text:string,first:double,right:double,objects:array<{piece}>>"
    start = F.struct(F.expr(f"cast(null as {line})").alias("now"), F.expr(f"cast(array() as array<{line}>)").alias("out"))

    def part(x: Column, at: Column) -> Column:
        return F.array(F.struct(x["text"].alias("text"), x["left"].alias("left"), x["top"].alias("top"), x["right"].alias("right"), x["bottom"].alias("bottom"), at.cast("int").alias("char_offset")))

    def step(a: Column, x: Column) -> Column:
        now = a["now"]
        fresh = F.struct(x["text"].alias("text"), x["top"].alias("first"), x["right"].alias("right"), part(x, F.lit(0)).alias("objects"))
        glue = F.when(x["left"] - now["right"] > SPACE_GAP * x["font_size"], " ").otherwise("")
        joined = F.struct(F.concat(now["text"], glue, x["text"]).alias("text"), now["first"].alias("first"), x["right"].alias("right"), F.concat(now["objects"], part(x, F.char_length(now["text"]) + F.char_length(glue))).alias("objects"))
        same = now.isNotNull() & (F.abs(x["top"] - now["first"]) <= LINE_GAP * x["font_size"])
        closed = F.when(now.isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(now)))
        return F.when(same, F.struct(joined.alias("now"), a["out"].alias("out"))).otherwise(F.struct(fresh.alias("now"), closed.alias("out")))

    lines = F.aggregate("all", start, step, lambda a: F.when(a["now"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["now"]))))
    return pages.select("file_id", "page", F.posexplode(lines).alias("line", "x")).select("file_id", "page", "line", "x.text", "x.objects")


def redact_targets(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Rectangles (file_id, page, line, left, top, right, bottom) of the objects that items overlap."""
    o = lines.select("file_id", "page", "line", F.explode("objects").alias("o"))
    end = F.col("o.char_offset") + F.char_length("o.text")
    hit = items.join(o, ["file_id", "page", "line"]).where((F.col("o.char_offset") < F.col("end")) & (end > F.col("start")))
    return hit.select("file_id", "page", "line", F.col("o.left").alias("left"), F.col("o.top").alias("top"), F.col("o.right").alias("right"), F.col("o.bottom").alias("bottom")).distinct()


def redact_preview(targets: DataFrame, pages: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Targets on a screen of size one (y grows downward); pages: file_id, page, width, height."""
    p = targets.join(pages, ["file_id", "page"]).select("file_id", "page", (F.col("left") / F.col("width")).alias("left"), (1 - F.col("top") / F.col("height")).alias("top"), (F.col("right") / F.col("width")).alias("right"), (1 - F.col("bottom") / F.col("height")).alias("bottom"))
    return p if manual is None else p.unionByName(manual)
