"""Dictionary matching: literal entries found in segments.

Entries overlap freely here; merging settles overlaps later.  Exact entries match as they are; fuzzy
ones match the lower-cased text and show the original at the same characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.operators.detect import KEYS
from cloakframe.operators.search import find_literals

#: Built-in entries by type; those of FUZZY match without case.
BUILTIN = {
    "zh": {
        "OrgName": "有限公司 股份有限公司 集团有限公司 责任有限公司 人民法院 人民检察院 人民政府 公安局 派出所 居委会 村委会".split(),
        "Address": "北京市 上海市 广州市 深圳市 杭州市 南京市 成都市 武汉市 重庆市 天津市 苏州市 西安市 长沙市 郑州市 青岛市 合肥市 济南市 福州市 厦门市 昆明市".split(),
    },
    "en": {
        "OrgName": ["Inc.", "Corp.", "Corporation", "LLC", "Ltd.", "Limited", "Holdings", "Foundation", "Association", "University", "Hospital", "Bank of"],
        "Address": [
            "New York", "Los Angeles", "Chicago", "Phoenix", "Philadelphia", "San Antonio", "San Diego", "San Francisco", "Seattle", "Denver",
            "Nashville", "London", "Edinburgh", "California", "Texas", "Florida", "Illinois", "Pennsylvania", "Michigan", "Massachusetts",
        ],
        "Ssn": ["Social Security"],
        "DriversLicense": ["Driver's License", "Drivers License"],
        "Passport": ["Passport No", "Passport Number"],
    },
}
FUZZY = {"University", "Hospital", "Bank of", "Social Security", "Driver's License", "Drivers License", "Passport No", "Passport Number"}
ENTRY = "entry_idx int, text string, type string, match_mode string, replacement string, language string"


def builtin_entries(spark: SparkSession, language: str, first_idx: int = 0) -> DataFrame:
    rows, k = [], first_idx
    for type_key, texts in BUILTIN[language].items():
        for t in texts:
            rows.append((k, t, type_key, "Fuzzy" if t in FUZZY else "Exact", None, language))
            k += 1
    return spark.createDataFrame(rows, ENTRY)


def detect_dictionary(segments: DataFrame, entries: DataFrame, language: str | None = None) -> DataFrame:
    """Items of all entries (for a language: those of it and those of none); ord follows the entries' order.

    Entries stay a table: places come from a search by hashes (see ``search``) and are joined with the
    entries that look so.  Places of one entry in one text don't overlap each other.
    """
    chosen = entries.where("text is not null and text <> ''").select("entry_idx", F.col("text").alias("entry"), "type", "match_mode", "language")
    if language is not None:
        chosen = chosen.where(F.col("language").isNull() | (F.col("language") == language))
    fuzzy = F.coalesce(F.col("match_mode") == "Fuzzy", F.lit(False))
    looks = chosen.select("entry_idx", "type", F.when(fuzzy, F.lower("entry")).otherwise(F.col("entry")).alias("look"), fuzzy.alias("fuzzy"))
    given = segments.where("text is not null and text <> ''").select(*KEYS, "text")
    parts = []
    for loose, text in ((False, F.col("text")), (True, F.lower("text"))):
        own = looks.where(F.col("fuzzy") == loose)
        found = find_literals(given.withColumn("__find", text), KEYS, "__find", own, "text" if loose else None)
        parts.append(apart(found).join(own, "look"))
    order = F.col("entry_idx").cast("long") * (1 << 31) + F.col("start")
    return parts[0].unionByName(parts[1]).select(*KEYS, order.alias("ord"), "start", "end", F.col("shown").alias("text"), "type", F.lit("Dict").alias("source"), F.lit(1.0).alias("confidence"), "entry_idx")


def apart(found: DataFrame) -> DataFrame:
    """Places of one literal without those that overlap the one kept before, from the left."""
    near = F.lag("end").over(W.partitionBy(*KEYS, "look").orderBy("start"))
    marked = found.withColumn("__new", F.coalesce(F.col("start") >= near, F.lit(True)).cast("int"))
    # places of a chain overlap their neighbours: only chains of several are folded
    chain = marked.withColumn("__chain", F.sum("__new").over(W.partitionBy(*KEYS, "look").orderBy("start")))
    lists = chain.groupBy(*KEYS, "look", "__chain").agg(F.array_sort(F.collect_list(F.struct("start", "end", "shown"))).alias("all"))
    first = F.struct(F.lit(0).alias("at"), F.filter("all", lambda x: F.lit(False)).alias("kept"))

    def step(a: Column, x: Column) -> Column:
        return F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)

    kept = F.when(F.size("all") > 1, F.aggregate("all", first, step, lambda a: a["kept"])).otherwise(F.col("all"))
    return lists.select(*KEYS, "look", F.explode_outer(kept).alias("x")).where("x is not null").select(*KEYS, "look", "x.start", "x.end", "x.shown")


def upsert_entries(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries by text: a new one takes the place of an old one with the same text."""
    both = entries.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy("text").agg(F.max_by(F.struct(*[c for c in entries.columns if c != "text"]), F.struct("__new", "entry_idx")).alias("x")).select("text", "x.*").select(*entries.columns)
