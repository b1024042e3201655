"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read by the next.

Defined results: rows without a letter in their text go in the first stage, and a null lang becomes
the predicted one.  Of each group of near
duplicates the row with the least doc_id stays (of equal ones that with the least hash of its text);
rows without doc_id belong to no group and stay.  Rows that repeat doc_id and text are one document;
rows that share a doc_id only are documents of their own, and each is judged by its own text.  Columns keep their values; the last stage
returns what the token files hold.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import decontaminate as decontamination
from cloakframe.llm import langid, mixing, ngram_join, token_files
from cloakframe.llm.shared import materialize, ranked, shared_dir, sized

SHINGLE_WORDS = 5
PERCENT = 80
#: Removed documents up to this number are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter; the others get the predicted language where none is given."""
    found = langid.predict_rows(docs, langid.fit(docs)).where(langid.has_letter())
    known = F.when(F.col("lang_pred") != langid.UNDETERMINED, F.col("lang_pred"))
    own = {"text": F.col("text"), "lang": F.coalesce("rest.lang", known)}
    return found.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that 5-word shingles of similarity 0.8 or more link."""
    rows = docs.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if rows["n"] > rows["d"]:
        return _repeated_ids(docs)
    linked = ngram_join.jaccard_components(docs, SHINGLE_WORDS, PERCENT)
    gone = materialize(linked.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(sized(gone, BROADCAST_IDS), "doc_id", "left_anti")


def _repeated_ids(docs: DataFrame) -> DataFrame:
    """The same where several rows share a doc_id: a document is a doc_id with a text, and of a group the least pair stays."""
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    key = F.xxhash64("text").alias("__hash")
    pairs = materialize(ranked(own.select("doc_id", key), [F.col("doc_id"), F.col("__hash")]), "documents")
    numbered = own.select("doc_id", "text", key).join(pairs, ["doc_id", "__hash"]).select(F.col("place").alias("doc_id"), "text")
    linked = ngram_join.jaccard_components(materialize(numbered, "numbered"), SHINGLE_WORDS, PERCENT)
    out = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("place")).distinct()
    gone = materialize(pairs.join(out, "place").select(F.col("doc_id").alias("__id"), F.col("__hash").alias("__gone")), "gone")
    kept = own.join(sized(gone, BROADCAST_IDS), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__gone")), "left_anti")
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of the benchmark."""
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    rest = [F.col(f"rest.`{c}`").alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return found.where(F.size("items") == 0).select("doc_id", "text", *rest).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics meet their target weights."""
    return mixing.mix(docs).where("mix_keep").select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents as token files and returns what the files hold."""
    return token_files.read_documents(token_files.write_token_files(docs, shared_dir(spark, "tokens")))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: The first and the last stage have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shared_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}-{name}")
        docs = spark.read.parquet(f"{out}/{k}-{name}")
    return docs
