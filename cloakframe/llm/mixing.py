"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts per cell (source, language, topic) are raked until their marginals meet the targets.  A
document of a cell is kept with the probability min(1, c * raked / counted tokens), where c is such
that the kept tokens come to ``BUDGET`` of all; so a rare cell that targets lift above its tokens is
kept whole, and the rest shares what is left of the budget in the raked proportions.  Decisions come
from a hash of doc_id, so they are repeatable.  Documents are read once for the counts and once for
the sample.  Cells are few: up to ``BROADCAST_CELLS`` of them are raked as arrays, more by joins.

Targets default to powers of the counted shares (a power below one lifts small values); other
targets come as DataFrames (value, weight) for each margin.

Defined results: a null source, language or topic is the value ''; null text has no tokens; rows
with one doc_id share a decision, a null doc_id is hashed as ''; cells without tokens and values
without target have probability 0; an empty table gives no rows; columns of the input are kept
(those named ``mix_...`` give way to the results); targets of values that no cell has are left
out, and where targets contradict each other ``residuals`` shows what is missed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

POWERS = {"source": 0.9, "lang": 0.95, "topic": 0.95}
ROUNDS = 8
#: Share of all tokens that the sample is to have.
BUDGET = 0.9
MARGINS = ("source", "lang", "topic")
#: Cells up to this number are raked as arrays and broadcast to the documents; more are joined by shuffles.
BROADCAST_CELLS = 100_000


def topic(text: Column) -> Column:
    """A plain topic by form: tables, licensed material, records with addresses, loud text, prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(F.lower(text), F.lit("licens")), "licensed")
        .when(F.contains(text, F.lit("@")), "records")
        .when(F.contains(text, F.lit("!!")), "loud")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_margins(docs: DataFrame) -> DataFrame:
    """rest (a struct of the input's columns but those named mix_..., so no name can clash), the margins, tokens and a number to sample by."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if not c.startswith("mix_")]).alias("rest"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        topic(F.coalesce("text", F.lit(""))).alias("topic"),
        n_tokens(F.col("text")).alias("tokens"),
        uniform(F.col("doc_id")).alias("u"),
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, budget: float = BUDGET, few: int = BROADCAST_CELLS) -> DataFrame:
    """Adds the targets ``t_...``, ``raked`` and the probability ``p`` to cells (source, lang, topic, tokens)."""
    cells = materialize(cells, "cells")
    own = {}
    for m in MARGINS:
        own[m] = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("own"))
        if targets and m in targets:
            t = targets[m].groupBy(F.coalesce("value", F.lit("")).alias(m)).agg(F.sum("weight").cast("double").alias("weight"))
            own[m] = own[m].join(t, m, "left").select(m, F.coalesce("weight", F.lit(0.0)).alias(f"t_{m}"))
        else:
            own[m] = own[m].select(m, F.pow("own", F.lit(powers[m])).alias(f"t_{m}"))
    return _rake_arrays(cells, own, rounds, budget) if cells.count() <= few else _rake_joins(cells, own, rounds, budget)


def _rake_arrays(cells: DataFrame, own: dict[str, DataFrame], rounds: int, budget: float) -> DataFrame:
    rows = cells.select(*MARGINS, F.col("tokens").cast("double").alias("tokens")).collect()
    tokens = np.array([r["tokens"] for r in rows], float)
    raked, wanted, codes = tokens.copy(), {}, {}
    for m in MARGINS:
        known = dict(own[m].collect())  # no more values than cells
        names = sorted(known)
        place = {v: k for k, v in enumerate(names)}
        wanted[m], codes[m] = np.array([known[v] for v in names], float), np.array([place[r[m]] for r in rows], np.int64)
    for _ in range(rounds):
        for m in MARGINS:
            have = np.bincount(codes[m], raked, len(wanted[m]))
            want = wanted[m] / (wanted[m].sum() or 1.0) * tokens.sum()
            raked *= np.divide(want, have, out=np.zeros(len(have)), where=have > 0)[codes[m]]
    ratio = np.divide(raked, tokens, out=np.zeros(len(rows)), where=tokens > 0)
    p = np.minimum(1.0, ratio * budget_scale(ratio, tokens, raked, budget))
    out = [(*(r[m] for m in MARGINS), int(r["tokens"]), *(float(wanted[m][codes[m][k]]) for m in MARGINS), float(raked[k]), float(p[k])) for k, r in enumerate(rows)]
    return cells.sparkSession.createDataFrame(out, "source string, lang string, topic string, tokens long, t_source double, t_lang double, t_topic double, raked double, p double")


def budget_scale(ratio: np.ndarray, tokens: np.ndarray, raked: np.ndarray, budget: float) -> float:
    """c with sum(tokens * min(1, c * ratio)) = budget * sum(tokens): cells are filled from the largest ratio on."""
    order = np.argsort(-ratio, kind="stable")
    order = order[ratio[order] > 0]
    before_tokens, before_raked = np.cumsum(tokens[order]) - tokens[order], np.cumsum(raked[order]) - raked[order]
    c = (budget * tokens.sum() - before_tokens) / np.maximum(raked.sum() - before_raked, 1e-300)
    fits = np.flatnonzero(c * ratio[order] <= 1)
    return float(max(c[fits[0]], 0.0)) if len(fits) else float(1 / ratio[order[-1]]) if len(order) else 0.0


def _rake_joins(cells: DataFrame, own: dict[str, DataFrame], rounds: int, budget: float) -> DataFrame:
    """The same for any number of cells; each step uses the cells twice, so they are written after each step and the plans stay small."""
    tokens = float(cells.agg(F.sum("tokens").alias("s")).first()["s"] or 0)
    sums = {m: own[m].agg(F.sum(f"t_{m}").alias("s")).first()["s"] or 1.0 for m in MARGINS}
    cells = cells.withColumn("raked", F.col("tokens").cast("double"))
    for m in MARGINS:
        cells = cells.join(own[m], m)
    cells = materialize(cells, "cells")
    for _ in range(rounds):
        for m in MARGINS:
            # sums are aggregated before they are joined back, so a value that holds most cells is no hot key
            have = cells.groupBy(m).agg(F.sum("raked").alias("have"))
            want = F.col(f"t_{m}") / F.lit(sums[m]) * F.lit(tokens)
            raked = F.when(F.col("have") > 0, F.col("raked") * want / F.col("have")).otherwise(0.0)
            cells = materialize(cells.join(have, m).withColumn("raked", raked).drop("have"), "raked")
    ratio = F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0)
    scale, full = 0.0, None
    while True:  # each turn fills the cells that the scale so far puts above one
        above = (ratio * F.lit(scale) > 1) & (ratio > 0)
        s = cells.agg(F.sum(F.when(above, F.col("tokens")).otherwise(0)).alias("filled"), F.sum(F.when(above, 0.0).otherwise(F.col("raked"))).alias("rest"), F.count_if(above).alias("n"), F.min(F.when(ratio > 0, ratio)).alias("least")).first()
        if s["n"] == full or not s["least"]:
            break
        full = s["n"]
        scale = (budget * tokens - s["filled"]) / s["rest"] if s["rest"] else 1 / s["least"]
    return cells.withColumn("p", F.least(F.lit(1.0), ratio * F.lit(float(scale))))


def residuals(cells: DataFrame) -> dict[str, float]:
    """For each margin, the largest share of all tokens by which a raked value misses its target (cells of ``rake``)."""
    out, tokens = {}, float(cells.agg(F.sum("tokens").alias("s")).first()["s"] or 0)
    for m in MARGINS:
        values = cells.groupBy(m).agg(F.first(f"t_{m}").alias("t"), F.sum("raked").alias("have"))
        total = values.agg(F.sum("t").alias("s")).first()["s"] or 1.0
        worst = values.agg(F.max(F.abs(F.col("have") - F.col("t") / F.lit(total) * F.lit(tokens))).alias("w")).first()["w"] or 0.0
        out[m] = worst / tokens if tokens else 0.0
    return out


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """docs with ``mix_topic``, ``mix_tokens``, ``mix_p`` and ``mix_keep``."""
    own = with_margins(docs)
    cells = own.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    raked = materialize(rake(cells, targets, powers, rounds, budget).select(*MARGINS, F.col("p").alias("mix_p")), "shares")
    if raked.count() <= BROADCAST_CELLS:
        raked = F.broadcast(raked)
    return own.join(raked, list(MARGINS)).select(
        *[F.col(f"rest.`{c}`").alias(c) for c in docs.columns if not c.startswith("mix_")],
        F.col("topic").alias("mix_topic"),
        F.col("tokens").alias("mix_tokens"),
        "mix_p",
        (F.col("u") < F.col("mix_p")).alias("mix_keep"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs).select("doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_p", 9).alias("p"), F.col("mix_keep").alias("keep"))


def sql(docs: str = "documents", last: str | None = None) -> str:
    """DuckDB SQL of ``mix`` over the table or subquery ``docs``."""
    steps = ["w0 AS (SELECT source, lang, topic, tokens, tokens::DOUBLE AS w, ts, tl, tt FROM targets)"]
    for k in range(3 * ROUNDS):
        m, t = (("source", "ts"), ("lang", "tl"), ("topic", "tt"))[k % 3]
        steps.append(f"w{k + 1} AS (SELECT source, lang, topic, tokens, CASE WHEN sum(w) OVER (PARTITION BY {m}) > 0 THEN w * {t} / sum(w) OVER (PARTITION BY {m}) ELSE 0 END AS w, ts, tl, tt FROM w{k})")
    share = "\n".join(f"m{m} AS (SELECT {m}, power(sum(tokens)::DOUBLE, {POWERS[m]}) AS t FROM cells GROUP BY {m})," for m in MARGINS)
    scaled = ", ".join(f"m{m}.t / (SELECT sum(t) FROM m{m}) * (SELECT sum(tokens) FROM cells) AS {alias}" for m, alias in zip(MARGINS, ("ts", "tl", "tt")))
    return f"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(lower(coalesce(text, '')), 'licens') THEN 'licensed'
      WHEN contains(coalesce(text, ''), '@') THEN 'records' WHEN contains(coalesce(text, ''), '!!') THEN 'loud' ELSE 'prose' END AS topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens
  FROM {docs}),
cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM own GROUP BY ALL),
{share}
targets AS (SELECT cells.*, {scaled} FROM cells JOIN msource USING (source) JOIN mlang USING (lang) JOIN mtopic USING (topic)),
{", ".join(steps)},
ratios AS MATERIALIZED (SELECT source, lang, topic, tokens, w, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS r FROM w{3 * ROUNDS}),
filled AS (SELECT r, row_number() OVER o AS k, ({BUDGET} * (SELECT sum(tokens) FROM ratios) - (sum(tokens) OVER o - tokens)) / greatest((SELECT sum(w) FROM ratios) - (sum(w) OVER o - w), 1e-300) AS c FROM ratios WHERE r > 0
  WINDOW o AS (ORDER BY r DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)),
shares AS (SELECT source, lang, topic, least(1, r * coalesce((SELECT greatest(arg_min(c, k), 0) FROM filled WHERE c * r <= 1), (SELECT 1 / min(r) FROM filled), 1)) AS p FROM ratios)
""" + (
        last
        or "SELECT doc_id, topic, n_tokens, round(p, 9) AS p, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < p AS keep FROM own JOIN shares USING (source, lang, topic)"
    )
