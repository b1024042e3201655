"""Language ID by hierarchical discrimination.

A text's language family is predicted first; within a family, one-versus-one linear support vector
machines vote on the language.  All machines share one feature vector: counts of hashed 1- to
4-grams of the lower-cased UTF-8 bytes (anything but letters counts as one blank), scaled to unit
length.  The machines are trained on the driver, on a sample of labelled rows with a documented
bound (``per_lang`` rows of each of the ``max_langs`` most frequent languages, at most ``max_rows``
in all, chosen by a hash of doc_id); prediction runs over every whole text.

Families are a fixed table; languages it doesn't have form a family each.

Defined results: ``und`` with score 0 for texts that are null or have no letter; rows and null or
repeated doc_ids are kept; rows whose lang is null are predicted but never learned from; with no
labelled row at all every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches
from .words import give_back, text_slices

PER_LANG = 500
MAX_ROWS = 4000
MAX_LANGS = 64
BITS = 12
ORDERS = 4
UNDETERMINED = "und"

# Languages (ISO 639-1) of the larger European families.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "celtic": "ga gd cy br",
    "baltic": "lt lv",
    "turkic": "tr az kk ky uz tk tt",
    "indo_aryan": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

# Byte classes: A-Z lower-cased; every other ASCII byte but a-z is a blank (0x20).
FOLD = np.arange(256, dtype=np.uint8)
FOLD[:0x80] = 0x20
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def feature_ids(buf: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For n = 1 .. ORDERS, the feature of the n-gram that ends at each byte; blanks precede a text."""
    b = FOLD[buf].astype(np.uint32)
    out, code = [], np.zeros(len(b), np.uint32)
    back = b.copy()
    for n in range(ORDERS):
        code = code + (back << np.uint32(8 * n))
        out.append(((code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
        back = np.concatenate([np.full(1, 0x20, np.uint32), back[:-1]])
        back[starts] = 0x20
    return [x + np.uint32(k << BITS) for k, x in enumerate(out)]


WIDTH = ORDERS << BITS
#: Rows of one block of training vectors, which bounds the copies that a step makes.
BLOCK = 200


def vectors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and values of each text's vector of unit length."""
    out = []
    for text in texts:
        row = np.zeros(WIDTH, np.float32)
        for ids in feature_ids(np.frombuffer(text, np.uint8), np.zeros(min(1, len(text)), np.int64)):
            row += np.bincount(ids, minlength=WIDTH)
        at = np.flatnonzero(row).astype(np.uint16)
        out.append((at, row[at] / max(np.linalg.norm(row), 1e-9)))
    return out


@dataclass
class Block:
    """Some training vectors of one language, as features and values one row after the other."""

    at: np.ndarray
    value: np.ndarray
    sizes: np.ndarray

    def values(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.at] * self.value, np.cumsum(self.sizes) - self.sizes)

    def total(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * np.repeat(weights, self.sizes), WIDTH)


def fit_svm(positive: list[Block], negative: list[Block], steps: int = 60, c: float = 20.0) -> np.ndarray:
    """Linear machine with squared hinge loss by accelerated gradient steps; the last weight is the bias."""
    sides = [(block, side, c * 0.5 / sum(len(b.sizes) for b in blocks)) for side, blocks in ((1.0, positive), (-1.0, negative)) for block in blocks]
    w = np.zeros(WIDTH + 1)
    ahead, rate = w.copy(), 1 / (1 + 4 * c)
    for k in range(steps):
        grad = np.append(ahead[:-1], 0.0)
        for block, side, cost in sides:
            slack = np.maximum(0, 1 - side * (block.values(ahead[:-1].astype(np.float32)) + ahead[-1])) * cost * side
            grad[:-1] -= 2 * block.total(slack.astype(np.float32))
            grad[-1] -= 2 * slack.sum()
        new = ahead - rate * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w.astype(np.float32)


@dataclass
class Model:
    """Pairs of labels with a machine each: positive values speak for the first of a pair."""

    langs: list[str]
    families: list[str] = field(default_factory=list)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None

    def scores(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Decision values, one row for each document and one column for each pair."""
        out = np.zeros((len(offsets) - 1, len(self.pairs)), np.float64)
        if not len(buf) or not self.pairs:
            return out
        full = np.flatnonzero(np.diff(offsets))
        at = offsets[:-1][full]
        ids = feature_ids(buf, at)
        for k in range(len(self.pairs)):
            column = np.ascontiguousarray(self.weights[k, :-1])
            out[full, k] = sum(np.add.reduceat(column[x], at, dtype=np.float64) for x in ids)
        for d in full.tolist():
            out[d] /= norm([x[offsets[d] : offsets[d + 1]] for x in ids])
        return out + self.weights[:, -1]

    def predict(self, values: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = {p: values[:, k] for k, p in enumerate(self.pairs)}
        family, sure = self._vote(self.families, margin, len(values))
        out = np.full(len(values), UNDETERMINED, object)
        score = sure.copy()
        for name in self.families:
            own = np.flatnonzero(family == name)
            langs = [x for x in self.langs if FAMILY.get(x, x) == name]
            lang, inner = self._vote(langs, {p: v[own] for p, v in margin.items()}, len(own))
            out[own] = lang
            score[own] *= inner
        return out.tolist(), score

    @staticmethod
    def _vote(names: list[str], margin: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Most won pairs, then the larger sum of margins; and how sure the least sure won pair is."""
        if not names:
            return np.full(n, UNDETERMINED, object), np.zeros(n)
        votes, least = np.zeros((n, len(names))), np.full((n, len(names)), 1.0)
        for a, b in combinations(range(len(names)), 2):
            p = 1 / (1 + np.exp(-np.clip(4 * margin[names[a], names[b]], -40, 40)))
            votes[:, a] += (p >= 0.5) + 1e-3 * p
            votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
            least[:, a] = np.minimum(least[:, a], p)
            least[:, b] = np.minimum(least[:, b], 1 - p)
        best = votes.argmax(axis=1)
        return np.array(names, object)[best], least[np.arange(n), best]


def norm(ids: list[np.ndarray]) -> float:
    """Length of a document's count vector."""
    if len(ids[0]) < 64:
        return float(np.sqrt(sum(int((c.astype(np.int64) ** 2).sum()) for c in (np.unique(x, return_counts=True)[1] for x in ids))))
    return float(np.sqrt(sum(float(np.dot(c, c)) for c in (np.bincount(x & np.uint32((1 << BITS) - 1), minlength=1 << BITS).astype(np.float64) for x in ids))))


def has_letter() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS) -> Model:
    """Train on at most ``max_rows`` labelled rows, about ``per_lang`` of each language."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.abs(F.xxhash64(F.col("doc_id"), F.lit(17)) % 1_000_000_007).alias("h"))
    counts = dict(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect())
    if not counts:
        return Model([])
    per_lang = min(per_lang, max_rows // len(counts))
    bound = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(1_000_000_007 * min(1.0, per_lang / n)))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole texts as sparse vectors, so what goes to the driver is bounded by their length."""
        for batch in batches:
            found = vectors([(t or "").encode() for t in batch.column(1).to_pylist()])
            parts = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *parts], names=["lang", "h", "at", "x"])

    bounded_batches(docs.sparkSession)
    sample = labelled.where(F.col("h") <= bound[F.col("lang")]).where(has_letter()).select("lang", "text", "h")
    rows = sample.mapInArrow(features, "lang string, h long, at binary, x binary").orderBy("h", "lang", "at", "x").limit(max_rows).collect()
    blocks: dict[str, list[Block]] = {}
    for lang in sorted({r.lang for r in rows}):
        own = [r for r in rows if r.lang == lang]
        for part in (own[k : k + BLOCK] for k in range(0, len(own), BLOCK)):
            at, x = (b"".join(r[name] for r in part) for name in ("at", "x"))
            blocks.setdefault(lang, []).append(Block(np.frombuffer(at, np.uint16), np.frombuffer(x, np.float32), np.array([len(r["at"]) // 2 for r in part])))
    own = part = rows = None
    give_back()
    langs = list(blocks)
    families: dict[str, dict[str, list[Block]]] = {}
    for lang, own in blocks.items():
        families.setdefault(FAMILY.get(lang, lang), {})[lang] = own
    whole = {name: [b for own in members.values() for b in own] for name, members in sorted(families.items())}
    model, weights = Model(langs, list(whole)), []
    for members in [whole, *(families[name] for name in whole)]:
        for a, b in combinations(members, 2):
            model.pairs.append((a, b))
            weights.append(fit_svm(members[a], members[b]))
    model.weights = np.array(weights) if weights else np.zeros((0, WIDTH + 1), np.float32)
    return model


def predict_rows(docs: DataFrame, model: Model) -> DataFrame:
    """text, rest (a struct of all other columns, so no name can clash), lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    own = docs.select("text", F.struct(*rest).alias("rest"), has_letter().alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, buf, offsets in text_slices(batch, "text", 1 << 20):
                part = batch.slice(rows.start, rows.stop - rows.start)
                lang, score = model.predict(model.scores(buf, offsets))
                known = part.column(2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pc.if_else(known, pa.array(lang, pa.string()), UNDETERMINED), pc.if_else(known, pa.array(score), 0.0)],
                    names=["text", "rest", "lang_pred", "score"],
                )

    return own.mapInArrow(run, f"text string, rest {own.schema['rest'].dataType.simpleString()}, lang_pred string, score double")


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row, lang_pred and score; kept columns of these two names give way."""
    found = predict_rows(docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])]), model)
    own = [F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in keep if c not in ("lang_pred", "score")]
    return found.select(*own, "lang_pred", "score")


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
