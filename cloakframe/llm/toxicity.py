"""Toxicity: a lexicon trie intersected with Levenshtein automata, and context windows that tell quotation from abuse.

The lexicon is learned from labels: whole words, and stems (``stem*``: words that begin so), chosen one
after the other by how many toxic texts they explain that no chosen term explains yet.  A lexicon of
one's own can be added.  Words are read by an automaton that walks the trie with a few edits left (by
a term's length) and is made deterministic as it is used.  Misspelled forms that clean training texts
hold are ordinary words and no hits.  A hit is quoted if the words around it hold quotation marks on
both sides or speak about wording, and don't address anybody.  How much a quoted and a misspelled
hit count is learned too, from a prior on.

The score is 1 - (1 - base) * product of (1 - share * strength) over the terms found: the share of toxic
texts among those with so many places of the term, and the strength of its best place; base is the
share of toxic texts among those without hits.

Training takes at most ``PER_CLASS`` labelled rows of each class, ``CANDIDATES`` forms and ``TERMS``
terms (parameters); scoring covers all rows and whole texts.

Defined results: null and empty texts have no hits and the score base; without toxic labels the
lexicon is empty and base 0; of several labels of a doc_id the largest counts, and rows that repeat a
doc_id train as one; a null doc_id is never trained on and counts as ''; an empty table gives no rows;
other columns are kept in ``rest``, so no name can clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize

PER_CLASS, CANDIDATES, TERMS = 8000, 60_000, 1000
#: Least toxic texts of a form, and shortest and longest stem.
LEAST, STEM = 3, (4, 10)
#: What a term's log likelihood ratio needs: above ln(forms) over all texts, and in those that no chosen term explains.
EVIDENCE, RESIDUAL = 1.0, 1.5
WINDOW, THRESHOLD = 6, 0.7
#: Strength of quoted and misspelled hits beside plain ones before any is seen, and how many texts that prior weighs.
PRIOR, PRIOR_TEXTS = {"quoted": 0.3, "misspelled": 0.8}, 4
#: Places of a term in a text that are told apart: one, two, and so many or more.
COUNTS = 3
#: Share of toxic texts that a term of one's own stands for.
OWN = 0.95
_WORD = re.compile(r"[^\W_]+(?:[@$!*'’][^\W_]+)*")
_OPEN, _CLOSE = set("\"“„«‹‚‘"), set("\"”“»›’")
MENTION = set("said says saying wrote writes called calling quote quoted quotes word words term terms insult sagte schrieb nannte wort dit disait écrit mot dijo escribió llamó palabra".split())
ADDRESS = set("you your you're youre u du dich dir ihr euch tu toi te vous tú usted vosotros".split())


def edits_of(term: str) -> int:
    """Edits that a term allows, by its length; a stem, which takes any ending, allows none."""
    n = 0 if term.endswith("*") else len(term)
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """The Levenshtein automata of all terms along their trie, determinised on demand.

    A state maps trie nodes to the edits used so far; state 0 is dead.  Reading a word costs one
    lookup for each character.
    """

    MOST_STATES = 200_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.slack = [0]
        for k, term in enumerate(terms):
            node, allowed = 0, edits_of(term)
            self.slack[0] = max(self.slack[0], allowed)
            for c in term.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({}), self.ends.append([]), self.slack.append(0)
                node = self.child[node][c]
                self.slack[node] = max(self.slack[node], allowed)
            self.ends[node].append(k)
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {((), None): 0}
        self.states: list[tuple[dict[int, int], tuple | None]] = [({}, None)]
        self.next: list[dict[str, int]] = [{}]
        self.start = self._state({0: 0}, None)

    def _close(self, nodes: dict[int, int]) -> dict[int, int]:
        """Also the nodes reached by leaving letters of a term out."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            e = nodes[node] + 1
            for to in self.child[node].values():
                if e <= self.slack[to] and e < nodes.get(to, 99):
                    nodes[to] = e
                    todo.append(to)
        return nodes

    def _state(self, nodes: dict[int, int], stem: tuple | None) -> int:
        """stem: (edits, term) of the best stem that the word begins with."""
        nodes = self._close(nodes)
        for node, e in nodes.items():
            for k in self.ends[node]:
                if self.terms[k].endswith("*") and e <= edits_of(self.terms[k]) and (stem is None or (e, k) < stem):
                    stem = (e, k)
        key = (tuple(sorted(nodes.items())), stem)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append((nodes, stem))
            self.next.append({})
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        nodes, stem = self.states[state]
        out: dict[int, int] = {}
        for node, e in nodes.items():
            if e + 1 <= self.slack[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
            for x, to in self.child[node].items():
                cost = e + (x != c)
                if cost <= self.slack[to] and cost < out.get(to, 99):
                    out[to] = cost
        to = self.next[state][c] = self._state(out, stem)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, the first of equals; None if none is near enough."""
        if len(self.states) > self.MOST_STATES:
            self._reset()
        state = self.start
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == 0:
                return None
        nodes, best = self.states[state]
        for node, e in nodes.items():
            for k in self.ends[node]:
                if not self.terms[k].endswith("*") and e <= edits_of(self.terms[k]) and (best is None or (e, k) < best):
                    best = (e, k)
        return best


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    #: Share of toxic texts among those with the term, and among those with one, two and more places of it.
    precision: list[float] = field(default_factory=list)
    by_count: list[list[float]] = field(default_factory=list)
    #: Misspelled forms that clean texts hold.
    ordinary: set[str] = field(default_factory=set)
    base: float = 0.0
    strength: dict[str, float] = field(default_factory=lambda: dict(PRIOR))

    def score(self, found: list[tuple]) -> float:
        """found: (start, end, term, edits, quoted) of a text."""
        kinds: dict[int, list[float]] = {}
        for _, _, k, e, quoted in found:
            kinds.setdefault(k, []).append(kind_strength(self.strength, e, quoted))
        left = 1 - self.base
        for k, own in kinds.items():
            share = self.by_count[k][min(len(own), COUNTS) - 1] if self.by_count else self.precision[k]
            left *= 1 - share * max(own)
        return 1 - left


def kind_strength(strength: dict[str, float], edits: int, quoted: bool) -> float:
    return (strength["quoted"] if quoted else 1.0) * (strength["misspelled"] if edits else 1.0)


class Finder:
    """Finds a model's terms in texts; words seen before are looked up."""

    MOST_WORDS = 500_000

    def __init__(self, model: Model):
        self.model, self.automaton, self.seen = model, Automaton(model.terms), {}

    def word(self, word: str) -> tuple[int, int] | None:
        if word not in self.seen:
            if len(self.seen) >= self.MOST_WORDS:
                self.seen.clear()
            hit = self.automaton.match(word)
            self.seen[word] = None if hit and hit[0] and word in self.model.ordinary else hit
        return self.seen[word]

    def find(self, text: str) -> list[tuple[int, int, int, int, bool]]:
        """(start, end, term, edits, quoted) of every hit, in order."""
        lower = text.lower()
        if len(lower) != len(text):  # a few letters become two; offsets are those of the text
            lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        if not any(self.word(w) for w in set(_WORD.findall(lower))):
            return []
        spans = [m.span() for m in _WORD.finditer(lower)]
        words = [lower[a:b] for a, b in spans]
        return [(*spans[i], hit[1], hit[0], quoted(text, spans, words, i)) for i, w in enumerate(words) if (hit := self.word(w))]


def quoted(text: str, spans: list[tuple[int, int]], words: list[str], i: int) -> bool:
    """Whether the window around a word speaks of it (marks on both sides, or words about wording) more than to somebody."""
    lo, hi = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
    before, after = text[spans[lo][0] : spans[i][0]], text[spans[i][1] : spans[hi][1] + 1]
    marks = any(c in _OPEN for c in before) and any(c in _CLOSE for c in after)
    near = words[lo:i] + words[i + 1 : hi + 1]
    return 2 * marks + any(w in MENTION for w in near) - any(w in ADDRESS for w in near) > 0


def forms(text: str) -> set[str]:
    """The words of a text and the stems of each."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1)}


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic) of at most about ``per_class`` labelled rows of each class, and how many rows each stands for."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(own.groupBy("toxic").count().collect())
    share = {c: min(1.0, per_class / n) for c, n in counts.items()}
    space = 1_000_000_007
    bound = F.create_map(*[F.lit(x) for c, s in share.items() for x in (c, int(space * s))]) if share else F.create_map().cast("map<int,int>")
    chosen = own.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(space)) <= bound[F.col("toxic")]).limit(2 * per_class + per_class // 4)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return materialize(rows, "training"), {c: 1 / s for c, s in share.items()}


def fit(docs: DataFrame, labels: DataFrame, terms: list[str] = (), per_class: int = PER_CLASS, most_forms: int = CANDIDATES, most_terms: int = TERMS) -> Model:
    """A model from labelled rows (doc_id, toxic) of docs (doc_id, text); ``terms`` go into the lexicon as they are."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, weight = training_rows(docs, labels, per_class)
    counts = dict(rows.groupBy("toxic").count().collect())
    if not counts.get(1):
        return Model(list(terms), [OWN] * len(terms))

    def toxic_forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = Counter(f for t in batch.column(0).to_pylist() for f in forms(t))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["form", "n"])

    seen = rows.where("toxic = 1").select("text").mapInArrow(toxic_forms, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    names = [r["form"] for r in seen.orderBy(F.desc("n"), "form").limit(most_forms).collect()]
    at = spark.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def members(some: dict[int, int] | None):
        """doc, toxic and the numbers of the forms (renumbered by ``some``) that each text holds."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for t in batch.column(0).to_pylist():
                    own = [k for f in forms(t) if (k := at.value.get(f)) is not None]
                    out.append(sorted(some[k] for k in own if k in some) if some is not None else sorted(own))
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["toxic", "forms"])

        return rows.select("text", F.col("toxic").cast("int")).mapInArrow(run, "toxic int, forms array<int>")

    clean = np.zeros(len(names), np.int64)
    toxic = np.zeros(len(names), np.int64)
    for r in members(None).select("toxic", F.explode("forms").alias("form")).groupBy("form").agg(F.count_if(F.col("toxic") == 0).alias("c"), F.count_if(F.col("toxic") == 1).alias("t")).collect():
        clean[r["form"]], toxic[r["form"]] = r["c"], r["t"]
    w1, w0 = weight.get(1, 1.0), weight.get(0, 1.0)
    rate = counts[1] * w1 / (counts[1] * w1 + counts.get(0, 0) * w0)
    rate = min(max(rate, 1e-6), 0.5)
    needed = np.log(max(2, len(names))) + EVIDENCE
    good = np.flatnonzero(evidence(toxic * 1.0, clean * w0 / w1, rate) >= needed)
    good = good[np.argsort(-evidence(toxic[good] * 1.0, clean[good] * w0 / w1, rate), kind="stable")][:5000]
    table = members({int(k): i for i, k in enumerate(good)}).collect()
    doc = np.repeat(np.arange(len(table)), [len(r["forms"]) for r in table])
    form = np.array([f for r in table for f in r["forms"]], np.int64)
    label = np.array([r["toxic"] for r in table], np.int64)
    # of forms with equal counts the most specific goes first: a word before a stem, a longer stem before a shorter one
    chosen = cover(doc, form, label, clean[good] * w0 / w1, rate, [len(names[k].rstrip('*')) + 1000 * (names[k][-1] != '*') for k in good], most_terms)
    model = Model([*terms, *(names[good[k]] for k in chosen)])
    extra = [OWN] * len(terms)
    model.precision = [*extra, *(float((toxic[good[k]] * w1 + 0.5) / (toxic[good[k]] * w1 + clean[good[k]] * w0 + 1)) for k in chosen)]
    return calibrated(model, rows, w1, w0)


def evidence(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Log likelihood ratio of a form's share of toxic texts against the rate of all; 0 where the share is no majority."""
    n = np.maximum(toxic + clean, 1e-9)
    p = np.clip(toxic / n, 1e-12, 1 - 1e-12)
    ratio = toxic * np.log(p / rate) + clean * np.log((1 - p) / (1 - rate))
    return np.where(toxic > clean, ratio, 0.0)


def cover(doc: np.ndarray, form: np.ndarray, label: np.ndarray, clean: np.ndarray, rate: float, length: list[int], most: int) -> list[int]:
    """Forms in the order of choice: each has the most evidence in toxic texts that hold none chosen before."""
    open_pairs = label[doc] == 1 if len(doc) else np.zeros(0, bool)
    chosen: list[int] = []
    while len(chosen) < most and open_pairs.any():
        value = evidence(np.bincount(form[open_pairs], minlength=len(clean)).astype(np.float64), clean, rate)
        best = max(range(len(clean)), key=lambda k: (round(float(value[k]), 9), length[k]))
        if value[best] < RESIDUAL:
            break
        chosen.append(best)
        covered = np.zeros(len(label), bool)
        covered[doc[form == best]] = True
        open_pairs &= ~covered[doc]
    return chosen


def calibrated(model: Model, rows: DataFrame, w1: float, w0: float) -> Model:
    """The model with ordinary words, base, and the strength of quoted and misspelled hits, from the training rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def forms_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, c = Finder(shared.value), Counter()
        for batch in batches:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c.update((w, toxic) for w in set(_WORD.findall(t.lower())) if (hit := finder.word(w)) and hit[0])
        if c:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.int32()), pa.array(list(c.values()), pa.int64())], names=["word", "toxic", "n"])

    own = rows.select("text", F.col("toxic").cast("int").alias("toxic"))
    near = own.mapInArrow(forms_near, "word string, toxic int, n long").groupBy("word").agg(F.sum(F.expr("if(toxic = 0, n, 0)")).alias("c"), F.sum(F.expr("if(toxic = 1, n, 0)")).alias("t"))
    model.ordinary = {r["word"] for r in near.where(F.col("c") * w0 >= F.col("t") * w1).collect()}
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                found = finder.find(t)
                out.append("none" if not found else "plain" if any(not e and not q for *_, e, q in found) else "quoted" if any(not e for *_, e, q in found) else "misspelled")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], names=["kind", "toxic"])

    n = {(r["kind"], r["toxic"]): r["count"] for r in own.mapInArrow(kinds, "kind string, toxic int").groupBy("kind", "toxic").count().collect()}

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many texts of each class hold a term so many times as it stands, unquoted."""
        finder, c = Finder(shared.value), Counter()
        for batch in batches:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = Counter(k for _, _, k, e, q in finder.find(t) if not e and not q)
                c.update((k, min(m, COUNTS) - 1, toxic) for k, m in here.items())
        if c:
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in c], pa.int32()) for i in range(3)] + [pa.array(list(c.values()), pa.int64())], names=["term", "times", "toxic", "n"])

    held = {(r["term"], r["times"], r["toxic"]): r["n"] for r in own.mapInArrow(places, "term int, times int, toxic int, n long").groupBy("term", "times", "toxic").agg(F.sum("n").alias("n")).collect()}
    for k, p in enumerate(model.precision):
        pairs = [(held.get((k, m, 1), 0) * w1, held.get((k, m, 0), 0) * w0) for m in range(COUNTS)]
        model.by_count.append([(t + 2 * p) / (t + c + 2) for t, c in pairs])
    for kind in PRIOR:
        t, c = n.get((kind, 1), 0) * w1, n.get((kind, 0), 0) * w0
        model.strength[kind] = (t + PRIOR[kind] * PRIOR_TEXTS) / (t + c + PRIOR_TEXTS)
    t, c = n.get(("none", 1), 0) * w1, n.get(("none", 0), 0) * w0
    model.base = min(0.5, t / (t + c)) if t + c else 0.0
    return model


HIT = "struct<start:int,end:int,term:string,edits:int,quoted:boolean>"


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """rest (all columns but text), hits (in code points) and score of every row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    own = docs.select("text", F.struct(*rest).alias("rest"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        names = shared.value.terms
        for batch in batches:
            hits, scores = [], []
            for text in batch.column(0):
                found = finder.find(text.as_py() or "")
                hits.append([{"start": a, "end": b, "term": names[k], "edits": e, "quoted": q} for a, b, k, e, q in found])
                scores.append(shared.value.score(found))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(hits, kind), pa.array(scores, pa.float64())], names=["rest", "hits", "score"])

    return own.mapInArrow(run, f"rest {own.schema['rest'].dataType.simpleString()}, hits array<{HIT}>, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out()).select("doc_id", "toxic"))
    found = score_rows(docs, model).select("rest.doc_id", "score")
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
