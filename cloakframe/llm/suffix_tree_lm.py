"""LM scoring with a probabilistic suffix tree.

Texts are tokens: lower-cased words and one end.  A context is a run of at most ``max_words`` words
before a token (the oldest may be the text's start).  A context that ``min_count`` training tokens (one number for single
words, one for longer contexts) follow is a candidate whatever the size of the corpus; it becomes a state if its distribution of next
words diverges enough from its parent's (the context less its oldest word), which is that of the
longest suffix that is a state.  Distributions are smoothed with their parent's, by as many
observations as the context has different next words, down to the base distribution of single words;
scoring follows the longest suffix that is a state.  A context that one word always follows is not
extended: what is longer has the same next word.

The corpus is kept as slices: runs of whole documents as numbers of their own sorted word hashes,
cut where the input is read, so texts are not shuffled.  In pass 0 every slice sends its distinct
words to hash buckets, which add up their counts and send back those of the slice's words.  In each
further pass (contexts one word longer) it sends its distinct pairs of context and next word, for
contexts that may be states; the bucket of a context adds them up, tests it, and sends back the
counts and the weight of smoothing.  A slice's walk is done anew in each pass, so no state of it is
stored.  The number of buckets follows the input, so a bucket's size does
not.  A context seen more than ``spread`` times is dealt over several buckets by its next word; each
adds up its part of the test and of the next words, the parts are added to one result for the
context, and that is joined to the slices that hold it.  Test and smoothing are those of all other
contexts, so ``spread`` moves work and no result.

Counts are exact up to collisions of 64-bit hashes of words, and of 32 bits within a bucket for
contexts and for the words after one context.

Defined results: null or empty text is one end token; a row without doc_id is scored but never
learned from, and its held_out is null; rows with one doc_id are learned and scored one by one; with
nothing to learn from, every token has probability 1; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize
from .slices import NO_ID, bucket_of, bucketed, from_planes, ids_array, packed_rows, slice_rows, table_buckets, to_planes, total_bytes
from .words import GRAM_MUL, SPACE, give_back, mix, split_words, text_runs

MAX_WORDS = 3
#: Training tokens that must follow a context of one word, and a longer one.
MIN_COUNT = (2, 5)
#: A context is a state if N * KL(own, parent's) is at least this, for each next word seen.
DIVERGENCE = 1.0
#: Divergences are added as integers of this part of one, so their sums don't depend on the order.
GAIN_PARTS = 1 << 16
#: Training tokens after a context from which its next words are spread over buckets.
SPREAD = 1 << 19
SLICE_BYTES = 2 << 20
RUN_BYTES = 1 << 18
BUCKET_TEXT = 8 << 20
START_HASH, END_HASH = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
LOW32 = np.uint64((1 << 32) - 1)

SLICES = "slice long, doc_ids binary, counts binary, words binary, tokens binary"
WORDS = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
PAIRS = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("nexts", pa.binary()), ("counts", pa.binary()), ("parents", pa.binary()), ("contexts", pa.binary()), ("runs", pa.binary()), ("totals", pa.binary())])
ANSWER = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("weights", pa.binary()), ("a", pa.int64()), ("b", pa.int64()), ("wide", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64()))])
ANSWER_SQL = "slice long, bucket long, counts binary, weights binary, a long, b long, wide array<long>, parts array<long>"
#: In place of a slice's number: a bucket's sums; its parts of the contexts that are spread (``wide``: their keys).
SUMS, PARTS = -1, -2
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


def learned(ids: np.ndarray) -> np.ndarray:
    return np.array([i != NO_ID and not held_out(i) for i in ids.tolist()], bool)


def parent_code(p: np.ndarray) -> np.ndarray:
    """A parent's probability in one byte, in eighths of a power of two: enough to test a context."""
    return np.clip(np.rint(-8 * np.log2(p)), 0, 255).astype(np.uint8)


def code_log(code: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability that ``parent_code`` stands for."""
    return code * (-np.log(2) / 8)


def wide_key(context: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A spread context in all buckets: 32 bits of its hash and its count."""
    return ((total.astype(np.uint64) << np.uint64(32)) | (context.astype(np.uint64) & LOW32)).view(np.int64)


def sorted_places(number: np.ndarray, token: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ``at`` in order of their pairs (number, token of at most ``bits`` bits), and the codes of these pairs."""
    code = (number.astype(np.int64) << bits) | token
    if not len(at):
        return at, code
    low = int(at.max()).bit_length()
    if int(code.max()).bit_length() + low <= 63:
        code <<= low
        code |= at
        code.sort()
        return code & ((1 << low) - 1), code >> low
    order = np.argsort(code, kind="stable")
    return at[order], code[order]


def heads(code: np.ndarray) -> np.ndarray:
    """The first place of each run of equal numbers."""
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)


def sizes(head: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(head, n))


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the keys, the first place in it of each distinct key, and how often that occurs."""
    order = np.argsort(key)
    head = heads(key[order])
    return order, head, sizes(head, len(key))


def put_back(order: np.ndarray, values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each distinct key's value at all its places."""
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, size)
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The integers in the fewest bytes that hold them all; who reads them knows their number."""
    if x.dtype.kind == "u":
        return x.astype(np.min_scalar_type(x.max()) if len(x) else np.uint8)
    return x.astype(np.min_scalar_type(-1 - int(np.abs(x).max())) if len(x) else np.int8)


def widened(raws: list, numbers: list[int], kind: str) -> np.ndarray:
    """Narrow integers, so many in each of ``raws``; kind: u or i."""
    if len(raws) != len(numbers):
        raise ValueError("answers that do not fit the slice's contexts")
    return np.concatenate([np.empty(0, kind + "1"), *(from_planes(x, f"{kind}{len(x) // k}") for x, k in zip(raws, numbers))])


def build_slices(docs: DataFrame, tables: int, slice_bytes: int) -> DataFrame:
    """The documents as numbered words: slice, doc_ids, words of each, word hashes, tokens (the last number is the end)."""
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, runs = TaskContext.get().partitionId() << 32, 0, []

        def full() -> pa.RecordBatch:
            ids, counts, hashes = (np.concatenate(x) for x in zip(*runs))
            runs.clear()
            order, head, size = groups(hashes)
            tokens = np.insert(put_back(order, np.arange(len(head), dtype=np.uint32), size), np.cumsum(counts), len(head))
            columns = [ids, counts.astype(np.int32), hashes[order[head]], narrow(tokens)]
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([to_planes(c)], pa.binary()) for c in columns)], names=["slice", "doc_ids", "counts", "words", "tokens"])

        # words are split and hashed in runs that fit into a processor's cache
        for ids, text, offsets in text_runs(batches, min(slice_bytes, RUN_BYTES), trim=False):
            w = split_words(text, offsets, SPACE, lower=True)
            runs.append((ids.to_numpy(zero_copy_only=False), w.counts, w.hash))
            held += len(text)
            if held >= slice_bytes:
                yield full()
                number, held = number + 1, 0
        if runs:
            yield full()
        give_back()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    return bucketed(rows.mapInArrow(cut, SLICES), tables)


class Walk:
    """The contexts of a slice's tokens, one word longer with each step.

    A step works on groups: the tokens with one context before them and one next word.  They share
    counts and probabilities.  Contexts are numbered in the order of their buckets.
    """

    def __init__(self, row: dict, least: tuple[int, int], spread: int, buckets: int):
        self.ids = from_planes(row["doc_ids"], np.int64)
        self.counts = from_planes(row["counts"], np.int32).astype(np.int64)
        self.words = from_planes(row["words"], np.uint64)
        n = int(self.counts.sum()) + len(self.counts)
        self.tokens = from_planes(row["tokens"], f"u{len(row['tokens']) // n}").astype(np.int32)
        self.first = np.cumsum(self.counts + 1) - self.counts - 1
        self.least, self.spread, self.buckets = least, spread, buckets

    def use(self) -> np.ndarray:
        """The tokens that are learned from."""
        return np.repeat(learned(self.ids), self.counts + 1)

    def begin(self, count: np.ndarray, texts: int) -> None:
        """count: of each of the slice's words in the corpus; texts: the number of starts."""
        n = len(self.tokens)
        self.is_first = np.zeros(n + 1, bool)
        self.is_first[self.first] = self.is_first[n] = True
        #: 1: a context with a single next word, seen too rarely to go on; 2: one that goes on.
        self.single = np.zeros(n, np.uint8)
        # of each token's number: the last one is the end, or the start as a context
        self.hash, self.seen, self.length = np.append(self.words, START_HASH), np.append(count, texts), 0

    def grow(self) -> None:
        """Contexts one word longer: what stands before a token is the previous token with its context.

        Only tokens after a pair that was seen often enough go on: their number falls with each step.
        """
        least = self.least[min(self.length, len(self.least) - 1)]
        chosen = np.flatnonzero(self.seen >= least)
        gram = self.hash[chosen] if self.length == 0 else mix(self.gram[self.number[chosen]] * GRAM_MUL + self.hash[self.token[chosen]])
        place = mix(gram)
        order = np.argsort(place)
        gram, place, chosen = gram[order], place[order], chosen[order]
        total = self.seen[chosen]
        rank = np.full(len(self.seen), -1, np.int32)
        rank[chosen] = np.arange(len(chosen))
        if self.length == 0:
            number = rank[self.tokens[:-1]]
            at = np.flatnonzero((number >= 0) & ~self.is_first[1:-1]) + 1
            number = number[at - 1]
            if rank[-1] >= 0:
                at, number = np.concatenate([self.first, at]), np.concatenate([np.full(len(self.first), rank[-1]), number])
        else:
            number = np.repeat(rank, self.size)
            at = self.at + 1
            own = np.flatnonzero((number >= 0) & ~self.is_first[at])
            at, number = at[own], number[own]
        self.length += 1
        self.hash[-1] = END_HASH
        bits = len(self.words).bit_length()
        self.at, code = sorted_places(number, self.tokens[at], at, bits)
        head = heads(code)
        self.head, self.size, code = head, sizes(head, len(code)), code[head]
        self.number, self.token, self.gram = code >> bits, code & ((1 << bits) - 1), gram
        self.total = total[self.number]
        self.lead = self.at[head]
        # after a context with a single next word, so have all that are longer
        single = self.single[self.lead]
        self.known = single > 0
        self.seen = np.where(single == 2, self.total, 0)
        # entries: pairs whose context may be a state, by bucket and context
        self.own = np.flatnonzero(~self.known)
        number = self.number[self.own]
        run = heads(number)
        context, total = gram[number[run]], self.total[self.own[run]]
        bucket = bucket_of(place[number[run]], self.buckets)
        if (total > self.spread).any():
            of = np.repeat(np.arange(len(run)), sizes(run, len(number)))
            wide = np.flatnonzero(total[of] > self.spread)
            parts = np.ceil(total[of[wide]] / self.spread).astype(np.uint64)
            salt = self.hash[self.token[self.own[wide]]] % parts
            bucket = bucket[of]
            bucket[wide] = bucket_of(mix(context[of[wide]] + salt * GRAM_MUL), self.buckets)
            by, code = sorted_places(bucket, of, np.arange(len(of)), len(run).bit_length())
            run = heads(code)
            self.own, bucket, of = self.own[by], bucket[by[run]], of[by[run]]
            context, total = context[of], total[of]
        self.run, self.run_size, self.bucket, self.context, self.run_total = run, sizes(run, len(self.own)), bucket, context, total

    def pairs(self, number: int, p: np.ndarray) -> pa.RecordBatch:
        """The entries with their counts in the slice and the parent's probability."""
        counts = np.add.reduceat(self.use()[self.at].astype(np.uint32), self.head)[self.own]
        columns = [self.hash[self.token[self.own]].astype(np.uint32), narrow(counts), parent_code(p[self.lead[self.own]])]
        by_context = [self.context.astype(np.uint32), narrow(self.run_size.astype(np.uint64)), narrow(self.run_total.astype(np.uint64))]
        return packed_rows(PAIRS, number, np.repeat(self.bucket, self.run_size), columns, self.bucket, by_context, planes=(1, 4, 5))

    def take(self, answers: list, spread: list, p: np.ndarray) -> None:
        """Counts and weights of the step's contexts; probabilities go on in those that are states.

        spread: (key, weight) of the slice's contexts that are spread over buckets.
        """
        cut = heads(self.bucket)
        runs, entries = sizes(cut, len(self.run)), sizes(self.run[cut], len(self.own))
        counts = widened([x["counts"] for x in answers], entries.tolist(), "u")
        weight = widened([x["weights"] for x in answers], runs.tolist(), "i").astype(np.int32)
        if len(counts) != len(self.own) or len(weight) != len(self.run):
            raise ValueError("answers that do not fit the slice's contexts")
        if spread:
            # a part's own weight counts only its next words
            whole = dict((x["wide"], x["weight"]) for x in spread)
            wide = np.flatnonzero(self.run_total > self.spread)
            keys = wide_key(self.context[wide], self.run_total[wide]).tolist()
            weight[wide] = [whole.get(k, w) for k, w in zip(keys, weight[wide].tolist())]
        weight = np.repeat(weight, self.run_size)
        self.seen[self.own] = counts
        self.known[self.own] = np.abs(weight) <= 1
        np.minimum(self.single, 1, out=self.single)
        self.single[self.at] = np.repeat(np.where(self.known, np.where(self.seen > 0, 2, 1), 0).astype(np.uint8), self.size)
        state = np.flatnonzero(weight > 0)
        kept, weight = self.own[state], weight[state].astype(np.float64)
        own = p[self.lead]
        own[kept] = (self.seen[kept] + weight * own[kept]) / (self.total[kept] + weight)
        p[self.at] = np.repeat(own, self.size)


def send_words(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for row in slice_rows(batches, trim=False):
        walk = Walk(row, (1,), 1, buckets)
        counts = np.bincount(walk.tokens[walk.use()], minlength=len(walk.words) + 1)[:-1].astype(np.uint32)
        if len(counts):
            yield packed_rows(WORDS, row["slice"], bucket_of(walk.words, buckets), [walk.words, narrow(counts)], planes=(1,))


def _column(table: pa.Table, name: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]


def _narrow(table: pa.Table, name: str, beside: list[np.ndarray]) -> np.ndarray:
    """Narrow integers, one for each number of ``beside``."""
    return widened([x.as_buffer() for x in table.column(name)], [len(x) for x in beside], "u")


def _answers(table: pa.Table, entries: list[int], counts: np.ndarray, runs: list[int], weights: np.ndarray, a: int, b: int, wide: np.ndarray | None = None, parts: tuple | None = None) -> pa.Table:
    """Each slice's own counts and weights, and a row with the bucket's sums.

    wide: of each run the key if its context is spread, else 0; parts: keys of the bucket's spread
    contexts with their divergences and numbers of next words.
    """
    bucket = table.column("bucket")[0].as_py()
    cut, split = np.cumsum([0, *entries]).tolist(), np.cumsum([0, *runs]).tolist()
    rows = [(s, bucket, to_planes(narrow(counts[cut[k] : cut[k + 1]])), to_planes(narrow(weights[split[k] : split[k + 1]])), None, None, _some(wide, split[k], split[k + 1]), None) for k, s in enumerate(table.column("slice").to_pylist())]
    rows.append((SUMS, bucket, None, None, a, b, None, None))
    if parts is not None and len(parts[0]):
        keys, gain, number = parts
        rows.append((PARTS, bucket, None, None, None, None, keys.tolist(), np.column_stack([gain, number]).reshape(-1).tolist()))
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), ANSWER)], schema=ANSWER)


def _some(wide: np.ndarray | None, start: int, end: int) -> list[int] | None:
    return (wide[start:end][wide[start:end] != 0].tolist() or None) if wide is not None else None


def add_words(table: pa.Table) -> pa.Table:
    """Corpus counts of the bucket's words; sums: distinct words and tokens of the training texts."""
    parts = _column(table, "keys", np.uint64)
    order, head, size = groups(np.concatenate(parts))
    sums = np.add.reduceat(_narrow(table, "counts", parts)[order].astype(np.uint64), head)
    none = np.empty(0, np.int32)
    return _answers(table, [len(x) for x in parts], put_back(order, sums, size), [0] * len(parts), none, int((sums > 0).sum()), int(sums.sum()))


def add_pairs(table: pa.Table, spread: int = SPREAD) -> pa.Table:
    """Corpus counts of the bucket's pairs, and for each context its number of next words, negative if it is no state.

    Contexts seen more than ``spread`` times have only a part of their next words here.
    """
    nexts, by_context = _column(table, "nexts", np.uint32), _column(table, "contexts", np.uint32)
    lengths = _narrow(table, "runs", by_context).astype(np.int64)
    contexts, totals = np.concatenate(by_context), _narrow(table, "totals", by_context).astype(np.uint64)
    key = np.repeat(contexts.astype(np.uint64) << np.uint64(32), lengths)
    key |= np.concatenate(nexts)
    order, first, size = groups(key)
    sums = np.add.reduceat(_narrow(table, "counts", nexts)[order].astype(np.uint64), first)
    at = order[first]
    keys, seen = key[at], sums.astype(np.float64)
    total = np.repeat(totals, lengths)[at].astype(np.float64)
    parent = code_log(np.concatenate(_column(table, "parents", np.uint8))[at])
    gain = np.rint(np.where(sums > 0, seen * (np.log(np.maximum(seen, 1) / total) - parent), 0.0) * GAIN_PARTS).astype(np.int64)
    own = keys >> np.uint64(32)
    head = heads(own)
    number = np.add.reduceat((sums > 0).astype(np.int64), head)
    gain = np.add.reduceat(gain, head)
    state = is_state(gain, number)
    weight = np.where(state, number, -number).astype(np.int32)
    wide, parts = None, None
    if (totals > spread).any():
        wide = np.where(totals > spread, wide_key(contexts, totals), 0)
        most = np.maximum.reduceat(total, head)
        part = np.flatnonzero(most > spread)
        parts = wide_key(own[head[part]], most[part]), gain[part], number[part]
    weights = weight[np.searchsorted(own[head], contexts)]
    return _answers(table, [len(x) for x in nexts], put_back(order, sums, size), [len(x) for x in by_context], weights, int(state.sum()), int(sums.sum()), wide, parts)


def is_state(gain: np.ndarray, number: np.ndarray) -> np.ndarray:
    """gain: in units of 1 / ``GAIN_PARTS``; number: of next words."""
    return gain >= round(DIVERGENCE * GAIN_PARTS) * np.maximum(number, 1)


def whole_weights(got: DataFrame) -> DataFrame:
    """slice and its spread contexts (wide, weight): the parts of all buckets added up, then joined to the slices."""
    parts = got.where(F.col("slice") == PARTS).select(F.posexplode("wide").alias("k", "wide"), "parts")
    parts = parts.select("wide", F.element_at("parts", 2 * F.col("k") + 1).alias("gain"), F.element_at("parts", 2 * F.col("k") + 2).alias("number"))
    sums = parts.groupBy("wide").agg(F.sum("gain").alias("gain"), F.sum("number").alias("number"))
    state = F.col("gain") >= round(DIVERGENCE * GAIN_PARTS) * F.greatest("number", F.lit(1))
    weights = sums.select("wide", F.when(state, F.col("number")).otherwise(-F.col("number")).cast("int").alias("weight"))
    held = got.where(F.col("slice") >= 0).select("slice", F.explode("wide").alias("wide")).distinct()
    return held.join(weights, "wide").groupBy("slice").agg(F.collect_list(F.struct("wide", "weight")).alias("spread"))


def score(docs: DataFrame, max_words: int = MAX_WORDS, min_count: tuple[int, int] = MIN_COUNT, spread: int = SPREAD, slice_bytes: int = SLICE_BYTES, bucket_text: int = BUCKET_TEXT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    size = total_bytes(docs)
    buckets = max(16, -(-size // bucket_text))
    tables = table_buckets(docs.sparkSession, size)
    slices = build_slices(docs, tables, slice_bytes)
    got = materialize(slices.mapInArrow(lambda x: send_words(x, buckets), "bucket long, slice long, keys binary, counts binary").groupBy("bucket").applyInArrow(add_words, ANSWER_SQL), "words")
    sums = got.where(F.col("slice") == SUMS).agg(F.sum("a").alias("v"), F.sum("b").alias("n")).first()
    ends = docs.where("doc_id is not null").where(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 != 1).count()
    v, n = (sums["v"] or 0) + (ends > 0), (sums["n"] or 0) + ends
    answers = []

    def keep(got: DataFrame) -> bool:
        """The answers of a pass by slice, bucketed as the slices are: they move once.  False if there are none."""
        last = got.where(F.col("slice") < 0).agg(F.min("slice").alias("kind")).first()["kind"]
        own = got.where(F.col("slice") >= 0).repartition(tables, "slice").groupBy("slice").agg(F.collect_list(F.struct("bucket", "counts", "weights")).alias(f"level{len(answers)}"))
        if last == PARTS:
            own = own.join(whole_weights(got), "slice", "left")
        else:
            own = own.withColumn("spread", F.lit(None).cast("array<struct<wide:long,weight:int>>"))
        answers.append(bucketed(own.withColumnRenamed("spread", f"spread{len(answers)}"), tables))
        return last is not None

    def with_answers() -> DataFrame:
        out = slices
        for x in answers:
            out = out.join(x.hint("shuffle_hash"), "slice", "left")
        return out

    def walked(row: dict, levels: int) -> tuple[Walk, np.ndarray, np.ndarray, np.ndarray]:
        """The slice's walk after so many passes; count and base probability of each word, own probability of each token."""
        walk = Walk(row, min_count, spread, buckets)
        by_level = [sorted(row[f"level{k}"] or (), key=lambda x: x["bucket"]) for k in range(levels + 1)]
        sent = sizes(heads(bucket_of(walk.words, buckets)), len(walk.words))
        count = widened([x["counts"] for x in by_level[0]], sent.tolist(), "u").astype(np.float64)
        walk.begin(count, ends)
        count = np.append(count, ends)
        base = (count + 0.5) / (n + 0.5 * (v + 1))
        p = base[walk.tokens]
        for k, level in enumerate(by_level[1:], 1):
            walk.grow()
            walk.take(level, row[f"spread{k}"] or [], p)
        return walk, count, base, p

    def sender(levels: int):
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in slice_rows(batches, trim=False):
                walk, _, _, p = walked(row, levels)
                walk.grow()
                if len(walk.own):
                    yield walk.pairs(row["slice"], p)

        return send

    def run(batches: Iterator[pa.RecordBatch], passes: int) -> Iterator[pa.RecordBatch]:
        for row in slice_rows(batches, trim=False):
            walk, count, base, p = walked(row, passes)
            sums = np.add.reduceat(np.column_stack([np.log10(base)[walk.tokens], np.log10(p), (count > 0)[walk.tokens]]), walk.first, axis=0)
            held = pa.array([None if i == NO_ID else held_out(i) for i in walk.ids.tolist()], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [ids_array(walk.ids), held, pa.array(walk.counts + 1), pa.array(sums[:, 2].astype(np.int64)), pa.array(np.full(len(walk.ids), n, np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    keep(got)
    for level in range(1, max_words + 1):
        sent = with_answers().mapInArrow(sender(level - 1), "bucket long, slice long, nexts binary, counts binary, parents binary, contexts binary, runs binary, totals binary")
        got = materialize(sent.groupBy("bucket").applyInArrow(lambda x: add_pairs(x, spread), ANSWER_SQL), "contexts")
        # a context that is no state may have longer ones that are
        if not keep(got):
            break
    passes = len(answers) - 1
    return with_answers().mapInArrow(lambda x: run(x, passes), RESULT)


def op4_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int | None, str | None]], max_words: int = MAX_WORDS, min_count: tuple[int, int] = MIN_COUNT, spread: int = SPREAD) -> list[tuple]:
    """Plain reference for tests; ``spread`` has no part in the results."""
    import math
    import re
    from collections import Counter, defaultdict

    def tokens(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), ""]

    texts = [(i, tokens(t)) for i, t in rows]
    train = [t for i, t in texts if i is not None and not held_out(i)]
    words = Counter(x for t in train for x in t)
    n, v = sum(words.values()), len(words)
    after: dict[tuple, Counter] = defaultdict(Counter)
    for t in train:
        line = [None, *t]
        for k in range(1, len(line)):
            for m in range(1, min(max_words, k) + 1):
                after[tuple(line[k - m : k])][line[k]] += 1
    memo: dict[tuple, tuple | None] = {}

    def prob(context: tuple, word: str) -> float:
        if not context:
            return (words[word] + 0.5) / (n + 0.5 * (v + 1))
        own = state(context)
        if own is None:
            return prob(context[1:], word)
        total, weight = own
        return (after[context][word] + weight * prob(context[1:], word)) / (total + weight)

    def state(context: tuple) -> tuple | None:
        if context not in memo:
            nexts = after.get(context, Counter())
            total = sum(nexts.values())
            shorter = context[1:]
            extended = all(len(after[shorter[k:]]) > 1 for k in range(len(shorter)))
            memo[context] = None
            if total >= min_count[len(context) > 1] and extended and (not shorter or sum(after[shorter].values()) >= min_count[len(shorter) > 1]):
                codes = {x: float(code_log(parent_code(np.array([prob(shorter, x)])))[0]) for x in nexts}
                gain = sum(round(c * (math.log(c / total) - codes[x]) * GAIN_PARTS) for x, c in nexts.items())
                if gain >= DIVERGENCE * GAIN_PARTS * len(nexts):
                    memo[context] = (total, len(nexts))
        return memo[context]

    out = []
    for i, t in texts:
        line = [None, *t]
        base = sum(math.log10(prob((), x)) for x in t) if n else 0.0
        own = sum(math.log10(prob(tuple(line[max(0, k - max_words) : k]), line[k])) for k in range(1, len(line))) if n else 0.0
        out.append((i, None if i is None else held_out(i), len(t), sum(words[x] > 0 for x in t), n, base, own))
    return out
