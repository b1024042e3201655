"""N-gram Jaccard join: linked documents and their components.

The document by n-gram incidence matrix is multiplied with its transpose in blocks, and pairs that
cannot reach the threshold by their sizes are never accumulated:

1.  A pass over all texts counts n-gram hashes in a table of fixed size; it only orders n-grams
    from rare to frequent, the same way in every document, so it cannot change the result.
2.  Equal n-gram sets are one node.  A node's n-grams are put in that order, and only the first
    ``n - ceil(t n) + 1`` can be the first n-gram of a linked pair; these are its postings (column
    of the incidence matrix, node, size, position).  Columns with one posting are dropped.
3.  Blocks of candidates are multiplied: a pivot's n-gram set against the sets of its members,
    which gives overlap counts; 100 i >= t |union| makes a link.  Sizes and positions bound the
    overlap beforehand.
4.  Pivot rounds keep large groups linear: each node is multiplied with one pivot of its columns
    (that with most shared postings).  Nodes that the links so far connect need no further product,
    so what remains are columns with nodes of several components; postings that no other
    component's sizes and positions can meet leave, and all remaining pairs are multiplied.

So every link between different components is found or excluded by a bound: the result is exact
up to collisions of 64-bit hashes.  A pivot with many members is copied to several groups of a
bounded number of members.

Defined results: null or empty text has an empty set and links with nothing; rows with one doc_id
are judged one by one and each gives a row; a row without doc_id has no component and links with
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, materialize
from .words import GRAM_MUL, SPACE, give_back, mix, split_words, text_slices

K = 4
PERCENT = 85
SKETCH_BITS = 20
SKETCH_CHUNK = 1 << 14
GROUP = 512
#: Candidate documents up to this number are broadcast to the texts; more are joined by a shuffle.
BROADCAST_IDS = 400_000


def gram_sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of all n-grams; fewer words than k are one n-gram of their own."""
    w = split_words(buf, offsets, SPACE, lower=True)
    at, h = w.grams(k)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        extra = []
        for d in short.tolist():
            g = np.array([w.counts[d]], np.uint64)
            for x in w.hash[w.first[d] : w.first[d + 1]]:
                g = g * GRAM_MUL + x
            extra.append(mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5))[0])
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(extra, np.uint64)])
    return doc, h


def ordered_sets(doc: np.ndarray, h: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each document, documents ascending, n-grams from rare to frequent."""
    key = (level[(h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    o = np.argsort(key)
    o = o[np.argsort(doc[o].astype(np.uint16 if len(doc) and doc.max() < 1 << 16 else np.int64), kind="stable")]
    doc, h = doc[o], h[o]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """A level for each cell of the table of n-gram counts; of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, buf, offsets in text_slices(batch):
                _, h = gram_sets(buf, offsets, k)
                total += np.bincount((h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
        if total.any():
            n = len(total) // SKETCH_CHUNK
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in total.reshape(n, -1)], pa.binary())], names=["chunk", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_CHUNK, np.float64)
        for x in table.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        levels = np.floor(4 * np.log2(1 + total)).astype(np.uint8)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "levels": pa.array([levels.tobytes()], pa.binary())})

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    parts = docs.select("text").mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, levels binary")
    for r in parts.collect():  # 64 rows of 16 KB
        out[r.chunk * SKETCH_CHUNK : (r.chunk + 1) * SKETCH_CHUNK] = np.frombuffer(r.levels, np.uint8)
    return out


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit sums of each document's set; doc is ascending."""
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    one = np.concatenate([[np.uint64(0)], np.cumsum(mix(h + np.uint64(0x2545F4914F6CDD1D)))])
    two = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(0x9FB21C651E98DF25)))])
    return np.diff(first), mix(one[first[1:]] - one[first[:-1]]), two[first[1:]] - two[first[:-1]]


def profiles(docs: DataFrame, levels, k: int, percent: int) -> DataFrame:
    """doc_id, n, node, check and prefix (n-gram hashes in order) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for rows, buf, offsets in text_slices(batch):
                doc, h = ordered_sets(*gram_sets(buf, offsets, k), levels.value)
                n, node, check = signatures(doc, h, len(offsets) - 1)
                first = np.cumsum(n) - n
                length = n - -(-percent * n // 100) + 1
                prefix = [h[a : a + x].tobytes() if m else b"" for a, x, m in zip(first.tolist(), length.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids[rows.start : rows.stop], pa.array(n), pa.array(node.view(np.int64)), pa.array(check.view(np.int64)), pa.array(prefix, pa.binary())],
                    names=["doc_id", "n", "node", "check", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, check long, prefix binary")


def explode_prefix(nodes: DataFrame) -> DataFrame:
    """Postings (h, node, n, pos) of nodes (node, n, prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                blobs = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
                sizes = np.array([len(b) for b in blobs])
                if not sizes.sum():
                    continue
                pos = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own = [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(blobs)), own[0], own[1].cast(pa.int32()), pa.array(pos.astype(np.int32))], names=["h", "node", "n", "pos"])

    return nodes.select("node", "n", "prefix").mapInArrow(run, "h long, node long, n int, pos int")


def can_link(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Whether sizes, and positions of the first common n-gram, allow the threshold."""
    most = F.least(n1 - p1, n2 - p2)
    return ((100 + percent) * most >= percent * (n1 + n2)) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))


def multiply(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, levels, k: int, percent: int) -> DataFrame:
    """The pairs (pivot, member) with ``linked``: overlap counts of the whole sets.

    nodes has the document (rep) that stands for a node.  Members of a pivot are dealt to groups of
    about ``GROUP``, each with a copy of the pivot's set.
    """
    pairs = pairs.select("pivot", "member")
    groups = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    members = pairs.join(groups, "pivot").select(F.col("member").alias("node"), F.struct("pivot", F.pmod(F.hash("member"), "groups").alias("part"), F.lit(1).alias("role")).alias("to"))
    pivots = groups.select(F.col("pivot").alias("node"), F.explode(F.transform(F.sequence(F.lit(0), F.col("groups") - 1), lambda s: F.struct(F.col("pivot"), s.alias("part"), F.lit(0).alias("role")))).alias("to"))
    wanted = members.union(pivots).groupBy("node").agg(F.collect_set("to").alias("to"))
    wanted = materialize(wanted.join(nodes.select("node", F.col("rep").alias("doc_id")), "node"), "wanted")
    if wanted.count() <= BROADCAST_IDS and not wanted.where(F.size("to") > 1000).limit(1).count():
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.get_field_index("node"), batch.schema.get_field_index("to")
            for rows, buf, offsets in text_slices(batch):
                doc, h = ordered_sets(*gram_sets(buf, offsets, k), levels.value)
                n, node, _ = signatures(doc, h, len(offsets) - 1)
                first = np.cumsum(n) - n
                part = batch.slice(rows.start, rows.stop - rows.start)
                out, held = [], 0
                for d, (want, to) in enumerate(zip(part.column(names[0]).to_pylist(), part.column(names[1]).to_pylist())):
                    if want != int(node[d : d + 1].view(np.int64)[0]):
                        continue  # another row with this doc_id
                    blob = np.sort(h[first[d] : first[d] + n[d]]).tobytes()
                    for x in to:
                        out.append({"pivot": x["pivot"], "part": x["part"], "role": x["role"], "node": want, "grams": blob})
                        held += len(blob)
                        if held > 2 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=SETS)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=SETS)

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = np.empty(0, np.uint64), None
        for batch in batches:
            give_back()
            out = []
            for pivot, part, role, node, grams in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                h = np.frombuffer(grams.as_buffer(), np.uint64)
                if role == 0:
                    own, of = h, (pivot, part)
                    continue
                if of != (pivot, part):
                    raise ValueError("a group without its pivot: the documents changed while they were read")
                i = int((own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h).sum())
                out.append((pivot, node, (100 + percent) * i >= percent * (len(h) + len(own))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["pivot", "member", "linked"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
    dealt = texts.mapInArrow(sets, "pivot long, part int, role int, node long, grams binary").repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role", "node")
    return dealt.mapInArrow(overlap, "pivot long, member long, linked boolean")


SETS = pa.schema([("pivot", pa.int64()), ("part", pa.int32()), ("role", pa.int32()), ("node", pa.int64()), ("grams", pa.binary())])


def open_postings(postings: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Postings of columns with several components, without those that no other posting can meet."""
    p = postings.drop("comp").join(labels.select("node", F.col("label").alias("comp")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    for _ in range(2):
        column = p.groupBy("h").agg(F.min("n").alias("least"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").drop("c0", "c1")
        p = p.join(column, "h").where((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + F.greatest("least", F.ceil(percent * F.col("n") / 100)))).drop("least")
    return p


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT, pivot_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    levels = spark.sparkContext.broadcast(frequency_levels(docs, k))
    rows = materialize(profiles(docs, levels, k, percent), "profiles")
    full = rows.where("n > 0 and doc_id is not null")
    nodes = materialize(full.groupBy("node", "check", "n").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix")), "nodes")
    shared = explode_prefix(nodes).withColumn("m", F.expr("count(1) over (partition by h)")).where("m > 1")
    postings = materialize(shared, "postings")
    degree = postings.groupBy("node").agg(F.sum("m").alias("degree"))
    postings = materialize(postings.drop("m").join(degree, "node").withColumn("comp", F.col("node")), "postings")
    names, tested = nodes.select("node", "rep"), None
    labels = spark.createDataFrame([], "node long, label long")
    for turn in range(pivot_rounds + 1):
        if not postings.limit(1).count():
            break
        if turn < pivot_rounds:
            best = postings.groupBy("h").agg(F.max(F.struct("degree", "node", "n", "pos", "comp")).alias("p"))
            p = postings.join(best, "h").where("node <> p.node and comp <> p.comp").where(can_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"), percent))
            pairs = p.groupBy(F.col("node").alias("member")).agg(F.max(F.struct("p.degree", "p.node")).alias("p")).select(F.col("p.node").alias("pivot"), "member")
        else:
            a, b = postings.alias("a"), postings.alias("b")
            above = F.expr("a.comp <> b.comp and (a.degree > b.degree or (a.degree = b.degree and a.node > b.node))")
            p = a.join(b, (F.col("a.h") == F.col("b.h")) & above & can_link(F.col("a.n"), F.col("a.pos"), F.col("b.n"), F.col("b.pos"), percent))
            pairs = p.select(F.col("a.node").alias("pivot"), F.col("b.node").alias("member")).distinct()
        if tested is not None:
            known = tested.select("pivot", "member").union(tested.select("member", "pivot"))
            pairs = pairs.join(known, ["pivot", "member"], "left_anti")
        pairs = materialize(pairs, "pairs")
        done = materialize(multiply(docs, names, pairs, levels, k, percent), "products")
        tested = done if tested is None else tested.union(done)
        labels = components(tested.where("linked").select(F.col("pivot").alias("a"), F.col("member").alias("b")))
        if turn < pivot_rounds:
            postings = materialize(open_postings(postings, labels, percent), "postings")
    joined = nodes.select("node", "check", "n", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "label").select("node", "check", F.col("n").alias("__n"), "component_id")
    linked = full.select("doc_id", "n", "node", "check").join(named, ["node", "check"]).where("n = __n").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(k: int = K, percent: int = PERCENT) -> str:
    """DuckDB SQL of the same components."""
    return f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS MATERIALIZED (
  SELECT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) END) AS g FROM words)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY ALL),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * i >= {percent} * (x.n + y.n - i)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) USING (doc_id)"""


def brute_force(rows: list[tuple[int | None, str | None]], k: int = K, percent: int = PERCENT) -> list[tuple]:
    """Plain reference for tests."""
    import re

    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)]
