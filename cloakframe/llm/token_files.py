"""Token-ID files: equal-length sequences and masks in Arrow IPC files.

Documents are range-partitioned by doc_id, so the partitions in order are the corpus in order.
Each partition tokenises its documents and writes one shard: an Arrow IPC file whose batches hold
``input_ids`` (fixed-size list) and ``mask`` (fixed-size list of bits), both uncompressed, so that
a reader maps the file and takes sequence i as a view.  All batches but the last hold
``BATCH_SEQUENCES`` sequences, so sequence i is found without a walk.  Ids take 16 bits where the
vocabulary allows and 32 bits elsewhere.  The last sequence of a shard is padded and masked.  A
second Arrow file lists the shard's documents.  A task that is run again writes files of another
name, and the manifest, committed by Spark's Parquet writer, lists the files of the attempt that
counted.

A tokenizer whose normaliser and pre-tokenizer are the known ones (``NORMALIZER``,
``PRE_TOKENIZER``) drops white space and never joins an ASCII letter with another kind of ASCII
character.  So the distinct words of a run of documents are cut into such pieces, each distinct
piece is encoded once, and its ids are copied to where it stands; a worker keeps the ids of short
pieces for its later runs.  With any other tokenizer whole texts are encoded.

Defined results: null text is empty and gives the end id alone; rows are ordered by doc_id, a null
doc_id first, equal doc_ids by a hash of their text; an empty table gives no shards and no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bounded_batches, partitions_for, shared_dir
from .words import LOWER, SPACE, give_back, ragged, span_hashes, split_words, text_runs

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
SEQ_LEN = 2048
BATCH_SEQUENCES = 256
#: Text that is encoded at once, and the pieces that a worker keeps (of at most PIECE_BYTES; both affect cost only).
RUN_BYTES = 512 << 10
CACHE_PIECES = 300_000
PIECE_BYTES = 64
MANIFEST = "shard long, tokens string, index string, n_ids long, n_docs long"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


# Fixed values of the tokenizer's file: white space is dropped, letters, single digits and other characters are apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
WORD_END = "</w>"
#: Letters of Latin script, each a letter in every version of Unicode: a run of them is one word of the tokenizer.
LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
LETTER, DIGIT, OTHER = 1, 2, 3
#: Kinds of ASCII bytes once A-Z is lower-cased; 0 for white space and for bytes of other characters.
KIND = np.where(SPACE, 0, OTHER).astype(np.uint8)
KIND[0x61:0x7B], KIND[0x30:0x3A], KIND[0x80:] = LETTER, DIGIT, 0


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process, so that its pieces serve the tasks that follow."""
    return Encoder(path)


class Encoder:
    """Encodes runs of documents; equal to encoding each whole text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        # without offsets where the library has that
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.by_pieces = (
            (spec["normalizer"], spec["pre_tokenizer"], spec["model"].get("end_of_word_suffix"), spec["model"].get("dropout")) == (NORMALIZER, PRE_TOKENIZER, WORD_END, None)
            and all(t["content"].startswith("<|") and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        )
        if self.by_pieces:
            # the same model for pieces that are normalised already, joined by blanks
            plain = Tokenizer.from_file(path)
            plain.normalizer = normalizers.Sequence([])
            plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.plain = getattr(plain, "encode_batch_fast", plain.encode_batch)
            self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
            self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(WORD_END)]] = True
        self.keys, self.begins, self.sizes, self.flat = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.dtype)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the run in order, and the number of each document (end id included)."""
        return self._by_pieces(buf, offsets, end_id) if self.by_pieces else self._whole(buf, offsets, end_id)

    def _whole(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        raw, bounds = buf.tobytes(), offsets.tolist()
        parts = [np.array([*e.ids, end_id], self.dtype) for e in self.batch([raw[a:b].decode() for a, b in zip(bounds, bounds[1:])], add_special_tokens=False)]
        return np.concatenate([np.empty(0, self.dtype), *parts]), np.array([len(p) for p in parts], np.int64)

    def _by_pieces(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        w = split_words(_lowered(buf, offsets), offsets, SPACE)
        _, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        size = w.end[at] - w.start[at]
        bounds = np.append(0, np.cumsum(size + 1))  # each distinct word, with a blank behind it
        text = np.full(bounds[-1], 0x20, np.uint8)
        text[ragged(bounds[:-1], size)] = w.buf[ragged(w.start[at], size)]
        start, end, count = cut_words(text, bounds[:-1], bounds[:-1] + size)
        begins, sizes, flat = self._pieces(text, start, end)
        words = np.append(flat[ragged(begins, sizes)], np.array([end_id], self.dtype))
        ids = np.append(0, np.cumsum(sizes))
        cuts = np.append(0, np.cumsum(count))
        lengths = np.append(ids[cuts[1:]] - ids[cuts[:-1]], 1)
        which = np.insert(inverse.reshape(-1), w.first[1:], len(at))  # an end after each document
        n = lengths[which]
        total = np.cumsum(n)
        ends = total[w.first[1:] + np.arange(len(w.counts))]
        return words[ragged(np.append(ids[cuts[:-1]], len(words) - 1)[which], n)], np.diff(ends, prepend=0)

    def _pieces(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's ids begin in the third array, and their number."""
        keys, at, inverse = np.unique(span_hashes(text, start, end), return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        known = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        new = at[~known]
        sizes, flat = self._encode(text, start[new], end[new])
        kept, begins, lengths = self.keys, self.begins, self.sizes
        if len(kept) + len(new) > CACHE_PIECES:  # those of this run stay
            stay = np.isin(kept, keys, assume_unique=True)
            flat = np.concatenate([self.flat[ragged(begins[stay], lengths[stay])], flat])
            kept, lengths = kept[stay], lengths[stay]
            begins = np.cumsum(lengths) - lengths
        else:
            flat = np.concatenate([self.flat, flat])
        own = len(flat) - int(sizes.sum()) + np.cumsum(sizes) - sizes
        kept, begins, lengths = np.concatenate([kept, keys[~known]]), np.concatenate([begins, own]), np.concatenate([lengths, sizes])
        order = np.argsort(kept)
        kept, begins, lengths = kept[order], begins[order], lengths[order]
        where = np.searchsorted(kept, keys)
        out = begins[where][inverse], lengths[where][inverse], flat
        if len(kept) <= CACHE_PIECES:
            short = lengths <= PIECE_BYTES
            self.keys, self.begins, self.sizes = kept[short], begins[short], lengths[short]
            self.flat = flat
        return out

    def _encode(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids in order."""
        raw, count = text.tobytes(), np.zeros(len(start), np.int64)
        if not len(start):
            return count, np.empty(0, self.dtype)
        before = np.cumsum(np.concatenate([[0], (KIND[text] == 0) | (text == 0x27) | (text == 0x3C)]))
        odd = before[end] > before[start]
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        normal = self.tokenizer.normalizer.normalize_str(" ".join(texts[k] for k in rest.tolist())).split(" ") if len(rest) else []
        if len(normal) == len(rest):  # else a special piece has a blank of its own once it is normalised
            latin = np.array([LATIN.fullmatch(x) is not None for x in normal], bool)
            for k in np.flatnonzero(latin).tolist():
                texts[rest[k]] = normal[k]
            odd[rest[latin]] = False
            plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        got = self.plain([" ".join(texts[k] for k in plain[a : a + 512].tolist()) for a in range(0, len(plain), 512)], add_special_tokens=False)
        ids = np.concatenate([np.empty(0, self.dtype), *(np.array(e.ids, self.dtype) for e in got)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(plain):
            raise ValueError("a piece that is not one word of the tokenizer")
        count[plain] = np.diff(stops, prepend=0)
        others = [np.array(e.ids, self.dtype) for e in self.batch([texts[k] for k in rest.tolist()], add_special_tokens=False)]
        count[rest] = [len(x) for x in others]
        begins = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), self.dtype)
        flat[ragged(begins[plain], count[plain])] = ids
        flat[ragged(begins[rest], count[rest])] = np.concatenate([np.empty(0, self.dtype), *others])
        return count, flat


def _lowered(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, but not in words that may hold a special token; words end with their document."""
    low = LOWER[buf]
    at = np.flatnonzero((buf[:-1] == 0x3C) & (buf[1:] == 0x7C))
    if len(at):
        w = split_words(buf, offsets, SPACE, hashed=False)
        word = np.searchsorted(w.start, at, "right") - 1
        word = np.unique(word[at + 1 < w.end[word]])
        own = ragged(w.start[word], w.end[word] - w.start[word])
        low[own] = buf[own]
    return low


def cut_words(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of words (starts, ends, number for each word), cut between ASCII characters of two kinds and between digits.

    Words with an apostrophe (contractions) or with ``<|`` (special tokens) stay whole.
    """
    kind = KIND[text]
    a, b = kind[:-1], kind[1:]
    cut = np.flatnonzero((a > 0) & (b > 0) & ((a != b) | (a == DIGIT))) + 1
    whole = np.zeros(len(start), bool)
    special = np.flatnonzero((text[:-1] == 0x3C) & (text[1:] == 0x7C))
    whole[np.searchsorted(start, np.concatenate([np.flatnonzero(text == 0x27), special]), "right") - 1] = True
    cut = cut[~whole[np.searchsorted(start, cut, "right") - 1]]
    starts, ends = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return starts, ends, np.diff(np.searchsorted(starts, np.append(start, len(text))))


def _open(path: str):
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return fs, inner


class ShardWriter:
    def __init__(self, path: str, dtype: type, seq_len: int):
        fs, inner = _open(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.seq_len, self.dtype = seq_len, dtype
        self.schema = pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.out = fs.open_output_stream(f"{inner}.arrow")
        self.file = pa.ipc.new_file(self.out, self.schema)
        self.index_out = fs.open_output_stream(f"{inner}.docs.arrow")
        self.index = pa.ipc.new_file(self.index_out, INDEX)
        self.rest: list[np.ndarray] = []
        self.held = self.n_ids = self.n_docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.n_ids + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(counts)], schema=INDEX))
        self.n_ids += len(ids)
        self.n_docs += len(counts)
        self.rest.append(ids)
        self.held += len(ids)
        size = BATCH_SEQUENCES * self.seq_len
        if self.held >= size:
            ids = np.concatenate(self.rest)
            whole = len(ids) // size * size
            for at in range(0, whole, size):
                self._write(ids[at : at + size])
            self.rest, self.held = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, real: int | None = None) -> None:
        mask = np.ones(len(ids), bool)
        mask[len(ids) if real is None else real :] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.concatenate(self.rest)
            self._write(np.pad(ids, (0, -len(ids) % self.seq_len)), len(ids))
        for x in (self.file, self.out, self.index, self.index_out):
            x.close()


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str | None = None, end_id: int = END_ID, seq_len: int = SEQ_LEN) -> DataFrame:
    """Write the shards and return the committed manifest."""
    spark, path = docs.sparkSession, tokenizer_path or default_tokenizer()
    bounded_batches(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, name = TaskContext.get().partitionId(), None, ""
        for doc_ids, buf, offsets in text_runs(batches, RUN_BYTES):
            encoder = encoder_of(path)
            if writer is None:
                name = f"{out_dir}/shards/{shard:06d}-{uuid.uuid4().hex}"
                writer = ShardWriter(name, encoder.dtype, seq_len)
            writer.add(doc_ids.cast(pa.int64()), *encoder.encode(buf, offsets, end_id))
        if writer is not None:
            writer.close()
            del doc_ids, buf, offsets  # the worker lives on beside those of later stages
            give_back()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "tokens": [f"{name}.arrow"], "index": [f"{name}.docs.arrow"], "n_ids": [writer.n_ids], "n_docs": [writer.n_docs]})

    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions_for(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def open_shard(path: str) -> pa.ipc.RecordBatchFileReader:
    """A local file is memory-mapped; others are read by range."""
    fs, inner = _open(path)
    return pa.ipc.open_file(pa.memory_map(inner) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(inner))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask (bits) of the i-th sequence of a shard, both views of the mapped file."""
    batch = reader.get_batch(i // BATCH_SEQUENCES)
    return batch.column(0)[i % BATCH_SEQUENCES].values.to_numpy(), batch.column(1)[i % BATCH_SEQUENCES].values


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: one row per document."""
    before = F.sum("n_ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    shards = manifest.withColumn("before", F.coalesce(before, F.lit(0)))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens, index = open_shard(row["tokens"]), open_shard(row["index"])
                chunks = _flat(tokens)
                held, base = np.empty(0, "<u4"), 0
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    starts, counts = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crcs = np.empty(len(starts), np.int64)
                    for d, (a, n_ids) in enumerate(zip(starts.tolist(), counts.tolist())):
                        crc, left = 0, n_ids
                        while left:
                            if a >= base + len(held):
                                base += len(held)
                                held = next(chunks)
                                continue
                            part = held[a - base : a - base + left]
                            crc = zlib.crc32(part, crc)
                            a += len(part)
                            left -= len(part)
                        crcs[d] = crc
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + row["before"]), docs.column(2), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _flat(reader: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    """The real ids of each batch as little-endian 32-bit integers."""
    for k in range(reader.num_record_batches):
        batch = reader.get_batch(k)
        ids = batch.column(0).flatten().to_numpy()
        mask = batch.column(1).flatten()
        real = mask.true_count
        yield np.ascontiguousarray(ids[:real], "<u4")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_documents(write_token_files(docs, shared_dir(spark, "tokens")))
