import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from cloakframe.llm import token_files as m
from cloakframe.llm.shared import shared_dir


def expected(rows):
    t = Tokenizer.from_file(m.default_tokenizer())
    out, at = [], 0
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out, at


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want, total = expected(rows)
    manifest = m.write_token_files(docs, shared_dir(spark, "t"), seq_len=128)
    assert sorted(map(tuple, m.read_documents(manifest).collect())) == want
    flat = []
    for r in sorted(manifest.collect()):
        reader = m.open_shard(r.tokens)
        for i in range(sum(reader.get_batch(k).num_rows for k in range(reader.num_record_batches))):
            ids, mask = m.sequence(reader, i)
            assert len(ids) == len(mask) == 128
            flat += ids[mask.to_numpy(zero_copy_only=False)].tolist()
    assert len(flat) == total


def test_edges(spark):
    odd = ["", None, "  \n", "It's <|endoftext|> n't  Éé İ ΣΣ. a b c é", "x" * 40000, "a\tb\x0bc\x1cd", "don't we'll I'M 1234 #!?"]
    rows = [(i * 3, t) for i, t in enumerate(odd)]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows][::-1], "doc_id long, text string, start string, n_tokens int")
    assert sorted(map(tuple, m.read_documents(m.write_token_files(df, shared_dir(spark, "t"))).collect())) == expected(rows)[0]
    assert m.read_documents(m.write_token_files(df.limit(0), shared_dir(spark, "t"))).collect() == []
    twice = df.limit(2).union(df.limit(2)).union(spark.createDataFrame([(None, "q", "", 0)], df.schema))
    got = m.read_documents(m.write_token_files(twice, shared_dir(spark, "t"))).collect()
    assert len(got) == 5 and min(got, key=lambda r: r.start).doc_id is None


def test_runs_equal_whole_texts():
    """12,000 hostile texts in runs of many: special tokens, halves of them beside a neighbour's, contractions, marks, scripts."""
    r = random.Random(11)
    parts = ["<|", "|>", "<", "|", "<|endoftext|>", "<|pad|>", " ", "\n", "\t", " ", "X", "Foo", "a", "Z9", "12", "'s", "'", "É", "é", "́", "ß", "İ", "中", "ж", "!!", "x<", "...", "\x00", "🙂", "Don't", "D", ""]
    texts = ["".join(r.choices(parts, k=r.randrange(9))) for _ in range(12_000)]
    texts += ["x <|", "D and More", "see a<", "|Dx Foo", "Big", "<|y", "<|" * 3000 + "A", "A" * 5000]
    path = m.default_tokenizer()
    encoder, whole = m.Encoder(path), Tokenizer.from_file(path)
    assert encoder.by_pieces
    for at in range(0, len(texts), 97):
        own = [t.encode() for t in texts[at : at + 97]]
        buf, offsets = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])
        ids, counts = encoder.encode(buf, offsets, 2)
        want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts[at : at + 97]]
        assert counts.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]
