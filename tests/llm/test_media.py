import hashlib
import zlib

import numpy as np

from cloakframe.llm import media as m


def test_tables():
    assert m.MULAW[0] == -32124 and m.MULAW[0x80] == 32124 and m.MULAW[0xFF] == 0 and m.MULAW[0x7F] == 0
    assert m.ALAW[0xD5] == 8 and m.ALAW[0x55] == -8 and m.ALAW[0xAA] == 32256 and m.ALAW[0x2A] == -32256
    assert len(np.unique(m.ALAW)) == 256 and len(np.unique(m.MULAW)) == 255


def slow_ima(data, block):
    out = []
    for at in range(0, len(data), block):
        b = data[at : at + block]
        v = int.from_bytes(b[:2], "little", signed=True)
        i = min(b[2], 88)
        out.append(v)
        for byte in b[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(m.IMA_STEP[i])
                d = step >> 3
                d += step if code & 4 else 0
                d += step >> 1 if code & 2 else 0
                d += step >> 2 if code & 1 else 0
                v = max(-32768, min(32767, v - d if code & 8 else v + d))
                i = max(0, min(88, i + int(m.IMA_INDEX[code])))
                out.append(v)
    return out


def test_adpcm_blocks():
    data = np.random.default_rng(1).integers(0, 256, 64 * 9, dtype=np.uint8)
    assert m.decode_ima(data, 64).tolist() == slow_ima(data.tobytes(), 64)


def test_resample_tone():
    t = np.arange(4000) / 8000
    x = (10000 * np.sin(2 * np.pi * 440 * t)).astype(np.int16)
    y = m.resample(x, 8000, 16000)
    want = 10000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert len(y) == 8000 and np.abs(y[200:-200] - want[200:-200]).max() < 60
    z = m.resample(x, 8000, 12000)
    assert len(z) == 6000 and np.abs(z[200:-200] - 10000 * np.sin(2 * np.pi * 440 * np.arange(6000) / 12000)[200:-200]).max() < 60


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 64), (None, "é" * 100000), (-3, "x" * 64)], "doc_id long, text string")
    every = docs.union(odd)
    texts = sorted(((r.doc_id, (r.text or "").encode()) for r in every.collect()), key=repr)
    got = sorted(m.media_features(m.encode_media(every)).collect(), key=lambda r: repr((r.doc_id, r.payload_sha256)))
    want = []
    for doc_id, t in texts:
        p = t + b"\0" * ((-len(t)) % 64 or (0 if t else 64))
        want.append((doc_id, len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(m.wav(p, "mulaw")).hexdigest()))
    have = [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)
    for codec in ("alaw", "ima_adpcm"):
        coded = m.encode_media(every.limit(5), codec).collect()
        assert all(m.read_wav(bytes(r.media))[3][: r.n_bytes] == dict(texts)[r.doc_id] for r in coded)
    pcm = m.decode_media(m.encode_media(every.limit(3))).collect()
    assert all(m.read_wav(bytes(r.pcm))[:2] == ("pcm", 16000) for r in pcm)
    assert m.media_features(m.encode_media(every.limit(0))).collect() == []
