"""Media columns: telephony audio (G.711 mu-law and A-law, IMA ADPCM) in WAV containers.

``encode_media`` wraps bytes as 8-bit companded samples in a WAV file (a binary column), without
loss.  ``decode_media`` reads such a column back: companded samples go through 256-entry lookup
tables, ADPCM blocks are decoded side by side (one numpy step per nibble position, across all
blocks), and the PCM is resampled and stored as a 16-bit WAV column.  ``op2_media`` writes the
documents' bytes as a table of media, reads the stored form back and describes the audio.

Defined results: null text is empty, so its payload is 64 zero bytes; equal texts give equal
values; rows and null or repeated doc_ids are kept as they are; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import bounded_batches, materialize
from .words import text_slices

BLOCK = 64
RATE, OUT_RATE = 8000, 16000
FORMATS = {"pcm": 1, "alaw": 6, "mulaw": 7, "ima_adpcm": 17}
CODECS = {v: k for k, v in FORMATS.items()}

# Fixed values of the IMA ADPCM format: index changes by the low three bits of a code, and step sizes.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)
IMA_STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34,
    37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173,
    190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876,
    963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
    4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385,
    24623, 27086, 29794, 32767,
])


def mulaw_table() -> np.ndarray:
    """16-bit linear value of each mu-law code (ITU-T G.711)."""
    u = ~np.arange(256, dtype=np.uint8)
    size = ((((u & 15).astype(np.int32) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit linear value of each A-law code (ITU-T G.711)."""
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    exp = ((a >> 4) & 7).astype(np.int32)
    low = ((a & 15).astype(np.int32) << 4) + 8
    size = np.where(exp == 0, low, (low + 0x100) << np.maximum(exp - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_ima(data: np.ndarray, block: int) -> np.ndarray:
    """Mono IMA ADPCM; all blocks advance together.  A short last block is padded with zeros."""
    blocks = np.pad(data, (0, -len(data) % block)).reshape(-1, block)
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int8).astype(np.int32) << 8
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((len(blocks), 1 + 2 * (block - 4)), np.int16)
    out[:, 0] = value
    for k in range(2 * (block - 4)):
        code = (blocks[:, 4 + k // 2] >> 4 * (k % 2)) & 15
        step = IMA_STEP[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        out[:, 1 + k] = value
    return out.reshape(-1)


def wav(data: bytes, codec: str, rate: int = RATE, block: int = 1) -> bytes:
    """A mono WAV file; ``block`` is the bytes of a block (of a sample for companded data)."""
    bits, per_block = {"pcm": (16, 1), "ima_adpcm": (4, 1 + 2 * (block - 4))}.get(codec, (8, 1))
    block = 2 if codec == "pcm" else block
    extra = struct.pack("<HH", 2, per_block) if codec == "ima_adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, rate, rate * block // per_block, block, bits) + extra
    fact = b"" if codec == "pcm" else b"fact" + struct.pack("<II", 4, len(data) // block * per_block)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(raw: bytes) -> tuple[str, int, int, bytes]:
    """(codec, rate, block, data) of a mono WAV file."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate, block, data = 12, "", 0, 0, b""
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], int.from_bytes(raw[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, channels, rate, _, block = struct.unpack_from("<HHIIH", raw, at + 8)
            if channels != 1 or tag not in CODECS:
                raise ValueError(f"format {tag} with {channels} channels is not read")
            codec = CODECS[tag]
        elif name == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return codec, rate, block, data


def to_pcm(codec: str, block: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if codec == "mulaw":
        return MULAW[raw]
    if codec == "alaw":
        return ALAW[raw]
    if codec == "ima_adpcm":
        return decode_ima(raw, block)
    return np.frombuffer(data, "<i2")


@lru_cache
def _filter(up: int, down: int, zeros: int = 8) -> np.ndarray:
    """Hann-windowed sinc for a change of rate by up/down."""
    cut = max(up, down)
    n = np.arange(-zeros * cut, zeros * cut + 1)
    taps = np.sinc(n / cut) * (0.5 + 0.5 * np.cos(np.pi * n / (zeros * cut)))
    return taps / taps.sum() * up


def resample(pcm: np.ndarray, rate: int, out_rate: int) -> np.ndarray:
    """16-bit PCM at another rate by a polyphase windowed-sinc filter."""
    g = int(np.gcd(rate, out_rate))
    up, down = out_rate // g, rate // g
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    taps, x = _filter(up, down), pcm.astype(np.float64)
    half, n = len(taps) // 2, -(-len(pcm) * up // down)
    if down == 1:  # each phase is a plain convolution of the input
        out = np.empty((len(x), up))
        for p in range(up):
            phase = taps[(half + p) % up :: up]
            shift = (half + p - (half + p) % up) // up
            out[:, p] = np.convolve(x, phase)[shift : shift + len(x)]
        y = out.reshape(-1)[:n]
    else:
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        y = np.convolve(wide, taps)[half : half + len(wide)][::down][:n]
    return np.clip(np.rint(y), -32768, 32767).astype(np.int16)


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % BLOCK if text else BLOCK)


def encode_media(docs: DataFrame, codec: str = "mulaw") -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the padded text as samples of a WAV file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for rows, buf, offsets in text_slices(batch):
                texts = [buf[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                block = BLOCK if codec == "ima_adpcm" else 1
                yield pa.RecordBatch.from_arrays(
                    [ids[rows.start : rows.stop], pa.array([len(t) for t in texts], pa.int64()), pa.array([wav(payload(t), codec, block=block) for t in texts], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, out_rate: int = OUT_RATE) -> DataFrame:
    """The media column as resampled 16-bit PCM in WAV files (pcm); null stays null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.slice(at, 256), []
                for raw in part.column(1):
                    if raw.is_valid:
                        codec, rate, block, data = read_wav(raw.as_py())
                        out.append(wav(resample(to_pcm(codec, block, data), rate, out_rate).astype("<i2").tobytes(), "pcm", out_rate))
                    else:
                        out.append(None)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(decode, "doc_id long, pcm binary")


def describe(raw: bytes, out_rate: int = OUT_RATE) -> tuple[bytes, str]:
    """The stored samples of a WAV file, and a line of features of its audio."""
    codec, rate, block, data = read_wav(raw)
    pcm = to_pcm(codec, block, data)
    x = pcm.astype(np.int64)
    high = resample(pcm, rate, out_rate)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    energy = int((x * x).sum())
    text = f"codec={codec};rate={rate};samples={len(x)};ms={len(x) * 1000 // rate};peak={int(np.abs(x).max())};mean={x.mean():.3f};rms={(energy / len(x)) ** 0.5:.3f};crossings={crossings};out_rate={out_rate};out_samples={len(high)};out_crc32={zlib.crc32(high.astype('<i2').tobytes())}"
    return data, text


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    """Digests of the stored media column and of what is read back from it."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part, rows = batch.slice(at, 512), []
                for doc_id, n, stored in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    raw = stored.as_py()
                    data, text = describe(raw)
                    rows.append((doc_id, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(raw), hashlib.sha256(raw).hexdigest(), text))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, FEATURES)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    media = encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media_features(materialize(media, "media"))
