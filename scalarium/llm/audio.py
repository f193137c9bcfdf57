"""Telephony audio in WAV containers: mu-law and A-law by lookup tables, IMA ADPCM with numpy across blocks.

Bytes are stored as samples of one of the three codecs, read back from the container, expanded to 16-bit samples
at 8 kHz, and resampled to 16 kHz.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarium.llm.tables import discard, stored
from scalarium.llm.text import raw_text, slices

RATE, BLOCK, PAD = 8000, 576, 255
#: How hard stored media are compressed: samples take four to eight times their payload otherwise.
LEVEL = 9
#: Parts that a round trip is made in: media of one part are stored at a time.
PARTS = 4
MULAW, ALAW, ADPCM = "mulaw", "alaw", "adpcm"
#: Format tags of the WAV container, and the step sizes and index changes of IMA ADPCM.
TAGS = {ALAW: 6, MULAW: 7, ADPCM: 17}
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def adpcm_samples(blocks: np.ndarray) -> np.ndarray:
    """Decode mono IMA ADPCM blocks (rows of bytes), all at once: each row gives one sample and two for each byte after its head.

    A step index over 88 in a head counts as 88.
    """
    blocks = blocks.astype(np.int32)
    value = (blocks[:, 0] | (blocks[:, 1] << 8)).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88)
    out = np.empty((blocks.shape[1] * 2 - 7, len(blocks)), np.int16)
    out[0] = value
    for k in range(4, blocks.shape[1]):
        for half in (0, 1):
            code = (blocks[:, k] >> (4 * half)) & 15
            step = STEPS[index]
            change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + MOVES[code & 7], 0, 88)
            out[2 * k - 7 + half] = value
    return np.ascontiguousarray(out.T)


def resampled(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: between each two samples their mean, rounded down; the last one again at the end."""
    out = np.empty(2 * len(samples), np.int16)
    out[::2] = samples
    out[1:-1:2] = (samples[:-1].astype(np.int32) + samples[1:]) >> 1
    out[-1:] = samples[-1:]
    return out


def wav(codec: str, data: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with the data as they are; codec may be pcm16 too."""
    if codec == "pcm16":
        form = struct.pack("<HHIIHH", 1, 1, rate, 2 * rate, 2, 16)
        fact = b""
    elif codec == ADPCM:
        samples = 2 * BLOCK - 7
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // samples, BLOCK, 4, 2, samples)
        fact = struct.pack("<4sII", b"fact", 4, len(data) // BLOCK * samples)
    else:
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
        fact = struct.pack("<4sII", b"fact", 4, len(data))
    body = b"WAVE" + struct.pack("<4sI", b"fmt ", len(form)) + form + fact + struct.pack("<4sI", b"data", len(data)) + data + b"\0" * (len(data) % 2)
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def wav_data(media: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, block size and data of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    view, at, form = memoryview(media), 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data" and form:
            return form[0], form[2], form[4], view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def codec_of(payload: bytes) -> str:
    """The codec that stores a payload: by its CRC-32, so equal payloads are stored alike."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as UTF-8, padded with bytes 255 to a positive multiple of 576, in a WAV file.

    The payload is stored as 8-bit mu-law or A-law samples or as ADPCM blocks of 576 bytes.  A null text counts as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, buf = raw_text(batch.column(1))
            for i, j in slices(off, 4 << 20):
                media = []
                for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True):
                    payload = buf[a:b].tobytes() + bytes([PAD]) * ((a - b) % BLOCK or (0 if b > a else BLOCK))
                    media.append(wav(codec_of(payload), payload))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def expanded(media: list[bytes]) -> list[tuple[str, memoryview, np.ndarray]]:
    """Codec, stored bytes and 16-bit samples of each WAV file; the ADPCM blocks of all are decoded together."""
    told = [wav_data(x) for x in media]
    names = {tag: name for name, tag in TAGS.items()}
    blocks = [np.frombuffer(data, np.uint8).reshape(-1, block) for tag, _, block, data in told if names[tag] == ADPCM]
    decoded = iter(())
    if blocks:
        if len({b.shape[1] for b in blocks}) > 1:
            raise ValueError("ADPCM files of different block sizes")
        samples = adpcm_samples(np.concatenate(blocks))
        edges = np.cumsum([0, *map(len, blocks)])
        decoded = (samples[a:b].reshape(-1) for a, b in zip(edges[:-1], edges[1:], strict=True))
    return [(names[tag], data, next(decoded) if names[tag] == ADPCM else TABLES[names[tag]][np.frombuffer(data, np.uint8)]) for tag, _, _, data in told]


def feature(codec: str, pcm: np.ndarray) -> str:
    """Codec, rate, number of samples, power, zero crossings and CRC-32 of resampled 16-bit samples."""
    wide = pcm.astype(np.int64)
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"{codec};{2 * RATE};{len(pcm)};{int((wide * wide).sum()) // max(len(pcm), 1)};{crossings};{zlib.crc32(pcm.astype('<i2').tobytes()):08x}"


def pcm(media: DataFrame) -> DataFrame:
    """Stored media (doc_id, n_bytes, media) as WAV files of 16-bit samples at 16 kHz (pcm), with the codec and digests of what was stored and of the payload read from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, _ = raw_text(batch.column(2))
            for i, j in slices(off):
                files = batch.column(2).slice(i, j - i).to_pylist()
                rows = []
                for file, (codec, payload, samples) in zip(files, expanded(files), strict=True):
                    made = wav("pcm16", resampled(samples).astype("<i2").tobytes(), 2 * RATE)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), codec, made))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in (0, 1)), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "codec", "pcm"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, pcm binary")


def describe(made: DataFrame) -> DataFrame:
    """The rows of pcm() with a feature of the samples in place of codec and samples."""
    told = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [feature(codec.as_py(), np.frombuffer(wav_data(file.as_py())[3], "<i2")) for codec, file in zip(batch.column(7), batch.column(8), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(features, pa.string())], names=[*told, "feature"])

    return made.select(*told, "codec", "pcm").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts stored as media in tables of the shared folder, read back, stored again as samples and described from these; one row per row.

    Rows are dealt in parts by their ids.  A part's media are removed when its samples are stored, as nothing reads them
    any more; the samples of all parts stay, in one table.
    """
    made = None
    for k in range(PARTS):
        part = docs.filter(F.pmod(F.xxhash64(id_col), F.lit(PARTS)) == k)
        media = stored(store(part, id_col, text_col), "media", level=LEVEL)
        made = stored(pcm(media), "pcm", level=LEVEL, onto=made)
        discard(media)
    return describe(made)
