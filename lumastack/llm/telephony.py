"""Telephony audio columns: G.711 tables, block ADPCM with numpy, resampled PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

PAD = 64
RATE = 8000
#: WAVE format codes.
CODES = {"alaw": 6, "mulaw": 7}
#: Samples that are expanded and measured at a time.
CHUNK = 1 << 20

# Fixed values of the IMA ADPCM format: step of index i is about 7 * 1.1^i; index moves by code magnitude.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
     209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272,
     2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500,
     20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """Linear 16-bit value of each mu-law byte."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit value of each A-law byte."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (size + 256) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def ima_decode(data: np.ndarray, block: int = PAD) -> np.ndarray:
    """Decode IMA ADPCM blocks, one row of int16 samples per block; all blocks step together.

    A block is a little-endian 16-bit first sample, the step index (beyond 88:
    88), a reserved byte, then two 4-bit codes a byte, low half first.
    """
    rows = data.reshape(-1, block)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(rows[:, 2], 88).astype(np.int32)
    codes = np.empty((block - 4) * 2 * len(rows), dtype=np.uint8).reshape((block - 4) * 2, len(rows))
    codes[0::2], codes[1::2] = (rows[:, 4:] & 15).T, (rows[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(rows)), dtype=np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        step = IMA_STEPS[index]
        delta = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -delta, delta), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code & 7], 0, 88)
        out[k] = value
    return out.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation in integers; the last sample repeats."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    out[-1] = pcm[-1]
    return out


def pack_pcm(pcm: np.ndarray) -> bytes:
    """PCM of twice the rate as its even samples, then what its odd ones differ by from the mean of their neighbours (modulo 2^16). Lossless for any samples; interpolated ones leave zeros, which compress away."""
    even, odd = pcm[0::2].astype(np.int32), pcm[1::2].astype(np.int32)
    guess = (even + np.append(even[1:], even[-1:])) >> 1
    return even.astype("<i2").tobytes() + (odd - guess).astype("<i2").tobytes()


def unpack_pcm(stored: bytes) -> np.ndarray:
    """The 16-bit samples again."""
    even, rest = np.frombuffer(stored, dtype="<i2").reshape(2, -1).astype(np.int32)
    out = np.empty(2 * len(even), dtype="<i2")
    out[0::2] = even
    out[1::2] = (((even + np.append(even[1:], even[-1:])) >> 1) + rest).astype("<i2")
    return out


def wav_bytes(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono 8-bit WAVE file of G.711 samples."""
    body = struct.pack("<4sIHHIIHHH", b"fmt ", 18, CODES[codec], 1, rate, rate, 1, 8, 0) + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI4s", b"RIFF", 4 + len(body), b"WAVE") + body


def wav_payload(media: bytes) -> tuple[int, bytes]:
    """(format code, sample bytes) of a WAVE file, chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, code = 12, 0
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            code = struct.unpack_from("<H", media, at + 8)[0]
        if name == b"data":
            return code, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % PAD or PAD * (not raw))


def features(payloads: list[bytes], pcms: list[bytes]) -> list[str]:
    """Per payload, integers measured on its three decodings and the digest of its resampled PCM, as ``pack_pcm`` stored it.

    Payloads are cut into parts of at most ``CHUNK`` bytes and measured many at
    a time, so that short texts share numpy's steps and long ones stay bounded.
    """
    names = [f"{law}:{what}" for law in TABLES for what in ("energy", "crossings")] + ["ima:energy", "ima:peak"]
    totals = [dict.fromkeys(names, 0) for _ in payloads]
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def measure() -> None:
        data = np.concatenate([p for _, p in held])
        ends = np.cumsum([len(p) for _, p in held])
        starts = np.concatenate([[0], ends[:-1]])
        found = {}
        for law, table in TABLES.items():
            found[f"{law}:energy"] = np.add.reduceat((table.astype(np.int64) ** 2)[data], starts)
            negative = table[data] < 0
            turns = np.concatenate([[False], negative[1:] != negative[:-1]])
            turns[starts] = False
            found[f"{law}:crossings"] = np.add.reduceat(turns.astype(np.int64), starts)
        pcm = ima_decode(data).astype(np.int32)
        blocks = starts // PAD
        found["ima:energy"] = np.add.reduceat((pcm.astype(np.int64) ** 2).sum(axis=1), blocks)
        peaks = np.maximum.reduceat(np.abs(pcm).max(axis=1), blocks)
        for row, (i, _) in enumerate(held):
            for name, values in found.items():
                totals[i][name] += int(values[row])
            totals[i]["ima:peak"] = max(totals[i]["ima:peak"], int(peaks[row]))
        held.clear()

    for i, payload in enumerate(payloads):
        data = np.frombuffer(payload, dtype=np.uint8)
        for at in range(0, len(data), CHUNK):
            held.append((i, data[at : at + CHUNK]))
            size += len(held[-1][1])
            if at:
                # a sign change between two parts of one payload
                for law, table in TABLES.items():
                    totals[i][f"{law}:crossings"] += int((table[data[at]] < 0) != (table[data[at - 1]] < 0))
            if size >= CHUNK:
                measure()
                size = 0
    if held:
        measure()
    return [";".join([*(f"{k}={v}" for k, v in t.items()), f"pcm{2 * RATE}:{hashlib.sha256(unpack_pcm(p).tobytes()).hexdigest()[:16]}"]) for t, p in zip(totals, pcms, strict=True)]


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_media(docs: DataFrame, key: str = "doc_id", text: str = "text", codec: str = "mulaw") -> DataFrame:
    """``key, n_bytes, media, pcm`` of each text: the telephony WAVE file whose 8-bit samples are the padded bytes, and its 16-bit samples at twice the rate, packed by ``pack_pcm``.

    Texts are UTF-8, padded with zero bytes to a positive multiple of 64; null
    counts as empty.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [padded(v.as_py()) for v in part.column(1)]
                pcm = [pack_pcm(resample_double(TABLES[codec][np.frombuffer(p, dtype=np.uint8)])) for _, p in rows]
                columns = [pa.array([n for n, _ in rows], pa.int64()), pa.array([wav_bytes(p, codec) for _, p in rows], pa.binary()), pa.array(pcm, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], [key, "n_bytes", "media", "pcm"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(store, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary, pcm binary")


def measured_media(stored: DataFrame, key: str = "doc_id", codec: str = "mulaw", with_media: bool = False) -> DataFrame:
    """``key`` and the columns of ``MEDIA``, all from the files and PCM of a table of ``stored_media``; with ``with_media`` also ``media, pcm``. A file in another format is an error."""
    schema = f"{key} {stored.schema[key].dataType.simpleString()}, {MEDIA}" + ", media binary, pcm binary" * with_media

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows: list[tuple] = []
                back: list[bytes] = []
                for n, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    media = value.as_py()
                    code, read = wav_payload(media)
                    if code != CODES[codec]:
                        raise ValueError(f"stored as format {code}")
                    rows.append((n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-PAD:]), len(media), hashlib.sha256(media).hexdigest()))
                    back.append(read)
                packed = batch.column(3).to_pylist()
                rows = [(*r, f) for r, f in zip(rows, features(back, packed), strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                if with_media:
                    columns += [batch.column(2), pa.array([unpack_pcm(p).tobytes() for p in packed], pa.binary())]
                names = [key, *[x.split()[0] for x in MEDIA.split(", ")], *["media", "pcm"][: 2 * with_media]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return stored.select(key, "n_bytes", "media", "pcm").mapInArrow(measure, schema)


#: Rows that are stored or measured together.
ROWS = 256
#: Compression of the stored table: files and PCM say the same, so that disk counts twice.
LEVEL = 6


def telephony_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", codec: str = "mulaw", with_media: bool = False) -> DataFrame:
    """Store each whole text as a telephony WAVE file and as its PCM at twice the rate in a table of the shared folder, read both back and measure them.

    Returns ``key``, the columns of ``MEDIA``, and with ``with_media`` also
    ``media binary`` and ``pcm binary`` (16-bit samples at twice the rate). The
    codec's byte is the sample, so storing is lossless; every value but the
    text's own length derives from the bytes that the table gives back.
    Null texts count as empty; equal texts give equal values; rows are
    independent and nothing is shuffled.
    """
    return measured_media(materialise(stored_media(docs, key, text, codec), "telephony-media", LEVEL), key, codec, with_media)
