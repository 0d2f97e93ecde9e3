"""Media columns: telephony audio.

A payload of bytes is stored as a WAV file of 8-bit mu-law or A-law samples, or as IMA ADPCM blocks whose data areas hold
64 bytes each. Mu-law and A-law expand by lookup tables; ADPCM blocks decode together, one numpy step for each nibble
position of all blocks. The decoded 8 kHz signal is resampled to 16 kHz PCM.

Files are a column of a stored table, compressed by zstd. What the table gives back is decoded, and the PCM samples are a
column beside the digests and features, to be stored with them.

Cases: null text is the empty text; the payload is padded with zero bytes to a positive multiple of 64. Equal texts give
equal values (the codec follows from the payload). Texts are whole; a batch is cut into runs of at most RUN bytes for
ADPCM, a longer text is a run of its own. Null and repeated ids stay as they are. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from larkspur.session import own_path, ship, stored

UNIT, RATE, OUT_RATE, RUN = 64, 8000, 16000, 1 << 20
#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: IMA ADPCM step sizes and index changes.
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], dtype=np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: complement, then sign, 3 bits of exponent, 4 of mantissa, bias 132."""
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    x = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -x, x).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: every other bit inverted; the first two segments are linear."""
    a = np.arange(256, dtype=np.int32) ^ 0x55
    e, m = (a >> 4) & 7, ((a & 15) << 4) + 8
    x = np.where(e == 0, m, (m + 256) << np.maximum(e - 1, 0))
    return np.where(a & 128, x, -x).astype(np.int16)


TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """blocks: (n, 4 + 64) bytes, each with its own header. Returns (n, 129) samples; all blocks advance together."""
    head = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * data.shape[0], len(blocks)), dtype=np.int16)
    out[0] = head
    for i in range(2 * data.shape[0]):
        nibble = ((data[i // 2] >> (4 * (i % 2))) & 15).astype(np.int32)
        step, low = STEPS[index], nibble & 7
        delta = (step >> 3) + step * (low >> 2) + (step >> 1) * ((low >> 1) & 1) + (step >> 2) * (low & 1)
        head = np.clip(np.where(nibble & 8, head - delta, head + delta), -32768, 32767)
        index = np.clip(index + CHANGES[low], 0, 88)
        out[1 + i] = head
    return out.T


def wrap(payload: bytes, codec: str) -> bytes:
    """A WAV file with the payload as its samples; for ADPCM each block is a zero header and 64 payload bytes."""
    if codec == "adpcm":
        body = np.zeros((len(payload) // UNIT, 4 + UNIT), dtype=np.uint8)
        body[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        body, align, bits, extra = body.tobytes(), 4 + UNIT, 4, struct.pack("<HH", 2, 1 + 2 * UNIT)
        n, speed = len(payload) // UNIT * (1 + 2 * UNIT), RATE * align // (1 + 2 * UNIT)
    else:
        body, align, bits, extra, n, speed = payload, 1, 8, struct.pack("<H", 0), len(payload), RATE
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, speed, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, n) + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwrap(media: bytes) -> tuple[str, bytes]:
    """(codec, stored sample bytes) of such a file, read chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, data = 12, 0, b""
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    return {v: k for k, v in TAGS.items()}[tag], data


def payload_of(codec: str, data: bytes) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(-1, 4 + UNIT)[:, 4:].tobytes() if codec == "adpcm" else data


def resample(pcm: np.ndarray, rate: int = RATE, to: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation. Doubling, the usual case, is done in integers."""
    if to == 2 * rate:
        out, x = np.empty(2 * len(pcm), dtype="<i2"), pcm.astype(np.int32)
        out[::2], out[-1] = pcm, pcm[-1]
        out[1:-1:2] = (x[:-1] + x[1:]) >> 1
        return out
    at = np.arange(len(pcm) * to // rate) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype("<i2")


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """PCM of each file; the ADPCM blocks of a run of files decode together."""
    out: list = [None] * len(files)
    run, size = [], 0

    def flush():
        blocks = np.concatenate([np.frombuffer(d, np.uint8).reshape(-1, 4 + UNIT) for _, d in run])
        pcm, at = decode_adpcm(blocks), 0
        for i, d in run:
            n = len(d) // (4 + UNIT)
            out[i], at = pcm[at : at + n].ravel(), at + n
        run.clear()

    for i, f in enumerate(files):
        codec, data = unwrap(f)
        if codec != "adpcm":
            out[i] = TABLES[codec][np.frombuffer(data, np.uint8)]
            continue
        if run and size + len(data) > RUN:
            flush()
            size = 0
        run.append((i, data))
        size += len(data)
    if run:
        flush()
    return out


def describe(codec: str, pcm: np.ndarray, wide: bytes) -> str:
    x = pcm.astype(np.int32)
    sign = x >= 0
    return f"{codec}:{len(x)}:{int(np.abs(x).max())}:{int(np.abs(x).sum()) // len(x)}:{int((sign[1:] != sign[:-1]).sum())}:{zlib.crc32(wide):08x}"


STORED = "n_bytes long, codec string, media binary"
COLUMNS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, pcm binary"


def in_runs(pdf: pd.DataFrame, sizes, most: int):
    """The frame in parts of about `most` bytes."""
    size, start = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size > most or i + 1 == len(pdf):
            yield pdf.iloc[start : i + 1]
            size, start = 0, i + 1


def store_audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str = "auto", path: str | None = None) -> DataFrame:
    """The stored table, read back: id, n_bytes (unpadded), codec, media (a WAV file). codec: mulaw, alaw, adpcm, or auto (by the payload's crc32). path: where it is stored, by default in the shared folder."""
    spark = docs.sparkSession
    ship(spark)

    def rows(part):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in part[text_col]]
        names, files = [], []
        for b in raw:
            p = b + bytes(-len(b) % UNIT or (0 if b else UNIT))
            names.append(codec if codec != "auto" else ("mulaw", "alaw", "adpcm")[zlib.crc32(p) % 3])
            files.append(wrap(p, names[-1]))
        return pd.DataFrame({id_col: part[id_col], "n_bytes": [len(b) for b in raw], "codec": names, "media": files})

    def store(batches):
        for pdf in batches:
            yield from map(rows, in_runs(pdf, pdf[text_col].str.len().fillna(0), RUN))

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(id_col, text_col).mapInPandas(store, f"`{id_col}` {kind}, {STORED}")
    return stored(made, path or own_path(spark, "media"), compression="zstd")


def expand(table: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a row of a stored table: digests of its payload and file, the samples at 16 kHz (pcm: 16 bits, little-endian), and
    a feature: codec, number of samples, peak, mean size, changes of sign, and the checksum of pcm."""
    ship(table.sparkSession)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def rows(part):
        out = []
        for key, n, m, x in zip(part[id_col], part["n_bytes"], part["media"], decode_many(list(part["media"])), strict=True):
            kind, data = unwrap(m)
            p, wide = payload_of(kind, data), resample(x).tobytes()
            out.append((key, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), describe(kind, x, wide), kind, wide))
        return pd.DataFrame(out, columns=[id_col, *names])

    def read(batches):
        for pdf in batches:
            yield from map(rows, in_runs(pdf, pdf["media"].str.len(), RUN))

    return table.select(id_col, "n_bytes", "media").mapInPandas(read, f"`{id_col}` {table.schema[id_col].dataType.simpleString()}, {COLUMNS}")
