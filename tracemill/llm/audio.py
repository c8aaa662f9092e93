"""Telephony audio columns: mu-law, A-law and IMA ADPCM to resampled PCM.

Companded samples expand through lookup tables. ADPCM blocks are independent, so numpy decodes the n-th code of
all blocks at once. Resampling is polyphase, in integers: equal input gives equal bytes on every machine.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracemill.llm import common

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11
NAMES = {PCM: "pcm", ALAW: "alaw", MULAW: "mulaw", ADPCM: "adpcm"}

#: Fixed values of the IMA ADPCM standard: quantizer steps, and the change of index by code.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598,
    658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289,
    16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int64)
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    magnitude = ((((u & 15) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment, low = (a >> 4) & 7, (a & 15) << 4
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


EXPAND = {MULAW: _mulaw_table(), ALAW: _alaw_table()}


def compress(pcm: np.ndarray, law: int) -> bytes:
    """The code whose expansion is nearest to each sample (of equals the smaller value)."""
    values, codes = np.unique(EXPAND[law], return_index=True)
    x = pcm.astype(np.int64)
    at = np.clip(np.searchsorted(values, x), 1, len(values) - 1)
    low, high = values[at - 1].astype(np.int64), values[at].astype(np.int64)
    return codes[np.where(x - low <= high - x, at - 1, at)].astype(np.uint8).tobytes()


def adpcm_decode(data: bytes, block_bytes: int) -> np.ndarray:
    """Mono IMA blocks: 16-bit predictor, 8-bit index, a spare byte, then 4-bit codes, low half first. A last short block is padded with code 0 and cut again."""
    if block_bytes <= 4:
        raise ValueError("a block must hold more than its head")
    blocks = -(-len(data) // block_bytes)
    if not blocks or len(data) - (blocks - 1) * block_bytes < 4:
        if blocks <= 1:
            return np.empty(0, np.int16)
        blocks -= 1  # a last block without a whole head holds no sample
        data = data[: blocks * block_bytes]
    short = blocks * block_bytes - len(data)
    raw = np.frombuffer(data + bytes(short), np.uint8).reshape(blocks, block_bytes)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
    index = np.clip(raw[:, 2].astype(np.int64), 0, len(STEPS) - 1)
    codes = np.empty((blocks, (block_bytes - 4) * 2), np.int64)
    codes[:, 0::2], codes[:, 1::2] = raw[:, 4:] & 15, raw[:, 4:] >> 4
    out = np.empty((blocks, codes.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(codes.shape[1]):  # the k-th code of all blocks
        code, step = codes[:, k], STEPS[index]
        change = step >> 3
        change = change + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        out[:, k + 1] = value
    return out.reshape(-1)[: out.size - 2 * short]


def adpcm_encode(pcm: np.ndarray, block_bytes: int) -> bytes:
    """Blocks that adpcm_decode reads; the last is padded with its last sample."""
    per = (block_bytes - 4) * 2 + 1
    if not len(pcm):
        return b""
    blocks = -(-len(pcm) // per)
    x = np.concatenate([pcm, np.full(blocks * per - len(pcm), pcm[-1])]).astype(np.int64).reshape(blocks, per)
    value, index = x[:, 0].copy(), np.zeros(blocks, np.int64)
    codes = np.zeros((blocks, per - 1), np.uint8)
    for k in range(per - 1):
        step, rest = STEPS[index], x[:, k + 1] - value
        code, size, change = np.where(rest < 0, 8, 0), np.abs(rest), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            on = size >= part
            code, size, change = code | on * bit, size - on * part, change + on * part
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[code], 0, len(STEPS) - 1)
        codes[:, k] = code
    raw = np.zeros((blocks, block_bytes), np.uint8)
    raw[:, :2] = x[:, 0].astype("<i2").view(np.uint8).reshape(blocks, 2)
    raw[:, 4:] = codes[:, 0::2] | codes[:, 1::2] << 4
    return raw.tobytes()


def store(data: bytes, form: int, rate: int, block_bytes: int = 0) -> bytes:
    """A mono RIFF file of these samples or blocks."""
    bits, align = {PCM: (16, 2), ADPCM: (4, block_bytes)}.get(form, (8, 1))
    speed = rate * block_bytes // ((block_bytes - 4) * 2 + 1) if form == ADPCM else rate * align
    head = struct.pack("<HHIIHH", form, 1, rate, speed, align, bits)
    body = b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def load(media: bytes) -> tuple[int, int, int, bytes]:
    """Form, rate, block size and data of a RIFF file; ValueError if it isn't one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF file")
    at, form, data = 12, None, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if channels != 1:
                raise ValueError("mono only")
            form = kind, rate, align
        elif name == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    if form is None or data is None:
        raise ValueError("a chunk is missing")
    return *form, data


def samples(form: int, block_bytes: int, data: bytes) -> np.ndarray:
    """16-bit PCM of the data of a file."""
    if form in EXPAND:
        return EXPAND[form][np.frombuffer(data, np.uint8)]
    if form == ADPCM:
        return adpcm_decode(data, block_bytes)
    if form == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.int16)
    raise ValueError(f"unknown form {form}")


@functools.lru_cache(maxsize=16)
def _phases(up: int, down: int, half: int) -> np.ndarray:
    """Windowed-sinc taps by phase, in units of 2**-14; each phase sums to one."""
    k = np.arange(-half + 1, half + 1)
    t = k[None, :] - np.arange(up)[:, None] / up
    cut = min(1.0, up / down)
    taps = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * np.clip(t / half, -1, 1)))
    taps = np.rint(taps / taps.sum(1, keepdims=True) * (1 << 14)).astype(np.int64)
    taps[np.arange(up), np.abs(taps).argmax(1)] += (1 << 14) - taps.sum(1)
    return taps


def resample(pcm: np.ndarray, rate: int, to: int, half: int = 8) -> np.ndarray:
    """16-bit PCM at another rate, ceil(n * to / rate) samples."""
    g = gcd(rate, to)
    up, down = to // g, rate // g
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    n = -(-len(pcm) * up // down)
    taps = _phases(up, down, half)
    x = np.concatenate([np.zeros(half - 1, np.int32), pcm.astype(np.int32), np.zeros(half + down, np.int32)])
    out = np.empty(n, np.int16)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase; their inputs are down apart
        base, phase = divmod(first * down, up)
        m = -(-(n - first) // up)
        total = np.zeros(m, np.int64)
        for k in range(2 * half):
            if w := int(taps[phase, k]):
                total += x[base + k : base + k + (m - 1) * down + 1 : down].astype(np.int64) * w
        out[first::up] = np.clip((total + (1 << 13)) >> 14, -32768, 32767)
    return out


def features(pcm: np.ndarray) -> str:
    """Length, peak, root mean square in hundredths and sign changes, all from integers."""
    x = pcm.astype(np.int64)
    if not len(x):
        return "n=0 peak=0 rms=0 zc=0"
    mean = int((x * x).sum()) * 10_000 // len(x)
    root = int(np.sqrt(float(mean)))
    root += ((root + 1) ** 2 <= mean) - (root * root > mean)
    return f"n={len(x)} peak={int(np.abs(x).max())} rms={root} zc={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _decoded(files: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """PCM of each form, block size and data; ADPCM files of whole blocks of one size are decoded together, across all their blocks."""
    out: list = [None] * len(files)
    together: dict[int, list[int]] = {}
    for i, (form, block, data) in enumerate(files):
        if form == ADPCM and block > 4 and len(data) % block == 0:
            together.setdefault(block, []).append(i)
        else:
            out[i] = samples(form, block, data)
    for block, which in together.items():
        per = (block - 4) * 2 + 1
        pcm = adpcm_decode(b"".join(files[i][2] for i in which), block)
        at = 0
        for i in which:
            n = len(files[i][2]) // block * per
            out[i], at = pcm[at : at + n], at + n
    return out


def decode_column(df: DataFrame, media_col: str, rate: int = 16000, status_col: str = "media_status", pcm_col: str = "pcm") -> DataFrame:
    """df with the files of a binary column expanded and resampled: status_col and pcm_col, a PCM file at `rate`, follow all other columns.

    Status is `ok`, `null`, or `bad: ` and the reason; the last two have no PCM. Files of no samples are `ok`. Status
    and PCM columns that df has already are replaced. An empty table gives an empty one.
    """
    kept = [c for c in df.columns if c not in (status_col, pcm_col)]

    def make():
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            media = b.column("media").to_pylist()
            status, files, own = [], [], []
            for m in media:
                try:
                    if m is None:
                        status.append("null")
                        continue
                    form, at, block, data = load(m)
                    if form not in NAMES or (form == ADPCM and block <= 4) or at <= 0:
                        raise ValueError(f"unknown form {form}, block {block} or rate {at}")
                    files.append((form, block, data))
                    own.append(at)
                    status.append("ok")
                except (ValueError, struct.error) as e:
                    status.append(f"bad: {e}")
            stored = iter([store(resample(x, at, rate).astype("<i2").tobytes(), PCM, rate) for x, at in zip(_decoded(files), own, strict=True)])
            columns = [*(b.column(f"c{i}") for i in range(len(kept))), pa.array(status), pa.array([next(stored) if x == "ok" else None for x in status], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [*(f"c{i}" for i in range(len(kept))), "status", "pcm"])

        return run

    fields = [df.schema[c] for c in kept]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(fields)] + [T.StructField("status", T.StringType()), T.StructField("pcm", T.BinaryType())])
    rows = df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(kept)], df[media_col].alias("media"))
    return common.map_batches(rows, make, schema).toDF(*kept, status_col, pcm_col)


def store_texts(docs: DataFrame, rate: int = 8000, pcm_rate: int = 16000, block: int = 64, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as a telephony recording: its bytes, padded to blocks, are the data of a RIFF file.

    The form goes by the text's crc32 modulo 3: 8-bit mu-law or A-law samples, or ADPCM blocks. The file is read back,
    expanded by table or decoded, and resampled; features are those of the PCM. keep adds the file and the PCM file
    themselves. Null texts count as empty: one block of zero bytes. Equal texts give equal values, an empty table an
    empty one; further columns are not read.
    """
    more = ", media binary, pcm binary" if keep else ""

    def make():
        def stored_file(text: str) -> tuple[bytes, bytes]:
            raw = text.encode("utf-8", "surrogatepass")
            padded = raw + bytes(max(block, -(-len(raw) // block) * block) - len(raw))
            form = (MULAW, ALAW, ADPCM)[zlib.crc32(raw) % 3]
            return raw, store(padded, form, rate, block if form == ADPCM else 0)

        def one(raw: bytes, media: bytes, form: int, own: int, back: bytes, pcm: np.ndarray) -> tuple:
            stored = store(resample(pcm, own, pcm_rate).astype("<i2").tobytes(), PCM, pcm_rate)
            pcm = np.frombuffer(load(stored)[3], "<i2")
            return (
                len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-block:]), len(media), hashlib.sha256(media).hexdigest(),
                f"{NAMES[form]} {features(pcm)}", len(stored), hashlib.sha256(stored).hexdigest(), *((media, stored) if keep else ()),
            )

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256", "media", "pcm"]

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            files = [stored_file(t) for t in common.texts_of(b)]
            read = [load(m) for _, m in files]
            decoded = _decoded([(form, align, back) for form, _, align, back in read])
            rows = list(zip(*(one(raw, m, form, own, back, x) for (raw, m), (form, own, _, back), x in zip(files, read, decoded, strict=True)), strict=True))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=False))], ["doc_id", *names[: len(rows)]])

        return run

    docs = common.spread(common.id_and_text(docs, id_col, text_col))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"
    return common.map_batches(docs, make, schema + more)
