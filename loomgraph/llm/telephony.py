"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE files, decoded to 16 kHz PCM.

``store`` puts bytes into a WAVE file as 8-bit codes (mu-law, A-law) or as 64-byte ADPCM blocks, without
loss; ``decode`` reads WAVE bytes back, expands the codes by lookup tables, decodes all ADPCM blocks of a
batch side by side, and resamples 8 kHz to 16 kHz. Both work on slices of a batch, and a long clip is decoded in pieces, so that
memory beyond a row's own input and output depends neither on the number nor on the length of rows.

Defined results: a null payload is stored as null media; null or foreign bytes decode to null in every
output column; an empty data chunk has an empty payload and no samples. Repeated rows give repeated rows; columns named like the
new ones are replaced, others are kept; an empty table gives no rows.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import sliced, small_batches

MULAW, ALAW, ADPCM = 7, 6, 0x11
RATE, BLOCK = 8000, 64
BLOCK_SAMPLES = 1 + 2 * (BLOCK - 4)

# The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
    107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
    876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
    5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
    27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132) << ((code >> 4) & 7)
    return np.where(code & 128, 132 - size, size - 132).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    segment, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(segment > 0, (size + 256) << np.maximum(segment - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each (step index, nibble): the change of the predictor and the next index."""
    nibble = np.arange(16)
    step = STEPS[:, None]
    change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
    change = np.where(nibble & 8, -change, change)
    index = np.clip(np.arange(len(STEPS))[:, None] + CHANGES[nibble & 7], 0, len(STEPS) - 1)
    return change.astype(np.int32), index.astype(np.int32)


CHANGE, NEXT = (x.ravel() for x in adpcm_tables())


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) bytes to (n, 121) samples: sample k of all blocks is computed in one step."""
    n = len(blocks)
    out = np.empty((BLOCK_SAMPLES, n), np.int16)
    now = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = now
    codes = np.empty((BLOCK_SAMPLES - 1, n), np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    for k in range(BLOCK_SAMPLES - 1):
        at = index * 16 + codes[k]
        now = np.clip(now + CHANGE[at], -32768, 32767)
        index = NEXT[at]
        out[k + 1] = now
    return out.T


TAPS = 8


def half_band() -> np.ndarray:
    """Weights, in 1/4096, of the samples on either side of a point half way: a windowed sinc."""
    at = np.arange(TAPS) + 0.5
    weight = np.sinc(at) * np.cos(np.pi * at / (2 * TAPS + 1)) ** 2
    return np.round(4096 * weight / (2 * weight.sum())).astype(np.int32)


WEIGHTS = half_band()


def doubled(samples: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Twice the rate: every sample, then the value half way to the next; silence surrounds each clip."""
    count = np.diff(offsets)
    shift = np.repeat(np.arange(len(count)) * 2 * TAPS, count) + TAPS
    at = np.arange(len(samples)) + shift
    quiet = np.zeros(len(samples) + 2 * TAPS * (len(count) + 1), np.int32)
    quiet[at] = samples
    middle = np.zeros(len(quiet), np.int32)
    for k in range(TAPS):
        middle[TAPS:-TAPS] += WEIGHTS[k] * (quiet[TAPS - k : len(quiet) - TAPS - k] + quiet[TAPS + 1 + k : len(quiet) - TAPS + 1 + k])
    out = np.empty(2 * len(samples), np.int16)
    out[0::2] = samples
    out[1::2] = np.clip((middle[at] + 2048) >> 12, -32768, 32767)
    return out


def wave(payload: bytes, codec: int) -> bytes:
    """A RIFF file whose data chunk is the payload, byte for byte."""
    if codec == ADPCM:
        form = struct.pack("<HHIIHHHH", codec, 1, RATE, RATE * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
        count = len(payload) // BLOCK * BLOCK_SAMPLES
    else:
        form, count = struct.pack("<HHIIHHH", codec, 1, RATE, RATE, 1, 8, 0), len(payload)
    chunks = b"".join(struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) & 1) for name, body in ((b"fmt ", form), (b"fact", struct.pack("<I", count)), (b"data", payload)))
    return struct.pack("<4sI4s", b"RIFF", 4 + len(chunks), b"WAVE") + chunks


def opened(media: bytes | None) -> tuple[int, bytes] | None:
    """Codec and data chunk of a WAVE file in one of the three codecs; None for anything else."""
    if media is None or len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, codec, align = 12, None, 1
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and size >= 16 and at + 24 <= len(media):
            codec, align = struct.unpack_from("<H", media, at + 8)[0], struct.unpack_from("<H", media, at + 20)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
            fits = codec in TABLES or codec == ADPCM and align == BLOCK and len(data) % BLOCK == 0
            return (codec, data) if fits and len(data) == size else None
        at += 8 + size + (size & 1)
    return None


def store(df: DataFrame, payload: str = "payload", codec: str = "codec") -> DataFrame:
    """df with a binary column ``media``: the payload in a WAVE file of the row's codec (7, 6 or 17).

    Payloads for codec 17 have a multiple of 64 bytes; others, and null payloads, have null media.
    """
    schema = df.drop("media").schema.add("media", "binary")
    rest = [x for x in df.columns if x != "media"]
    at_payload, at_codec = rest.index(payload), rest.index(codec)

    def run(batches):
        for batch in batches:
            for part in sliced(batch, at_payload):
                made = [
                    None if body is None or kind not in (MULAW, ALAW, ADPCM) or kind == ADPCM and len(body) % BLOCK else wave(body, kind)
                    for body, kind in zip(part.column(at_payload).to_pylist(), part.column(at_codec).to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.binary())], names=[*rest, "media"])

    return small_batches(df).select(*rest).mapInArrow(run, schema)


def _samples(found: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """8 kHz samples of all clips, end to end, and the offsets of the clips."""
    count = np.array([len(body) // BLOCK * BLOCK_SAMPLES if codec == ADPCM else len(body) for codec, body in found], np.int64)
    offsets = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(offsets[-1], np.int16)
    for codec in (MULAW, ALAW, ADPCM):
        own = [i for i, x in enumerate(found) if x[0] == codec]
        if not own:
            continue
        raw = np.frombuffer(b"".join(found[i][1] for i in own), np.uint8)
        values = decode_adpcm(raw.reshape(-1, BLOCK)).ravel() if codec == ADPCM else TABLES[codec][raw]
        own_count = count[own]
        inner = np.arange(len(values)) - np.repeat(np.cumsum(own_count) - own_count, own_count)
        out[np.repeat(offsets[:-1][own], own_count) + inner] = values
    return out, offsets


def _binary(clip: np.ndarray) -> pa.Array:
    """One binary value on the clip's own memory."""
    raw = clip.astype("<i2", copy=False)
    return pa.BinaryArray.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, raw.nbytes], np.int32)), pa.py_buffer(raw)])


#: Payload bytes of one clip that are decoded at a time.
PIECE = 1 << 19


def decoded_clip(codec: int, body: bytes) -> tuple[np.ndarray, int, int, int]:
    """16 kHz samples of one clip of any length, piece by piece; the sum of their squares, their peak, and their sign changes.

    Blocks are independent, and a piece is decoded with a block more on both sides, which is more than the resampler reaches."""
    each = BLOCK_SAMPLES if codec == ADPCM else BLOCK
    out = np.empty(2 * (len(body) // BLOCK * each if codec == ADPCM else len(body)), np.int16)
    energy = peak = turns = at = 0
    for a in range(0, len(body), PIECE):
        lo, hi = max(0, a - BLOCK), min(len(body), a + PIECE + BLOCK)
        low, offsets = _samples([(codec, body[lo:hi])])
        skip = 2 * (each if lo < a else 0)
        n = 2 * (min(PIECE, len(body) - a) // BLOCK * each if codec == ADPCM else min(PIECE, len(body) - a))
        clip = doubled(low, offsets)[skip : skip + n]
        out[at : at + n] = clip
        energy += int(np.square(clip.astype(np.int64)).sum())
        peak = max(peak, int(clip.max()), -int(clip.min()))
        turns += int(((clip[1:] < 0) != (clip[:-1] < 0)).sum()) + int(at > 0 and (out[at - 1] < 0) != (clip[0] < 0))
        at += n
    return out, energy, peak, turns


def decode(df: DataFrame, media: str = "media") -> DataFrame:
    """df, without the media column, with codec int, payload binary, pcm binary (16 kHz, 16-bit little-endian),
    n_samples long, rms double, peak int and crossings long (sign changes) of the stored PCM."""
    new = "codec integer, payload binary, pcm binary, n_samples long, rms double, peak integer, crossings long"
    names = [x.split()[0] for x in new.split(", ")]
    rest = [x for x in df.columns if x not in (*names, media)]
    schema = df.select(*rest).schema
    for x in new.split(", "):
        schema = schema.add(*x.split())

    def run(batches):
        for batch in batches:
            for part in sliced(batch, len(rest)):
                read = [opened(x) for x in part.column(len(rest)).to_pylist()]
                if part.num_rows == 1 and read[0] is not None and len(read[0][1]) > PIECE:
                    codec, body = read[0]
                    clip, energy, peak, turns = decoded_clip(codec, body)
                    one = (pa.array([codec], pa.int32()), pa.array([body], pa.binary()), _binary(clip), pa.array([len(clip)]), pa.array([float(np.sqrt(energy / len(clip)))]), pa.array([peak], pa.int32()), pa.array([turns]))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *one], names=[*rest, *names])
                    continue
                good = [x for x in read if x is not None]
                low, offsets = _samples(good)
                pcm = doubled(low, offsets)
                edges = 2 * offsets
                energy = np.concatenate(([0], np.cumsum(np.square(pcm.astype(np.int64)))))
                signs = np.concatenate(([0], np.cumsum(np.concatenate((pcm[1:] < 0, [False])) != (pcm < 0)))) if len(pcm) else np.zeros(1, np.int64)
                rows, k = [], 0
                for x in read:
                    if x is None:
                        rows.append((None,) * len(names))
                        continue
                    a, b = edges[k], edges[k + 1]
                    clip = pcm[a:b]
                    loud = float(np.sqrt((energy[b] - energy[a]) / max(b - a, 1)))
                    top = int(max(int(clip.max()), -int(clip.min()))) if b > a else 0
                    turns = int(signs[b - 1] - signs[a]) if b > a else 0
                    rows.append((x[0], x[1], clip.astype("<i2").tobytes(), int(b - a), loud, top, turns))
                    k += 1
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=[*rest, *names])

    return df.select(*rest, media).mapInArrow(run, schema)


def text_payload(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts as payloads: UTF-8, then bytes 0 up to a positive multiple of 64. Columns doc_id, n_bytes, payload, codec.

    The codec follows from the payload alone (its CRC-32 modulo 3), so that equal texts are stored alike."""
    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    size = F.octet_length(body).cast("long")
    full = F.greatest(F.lit(BLOCK), F.ceil(size / BLOCK) * BLOCK).cast("int")
    out = docs.select(F.col(id_col).alias("doc_id"), size.alias("n_bytes"), F.rpad(body, full, F.lit(b"\0")).alias("payload"))
    return out.withColumn("codec", F.element_at(F.array(*(F.lit(x) for x in (MULAW, ALAW, ADPCM))), (F.crc32("payload") % 3 + 1).cast("int")))


def text_media(docs: DataFrame) -> DataFrame:
    """The digest of op1: store every text, read the stored bytes back, and describe both."""
    kept = store(text_payload(docs)).select(
        "doc_id", "n_bytes", "media", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")
    )
    back, payload = decode(kept), F.col("payload")
    return back.select(
        "doc_id", "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -BLOCK, BLOCK)).alias("tail_crc32"),
        "media_bytes", "media_sha256",
        F.format_string("codec=%d;samples=%d;rms=%.3f;peak=%d;crossings=%d", "codec", "n_samples", "rms", "peak", "crossings").alias("feature"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
    )
