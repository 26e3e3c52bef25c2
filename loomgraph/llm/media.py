"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM in WAV bytes, expanded to PCM.

G.711 bytes expand by 256-entry tables; ADPCM blocks decode with one numpy step per
sample position over all blocks of a file together.
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

from loomgraph.storage import stash

RATE, UNIT = 8000, 64
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 0x11
#: Bytes of media that are decoded together, and samples that are worked on at once within a long file.
WINDOW, CHUNK = 1 << 19, 1 << 17


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = code >> 4 & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _steps() -> np.ndarray:
    """The 89 IMA step sizes. Fixed values of the format."""
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
        np.int32,
    )


MULAW_PCM, ALAW_PCM, STEPS = _mulaw_table(), _alaw_table(), _steps()
#: Change of the step index by the nibble's magnitude. Fixed values of the format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def adpcm_decode(payload: bytes, block: int = UNIT) -> np.ndarray:
    """16-bit samples of mono IMA ADPCM blocks: a header sample, then two per byte, low nibble first. A last partial block is left out."""
    blocks = np.frombuffer(payload, np.uint8)[: len(payload) // block * block].reshape(-1, block)
    out = np.empty((len(blocks), 1 + 2 * (block - 4)), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = value
    for k in range(block - 4):
        byte = blocks[:, 4 + k]
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            step = STEPS[index]
            n = nibble.astype(np.int32)
            delta = (step >> 3) + np.where(n & 1, step >> 2, 0) + np.where(n & 2, step >> 1, 0) + np.where(n & 4, step, 0)
            value = np.clip(np.where(n & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + INDEX_STEP[nibble], 0, 88)
            out[:, 1 + 2 * k + half] = value
    return out.reshape(-1)


def wav(payload: bytes, kind: int = MULAW, rate: int = RATE) -> bytes:
    """A mono WAV file around ``payload``; a reader gets exactly its bytes back."""
    if kind == IMA_ADPCM:
        per = 1 + 2 * (UNIT - 4)
        form, samples = struct.pack("<HHIIHHHH", kind, 1, rate, rate * UNIT // per, UNIT, 4, 2, per), len(payload) // UNIT * per
    elif kind == PCM:
        form, samples = struct.pack("<HHIIHH", kind, 1, rate, 2 * rate, 2, 16), len(payload) // 2
    else:
        form, samples = struct.pack("<HHIIHHH", kind, 1, rate, rate, 1, 8, 0), len(payload)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """(format, rate, payload); ValueError if the chunks do not add up."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("not a whole WAV file")
    at, kind, rate = 12, None, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk is longer than its file")
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data" and kind is not None:
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk behind a format chunk")


def expand(kind: int, payload: bytes) -> np.ndarray:
    """16-bit samples of a payload in one of the four formats."""
    if kind in (MULAW, ALAW):
        return (MULAW_PCM if kind == MULAW else ALAW_PCM)[np.frombuffer(payload, np.uint8)]
    if kind == IMA_ADPCM:
        return adpcm_decode(payload)
    if kind == PCM:
        return np.frombuffer(payload[: len(payload) // 2 * 2], "<i2")
    raise ValueError(f"format {kind}")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers to another rate; the first sample stays first."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    n = max(1, len(pcm) * to // rate)
    out = np.empty(n, np.int16)
    for lo in range(0, n, CHUNK):
        at = np.arange(lo, min(n, lo + CHUNK), dtype=np.int64) * rate
        k, part = at // to, at % to
        a, b = pcm[k].astype(np.int64), pcm[np.minimum(k + 1, len(pcm) - 1)].astype(np.int64)
        out[lo : lo + len(at)] = a + (b - a) * part // to
    return out


def low_pass(pcm: np.ndarray, rate: int, to: int, half: int = 16) -> np.ndarray:
    """The samples without what ``to`` Hz cannot hold, before they are resampled downwards; unchanged otherwise.

    A sinc of the new rate's half under a Hann window, over ``half`` of the new samples on either side.
    """
    if to >= rate or not len(pcm):
        return pcm
    reach = half * rate // to
    at = np.arange(-reach, reach + 1)
    taps = np.sinc(at * to / rate) * (0.5 + 0.5 * np.cos(np.pi * at / (reach + 1)))
    taps /= taps.sum()
    out = np.empty(len(pcm), np.int16)
    room = np.concatenate([np.full(reach, pcm[0]), pcm, np.full(reach, pcm[-1])]).astype(np.float64)
    for lo in range(0, len(pcm), CHUNK):
        part = room[lo : min(len(pcm), lo + CHUNK) + 2 * reach]
        out[lo : lo + len(part) - 2 * reach] = np.clip(np.rint(np.convolve(part, taps, "valid")), -32768, 32767)
    return out


def resampled(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    return resample(low_pass(pcm, rate, to), rate, to)


def describe(pcm: np.ndarray) -> str:
    """Length, peak, root mean square and sign changes of samples, in whole numbers."""
    if not len(pcm):
        return "0/0/0/0"
    peak, power, turns = 0, 0, 0
    for lo in range(0, len(pcm), CHUNK):
        wide = pcm[lo : lo + CHUNK + 1].astype(np.int64)  # one more, for the change of sign between chunks
        own = wide[:CHUNK]
        peak, power = max(peak, int(np.abs(own).max())), power + int(np.dot(own, own))
        turns += int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    return f"{len(pcm)}/{peak}/{int(np.sqrt(float(power) / len(pcm)))}/{turns}"


def store_media(docs: DataFrame, kind: int = MULAW) -> DataFrame:
    """(doc_id, n_bytes, media): every text's UTF-8 bytes, padded with zeros to a positive multiple of UNIT, in a WAV file.

    Null texts count as empty and are stored as UNIT zeros; texts may be of any length; null
    ids and repeated rows are rows like any other; other columns are ignored; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), 256):
                raw = [(x or "").encode() for x in texts.slice(lo, 256).to_pylist()]
                media = [wav(x + b"\0" * ((-len(x)) % UNIT or (0 if x else UNIT)), kind) for x in raw]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 256), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode_media(table: DataFrame, to: int = 16000) -> DataFrame:
    """(doc_id, pcm): the media column expanded and resampled to ``to`` Hz, 16-bit little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                kind, rate, payload = read_wav(batch.column("media")[k].as_py())
                pcm = resampled(expand(kind, payload), rate, to).astype("<i2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1), pa.array([pcm], pa.binary())], ["doc_id", "pcm"])

    return table.select("doc_id", "media").mapInArrow(run, "doc_id long, pcm binary")


def media_features(table: DataFrame, to: int = 16000) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pcm) from a stored table (doc_id, n_bytes, media).

    pcm: the samples resampled to ``to`` Hz, 16-bit little-endian, a media column of its own.
    feature: length/peak/rms/sign changes of the samples the stored format gives, of the
    payload read as A-law and as ADPCM blocks, and the CRC-32 of pcm. ValueError if a media
    file is damaged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media_column, ids, sizes = batch.column("media"), batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist()
            lo = 0
            while lo < len(batch):
                files, total = [], 0
                while lo + len(files) < len(batch) and (not files or total < WINDOW):
                    files.append((media := media_column[lo + len(files)].as_py(), *read_wav(media)))
                    total += len(media)
                out: list[list] = [[] for _ in kinds]
                # the blocks of all files of the window are decoded together
                blocks = adpcm_decode(b"".join(payload[: len(payload) // UNIT * UNIT] for *_, payload in files))
                at = 0
                for doc, n, (media, kind, rate, payload) in zip(ids[lo:], sizes[lo:], files, strict=False):
                    wide = len(payload) // UNIT * (1 + 2 * (UNIT - 4))
                    adpcm, at = blocks[at : at + wide], at + wide
                    pcm = adpcm if kind == IMA_ADPCM else expand(kind, payload)
                    again = resampled(pcm, rate, to).astype("<i2").tobytes()
                    feature = f"{describe(pcm)};alaw={describe(expand(ALAW, payload))};adpcm={describe(adpcm)};pcm{to}={zlib.crc32(again):08x}"
                    row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature, again)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                lo += len(files)
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return table.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")


def text_audio(docs: DataFrame, kind: int = MULAW, to: int = 16000) -> DataFrame:
    """Store every text as telephony audio, read the stored column back, and describe it beside its resampled PCM, which is stored with the result."""
    return media_features(stash(store_media(docs, kind), "media"), to)
