"""Media columns: payloads kept losslessly as WAV files in a binary column, and audio fingerprints of them.

A payload becomes 8-bit mono samples. Fingerprints follow the spectral-peak pair scheme: a short-time Fourier
transform of the samples, the strongest bin of each frequency band where it is also a peak in time, and pairs of
a peak with the next ones, each stored as ``time << 32 | first bin << 20 | second bin << 8 | time difference``.

Both maps work row by row over Arrow batches; nothing is shuffled, and a batch bounds memory. What ``store_wav`` gives is
meant to be written; ``read_wav`` works on the bytes that are read back.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Edges of the frequency bands, in bins.
BANDS = (1, 8, 20, 48, 129)
#: Peaks that a peak is paired with, and how many frames ahead they may be.
FAN_OUT, AHEAD = 3, 32
FRAMES_AT_ONCE = 8192


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as r:
        return r.readframes(r.getnframes())


def padded(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of ``BLOCK``."""
    return raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


_HANN = np.hanning(FRAME).astype(np.float32)


def spectrogram(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of the short-time Fourier transform; the last frame is filled with silence."""
    count = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    signal = np.zeros((count - 1) * HOP + FRAME, dtype=np.float32)
    signal[: len(samples)] = (samples.astype(np.float32) - 128) / 128
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    parts = [np.abs(np.fft.rfft(frames[i : i + FRAMES_AT_ONCE] * _HANN, axis=1)).astype(np.float32) for i in range(0, count, FRAMES_AT_ONCE)]
    return np.concatenate(parts)


def peaks(spectrum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and bin of the spectral peaks, by time and then bin."""
    times, bins = [], []
    for low, high in zip(BANDS, BANDS[1:]):
        band = spectrum[:, low:high]
        top = band.argmax(axis=1)
        level = band[np.arange(len(band)), top]
        before = np.concatenate([[-1.0], level[:-1]])
        after = np.concatenate([level[1:], [-1.0]])
        at = np.flatnonzero((level > before) & (level >= after) & (level > 2 * band.mean(axis=1)))
        times.append(at)
        bins.append(top[at] + low)
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprint(payload: bytes) -> np.ndarray:
    """Time-coded hashes of the peak pairs, as 64-bit integers in order of time."""
    t, f = peaks(spectrogram(np.frombuffer(payload, dtype=np.uint8)))
    codes = []
    for step in range(1, FAN_OUT + 1):
        ahead = t[step:] - t[:-step]
        near = ahead <= AHEAD
        codes.append(((t[:-step] << 32) | (f[:-step] << 20) | (f[step:] << 8) | ahead)[near])
    return np.sort(np.concatenate(codes).astype(np.int64))


def _carried(df: DataFrame, carry: tuple[str, ...]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry]


def store_wav(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, ``n_bytes`` of the text in UTF-8, and ``media``: the padded bytes as a WAV file.

    A null text counts as empty and is stored as one block of zeros. Repeated rows are stored each.
    """
    rows = docs.select(*carry, docs[text].alias("__text"))
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                raw = [(t or "").encode("utf-8", "replace") for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(map(len, raw), pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())], names=[*carry, "n_bytes", "media"])

    return rows.mapInArrow(run, ", ".join([*_carried(docs, carry), "n_bytes long, media binary"]))


def read_wav(stored: DataFrame, *, carry: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Reads ``media`` back: its size and SHA-256, those of the payload, the CRC-32 of the payload's last block, and ``peaks``.

    ``peaks`` is an array of time-coded peak pairs, empty where the sound has no peaks. A null ``media`` gives nulls.
    """
    rows = stored.select(*carry, "media")
    n = len(carry)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "peaks"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def one(media: bytes | None) -> tuple:
        if media is None:
            return (None,) * len(names)
        payload = from_wav(media)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), fingerprint(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                read = [one(m.as_py()) for m in batch.column(n)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(list(c), k) for c, k in zip(zip(*read, strict=True), kinds, strict=True))], names=[*carry, *names])

    return rows.mapInArrow(run, ", ".join([*_carried(stored, carry), "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, peaks array<bigint>"]))
