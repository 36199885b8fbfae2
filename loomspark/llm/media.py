"""Operator 8: audio columns. Texts as lossless WAV samples, short-time spectra and spectral-peak fingerprints.

A text's UTF-8 bytes, padded with bytes 32 to a positive multiple of ``BLOCK``, become the unsigned 8-bit samples of a
mono WAV file written by the ``wave`` module. ``read_wav`` opens the stored file again; every feature is computed from
the samples that come back. The short-time Fourier transform has frames of ``FRAME`` samples under a Hann window that
overlap by two thirds; as many bytes 32 before and after let the edges count in full. A frame's peaks are its
``PEAKS`` strongest local maxima over frequency. Fingerprints pair each peak with the peaks of the next ``FAN_OUT``
frames (anchor frequency, target frequency, frame distance), each coded with the anchor's time into one long.

Null text counts as empty; the empty text is one block of bytes 32, which has no peak. Equal texts, repeated rows and rows
with a null id give equal values; of equally strong peaks the lower frequency comes first; very long texts are transformed
in parts; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 192
RATE = 8000
FRAME = 192
HOP = FRAME // 3
PEAKS = 2
FAN_OUT = 2
#: Frames that are transformed at once.
PART = 8192

SCHEMA = "doc_id bigint, n_bytes bigint, media binary, payload binary, fingerprints array<bigint>, feature string"


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float64)


def spectrogram(samples: bytes) -> Iterator[np.ndarray]:
    """Magnitudes of the short-time Fourier transform in parts of up to ``PART`` frames, one row a frame."""
    pad = b" " * (FRAME - HOP)
    x = np.frombuffer(pad + samples + pad, dtype=np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, len(frames), PART):
        part = frames[at : at + PART].astype(np.float64)
        yield np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * _WINDOW, axis=1))


def spectral_peaks(magnitudes: np.ndarray) -> np.ndarray:
    """For each frame the frequencies of its strongest local maxima, 0 where there are fewer."""
    inner = magnitudes[:, 1:-1]
    # Rounding of a still frame is no peak.
    strength = np.where((inner > magnitudes[:, :-2]) & (inner >= magnitudes[:, 2:]) & (inner > 1e-6), inner, 0.0)
    out = np.zeros((len(strength), PEAKS), dtype=np.int64)
    rows = np.arange(len(strength))
    for k in range(PEAKS):
        best = strength.argmax(axis=1)
        out[:, k] = np.where(strength[rows, best] > 0, best + 1, 0)
        strength[rows, best] = 0.0
    return out


def fingerprints(samples: bytes, fan_out: int = FAN_OUT) -> np.ndarray:
    """Sorted longs ``time << 32 | f_anchor << 20 | f_target << 8 | distance``."""
    peaks = np.concatenate([spectral_peaks(m) for m in spectrogram(samples)])
    codes = []
    for d in range(1, min(fan_out, len(peaks) - 1) + 1):
        time = np.arange(len(peaks) - d, dtype=np.int64) << 32
        for i in range(PEAKS):
            for j in range(PEAKS):
                anchor, target = peaks[:-d, i], peaks[d:, j]
                there = (anchor > 0) & (target > 0)
                codes.append((time | anchor << 20 | target << 8 | d)[there])
    return np.sort(np.concatenate(codes))


def encode_text(text: str) -> tuple[int, bytes, bytes, np.ndarray, str]:
    raw = text.encode("utf-8")
    padded = raw + b" " * ((-len(raw)) % BLOCK if raw else BLOCK)
    media = write_wav(padded)
    back = read_wav(media)
    codes = fingerprints(back)
    return len(raw), media, back, codes, hashlib.blake2b(codes.astype("<i8").tobytes(), digest_size=16).hexdigest()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("fingerprints", pa.list_(pa.int64())), ("feature", pa.string())])
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        rows, held, start = [], 0, 0
        for i, text in enumerate(texts):
            rows.append(encode_text(text.as_py() or ""))
            held += len(rows[-1][2])
            if held >= 1 << 22 or i + 1 == len(texts):
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), pa.array(list(cols[3]), pa.list_(pa.int64())), pa.array(cols[4], pa.string())], schema=schema)
                rows, held, start = [], 0, i + 1


def text_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its WAV file, the payload read back from it, fingerprints and their digest."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode, SCHEMA)


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of ``text_to_media``; hashes are computed JVM-side from the stored columns."""
    m = text_to_media(docs)
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("fingerprints").cast("long").alias("n_fingerprints"),
    )
