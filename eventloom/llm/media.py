"""Media columns: a text's bytes as sound, and audio features of the stored sound.

Bytes, padded with 0 to a positive multiple of 64, are stored as 8-bit PCM in a WAV file and read back. Features: polyphase
resampling, overlapped frames through a mel filterbank as logarithms, pooled to a tensor of fixed shape, and hysteresis segments
of frame energy with their time spans. All is done in blocks at places that depend on the sound alone, so equal
texts have equal values and a very long one needs no more memory than its samples.
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
from pyspark.sql import functions as F

from .common import slices

RATE, UP, DOWN, TAPS = 16_000, 2, 3, 16
FRAME, HOP, MELS, SPANS = 256, 128, 16, 8
BLOCK = 2048
OUT = "doc_id long, n_bytes long, media binary, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, segments array<struct<start:double,end:double>>, tensor binary, spans array<struct<start:double,end:double>>, logmel array<float>"


def padded(data: bytes) -> bytes:
    return data + bytes(64 if not data else -len(data) % 64)


def stored_sound(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_sound(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def phases(up: int, down: int, taps: int) -> np.ndarray:
    """The low-pass filter dealt out to its phases: row p serves the outputs whose place times down leaves p when divided by up."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * np.hamming(n) * cut * up
    return np.ascontiguousarray(h.reshape(taps, up).T[:, ::-1]).astype(np.float32)


def resampled(samples: np.ndarray, start: int, stop: int, up: int = UP, down: int = DOWN, taps: int = TAPS, bank: np.ndarray | None = None) -> np.ndarray:
    """Outputs start to stop of the polyphase resampling of 8-bit samples; silence before and after them."""
    bank = phases(up, down, taps) if bank is None else bank
    at = np.arange(start, stop, dtype=np.int64) * down
    first = at // up - taps // 2 + 1
    lo, hi = int(first[0]), int(first[-1]) + taps
    part = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(samples))
    if a < b:
        part[a - lo : b - lo] = (samples[a:b].astype(np.float32) - 128) / 128
    windows = np.lib.stride_tricks.sliding_window_view(part, taps)
    out = np.empty(len(at), np.float32)
    for p in range(up):
        mine = np.flatnonzero(at % up == p)
        if len(mine):
            out[mine] = np.einsum("ij,j->i", windows[first[mine] - lo], bank[p])
    return out


def filterbank(rate: float, frame: int, mels: int) -> tuple[np.ndarray, np.ndarray]:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(frame, 1 / rate)
    up = (freq[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32), np.hanning(frame).astype(np.float32)


class Tools:
    """Filters that are the same for every sound; each task makes them once."""

    def __init__(self):
        self.rate = RATE * UP / DOWN
        self.phases = phases(UP, DOWN, TAPS)
        self.bank, self.window = filterbank(self.rate, FRAME, MELS)


def features(samples: np.ndarray, tools: Tools) -> tuple[int, list[tuple[float, float]], list[tuple[float, float]], np.ndarray]:
    """Frames, segments in seconds, the time spans of the tensor's rows, and the tensor: SPANS x MELS means of the log-mel values."""
    rate, bank, window = tools.rate, tools.bank, tools.window
    length = -(-len(samples) * UP // DOWN)
    n = max(1, -(-(length - FRAME) // HOP) + 1)
    span = np.minimum(np.arange(n) * SPANS // n, SPANS - 1)
    sums, counts, energy = np.zeros((SPANS, MELS)), np.bincount(span, minlength=SPANS), np.empty(n)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        sound = resampled(samples, a * HOP, (b - 1) * HOP + FRAME, bank=tools.phases)
        frames = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP] * window
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32) ** 2
        logs = np.log(power @ bank + 1e-6)
        energy[a:b] = np.log(power.sum(axis=1) + 1e-6)
        at = np.flatnonzero(np.diff(span[a:b], prepend=-1))
        sums[span[a:b][at]] += np.add.reduceat(logs, at, axis=0)
    ends = np.cumsum(counts)
    spans = [(round(int(x) * HOP / rate, 6), round(((int(y) - 1) * HOP + FRAME) / rate, 6)) if y > x else (0.0, 0.0) for x, y in zip(ends - counts, ends, strict=True)]
    return n, segments(energy, HOP / rate), spans, (sums / np.maximum(counts, 1)[:, None]).astype(np.float32)


def segments(energy: np.ndarray, step: float) -> list[tuple[float, float]]:
    """A segment begins where energy reaches mean + deviation / 4 and lasts until it falls below mean - deviation / 4."""
    mean, by = energy.mean(), energy.std() / 4 + 1e-9
    says = np.where(energy >= mean + by, 1, np.where(energy < mean - by, -1, 0))
    last = np.maximum.accumulate(np.where(says != 0, np.arange(len(says)), -1))
    on = np.where(last >= 0, says[last], -1) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(round(a * step, 6), round(b * step, 6)) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def as_tensor(values: np.ndarray) -> bytes:
    """An Arrow tensor message: shape, type and values."""
    out = pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(values, dim_names=["span", "mel"]), out)
    return out.getvalue().to_pybytes()


def from_tensor(message: bytes) -> np.ndarray:
    return pa.ipc.read_tensor(pa.BufferReader(message)).to_numpy()


def sounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tools = Tools()
    for batch in slices(batches):
        ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
        out: list[dict] = []
        for i, text in zip(ids, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            data = text or b""
            media = stored_sound(padded(data))
            payload = read_sound(media)
            n, loud, spans, mel = features(np.frombuffer(payload, np.uint8), tools)
            tensor = as_tensor(mel)
            out.append(
                {"doc_id": i, "n_bytes": len(data), "media": media, "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:])}
                | {"n_frames": n, "segments": [{"start": a, "end": b} for a, b in loud], "tensor": tensor, "spans": [{"start": a, "end": b} for a, b in spans], "logmel": from_tensor(tensor).ravel().tolist()}
            )
        yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("n_frames", pa.int64())]
    + [("segments", pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))), ("tensor", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))), ("logmel", pa.list_(pa.float32()))]
)


def media_columns(docs: DataFrame) -> DataFrame:
    """Each text's sound and its features, a row for each row of docs.

    tensor is an Arrow tensor of SPANS x MELS log-mel means (see from_tensor()), spans the time of each of its rows (0 to 0 where the sound has
    fewer frames than rows), and logmel its values as read back. segments are all stretches of sound above the threshold. A null text counts as empty: 64 bytes of 0. Rows that repeat or
    have no doc_id come out as they are; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sounds, OUT)


def op9_media(spark, sf_dir: str) -> DataFrame:
    out = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["start"], s["end"]))
    values = F.transform("logmel", lambda x: F.format_string("%.2f", x))
    feature = F.concat_ws("|", F.concat(F.lit("frames="), "n_frames"), F.concat(F.lit("segments="), F.size("segments"), F.lit(":"), F.concat_ws(",", spans)), F.concat(F.lit("logmel="), F.concat_ws(",", values)))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
