"""Media columns: audio stored as WAV, and features of the stored bytes.

`as_wav` wraps 8-bit samples in a RIFF/WAVE container with JVM functions. `audio_features` reads containers back and
computes, for each,

* a rational resampling by a polyphase windowed-sinc filter: one short filter for each output phase, no zero stuffing;
* overlapped Hann frames, their power spectra and log energies in triangular mel bands;
* segments by hysteresis: runs of frames whose energy stays over a low level and passes a high one somewhere.

Band energies are stored as Arrow fixed-shape tensors [FRAMES, BANDS], each with its time span, as one Arrow IPC stream for
each recording. Long recordings pass through the transforms block by block.

Defined results: a null or empty text is one padded block of 576 bytes. Equal bytes give equal features, so repeated rows
agree. A null id is kept, a table without rows gives none, other columns pass through `audio_features` untouched, but for
those with the very names of its results, which give way. A null or broken container gives null features, and so does one
that isn't mono 8-bit PCM or holds no sample.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, text_or_empty

RATE, UP, DOWN, TAPS = 12_000, 2, 3, 16
FRAME, HOP, BANDS, FRAMES = 256, 128, 24, 24
BLOCK = 576
FRAMES_AT_ONCE = 4096


def little_endian(value: Column) -> Column:
    """A 32-bit integer as four bytes, lowest first."""
    digits = F.lpad(F.hex(value), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, at, 2) for at in (7, 5, 3, 1)]))


def as_wav(payload: Column, rate: int = RATE) -> Column:
    """Mono 8-bit PCM in a RIFF container; the payload's bytes are the samples. Its length must be even."""
    size = F.octet_length(payload)
    form = struct.pack("<4sIHHIIHH4s", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data")
    return F.concat(F.unhex(F.lit(b"RIFF".hex())), little_endian(size + 36), F.unhex(F.lit((b"WAVE" + form).hex())), little_endian(size), payload)


def padded(data: Column, block: int = BLOCK) -> Column:
    """data with bytes 255 after it, up to a positive multiple of block."""
    size = F.octet_length(data)
    missing = F.greatest(F.ceil(size / block), F.lit(1)).cast("int") * block - size
    return F.concat(data, F.unhex(F.repeat(F.lit("FF"), missing)))


@lru_cache
def phases(up: int, down: int, taps: int) -> list[np.ndarray]:
    """For each output phase its filter over the input, latest sample last."""
    wide = max(up, down)
    size = taps * up
    t = np.arange(size) - (size - 1) / 2
    h = np.sinc(t / wide) * np.hanning(size + 2)[1:-1]
    h *= up / h.sum()
    return [np.ascontiguousarray(h[p::up][::-1].astype(np.float32)) for p in range(up)]


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """ceil(len(x) * up / down) samples at up / down times the rate."""
    n_out = -(-len(x) * up // down)
    y = np.empty(n_out, np.float32)
    before = taps // 2
    edge = np.concatenate([np.zeros(before, np.float32), x, np.zeros(taps + down, np.float32)])
    windows = sliding_window_view(edge, taps)
    for k in range(up):
        count = len(range(k, n_out, up))
        phase, first = (k * down) % up, (k * down) // up
        for at in range(0, count, 1 << 16):
            some = min(1 << 16, count - at)
            y[k::up][at : at + some] = windows[first + at * down :: down][:some] @ phases(up, down, taps)[phase]
    return y


@lru_cache
def mel_filters(rate: float, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0, mel(rate / 2), bands + 2) / 2595.0) - 1.0)
    at = np.fft.rfftfreq(frame, 1.0 / rate)
    rise = (at[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - at[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log band energies of overlapped frames, and each frame's log energy."""
    if len(y) < FRAME:
        y = np.concatenate([y, np.zeros(FRAME - len(y), np.float32)])
    frames = sliding_window_view(y, FRAME)[::HOP]
    window, filters = np.hanning(FRAME).astype(np.float32), mel_filters(rate)
    bands, energy = np.empty((len(frames), BANDS), np.float32), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        some = frames[at : at + FRAMES_AT_ONCE]
        spectrum = np.fft.rfft(some * window, axis=1)
        bands[at : at + len(some)] = np.log10((spectrum.real**2 + spectrum.imag**2) @ filters + 1e-6)
        energy[at : at + len(some)] = np.log10(np.einsum("ij,ij->i", some, some) / FRAME + 1e-6)
    return bands, energy


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs [first, end) of frames over the mean that reach half a standard deviation over it somewhere."""
    low = float(energy.mean())
    high = low + 0.5 * float(energy.std())
    over = np.concatenate(([0], (energy > low).astype(np.int8), [0]))
    step = np.diff(over)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    peaks = np.concatenate(([0], np.cumsum(energy > high)))
    keep = peaks[ends] > peaks[starts]
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS))


def tensors(bands: np.ndarray, rate: float) -> bytes:
    """Arrow IPC stream with columns start_s, end_s and logmel, a fixed-shape tensor; the last one is padded with its floor."""
    n = -(-len(bands) // FRAMES)
    full = np.full((n * FRAMES, BANDS), -6.0, np.float32)
    full[: len(bands)] = bands
    starts = np.arange(n) * (FRAMES * HOP / rate)
    ends = np.minimum(starts + ((FRAMES - 1) * HOP + FRAME) / rate, ((len(bands) - 1) * HOP + FRAME) / rate)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), FRAMES * BANDS)
    batch = pa.record_batch([pa.array(starts), pa.array(ends), pa.ExtensionArray.from_storage(TENSOR, storage)], names=["start_s", "end_s", "logmel"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue()


def samples(media: bytes) -> tuple[bytes, int]:
    """Sample bytes of a container as stored, and their rate; ValueError if it isn't mono 8-bit PCM with a sample at least."""
    with wave.open(io.BytesIO(media)) as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("mono 8-bit samples only")
        data, rate = f.readframes(f.getnframes()), f.getframerate()
    if not data:
        raise ValueError("no samples")
    return data, rate


def features(data: bytes, rate: int) -> tuple[bytes, list[dict]]:
    """Tensors, and segments with their time spans, of 8-bit samples."""
    y = resample((np.frombuffer(data, np.uint8).astype(np.float32) - 128.0) / 128.0)
    out_rate = rate * UP / DOWN
    bands, energy = log_mel(y, out_rate)
    spans = [{"start_s": a * HOP / out_rate, "end_s": ((b - 1) * HOP + FRAME) / out_rate} for a, b in hysteresis(energy)]
    return tensors(bands, out_rate), spans


RESULTS = ("payload_bytes", "payload_sha256", "tail_crc32", "tensors", "segments")
SPANS = "array<struct<start_s: double, end_s: double>>"


def audio_features(docs: DataFrame, media_col: str = "media") -> DataFrame:
    """docs, without the media, with payload_bytes, payload_sha256 and tail_crc32 of the samples read back, tensors and segments."""
    at = docs.columns.index(media_col)
    kept = [i for i, c in enumerate(docs.columns) if c != media_col and c.lower() not in RESULTS]
    names = [*[docs.columns[i] for i in kept], *RESULTS]
    types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                out: list[list] = [[] for _ in RESULTS]
                for value in batch.column(at):
                    row: tuple = (None,) * len(RESULTS)
                    if value.is_valid:
                        try:
                            data, rate = samples(value.as_py())
                        except (wave.Error, EOFError, ValueError):
                            pass
                        else:
                            row = (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), *features(data, rate))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[pa.array(x, t) for x, t in zip(out, types, strict=True)]], names=names)

    more = T.StructType.fromDDL(f"payload_bytes long, payload_sha256 string, tail_crc32 long, tensors binary, segments {SPANS}")
    return docs.mapInArrow(run, T.StructType([docs.schema.fields[i] for i in kept] + more.fields))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.encode(text_or_empty(), "UTF-8")
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(data).cast("long").alias("n_bytes"), as_wav(padded(data)).alias("media"))
    stored = docs.select("*", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    spans = F.transform("segments", lambda s: F.format_string("%.4f-%.4f", s["start_s"], s["end_s"]))
    feature = F.concat_ws(":", F.sha2("tensors", 256), F.size("segments").cast("string"), F.sha2(F.array_join(spans, ","), 256))
    return audio_features(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), F.size("segments").alias("n_segments"))
