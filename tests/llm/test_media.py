import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assayer.llm import media


def stored(df):
    return df.select("doc_id", media.as_wav(media.padded(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("media"))


def test_round_trip(spark, awkward, nothing):
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r.doc_id, set()).add((r.text or "").encode())
    got = media.audio_features(stored(awkward)).join(stored(awkward).select("doc_id", "media").distinct(), "doc_id").collect()
    for r in got:
        payloads = [t + b"\xff" * ((max(1, -(-len(t) // 576)) * 576) - len(t)) for t in texts[r.doc_id]]
        assert (r.payload_sha256, r.tail_crc32) in [(hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for p in payloads]
        with wave.open(io.BytesIO(bytes(r.media))) as f:
            assert f.readframes(f.getnframes()) in payloads
        table = pa.ipc.open_stream(bytes(r.tensors)).read_all()
        assert table["logmel"].type == media.TENSOR and table["end_s"][-1].as_py() > 0
    assert media.audio_features(stored(nothing)).count() == 0
    def wav(data, channels=1, width=1):
        sink = io.BytesIO()
        with wave.open(sink, "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(12_000)
            f.writeframes(data)
        return sink.getvalue()

    rows = [(1, b"no audio"), (2, None), (3, wav(bytes(64), 2)), (4, wav(bytes(64), 1, 2)), (5, wav(b"")), (6, wav(b"\x80" * 64)), (7, wav(bytes(64))[:-60])]
    broken = {r.doc_id: r for r in media.audio_features(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert [i for i, r in broken.items() if r.payload_sha256 is None] == [1, 2, 3, 4, 5]
    assert broken[6].payload_bytes == 64 and broken[7].payload_bytes == 4
    assert all(r.payload_bytes % 576 == 0 for r in got)
    clash = stored(awkward).selectExpr("*", "'mine' AS own", "1 AS segments")
    assert media.audio_features(clash).columns == ["doc_id", "own", *media.RESULTS]


def test_resampling_against_zero_stuffing():
    x = np.random.default_rng(1).normal(size=1000).astype(np.float32)
    taps = [media.phases(media.UP, media.DOWN, media.TAPS)[p][::-1] for p in range(media.UP)]
    h = np.empty(media.TAPS * media.UP, np.float64)
    for p in range(media.UP):
        h[p :: media.UP] = taps[p]
    up = np.zeros(len(x) * media.UP)
    up[:: media.UP] = x
    full = np.convolve(up, h)
    want = full[(media.TAPS - media.TAPS // 2 - 1) * media.UP :: media.DOWN][: len(x) * media.UP // media.DOWN]
    got = media.resample(x)
    n = min(len(got), len(want)) - media.TAPS
    assert np.allclose(got[:n], want[:n], atol=1e-4)


def test_blocks_and_hysteresis(monkeypatch):
    y = np.random.default_rng(2).normal(size=30_000).astype(np.float32)
    whole = media.log_mel(y, 8000)
    monkeypatch.setattr(media, "FRAMES_AT_ONCE", 7)
    parts = media.log_mel(y, 8000)
    assert np.allclose(whole[0], parts[0], atol=1e-5) and np.allclose(whole[1], parts[1])
    energy = np.array([0, 4, 4, 0, 5, 9, 4, 0, 0, 4, 4, 0], float)  # mean 2.83, standard deviation 2.79: low 2.83, high 4.23
    assert media.hysteresis(energy) == [(4, 7)]
    assert media.hysteresis(np.ones(5)) == [] and media.hysteresis(np.array([0.0, 9.0])) == [(1, 2)]


def test_segments_against_a_scan():
    rng = np.random.default_rng(5)
    for size in (1, 2, 17, 300):
        energy = np.cumsum(rng.normal(size=size))
        low, high = float(energy.mean()), float(energy.mean()) + 0.5 * float(energy.std())
        want, first = [], None
        for i, e in enumerate([*energy.tolist(), -np.inf]):
            if e > low and first is None:
                first = i
            elif e <= low and first is not None:
                want += [(first, i)] if max(energy[first:i]) > high else []
                first = None
        assert media.hysteresis(energy) == want


def test_bands_against_a_plain_transform():
    rate, n = 8000.0, media.FRAME
    y = np.random.default_rng(6).normal(size=3 * n).astype(np.float32)
    bands, energy = media.log_mel(y, rate)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n // 2 + 1), np.arange(n)) / n)
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), media.BANDS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    for i in range(len(bands)):
        frame = y[i * media.HOP : i * media.HOP + n].astype(np.float64)
        power = np.abs(turn @ (frame * window)) ** 2
        for b in range(media.BANDS):
            weight = [max(0, min((f - edges[b]) / (edges[b + 1] - edges[b]), (edges[b + 2] - f) / (edges[b + 2] - edges[b + 1]))) for f in np.arange(n // 2 + 1) * rate / n]
            assert abs(bands[i, b] - np.log10(np.dot(power, weight) + 1e-6)) < 1e-3
        assert abs(energy[i] - np.log10((frame**2).mean() + 1e-6)) < 1e-4
