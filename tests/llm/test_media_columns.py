import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm.common import stored
from skylattice.llm.media_columns import AHEAD, BANDS, FAN_OUT, FRAME, HOP, fingerprint, from_wav, padded, peaks, read_wav, spectrogram, store_wav, to_wav


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=700))
def test_wav_round_trip(raw):
    payload = padded(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw) and not any(payload[len(raw) :])
    assert from_wav(to_wav(payload)) == payload


def test_spectrogram_equals_plain_transform():
    x = np.random.default_rng(1).integers(0, 256, 1000).astype(np.uint8)
    got = spectrogram(x)
    signal = np.zeros((len(got) - 1) * HOP + FRAME)
    signal[:1000] = (x.astype(float) - 128) / 128
    for k, row in enumerate(got):
        assert np.allclose(row, np.abs(np.fft.rfft(signal[k * HOP : k * HOP + FRAME] * np.hanning(FRAME))), atol=1e-3)
    assert len(signal) >= 1000


def test_a_tone_has_its_peak_and_shifted_sound_the_same_pairs():
    t = np.arange(FRAME * 8)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 40 / FRAME) * (1 + np.sin(t / 300))).astype(np.uint8)
    assert 40 in peaks(spectrogram(tone))[1]
    sound = np.random.default_rng(2).integers(0, 256, FRAME * 64).astype(np.uint8)
    late = np.concatenate([np.full(HOP * 10, 128, np.uint8), sound])
    a, b = fingerprint(sound.tobytes()), fingerprint(late.tobytes())
    assert len(np.intersect1d(a + (10 << 32), b)) > 0.9 * len(a) > 0


def brute_fingerprint(payload):
    """Peaks and pairs from the definition, number by number."""
    spectrum = spectrogram(np.frombuffer(payload, dtype=np.uint8))
    found = []
    for low, high in zip(BANDS, BANDS[1:]):
        tops = []
        for frame in spectrum:
            best = low
            for k in range(low, high):
                if frame[k] > frame[best]:
                    best = k
            tops.append(best)
        for t, k in enumerate(tops):
            level = spectrum[t][k]
            before = spectrum[t - 1][tops[t - 1]] if t else -1
            after = spectrum[t + 1][tops[t + 1]] if t + 1 < len(tops) else -1
            if level > before and level >= after and level > 2 * spectrum[t][low:high].mean():
                found.append((t, k))
    found.sort()
    codes = []
    for i, (t, f) in enumerate(found):
        for u, g in found[i + 1 : i + 1 + FAN_OUT]:
            if u - t <= AHEAD:
                codes.append(t << 32 | f << 20 | g << 8 | u - t)
    return sorted(codes)


def test_peaks_and_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"some words and some words again " * 40, bytes(rng.integers(0, 256, 9000).astype(np.uint8)), "é日 prose, with a pause".encode() * 90 + b" " * 9000 + b"end" * 50]
    for raw in texts:
        assert fingerprint(padded(raw)).tolist() == brute_fingerprint(padded(raw))
    assert any(len(fingerprint(padded(raw))) > 50 for raw in texts)


def test_rows_come_back_from_a_written_table(spark):
    docs = spark.createDataFrame([(1, None), (2, "é" * 5000), (None, "x")], "doc_id long, text string")
    media = stored(store_wav(docs))
    assert sorted(map(str, read_wav(media).collect())) == sorted(map(str, read_wav(store_wav(docs)).collect()))


def test_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 5000), (3, "é" * 5000), (4, "x" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS media", "2 AS peaks")
    got = read_wav(store_wav(docs)).collect()
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()
        payload = padded(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes) == (zlib.crc32(payload[-64:]), len(payload) + 44)
        assert list(r.peaks) == fingerprint(payload).tolist()
    assert len({r.media_sha256 for r in got}) == 3
    assert read_wav(store_wav(docs.where("false"))).count() == 0
