"""Band-pass, mains hum, unmixing, thresholds and the chain of them, against definitions and planted sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modeloom.functions import fir, infomax, lines
from modeloom.functions.ica import two_gaussians
from modeloom.operators import artifacts, cleaning

FS = 128.0


@pytest.mark.parametrize("n", [5, 300, 5000])
def test_overlap_add_is_convolution(n):
    rng = np.random.default_rng(n)
    x, taps = rng.normal(size=(3, n)), fir.band_taps(1.0, 40.0, FS)
    half = len(taps) // 2
    at = np.clip(np.arange(n)[:, None] + half - np.arange(len(taps)), 0, n - 1)
    assert np.allclose(fir.bandpass(x, FS, 1.0, 40.0), x[:, at] @ taps, atol=1e-9)


def test_band_passes_and_stops():
    t = np.arange(2560) / FS
    wave = lambda f: np.sin(2 * np.pi * f * t)[None]
    middle = slice(640, -640)
    for f, gain in ((10.0, 1.0), (25.0, 1.0), (2.0, 0.0), (40.0, 0.0)):
        assert np.abs(fir.bandpass(wave(f), FS, 8.0, 30.0)[:, middle]).max() == pytest.approx(gain, abs=0.01)
    with pytest.raises(ValueError):
        fir.band_taps(8.0, 70.0, FS)


def test_tapers_concentrate_energy():
    own = lines.tapers(128, 4.0, 7)
    assert np.allclose(own @ own.T, np.eye(7), atol=1e-9)
    m = np.subtract.outer(np.arange(128), np.arange(128))
    inside = 2 * 4.0 / 128 * np.sinc(2 * 4.0 / 128 * m)
    share = np.diag(own @ inside @ own.T)
    assert share[0] > 0.999999 and (np.diff(share) < 1e-9).all() and share[-1] > 0.6


def test_amplitudes_are_a_regression():
    rng = np.random.default_rng(2)
    x, own, freqs = rng.normal(size=(4, 256)), lines.tapers(256, 3.0, 5), np.array([49.5, 50.0, 50.25])
    amplitude, f = lines.sinusoids(x, own, freqs, FS)
    for m in range(4):
        for j, freq in enumerate(freqs):
            spectra = (x[m] * own) @ np.exp(-2j * np.pi * np.arange(256) * freq / FS)
            gain = own.sum(axis=1)
            found = np.linalg.lstsq(gain[:, None].astype(complex), spectra, rcond=None)
            assert np.isclose(amplitude[m, j], found[0][0])
            rest = (np.abs(spectra - gain * found[0][0]) ** 2).sum()
            assert np.isclose(f[m, j], ((np.abs(spectra) ** 2).sum() - rest) / 2 / (rest / 8))


@pytest.mark.parametrize("freq, left", [(50.0, 0.03), (50.1, 0.1)])
def test_hum_goes_and_the_rest_stays(freq, left):
    rng, t = np.random.default_rng(3), np.arange(2500) / FS
    signal = np.stack([np.sin(2 * np.pi * 10 * t), 0.5 * np.sin(2 * np.pi * 21 * t + 1)]) + 0.1 * rng.normal(size=(2, 2500))
    hum = np.array([[0.8], [1.5]]) * np.sin(2 * np.pi * freq * t + np.array([[0.3], [2.0]]))
    clean = lines.without_line(signal + hum, FS, 50.0)
    assert np.sqrt(((clean - signal) ** 2).mean()) < left
    assert np.sqrt(((lines.without_line(signal, FS, 50.0) - signal) ** 2).mean()) < 0.03, "without hum next to nothing goes"
    assert lines.without_line(signal, FS, 70.0) is not None and np.array_equal(lines.without_line(signal, FS, 70.0), signal)
    short = signal[:, :20] + hum[:, :20]
    assert lines.without_line(short, FS, 50.0).shape == short.shape and np.array_equal(lines.without_line(short[:, :3], FS), short[:, :3])


def test_critical_value():
    rng = np.random.default_rng(4)
    k = 7
    num, den = rng.chisquare(2, 200_000) / 2, rng.chisquare(2 * k - 2, 200_000) / (2 * k - 2)
    assert np.mean(num / den > lines.critical(0.01, k)) == pytest.approx(0.01, abs=0.001)


def sources(n, seed=5):
    rng = np.random.default_rng(seed)
    return np.stack([rng.laplace(size=n), rng.uniform(-1, 1, n), np.sign(rng.normal(size=n)) + 0.05 * rng.normal(size=n), rng.laplace(size=n) ** 3, rng.normal(size=n)])


def test_infomax_recovers_heavy_and_light_tails():
    s = sources(6000)
    mixing = np.random.default_rng(6).normal(size=(5, 5))
    u = infomax.extended_infomax(mixing @ s) @ mixing @ s
    match = np.abs(np.corrcoef(u, s)[:5, 5:])
    assert (match.max(axis=0)[[0, 1, 2, 3]] > 0.97).all()
    w = infomax.extended_infomax(np.concatenate([mixing @ s, (mixing @ s)[:1]]))
    assert w.shape == (5, 6), "a channel that repeats another adds no component"
    assert infomax.extended_infomax(np.zeros((3, 10))).shape == (0, 3)


@pytest.mark.parametrize("seed", range(4))
def test_iterated_limits_are_those_of_one_array(spark, seed):
    rng = np.random.default_rng(seed)
    values = {"a": np.concatenate([rng.normal(0, 1, 300), rng.normal(6, 0.5, 60)]), "b": rng.exponential(size=200), "c": np.full(30, 2.0), "d": np.array([1.0, 5.0])}
    rows = spark.createDataFrame([(f, float(v)) for f, x in values.items() for v in x] + [("a", None)], "feature string, v double").repartition(5)
    found = artifacts.two_class_limits(rows)
    assert found == {f: pytest.approx(two_gaussians(x), rel=1e-6) for f, x in values.items()}


def test_chain_takes_a_planted_blink(spark):
    """A frontal source of rare large bursts goes, the rest stays; recordings without one lose little."""
    rng, n = np.random.default_rng(7), 128 * 24
    front = np.exp(-0.5 * np.arange(14)) + np.exp(-0.5 * np.arange(13, -1, -1))
    recordings, truth = [], {}
    for k in range(3):
        rest = rng.normal(size=(14, 13)) @ rng.laplace(size=(13, n))
        blink = np.zeros(n)
        for at in rng.integers(0, n - 60, 8):
            blink[at : at + 40] += np.hanning(40)
        truth[k] = (rest, 60 * front[:, None] * blink)
        recordings.append((k, (rest + truth[k][1]).tolist()))
    frame = spark.createDataFrame(recordings, "subject long, signal array<array<double>>")
    done = cleaning.clean_by_components(frame, artifacts.electrodes(spark), "subject", line=None, remove=1, epoch=128, fs=FS)
    for r in done.collect():
        rest, blink = (cleaning.filtered(spark.createDataFrame([(0, x.tolist())], frame.schema), 1.0, 51.2, None, fs=FS).first()["signal"] for x in truth[r["subject"]])
        assert len(r["removed"]) == 1
        left = np.array(r["signal"]) - np.array(rest)
        assert (left**2).sum() < 0.1 * (np.array(blink) ** 2).sum()


def test_epochs_and_odd_recordings(spark):
    x = np.random.default_rng(8).normal(size=(2, 100))
    (first, *_), _ = cleaning.epoch_moments(x, 40)
    own = x[0, :40]
    assert first == pytest.approx((((own - own.mean()) ** 4).mean() / own.var() ** 2 - 3, own.var(ddof=1)))
    assert [len(e) for e in cleaning.epoch_moments(x, None)] == [1, 1] and [len(e) for e in cleaning.epoch_moments(x, 40)] == [2, 2]
    odd = spark.createDataFrame([(1, [[1.0] * 50] * 14), (2, np.random.default_rng(9).normal(size=(14, 300)).tolist())], "subject long, signal array<array<double>>")
    done = {r["subject"]: r for r in cleaning.clean_by_components(odd, artifacts.electrodes(spark), "subject", low=8.0, high=30.0, fs=FS).collect()}
    assert len(done) == 2 and done[1]["removed"] == []
    none = cleaning.clean_by_components(odd.filter("subject = 3"), artifacts.electrodes(spark), "subject")
    assert none.count() == 0 and F.size("removed") is not None
