import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from modeloom.functions import features, filters, ica, information, smvmd, splits, wavelets
from modeloom.sources import matfile

RNG = np.random.default_rng(0)


def tones(freqs, n=640, channels=4, fs=128.0):
    t = np.arange(n) / fs
    return np.stack([sum((1 + 0.1 * c) * np.sin(2 * np.pi * f * t + c) for f in freqs) for c in range(channels)])


@pytest.mark.parametrize("alpha", [1000.0, 2000.0])
def test_three_tones_give_three_modes(alpha):
    r = smvmd.decompose(tones([6, 20, 45]), 128.0, smvmd.Settings(alpha=alpha))
    assert len(r.freqs) == 3
    assert np.allclose(np.sort(r.freqs), [6, 20, 45], atol=0.05)  # the other tones pull a little at each centre
    x = tones([6, 20, 45])
    assert np.allclose(r.modes.sum(axis=0) + r.residual, x)
    assert r.error < 0.01


def direct_centre(x, k, alpha):
    """The fixed point on the spectra of all channels, step by step."""
    n = x.shape[1]
    r, axis, w = np.fft.fft(x, axis=1)[:, : n // 2 + 1], np.fft.fftfreq(n)[: n // 2 + 1], (k + 1) / 21 * 0.5
    for _ in range(500):
        u = r / (1 + 2 * alpha * (axis - w) ** 2)
        new = np.clip((axis * np.abs(u) ** 2).sum() / ((np.abs(u) ** 2).sum() + 1e-12), 1e-6, 0.5 - 1e-6)
        done, w = abs(new - w) < 1e-10, new
        if done:
            break
    return w


@pytest.mark.parametrize("n", [64, 65, 640])
def test_first_centre_by_direct_iteration(n):
    x = RNG.normal(size=(3, n))
    assert np.isclose(smvmd.decompose(x, 1.0).freqs[0], direct_centre(x, 0, 2000.0), atol=1e-9)


def test_mode_with_dual_step_of_nearly_nothing_is_the_same():
    x = tones([10, 30])
    a, b = (smvmd.decompose(x, 128.0, smvmd.Settings(tau=t)) for t in (0.0, 1e-12))
    assert len(a.freqs) == len(b.freqs) and np.allclose(a.freqs, b.freqs, atol=1e-6)


def test_silence_and_odd_lengths():
    assert len(smvmd.decompose(np.zeros((2, 64)), 128.0).freqs) == 0
    r = smvmd.decompose(RNG.normal(size=(2, 65)), 128.0)
    assert r.modes.shape[1:] == (2, 65) and np.isfinite(r.modes).all()


def brute_features(x, fs):
    n = len(x)
    w = x * np.hamming(n)
    spectrum = np.abs(np.fft.rfft(w - w.mean())) ** 2 / (fs * n)
    spectrum[1 : (n + 1) // 2] *= 2
    sigma = 1.06 * x.std() * n**-0.2
    k = np.exp(-0.5 * ((x[:, None] - x[None, :]) / sigma) ** 2) / (np.sqrt(2 * np.pi) * sigma)
    lags = [np.mean(np.diag(k, 1)), sum(np.diag(k, l).sum() for l in range(1, n)) / n**2]
    return [x.std(), x.var(), np.sqrt((x**2).mean()), np.subtract(*np.percentile(x, [75, 25])), np.sqrt(np.abs(x)).sum(), spectrum.mean(), np.log10(np.sqrt((np.diff(x) ** 2).sum())), k.sum() / n**2, lags[0] - lags[1]]


@pytest.mark.parametrize("n", [15, 16, 640, 639])
def test_features_by_definition(n):
    x = RNG.normal(size=(3, n))
    assert np.allclose(features.nine(x, 128.0), [brute_features(r, 128.0) for r in x])


def test_features_of_flat_and_broken_signals():
    assert (features.nine(np.zeros((1, 10)), 1.0) == 0).all()
    flat = features.nine(np.full((1, 10), 3.0), 1.0)[0]
    assert flat[[0, 1, 3, 6, 7, 8]].tolist() == [0] * 6 and np.isclose(flat[2], 3)
    assert np.isfinite(features.nine(np.array([[1.0, np.nan, np.inf, 2.0]]), 1.0)).all()


def test_integration_weighs_by_energy():
    f, e = RNG.normal(size=(3, 2, 9)), RNG.uniform(1, 2, (3, 2))
    assert np.allclose(features.integrate(f, e).reshape(2, 9), (f * e[:, :, None]).sum(0) / e.sum(0)[:, None])
    assert features.integrate(np.zeros((0, 2, 9)), np.zeros((0, 2))).tolist() == [0] * 18


def response(sections, freq, fs):
    z = np.exp(2j * np.pi * freq / fs)
    return np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[4] / z + s[5] / z**2) for s in sections])


def test_bandpass_response():
    s = filters.butterworth_bandpass(1, 30, 128.0)
    assert s.shape == (4, 6)
    for edge in (1, 30):
        assert np.isclose(abs(response(s, edge, 128.0)) ** 2, 0.5, atol=1e-6)
    assert abs(response(s, 0.05, 128)) < 1e-4 and abs(response(s, 60, 128)) < 1e-3 and abs(response(s, 8, 128)) > 0.99


def test_filters_keep_phase_and_stop_lines():
    t = np.arange(4096) / 128
    x = np.stack([np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 50 * t)])
    y = filters.bandpass(x, 128.0, 0.5, 30)  # what the ends set off takes seconds to fade
    assert np.abs(y[0] - x[0])[1500:-1500].max() < 1e-3 and np.abs(y[1])[1500:-1500].max() < 1e-3
    z = filters.stop_band(x, 128.0)
    assert np.abs(z[1])[300:-300].max() < 0.05 and np.abs(z[0] - x[0])[300:-300].max() < 0.05
    assert (filters.stop_band(x, 90.0) == x).all()


@given(st.integers(1, 300))
@settings(max_examples=30, deadline=None)
def test_wavelet_steps_undo_each_other(n):
    x = np.random.default_rng(n).normal(size=n)
    a, d = wavelets.step(x)
    assert len(a) == len(d) == (n + 17) // 2
    assert np.allclose(wavelets.unstep(a, d)[:n], x)


def test_coiflet_is_orthonormal():
    h = wavelets.COIF3
    assert np.isclose(h.sum(), np.sqrt(2)) and all(np.isclose((h[: len(h) - 2 * k] * h[2 * k :]).sum(), float(k == 0), atol=1e-10) for k in range(9))


def test_sure_threshold_by_definition():
    for n in (1, 5, 64):
        c = RNG.normal(size=n)
        sigma = np.median(np.abs(c)) / 0.6745
        a = np.sort(np.abs(c) / sigma)
        risk = [n - 2 * (a <= t).sum() + (np.minimum(a, t) ** 2).sum() for t in a]
        assert np.isclose(wavelets.sure_threshold(c), a[int(np.argmin(risk))] * sigma)
    assert wavelets.sure_threshold(np.zeros(4)) == 0


def test_denoising_takes_out_noise():
    t = np.linspace(0, 1, 1024)
    clean = np.sin(2 * np.pi * 3 * t)
    noisy = clean + 0.3 * RNG.normal(size=1024)
    assert ((wavelets.denoise(noisy) - clean) ** 2).mean() < 0.5 * ((noisy - clean) ** 2).mean()


def test_ica_finds_sources():
    t = np.arange(4000) / 128
    s = np.stack([np.sin(2 * np.pi * 5 * t), np.sign(np.sin(2 * np.pi * 3 * t)), RNG.laplace(size=4000)])
    sources, mixing = ica.fast_ica(RNG.normal(size=(3, 3)) @ s)
    c = np.abs(np.corrcoef(np.concatenate([s, sources]))[:3, 3:])
    assert (c.max(axis=1) > 0.95).all() and mixing.shape == (3, 3)


def test_two_gaussians_border():
    v = np.concatenate([RNG.normal(0, 1, 500), RNG.normal(10, 1, 500)])
    assert 3 < ica.two_gaussians(v) < 7
    assert ica.two_gaussians(np.array([1.0, 1.0])) == 1.0


def test_components_of_many_recordings_are_those_of_each():
    rng = np.random.default_rng(8)
    x = rng.laplace(size=(60, 4, 16))
    x[3], x[7, 2], x[9, 1] = 0, 0, x[9, 0]
    together = ica.without_artifacts_of_many(x)
    assert np.allclose(together, [ica.without_artifacts(r) for r in x], atol=1e-9) and not together[3].any()
    for r, sources, mixing in zip(x, *ica.fast_ica_of_many(x), strict=True):
        assert np.allclose(mixing @ sources, r - r.mean(axis=1, keepdims=True), atol=1e-9)
        assert len(sources) == np.linalg.matrix_rank(r - r.mean(axis=1, keepdims=True)) and np.allclose(sources @ sources.T / 16, np.eye(len(sources)), atol=1e-6)


def test_information_of_dependent_and_independent():
    x = RNG.normal(size=800)
    y = 0.9 * x + np.sqrt(1 - 0.81) * RNG.normal(size=800)
    assert abs(information.continuous(x, y) - (-0.5 * np.log(1 - 0.81))) < 0.15
    assert information.continuous(x, RNG.normal(size=800)) < 0.1
    assert abs(information.with_class(x, (x > 0).astype(int)) - np.log(2)) < 0.1
    assert np.isclose(information.digamma(np.array([1.0]))[0], -0.5772156649, atol=1e-9)


def test_greedy_choice_prefers_the_unlike():
    assert information.greedy(np.array([1.0, 0.9, 0.5]), np.array([[1, 0.95, 0], [0.95, 1, 0], [0, 0, 1.0]])) == [0, 2, 1]


def test_splits_cover_and_keep_groups():
    y, g = np.repeat([0, 1], [60, 40]), np.repeat(np.arange(20), 5)
    f = splits.stratified(y, 10)
    assert all((y[f == k] == 0).sum() == 6 and (y[f == k] == 1).sum() == 4 for k in range(10))
    for fold in (splits.grouped(g, 4), splits.stratified_grouped(y, g, 4)):
        assert all(len(set(fold[g == k])) == 1 for k in range(20)) and len(set(fold)) == 4


def test_group_folds_of_large_tables_tell_small_spreads_apart():
    counts = np.random.default_rng(7).binomial(51_429, 0.5, 14)
    table = np.stack([counts, 51_429 - counts], axis=1)
    held, total, wanted = np.zeros((5, 2)), table.sum(axis=0), {}
    for g in sorted(range(14), key=lambda g: (-abs(int(table[g, 0]) - int(table[g, 1])), g)):
        spread = lambda i: np.mean([np.std([*held[:i, c], held[i, c] + table[g, c], *held[i + 1 :, c]]) / total[c] for c in (0, 1)])
        wanted[g] = min(range(5), key=lambda i: (round(spread(i), 9), held[i].sum(), i))  # noqa: B023
        held[wanted[g]] += table[g]
    found = splits.stratified_grouped(np.repeat(np.tile([0, 1], 14), table.ravel()), np.repeat(np.arange(14), 51_429), 5)
    assert dict(zip(np.repeat(np.arange(14), 51_429).tolist(), found.tolist(), strict=True)) == wanted


def test_mat_files_round_trip():
    x = RNG.normal(size=(3, 7))
    for compress in (False, True):
        back = matfile.read(matfile.write({"a": x, "b": x.astype("i2")}, compress))
        assert np.array_equal(back["a"], x) and np.array_equal(back["b"], x.astype("i2"))
    with pytest.raises(ValueError):
        matfile.read(b"short")
