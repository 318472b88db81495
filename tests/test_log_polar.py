"""The log-polar resampling, its profiles and the feature of 45 values, against plain loops."""

import numpy as np

from palimpsest.functions import log_polar as L
from palimpsest.operators import matching


def plain(image, radii, centred):
    h, w = image.shape
    m = radii / (np.log(radii) - np.log(2) / 2)
    out = np.zeros((180, radii))
    for i in range(180):
        for j in range(radii):
            r, t = np.exp(j / m), 2 * np.pi * i / 180
            y = int(np.rint(round((h // 2 if centred else 0) + r * np.sin(t), 9)))
            x = int(np.rint(round((w // 2 if centred else 0) + r * np.cos(t), 9)))
            if 0 <= y < h and 0 <= x < w:
                out[i, j] = image[y, x]
    return out


def test_samples_and_profiles():
    r = np.random.default_rng(1)
    for shape, radii, centred in (((16, 16), 8, True), ((16, 9), 8, False), ((5, 7), 4, True)):
        stack = r.random((3, *shape))
        got = L.log_polar(stack, radii, centred)
        for a, b in zip(stack, got, strict=True):
            assert (plain(a, radii, centred) == b).all()
    assert np.allclose(L.profiles(stack, 4), [plain(a, 4, True).sum(axis=0) for a in stack])


def test_feature_of_45_rays():
    r = np.random.default_rng(2)
    block = r.integers(0, 256, (16, 16)).astype(float)
    spectrum = np.abs(np.fft.fft2(block))[:, :9]
    lp = plain(spectrum, 8, False)
    want = []
    for k in range(45):
        want.append(sum(np.log(lp[k + 2 + 90 * half, j]) for half in (0, 1) for j in range(8) if lp[k + 2 + 90 * half, j] > 1e-9))
    got = L.fourier_mellin(block)
    assert got.shape == (45,) and np.allclose(got, want)
    assert np.allclose(L.fourier_mellin(np.roll(block, (3, 5), axis=(0, 1))), got)  # a shift leaves magnitudes
    assert np.isfinite(L.fourier_mellin(np.zeros((8, 8)))).all()


def test_criteria_of_stacks_are_those_of_single_pairs():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 256, (2, 6, 8, 8)).astype(float)
    b[0], a[1], b[2] = a[0], 5.0, np.roll(a[2], (2, 3), axis=(0, 1))
    for kind, measure in matching.CRITERIA.items():
        whole = measure(a, b)
        assert np.allclose(whole, [measure(a[i : i + 1], b[i : i + 1])[0] for i in range(6)]) and np.isclose(whole[0], 1), kind
    assert np.isclose(matching.phase_peaks(a, b)[2], 1) and matching.correlations(a, b)[1] == 0
    p, q = (np.abs(np.fft.fft(plain(x, 8, True).sum(axis=0)))[:5] for x in (a[3], b[3]))
    assert np.isclose(L.profile_correlation(a, b)[3], p @ q / np.sqrt(p @ p * (q @ q)))
    turned = np.rot90(a[4][1:, 1:])  # about the middle pixel
    other = np.zeros((8, 8))
    other[1:, 1:] = turned
    own = np.zeros((8, 8))
    own[1:, 1:] = a[4][1:, 1:]
    assert L.profile_correlation(own[None], other[None])[0] > 0.999
