"""numpy kernels for one channel or one small group; the callers bound what a group holds."""

from __future__ import annotations

import numpy as np

#: Hz
BANDS = {"delta": (1.0, 4.0), "theta": (4.0, 8.0), "beta": (15.0, 30.0), "gamma": (30.0, 90.0)}


def band_gain(n: int, fs: float, band: tuple[float, float], order: int = 4) -> np.ndarray:
    """Real gain at the rFFT frequencies of a Butterworth band-pass run forwards and backwards (bilinear transform)."""
    warp = lambda f: 2 * fs * np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-9)) / fs)
    w, lo, hi = warp(np.fft.rfftfreq(n, 1 / fs)), warp(np.float64(band[0])), warp(np.float64(band[1]))
    with np.errstate(divide="ignore", over="ignore"):
        x = (w**2 - lo * hi) / ((hi - lo) * w)
        return 1 / (1 + x ** (2 * order))


def envelope(v: np.ndarray, fs: float, band: tuple[float, float], pad: int | None = None) -> np.ndarray:
    """Natural log of the band's Hilbert amplitude, floored at 1e-6 of its median; ends are padded by odd reflection."""
    v = np.asarray(v, float)
    pad = min(len(v) - 1, int(3 * fs / band[0])) if pad is None else pad
    if len(v) < 2:
        return np.zeros(len(v))
    x = np.concatenate((2 * v[0] - v[pad:0:-1], v, 2 * v[-1] - v[-2 : -pad - 2 : -1]))
    n = len(x)
    s = np.zeros(n, complex)
    half = np.fft.rfft(x) * band_gain(n, fs, band)
    s[: len(half)] = 2 * half
    s[0] = half[0]
    if n % 2 == 0:
        s[n // 2] = half[-1]
    a = np.abs(np.fft.ifft(s))[pad : pad + len(v)]
    return np.log(a + 1e-6 * np.median(a) + np.finfo(float).tiny)


def window_powers(v: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies, and the powers of Hann windows that overlap by half (windows x frequencies); a shorter signal is one window."""
    v = np.asarray(v, float)
    size = min(size, len(v))
    w = np.hanning(size)
    at = np.arange(0, len(v) - size + 1, max(1, size // 2))
    x = v[at[:, None] + np.arange(size)]
    p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * w, axis=1)) ** 2
    return np.fft.rfftfreq(size, 1 / fs), p / (fs * (w**2).sum())


def welch(v: np.ndarray, fs: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and mean power of the windows."""
    f, p = window_powers(v, fs, size)
    return f, p.mean(0)


def between(t: np.ndarray, v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Linear interpolation of samples in order of ``t`` at ``at``, ends held; NaN if there are none."""
    if not len(t):
        return np.full(len(at), np.nan)
    p, q = np.searchsorted(t, at, "right") - 1, np.searchsorted(t, at, "left")
    p, q = np.where(p < 0, q, p), np.where(q == len(t), p, q)
    gap = t[q] - t[p]
    return np.where(gap > 0, v[p] + (v[q] - v[p]) * (at - t[p]) / np.where(gap > 0, gap, 1.0), v[p])


def low_pass(v: np.ndarray, fs: float, cut: float) -> np.ndarray:
    """Gain 1 / (1 + (f / cut) ** 32), by FFT with odd reflection at the ends: half at ``cut``, under a thousandth from 1.25
    times ``cut`` on."""
    v = np.asarray(v, float)
    if len(v) < 3:
        return v
    x = np.concatenate((2 * v[0] - v[:0:-1], v, 2 * v[-1] - v[-2::-1]))
    f = np.fft.rfftfreq(len(x), 1 / fs)
    with np.errstate(over="ignore"):
        return np.fft.irfft(np.fft.rfft(x) / (1 + (f / cut) ** 32), len(x))[len(v) - 1 : 2 * len(v) - 1]


def waveform_shape(w: np.ndarray, fs: float, recovery: int = 16) -> dict[str, float]:
    """G4 (own definitions): peak of largest size, trough after and tip before it of the other sign, half-peak crossings,
    value a fixed lag after the trough, slopes between them."""
    w = np.asarray(w, float)
    p = int(np.argmax(np.abs(w)))
    s = 1.0 if w[p] < 0 else -1.0
    tr = p + int(np.argmax(s * w[p:]))
    tip = int(np.argmax(s * w[: p + 1]))
    half = np.abs(w) >= abs(w[p]) / 2
    a, b = p, p
    while a > 0 and half[a - 1]:
        a -= 1
    while b < len(w) - 1 and half[b + 1]:
        b += 1
    r = min(len(w) - 1, tr + recovery)
    slope = lambda i, j: 0.0 if i == j else (w[j] - w[i]) / (j - i) * fs
    return {
        "peak_time_idx": p, "peak_val": w[p], "trough_time_idx": tr, "trough_val": w[tr], "tip_time_idx": tip, "tip_val": w[tip], "half_peak_pre_time_idx": a, "half_peak_post_time_idx": b,
        "recovery_time_idx": r, "recovery_val": w[r], "depolarisation_slope": slope(tip, p), "repolarisation_slope": slope(p, tr), "recovery_slope": slope(tr, r),
    }


def half_round_trip(v: np.ndarray) -> np.ndarray:
    """K5: through 16-bit floats and back."""
    with np.errstate(over="ignore"):
        return np.asarray(v, np.float32).astype(np.float16).astype(np.float32)


def logistic(x: np.ndarray, y: np.ndarray, lam: float, steps: int = 30) -> np.ndarray:
    """Weights, then the intercept, of two-class (0, 1) models with a ridge on the weights, by Newton's method; a step that
    would raise the loss is halved, so that separable classes end at finite weights.  Columns of ``y`` are targets that are
    fitted side by side, each with its own step; a ``y`` of one dimension gives weights of one."""
    many = y.reshape(len(y), -1)
    one = np.column_stack((x, np.ones(len(x))))
    ridge_on = np.r_[np.full(x.shape[1], float(lam)), 1e-9][:, None]

    def loss(w: np.ndarray) -> np.ndarray:
        z = one @ w
        return np.logaddexp(0, z).sum(0) - (many * z).sum(0) + (ridge_on * w * w).sum(0) / 2

    w = np.zeros((one.shape[1], many.shape[1]))
    now, live = loss(w), np.ones(many.shape[1], bool)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -500, 500)))
        curve = np.matmul((p * (1 - p)).T[:, None, :] * one.T, one) + np.diag(ridge_on[:, 0])
        slope = one.T @ (p - many) + ridge_on * w
        step = np.where(live, np.linalg.solve(curve, slope.T[:, :, None])[:, :, 0].T, 0.0)
        size = np.ones(many.shape[1])
        new = loss(w - size * step)
        while (worse := live & (new > now) & (size > 1e-6)).any():
            size[worse] /= 2
            new = loss(w - size * step)
        w, now = w - size * step, new
        live &= np.abs(step).max(0) >= 1e-9
        if not live.any():
            break
    return w if y.ndim > 1 else w[:, 0]


def logistics(x: np.ndarray, y: np.ndarray, used: np.ndarray, lam: float, steps: int = 30) -> np.ndarray:
    """``logistic`` of a stack of models: rows (model, row, column), their 0 and 1 (model, row) and whether a row is ``used``; weights,
    then the intercept, per model.  Models step side by side, and each leaves once it stands."""
    one = np.concatenate((x, np.ones((*x.shape[:2], 1))), axis=2) * used[..., None]
    y = y * used
    ridge_on = np.r_[np.full(x.shape[2], float(lam)), 1e-9]
    out = np.zeros((len(x), x.shape[2] + 1))

    def loss(one: np.ndarray, y: np.ndarray, used: np.ndarray, w: np.ndarray) -> np.ndarray:
        z = (one @ w[:, :, None])[:, :, 0]
        return (np.logaddexp(0, z) * used - y * z).sum(1) + (ridge_on * w * w).sum(1) / 2

    at, w = np.arange(len(x)), out.copy()
    now = loss(one, y, used, w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip((one @ w[:, :, None])[:, :, 0], -500, 500)))
        across = one.swapaxes(1, 2)
        curve = (across * (p * (1 - p))[:, None]) @ one + np.diag(ridge_on)
        slope = (across @ ((p - y) * used)[:, :, None])[:, :, 0] + ridge_on * w
        step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
        size = np.ones(len(at))
        new = loss(one, y, used, w - step)
        while (worse := np.flatnonzero((new > now) & (size > 1e-6))).size:
            size[worse] /= 2
            new[worse] = loss(one[worse], y[worse], used[worse], w[worse] - size[worse, None] * step[worse])
        w, now = w - size[:, None] * step, new
        out[at] = w
        live = np.abs(step).max(1) >= 1e-9
        if not live.any():
            break
        if not live.all():
            at, w, now, one, y, used = (v[live] for v in (at, w, now, one, y, used))
    return out
