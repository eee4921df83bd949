"""Filters along the last axis and the scoring of one window, in numpy; operators/smoothing.py, windows.py and landmarks.py apply them."""

from __future__ import annotations

from math import factorial

import numpy as np


def _bilinear(poles: np.ndarray, cutoff: float, fs: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 a1 a2) of an all-pole low-pass, unit gain at zero."""
    warped = 2 * fs * np.tan(np.pi * cutoff / fs)
    z = (2 * fs + poles * warped) / (2 * fs - poles * warped)
    upper = z[z.imag > 1e-12]
    out = []
    for p in upper:
        a1, a2 = -2 * p.real, abs(p) ** 2
        gain = (1 + a1 + a2) / 4
        out.append((gain, 2 * gain, gain, a1, a2))
    for p in z[np.abs(z.imag) <= 1e-12].real:
        gain = (1 - p) / 2
        out.append((gain, gain, 0.0, -p, 0.0))
    return np.array(out)


def bessel_sections(order: int, cutoff: float, fs: float) -> np.ndarray:
    """Phase-normalised Bessel low-pass from the roots of the reverse Bessel polynomial."""
    c = [factorial(2 * order - k) / (2 ** (order - k) * factorial(k) * factorial(order - k)) for k in range(order, -1, -1)]
    poles = np.roots(c) / c[-1] ** (1 / order)
    return _bilinear(poles, cutoff, fs)


def butterworth_sections(order: int, cutoff: float, fs: float) -> np.ndarray:
    k = np.arange(order)
    return _bilinear(np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order)), cutoff, fs)


def impulse_response(sections: np.ndarray, n: int) -> np.ndarray:
    """First n samples of the sections' joint response, by multiplying their spectra."""
    size = 1 << (4 * n - 1).bit_length()
    z = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    h = np.ones_like(z)
    for b0, b1, b2, a1, a2 in sections:
        h *= (b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z)
    return np.fft.irfft(h, size)[:n]


def causal_filter(x: np.ndarray, sections: np.ndarray, fs: float, memory_s: float = 0.25) -> np.ndarray:
    """Filtered from zero state: convolution with the response, cut where it has died away."""
    n = x.shape[-1]
    if n == 0:
        return x
    h = impulse_response(sections, max(8, int(memory_s * fs)))
    size = 1 << (n + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[..., :n]


def zero_phase_filter(x: np.ndarray, sections: np.ndarray, fs: float) -> np.ndarray:
    """Forward and backward, ends continued by odd reflection; under 8 samples unchanged."""
    if x.shape[-1] < 8:
        return x
    n = min(x.shape[-1] - 1, max(1, int(0.25 * fs)))
    ahead, behind = 2 * x[..., :1] - x[..., n:0:-1], 2 * x[..., -1:] - x[..., -2 : -n - 2 : -1]
    wide = np.concatenate([ahead, x, behind], -1)
    once = causal_filter(wide - wide[..., :1], sections, fs) + wide[..., :1]
    back = causal_filter(once[..., ::-1] - once[..., -1:], sections, fs)[..., ::-1] + once[..., -1:]
    return back[..., n : n + x.shape[-1]]


def score_landmarks(features: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Three ordered fractions of each window (..., rows, points) from a small convolutional network's weights."""
    x = features.astype(np.float64)
    for i in range(4):
        w, b = weights[f"conv{i}_w"], weights[f"conv{i}_b"]
        k = w.shape[2] // 2
        frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, [(0, 0)] * (x.ndim - 1) + [(k, k)]), w.shape[2], -1)
        x = np.moveaxis(np.tensordot(frames, w, axes=([-3, -1], [1, 2])), -1, -2) + b[:, None]
        x = (x - x.mean(-1, keepdims=True)) / (x.std(-1, keepdims=True) + 1e-5)
        x = x / (1 + np.exp(-x))
    h = x.mean(-1) @ weights["dense0_w"].T + weights["dense0_b"]
    h = h / (1 + np.exp(-h))
    return np.sort(1 / (1 + np.exp(-(h @ weights["dense1_w"].T + weights["dense1_b"]))), -1)
