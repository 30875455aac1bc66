"""Synthetic signals, rendered from their parameters by closed formulas: tracks, pulses, bands, shapes, dispersed bursts.

A site is a plain dict of numbers, drawn from a seed alone, so that a catalogue can be checked by drawing again. Signals
are ON-only: one constant amplitude in the observations of the pattern, nothing elsewhere.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np

# Observations that carry the signal, by pattern; ranges that sites are drawn from.
PATTERNS = {"3on": (0, 2, 4), "2on_02": (0, 2), "2on_04": (0, 4), "2on_24": (2, 4), "1on_0": (0,), "1on_2": (2,), "1on_4": (4,)}
EXCURSION, SINE_AMPLITUDE, SINE_CYCLES = (0.05, 0.40), (0.05, 0.20), (2.0, 5.0)
PULSES, DUTY, LEAST_PULSE = (2.0, 6.0), (0.30, 0.60), 1.5
BAND_WIDTH, SNR_RANGE = (0.1, 0.5), (5.0, 50.0)
DRIFT_MEDIAN, DRIFT_DEX, DRIFT_ZERO = 0.3, 0.5, 0.05
SCATTER_WIDTH, SCINT_DEPTH, SCINT_SHARE = (0.5, 2.0), (0.2, 0.8), 0.5
FRINGES, FRINGE_FLOOR, BAND_SHARE = (1e-3, 30.0), 0.1, (0.3, 1.0)
DISPERSION = 4.148808e3  # seconds · MHz^2 per unit of dispersion measure
NAMES = ("narrowband_drift", "narrowband_accel", "narrowband_sine", "narrowband_pulsed", "wideband_continuous", "wideband_pulsed", "smiley_face", "random_2d")


def canonical_json(obj: object) -> str:
    """JSON with sorted keys and plain numbers: equal for equal content."""
    return json.dumps(json.loads(json.dumps(obj, default=lambda o: o.tolist() if hasattr(o, "tolist") else str(o))), sort_keys=True)


def hash_seed(*parts: object) -> int:
    """The first four bytes, big-endian, of the SHA-256 of the parts joined by bars."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:4], "big")


def sample_site(name: str, seed: int, channels: int, bins: int, n_obs: int = 6) -> dict:
    """The parameters of one signal in windows of `channels`, observations of `bins` time steps."""
    if name not in NAMES:
        raise ValueError(f"unknown morphology {name!r}; one of {', '.join(NAMES)}")
    rng = np.random.default_rng(seed)
    whole = bins * n_obs
    site: dict = {"morphology": name, "width": float(rng.uniform(1.0, 3.0)), "profile": str(rng.choice(["gaussian", "sinc2", "lorentzian", "voigt"]))}
    if name.startswith("wideband"):
        site |= {"profile": "box", "width": float(rng.uniform(*BAND_WIDTH) * channels)}
    if name in ("narrowband_drift", "narrowband_pulsed"):
        rate = 0.0 if rng.random() < DRIFT_ZERO else float(DRIFT_MEDIAN * 10 ** (DRIFT_DEX * rng.normal()))
        site |= {"drift": float(np.clip(rate, 0, 0.8 * channels / whole)) * (1 if rng.random() < 0.5 else -1)}
    if name == "narrowband_accel":
        excursion = rng.uniform(*EXCURSION) * channels
        site |= {"accel": float(2 * excursion / whole**2) * (1 if rng.random() < 0.5 else -1)}
    if name == "narrowband_sine":
        site |= {"amplitude": float(rng.uniform(*SINE_AMPLITUDE) * channels), "cycles": float(rng.uniform(*SINE_CYCLES))}
    if name.endswith("pulsed"):
        period = bins / rng.uniform(*PULSES)
        site |= {"period": float(period), "pulse": float(max(LEAST_PULSE, rng.uniform(*DUTY) * period)), "phase": float(rng.uniform(0, period))}
    if name == "random_2d":
        site |= {"harmonics": [float(x) for x in rng.normal(0, 0.15, 6)]}
    if site["profile"] in ("lorentzian", "voigt"):
        site |= {"scatter": float(rng.uniform(*SCATTER_WIDTH))}
    if name in ("narrowband_drift", "narrowband_accel", "narrowband_sine") and rng.random() < SCINT_SHARE:
        site |= {"scint_seed": int(rng.integers(2**31)), "scint_steps": float(rng.uniform(1.0, max(2.0, bins))), "scint_depth": float(rng.uniform(*SCINT_DEPTH))}
    reach = np.abs(track(site, np.arange(whole), whole)).max() + site["width"]
    room = max(0.0, channels / 2 - reach)
    return site | {"centre": float(channels / 2 + rng.uniform(-room, room))}


def track(site: dict, t: np.ndarray, whole: int) -> np.ndarray:
    """The distance of the signal's centre from its start, in channels, at each time step of the sequence."""
    out = site.get("drift", 0.0) * t + 0.5 * site.get("accel", 0.0) * t**2
    return out + site.get("amplitude", 0.0) * np.sin(2 * np.pi * site.get("cycles", 0.0) * t / whole)


def profile(kind: str, x: np.ndarray, width: float, scatter: float = 0.0) -> np.ndarray:
    """Unit height at 0; width is the full width at half maximum. Scattering adds Lorentzian wings of that width: to a
    lorentzian it is added, with a gaussian it makes a voigt."""
    if kind == "gaussian":
        return np.exp(-4 * np.log(2) * (x / width) ** 2)
    if kind == "sinc2":
        return np.sinc(x / width * 0.886) ** 2
    if kind == "lorentzian":
        return 1 / (1 + (2 * x / (width + scatter)) ** 2)
    if kind == "voigt":
        return voigt(x, width, scatter)
    if kind == "box":
        return (np.abs(x) <= width / 2).astype(float)
    raise ValueError(f"unknown profile {kind!r}")


def voigt(x: np.ndarray, gauss: float, lorentz: float) -> np.ndarray:
    """The pseudo-Voigt profile of Thompson, Cox and Hastings (1987), unit height, from both full widths at half maximum;
    within about a per cent of the convolution."""
    powers = np.array([gauss ** (5 - k) * lorentz**k for k in range(6)])
    whole = float(powers @ np.array([1, 2.69269, 2.42843, 4.47163, 0.07842, 1])) ** 0.2
    ratio = lorentz / whole
    share = 1.36603 * ratio - 0.47719 * ratio**2 + 0.11116 * ratio**3
    # Areas are mixed, so each part counts by the height of its unit area.
    wings, core = share * 2 / np.pi, (1 - share) * 2 * np.sqrt(np.log(2) / np.pi)
    return (wings * profile("lorentzian", x, whole) + core * profile("gaussian", x, whole)) / (wings + core)


def scintillation(seed: int, steps: int, timescale: float, depth: float) -> np.ndarray:
    """Gains of mean 1: the exponential of a stationary first-order autoregression with the correlation time in steps."""
    kept = np.exp(-1 / timescale)
    shocks = np.random.default_rng(seed).normal(size=steps) * np.where(np.arange(steps) == 0, 1.0, np.sqrt(1 - kept**2))
    state = np.empty(steps)
    last = 0.0
    for i, shock in enumerate(shocks):
        state[i] = last = kept * last + shock
    return np.exp(depth * state - depth**2 / 2)


def shape(site: dict, bins: int, channels: int) -> np.ndarray:
    """A two-dimensional figure, bins × channels, unit height: a face, or a closed random curve."""
    y, x = np.mgrid[0:bins, 0:channels]
    v, u = (y - (bins - 1) / 2) / (bins / 2), (x - site["centre"]) / (1.5 * bins)
    r, theta = np.hypot(u, v), np.arctan2(v, u)
    edge = 0.85 + sum(a * np.cos((k + 2) * theta) for k, a in enumerate(site.get("harmonics", [])))
    out = np.exp(-(((r - edge) / 0.12) ** 2))
    if site["morphology"] == "smiley_face":
        mouth = np.exp(-(((r - 0.5) / 0.1) ** 2)) * ((theta > 0.5) & (theta < np.pi - 0.5))
        eyes = sum(np.exp(-(((u - s * 0.35) ** 2 + (v + 0.3) ** 2) / 0.02)) for s in (-1, 1))
        out = np.maximum(out, np.maximum(mouth, eyes))
    return np.minimum(out, 1.0)


def render(site: dict, bins: int, channels: int, obs: int, n_obs: int = 6) -> np.ndarray:
    """The signal of unit amplitude in one observation, bins × channels."""
    if site["morphology"] in ("smiley_face", "random_2d"):
        return shape(site, bins, channels)
    t = np.arange(bins) + obs * bins
    centre = site["centre"] + track(site, t, bins * n_obs)
    out = profile(site["profile"], np.arange(channels)[None, :] - centre[:, None], site["width"], site.get("scatter", 0.0))
    if "scint_seed" in site:
        out = out * scintillation(site["scint_seed"], bins * n_obs, site["scint_steps"], site["scint_depth"])[t][:, None]
    if "period" in site:
        nearest = (t - site["phase"] + site["period"] / 2) % site["period"] - site["period"] / 2
        out = out * np.exp(-4 * np.log(2) * (nearest / site["pulse"]) ** 2)[:, None]
    return out


def inject(window: np.ndarray, site: dict, snr: float, pattern: str) -> tuple[np.ndarray, dict]:
    """A window (observations × bins × channels) with the signal in the pattern's observations; the rest is untouched.

    The amplitude is snr times the noise of a time-averaged channel, from robust statistics of the first ON observation.
    """
    on = PATTERNS[pattern]
    out = window.astype(float).copy()
    first = out[on[0]]
    sigma = 1.4826 * np.median(np.abs(first - np.median(first)))
    amplitude = snr * sigma / np.sqrt(window.shape[1])
    for obs in on:
        out[obs] += amplitude * render(site, window.shape[1], window.shape[2], obs, len(window))
    return out, {"snr": snr, "pattern": pattern, "amplitude": float(amplitude)} | site


def changed_span(before: np.ndarray, after: np.ndarray) -> tuple[int, int] | None:
    """First and one past the last changed channel; None where nothing changed."""
    changed = np.flatnonzero((before != after).any(axis=tuple(range(before.ndim - 1))))
    return (int(changed[0]), int(changed[-1]) + 1) if len(changed) else None


def delay_steps(freqs_mhz: np.ndarray, step_s: float, dm: float, ref_mhz: float) -> np.ndarray:
    """How many time steps later than at the reference a burst comes at each frequency."""
    return DISPERSION * dm * (freqs_mhz**-2.0 - ref_mhz**-2.0) / step_s


def dispersed_burst(freqs_mhz: np.ndarray, bins: int, step_s: float, start: float, dm: float, width: float, scatter_s: float, ref_mhz: float) -> np.ndarray:
    """A burst of unit peak before scattering, bins × channels: later at lower frequencies by the cold-plasma delay, with a
    causal exponential tail whose time grows as the inverse fourth power of the frequency."""
    delay = delay_steps(freqs_mhz, step_s, dm, ref_mhz)
    t = np.arange(bins)[:, None]
    out = np.exp(-(((t - start - delay[None, :]) / width) ** 2))
    tail = np.exp(-t / np.maximum(scatter_s / step_s * (freqs_mhz / ref_mhz) ** -4.0, 1e-6)[None, :])
    tail /= tail.sum(0)
    size = 2 * bins
    return np.fft.irfft(np.fft.rfft(out, size, axis=0) * np.fft.rfft(tail, size, axis=0), size, axis=0)[:bins]


def sample_burst(seed: int, channels: int, bins: int, step_s: float, dm: float) -> dict:
    """The parameters of a dispersed burst, drawn from a seed: start, width, scattering, fringes and the part of the band
    that carries it. Fewer than one fringe over the band counts as none."""
    rng = np.random.default_rng(seed)
    fringes = float(np.exp(rng.uniform(*np.log(FRINGES))))
    carried = max(1, int(channels * rng.uniform(*BAND_SHARE)))
    first = int(rng.integers(0, channels - carried + 1))
    return {
        "dm": dm, "start": float(rng.uniform(0.1, 0.5) * bins), "width": float(rng.uniform(1.5, 6.0)), "scatter_s": float(rng.uniform(0, 5) * step_s),
        "fringes": fringes if fringes >= 1 else 0.0, "phase": float(rng.uniform(0, 2 * np.pi)), "band": [first, first + carried],
    }


def inject_burst(frame: np.ndarray, site: dict, snr: float, freqs_mhz: np.ndarray, step_s: float, ref_mhz: float | None = None) -> tuple[np.ndarray, dict]:
    """A frame (bins × channels) with the burst added: its peak, summed up along the dispersed track, is snr times the
    deviation of the frame's mean over channels. A burst that misses the frame leaves it as it is, with amplitude 0."""
    bins = len(frame)
    ref = float(freqs_mhz.max()) if ref_mhz is None else ref_mhz
    signal = dispersed_burst(freqs_mhz, bins, step_s, site["start"], site["dm"], site["width"], site["scatter_s"], ref)
    gains = np.maximum(np.cos(2 * np.pi * site["fringes"] * (freqs_mhz / ref) ** -2.0 + site["phase"]), 0) + FRINGE_FLOOR
    channel = np.arange(len(freqs_mhz))
    signal = np.maximum(signal, 0) * gains * ((channel >= site["band"][0]) & (channel < site["band"][1]))
    at = np.arange(bins)[:, None] + np.rint(delay_steps(freqs_mhz, step_s, site["dm"], ref)).astype(int)
    aligned = np.where((at >= 0) & (at < bins), np.take_along_axis(signal, np.clip(at, 0, bins - 1), 0), 0.0)
    peak = float(aligned.mean(1).max())
    amplitude = snr * float(frame.mean(1).std()) / peak if peak > 1e-12 else 0.0
    return frame + amplitude * signal, {"snr": snr, "amplitude": amplitude, "ref_mhz": ref} | site
