"""Step functions of the keyed recursions.

Each takes the state at entry and a run of ordered rows and returns the state at
exit and the outputs.  Batch (``folds``) and streaming (``streaming.live``) call the
same functions.  A state is a flat list of doubles, so it fits one array column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np

from kinetable.config import Config

Columns = Mapping[str, np.ndarray]


def quality_state(state, rows: Columns, cfg: Config):
    """Hysteresis of the quality flag; state: [good, time of last change]."""
    good, changed = bool(state[0]), state[1]
    hold = cfg.span(cfg.quality_min_s)
    out = np.empty(len(rows["t"]), bool)
    for i, (t, score, rejected) in enumerate(zip(rows["t"], rows["score"], rows["rejected"])):
        if good:
            if (score < cfg.quality_exit or rejected) and t - changed >= hold:
                good, changed = False, t
        elif score >= cfg.quality_enter and not rejected:
            good, changed = True, t
        out[i] = good
    return [float(good), float(changed)], {"is_valid": out}


def _blend(te: float, cutoff):
    return 1.0 / (1.0 + (1.0 / (2.0 * math.pi * cutoff)) / te)


def one_euro(state, t: np.ndarray, x: np.ndarray, cfg: Config):
    """Adaptive low-pass of the rows of ``x``; state: [time, has slope, values..., slopes...]."""
    size = x.shape[1]
    out = np.empty_like(x, dtype=float)
    if len(state):
        last, sloped = state[0], bool(state[1])
        value, slope = np.array(state[2 : 2 + size]), np.array(state[2 + size :])
    else:
        last, sloped, value, slope = None, False, None, np.zeros(size)
    for i in range(len(t)):
        if last is None:
            value = x[i].astype(float)
        else:
            rate = 1.0 / max(1e-4, (t[i] - last) / cfg.unit)
            te = 1.0 / rate
            raw = (x[i] - value) * rate
            a = _blend(te, cfg.d_cutoff)
            slope = a * raw + (1.0 - a) * slope if sloped else raw
            sloped = True
            b = _blend(te, cfg.min_cutoff + cfg.beta * np.abs(slope))
            value = b * x[i] + (1.0 - b) * value
        last = t[i]
        out[i] = value
    if last is None:
        return [], out
    return [float(last), float(sloped), *value.tolist(), *slope.tolist()], out


def vad(state, rows: Columns, cfg: Config):
    """Voice activity; state: [noise floor, time of last raw speech].

    ``core``/``extreme`` (mean band energies) may be absent; NaN means no spectrum.
    A vetoed slice is silent but still counts for the hangover of later slices.
    """
    floor, spoken = state
    hangover = cfg.span(cfg.vad_hangover_s)
    n = len(rows["t"])
    speech, confidence = np.zeros(n, bool), np.zeros(n)
    core = rows.get("core", np.full(n, np.nan))
    extreme = rows.get("extreme", np.full(n, np.nan))
    for i in range(n):
        rms = rows["rms"][i]
        if np.isnan(rms):  # an empty slice changes nothing
            continue
        t = rows["t"][i]
        if rms < floor * 1.5 or floor == cfg.vad_floor_start:
            floor = 0.96 * floor + 0.04 * rms
        threshold = max(cfg.vad_energy, floor * 2.2)
        raw = rms >= threshold and 0.01 <= rows["zcr"][i] <= 0.45
        if raw:
            spoken = t
        heard = raw or (spoken > 0 and t - spoken <= hangover)
        if heard and extreme[i] > core[i] * 2.5 and core[i] < 0.25:
            heard = False
        speech[i] = heard
        confidence[i] = min(1.0, rms / max(1e-4, threshold * 2.5)) if heard else 0.0
    return [float(floor), float(spoken)], {"is_speech": speech, "vad_confidence": confidence}


def attack_release(state, x: np.ndarray, rise: float = 0.65, fall: float = 0.25):
    """Envelope that rises fast and falls slowly; state: [level] or [] before the first row."""
    level = state[0] if len(state) else None
    out = np.empty(len(x))
    for i, v in enumerate(x):
        if level is None:
            level = v
        else:
            a = rise if v > level else fall
            level = a * v + (1 - a) * level
        out[i] = level
    return ([] if level is None else [float(level)]), out


def adaptive_peak(state, x: np.ndarray):
    """Slowly decaying peak; state: [peak]."""
    peak = state[0]
    out = np.empty(len(x))
    for i, v in enumerate(x):
        peak = 0.92 * peak + 0.08 * v if v > peak else max(0.02, 0.998 * peak)
        out[i] = peak
    return [float(peak)], out


def ema(state, x: np.ndarray, alpha: float = 0.1):
    """Exponential moving average from a start value; state: [average]."""
    level = state[0]
    out = np.empty(len(x))
    for i, v in enumerate(x):
        level = (1.0 - alpha) * level + alpha * v
        out[i] = level
    return [float(level)], out


def track(state, frames, cfg: Config):
    """Greedy centroid tracking of the faces of successive frames.

    ``frames`` yields lists of (cx, cy) in detection order.  State: [next id, then
    per live track id, cx, cy, missed, hits].  Returns per frame [(id, hits), ...].
    """
    next_id = int(state[0])
    live = [list(state[i : i + 5]) for i in range(1, len(state), 5)]
    result = []
    for faces in frames:
        # Best pairs first; equal distances go to the earlier face, then the older track.
        pairs = sorted(
            (math.sqrt((cx - tr[1]) ** 2 + (cy - tr[2]) ** 2), i, j)
            for i, (cx, cy) in enumerate(faces)
            for j, tr in enumerate(live)
        )
        of_face, taken = {}, set()
        for distance, i, j in pairs:
            if distance > cfg.track_max_distance:
                break
            if i not in of_face and j not in taken:
                of_face[i] = j
                taken.add(j)
        for j, tr in enumerate(live):
            if j not in taken:
                tr[3] += 1
        labels = []
        for i, (cx, cy) in enumerate(faces):
            if i in of_face:
                tr = live[of_face[i]]
                tr[1:5] = [cx, cy, 0, tr[4] + 1]
            else:
                tr = [next_id, cx, cy, 0, 1]
                next_id += 1
                live.append(tr)
            labels.append((int(tr[0]), int(tr[4])))
        live = [tr for tr in live if tr[3] <= cfg.track_max_missed]
        result.append(labels)
    return [float(next_id), *[float(v) for tr in live for v in tr]], result
