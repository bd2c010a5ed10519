"""Plain loops for what the signal expressions compute, from the written semantics; the tests' oracle."""

import math

import numpy as np


def level_of(part):
    """Root mean square in doubles, rounded to float; 0 for nothing."""
    energy = 0.0
    for v in part:
        energy += float(v) * float(v)
    return float(np.float32(math.sqrt(energy / len(part)))) if len(part) else 0.0


def centred_levels(x, rate, length_ms, step_ms):
    """(seconds of the middle, level) of each frame; one frame of everything where the signal is shorter."""
    length, step = max(1, int(rate * length_ms / 1000)), max(1, int(rate * step_ms / 1000))
    if len(x) < length:
        return [(len(x) / (2 * rate), level_of(x))]
    out, at = [], 0
    while at + length <= len(x):
        out.append(((at + length / 2) / rate, level_of(x[at:at + length])))
        at += step
    return out


def quiet_spot(x, rate, centre):
    found = centred_levels(x, rate, 10, 5)
    floor = min(v for _, v in found)
    bound = np.float32(floor + max(floor * 0.2, 1e-5))
    return min(((abs(t - centre), n, t, v) for n, (t, v) in enumerate(found) if np.float32(v) <= bound))[2:]


def share_below(values, share):
    ordered = sorted(values)
    place = (len(ordered) - 1) * share
    low = int(place)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (place - low)


def loudness(x, rate):
    if not len(x):
        return 0.0
    all_levels = [v for _, v in centred_levels(x, rate, 50, 25)]
    return share_below([v for v in all_levels if np.float32(v) > np.float32(0.005)] or all_levels, 0.75)


def has_content(x, rate):
    return bool(len(x)) and share_below([v for _, v in centred_levels(x, rate, 50, 25)], 0.9) > 0.005


def brought_to(x, rate, target):
    own = loudness(x, rate)
    if target <= 0 or own <= 1e-9:
        return list(x)
    gain = min(max(target / own, 10 ** -0.6), 10 ** 0.6)
    out = [float(np.float32(float(v) * gain)) for v in x]
    top = max(abs(v) for v in out)
    return [float(np.float32(v * (0.99 / top))) for v in out] if top > 0.99 else out


def ramped(x, rate, seconds_in, seconds_out):
    n, a, b = len(x), min(len(x), int(rate * seconds_in)), min(len(x), int(rate * seconds_out))
    out = []
    for i, v in enumerate(x):
        up = i / (a - 1) if a > 1 and i < a else 1.0
        down = (n - 1 - i) / (b - 1) if b > 1 and n - 1 - i < b else 1.0
        out.append(float(v) * up * down)
    return out
