"""Windows of sound against the rule, step by step over samples."""

import numpy as np

from heliograph.sources import sound


def brute(samples, rate):
    window, frame, search = int(30 * rate), int(0.1 * rate), int(3 * rate)
    rms = lambda x: float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0
    out, start, k = [], 0, 0
    while start < len(samples):
        end = min(start + window, len(samples))
        if end < len(samples):
            places = range(end - search, end - frame + 1, frame // 2)
            end = min(places, key=lambda p: (round(float(np.sum(np.square(samples[p : p + frame]))), 12), p)) + frame // 2
        k += 1
        if rms(samples[start:end]) >= 1e-4:
            out.append((k, start, end, round(rms(samples[start:end]), 9)))
        start = end
    return out


def test_windows_are_cut_where_it_is_quiet(spark):
    rng = np.random.default_rng(4)
    rate, sounds = 100, {}
    for k, n in enumerate([0, 1, 5, 2999, 3000, 3001, 9000, 20_013, 6000]):
        x = np.round(rng.normal(0, 0.1, n), 3)
        for at in rng.integers(0, max(n, 1), n // 400):  # pauses, some of them equal
            x[at : at + int(rng.integers(3, 40))] = 0
        if n == 9000:
            x[2500:8000] = 0
        sounds[k] = x if n != 6000 else np.zeros(n)
    rows = [(k, b // 500, x[b : b + 500].tolist()) for k, x in sounds.items() for b in range(0, max(len(x), 1), 500)]
    frame = spark.createDataFrame(rows, "sound_id long, block long, samples array<double>").repartition(5)
    got = {}
    for r in sound.sound_windows(frame, rate).collect():
        got.setdefault(r.sound_id, []).append((r.window, r.start, r.end, round(r.rms, 9)))
    assert {k: sorted(v) for k, v in got.items()} == {k: w for k, x in sounds.items() if (w := brute(x, rate))}
