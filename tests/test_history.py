"""Look-back columns against a plain Python replay, with one and with many segments."""

import math
import random

import pytest

from tallyrank.operators.history import history, snapshot

NAMES = {0: "Pass", 1: "Fail", 2: "Blocked"}


def make_rows(seed=7, builds=90, tests=6):
    rng = random.Random(seed)
    rows = []
    for t in range(tests):
        chance = [1.0, 0.8, 0.5, 0.3, 0.1, 0.03][t]
        for b in range(builds):
            if rng.random() < chance:
                v = rng.choice([0, 0, 0, 1, 1, 2])
                rows.append(("p", f"b{b:03d}", f"t{t}", b, v, int(v == 1), NAMES[v],
                             round(rng.random() * 10, 2), rng.randint(1, 4)))
    return rows


def replay(rows, alpha=0.1):
    """(test, build) -> expected columns."""
    out, past = {}, {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        h = past.setdefault(r[2], [])
        f = [x[5] for x in h]
        raw = [x[6] for x in h]
        vs = [x[4] for x in h]
        xs = [x for x in vs if x < 2]

        def trail(seq, v):
            n = 0
            for s in reversed(seq):
                if s != v:
                    break
                n += 1
            return n

        def longest(seq, v):
            best = cur = 0
            for s in seq:
                cur = cur + 1 if s == v else 0
                best = max(best, cur)
            return best

        def rate(seq, k):
            return sum(seq[-k:]) / len(seq[-k:]) if seq[-k:] else None

        e = {
            "n": len(h), "failures": sum(f), "exact_passes": xs.count(0), "exact_n": len(xs),
            "flips": sum(a != b for a, b in zip(f, f[1:])),
            "exact_flips": sum({a, b} == {0, 1} for a, b in zip(vs, vs[1:])),
            "duration_sum": sum(x[7] for x in h), "sum_commits": sum(x[8] for x in h),
            "max_duration": max((x[7] for x in h), default=None),
            "first_idx": h[0][3] if h else None, "last_idx": h[-1][3] if h else None,
            "first_verdict": h[0][4] if h else None,
            "last_fail_idx": max((x[3] for x in h if x[5]), default=None),
            "fail_run": trail(f, 1), "pass_run": trail(f, 0),
            "exact_fail_run": trail(xs, 1), "exact_pass_run": trail(xs, 0),
            "max_fail_run": longest(f, 1), "max_pass_run": longest(f, 0),
            "max_exact_fail_run": longest(xs, 1), "max_exact_pass_run": longest(xs, 0),
            "last_duration": h[-1][7] if h else None,
            "raw_flips_10": sum(a != b for a, b in zip(raw[-10:], raw[-10:][1:])),
            "fail_flips_5": sum(a != b for a, b in zip(f[-5:], f[-5:][1:])),
            "recent_fails_11": sum(f[-11:]),
        }
        for k in (2, 3, 5, 10, 20):
            e[f"rate_{k}"] = rate(f, k)
        for k in range(1, 11):
            e[f"fail_{k}"] = f[-k] if len(f) >= k else None
            e[f"verdict_{k}"] = h[-k][4] if len(h) >= k else None
        lx = [x[4] for x in h[-10:] if x[4] < 2]
        e["exact_rate_10"] = sum(lx) / len(lx) if lx else None
        if h:
            w = [math.exp(-alpha * (h[-1][3] - x[3])) for x in h]
            e["decayed_rate"] = sum(a * b for a, b in zip(w, f)) / sum(w)
        else:
            e["decayed_rate"] = None
        out[(r[2], r[3])] = e
        h.append(r)
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "project string, build_id string, tc_key string, build_idx bigint, verdict int,"
              " fail int, result string, duration double, commits int")


@pytest.mark.parametrize("segment,alpha", [(4096, 0.1), (7, 90.0), (20, 40.0)])
def test_matches_replay(spark, segment, alpha):
    rows = make_rows()
    want = replay(rows, alpha)
    got = history(frame(spark, rows), alpha=alpha, segment=segment, sums=["commits"]).collect()
    assert len(got) == len(rows)
    for r in got:
        for k, v in want[(r.tc_key, r.build_idx)].items():
            g = r[k]
            if v is None or g is None:
                assert g is v, (segment, r.tc_key, r.build_idx, k, g, v)
            else:
                assert abs(g - v) < 1e-9, (segment, r.tc_key, r.build_idx, k, g, v)


@pytest.mark.parametrize("hot", [None, 3])
def test_long_clock_does_not_overflow(spark, hot):
    ticks = [0, 1, 2, 5999, 6000, 6001, 12000, 18500, 18501, 18502, 29999, 30000, 90000, 90001, 91000]
    rows = [("p", f"b{i}", "t", b, i % 2, i % 2, NAMES[i % 2], 1.0, 1) for i, b in enumerate(ticks)]
    want = replay(rows)
    for r in history(frame(spark, rows), segment=6000, hot_rows=hot).collect():
        v = want[("t", r.build_idx)]["decayed_rate"]
        assert (v is None and r.decayed_rate is None) or abs(r.decayed_rate - v) < 1e-12
        assert r.max_pass_run == want[("t", r.build_idx)]["max_pass_run"]


def test_snapshot_is_the_next_look_back(spark):
    rows = make_rows()
    df = frame(spark, rows)
    snap = {r.tc_key: r for r in snapshot(df, alpha=40.0, segment=16).collect()}
    probes = [("p", "z", t, 1000, 0, 0, "Pass", 0.0, 0) for t in snap]
    want = replay(rows + probes, 40.0)
    for t, r in snap.items():
        for k in ("n", "failures", "flips", "fail_run", "max_fail_run", "rate_5", "decayed_rate"):
            assert abs(r[k] - want[(t, 1000)][k]) < 1e-9
