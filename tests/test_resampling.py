"""Exact, shared and nested resampling against plain versions."""

import collections
import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trivalent.operators import resampling as rs
from trivalent.operators import statistics


def test_powers_are_those_of_plain_convolution():
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 20):
        counts = {p: rng.randrange(1, 5) for p in rng.sample(range(12), 4)}
        plain = {0: 1}
        for _ in range(n):
            more = collections.Counter()
            for (a, x), (b, y) in itertools.product(plain.items(), counts.items()):
                more[a + b] += x * y
            plain = dict(more)
        assert rs.power(counts, n) == plain
    big = rs.power({0: 300, 1: 200, 5: 100}, 600)  # a number of 1.6 million digits
    assert sum(big.values()) == 600**600 and big[0] == 300**600


def test_family_bootstrap_is_exact(spark):
    families = [("f0", 2, 3), ("f1", -1, 2), ("f2", 0, 3), ("f3", 2, 0), ("f4", 1, 4)]
    df = spark.createDataFrame([("g", f, v, m) for f, v, m in families] + [("h", "a", 0, 0)], "g string, f string, v long, m long")
    rows = {r.g: r for r in rs.family_bootstrap(df, ["g"], "f", "v", "m").collect()}
    draws = list(itertools.product(families, repeat=5))
    totals = sorted(sum(v for _, v, _ in d) for d in draws)
    need = lambda share, n: math.ceil(share * n) - 1
    r = rows["g"]
    assert (r.lower, r.upper) == (totals[need(Fraction(1, 40), len(totals))], totals[need(Fraction(39, 40), len(totals))])
    assert math.isclose(r["mean"], 4.0) and math.isclose(r.p_not_above_zero, sum(t <= 0 for t in totals) / 3125)
    assert math.isclose(r.lower_share, r.lower / 12) and math.isclose(r.upper_share, r.upper / 12)
    shares = sorted(Fraction(sum(v for _, v, _ in d), sum(m for *_, m in d)) for d in draws if sum(m for *_, m in d))
    assert math.isclose(r.joint_lower, shares[need(Fraction(1, 40), len(shares))]) and math.isclose(r.joint_upper, shares[need(Fraction(39, 40), len(shares))])
    assert (rows["h"].lower, rows["h"].upper_share, rows["h"].joint_lower) == (0, None, None)


def test_joint_shares_from_halves_are_those_of_all_outcomes():
    rng = random.Random(3)
    for top in (4, 30, 10**10):
        for n in range(1, 9):
            cells = collections.Counter((rng.randrange(-4, top), rng.choice([0, 0, 1, 2, 7, rng.randrange(50)])) for _ in range(n))
            cells = [(v, m, c) for (v, m), c in cells.items()]
            draws = list(itertools.product([(v, m) for v, m, c in cells for _ in range(c)], repeat=n)) if n < 6 else None
            found = rs._ends_of_halves(cells, n, min(v for v, _, _ in cells))
            if draws is None:
                assert top > 30 or found == rs._ends_of_all(cells, n, min(v for v, _, _ in cells))
            else:
                shares = sorted(Fraction(sum(v for v, _ in d), sum(m for _, m in d)) for d in draws if sum(m for _, m in d))
                assert found == ([shares[math.ceil(Fraction(k, 40) * len(shares)) - 1] for k in (1, 39)] if shares else [None, None])


def test_joint_shares_of_a_family_that_dwarfs_the_others():
    """Twenty families, one of half of all cases: packed into one number, this took some 10^10 digits."""
    rng = random.Random(5)
    cells = [(12707, 2892, 1)] + [(1200 + rng.randrange(-60, 60), 270 + rng.randrange(-40, 40), 1) for _ in range(19)]
    low, high = rs._ends_of_halves(cells, 20, min(v for v, _, _ in cells))
    draws = np.random.default_rng(1).multinomial(20, [1 / 20] * 20, 400_000)
    drawn = (draws @ [v for v, _, _ in cells]) / (draws @ [m for _, m, _ in cells])
    assert abs(np.mean(drawn <= float(low)) - 0.025) < 0.0015 and abs(np.mean(drawn <= float(high)) - 0.975) < 0.0015


def cases(seed=4, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        d, y = rng.choice("pqr"), rng.random() < 0.5
        for m, skill in ((1, 0.9), (2, 0.75), (3, 0.6)):
            flag = None if rng.random() < 0.05 else (y if rng.random() < skill else not y)
            rows.append(("g", d, i, y, m, None if flag is None else int(flag), None if flag is None else round(rng.gauss(y * skill, 0.4), 1)))
    return rows


@pytest.mark.parametrize("kind", ["ba", "auroc"])
def test_models_share_their_redraws(spark, kind):
    rows = cases()
    df = spark.createDataFrame(rows, "g string, d string, c int, y boolean, m int, flag int, score double")
    value = 5 if kind == "ba" else 6
    found = {r.model: r for r in rs.shared_redraws(df, ["g"], "d", "c", "y", "m", "flag" if kind == "ba" else "score", [1, 2, 3], kind, reps=1500).collect()}

    def statistic(drawn):  # cases with their times, a model's mean over datasets
        out = []
        for m in (1, 2, 3):
            each = []
            for d in "pqr":
                here = [(by[c][m], y, t) for c, (dd, y), t in drawn if dd == d and by[c][m] is not None]
                up, down = [(v, t) for v, y, t in here if y], [(v, t) for v, y, t in here if not y]
                if kind == "ba":
                    each.append((sum(v * t for v, t in up) / sum(t for _, t in up) + sum((1 - v) * t for v, t in down) / sum(t for _, t in down)) / 2)
                else:
                    wins = sum(t * u * ((a > b) + (a == b) / 2) for a, t in up for b, u in down)
                    each.append(wins / sum(t for _, t in up) / sum(t for _, t in down))
            out.append(sum(each) / 3)
        return out

    by, of = collections.defaultdict(dict), {}
    for r in rows:
        by[r[2]][r[4]], of[r[2]] = r[value], (r[1], r[3])
    point = statistic([(c, k, 1) for c, k in of.items()])
    rng, drawn = np.random.default_rng(9), []
    pools = collections.defaultdict(list)
    for c, k in of.items():
        pools[k].append(c)
    for _ in range(250 if kind == "ba" else 60):
        times = collections.Counter(int(x) for k in pools for x in rng.choice(pools[k], len(pools[k])))
        drawn.append(statistic([(c, of[c], t) for c, t in times.items()]))
    drawn = np.array(drawn)
    low, high = np.percentile(drawn, [2.5, 97.5], axis=0)
    order = sorted((1, 2, 3), key=lambda m: -point[m - 1])
    for m in (1, 2, 3):
        assert math.isclose(found[m].estimate, point[m - 1], abs_tol=1e-9) and found[m].place == order.index(m) + 1 and found[m].cases == 240
        assert abs(found[m].lower - low[m - 1]) < 0.03 and abs(found[m].upper - high[m - 1]) < 0.03
        assert abs(found[m].top_share - np.mean(drawn[:, m - 1] >= drawn.max(1))) < 0.1
        assert math.isclose(found[m].range, max(point) - min(point), abs_tol=1e-9) and math.isclose(found[m].sd, np.std(point, ddof=1), abs_tol=1e-9)
    lead = drawn[:, order[0] - 1] - drawn[:, order[1] - 1]
    assert abs(found[order[0]].margin_lower - np.percentile(lead, 2.5)) < 0.04 and found[order[2]].margin is None


def plain_mulberry(seed):
    a = seed & 0xFFFFFFFF
    while True:
        a = (a + 0x6D2B79F5) & 0xFFFFFFFF
        t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
        t ^= (t + ((t ^ (t >> 7)) * (t | 61) & 0xFFFFFFFF)) & 0xFFFFFFFF
        yield ((t ^ (t >> 14)) & 0xFFFFFFFF) / 4294967296


def test_the_generator_gives_any_stretch_of_its_stream():
    for seed in (0, 1, 0x5EED, 0xFFFFFFFF, 12345678901):
        stream = list(itertools.islice(plain_mulberry(seed), 500))
        assert rs.mulberry32(seed, 0, 500).tolist() == stream and rs.mulberry32(seed, 123, 40).tolist() == stream[123:163]
    assert abs(float(rs.mulberry32(0, 0, 1)[0]) - 0.26642920868471265) < 1e-15  # a published first draw of seed 0


def test_nested_bootstrap_value_by_value(spark):
    rng = random.Random(2)
    rows = [("g", d, f"c{rng.randrange(k):02}", rng.randrange(0, 2)) for d, k in (("a", 5), ("b", 9), ("c", 2)) for _ in range(60)]
    got = rs.nested_bootstrap(spark.createDataFrame(rows, "g string, d string, c string, v int").withColumn("w", F.lit(1)), ["g"], "d", "c", "v", "w", reps=700, seed=77).first()
    sums = {d: sorted((c, sum(x[3] for x in rows if x[1] == d and x[2] == c), sum(1 for x in rows if x[1] == d and x[2] == c)) for c in {x[2] for x in rows if x[1] == d}) for d in "abc"}
    stream, drawn = plain_mulberry(77), []
    for _ in range(700):
        each = []
        for d in "abc":
            picks = [sums[d][math.floor(next(stream) * len(sums[d]))] for _ in sums[d]]
            each.append(sum(p[1] for p in picks) / sum(p[2] for p in picks))
        drawn.append(sum(each) / 3)
    assert np.allclose([got.lower, got.upper], np.percentile(drawn, [2.5, 97.5]), atol=1e-12)
    assert math.isclose(got.estimate, sum(sum(s[1] for s in sums[d]) / sum(s[2] for s in sums[d]) for d in "abc") / 3)


def test_groups_are_taken_whole(spark):
    df = spark.createDataFrame([(i, f"p{i // 3}" if i < 60 else None) for i in range(70)], "id int, pair string")
    order = lambda key: statistics.hash_rank("seed", key)
    found = rs.whole_groups(df, "pair", 4, order).collect()
    sizes = collections.Counter(r.pair for r in found)
    assert len(sizes) == 4 and set(sizes.values()) == {3}
    with pytest.raises(Exception, match="fewer than 21 groups"):
        rs.whole_groups(df, "pair", 21, order).collect()
