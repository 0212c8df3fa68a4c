"""The measures against plain Python, on random counts and known values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import metrics as m


def h(a, t):
    return -sum(x / t * math.log2(x / t) for x in a if x) if t else 0.0


def jsd(a, b, ta, tb):
    out = 0.0
    for x, y in zip(a, b, strict=True):
        p, q = x / ta if ta else 0, y / tb if tb else 0
        for v in (p, q):
            out += v * math.log2(v / ((p + q) / 2)) / 2 if v else 0
    return min(1.0, max(0.0, out))


def kl(a, b, ta, tb):
    if not ta or not tb:
        return 0.0
    return sum(x / ta * math.log2((x / ta) / ((y + 1e-10) / (tb + len(b) * 1e-10))) for x, y in zip(a, b, strict=True) if x)


def hellinger(a, b, ta, tb):
    if not ta or not tb:
        return float(bool(ta or tb))
    return math.sqrt(sum((math.sqrt(x / ta) - math.sqrt(y / tb)) ** 2 for x, y in zip(a, b, strict=True)) / 2)


def wasserstein(a, b, ta, tb, w):
    if not ta or not tb:
        return 0.0
    gap = area = 0.0
    for x, y in zip(a, b, strict=True):
        gap += x / ta - y / tb
        area += abs(gap)
    return area * w


def cases():
    r = random.Random(7)
    out = [([0, 0], [0, 0], 0, 0), ([1, 2], [0, 0], 0, 0), ([5, 5], [5, 5], 0, 0), ([9, 1], [1, 9], 0, 0), ([10, 0], [0, 10], 0, 0), ([8, 2], [3, 7], 4, 0)]
    for _ in range(40):
        k = r.randint(1, 12)
        out.append(([r.choice([0, r.randint(0, 50)]) for _ in range(k)], [r.choice([0, r.randint(0, 50)]) for _ in range(k)], r.choice([0, 0, 3]), r.choice([0, 7])))
    return [(a, b, sum(a) + ua, sum(b) + ub) for a, b, ua, ub in out]


def test_against_plain_python(spark):
    rows = cases()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<bigint>, b array<bigint>, ta bigint, tb bigint")
    x = tuple(F.col(c) for c in ("a", "b", "ta", "tb"))
    got = df.select("i", m.jsd(*x).alias("jsd"), m.kl(*x).alias("kl"), m.psi(*x).alias("psi"), m.hellinger(*x).alias("hellinger"), m.wasserstein(*x, F.lit(2.5)).alias("w"), m.entropy(x[0], x[2]).alias("h")).collect()
    for g in got:
        a, b, ta, tb = rows[g["i"]]
        assert g["jsd"] == pytest.approx(jsd(a, b, ta, tb), abs=1e-12)
        assert 0 <= g["jsd"] <= 1
        assert g["kl"] == pytest.approx(kl(a, b, ta, tb), abs=1e-9)
        assert g["psi"] == pytest.approx(kl(a, b, ta, tb) + kl(b, a, tb, ta), abs=1e-9)
        assert g["hellinger"] == pytest.approx(hellinger(a, b, ta, tb), abs=1e-12)
        assert g["w"] == pytest.approx(wasserstein(a, b, ta, tb, 2.5), abs=1e-12)
        assert g["h"] == pytest.approx(h(a, ta), abs=1e-12)


def test_confidence(spark):
    df = spark.createDataFrame([(0.2, 100, 100), (0.2, 10, 100), (0.0, 0, 0)], "j double, a bigint, b bigint")
    low, high, enough = m.confidence(F.col("j"), F.col("a"), F.col("b"))
    got = df.select(low.alias("l"), high.alias("h"), enough.alias("e")).collect()
    se = math.sqrt(0.2 * 0.8 / 50)
    assert got[0]["l"] == pytest.approx(0.2 - 1.96 * se) and got[0]["h"] == pytest.approx(0.2 + 1.96 * se)
    assert [r["e"] for r in got] == [True, False, False] and (got[2]["l"], got[2]["h"]) == (0, 0)


def test_rebin(spark):
    one = spark.createDataFrame([([10, 20, 30, 40],)], "c array<bigint>")
    assert one.select(m.rebin(F.col("c"), 0.0, 10.0, 0.0, 10.0, 4)).first()[0] == [10, 20, 30, 40]
    assert abs(sum(one.select(m.rebin(F.col("c"), 0.0, 10.0, 0.0, 10.0, 5)).first()[0]) - 100) <= 1


def test_sql_functions(spark):
    m.register(spark)
    got = spark.sql("select tf_entropy(array(1L, 1L, 1L, 1L)) e, tf_jsd(array(9L, 1L), array(1L, 9L)) j, tf_hellinger(array(10L, 0L), array(0L, 10L)) h").first()
    assert got["e"] == pytest.approx(2) and got["j"] == pytest.approx(jsd([9, 1], [1, 9], 10, 10)) and got["h"] == pytest.approx(1)
