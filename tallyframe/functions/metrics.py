"""Distances and information measures over dense count arrays, as Column expressions (no Python at run time).

Counts leave out the unknown category, totals take it in, so probabilities may add up to less than 1.
All logarithms are to base 2.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Added to each count of the second distribution in kl().
SMOOTHING = 1e-10


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _share(n: Column, total: Column) -> Column:
    return F.when(total > 0, n / total).otherwise(F.lit(0.0))


def _plog(p: Column, over: Column) -> Column:
    """p * log2(p / over), 0 where p is 0."""
    return F.when(p > 0, p * F.log2(p / over)).otherwise(F.lit(0.0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def probabilities(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda n: _share(n, total))


def entropy(counts: Column, total: Column) -> Column:
    return F.when(total > 0, _sum(F.transform(counts, lambda n: F.when(n > 0, -(n / total) * F.log2(n / total)).otherwise(F.lit(0.0))))).otherwise(F.lit(0.0))


def jsd_parts(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """What each cell adds to the Jensen-Shannon divergence."""

    def part(x: Column, y: Column) -> Column:
        p, q = _share(x, ta), _share(y, tb)
        m = (p + q) / 2
        return (_plog(p, m) + _plog(q, m)) / 2

    return F.zip_with(a, b, part)


def jsd(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    return clamp(_sum(jsd_parts(a, b, ta, tb)))


def kl(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Only the second distribution is smoothed; its size counts empty cells. 0 where either is empty."""
    smooth = tb + F.size(b) * F.lit(SMOOTHING)
    parts = F.zip_with(a, b, lambda x, y: _plog(x / ta, (y + F.lit(SMOOTHING)) / smooth))
    return F.when((ta > 0) & (tb > 0), _sum(parts)).otherwise(F.lit(0.0))


def psi(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    return kl(a, b, ta, tb) + kl(b, a, tb, ta)


def hellinger(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(_share(x, ta)) - F.sqrt(_share(y, tb)), 2.0))
    both = F.sqrt(_sum(square) / 2)
    return F.when((ta > 0) & (tb > 0), both).when((ta > 0) | (tb > 0), F.lit(1.0)).otherwise(F.lit(0.0))


def wasserstein(a: Column, b: Column, ta: Column, tb: Column, width: Column) -> Column:
    """Area between the cumulative distributions, over the last bin's end too; 0 where either is empty."""
    steps = F.zip_with(a, b, lambda x, y: x / ta - y / tb)
    zero = F.struct(F.lit(0.0).alias("gap"), F.lit(0.0).alias("area"))
    walked = F.aggregate(steps, zero, lambda acc, d: F.struct((acc["gap"] + d).alias("gap"), (acc["area"] + F.abs(acc["gap"] + d)).alias("area")), lambda acc: acc["area"])
    return F.when((ta > 0) & (tb > 0), walked * width).otherwise(F.lit(0.0))


def confidence(divergence: Column, ta: Column, tb: Column) -> tuple[Column, Column, Column]:
    """Asymptotic 95 % bounds of a Jensen-Shannon divergence, and whether both samples reach 30."""
    n = ta * tb / F.greatest(ta + tb, F.lit(1))
    spread = F.greatest(divergence, F.lit(1e-12)) * F.greatest(1 - divergence, F.lit(1e-12))
    error = F.when(n > 0, F.sqrt(spread / n)).otherwise(F.lit(0.0))
    return clamp(divergence - 1.96 * error), clamp(divergence + 1.96 * error), (ta >= 30) & (tb >= 30)


DISTANCES = {"jsd": jsd, "psi": psi, "hellinger": hellinger}


def rebin(counts: Column, low: float, high: float, to_low: float, to_high: float, bins: int) -> Column:
    """Counts on another grid: each source bin is shared out by overlap, and every piece is rounded (half away from zero)."""
    n, to_width = F.size(counts), (to_high - to_low) / bins
    width = F.lit(high - low) / n

    def target(j: Column) -> Column:
        begin = F.lit(to_low) + j * F.lit(to_width)

        def piece(x: Column, i: Column) -> Column:
            lo = F.lit(low) + i * width
            overlap = F.least(begin + F.lit(to_width), lo + width) - F.greatest(begin, lo)
            return F.when(overlap > 0, F.round(x * overlap / width)).otherwise(F.lit(0.0))

        return _sum(F.transform(counts, piece)).cast("bigint")

    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), target)


def register(spark: SparkSession) -> None:
    """The measures as SQL functions: tf_entropy(counts), tf_jsd(a, b), tf_psi(a, b), tf_hellinger(a, b), tf_kl(a, b)."""
    c = "array<bigint>"
    total = "aggregate({0}, 0D, (s, x) -> s + x)"
    p = f"if({total} > 0, x / {total}, 0D)"
    share = lambda v: f"transform({v}, x -> {p.format(v)})"
    plog = "if(p > 0, p * log2(p / m), 0D)"
    bodies = {
        "tf_entropy": ("counts " + c, f"aggregate({share('counts')}, 0D, (s, p) -> s + if(p > 0, -p * log2(p), 0D))"),
        "tf_jsd": (f"a {c}, b {c}", f"greatest(0D, least(1D, aggregate(zip_with({share('a')}, {share('b')}, (p, q) -> ({plog.replace('m', '((p + q) / 2)')} + if(q > 0, q * log2(q / ((p + q) / 2)), 0D)) / 2), 0D, (s, x) -> s + x)))"),
        "tf_hellinger": (f"a {c}, b {c}", f"sqrt(aggregate(zip_with({share('a')}, {share('b')}, (p, q) -> power(sqrt(p) - sqrt(q), 2)), 0D, (s, x) -> s + x) / 2)"),
    }

    def kl(a: str, b: str) -> str:
        smooth = f"transform({b}, x -> (x + 1e-10D) / ({total.format(b)} + size({b}) * 1e-10D))"
        return f"if({total.format(a)} = 0 or {total.format(b)} = 0, 0D, aggregate(zip_with({share(a)}, {smooth}, (p, m) -> {plog}), 0D, (s, x) -> s + x))"

    bodies |= {"tf_kl": (f"a {c}, b {c}", kl("a", "b")), "tf_psi": (f"a {c}, b {c}", f"{kl('a', 'b')} + {kl('b', 'a')}")}
    for name, (args, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS double RETURN {body}")
