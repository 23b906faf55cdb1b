"""Series statistics: totals, stacking, shares, fits, error bars, windows, axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quireworks.functions.text import number_format

SINGULAR = 1e-12


def category_totals(series: DataFrame) -> DataFrame:
    return series.groupBy(F.col("x").alias("category_no")).agg(F.sum(F.abs("y")).alias("total"))


def stacked_extent(series: DataFrame) -> DataFrame:
    """Per category the sums of values from zero up and below zero: category_no, pos, neg."""
    y = F.col("y")
    return series.groupBy(F.col("x").alias("category_no")).agg(F.coalesce(F.sum(F.when(y >= 0, y)), F.lit(0.0)).alias("pos"), F.coalesce(F.sum(F.when(y < 0, y)), F.lit(0.0)).alias("neg"))


def share(series: DataFrame) -> DataFrame:
    """Each value's share of its series' sum of absolute values; series without any are dropped."""
    total = F.sum(F.abs("y")).over(W.partitionBy("series_id"))
    return series.withColumn("total", total).where("total > 0").select("series_id", F.col("x").alias("category_no"), (F.abs("y") / F.col("total")).alias("share"))


def ohlc(prices: DataFrame) -> DataFrame:
    out = prices.groupBy("period").agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close")
    )
    return out.withColumn("up", F.col("close") >= F.col("open"))


def stddev(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("sd"))


def error_bars(series: DataFrame, kind: str, value: float | None = None, custom: tuple[Column, Column] | None = None) -> DataFrame:
    """Lower and upper end per point: FIXED, PERCENT, STANDARD_DEVIATION, STANDARD_ERROR or CUSTOM (plus, minus)."""
    w = W.partitionBy("series_id")
    sd, n, y = F.coalesce(F.stddev_samp("y").over(w), F.lit(0.0)), F.count("y").over(w), F.col("y")
    plus, minus = custom or (None, None)
    amount = {
        "FIXED": F.lit(value or 0.0), "PERCENT": F.abs(y) * (value or 0.0) / 100, "STANDARD_DEVIATION": sd * (1.0 if value is None else value),
        "STANDARD_ERROR": sd / F.sqrt(F.greatest(n, F.lit(1))),
    }.get(kind)
    return series.select("series_id", F.col("x").alias("category_no"), (y - (minus if kind == "CUSTOM" else amount)).alias("lower"), (y + (plus if kind == "CUSTOM" else amount)).alias("upper"))


def fit_linear(series: DataFrame) -> DataFrame:
    """Least squares y = a + b x per series; null where there are fewer than two points or no spread of x."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    both = x.isNotNull() & y.isNotNull()
    some = (F.sum(both.cast("int")) >= 2) & (F.coalesce(F.regr_sxx(y, x), F.lit(0.0)) >= SINGULAR)
    return series.groupBy("series_id").agg(F.when(some, F.regr_intercept(y, x)).alias("a"), F.when(some, F.regr_slope(y, x)).alias("b"))


def fit_curve(series: DataFrame, kind: str) -> DataFrame:
    """Log, exp or power fit by a linear one of logarithms, points that have none dropped: series_id, x, a, b, fitted."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    lx, ly = kind in ("log", "power"), kind in ("exp", "power")
    used = series.where(((x > 0) if lx else F.lit(True)) & ((y > 0) if ly else F.lit(True)))
    made = used.select("series_id", (F.log(x) if lx else x).alias("x"), (F.log(y) if ly else y).alias("y"))
    # one row per series
    line = fit_linear(made)
    fitted = F.col("a") + F.col("b") * (F.log(x) if lx else x)
    return used.join(line, "series_id").select("series_id", "x", "a", "b", (F.exp(fitted) if ly else fitted).alias("fitted"))


def _solve(batches: Iterator[pd.DataFrame], degree: int) -> Iterator[pd.DataFrame]:
    for sums in batches:
        rows = []
        for r in sums.itertuples(index=False):
            m = np.array([[r.powers[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
            ok = r.n > degree and abs(np.linalg.det(m / np.abs(m).max())) > SINGULAR ** (degree)
            rows.append([float(c) for c in np.linalg.solve(m, np.array(r.moments))] if ok else None)
        yield pd.DataFrame({"series_id": sums["series_id"], "coefficients": rows})


def fit_poly(series: DataFrame, degree: int) -> DataFrame:
    """Coefficients (constant first) of a polynomial of degree 1 to 6 per series; null where the equations are singular.

    Spark adds up powers and moments; degrees 1 and 2 are solved by determinants in column expressions, higher ones by a
    small solver on the sums, one row per series.
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = series.where(x.isNotNull() & y.isNotNull()).groupBy("series_id").agg(
        F.count("*").alias("n"), *[F.sum(F.pow(x, F.lit(k))).alias(f"p{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow(x, F.lit(k)) * y).alias(f"m{k}") for k in range(degree + 1)]
    )
    if degree > 2:
        packed = sums.select("series_id", "n", F.array(*[f"p{k}" for k in range(2 * degree + 1)]).alias("powers"), F.array(*[f"m{k}" for k in range(degree + 1)]).alias("moments"))
        return packed.mapInPandas(lambda it: _solve(it, degree), "series_id string, coefficients array<double>")
    p, m = [F.col(f"p{k}") for k in range(2 * degree + 1)], [F.col(f"m{k}") for k in range(degree + 1)]
    if degree == 1:
        det = p[0] * p[2] - p[1] * p[1]
        out = [(m[0] * p[2] - m[1] * p[1]) / det, (p[0] * m[1] - p[1] * m[0]) / det]
    else:
        def det3(a: list[list[Column]]) -> Column:
            return a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])

        rows = [[p[i + j] for j in range(3)] for i in range(3)]
        det = det3(rows)
        out = [det3([[m[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]) / det for k in range(3)]
    return sums.select("series_id", F.when((F.col("n") > degree) & (F.abs(det) > SINGULAR), F.array(*out)).alias("coefficients"))


def fit_r2(series: DataFrame) -> DataFrame:
    """R² of the linear fit as text with two decimals; 0.00 where there is no fit, else 1.00 where y does not vary."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    flat = F.coalesce(F.regr_syy(y, x), F.lit(0.0)) < SINGULAR
    none = (F.count(x) < 2) | (F.coalesce(F.regr_sxx(y, x), F.lit(0.0)) < SINGULAR)
    value = F.least(F.greatest(F.regr_r2(y, x), F.lit(0.0)), F.lit(1.0))
    return series.groupBy("series_id").agg(F.when(none, "0.00").when(flat, "1.00").otherwise(F.format_number(value, 2)).alias("r2"))


def moving_average(series: DataFrame, period: int = 2) -> DataFrame:
    w = W.partitionBy("series_id").orderBy("x").rowsBetween(-(max(period, 1) - 1), 0)
    return series.select("series_id", "x", F.avg("y").over(w).alias("ma"))


def stack_offsets(series: DataFrame) -> DataFrame:
    """Start and end of each value when a category's values are stacked, those below zero downwards: one window."""
    side = F.when(F.col("y") >= 0, 1).otherwise(-1)
    w = W.partitionBy("x", side).orderBy("series_id").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum("y").over(w)
    return series.select("series_id", F.col("x").alias("category_no"), (end - F.col("y")).alias("start"), end.alias("end"))


def densify(points: DataFrame) -> DataFrame:
    """Sparse points (chart_id, series_id, category_no, label, y) as a row per category up to the longest series."""
    longest = points.groupBy("chart_id").agg(F.max("category_no").alias("last"))
    grid = points.select("chart_id", "series_id").distinct().join(longest, "chart_id").withColumn("category_no", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    joined = grid.join(points, ["chart_id", "series_id", "category_no"], "left")
    label = F.coalesce(F.nullif(F.trim("label"), F.lit("")), (F.col("category_no") + 1).cast("string"))
    return joined.select("chart_id", "series_id", "category_no", label.alias("label"), "y")


def scale(series: DataFrame, kind: str) -> DataFrame:
    """`size`: 0.3 to 1 between the least and the largest value, 0.6 when flat; `peak`: the share of the largest size."""
    w, y = W.partitionBy("series_id"), F.col("y")
    low, high, peak = F.min("y").over(w), F.max("y").over(w), F.max(F.abs("y")).over(w)
    size = F.when(high - low > 0, 0.3 + 0.7 * (y - low) / (high - low)).otherwise(0.6)
    return series.select("series_id", "x", (size if kind == "size" else F.abs(y) / F.when(peak > 0, peak).otherwise(1.0)).alias("scaled"))


def labels(series: DataFrame, name: bool = True, category: bool = True, value: bool = True, percent: bool = False, code: str = "#,##0") -> DataFrame:
    total = F.sum(F.abs("y")).over(W.partitionBy("series_id"))
    parts = []
    if name:
        parts.append(F.col("series_id"))
    if category:
        parts.append(F.col("x").cast("string"))
    if value:
        parts.append(number_format(F.col("y"), code))
    if percent:
        parts.append(F.when(total > 0, number_format(F.col("y") / total, "0%")))
    return series.select("series_id", F.col("x").alias("category_no"), F.concat_ws("\n", *parts).alias("label"))


def axis_ticks(extent: DataFrame, fixed_step: float | None = None) -> DataFrame:
    """Ticks of an axis from (min, max), zero included: tick_no, value; step 1, 2, 5 or 10 times a power of ten, 200 at most."""
    low, high = F.least("min", F.lit(0.0)), F.greatest("max", F.lit(0.0))
    flat = high - low < 1e-9
    rows = extent.select(F.when(flat & (low < 0), low - 1).otherwise(low).alias("low"), F.when(flat, high + 1).otherwise(high).alias("high"), *[c for c in extent.columns if c not in ("min", "max")])
    raw = (F.col("high") - F.col("low")) / 5
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    part = raw / base
    nice = base * F.when(part <= 1, 1.0).when(part <= 2, 2.0).when(part <= 5, 5.0).otherwise(10.0)
    rows = rows.withColumn("step", F.lit(fixed_step) if fixed_step and fixed_step > 0 else nice)
    first = F.ceil(F.col("low") / F.col("step"))
    n = F.least(F.floor((F.col("high") + F.col("step") * 1e-6) / F.col("step")) - first, F.lit(199))
    ticks = rows.withColumn("first", first).withColumn("tick_no", F.explode(F.sequence(F.lit(0), F.greatest(n, F.lit(0)).cast("int"))))
    return ticks.withColumn("value", (F.col("first") + F.col("tick_no")) * F.col("step")).drop("low", "high", "first")
