"""Series queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireworks.operators import series as S
from quireworks.plans.registry import query

V = "monthly_series"
SIGNED = "s AS (SELECT series_id, x, CASE WHEN x % 3 = 0 THEN -y ELSE y END AS y FROM monthly_series)"


def signed(t):
    return t.monthly_series.withColumn("y", F.when(F.col("x") % 3 == 0, -F.col("y")).otherwise(F.col("y")))


def rounded(df, *columns, places=4):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("chart_category_totals", f"WITH {SIGNED} SELECT x AS category_no, round(sum(abs(y)), 4) AS total FROM s GROUP BY 1", V)
def _(t):
    return rounded(S.category_totals(signed(t)), "total")


@query("chart_stacked_extent", f"WITH {SIGNED} SELECT x AS category_no, round(coalesce(sum(y) FILTER (y >= 0), 0), 4) AS pos, round(coalesce(sum(y) FILTER (y < 0), 0), 4) AS neg FROM s GROUP BY 1", V)
def _(t):
    return rounded(S.stacked_extent(signed(t)), "pos", "neg")


@query("chart_share", f"WITH {SIGNED} SELECT series_id, x AS category_no, round(abs(y) / sum(abs(y)) OVER (PARTITION BY series_id), 9) AS share FROM s", V)
def _(t):
    return rounded(S.share(signed(t)), "share", places=9)


@query("chart_ohlc", "SELECT period, min_by(price, ts) AS open, max(price) AS high, min(price) AS low, max_by(price, ts) AS close, max_by(price, ts) >= min_by(price, ts) AS up FROM daily_prices GROUP BY 1", "daily_prices")
def _(t):
    return S.ohlc(t.daily_prices)


@query("stat_stddev", "SELECT series_id, round(coalesce(stddev_samp(y), 0), 3) AS sd FROM monthly_series GROUP BY 1", V)
def _(t):
    return rounded(S.stddev(t.monthly_series), "sd", places=3)


BARS = {
    "FIXED": "250.0", "PERCENT": "abs(y) * 5 / 100", "STANDARD_DEVIATION": "coalesce(stddev_samp(y) OVER (PARTITION BY series_id), 0) * 2",
    "STANDARD_ERROR": "coalesce(stddev_samp(y) OVER (PARTITION BY series_id), 0) / sqrt(greatest(count(y) OVER (PARTITION BY series_id), 1))",
}


@query("stat_error_bars", " UNION ALL ".join(f"SELECT '{k}' AS kind, series_id, x AS category_no, round(y - {e}, 4) AS lower, round(y + {e}, 4) AS upper FROM monthly_series" for k, e in BARS.items())
       + " UNION ALL SELECT 'CUSTOM', series_id, x, round(y - 0.5 * x, 4), round(y + x, 4) FROM monthly_series", V)
def _(t):
    out = None
    for kind, value in (("FIXED", 250.0), ("PERCENT", 5.0), ("STANDARD_DEVIATION", 2.0), ("STANDARD_ERROR", None), ("CUSTOM", None)):
        bars = S.error_bars(t.monthly_series, kind, value, (F.col("x"), F.col("x") * 0.5)).withColumn("kind", F.lit(kind))
        out = bars if out is None else out.unionByName(bars)
    return rounded(out, "lower", "upper")


@query("fit_linear", "SELECT series_id, round(regr_intercept(y, x), 2) AS a, round(regr_slope(y, x), 4) AS b FROM monthly_series GROUP BY 1", V)
def _(t):
    return rounded(rounded(S.fit_linear(t.monthly_series), "a", places=2), "b")


CURVES = {"log": ("ln(x)", "y", "a + b * ln(x)"), "exp": ("x", "ln(y)", "exp(a + b * x)"), "power": ("ln(x)", "ln(y)", "exp(a + b * ln(x))")}
for kind, (lx, ly, fitted) in CURVES.items():

    @query(f"fit_{kind}", f"""
        WITH u AS (SELECT * FROM monthly_series WHERE {'x > 0' if kind != 'exp' else 'true'} AND {'y > 0' if kind != 'log' else 'true'}),
             f AS (SELECT series_id, regr_intercept({ly}, {lx}) AS a, regr_slope({ly}, {lx}) AS b FROM u GROUP BY 1)
        SELECT u.series_id, x, round(a, 5) AS a, round(b, 6) AS b, round({fitted}, 2) AS fitted FROM u JOIN f USING (series_id)""", V)
    def _(t, kind=kind):
        return rounded(rounded(rounded(S.fit_curve(t.monthly_series, kind), "a", places=5), "b", places=6), "fitted", places=2)


@query("fit_poly", """
    WITH p AS (SELECT series_id, count(*)::DOUBLE AS p0, sum(x)::DOUBLE AS p1, sum(x * x)::DOUBLE AS p2, sum(x * x * x)::DOUBLE AS p3, sum(x * x * x * x)::DOUBLE AS p4, sum(y) AS m0, sum(x * y) AS m1, sum(x * x * y) AS m2 FROM monthly_series GROUP BY 1),
         d AS (SELECT *, p0 * (p2 * p4 - p3 * p3) - p1 * (p1 * p4 - p3 * p2) + p2 * (p1 * p3 - p2 * p2) AS det FROM p)
    SELECT series_id, 1 AS degree, round((m0 * p2 - m1 * p1) / (p0 * p2 - p1 * p1), 2) AS c0, round((p0 * m1 - p1 * m0) / (p0 * p2 - p1 * p1), 3) AS c1, NULL::DOUBLE AS c2 FROM d
    UNION ALL SELECT series_id, 2, round((m0 * (p2 * p4 - p3 * p3) - p1 * (m1 * p4 - p3 * m2) + p2 * (m1 * p3 - p2 * m2)) / det, 1),
           round((p0 * (m1 * p4 - p3 * m2) - m0 * (p1 * p4 - p3 * p2) + p2 * (p1 * m2 - m1 * p2)) / det, 2), round((p0 * (p2 * m2 - m1 * p3) - p1 * (p1 * m2 - m1 * p2) + m0 * (p1 * p3 - p2 * p2)) / det, 3) FROM d""", V)
def _(t):
    out = None
    for degree in (1, 2):
        c = S.fit_poly(t.monthly_series, degree)
        get = lambda k: F.get("coefficients", F.lit(k))
        part = c.select("series_id", F.lit(degree).alias("degree"), F.round(get(0), 2 if degree == 1 else 1).alias("c0"), F.round(get(1), 3 if degree == 1 else 2).alias("c1"), F.round(get(2), 3).alias("c2"))
        out = part if out is None else out.unionByName(part)
    return out


@query("fit_poly_high")
def _(t):
    """Degrees 3 to 6 on months scaled to 0..1, whose equations are well conditioned."""
    scaled = t.monthly_series.withColumn("x", F.col("x") / 83.0)
    out = None
    for degree in (3, 4, 5, 6):
        part = S.fit_poly(scaled, degree).withColumn("degree", F.lit(degree))
        out = part if out is None else out.unionByName(part)
    return out


@query("fit_r2", """
    SELECT series_id, CASE WHEN count(*) < 2 OR regr_sxx(y, x) < 1e-12 THEN '0.00' WHEN regr_syy(y, x) < 1e-12 THEN '1.00' ELSE format('{:.2f}', least(greatest(regr_r2(y, x), 0), 1)) END AS r2
    FROM (SELECT series_id, x, y FROM monthly_series UNION ALL SELECT 'flat', x, 1.0 FROM monthly_series UNION ALL SELECT 'point', 1, min(y) FROM monthly_series UNION ALL SELECT 'upright', 1, y FROM monthly_series) GROUP BY 1""", V)
def _(t):
    m = t.monthly_series.select("series_id", "x", "y")
    extra = m.select(F.lit("flat"), "x", F.lit(1.0)).union(m.agg(F.lit("point"), F.lit(1), F.min("y"))).union(m.select(F.lit("upright"), F.lit(1), "y"))
    return S.fit_r2(m.union(extra))


@query("moving_average", "SELECT series_id, x, round(avg(y) OVER (PARTITION BY series_id ORDER BY x ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS ma FROM monthly_series", V)
def _(t):
    return rounded(S.moving_average(t.monthly_series, 4), "ma")


@query("stack_offsets", f"""WITH {SIGNED}, e AS (SELECT series_id, x, y, sum(y) OVER (PARTITION BY x, y >= 0 ORDER BY series_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM s)
    SELECT series_id, x AS category_no, round(e - y, 3) AS start, round(e, 3) AS "end" FROM e""", V)
def _(t):
    return rounded(S.stack_offsets(signed(t)), "start", "end", places=3)


@query("series_densify", """
    WITH p AS (SELECT 1 AS chart_id, series_id, x AS category_no, CASE WHEN x % 4 = 0 THEN ' ' WHEN x % 4 = 1 THEN NULL ELSE 'm' || x END AS label, y FROM monthly_series WHERE x % 5 <> 0),
         g AS (SELECT DISTINCT chart_id, series_id, unnest(range(0, (SELECT max(category_no) FROM p) + 1)) AS category_no FROM p)
    SELECT chart_id, series_id, category_no, coalesce(nullif(trim(label), ''), (category_no + 1)::VARCHAR) AS label, y FROM g LEFT JOIN p USING (chart_id, series_id, category_no)""", V)
def _(t):
    label = F.when(F.col("x") % 4 == 0, " ").when(F.col("x") % 4 == 1, None).otherwise(F.concat(F.lit("m"), "x"))
    return S.densify(t.monthly_series.where("x % 5 <> 0").select(F.lit(1).alias("chart_id"), "series_id", F.col("x").alias("category_no"), label.alias("label"), "y"))


@query("series_scale", f"""WITH {SIGNED} SELECT 'size' AS kind, series_id, x, round(CASE WHEN max(y) OVER w > min(y) OVER w THEN 0.3 + 0.7 * (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) ELSE 0.6 END, 9) AS scaled FROM s WINDOW w AS (PARTITION BY series_id)
    UNION ALL SELECT 'peak', series_id, x, round(abs(y) / max(abs(y)) OVER (PARTITION BY series_id), 9) FROM s""", V)
def _(t):
    parts = [S.scale(signed(t), k).withColumn("kind", F.lit(k)) for k in ("size", "peak")]
    return rounded(parts[0].unionByName(parts[1]), "scaled", places=9)


@query("series_labels", "SELECT series_id, x AS category_no, series_id || chr(10) || x || chr(10) || format('{:,}', floor(y)::BIGINT) AS label FROM monthly_series", V)
def _(t):
    return S.labels(t.monthly_series.withColumn("y", F.floor("y").cast("double")))


@query("axis_ticks", """
    WITH e AS (SELECT series_id, least(min(y), 0.0::DOUBLE) AS low, greatest(max(y), 0.0::DOUBLE) AS high FROM monthly_series GROUP BY 1), b AS (SELECT *, (high - low) / 5 AS raw, pow(10, floor(log10((high - low) / 5))) AS base FROM e),
         s AS (SELECT *, base * CASE WHEN raw / base <= 1 THEN 1 WHEN raw / base <= 2 THEN 2 WHEN raw / base <= 5 THEN 5 ELSE 10 END AS step FROM b),
         n AS (SELECT series_id, step, low, unnest(range(0, 200)) AS tick_no, high FROM s)
    SELECT series_id, step, tick_no::INT AS tick_no, (ceil(low / step) + tick_no) * step AS value FROM n WHERE (ceil(low / step) + tick_no) * step <= high + step * 1e-6""", V)
def _(t):
    return S.axis_ticks(t.monthly_series.groupBy("series_id").agg(F.min("y").alias("min"), F.max("y").alias("max")))
