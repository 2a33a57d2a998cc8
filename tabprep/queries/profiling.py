"""Profiles and plot data."""

from pyspark.sql import functions as F

from tabprep.operators import profiling as P
from tabprep.operators.distribution import DistributionTransformer
from tabprep.operators.sampling import sample_rows
from tabprep.queries.registry import query, rounded, table

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe(c, t, x=None):
    x = x or c
    return f"""SELECT '{c}' AS "column", count({x}) AS "count", round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std,
       round(min({x})::DOUBLE, 6) AS min, round(quantile_cont({x}, 0.25), 6) AS q25, round(median({x}), 6) AS q50,
       round(quantile_cont({x}, 0.75), 6) AS q75, round(max({x})::DOUBLE, 6) AS max FROM {t}"""


@query("describe_numeric", " UNION ALL ".join(_describe(c, "lineitem") for c in NUMBERS))
def describe_numeric(spark, sf):
    return rounded(P.describe_numeric(table(spark, sf, "lineitem"), NUMBERS))


def _describe_text(c, t):
    return f"""SELECT '{c}' AS "column", count({c}) AS "count", NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min,
       NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, NULL::DOUBLE AS q75, NULL::DOUBLE AS max, count(DISTINCT {c}) AS "unique",
       (SELECT {c} FROM {t} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top,
       (SELECT count(*) FROM {t} GROUP BY {c} ORDER BY 1 DESC LIMIT 1) AS freq FROM {t}"""


@query("describe_all", "SELECT *, NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM ("
       + " UNION ALL ".join(_describe(c, "part") for c in ("p_partkey", "p_size", "p_retailprice"))
       + ") UNION ALL " + " UNION ALL ".join(_describe_text(c, "part") for c in ("p_name", "p_brand", "p_type")))
def describe_all(spark, sf):
    return rounded(P.describe_all(table(spark, sf, "part")))


@query("describe_compare", f"""
SELECT "column", r."count" AS raw_count, r.mean AS raw_mean, r.std AS raw_std, r.min AS raw_min, r.q25 AS raw_q25,
       r.q50 AS raw_q50, r.q75 AS raw_q75, r.max AS raw_max, p."count" AS processed_count, p.mean AS processed_mean,
       p.std AS processed_std, p.min AS processed_min, p.q25 AS processed_q25, p.q50 AS processed_q50,
       p.q75 AS processed_q75, p.max AS processed_max
FROM ({_describe('value', 'events')}) r JOIN ({_describe('value', 'events', 'ln(value + 1)')}) p USING ("column")""")
def describe_compare(spark, sf):
    raw = table(spark, sf, "events").select("value")
    return rounded(P.compare_profiles(raw, DistributionTransformer("log").fit(raw).transform(raw)))


@query("value_counts", """SELECT source, count(*) AS "count" FROM documents GROUP BY 1""")
def value_counts(spark, sf):
    return P.value_counts(table(spark, sf, "documents"), "source")


@query("value_percent", """SELECT event_type, count(*) AS "count",
    round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 2) AS percent FROM events GROUP BY 1""")
def value_percent(spark, sf):
    return P.value_percent(table(spark, sf, "events"), "event_type")


@query("histogram", """
WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events),
     c AS (SELECT least(19, floor((value - lo) / w))::INTEGER AS bin, count(*) AS n FROM events, b GROUP BY 1)
SELECT i::INTEGER AS bin, round(lo + i * w, 6) AS bin_start, round(lo + (i + 1) * w, 6) AS bin_end, coalesce(n, 0) AS "count"
FROM (SELECT unnest(range(20)) AS i) r LEFT JOIN c ON r.i = c.bin, b""")
def histogram(spark, sf):
    return rounded(P.histogram(table(spark, sf, "events"), "value", 20))


def _box(group):
    key = "event_type" if group else "'all'"
    return f"""
WITH q AS (SELECT {key} AS category, count(value) AS n, quantile_cont(value, 0.25) AS q1, median(value) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT category, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(value) FILTER (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS fliers
FROM events JOIN q ON q.category = {key} GROUP BY category, n, q1, median, q3"""


@query("box_stats", _box(False))
def box_stats(spark, sf):
    return rounded(P.box_stats(table(spark, sf, "events"), "value"), 6, ["q1", "median", "q3"])


@query("box_stats_by_category", _box(True))
def box_stats_by_category(spark, sf):
    return rounded(P.box_stats(table(spark, sf, "events"), "value", "event_type"), 6, ["q1", "median", "q3"])


@query("pair_corr", "SELECT round(corr(l_quantity, l_extendedprice), 3) AS corr FROM lineitem")
def pair_corr(spark, sf):
    return P.pair_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("crosstab", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
       count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def crosstab(spark, sf):
    return P.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("crosstab_counts", "SELECT l_partkey, l_suppkey, count(*) AS \"count\" FROM lineitem GROUP BY ALL")
def crosstab_counts(spark, sf):
    return P.crosstab_counts(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query("box_stats_many_groups", """
WITH q AS (SELECT l_partkey AS category, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
                  median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT category, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS fliers
FROM lineitem JOIN q ON q.category = l_partkey GROUP BY category, n, q1, median, q3""")
def box_stats_many_groups(spark, sf):
    return rounded(P.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", "l_partkey"), 6, ["q1", "median", "q3"])


@query("scatter_sample", """SELECT value, user_id FROM events ORDER BY md5(event_id::VARCHAR || '42'), event_id LIMIT 1000""")
def scatter_sample(spark, sf):
    return sample_rows(table(spark, sf, "events"), "event_id", 1000).select("value", "user_id")


@query("table_overview", """
SELECT count(*) AS "rows", 6::INTEGER AS "columns", 'event_id, user_id, value' AS numeric_columns,
       'ts, event_type, props' AS other_columns FROM events""")
def table_overview(spark, sf):
    return P.table_overview(table(spark, sf, "events"))


@query("sample_head", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 5")
def sample_head(spark, sf):
    return table(spark, sf, "nation").orderBy(F.col("n_nationkey")).limit(5)
