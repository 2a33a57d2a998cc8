"""Column selection, alignment, row and target rules."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.operators import schema as S
from tabprep.operators.missing import missing_row_flag
from tabprep.operators.outliers import OutlierDetector
from tabprep.queries.registry import null_when, query, table


def _gaps(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", null_when(F.col("event_id") % 10 == 0, "value").alias("value"),
                    null_when(F.col("event_id") % 15 == 0, "event_type").alias("event_type"))


@query("exclude_columns", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def exclude_columns(spark, sf):
    return S.exclude_columns(table(spark, sf, "customer"), ["c_name", "c_mktsegment", "absent"])


@query("separate_target", """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority
                             FROM orders""")
def separate_target(spark, sf):
    orders = table(spark, sf, "orders")
    features, _ = S.separate_target(orders, "o_orderstatus")
    return orders.select(*features)


@query("recombine_target", """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
                                     o_orderstatus FROM orders""")
def recombine_target(spark, sf):
    return S.recombine_target(table(spark, sf, "orders"), "o_orderstatus")


@query("align_raw", """SELECT s_suppkey, s_acctbal, NULL::VARCHAR AS s_comment, NULL::DOUBLE AS s_rating
                       FROM supplier""")
def align_raw(spark, sf):
    schema = T.StructType.fromDDL("s_suppkey bigint, s_acctbal double, s_comment string, s_rating double")
    return S.align_raw(table(spark, sf, "supplier"), schema)


@query("align_schema", """
SELECT coalesce(CASE WHEN event_id % 10 <> 0 THEN value END, 0.0) AS value,
       user_id::INTEGER AS user_id, coalesce(try_cast(event_type AS DOUBLE), 0.0) AS event_type,
       0::BIGINT AS clicks, 0.0::DOUBLE AS score, false AS active
FROM events""")
def align_schema(spark, sf):
    fields = [{"name": "value", "dtype": "float64"}, {"name": "user_id", "dtype": "int32"},
              {"name": "event_type", "dtype": "float64"}, {"name": "clicks", "dtype": "int64"},
              {"name": "score", "dtype": "float64"}, {"name": "active", "dtype": "bool"}]
    return S.align_schema(_gaps(spark, sf), fields)


@query("finalize_output", """SELECT s_acctbal, 0.0::DOUBLE AS made_later, s_suppkey, s_nationkey
                             FROM supplier""")
def finalize_output(spark, sf):
    return S.finalize_output(table(spark, sf, "supplier"), ["s_acctbal", "made_later", "s_suppkey"],
                             "s_nationkey")


@query("clean_inf", """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 2, 3) THEN 0.0 ELSE value END AS value FROM events""")
def clean_inf(spark, sf):
    k = F.col("event_id") % 5
    broken = (F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(float("-inf")))
              .when(k == 2, F.lit(float("nan"))).when(k == 4, F.col("value")))
    return S.clean_infinite(table(spark, sf, "events").select("event_id", broken.alias("value")))


@query("drop_flag_columns", """SELECT event_id, user_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value,
    CASE WHEN event_id % 15 <> 0 THEN event_type END AS event_type FROM events""")
def drop_flag_columns(spark, sf):
    flagged = missing_row_flag(_gaps(spark, sf))
    flagged = OutlierDetector(columns=["value"]).fit(flagged).transform(flagged)
    return S.drop_flag_columns(flagged)


@query("nan_rows", """
SELECT event_id, user_id, CASE WHEN event_id % 10 <> 0 THEN value END AS value,
       CASE WHEN event_id % 15 <> 0 THEN event_type END AS event_type
FROM events WHERE event_id % 10 = 0 OR event_id % 15 = 0 ORDER BY event_id LIMIT 5""")
def nan_rows(spark, sf):
    return S.rows_with_missing(_gaps(spark, sf)).orderBy("event_id").limit(5)


@query("rows_in_valid_classes", """
SELECT c_custkey, c_acctbal, k FROM (SELECT c_custkey, c_acctbal,
  CASE WHEN c_custkey % 500 = 1 THEN c_custkey ELSE c_nationkey END AS k FROM customer)
WHERE k IN (SELECT k FROM (SELECT CASE WHEN c_custkey % 500 = 1 THEN c_custkey ELSE c_nationkey END AS k
                           FROM customer) GROUP BY k HAVING count(*) >= 2)""")
def rows_in_valid_classes(spark, sf):
    k = F.when(F.col("c_custkey") % 500 == 1, F.col("c_custkey")).otherwise(F.col("c_nationkey"))
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", k.alias("k"))
    return S.keep_valid_classes(rows, "k").select("c_custkey", "c_acctbal", "k")


@query("binarize_target", """SELECT l_orderkey, l_linenumber, (l_discount >= 0.05)::INTEGER AS l_discount
                             FROM lineitem""")
def binarize_target(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return S.binarize_target(rows, "l_discount", 0.05)
