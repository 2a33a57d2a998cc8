"""Readers and writers: each query writes a given table with Spark and reads it back whole."""

from pyspark.sql import functions as F

from tabprep.operators.sampling import stratified_split
from tabprep.queries.registry import null_when, query, table
from tabprep.sources import readers, writers
from tabprep.sources.storage import fresh_path

_ORDERS = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
             FROM orders"""
_EVENTS = "SELECT event_id, ts, user_id, event_type, value FROM events"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("scan_parquet", "SELECT * FROM customer")
def scan_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/customer.parquet")


@query("scan_csv", _ORDERS)
def scan_csv(spark, sf):
    orders = table(spark, sf, "orders")
    path = writers.write_csv(orders, fresh_path(spark, "csv"))
    return readers.read_csv(spark, path, orders.schema)


@query("scan_csv_inferred", """SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey, s_acctbal
                               FROM supplier""")
def scan_csv_inferred(spark, sf):
    path = writers.write_csv(table(spark, sf, "supplier"), fresh_path(spark, "csv"))
    return readers.read_csv(spark, path)


@query("scan_txt", _EVENTS)
def scan_txt(spark, sf):
    events = _events(spark, sf)
    path = writers.write_txt(events, fresh_path(spark, "txt"))
    return readers.read_txt(spark, path, events.schema)


@query("scan_json", _EVENTS)
def scan_json(spark, sf):
    events = _events(spark, sf)
    path = writers.write_json(events, fresh_path(spark, "json"))
    return readers.read_json(spark, path, events.schema)


@query("sink_csv", "SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 10 <> 0 THEN value END AS value FROM events")
def sink_csv(spark, sf):
    gaps = _events(spark, sf).withColumn("value", null_when(F.col("event_id") % 10 == 0, "value"))
    path = writers.write_csv(gaps, fresh_path(spark, "csv"), sep=";")
    return readers.read_csv(spark, path, gaps.schema, sep=";")


@query("sink_txt", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def sink_txt(spark, sf):
    part = table(spark, sf, "part")
    return readers.read_txt(spark, writers.write_txt(part, fresh_path(spark, "txt")), part.schema)


@query("sink_json", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def sink_json(spark, sf):
    docs = table(spark, sf, "documents")
    return readers.read_json(spark, writers.write_json(docs, fresh_path(spark, "json")), docs.schema)


@query("sink_parquet", "SELECT vec_id, label, len(embedding)::INTEGER AS width FROM embeddings")
def sink_parquet(spark, sf):
    path = writers.write_parquet(table(spark, sf, "embeddings"), fresh_path(spark, "parquet"))
    return readers.read_parquet(spark, path).select("vec_id", "label", F.size("embedding").alias("width"))


@query("sink_split", """
WITH r AS (SELECT event_type, value,
                  row_number() OVER (PARTITION BY event_type
                                     ORDER BY md5(event_id::VARCHAR || '42')) AS k,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT CASE WHEN k <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split, event_type,
       count(*) AS n, round(sum(value), 4) AS total
FROM r GROUP BY 1, 2""")
def sink_split(spark, sf):
    split = stratified_split(_events(spark, sf), "event_type", "event_id")
    path = writers.write_split(split, fresh_path(spark, "split"))
    return (readers.read_parquet(spark, path).groupBy("split", "event_type")
            .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("sink_features_target", """
SELECT 'X' AS part, event_id, ts, user_id, value, NULL::VARCHAR AS event_type FROM events
UNION ALL SELECT 'y', NULL, NULL, NULL, NULL, event_type FROM events""")
def sink_features_target(spark, sf):
    """Both datasets read back whole."""
    x, y = writers.write_features_and_target(_events(spark, sf), fresh_path(spark, "xy"), "event_type")
    features = readers.read_parquet(spark, x).select(F.lit("X").alias("part"), "event_id", "ts", "user_id", "value")
    target = readers.read_parquet(spark, y).select(F.lit("y").alias("part"), "event_type")
    return features.unionByName(target, allowMissingColumns=True)


@query("validate_table", """
SELECT 'events' AS name, (count(*) >= 5)::INTEGER AS valid FROM events
UNION ALL SELECT 'region', (count(*) >= 5)::INTEGER FROM region
UNION ALL SELECT 'regions_of_one_name', (count(*) >= 5)::INTEGER FROM region WHERE r_name = 'ASIA'""")
def validate_table(spark, sf):
    region = table(spark, sf, "region")
    rows = [("events", readers.validate_table(table(spark, sf, "events"))),
            ("region", readers.validate_table(region)),
            ("regions_of_one_name", readers.validate_table(region.where("r_name = 'ASIA'")))]
    return spark.createDataFrame([(n, int(v)) for n, v in rows], "name string, valid int")


@query("normalize_missing", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events""")
def normalize_missing(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan")))
        .otherwise(F.col("value")).alias("value"))
    return readers.normalize_missing(events)
