"""Measurement operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.columns import dbl
from suite.common import Suite, table
from synthloom.operators import metrics as M

suite = Suite()
BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0]
HOUR = "epoch_us(date_trunc('hour', ts))//1000000"


@suite.add("m1_count_bucket", """
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CASE WHEN n<=10 THEN '1-10' WHEN n<=100 THEN '11-100' WHEN n<=1000 THEN '101-1000' WHEN n<=10000 THEN '1001-10000'
 ELSE '10000+' END AS bucket, count(*) AS keys FROM c GROUP BY 1""")
def count_bucket(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return counts.groupBy(M.count_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("keys"))


@suite.add("m2_labelled_counter", """
SELECT l_returnflag, l_linestatus, sum(l_extendedprice::DECIMAL(28,6))::DOUBLE AS total FROM lineitem GROUP BY 1, 2""")
def labelled_counter(spark, sf):
    return M.labelled_counter(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")


_HIST = "WITH b AS (SELECT unnest([" + ",".join(map(dbl, BOUNDS)) + ", 'inf'::DOUBLE]) AS le)"


@suite.add("m3_histogram", f"""{_HIST}
SELECT event_type, le, count(*) FILTER (value <= le) AS bucket, count(value) AS count, sum(value::DECIMAL(28,6))::DOUBLE AS sum
FROM events, b GROUP BY 1, 2""")
def histogram(spark, sf):
    return M.histogram(table(spark, sf, "events"), "value", BOUNDS, ["event_type"])


@suite.add("m4_rate", f"""
SELECT {HOUR} AS window_start, event_type, count(*)::DOUBLE/3600.0::DOUBLE AS per_second FROM events GROUP BY 1, 2""")
def rate(spark, sf):
    return M.rate(table(spark, sf, "events"), "ts", ["event_type"], "1 hour")


@suite.add("m5_histogram_quantile", f"""{_HIST},
h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS bucket, count(value) AS n FROM events, b GROUP BY 1, 2),
e AS (SELECT *, coalesce(lag(bucket) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lower FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le)),
r AS (SELECT *, unnest([{dbl(.5)}, {dbl(.95)}, {dbl(.99)}]) AS q FROM e)
SELECT event_type, q, CASE WHEN le = 'inf' THEN lower ELSE lower+(le-lower)*((q*n-below)/(bucket-below)) END AS value
FROM r WHERE bucket >= q*n AND below < q*n""")
def histogram_quantile(spark, sf):
    hist = M.histogram(table(spark, sf, "events"), "value", BOUNDS, ["event_type"])
    return M.histogram_quantile(hist, [0.5, 0.95, 0.99], ["event_type"])


@suite.add("m6_error_ratio", f"""
SELECT {HOUR} AS window_start, count_if(event_type='error')*100.0::DOUBLE/count(*) AS error_pct FROM events GROUP BY 1""")
def error_ratio(spark, sf):
    return M.error_ratio(table(spark, sf, "events"), "ts", F.col("event_type") == "error", "1 hour")


@suite.add("m7_gauge_by_label", """
WITH l AS (SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2)
SELECT event_type, max(v) AS max_value, sum(v::DECIMAL(28,6))::DOUBLE AS sum_value FROM l GROUP BY 1""")
def gauge_by_label(spark, sf):
    return M.gauge_by_label(table(spark, sf, "events"), "value", "ts", ["user_id"], "event_type", "event_id")


@suite.add("m8_percentiles", """
WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice)-1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT 0.5::DOUBLE AS q, (max(v) FILTER (i = (n//2))+max(v) FILTER (i = (n-1)//2))/2 AS value FROM s
UNION ALL SELECT 0.95, max(v) FILTER (i = floor(n*0.95::DOUBLE)::BIGINT) FROM s UNION ALL SELECT 0.99, max(v) FILTER (i = floor(n*0.99::DOUBLE)::BIGINT) FROM s""")
def percentiles(spark, sf):
    return M.percentiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.5, 0.95, 0.99])


@suite.add("m8_percentiles_by_group", """
WITH v AS (SELECT event_type, CASE WHEN user_id < 30 THEN 1.5 WHEN value > 50 THEN -value ELSE value END AS v FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v)-1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM v),
q AS (SELECT *, unnest([0.0::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]) AS q FROM s)
SELECT event_type, q, (max(v) FILTER (i = least(floor(n*q)::BIGINT, n-1)) + max(v) FILTER (i = CASE WHEN q = 0.5 THEN (n-1)//2 ELSE least(floor(n*q)::BIGINT, n-1) END))/2 AS value
FROM q GROUP BY 1, 2""")
def percentiles_by_group(spark, sf):
    v = F.when(F.col("user_id") < 30, 1.5).when(F.col("value") > 50, -F.col("value")).otherwise(F.col("value"))
    df = table(spark, sf, "events").select("event_type", v.alias("v"))
    return M.percentiles(df, "v", [0.0, 0.5, 0.9, 1.0], ["event_type"])


@suite.add("m9_half_compare", """
WITH r AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events),
h AS (SELECT value::DECIMAL(28,6) AS v, (epoch_us(ts)-a)*2 < b-a AS h FROM events, r),
m AS (SELECT sum(v) FILTER (h)::DOUBLE/count(*) FILTER (h) AS x, sum(v) FILTER (NOT h)::DOUBLE/count(*) FILTER (NOT h) AS y FROM h)
SELECT x AS first_half, y AS second_half, (y-x)/x*100.0::DOUBLE AS change_pct FROM m""")
def half_compare(spark, sf):
    return M.half_compare(table(spark, sf, "events"), "ts", "value")


@suite.add("m10_share_summary", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS phase, count_if(event_type<>'error') AS succeeded, count_if(event_type='error') AS failed,
 count_if(event_type<>'error')*100.0::DOUBLE/count(*) AS success_pct FROM events GROUP BY 1""")
def share_summary(spark, sf):
    return M.share_summary(table(spark, sf, "events"), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type") != "error")


@suite.add("m11_top_type", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type AS top, n AS times FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def top_type(spark, sf):
    return M.top_type(table(spark, sf, "events"), "user_id", "event_type", "event_id")
