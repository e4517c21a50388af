"""Dataset store operators: datasets of events, some in the hot tier, some durable, some in both."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from suite.common import Suite, table
from suite.tables import DATASETS_CTE, NOW as CREATED, SEED, event_datasets
from synthloom.operators import store as B
from synthloom.session import persist_reliably, work_dir
from synthloom.sources.storelog import StoreLog, sync_logs

suite = Suite()
NOW = dt.datetime(2024, 2, 20, tzinfo=dt.timezone.utc)
NOW_SQL = "TIMESTAMP '2024-02-20'"
BASE = 1704067200


def tiers(spark, sf):
    """Datasets created one minute per event id; types decide the tier, so both grow with the data.

    The store is a stored table: it is written once and the operators read it.
    """
    first = F.get_json_object("data", "$.items[0].event_id").cast("bigint")
    created = F.timestamp_seconds(F.lit(BASE) + first % 50_000 * 60)
    ds = event_datasets(spark, sf).withColumn("created_at", created)
    ds = persist_reliably(ds.withColumn("expires_at", F.col("created_at") + F.make_interval(days=F.lit(30))))
    return ds.where("schema_name <> 'error'"), ds.where("schema_name <> 'click'")


TIERS = f"""{DATASETS_CTE}, ds AS (SELECT *, make_timestamp(({BASE}+first_event%50000*60)*1000000) AS created_at FROM datasets),
full_ds AS (SELECT *, created_at + INTERVAL 30 DAY AS expires_at FROM ds),
hot AS (SELECT * FROM full_ds WHERE schema_name <> 'error'), durable AS (SELECT * FROM full_ds WHERE schema_name <> 'click')"""


def us(c):
    return F.unix_micros(c).alias(c)


@suite.add("b1_find_missing", f"WITH {TIERS} SELECT id FROM hot WHERE id NOT IN (SELECT id FROM durable)")
def find_missing(spark, sf):
    return B.find_missing(*tiers(spark, sf))


@suite.add("b2_batch_sync", f"""WITH {TIERS}
SELECT id, schema_name, epoch_us(created_at) AS created_at, epoch_us(expires_at) AS expires_at FROM durable
UNION ALL SELECT id, schema_name, epoch_us({NOW_SQL}), epoch_us({NOW_SQL}+INTERVAL 30 DAY) FROM hot WHERE id NOT IN (SELECT id FROM durable)""")
def batch_sync(spark, sf):
    hot, durable = tiers(spark, sf)
    return B.batch_sync(hot, durable, NOW)[0].select("id", "schema_name", us("created_at"), us("expires_at"))


@suite.add("b2_store_commits", f"""WITH {TIERS},
moved AS (SELECT * FROM durable UNION ALL SELECT * REPLACE ({NOW_SQL} AS created_at, {NOW_SQL}+INTERVAL 30 DAY AS expires_at) FROM hot WHERE id NOT IN (SELECT id FROM durable))
SELECT 'durable' AS tier, id, schema_name, epoch_us(created_at) + CASE WHEN schema_name = 'view' THEN 1000000 ELSE 0 END AS created_at FROM moved
WHERE expires_at >= {NOW_SQL} AND schema_name <> 'click'
UNION ALL SELECT 'hot', id, schema_name, epoch_us(created_at) FROM full_ds WHERE schema_name = 'error'""")
def store_commits(spark, sf):
    """Two stores over several commits: a sync that is repeated, a purge, an update, a delete, compactions between."""
    hot, durable = tiers(spark, sf)
    ddl = ", ".join(f"`{n}` {t}" for n, t in hot.dtypes)
    h, d = (StoreLog(spark, work_dir(spark, name), ddl) for name in ("hot", "durable"))
    h.commit(put=hot, retry_key="load")
    d.commit(put=durable, retry_key="load")
    for _ in range(2):
        sync_logs(h, d, lambda a, b: B.batch_sync(a, b, NOW), "sync")
    d.commit(delete=d.read().where(F.col("expires_at") < B.moment(NOW)), retry_key="purge")
    d.compact()
    d.commit(put=d.read().where("schema_name = 'view'").withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 SECOND")), retry_key="update")
    d.commit(delete=d.read().where("schema_name = 'click'"))
    h.commit(put=durable.where("schema_name = 'error'"))
    h.compact()
    found = d.read().withColumn("tier", F.lit("durable")).unionByName(h.read().withColumn("tier", F.lit("hot")))
    return found.select("tier", "id", "schema_name", us("created_at"))


@suite.add("b2_batch_sync_report", f"""WITH {TIERS}, b AS (SELECT * FROM hot ORDER BY id LIMIT 1000)
SELECT count_if(id IN (SELECT id FROM durable)) AS already_durable, count_if(id NOT IN (SELECT id FROM durable)) AS synced,
 coalesce(sum(CASE WHEN id NOT IN (SELECT id FROM durable) THEN octet_length(encode(data)) END), 0)::BIGINT AS bytes FROM b""")
def batch_sync_report(spark, sf):
    hot, durable = tiers(spark, sf)
    return B.batch_sync(hot, durable, NOW, batch_limit=1000)[2]


@suite.add("b3_retrieve", f"""WITH {TIERS}
SELECT id, schema_name, 'hot' AS tier, false AS copied FROM hot UNION ALL
SELECT id, schema_name, 'durable', true FROM durable WHERE expires_at > {NOW_SQL} AND id NOT IN (SELECT id FROM hot)""")
def retrieve(spark, sf):
    hot, durable = tiers(spark, sf)
    found, back = B.retrieve(hot, durable, event_datasets(spark, sf).select("id"), NOW)
    marked = back.select("id", F.lit(True).alias("copied"))
    return found.join(marked, "id", "left").select(
        "id", "schema_name", "tier", F.coalesce("copied", F.lit(False)).alias("copied"))


@suite.add("b4_metadata", f"""WITH {TIERS}
SELECT id, schema_name, {SEED}::BIGINT AS seed, n AS count, 'list_shuffle' AS faults, epoch_us(created_at) AS created_at,
 epoch_us(expires_at) AS expires_at FROM hot""")
def metadata(spark, sf):
    return B.metadata(tiers(spark, sf)[0]).select(
        "id", "schema_name", "seed", "count", F.array_join("chaos_applied", ",").alias("faults"), us("created_at"), us("expires_at"))


def _page(n, limit):
    off = (n - 1) * limit
    front = (f"(SELECT *, 0 AS t FROM hot WHERE id NOT IN (SELECT id FROM page) ORDER BY created_at DESC, id LIMIT {2 * limit})"
             if n == 1 else "(SELECT *, 0 AS t FROM hot WHERE false)")
    return f"""SELECT {n}::INT AS page, id, n AS count, (SELECT t FROM total) AS total, {off + limit} < (SELECT t FROM total) AS has_next, {str(n > 1).lower()} AS has_prev
 FROM (WITH page AS (SELECT * FROM durable WHERE expires_at > {NOW_SQL} ORDER BY created_at DESC, id LIMIT {limit} OFFSET {off})
 SELECT * FROM (SELECT * FROM {front} UNION ALL SELECT *, 1 FROM page) ORDER BY t, created_at DESC, id LIMIT {limit})"""


@suite.add("b5_list_page", f"""WITH {TIERS}, total AS (SELECT (SELECT count(*) FROM durable WHERE expires_at > {NOW_SQL})+(SELECT count(*) FROM hot) AS t)
{_page(1, 100)} UNION ALL {_page(2, 5)}""")
def list_page(spark, sf):
    hot, durable = tiers(spark, sf)
    pages = [B.list_page(hot, durable, n, limit, NOW).select(
        F.lit(n).alias("page"), "id", "count", "total", "has_next", "has_prev") for n, limit in ((1, 100), (2, 5))]
    return pages[0].unionByName(pages[1])


@suite.add("b6_purge_expired", f"WITH {TIERS} SELECT count_if(expires_at < {NOW_SQL} - INTERVAL 18 DAY) AS deleted, count_if(expires_at >= {NOW_SQL} - INTERVAL 18 DAY) AS kept FROM durable")
def purge_expired(spark, sf):
    return B.purge_expired(tiers(spark, sf)[1], NOW - dt.timedelta(days=18))[1]


@suite.add("b7_size_by_schema", f"""WITH {TIERS}
SELECT schema_name, count(*) AS datasets, sum(octet_length(encode(data)))::DOUBLE/1048576 AS mb, 'hot' AS tier FROM hot GROUP BY 1
UNION ALL SELECT schema_name, count(*), sum(octet_length(encode(data)))::DOUBLE/1048576, 'durable' FROM durable GROUP BY 1""")
def size_by_schema(spark, sf):
    hot, durable = tiers(spark, sf)
    return B.size_by_schema(hot, "hot").unionByName(B.size_by_schema(durable, "durable"))


_VICTIM = f"md5('view|{SEED}|{CREATED.isoformat()}|0')"


@suite.add("b8_delete_dataset", f"""WITH {TIERS}
SELECT 'hot' AS tier, count(*) AS datasets, true AS found FROM hot WHERE id <> {_VICTIM}
UNION ALL SELECT 'durable', count(*), true FROM durable WHERE id <> {_VICTIM}""")
def delete_dataset(spark, sf):
    import hashlib
    hot, durable = tiers(spark, sf)
    victim = hashlib.md5(f"view|{SEED}|{CREATED.isoformat()}|0".encode()).hexdigest()
    hot, durable, report = B.delete_dataset(hot, durable, victim)
    found = report.select("found").scalar()
    return (hot.agg(F.count("*").alias("datasets")).select(F.lit("hot").alias("tier"), "datasets", found.alias("found"))
            .unionByName(durable.agg(F.count("*").alias("datasets")).select(F.lit("durable").alias("tier"), "datasets", found.alias("found"))))


STATE_NOW = dt.datetime(2024, 1, 30, tzinfo=dt.timezone.utc)


@suite.add("b9_user_state_list", """
WITH s AS (SELECT user_id, event_type, max(ts) + INTERVAL 86400 SECOND AS expires_at FROM events GROUP BY ALL),
a AS (SELECT *, date_diff('microsecond', TIMESTAMP '2024-01-30', expires_at)//1000000 AS ttl FROM s)
SELECT user_id, string_agg(event_type||':'||ttl, ',' ORDER BY event_type) AS schemas FROM a WHERE ttl > 0 GROUP BY 1""")
def user_state_list(spark, sf):
    state = B.user_state(table(spark, sf, "events"), "user_id", "event_type", "ts", "value")
    out = B.user_state_list(state, STATE_NOW)
    return out.select("user_id", F.array_join(F.transform("schemas", lambda s: F.concat_ws(
        ":", s["schema_name"], s["ttl"].cast("string"))), ",").alias("schemas"))
