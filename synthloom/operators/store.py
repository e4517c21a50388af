"""Dataset store: a hot and a durable tier as tables; every operation yields new snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MB = 1_048_576
MAX_PAGE = 100


def moment(now: dt.datetime) -> Column:
    return F.lit(now.replace(tzinfo=now.tzinfo or dt.timezone.utc))


def find_missing(hot: DataFrame, durable: DataFrame) -> DataFrame:
    """Ids in the hot tier that the durable tier lacks."""
    return hot.select("id").join(durable.select("id"), "id", "left_anti")


def batch_sync(hot: DataFrame, durable: DataFrame, now: dt.datetime, batch_limit: int | None = None,
               ttl_days: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move hot datasets to the durable tier: ``(durable, hot, report)``.

    Ids already durable are dropped from hot; missing ones are inserted with fresh dates. Without a
    limit the tier is drained; with one, the first ids in order are handled. Inserting is by absent
    key, so repeating a sync changes nothing.
    """
    batch = hot if batch_limit is None else hot.orderBy("id").limit(batch_limit)
    created = moment(now)
    missing = batch.join(durable.select("id"), "id", "left_anti")
    added = missing.withColumns({
        "created_at": created, "expires_at": created + F.make_interval(days=F.lit(ttl_days))})
    new_durable = durable.unionByName(added.select(*durable.columns))
    new_hot = hot.limit(0) if batch_limit is None else hot.join(batch.select("id"), "id", "left_anti")
    known = batch.select("id", F.octet_length("data").alias("_b")).join(
        durable.select("id", F.lit(True).alias("_known")), "id", "left")
    report = known.agg(
        F.count_if(F.col("_known").isNotNull()).alias("already_durable"),
        F.count_if(F.col("_known").isNull()).alias("synced"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_b"))), F.lit(0)).cast("bigint").alias("bytes"))
    return new_durable, new_hot, report


def retrieve(hot: DataFrame, durable: DataFrame, ids: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Datasets for ``ids``: hot first, else durable and not expired. Second result: rows to copy back.

    The wanted ids filter both tiers before anything is compared.
    """
    wanted = ids.select("id").distinct()
    warm = hot.join(wanted, "id", "left_semi")
    cold = (durable.where(F.col("expires_at") > moment(now)).join(wanted, "id", "left_semi")
            .join(warm.select("id"), "id", "left_anti"))
    found = warm.withColumn("tier", F.lit("hot")).unionByName(cold.withColumn("tier", F.lit("durable")))
    return found, cold


def item_count(data: str = "data") -> Column:
    return F.coalesce(F.json_array_length(F.get_json_object(data, "$.items")), F.lit(0)).cast("bigint")


def metadata(datasets: DataFrame) -> DataFrame:
    """Description of each dataset without its items."""
    return datasets.select("id", "schema_name", "seed", item_count().alias("count"), "chaos_applied",
                           "created_at", "expires_at")


def list_page(hot: DataFrame, durable: DataFrame, page: int, limit: int, now: dt.datetime) -> DataFrame:
    """One page of live datasets, newest first, with paging facts on each row.

    Page 1 puts hot datasets that are not on the durable page in front and cuts to ``limit``. The total
    counts a dataset in both tiers twice (``total``). Pages are top-k selections, never full sorts.
    """
    if page < 1 or not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"need page >= 1 and limit within 1..{MAX_PAGE}")
    newest = [F.col("created_at").desc(), F.col("id")]
    offset = (page - 1) * limit
    live = durable.where(F.col("expires_at") > moment(now))
    total = live.agg(F.count("*").alias("n")).scalar() + hot.agg(F.count("*").alias("n")).scalar()
    rows = live.orderBy(*newest).offset(offset).limit(limit).withColumn("_tier", F.lit(1))
    if page == 1:
        # a hot row beyond the first limit + |page| can never reach the page: |page| <= limit
        front = hot.orderBy(*newest).limit(2 * limit).join(rows.select("id"), "id", "left_anti")
        rows = (front.withColumn("_tier", F.lit(0)).unionByName(rows)
                .orderBy("_tier", *newest).limit(limit))
    return metadata(rows).withColumn("total", total).withColumns({
        "has_next": F.lit(offset + limit) < F.col("total"), "has_prev": F.lit(page > 1)})


def purge_expired(datasets: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """``(kept, report)``: rows past their expiry are deleted and counted."""
    gone = F.col("expires_at") < moment(now)
    return datasets.where(~gone), datasets.agg(
        F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


def hot_expired(hot: DataFrame, now: dt.datetime, ttl_hours: int = 24) -> DataFrame:
    """Hot rows that are still within their time to live."""
    return hot.where(F.col("created_at") + F.make_interval(hours=F.lit(ttl_hours)) >= moment(now))


def size_by_schema(datasets: DataFrame, tier: str) -> DataFrame:
    """Stored megabytes per schema (UTF-8 bytes of the documents)."""
    return datasets.groupBy("schema_name").agg(
        F.count("*").alias("datasets"), (F.sum(F.octet_length("data")) / F.lit(MB)).alias("mb")
    ).withColumn("tier", F.lit(tier))


def delete_dataset(hot: DataFrame, durable: DataFrame, dataset_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(hot, durable, report)`` without one dataset; the report says where it was found."""
    hit = F.col("id") == dataset_id
    where = hot.where(hit).select(F.lit("hot").alias("tier")).unionByName(
        durable.where(hit).select(F.lit("durable").alias("tier")))
    report = where.agg(F.count_if(F.col("tier") == "hot").alias("in_hot"),
                       F.count_if(F.col("tier") == "durable").alias("in_durable"),
                       (F.count("*") > 0).alias("found"))
    return hot.where(~hit), durable.where(~hit), report


def user_state(df: DataFrame, user: str, schema: str, ts: str, value: str, ttl_s: int = 86_400) -> DataFrame:
    """State per (user, schema): last value by time and when it expires."""
    return df.groupBy(F.col(user).alias("user_id"), F.col(schema).alias("schema_name")).agg(
        F.max_by(value, ts).alias("last_value"),
        (F.max(ts) + F.make_interval(secs=F.lit(ttl_s))).alias("expires_at"))


def user_state_list(state: DataFrame, now: dt.datetime, schema: str | None = None) -> DataFrame:
    """Users with their schemas and the seconds each state still lives; expired states are gone.

    A user's list is as long as the number of schemas, never the number of events.
    """
    ttl = F.timestamp_diff("SECOND", moment(now), F.col("expires_at").cast("timestamp"))
    alive = state.withColumn("ttl", ttl).where(F.col("ttl") > 0)
    if schema is not None:
        alive = alive.where(F.col("schema_name") == schema)
    return alive.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("schema_name", "ttl"))).alias("schemas"))


def user_state_get(state: DataFrame, user: object, schema: str) -> DataFrame:
    return state.where((F.col("user_id") == user) & (F.col("schema_name") == schema))


def user_state_delete(state: DataFrame, user: object, schema: str) -> DataFrame:
    return state.where(~((F.col("user_id") == user) & (F.col("schema_name") == schema)))
