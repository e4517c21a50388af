"""Tables that change: a log of segments and tombstones under a manifest, and a ledger of rows that were taken.

A writer adds a segment (rows put or deleted, sorted by key) and then a manifest that names all segments; a reader takes
the newest manifest and the newest row of each key. Manifests are numbered, a number is written once: of two writers
that want the same one, one succeeds and the other sees a conflict and tries again on top. A retry key makes a commit
repeatable: the second time it changes nothing. Manifests are a row each; data stays in Spark tables.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPTS = 20


class Conflict(RuntimeError):
    """Other writers were faster in every attempt."""


class Versions:
    """A small JSON document in numbered files; a number is written by one writer only, as the file system's create is."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def latest(self) -> tuple[int, Any]:
        """(number, document) of the newest version; (0, None) before the first."""
        try:
            every = self.spark.read.text(self.path, wholetext=True).select("value", F.col("_metadata.file_name").alias("name"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, None
        row = every.where("value <> ''").orderBy(F.desc("name")).first()
        return (int(row["name"].split(".")[0]), json.loads(row["value"])) if row else (0, None)

    def publish(self, version: int, payload: Any) -> bool:
        """Write a version; False if another writer has it."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/{version:012d}.json")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = files.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName() and "exists" not in str(e.java_exception.getMessage()):
                raise
            return False
        out.write(bytearray(json.dumps(payload).encode()))
        out.close()
        return True

    def change(self, step: Callable[[Any], tuple[Any, Any]]) -> Any:
        """Publish ``step(document) -> (new document or None, result)`` on the newest version, again after a conflict."""
        for _ in range(ATTEMPTS):
            version, payload = self.latest()
            new, result = step(payload)
            if new is None or self.publish(version + 1, new):
                return result
        raise Conflict(self.path)


@dataclass
class StoreLog:
    """A keyed table on storage. ``schema`` (DDL) holds the key column; other columns may be null."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "id"
    versions: Versions = field(init=False)

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, f"{self.path}/manifests")

    @property
    def types(self) -> dict[str, str]:
        return dict(self.spark.createDataFrame([], self.schema).dtypes)

    @property
    def columns(self) -> list[str]:
        return list(self.types)

    def _segment(self, rows: DataFrame) -> str:
        """Write rows (columns and ``_put``) as a segment that is sorted by key, so that reads of a key range skip files."""
        name = uuid.uuid4().hex
        rows.repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(f"{self.path}/segments/{name}")
        return name

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema + ", _put boolean").parquet(f"{self.path}/segments/{name}")

    def commit(self, put: DataFrame | None = None, delete: DataFrame | None = None, retry_key: str | None = None) -> bool:
        """Put rows and delete the keys of ``delete`` in one step; False if ``retry_key`` was committed before.

        A key that is put and deleted at once is put. Of rows of one key in ``put`` any one is kept.
        """
        def known(doc: Any) -> bool:
            return retry_key is not None and retry_key in (doc or {"keys": []})["keys"]

        if known(self.versions.latest()[1]):
            return False
        parts = []
        if put is not None:
            parts.append(put.select(*self.columns).dropDuplicates([self.key]).withColumn("_put", F.lit(True)))
        if delete is not None:
            gone = delete.select(self.key).distinct()
            gone = gone if put is None else gone.join(put.select(self.key), self.key, "left_anti")
            parts.append(gone.select(
                *[F.col(c) if c == self.key else F.lit(None).cast(t).alias(c) for c, t in self.types.items()], F.lit(False).alias("_put")))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        name = self._segment(rows)

        def step(doc: Any) -> tuple[Any, bool]:
            doc = doc or {"segments": [], "keys": []}
            if known(doc):
                return None, False
            return {"segments": [*doc["segments"], name], "keys": doc["keys"] + ([retry_key] if retry_key else [])}, True
        return self.versions.change(step)

    def read(self) -> DataFrame:
        """The table as of the newest manifest: of each key the newest row, unless it was deleted.

        A filter on the key reaches every segment's scan.
        """
        doc = self.versions.latest()[1] or {"segments": []}
        return self._newest(doc["segments"])

    def _newest(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        if len(segments) == 1:
            return self._load(segments[0]).where("_put").drop("_put")
        every = None
        for number, name in enumerate(segments):
            part = self._load(name).withColumn("_seq", F.lit(number))
            every = part if every is None else every.unionByName(part)
        rest = [c for c in self.columns if c != self.key]
        last = every.groupBy(self.key).agg(F.max_by(F.struct(*rest, "_put"), "_seq").alias("_r"))
        return last.where("_r._put").select(*[F.col(c) if c == self.key else F.col(f"_r.`{c}`") for c in self.columns])

    def compact(self) -> None:
        """Join all segments to one without tombstones; commits that came meanwhile stay on top."""
        doc = self.versions.latest()[1]
        if not doc or len(doc["segments"]) < 2:
            return
        old = doc["segments"]
        name = self._segment(self._newest(old).withColumn("_put", F.lit(True)))

        def step(now: Any) -> tuple[Any, None]:
            if now["segments"][:len(old)] != old:  # another compaction was faster
                return None, None
            return now | {"segments": [name, *now["segments"][len(old):]]}, None
        self.versions.change(step)


def sync_logs(hot: StoreLog, durable: StoreLog, move: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]], retry_key: str) -> bool:
    """Run ``move(hot, durable) -> (durable, hot, report)`` on two stores and commit what it changes, durable first.

    With the same ``retry_key`` again only what is missing of the first run happens: rows never leave the hot tier
    before the durable one holds them.
    """
    before = durable.read()
    new_durable, new_hot, _ = move(hot.read(), before)
    added = durable.commit(put=new_durable.join(before.select(durable.key), durable.key, "left_anti"), retry_key=retry_key)
    gone = hot.read().select(hot.key).join(new_hot.select(hot.key), hot.key, "left_anti")
    left = hot.commit(delete=gone.join(durable.read().select(hot.key), hot.key, "left_semi"), retry_key=retry_key)
    return added or left


@dataclass
class ClaimLedger:
    """Which of a schema's prepared rows are taken: they are numbered from 0, and takers get intervals one after another."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.path)

    def claim(self, schema: str, k: int, size: int, retry_key: str | None = None) -> tuple[int, int]:
        """An interval [first, end) of at most ``k`` of ``size`` rows that nobody else has or gets; the same for the same key."""
        def step(doc: Any) -> tuple[Any, tuple[int, int]]:
            doc = doc or {"next": {}, "by_key": {}}
            if retry_key is not None and retry_key in doc["by_key"]:
                return None, tuple(doc["by_key"][retry_key])
            first = min(doc["next"].get(schema, 0), size)
            end = min(size, first + k)
            if first == end:
                return None, (first, end)
            by_key = doc["by_key"] | ({retry_key: [first, end]} if retry_key is not None else {})
            return {"next": doc["next"] | {schema: end}, "by_key": by_key}, (first, end)
        return self.versions.change(step)

    def take(self, prepared: DataFrame, live: DataFrame, schema: str, k: int, schema_col: str = "schema", row: str = "row_id",
             require: bool = False, retry_key: str | None = None) -> DataFrame:
        """Up to ``k`` prepared rows of a schema that are then taken; ``k`` live rows once nothing is left.

        ``require`` makes an exhausted store an error instead.
        """
        own = prepared.where(F.col(schema_col) == schema)
        size = own.agg((F.coalesce(F.max(row), F.lit(-1)) + 1).alias("n")).first()["n"]
        first, end = self.claim(schema, k, size, retry_key)
        if first < end:
            return own.where(F.col(row).between(first, end - 1))
        if require:
            raise LookupError(f"no prepared rows of {schema} left")
        return live.where(F.col(schema_col) == schema).select(*prepared.columns).orderBy(row).limit(k)
