"""Record stores: written tables, JSON import, keyed writes and deletes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ROW_GROUP_BYTES = 32 << 20     # a task holds one row group in memory while it writes

_written: dict[tuple[str, str], str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written tables and checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, a
    folder below the session's warehouse serves.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_work/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Searches run on the written records: scalar filters reach the scan, unread
    columns are pruned, and extraction is not repeated inside each predicate.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    # an empty table in folders has no file to tell its schema
    return (df.sparkSession.read.schema(df.schema) if partition_by else df.sparkSession.read).parquet(path)


def pin(df: DataFrame, name: str = "pinned") -> DataFrame:
    """``df`` as a written table, for a result that several branches of a plan read.

    Without it every branch would extract the same requests again, and a lost
    executor would redo the whole lineage instead of rereading a file.
    """
    return write_table(df, name)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, where it comes in fewer: for rows that cost much more than to move."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written_once(spark: SparkSession, key: str, build, partition_by: list[str] | None = None) -> DataFrame:
    """Table ``key`` of this application, built and written on first use."""
    slot = (spark.sparkContext.applicationId, key)
    if slot not in _written:
        path = fresh_path(spark, key.replace("/", "_").strip("_"))
        writer = build().write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        _written[slot] = path
    return spark.read.parquet(_written[slot])


def read_cases(spark: SparkSession, path: str, schema: str, required: list[str],
               one_per_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """JSON record store as (records, quarantine); one document per file, or per line.

    Unparsable documents go to the quarantine with their text; parsed ones
    that lack a required field are some other kind of record and are left out.
    """
    columns = T.StructType.fromDDL(f"{schema}, _corrupt STRING")
    parsed = F.from_json("value", columns, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    raw = (spark.read.text(path, wholetext=one_per_file)
           .select(F.col("_metadata.file_path").alias("_file"), "value", parsed.alias("_r")))
    good = raw.filter("_r._corrupt IS NULL").select("_r.*", "_file").drop("_corrupt")
    for column in required:
        good = good.filter(F.col(column).isNotNull())
    return good, raw.filter("_r._corrupt IS NOT NULL").select("_file", F.col("value").alias("_corrupt"))


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Newest row per key by the ``order`` columns.

    An aggregation, not a window: repeats of a hot key fold on the map side.
    """
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
            .select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def upsert(store: DataFrame, batch: DataFrame, key: str, *order: str) -> DataFrame:
    """Store after writing ``batch``; the last write per key wins.

    Only the batch's keys meet the store, in an anti join: a batch small enough
    is broadcast by the optimizer, and the store's rows do not move.
    """
    newest = latest(batch, key, *order)
    kept = store.join(newest.select(key), key, "left_anti")
    return kept.select(*store.columns).unionByName(newest.select(*store.columns))


def delete_by_key(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def delete_results(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Per requested key: whether there was a record to delete."""
    present = store.select(key).distinct().withColumn("deleted", F.lit(True))
    return keys.select(key).distinct().join(present, key, "left").withColumn(
        "deleted", F.coalesce("deleted", F.lit(False)))


class RecordStore:
    """Keyed records that are saved, loaded by key and deleted, in buckets by a hash of the key.

    A save writes only the buckets that hold keys of its batch, into a folder of its version, and then a manifest: a
    table that says for every bucket which version's folder has it, its rows and its range of keys. Readers follow the
    newest complete manifest, so a write that fails before leaves the old version in force. Files that none of the
    last ``grace`` manifests names are removed. One writer at a time. Rows without a key are not stored.

    ``save`` lets the last write win, ``merge`` the highest order. A bucket is one file and one task's work: let ``buckets`` grow with the store (about a gigabyte each). The number
    is fixed by the first save. What the driver holds is one manifest row a bucket.
    """

    MANIFEST = "bucket INT, written BIGINT, rows BIGINT, low STRING, high STRING, buckets INT, schema STRING"

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, grace: int = 3):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.grace = buckets, max(1, grace)

    def versions(self) -> list[int]:
        """Versions with a complete manifest, ascending."""
        return [v for v in _numbered(self.spark, f"{self.path}/manifests") if _exists(
            self.spark, f"{self.path}/manifests/{v}/_SUCCESS")]

    def version(self) -> int:
        """Newest complete version; 0 before the first save."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Per bucket of a version (by default the newest): bucket, written, rows, low and high key."""
        version = version or self.version()
        return (self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifests/{version}")
                .filter("bucket >= 0").drop("buckets", "schema"))

    def load(self, version: int | None = None) -> DataFrame:
        _, schema, places = self._read_manifest(version or self.version())
        return self._rows(schema, places)

    def get(self, key) -> DataFrame:
        """The record of ``key``, from its own bucket."""
        buckets, schema, places = self._read_manifest(self.version())
        kind = schema[self.key].dataType
        one = self.spark.range(1, numPartitions=1).select(_bucket(F.lit(key).cast(kind), buckets).alias("b")).first().b
        return self._rows(schema, {one: places[one]} if one in places else {}).filter(F.col(self.key) == key)

    def replace(self, records: DataFrame) -> DataFrame:
        """Make ``records`` the next version and return it."""
        newest = self.version()
        buckets = self._read_manifest(newest)[0] if newest else self.buckets
        return self._write(newest + 1, records.filter(F.col(self.key).isNotNull()), buckets, records.schema, {})

    def save(self, batch: DataFrame, *order: str) -> DataFrame:
        """Insert or replace records by key; the last write per key wins."""
        newest = self.version()
        new = latest(batch.filter(F.col(self.key).isNotNull()), self.key, *order)
        if not newest:
            return self.replace(new.select(*batch.columns))
        return self._change(newest, new, lambda old: upsert(old, new, self.key, *order))

    def merge(self, batch: DataFrame, *order: str) -> DataFrame:
        """Insert records by key, or replace those that are lower by ``order``: late and repeated ones change nothing."""
        newest = self.version()
        if not newest:
            return self.save(batch, *order)
        new = latest(batch.filter(F.col(self.key).isNotNull()), self.key, *order)
        return self._change(newest, new, lambda old: latest(
            old.unionByName(new.select(*old.columns)), self.key, *order).select(*old.columns))

    def delete(self, keys: DataFrame) -> DataFrame:
        return self._change(self.version(), keys, lambda old: delete_by_key(old, keys, self.key))

    def _change(self, newest: int, keys: DataFrame, change) -> DataFrame:
        """Next version: ``change`` of the rows in the buckets of ``keys``, all other buckets as they are."""
        buckets, schema, places = self._read_manifest(newest)
        key = F.col(self.key).cast(schema[self.key].dataType)       # a hash depends on the type
        touched = {r.b for r in keys.filter(key.isNotNull()).select(_bucket(key, buckets).alias("b"))
                   .distinct().collect()}       # at most ``buckets``
        if not touched:
            return self.load(newest)
        old = self._rows(schema, {b: v for b, v in places.items() if b in touched})
        rest = {b: v for b, v in places.items() if b not in touched}
        return self._write(newest + 1, change(old), buckets, schema, rest)

    def _read_manifest(self, version: int) -> tuple[int, T.StructType, dict[int, int]]:
        rows = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifests/{version}").collect()
        head = next(r for r in rows if r.bucket < 0)
        schema = T.StructType.fromJson(json.loads(head.schema))
        return head.buckets, schema, {r.bucket: r.written for r in rows if r.bucket >= 0}

    def _rows(self, schema: T.StructType, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/{written}/_bucket={b}" for b, written in sorted(places.items())]
        return self.spark.read.schema(schema).parquet(*paths)

    def _write(self, version: int, records: DataFrame, buckets: int, schema: T.StructType,
               rest: dict[int, int]) -> DataFrame:
        folder = f"{self.path}/data/{version}"
        typed = records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        placed = typed.withColumn("_bucket", _bucket(F.col(self.key), buckets))
        placed.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        fields = T.StructType([*schema.fields, T.StructField("_bucket", T.IntegerType())])
        written = (self.spark.read.schema(fields).parquet(folder).groupBy(F.col("_bucket").alias("bucket"))
                   .agg(F.count("*").alias("rows"), F.min(self.key).cast("string").alias("low"),
                        F.max(self.key).cast("string").alias("high"))
                   .select("bucket", F.lit(version).cast("bigint").alias("written"), "rows", "low", "high"))
        if rest:
            kept = self.spark.createDataFrame([(b,) for b in rest], "bucket INT")
            written = written.unionByName(self.manifest(version - 1).join(kept, "bucket"))
        none = F.lit(None)
        head = self.spark.range(1, numPartitions=1).select(
            F.lit(-1).alias("bucket"), none.cast("bigint").alias("written"), none.cast("bigint").alias("rows"),
            none.cast("string").alias("low"), none.cast("string").alias("high"), F.lit(buckets).alias("buckets"),
            F.lit(schema.json()).alias("schema"))
        rows = written.withColumn("buckets", none.cast("int")).withColumn("schema", none.cast("string"))
        rows.unionByName(head).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifests/{version}")
        self._remove_old()
        return self.load(version)

    def _remove_old(self) -> None:
        versions = self.versions()
        kept = versions[-self.grace:]
        named = {v for version in kept for v in self._read_manifest(version)[2].values()}
        for version in versions[:-self.grace]:
            _remove(self.spark, f"{self.path}/manifests/{version}")
        for version in _numbered(self.spark, f"{self.path}/data"):
            if version < kept[0] and version not in named:
                _remove(self.spark, f"{self.path}/data/{version}")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


def _numbered(spark: SparkSession, path: str) -> list[int]:
    """Names of the folders of ``path`` that are numbers, ascending."""
    files, place = _file_system(spark, path)
    found = files.listStatus(place) if files.exists(place) else []
    return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())


def _remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)
