"""Cutting lineage on shared storage, and the size checks behind plan choices."""

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

HOT_ROWS = 2_000_000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="witspark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of `df`; its partitions keep their order and number."""

    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_rows(spark: SparkSession) -> int:
    """Rows of one group above which a group is split over several tasks."""

    return int(spark.conf.get("witspark.hotRows", str(HOT_ROWS)))


def has_hot_group(df: DataFrame, keys: list) -> bool:
    """Whether any key holds more rows than one task should; counts combine map-side."""

    limit = hot_rows(df.sparkSession)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    return not counts.filter(F.col("__rows") > limit).isEmpty()


def _bytes_of(field: T.StructField) -> Column:
    """About the bytes of a value; nested values count by their JSON text."""

    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
    return F.lit(8)


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Broadcast hint only when a bounded count of rows and bytes proves the side small."""

    limit = int(df.sparkSession.conf.get("witspark.broadcastRows", str(BROADCAST_ROWS)))
    most = int(df.sparkSession.conf.get("witspark.broadcastBytes", str(BROADCAST_BYTES)))
    size = sum((_bytes_of(field) for field in df.schema.fields), F.lit(0))
    rows, held = df.limit(limit + 1).agg(F.count(F.lit(1)), F.sum(size.cast("bigint"))).first()
    if rows <= limit and (held or 0) <= most:
        return F.broadcast(df)
    return df


_WRITTEN: dict = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application, on storage that all executors share."""

    _ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _state_of(spark: SparkSession, source: str) -> str:
    """Digest of the paths, sizes and times of the files below `source`."""

    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(source)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    files = system.listFiles(path, True)
    found = []
    while files.hasNext():
        file = files.next()
        found.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def written_table(spark: SparkSession, name: str, source: str, build) -> DataFrame:
    """A derived table written once per application to the shared folder, then scanned.

    It is written again when the files below `source` have changed.

    Later queries read only the columns and rows they need from Parquet, and
    their plans start at a scan instead of at the whole derivation.
    """

    context = spark.sparkContext
    state = _state_of(spark, source)
    key = (context.applicationId, name, source, state)
    if key not in _WRITTEN:
        folder = shared_folder(spark)
        digest = hashlib.sha256(f"{source} {state}".encode()).hexdigest()[:12]
        path = f"{folder}/tables/{name}-{digest}"
        build().write.mode("overwrite").parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


class Rounds:
    """Tables of an iteration, written to the shared folder and scanned again.

    A checkpoint keeps the size that Spark estimates for what it holds, and the estimate
    of a join is the product of its sides: joined round after round, the number itself
    outgrows the data. A scan has the size of its files.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.latest: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """The new state of a table; the files of the one before go."""

        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        before, self.latest[name] = self.latest.get(name), path
        if before is not None:
            self.drop(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def add(self, name: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows added to a table that only grows: (the added ones, all)."""

        path = f"{self.folder}/{name}"
        own = f"{path}/{uuid.uuid4().hex}"
        df.write.parquet(own)
        reader = self.spark.read.schema(df.schema)
        return reader.parquet(own), reader.option("recursiveFileLookup", "true").parquet(path)

    def drop(self, path: str) -> None:
        context = self.spark.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
