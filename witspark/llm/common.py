"""Helpers shared by the operators: inputs, words, Arrow batches and bounded sizes."""

from __future__ import annotations

import sys
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from witspark.plans.lineage import cut

#: Rows of one Arrow batch; a batch of texts then stays at some tens of MB even
#: where most texts are very long.
BATCH_ROWS = 256

#: A model file that is sent to the executors may have this many bytes at most.
MAX_MODEL_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, and let the shuffle files of a step go when it ends.

    Every operator that runs Python calls this. Steps leave their results as
    checkpoints, so nothing reads a finished step's shuffle again; without the
    second setting the files stay until the driver happens to collect its garbage.
    """

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def texts(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """`id`, `body` (UTF-8 bytes, null as empty) and `more`; other columns are not read."""

    body = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return df.select(F.col(id_col).alias("id"), body.alias("body"), *more)


def whole_rows(df: DataFrame) -> Column:
    """All columns of `df` as one struct `row`, for operators that pass rows on."""

    return F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row")


def remainder(id_col, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""

    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % parts


def read_model(path: str) -> bytes:
    """A public vocabulary file, read once on the driver; larger files are refused."""

    with open(path, "rb") as file:
        data = file.read(MAX_MODEL_BYTES + 1)
    if len(data) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    return data


def map_rows(df: DataFrame, schema: str, work, carry: str | None = None) -> DataFrame:
    """mapInArrow where `work(columns) -> dict of lists` treats one batch.

    `columns` are Python lists by name, in the order of `df`. Nothing is kept
    between batches but what `work` holds itself. The column `carry` is passed on
    as it is; `work` then gives one row for each.
    """

    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    result = _parse_datatype_string(schema)
    arrow = to_arrow_schema(result)
    names = df.columns
    if carry is not None:
        result = StructType([*result.fields, df.schema[carry]])

    def run(batches):
        for batch in batches:
            out = work({n: batch.column(i).to_pylist() for i, n in enumerate(names) if n != carry})
            own = pa.RecordBatch.from_pydict({f.name: out[f.name] for f in arrow}, schema=arrow)
            if carry is not None:
                passed = batch.column(names.index(carry))
                own = pa.RecordBatch.from_arrays([*own.columns, passed], names=[*arrow.names, carry])
            yield own

    return df.mapInArrow(run, result)


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    use: Column,
    label: str,
    per_class: int,
    max_bytes: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample (`id`, `body`, `label`) of the labelled rows, and the rows by label.

    Of each label the `per_class` rows with the smallest hash of the id, among
    texts of 1 to `max_bytes` bytes; `use` is a condition on the column `id`. Ids
    with two labels are left out. Only ids and lengths are shuffled; the texts are
    then read by at most 2 * per_class broadcast ids.
    """

    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .filter(use & F.col("label").isin(0, 1))
        .groupBy("id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .filter("label = most")
        .drop("most")
    )
    sizes = texts(docs, id_col, text_col).select("id", F.octet_length("body").alias("size"))
    # Ids and labels only; kept, as both classes are taken from it.
    pool = cut(sizes.filter(F.col("size").between(1, max_bytes)).select("id").distinct().join(known, "id"))
    order = F.xxhash64(F.col("id").cast("string"))
    chosen, shares = [], {}
    for value in (0, 1):
        own = pool.filter(F.col("label") == value)
        rows = own.orderBy(order, F.col("id").cast("string")).limit(per_class).collect()
        shares[value] = own.count() if len(rows) == per_class else len(rows)
        chosen += rows
    picked = docs.sparkSession.createDataFrame(chosen, pool.schema)
    body = texts(docs, id_col, text_col).filter(F.octet_length("body").between(1, max_bytes))
    return body.join(F.broadcast(picked), "id"), shares


def per_worker(key, build):
    """`build()`, remembered under `key` by this Python process across its tasks.

    The package travels to the workers by value, so its own globals are new in
    every task; a module of the process is not. Only the last value is kept, so that
    the steps of a long job do not add up in the workers' memory.
    """

    kept = vars(sys.modules.setdefault("_witspark_worker", ModuleType("_witspark_worker"))).setdefault(
        "kept", {}
    )
    if key not in kept:
        kept.clear()
        kept[key] = build()
    return kept[key]
