"""What the operators share: tables, the shared folder, held-out rows, batches for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Labels are never learned from rows whose crc32(id) leaves this remainder.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where the driver was started from another folder.

    On a cluster whose executors don't see this folder, the package is passed with --py-files.
    """
    env = spark.sparkContext.environment
    if ROOT not in (now := env.get("PYTHONPATH", "")).split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, now) if x)


_local: list[str] = []  # the temporary folder of a local session, if one had to be made


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one the cluster shares (spark.checkpoint.dir), in a folder of this application.

    Where that is unset, a local session (one machine, as in tests) gets a temporary folder that goes with the process, and a
    cluster an error, as no folder of one machine would do.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not base and not context.master.startswith("local-") and context.master.startswith("local"):
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="landlace-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = "file://" + _local[0]
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/landlace-{context.applicationId}/{uuid.uuid4().hex}"


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a written folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote; call it when their results have been read or saved."""
    drop(spark, shared_dir(spark).rpartition("/")[0])


def written(df: DataFrame, folder: str) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read that."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def is_held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 = 2; a null id counts as held out, so that nothing is learned from it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def drawn(key: Column, share: float) -> Column:
    """Whether a row is in a sample of about `share` of all, by a 64-bit hash of the key."""
    return F.lit(True) if share >= 1 else F.xxhash64(key) < F.lit(int(share * 2**64) - 2**63)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most about `rows` labelled rows that aren't held out and `size` bytes of text, chosen by a hash of the id.

    The narrow labels table is counted first; the chosen ids are at most a few times `rows`, so their join
    is a broadcast of proven size. The rows found are written, so the documents are read once; where their texts have more than `size` bytes,
    those with the least hashes stay, as many of either class as fit in its part. Also returns how many labelled rows each class has. Null
    labels are left out; a repeated id keeps its largest label.
    """
    spark = docs.sparkSession
    fit = labels.where(F.col(label).isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    per_class = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    keep = F.lit(False)
    for value, n in per_class.items():
        keep = keep | ((F.col("label") == value) & drawn(F.col("doc_id"), rows / len(per_class) / n))
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(fit.where(keep)), "doc_id")
    found = written(found.select("doc_id", "text", "label"), f"{shared_dir(spark)}/sample")
    for value in per_class:
        sizes = found.where(F.col("label") == value).select(F.xxhash64("doc_id").alias("h"), F.octet_length("text").alias("n")).orderBy("h", "n").collect()
        held = 0
        for k, r in enumerate(sizes):
            held += r["n"]
            if k and held > size / len(per_class):
                found = found.where((F.col("label") != value) | (F.xxhash64("doc_id") < F.lit(r["h"])))
                break
    return found, per_class


def schema_with(schema: T.StructType, more: str) -> T.StructType:
    """A schema with further columns, whatever its own columns are called."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(more).fields])


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with f giving dicts of columns; rows keep to the order of the schema."""
    ship(df.sparkSession)
    spark_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(spark_schema)

    def run(batches):
        for out in f(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) if not isinstance(out[x.name], pa.Array) else out[x.name].cast(x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(run, spark_schema)


def chunks(batches: Iterator[pa.RecordBatch], chars: int = 4_000_000, by: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `chars` bytes of text at most, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        column = b.column(by)
        if column.nbytes <= chars:
            yield b
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > chars:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """(key, its rows) from rows that come sorted by the key, batch by batch."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held
