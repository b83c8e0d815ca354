"""Reading tables, walking Arrow batches and writing tables in the shared folder."""

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from signalharm.operators.checkpoints import ensure_checkpoint_dir


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


#: Lists that ``stored`` adds its paths to while they are open.
_NOTED: list[list[str]] = []


@contextmanager
def noted_paths() -> Iterator[list[str]]:
    """The paths of the tables that ``stored`` writes inside the block."""
    paths: list[str] = []
    _NOTED.append(paths)
    try:
        yield paths
    finally:
        _NOTED[:] = [other for other in _NOTED if other is not paths]  # lists of equal paths stay


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that no DataFrame in use reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    for paths in _NOTED:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give what a finished task held back to the system: Python workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice holds much more than ``max_bytes`` of one column."""
    at, held = 0, 0
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if held + n > max_bytes and i > at:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if len(sizes) > at:
        yield batch.slice(at)


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    fields: dict[str, str],
    make: Callable[[], Callable[[pa.RecordBatch], dict[str, Iterable]]],
) -> DataFrame:
    """One row per input row: its id as ``doc_id`` and ``fields`` (name -> Spark type).

    ``make()`` runs once a task and returns the function of one slice of the
    columns ``doc_id`` and ``text``, which gives the columns of ``fields``.
    """
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    own_schema = to_arrow_schema(StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            schema = pa.schema([batch.schema.field("doc_id"), *own_schema])
            for part in slices(batch, "text"):
                out = {"doc_id": part.column("doc_id"), **step(part)}
                yield pa.RecordBatch.from_arrays(
                    [v if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in schema], schema=schema
                )
        del step
        release_memory()

    return own.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in {"doc_id": id_type, **fields}.items()))


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast of a stored table after its rows were counted; else leave it to a shuffle join."""
    return broadcast(df) if df.count() <= max_rows else df


#: Ids that ``without`` broadcasts at most: a few MB.
BROADCAST_IDS = 200_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows of these ``doc_id``, null ids among them; all columns stay."""
    gone = stored(ids.select(ids["doc_id"].alias("gone_id")).distinct(), "gone")
    return docs.join(small(gone, BROADCAST_IDS), docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
