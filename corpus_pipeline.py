"""A training corpus from ``documents``: five stages, each on all that the one before kept.

``run`` writes every stage as Parquet in the shared folder and reads it again.
A filtering stage numbers its rows, writes them, decides on each row and removes
exactly those rows: null and repeated ids are rows like any other.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalharm.llm import decontaminate, mixing, queries, simhash, token_files, toxicity
from signalharm.llm.common import BROADCAST_IDS, discard, noted_paths, shared_path, small, stored, table

KEY = "__row_key"
#: Tables that earlier stages wrote for themselves.
_LEFT: list[str] = []
#: Rows and bytes that go to a Python worker at once, and bytes of chunks that the tokenizer's cache
#: holds: an executor runs all stages, so each takes less memory than its query alone.  Arrow buffers
#: lie outside the heap and their pool is kept, so large batches of one stage burden all later ones.
BATCH_ROWS, BATCH_BYTES, CACHE_BYTES = 1000, 1 << 20, 32 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most BATCH_ROWS rows, and about BATCH_BYTES, for the jobs inside the block."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = {key: spark.conf.get(key) for key in (rows, size)}
    spark.conf.set(rows, min(BATCH_ROWS, int(before[rows])) if int(before[rows]) > 0 else BATCH_ROWS)
    spark.conf.set(size, BATCH_BYTES)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def tidy(stage):
    """The stage, which first deletes what the stages before left: their rows are written by then.

    A table that ``docs`` still reads stays until a later stage.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        done = [p for p in _LEFT if not any(p.removeprefix("file:").strip("/") in f for f in files)]
        discard(spark, done)
        with noted_paths() as paths, small_batches(spark):
            out = stage(spark, docs, sf_dir)
        _LEFT[:] = [*(p for p in _LEFT if p not in done), *paths]
        return out

    return run_stage


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a number each, written once so that it stays."""
    return stored(docs.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def drop(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` without those whose number is the only column of ``gone``."""
    gone = stored(gone.toDF("gone_key"), "gone")  # a row has one number: no key is hot
    return rows.join(small(gone, BROADCAST_IDS), F.col(KEY) == F.col("gone_key"), "left_anti").drop(KEY)


@tidy
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    rows = keyed(docs)
    scored = toxicity.toxicity(rows, *toxicity.fit(rows, table(spark, sf_dir, "labels")), id_col=KEY)
    return drop(rows, scored.where("predicted = 1").select("doc_id"))


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of linked fingerprints: of the smallest id, null ids last."""
    rows = keyed(docs)
    linked = simhash.near_duplicates(rows, id_col=KEY).select(F.col("doc_id").alias(KEY), "component_id")
    linked = stored(linked.join(rows.select(KEY, "doc_id"), KEY), "near-duplicates")
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY))[KEY].alias("first"))
    return drop(rows, linked.join(first, F.col(KEY) == F.col("first"), "left_anti").select(KEY))


@tidy
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without, or with few, passages of the benchmark."""
    rows = keyed(docs)
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), id_col=KEY)
    return drop(rows, found.where("contaminated").select("doc_id"))


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at the target weights: rows of over-supplied sources beyond its end go."""
    rows = keyed(docs)
    return drop(rows, mixing.mixture(rows, key_col=KEY).where("NOT in_mix").select(KEY))


@tidy
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and per document what they hold."""
    path = shared_path(spark, "pipeline-tokens")
    token_files.write_token_files(docs, path, queries.tokenizer_file("byte_bpe_50k.json"), cache_bytes=CACHE_BYTES)
    # read back here: the batches of whole shards are bounded only inside the stage
    return stored(token_files.token_digests(spark, path), "digests")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: Classifier and tokenizer are not expressible in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
