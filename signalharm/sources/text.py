"""Text members to signals: headers, comments, numeric rows, file-name identity.

Every parser is a projection on ``(member, payload)``; a member either yields a
signal or a rejection code, never an exception.
"""

import os
import shutil
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A

PAIR_TYPE = "array<struct<key:string,value:string>>"


#: Members that share a folder; tasks a core when files are read: a split holds 32 files at most.
FOLDER, READERS = 256, 4
NO_NAME = "__HIVE_DEFAULT_PARTITION__"  # what Spark calls a partition without a value


def write_members(df: DataFrame, path: str) -> None:
    """One text file per member below ``path``, named after it: its payload and a line end.

    Each task writes its own files side by side and nothing is gathered; the
    folder of a task appears when it is complete, so a repeated task leaves no
    member twice.  Elsewhere than on a (shared) local file system Spark's writer
    makes a folder per member.  ``df``: member, payload.
    """
    sc = df.sparkSession.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file":
        df.select("member", "payload").write.partitionBy("member").text(path)
        return
    root = fs.makeQualified(where).toUri().getPath()
    os.makedirs(root)

    def write(batches):
        task = TaskContext.get()
        own = f"{root}/_{task.partitionId()}.{task.taskAttemptId()}"
        folders, used = 0, None
        for batch in batches:
            for member, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = _file_name(member)
                if used is None or len(used) == FOLDER or name in used:
                    folders, used = folders + 1, set()
                    os.makedirs(f"{own}/{folders}")
                used.add(name)
                with open(f"{own}/{folders}/{name}", "wb") as f:
                    f.write(payload or b"")
                    f.write(b"\n")
        if folders:
            _keep(own, f"{root}/members-{task.partitionId()}")
        yield pa.RecordBatch.from_pydict({"folders": pa.array([folders], pa.int64())})

    df.select(F.col("member").cast("binary"), F.col("payload").cast("binary")).mapInArrow(write, "folders long").agg(F.sum("folders")).collect()


def _keep(own: str, final: str) -> None:
    """Show the folder of a finished task, unless another attempt of it was first."""
    try:
        os.rename(own, final)
    except OSError:
        if not os.path.isdir(final):
            raise
        shutil.rmtree(own)


def _file_name(member: bytes | None) -> str:
    """A name that any file system takes and Spark's scan does not hide."""
    name = quote(member or NO_NAME, safe="")
    return (f"%{ord(name[0]):02X}{name[1:]}" if name[0] in "._" else name) + ".txt"


def read_members(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """member, payload, n_bytes of every file below ``path`` whose name matches ``pattern``.

    The member is what ``write_members`` was given, else the file's own
    name.  Folders are searched at any depth; files are read where they lie,
    each whole in one row, so one file may hold 2 GB at most.  Spark's scan
    leaves out files of no bytes: they are no members.  The payload of a file
    that is no UTF-8 is null: the parsers give it the code ``not_text``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    files = files.coalesce(READERS * spark.sparkContext.defaultParallelism)
    written = F.regexp_extract("path", r"/members-\d+/\d+/([^/]+)\.txt$", 1)
    folder = F.regexp_extract("path", r"/member=([^/]+)/[^/]+$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.when(written != "", F.coalesce(F.try_url_decode(written), name)).when(folder != "", folder).otherwise(name).alias("member"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("payload"),
        F.col("length").alias("n_bytes"),
    )


def write_with_quarantine(df: DataFrame, path: str, code: str = "rejection_code") -> None:
    """Accepted rows and the quarantine as two folders below ``path``, in one pass over ``df``."""
    state = F.when(F.col(code).isNull(), "accepted").otherwise("quarantine")
    df.withColumn("state", state).write.partitionBy("state").parquet(path)


def read_accepted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("state = 'accepted'").drop("state", "rejection_code")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("state = 'quarantine'").drop("state")


def _entries(lines, prefix: int) -> Column:
    """``key=value`` entries after a line prefix; empty values are dropped."""
    pairs = F.transform(
        F.filter(lines, lambda l: F.contains(l, F.lit("="))),
        lambda l: F.struct(
            F.substring_index(F.substr(l, F.lit(prefix + 1)), "=", 1).alias("key"),
            F.trim(F.regexp_replace(l, r"^[^=]*=", "")).alias("value"),
        ),
    )
    return F.filter(pairs, lambda p: p["value"] != "")


def _values(entries, key: str) -> Column:
    return F.array_distinct(
        F.transform(F.filter(entries, lambda p: p["key"] == key), lambda p: p["value"])
    )


def unique_value(entries, key: str) -> Column:
    """The value of a key when all its non-empty values agree."""
    return A.let(_values(entries, key), lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))


def split_members(df: DataFrame) -> DataFrame:
    """Adds ``headers``, ``comments``, ``rows`` (array of array<double>) and ``bad_rows``."""
    lines = F.filter(F.transform(F.split("payload", r"\r?\n"), lambda l: F.trim(l)), lambda l: l != "")
    df = A.pin(df, {"lines": lines})
    fields = F.transform(
        F.filter("lines", lambda l: ~F.startswith(l, F.lit("#"))),
        lambda l: F.transform(F.split(l, r"\s*,\s*|\s+"), lambda f: f.try_cast("double")),
    )
    df = A.pin(
        df,
        {
            "headers": _entries(F.filter("lines", lambda l: F.startswith(l, F.lit("##"))), 2),
            "comments": _entries(
                F.filter("lines", lambda l: F.startswith(l, F.lit("#")) & ~F.startswith(l, F.lit("##"))), 1
            ),
            "fields": fields,
        },
    )
    numeric = lambda r: (F.size(r) == 2) & F.get(r, F.lit(0)).isNotNull() & F.get(r, F.lit(1)).isNotNull()
    good = F.filter("fields", numeric)
    # text above the first numeric row is a column header; below it is damage
    first = F.array_position(F.transform("fields", numeric), True)
    bad = F.size("fields") - F.size(good) - F.when(first > 0, first - 1).otherwise(F.size("fields"))
    return A.pin(df, {"rows": good, "bad_rows": bad}).drop("lines", "fields")


def parse_text_signals(df: DataFrame, identity=("NAMES", "ID")) -> DataFrame:
    """``member, signal fields, rejection_code``; accepted rows have a null code."""
    df = split_members(df)
    axis = F.transform("rows", lambda r: F.get(r, F.lit(0)))
    y = F.transform("rows", lambda r: F.get(r, F.lit(1)))
    df = A.pin(df, {"axis": axis, "y": y, **{f"_{k}": _values("headers", k) for k in identity}})
    d = A.differences("axis")
    finite = F.forall("axis", lambda v: F.abs(v) < float("inf")) & F.forall("y", lambda v: F.abs(v) < float("inf"))
    code = F.lit(None).cast("string")
    rules = [
        (~A.let(d, lambda s: F.forall(s, lambda v: v > 0) | F.forall(s, lambda v: v < 0)), "axis_not_monotone"),
        (~finite, "not_finite"),
        (F.size("axis") < 2, "too_few_points"),
        (F.col("bad_rows") > 0, "bad_numeric_row"),
    ]
    for k in identity:
        rules.append((F.size(f"_{k}") > 1, "identity_header_conflict"))
        rules.append((F.size(f"_{k}") == 0, "required_header_missing"))
    rules.append((F.col("payload").isNull(), "not_text"))
    for condition, name in rules:
        code = F.when(condition, name).otherwise(code)
    return A.pin(df, {"rejection_code": code, **{k.lower(): F.get(f"_{k}", F.lit(0)) for k in identity}}).drop(
        *[f"_{k}" for k in identity], "rows", "payload"
    )


def promote(df: DataFrame) -> DataFrame:
    """Acquisition values from header, else comment; conflicting or non-positive is null."""

    def number(key_header, key_comment):
        pattern = r"(?i)^\s*\+?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?(\s+nm)?\s*$"
        text = F.coalesce(
            F.when(F.size(_values("headers", key_header)) > 0, F.coalesce(unique_value("headers", key_header), F.lit("?"))),
            unique_value("comments", key_comment),
        )
        value = F.when(F.rlike(text, F.lit(pattern)), F.regexp_replace(text, r"(?i)\s*nm\s*$", "").try_cast("double"))
        return A.let(value, lambda v: F.when(v > 0, v))

    return A.pin(
        df,
        {
            "excitation_nm": number("LASER", "Laser"),
            "integration_time_s": number("TIME", "Exposure"),
            "detector": unique_value("comments", "Detector"),
        },
    )


FILE_PATTERN = r"^s(\d+)-([A-H])(\d+)-p(\d+)-r(\d+)-m(\d+)-rep(\d+)\.csv$"


def parse_csv_signals(df: DataFrame, schema: str) -> DataFrame:
    """CSV rows with a trailing JSON line; identity and plate position from the name."""

    def part(k):
        return F.regexp_extract("member", FILE_PATTERN, k)

    meta = F.from_json(F.regexp_extract("payload", r"(\{.*\})\s*$", 1), schema)
    rows = F.regexp_replace("payload", r"\{.*\}\s*$", "")
    df = split_members(df.withColumns({"meta": meta, "payload": rows}))
    named = F.rlike("member", F.lit(FILE_PATTERN))
    sample, col = part(1).try_cast("int"), part(3).try_cast("int")
    position = 12 * (F.ascii(part(2)) - F.ascii(F.lit("A"))) + col
    code = (
        F.when(~named, "name_grammar")
        .when((sample != position) | ~col.between(1, 12) | ~part(7).try_cast("int").between(1, 4), "identity_out_of_contract")
        .when(F.col("payload").isNull(), "not_text")
        .when(F.col("meta").isNull() | F.exists(F.array(*[F.col(f"meta.{f.split()[0]}").isNull() for f in schema.split(", ")]), lambda m: m), "metadata_missing")
        .when((F.size("rows") < 2) | (F.col("bad_rows") > 0), "bad_numeric_row")
    )
    return A.pin(
        df,
        {
            "axis": F.transform("rows", lambda r: F.get(r, F.lit(0))),
            "y": F.transform("rows", lambda r: F.get(r, F.lit(1))),
            "well_id": F.concat(part(2), part(3), F.lit("_"), part(4)),
            "rejection_code": code,
        },
    ).drop("rows", "headers", "comments", "payload")


def composition(df: DataFrame, well: str, volumes, total: int = 375) -> DataFrame:
    """Concentrations from integer volumes; wells must be unique and sum to ``total``."""
    repeated = df.groupBy(well).agg(F.count(F.lit(1)).alias("_n"))
    whole = sum((F.col(v) for v in volumes[1:]), F.col(volumes[0]))
    code = (
        F.when(F.col("_n") > 1, "duplicate_well")
        .when(F.greatest(*[F.abs(F.col(v) - F.floor(v)) for v in volumes]) > 0, "volume_not_integer")
        .when(F.least(*[F.col(v) for v in volumes]) < 0, "volume_negative")
        .when(whole != total, "volumes_do_not_sum")
    )
    return df.join(repeated, well).withColumns(
        {"rejection_code": code, **{f"c_{v}": F.col(v) / total for v in volumes}}
    ).drop("_n")


def normalize_metadata(df: DataFrame) -> DataFrame:
    """Typed acquisition metadata next to its source text; ``N/A`` becomes null.

    ``df``: acquired_text, temperature_text, counts_text.
    """
    when = F.try_to_timestamp("acquired_text", F.lit("yyyy-MM-dd HH:mm:ss"))
    temperature = F.when(F.col("temperature_text") != "N/A", F.col("temperature_text").try_cast("double"))
    counts = F.col("counts_text").try_cast("int")
    code = (
        F.when(when.isNull(), "acquired_at_invalid")
        .when((F.col("temperature_text") != "N/A") & temperature.isNull(), "temperature_invalid")
        .when(counts.isNull(), "accumulations_invalid")
    )
    return df.withColumns(
        {"acquired_at": when, "temperature_c": temperature, "n_accumulations": counts, "rejection_code": code}
    )
