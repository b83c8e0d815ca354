"""Ingest queries.  Members are text that Spark renders from the given tables."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..sources import text as X
from . import sqltext as T
from .q_audits import scratch
from .q_signals import checksum
from .registry import query
from .tables import signals, table

R = A.rounded


def text_members(spark, sf):
    """Two-column members with headers, comments and four kinds of damage by id."""
    k = F.col("signal_id")
    rows = F.array_join(
        F.transform(
            F.arrays_zip("axis", "y"),
            lambda p: F.concat(
                p["axis"].cast("string"), F.when(k % 2 == 0, F.lit(", ")).otherwise(F.lit("  ")), p["y"].cast("string")
            ),
        ),
        "\n",
    )
    payload = F.concat(
        F.concat(F.lit("##NAMES=class "), F.col("class_id"), F.lit("\n")),
        F.when(k % 11 == 3, F.lit("")).otherwise(F.concat(F.lit("##ID=R"), k, F.lit("\n"))),
        F.when(k % 13 == 4, F.lit("##NAMES=other\n")).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.lit("##LASER=532 nm\n")).otherwise(F.lit("")),
        F.lit("#Laser=785\n#Detector=CCD\n"),
        F.when(k % 4 == 1, F.lit("#Detector=EM\n")).otherwise(F.lit("")),
        F.concat(F.lit("#Exposure="), (k % 6 - 1).cast("string"), F.lit("\nx, y\n")),
        rows,
        F.when(k % 17 == 5, F.lit("\nbroken, row")).otherwise(F.lit("")),
        F.lit("\n##END=\n"),
    )
    return signals(spark, sf).select(F.concat(F.lit("m"), k).alias("member"), k, payload.alias("payload"))


_CODE = """CASE WHEN signal_id % 11 = 3 THEN 'required_header_missing' WHEN signal_id % 13 = 4 THEN 'identity_header_conflict' WHEN signal_id % 17 = 5 THEN 'bad_numeric_row' END"""


@query(
    "ingest_text_signals",
    "WITH "
    + T.SQL_SIGNALS
    + f" SELECT 'm' || signal_id AS member, {_CODE} AS rejection_code, max(i)::BIGINT AS n_points, round(sum(i * y), 6) + 0.0 AS checksum FROM sig GROUP BY signal_id",
)
def ingest_text_signals(spark, sf):
    """Accepted members and the quarantine in one table, split by the code."""
    df = X.parse_text_signals(text_members(spark, sf))
    return df.select("member", "rejection_code", F.size("axis").cast("long").alias("n_points"), checksum(F.col("y")).alias("checksum"))


@query(
    "promote_unique_attr",
    """SELECT CASE WHEN vec_id % 3 = 0 THEN 532.0 ELSE 785.0 END::DOUBLE AS excitation_nm, CASE WHEN vec_id % 6 > 1 THEN (vec_id % 6 - 1)::DOUBLE END AS integration_time_s,
 CASE WHEN vec_id % 4 <> 1 THEN 'CCD' END AS detector, count(*)::BIGINT AS n FROM embeddings GROUP BY ALL""",
)
def promote_unique_attr(spark, sf):
    df = X.promote(X.split_members(text_members(spark, sf)))
    return df.groupBy("excitation_nm", "integration_time_s", "detector").agg(F.count(F.lit(1)).alias("n"))


def csv_members(spark, sf):
    """Plate-positioned CSV members; some names, positions and metadata are wrong."""
    k = F.col("signal_id")
    row, col = F.floor(F.pmod(k, F.lit(96)) / 12).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int")
    sample = 12 * row + col + F.when(k % 19 == 2, 1).otherwise(0)
    name = F.when(k % 23 == 7, F.concat(F.lit("odd-"), k, F.lit(".csv"))).otherwise(
        F.format_string(
            "s%03d-%s%02d-p%02d-r%02d-m01-rep%02d.csv",
            sample, F.char(row + 65), col, F.floor(k / 96).cast("int"), (k % 8 + 1).cast("int"), (k % 4 + 1).cast("int"),
        )
    )
    rows = F.array_join(
        F.transform(F.arrays_zip("axis", "y"), lambda p: F.concat_ws(",", p["axis"].cast("string"), p["y"].cast("string"))), "\n"
    )
    meta = F.when(k % 29 == 8, F.lit('\n{"power": 12.5}')).otherwise(F.lit('\n{"power": 12.5, "objective": "x50"}'))
    return signals(spark, sf).select(k, name.alias("member"), F.concat(rows, meta).alias("payload"))


@query(
    "ingest_csv_signals",
    "WITH "
    + T.SQL_SIGNALS
    + """ SELECT signal_id, CASE WHEN signal_id % 23 = 7 THEN 'name_grammar' WHEN signal_id % 19 = 2 THEN 'identity_out_of_contract' WHEN signal_id % 29 = 8 THEN 'metadata_missing' END AS rejection_code,
 round(sum(i * y), 6) + 0.0 AS checksum FROM sig GROUP BY signal_id""",
)
def ingest_csv_signals(spark, sf):
    df = X.parse_csv_signals(csv_members(spark, sf), "power double, objective string")
    return df.select("signal_id", "rejection_code", checksum(F.col("y")).alias("checksum"))


@query(
    "ingest_targets",
    """WITH p AS (SELECT p_partkey, p_size * 2 AS a, p_size * 3 AS b, 375 - p_size * 5 + CASE WHEN p_partkey % 31 = 6 THEN 1 ELSE 0 END AS c FROM part),
u AS (SELECT * FROM p UNION ALL SELECT * FROM p WHERE p_partkey % 41 = 9),
r AS (SELECT *, count(*) OVER (PARTITION BY p_partkey) AS n FROM u),
k AS (SELECT *, CASE WHEN n > 1 THEN 'duplicate_well' WHEN a + b + c <> 375 THEN 'volumes_do_not_sum' END AS rejection_code FROM r)
SELECT rejection_code, count(*)::BIGINT AS n, round(avg(a / 375.0), 6) AS mean_a, round(avg(c / 375.0), 6) AS mean_c FROM k GROUP BY ALL""",
)
def ingest_targets(spark, sf):
    """Three-component mixtures from part sizes, with wrong sums and repeated wells."""
    p = table(spark, sf, "part").select(
        "p_partkey",
        (F.col("p_size") * 2).alias("a"),
        (F.col("p_size") * 3).alias("b"),
        (375 - F.col("p_size") * 5 + F.when(F.col("p_partkey") % 31 == 6, 1).otherwise(0)).alias("c"),
    )
    df = X.composition(p.unionByName(p.filter("p_partkey % 41 = 9")), "p_partkey", ["a", "b", "c"])
    return df.groupBy("rejection_code").agg(
        F.count(F.lit(1)).alias("n"), R(F.avg("c_a")).alias("mean_a"), R(F.avg("c_c")).alias("mean_c")
    )


@query(
    "normalize_metadata",
    """WITH e AS (SELECT event_type, date_trunc('second', ts) AS t, CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 37 = 5 THEN NULL ELSE value END AS c,
 CASE WHEN event_id % 29 = 3 THEN 'acquired_at_invalid' WHEN event_id % 37 = 5 AND event_type <> 'error' THEN 'temperature_invalid' END AS code, (props ->> '$.k')::INT AS k, event_id FROM events)
SELECT event_type, code AS rejection_code, count(*)::BIGINT AS n, count(c)::BIGINT AS n_temperature, round(avg(c), 6) AS mean_temperature, sum(k)::BIGINT AS accumulations,
 max(CASE WHEN event_id % 29 <> 3 THEN strftime(t, '%Y-%m-%d %H:%M:%S') END) AS last_acquired FROM e GROUP BY ALL""",
)
def normalize_metadata(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select(
        "event_type",
        F.when(k % 29 == 3, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("acquired_text"),
        F.when(F.col("event_type") == "error", "N/A")
        .when(k % 37 == 5, "warm")
        .otherwise(F.col("value").cast("string"))
        .alias("temperature_text"),
        F.get_json_object("props", "$.k").alias("counts_text"),
    )
    df = X.normalize_metadata(e)
    return df.groupBy("event_type", "rejection_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("temperature_c").alias("n_temperature"),
        R(F.avg("temperature_c")).alias("mean_temperature"),
        F.sum("n_accumulations").alias("accumulations"),
        F.date_format(F.max("acquired_at"), "yyyy-MM-dd HH:mm:ss").alias("last_acquired"),
    )


def damaged(members):
    """Every 37th member ends in a byte that is no UTF-8."""
    bad = F.unhex(F.lit("FF")).cast("string")
    return members.withColumn("payload", F.when(F.col("signal_id") % 37 == 12, F.concat("payload", bad)).otherwise(F.col("payload")))


def through_files(spark, members, parse):
    """Members written as files, read and parsed from there, and stored beside their quarantine."""
    path = scratch(spark, "members")
    X.write_members(damaged(members), f"{path}/files")
    X.write_with_quarantine(parse(X.read_members(spark, f"{path}/files", "*.txt")), f"{path}/parsed")
    kept, bad = X.read_accepted(spark, f"{path}/parsed"), X.read_quarantine(spark, f"{path}/parsed")
    code = F.lit(None).cast("string").alias("rejection_code")
    kept = kept.select("member", code, F.size("axis").cast("long").alias("n_points"), checksum(F.col("y")).alias("checksum"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n_points", "long"), ("checksum", "double"))]
    return kept.unionByName(bad.select("member", "rejection_code", *none))


def _files_sql(member, code):
    return (
        "WITH "
        + T.SQL_SIGNALS
        + f""", m AS (SELECT signal_id, {member} AS member, CASE {code} END AS rejection_code, max(i)::BIGINT AS n, sum(i * y) AS s FROM sig GROUP BY signal_id)
SELECT member, rejection_code, CASE WHEN rejection_code IS NULL THEN n END AS n_points, CASE WHEN rejection_code IS NULL THEN round(s, 6) + 0.0 END AS checksum FROM m"""
    )


@query(
    "ingest_text_files",
    _files_sql("'m' || signal_id", "WHEN signal_id % 37 = 12 THEN 'not_text' ELSE (" + _CODE + ")"),
)
def ingest_text_files(spark, sf):
    return through_files(spark, text_members(spark, sf), X.parse_text_signals)


_POSITION = "(signal_id % 96)::BIGINT"
_NAME = f"""CASE WHEN signal_id % 23 = 7 THEN 'odd-' || signal_id || '.csv' ELSE
 printf('s%03d-%s%02d-p%02d-r%02d-m01-rep%02d.csv', 12 * ({_POSITION} // 12) + signal_id % 12 + 1 + CASE WHEN signal_id % 19 = 2 THEN 1 ELSE 0 END, chr(({_POSITION} // 12 + 65)::INT), signal_id % 12 + 1, signal_id // 96, signal_id % 8 + 1, signal_id % 4 + 1) END"""


@query(
    "ingest_csv_files",
    _files_sql(
        _NAME,
        "WHEN signal_id % 23 = 7 THEN 'name_grammar' WHEN signal_id % 19 = 2 THEN 'identity_out_of_contract' WHEN signal_id % 37 = 12 THEN 'not_text' WHEN signal_id % 29 = 8 THEN 'metadata_missing'",
    ),
)
def ingest_csv_files(spark, sf):
    """The member's identity comes from its path, not from a column."""
    return through_files(spark, csv_members(spark, sf), lambda df: X.parse_csv_signals(df, "power double, objective string"))
