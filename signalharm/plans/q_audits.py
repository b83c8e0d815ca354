"""Audit queries: duplicates, pairing, stores, digests, overlaps, ratios."""

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import hashing as H
from ..functions.peaks import detect_peaks, match_peaks, peak_components, range_threshold
from ..operators import audit as U
from ..operators import measure as M
from ..operators import splits as SP
from ..operators import signals as S
from ..operators import tasks
from ..operators.covariance import shrunk_covariance
from ..operators.perturb import ALPHAS, SEED, perturb
from ..operators.quantiles import exact_quantiles
from ..sources import store
from . import observations as O
from . import sqltext as T
from .q_perturb import SQL_COMPONENTS
from .q_signals import checksum
from .q_splits import ids
from .q_tasks import _CLEAN, clean_scores
from .registry import query
from .tables import signals, sql_uniform, table

R = A.rounded

# -- peaks ---------------------------------------------------------------------


def _robust(spark, sf):
    y = F.col("y")
    return signals(spark, sf).select(
        "signal_id",
        F.inline(detect_peaks(F.col("axis"), y, A.let(y, lambda v: 0.1 * (A.quantile(v, 0.99) - A.quantile(v, 0.01))))),
    )


_PK = "WITH " + T.SQL_SIGNALS + "," + T.sql_peaks("sig", "signal_id", "0.1 * (s.q99 - s.q01)", "pk")


@query("detect_peaks", _PK + " SELECT signal_id, pos, round(height, 6) + 0.0 AS height, round(prom, 6) AS prominence FROM pk")
def detect(spark, sf):
    return _robust(spark, sf).select("signal_id", "pos", R(F.col("height")).alias("height"), R(F.col("prom")).alias("prominence"))


@query("peak_fwhm", _PK + " SELECT signal_id, pos, round(fwhm, 6) AS fwhm FROM pk")
def fwhm(spark, sf):
    return _robust(spark, sf).select("signal_id", "pos", R(F.col("fwhm")).alias("fwhm"))


@query("peak_area", _PK + " SELECT signal_id, pos, round(area, 6) AS area FROM pk")
def area(spark, sf):
    return _robust(spark, sf).select("signal_id", "pos", R(F.col("area")).alias("area"))


def _components(spark, sf):
    x, y = F.col("axis"), F.col("y")
    return signals(spark, sf).select(
        "signal_id", F.inline(peak_components(x, y, detect_peaks(x, y, range_threshold(y))))
    )


@query(
    "peak_components",
    "WITH " + T.SQL_SIGNALS + "," + SQL_COMPONENTS + " SELECT pc.signal_id, pc.pos, pb.lo::BIGINT AS lo, pb.hi::BIGINT AS hi, pc.rank::BIGINT AS weak_rank, round(comp_height, 6) + 0.0 AS comp_height, round(comp_area, 6) + 0.0 AS comp_area FROM pc JOIN pb USING (signal_id, ord)",
)
def components(spark, sf):
    return _components(spark, sf).select(
        "signal_id",
        "pos",
        F.col("lo").cast("long").alias("lo"),
        F.col("hi").cast("long").alias("hi"),
        F.col("rank").cast("long").alias("weak_rank"),
        R(F.col("comp_height")).alias("comp_height"),
        R(F.col("comp_area")).alias("comp_area"),
    )


def _peak_tables(spark, sf):
    """Clean and noisy (p09 at 0.2) peak rows of every signal."""
    x, y = F.col("axis"), F.col("y")
    ref = signals(spark, sf).select("signal_id", F.inline(detect_peaks(x, y, range_threshold(y))))
    moved = perturb(signals(spark, sf), ("p09",), (0.2,), identity=False)
    cand = moved.select("signal_id", F.inline(detect_peaks(x, y, range_threshold(y))))
    return ref, cand


_TWO = (
    "WITH "
    + T.perturbed(("p09",), (0.2,))
    + ","
    + T.sql_peaks("pert", "signal_id", "0.05 * (s.ymax - s.ymin)", "ck")
    + ","
    + T.sql_peaks("sig", "signal_id", "0.05 * (s.ymax - s.ymin)", "rk")
)


@query(
    "peak_band_join",
    _TWO + " SELECT a.signal_id, a.pos AS ref_pos, b.pos AS cand_pos, abs(b.pos - a.pos) AS distance FROM rk a JOIN ck b USING (signal_id) WHERE abs(b.pos - a.pos) <= 2",
)
def peak_band_join(spark, sf):
    ref, cand = _peak_tables(spark, sf)
    return M.band_join(ref.select("signal_id", "pos"), cand.select("signal_id", "pos"), "signal_id", 2.0)


@query(
    "peak_match",
    _TWO + "," + T.sql_match("rk", "ck", "signal_id", "2.0", "mt") + " SELECT signal_id, l::BIGINT AS ref_no, r::BIGINT AS cand_no, d AS distance FROM mt",
)
def peak_match(spark, sf):
    x, y = F.col("axis"), F.col("y")
    df = A.pin(signals(spark, sf), {"ref_peaks": detect_peaks(x, y, range_threshold(y))})
    df = A.pin(perturb(df, ("p09",), (0.2,), identity=False), {"peaks": detect_peaks(x, y, range_threshold(y))})
    m = df.select("signal_id", F.inline(match_peaks(F.col("ref_peaks"), F.col("peaks"), 2.0)))
    return m.select(
        "signal_id",
        (F.col("l") + 1).cast("long").alias("ref_no"),
        (F.col("r") + 1).cast("long").alias("cand_no"),
        F.col("d").alias("distance"),
    )


# -- duplicates and overlaps -----------------------------------------------------


def _with_copies(spark, sf):
    """Every fifth signal also appears rescaled, every seventh slightly moved."""
    s = signals(spark, sf).select("signal_id", "class_id", "y")
    k = F.col("signal_id")
    a = s.filter(k % 5 == 0).select((k + 1_000_000).alias("signal_id"), "class_id", F.transform("y", lambda v: v * 2).alias("y"))
    b = s.filter(k % 7 == 0).select(
        (k + 2_000_000).alias("signal_id"), "class_id", F.transform("y", lambda v, i: v + F.when(i % 2 == 0, 0.00005).otherwise(-0.00005)).alias("y")
    )
    return s.unionByName(a).unionByName(b)


#: The distinct standardised vectors of ``_with_copies`` with their multiplicity.
SQL_DISTINCT_VECTORS = (
    T.SQL_SIGNALS
    + """, al AS (SELECT signal_id, i, y FROM sig UNION ALL SELECT signal_id + 1000000, i, y * 2 FROM sig WHERE signal_id % 5 = 0
 UNION ALL SELECT signal_id + 2000000, i, y + CASE WHEN i % 2 = 1 THEN 0.00005 ELSE -0.00005 END FROM sig WHERE signal_id % 7 = 0),
l AS (SELECT signal_id, list(y ORDER BY i) AS l FROM al GROUP BY ALL),
l2 AS (SELECT signal_id, list_transform(l, lambda x: x - list_sum(l) / len(l)) AS c FROM l),
v AS (SELECT signal_id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda u: u * u)) / len(c))) AS v FROM l2),
g AS MATERIALIZED (SELECT v, min(signal_id) AS id, count(*)::BIGINT AS m FROM v GROUP BY v)"""
)


@query(
    "near_dups",
    "WITH "
    + SQL_DISTINCT_VECTORS
    + """
SELECT a.id AS left_id, b.id AS right_id, a.m AS left_copies, b.m AS right_copies, (a.m * b.m)::BIGINT AS n_pairs, round(list_distance(a.v, b.v) / 8, 6) + 0.0 AS distance FROM g a JOIN g b ON a.id < b.id AND list_distance(a.v, b.v) / 8 <= 0.001
UNION ALL SELECT id, id, m, m, (m * (m - 1) // 2)::BIGINT, 0.0 FROM g WHERE m > 1""",
)
def near_dups(spark, sf):
    return U.near_duplicates(_with_copies(spark, sf)).withColumn("distance", R(F.col("distance")))


@query(
    "near_dup_groups",
    "WITH RECURSIVE "
    + SQL_DISTINCT_VECTORS
    + """, p AS MATERIALIZED (SELECT a.id AS l, b.id AS r, a.m * b.m AS n FROM g a JOIN g b ON a.id < b.id AND list_distance(a.v, b.v) / 8 <= 0.001),
e AS (SELECT l AS a, r AS b FROM p UNION ALL SELECT r, l FROM p),
nodes AS (SELECT id, m FROM g WHERE m > 1 OR id IN (SELECT a FROM e)),
reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.id),
lab AS (SELECT id, min(c) AS component FROM reach GROUP BY id),
k AS (SELECT component, sum(n) AS n FROM p JOIN lab ON l = id GROUP BY ALL)
SELECT component, sum(m)::BIGINT AS n_signals, count(*)::BIGINT AS n_vectors, (sum(m * (m - 1) // 2) + coalesce(any_value(k.n), 0))::BIGINT AS n_links
 FROM nodes JOIN lab USING (id) LEFT JOIN k USING (component) GROUP BY component""",
)
def near_dup_groups(spark, sf):
    return U.near_duplicate_groups(_with_copies(spark, sf))


@query(
    "signal_states",
    """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN vec_id % 9 = 4 THEN 0.0 WHEN vec_id % 7 = 3 AND x > 0 THEN NULL ELSE round(x) END) AS v FROM embeddings),
t AS (SELECT CASE WHEN len(list_filter(v, lambda x: x IS NULL)) > 0 THEN 'not_finite' WHEN list_min(v) = list_max(v) THEN 'constant' ELSE 'comparable' END AS state FROM s)
SELECT state, count(*)::BIGINT AS n FROM t GROUP BY ALL""",
)
def signal_states(spark, sf):
    """Flattened signals and signals with holes are named, not dropped in silence."""
    k = F.col("signal_id")
    s = signals(spark, sf).select(
        "signal_id",
        F.transform("y", lambda v: F.when(k % 9 == 4, 0.0).when((k % 7 == 3) & (v > 0), F.lit(None)).otherwise(F.rint(v))).alias("y"),
    )
    return U.signal_states(s).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(
    "exact_dups",
    f"""WITH d AS (SELECT md5(text) AS digest, CASE WHEN {sql_uniform(f"'{SEED}|role|' || doc_id")} < 0.6 THEN 'fit' ELSE 'test' END AS role FROM documents),
g AS (SELECT digest, count_if(role = 'fit') AS l, count_if(role = 'test') AS r FROM d GROUP BY digest)
SELECT digest, l::BIGINT AS n_left, r::BIGINT AS n_right, (l * r)::BIGINT AS n_pairs FROM g WHERE l > 0 AND r > 0""",
)
def exact_dups(spark, sf):
    d = table(spark, sf, "documents").select(
        F.md5("text").alias("digest"),
        F.when(H.uniform(SEED, "role", F.col("doc_id")) < 0.6, "fit").otherwise("test").alias("role"),
    )
    return U.exact_duplicate_pairs(d, "digest", "role", "fit", "test")


@query(
    "leakage_counts",
    f"""WITH d AS (SELECT doc_id, md5(text) AS digest, source, CASE WHEN {sql_uniform(f"'{SEED}|role|' || doc_id")} < 0.6 THEN 'fit' ELSE 'test' END AS role FROM documents),
g AS (SELECT digest, max(CASE WHEN role = 'fit' THEN 1 ELSE 0 END) AS f, max(CASE WHEN role = 'test' THEN 1 ELSE 0 END) AS t FROM d GROUP BY digest)
SELECT (SELECT count(*) FROM g WHERE f = 1)::BIGINT AS n_fit, (SELECT count(*) FROM g WHERE t = 1)::BIGINT AS n_test, (SELECT count(*) FROM g WHERE f = 1 AND t = 1)::BIGINT AS n_overlap,
 (SELECT count(DISTINCT source) FROM d)::BIGINT AS n_groups""",
)
def leakage_counts(spark, sf):
    d = table(spark, sf, "documents").select(
        F.md5("text").alias("digest"),
        "source",
        F.when(H.uniform(SEED, "role", F.col("doc_id")) < 0.6, "fit").otherwise("test").alias("role"),
    )
    g = d.groupBy("digest").agg(
        F.max((F.col("role") == "fit").cast("int")).alias("f"), F.max((F.col("role") == "test").cast("int")).alias("t")
    )
    n = g.agg(
        F.count_if(F.col("f") == 1).alias("n_fit"),
        F.count_if(F.col("t") == 1).alias("n_test"),
        F.count_if((F.col("f") == 1) & (F.col("t") == 1)).alias("n_overlap"),
    )
    return n.join(F.broadcast(d.agg(F.count_distinct("source").alias("n_groups"))), F.lit(True))


@query(
    "nearest_quantiles",
    f"WITH {_CLEAN}, b AS (SELECT seed, signal_id, max(score) AS s FROM bc GROUP BY ALL) SELECT seed::BIGINT AS seed, round(quantile_cont(s, 0.05), 6) AS q05, round(quantile_cont(s, 0.5), 6) AS q50, round(quantile_cont(s, 0.95), 6) AS q95 FROM b GROUP BY seed",
)
def nearest_quantiles(spark, sf):
    best = clean_scores(spark, sf).groupBy("seed", "signal_id").agg(F.max("score").alias("s"))
    q = exact_quantiles(best, ["seed"], "s", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    return q.select(F.col("seed").cast("long").alias("seed"), *[R(F.col(c)).alias(c) for c in ("q05", "q50", "q95")])


@query(
    "pair_status",
    """WITH m AS (SELECT o_orderkey // 2 AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'processed' END AS kind, o_orderstatus <> 'P' AS accepted FROM orders
 UNION ALL SELECT o_orderkey // 2, 'raw', true FROM orders WHERE o_orderkey % 10 = 0),
g AS (SELECT k, count_if(kind = 'raw') AS sr, count_if(kind = 'processed') AS sp, count_if(kind = 'raw' AND accepted) AS ar, count_if(kind = 'processed' AND accepted) AS ap FROM m GROUP BY k)
SELECT CASE WHEN ar = 0 AND ap = 0 THEN 'rejected_only' WHEN sr > 1 OR sp > 1 THEN 'ambiguous' WHEN ar = 1 AND ap = 1 THEN 'paired_unique' WHEN ar = 1 THEN 'raw_only' ELSE 'processed_only' END AS pair_status, count(*)::BIGINT AS n, sum(k)::BIGINT AS key_sum FROM g GROUP BY 1""",
)
def pair_status(spark, sf):
    """Order pairs as raw/processed measurements of one key; tenths are repeated."""
    o = table(spark, sf, "orders").select(
        F.floor(F.col("o_orderkey") / 2).alias("k"),
        F.when(F.col("o_orderkey") % 2 == 0, "raw").otherwise("processed").alias("kind"),
        (F.col("o_orderstatus") != "P").alias("accepted"),
        "o_orderkey",
    )
    extra = o.filter(F.col("o_orderkey") % 10 == 0).withColumns({"kind": F.lit("raw"), "accepted": F.lit(True)})
    s = U.pair_status(o.unionByName(extra), "k")
    return s.groupBy("pair_status").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("key_sum"))


@query(
    "axis_relation",
    """WITH r AS (SELECT vec_id, len(embedding) AS n, vec_id % 5 AS m FROM embeddings)
SELECT vec_id AS signal_id, CASE m WHEN 0 THEN 'exact_equal' WHEN 1 THEN 'processed_exact_contiguous_subset_of_raw' WHEN 2 THEN 'raw_exact_contiguous_subset_of_processed' WHEN 3 THEN 'no_axis_overlap' ELSE 'overlap_requires_alignment' END AS relation,
 CASE WHEN m IN (0, 2) THEN 0 WHEN m = 1 THEN 9 END::BIGINT AS raw_start, CASE WHEN m IN (0, 2) THEN n WHEN m = 1 THEN n - 1 END::BIGINT AS raw_end,
 CASE WHEN m IN (0, 1) THEN 0 WHEN m = 2 THEN 1 END::BIGINT AS processed_start, CASE WHEN m = 0 THEN n WHEN m = 1 THEN n - 10 WHEN m = 2 THEN n + 1 END::BIGINT AS processed_end FROM r""",
)
def axis_relation(spark, sf):
    """Five constructed relations between the axis and a derived one, by id."""
    m = F.col("signal_id") % 5
    n = F.size("axis")
    other = (
        F.when(m == 0, F.col("axis"))
        .when(m == 1, F.slice("axis", 10, n - 10))
        .when(m == 2, F.concat(F.array(F.lit(0.0)), F.col("axis"), F.array(F.lit(1e6))))
        .when(m == 3, F.transform("axis", lambda v: v + 1e4))
        .otherwise(F.transform("axis", lambda v: v + 0.5))
    )
    df = A.pin(signals(spark, sf), {"other": other})
    r = A.pin(df, {"r": U.axis_relation(F.col("axis"), F.col("other"))})
    return r.select(
        "signal_id",
        "r.relation",
        *[F.col(f"r.{c}").cast("long").alias(c) for c in ("raw_start", "raw_end", "processed_start", "processed_end")],
    )


@query(
    "content_digest",
    """SELECT label::BIGINT AS class_id, count(*)::BIGINT AS n, count(DISTINCT embedding)::BIGINT AS n_distinct,
 sha256(count(*) || '|' || sum(('0x' || substr(md5(vec_id::VARCHAR), 1, 13))::BIGINT)::HUGEINT || '|' || sum(('0x' || substr(md5(vec_id::VARCHAR), 14, 13))::BIGINT)::HUGEINT) AS id_set FROM embeddings GROUP BY 1""",
)
def content_digest(spark, sf):
    """Distinct contents and an id-set digest per class."""
    df = signals(spark, sf).withColumn("d", U.content_digest(F.col("axis"), F.col("y")))
    return U.set_digest(df, ["class_id"], "signal_id", "d")


@query(
    "validate_signals",
    """WITH r AS (SELECT vec_id, label, vec_id % 9 AS k FROM embeddings), v AS (
 SELECT vec_id, 'not_finite' AS code FROM r WHERE k = 1 UNION ALL SELECT vec_id, 'length_mismatch' FROM r WHERE k = 2
 UNION ALL SELECT vec_id, 'axis_not_monotone' FROM r WHERE k = 3 UNION ALL SELECT vec_id, 'unknown_class' FROM r WHERE label = 9
 UNION ALL SELECT vec_id, 'duplicate_id' FROM r WHERE k = 4)
SELECT code, count(*)::BIGINT AS n, min(vec_id) AS first_id FROM v GROUP BY code""",
)
def validate_signals(spark, sf):
    """Four kinds of damage by id, and class 9 undeclared."""
    k = F.col("signal_id") % 9
    df = A.pin(
        signals(spark, sf),
        {
            "y": F.when(k == 1, F.transform("y", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v)))
            .when(k == 2, F.slice("y", 1, 10))
            .otherwise(F.col("y")),
            "axis": F.when(k == 3, F.transform("axis", lambda v: -F.abs(v - 20))).otherwise(F.col("axis")),
        },
    )
    df = df.unionByName(df.filter(k == 4))
    classes = signals(spark, sf).select("class_id").distinct().filter("class_id < 9")
    v = store.violations(df, classes)
    return v.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("signal_id").alias("first_id"))


@query(
    "dataset_diff",
    """SELECT count_if(o_orderkey % 13 = 0)::BIGINT AS n_missing, count_if(o_orderkey % 17 = 0)::BIGINT AS n_extra, count_if(o_orderkey % 13 <> 0 AND o_orderkey % 5 = 0)::BIGINT AS n_value,
 count_if(o_orderkey % 13 <> 0 AND o_orderkey % 11 = 0)::BIGINT AS n_label FROM orders""",
)
def dataset_diff(spark, sf):
    """A damaged copy of orders against its source."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    copy = o.filter(k % 13 != 0).select(
        k,
        F.when(k % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 11 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    extra = o.filter(k % 17 == 0).withColumn("o_orderkey", -k - 1)
    return U.dataset_diff(
        o,
        copy.unionByName(extra),
        "o_orderkey",
        {
            "n_value": ~F.col("s_o_totalprice").eqNullSafe(F.col("t_o_totalprice")),
            "n_label": ~F.col("s_o_orderstatus").eqNullSafe(F.col("t_o_orderstatus")),
        },
    )


# -- stores ----------------------------------------------------------------------


def scratch(spark, name: str) -> str:
    """A new folder for one written table: the shared folder, else /tmp."""
    from ..operators.checkpoints import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"


@query(
    "write_signal_store",
    "SELECT count(*)::BIGINT AS n_signals, 1::BIGINT AS n_axes, count(DISTINCT label)::BIGINT AS n_partitions FROM embeddings",
)
def write_signal_store(spark, sf):
    path = scratch(spark, "store")
    store.write(signals(spark, sf).withColumn("dataset_id", F.col("class_id")), path)
    return store.manifest(spark, path)


@query(
    "read_signal_store",
    "WITH " + T.SQL_SIGNALS + " SELECT signal_id, round(sum(i * y), 6) + 0.0 AS checksum, max(x) AS last_x FROM sig WHERE class_id = 3 GROUP BY ALL",
)
def read_signal_store(spark, sf):
    """Round trip through the store, reading one dataset partition."""
    path = scratch(spark, "store")
    store.write(signals(spark, sf).withColumn("dataset_id", F.col("class_id")), path)
    df = store.read(spark, path, dataset_id=3)
    return df.select("signal_id", checksum(F.col("y")).alias("checksum"), F.element_at("axis", -1).alias("last_x"))


@query(
    "write_perturbed",
    "WITH " + T.perturbed(("p09", "p11"))
    + " SELECT perturbation_id, count(DISTINCT signal_id)::BIGINT AS n_sources, count(DISTINCT (signal_id, alpha))::BIGINT AS n_records, 'complete' AS status FROM pert GROUP BY ALL",
)
def write_perturbed(spark, sf):
    path = scratch(spark, "perturbed")
    store.write_perturbed(perturb(signals(spark, sf), ("p09", "p11"), identity=False), path, ("p09", "p11"), n_strengths=8)
    records = store.read_perturbed(spark, path)
    cells = spark.read.parquet(f"{path}/cells")
    n = records.groupBy("perturbation_id").agg(
        F.count_distinct("signal_id").alias("n_sources"), F.count(F.lit(1)).alias("n_records")
    )
    status = cells.groupBy("perturbation_id").agg(F.max("status").alias("status"))
    return n.join(status, "perturbation_id")


@query(
    "write_results",
    "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity, CASE WHEN l_returnflag = 'N' THEN NULL ELSE 'kept' END AS note FROM lineitem GROUP BY ALL",
)
def write_results(spark, sf):
    """CSV and JSON sinks with a fixed column order and empty text for null."""
    df = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )
    df = df.withColumn("note", F.when(F.col("l_returnflag") != "N", "kept"))
    path = scratch(spark, "results")
    columns = ["l_returnflag", "l_linestatus", "n", "quantity", "note"]
    store.write_results(df, path, columns)
    return spark.read.schema("l_returnflag string, l_linestatus string, n bigint, quantity double, note string").csv(
        f"{path}/csv", header=True, nullValue=""
    )


@query(
    "resume_pending",
    f"""WITH p AS (SELECT vec_id AS signal_id, unnest(['p08', 'p09', 'p10']) AS perturbation_id FROM embeddings)
SELECT perturbation_id, count(*)::BIGINT AS n_pending, sum(signal_id)::BIGINT AS id_sum FROM p WHERE NOT ((signal_id % 3 = 0 AND perturbation_id = 'p08') OR (signal_id % 4 = 0 AND perturbation_id = 'p10')) GROUP BY ALL""",
)
def resume_pending(spark, sf):
    planned = ids(spark, sf).select("signal_id", F.explode(F.array(*[F.lit(p) for p in T.NONAXIS])).alias("perturbation_id"))
    k, p = F.col("signal_id") % 12, F.col("perturbation_id")
    done = planned.filter(((k % 3 == 0) & (p == "p08")) | ((k % 4 == 0) & (p == "p10")))
    pending = store.pending(planned, done, ["signal_id", "perturbation_id"])
    return pending.groupBy("perturbation_id").agg(F.count(F.lit(1)).alias("n_pending"), F.sum("signal_id").alias("id_sum"))


@query(
    "named_views",
    f"""WITH v AS (SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag || '-' || l_linestatus AS view_id, n, true AS is_intersection, true AS disjoint, true AS exhaustive FROM v""",
)
def named_views(spark, sf):
    """Condition x role views of the line items with checked algebra."""
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_tax", "l_discount", "l_quantity").alias("record_id"),
        F.col("l_returnflag").alias("condition"),
        F.col("l_linestatus").alias("role"),
    )
    return store.named_views(li)


@query(
    "endmembers",
    "WITH " + T.SQL_SIGNALS + ", m AS (SELECT class_id, signal_id % 2 AS component, i, median(y) AS y FROM sig GROUP BY ALL) SELECT class_id, component, round(sum(i * y), 6) + 0.0 AS checksum, round(max(y), 6) + 0.0 AS top FROM m GROUP BY ALL",
)
def endmembers(spark, sf):
    """Pointwise median signal per (condition, component)."""
    df = signals(spark, sf).withColumn("component", F.col("signal_id") % 2)
    e = store.endmembers(df, ["class_id", "component"])
    return e.select("class_id", "component", checksum(F.col("y")).alias("checksum"), R(F.array_max("y")).alias("top"))


# -- replicates, calibration, covariance -------------------------------------------


@query(
    "half_split",
    "WITH " + T.SQL_SIGNALS
    + """, r AS (SELECT group_id, i, y, dense_rank() OVER (PARTITION BY group_id ORDER BY signal_id) % 2 AS h FROM sig),
m AS (SELECT group_id, i, avg(y) FILTER (h = 1) AS a, avg(y) FILTER (h = 0) AS b FROM r GROUP BY ALL)
SELECT group_id, CASE WHEN count(b) > 0 THEN round(corr(a, b), 6) + 0.0 END AS consistency FROM m GROUP BY ALL""",
)
def half_split(spark, sf):
    """Odd against even replicates of every group, in id order."""
    df = tasks.half_split(signals(spark, sf), "group_id", "signal_id")
    return df.withColumn("consistency", R(F.col("consistency")))


@query(
    "lod_loq",
    """WITH r AS (SELECT l_linenumber % 5 AS fold, l_returnflag AS target, l_quantity AS t, l_extendedprice / 1500 AS p, l_linestatus = 'O' AND l_quantity <= 5 AS blank FROM lineitem),
s AS (SELECT fold, target, regr_slope(p, t) AS slope, regr_intercept(p, t) AS intercept, stddev_samp(p) FILTER (blank) AS sigma FROM r GROUP BY ALL)
SELECT fold::BIGINT AS fold, target, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, CASE WHEN slope > 0 THEN round(3.3 * sigma / slope, 5) + 0.0 END AS ich_lod,
 CASE WHEN slope > 0 THEN round(10 * sigma / slope, 5) + 0.0 END AS ich_loq, CASE WHEN slope > 0 THEN round(3 * sigma / slope, 5) + 0.0 END AS iupac_lod FROM s""",
)
def lod_loq(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_linenumber") % 5).cast("long").alias("fold"),
        F.col("l_returnflag").alias("target"),
        F.col("l_quantity").alias("y_true"),
        (F.col("l_extendedprice") / 1500).alias("y_pred"),
        ((F.col("l_linestatus") == "O") & (F.col("l_quantity") <= 5)).alias("is_blank"),
    )
    df = tasks.detection_limits(li, ["fold", "target"])
    return df.select(
        "fold", "target", R(F.col("slope")).alias("slope"), R(F.col("intercept")).alias("intercept"),
        *[R(F.col(c), 5).alias(c) for c in ("ich_lod", "ich_loq", "iupac_lod")],
    )


@query(
    "shrunk_cov",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
l AS (SELECT label, k, v[k] AS x FROM v, range(1, 65) r(k)),
m AS (SELECT label, k, avg(x) AS m FROM l GROUP BY ALL),
mm AS (SELECT label, list(m ORDER BY k) AS mm FROM m GROUP BY ALL),
c AS (SELECT label, [v[i] - mm[i] for i in range(1, 65)] AS c FROM v JOIN mm USING (label)),
s AS (SELECT label, i, j, avg(c[i] * c[j]) AS s, count(*)::BIGINT AS n FROM c, range(1, 65) a(i), range(1, 65) b(j) GROUP BY ALL),
q AS (SELECT label, avg(power(list_dot_product(c, c), 2)) AS q FROM c GROUP BY ALL),
t AS (SELECT label, sum(s) FILTER (i = j) / 64 AS mu, sum(s * s) AS norm, any_value(n) AS n FROM s GROUP BY ALL),
h AS (SELECT label, mu, n, least(greatest((q - norm) / (64 * n), 0), (norm - 64 * mu * mu) / 64) / ((norm - 64 * mu * mu) / 64) AS sh FROM t JOIN q USING (label))
SELECT label::BIGINT AS class_id, h.n, round(sh, 6) AS shrinkage, i::BIGINT AS i, j::BIGINT AS j, round((1 - sh) * s + CASE WHEN i = j THEN sh * mu ELSE 0 END, 8) + 0.0 AS covariance FROM s JOIN h USING (label) WHERE i <= j""",
)
def shrunk_cov(spark, sf):
    """All 64 values of every class."""
    out = shrunk_covariance(signals(spark, sf), ["class_id"], "y", 64)
    return out.select(
        "class_id", "n", R(F.col("shrinkage")).alias("shrinkage"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), R(F.col("covariance"), 8).alias("covariance")
    )
