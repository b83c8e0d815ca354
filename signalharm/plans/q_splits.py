"""Splits, groups, quotas and filters over the driver tables."""

from pyspark.sql import functions as F

from ..operators import splits as S
from ..operators.perturb import SEED
from .registry import query
from .sqltext import key
from .tables import signals, sql_uniform, table

_G = "'c' || label || '-g' || (vec_id // 50)"
_EMB = f"e AS (SELECT vec_id AS signal_id, label::BIGINT AS class_id, {_G} AS group_id FROM embeddings)"


def _h(*parts):
    return f"md5({key(*parts)})"


def ids(spark, sf):
    return signals(spark, sf).select("signal_id", "class_id", "group_id")


def _hubs(spark, sf):
    """Documents with their three leakage keys: content, folded content, (lang, length)."""
    d = table(spark, sf, "documents")
    folded = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return d.select(
        "doc_id",
        F.explode(
            F.array(
                F.concat(F.lit("t"), F.md5("text")),
                F.concat(F.lit("f"), F.md5(folded)),
                F.concat_ws("-", F.lit("n"), "lang", "source", "n_chars"),
            )
        ).alias("hub"),
    )


_HUBS = """hub AS MATERIALIZED (
 SELECT doc_id, 't' || md5(text) AS h FROM documents
 UNION SELECT doc_id, 'f' || md5(regexp_replace(lower(text), '[^a-z]', '', 'g')) FROM documents
 UNION SELECT doc_id, 'n-' || lang || '-' || source || '-' || n_chars FROM documents),
ed AS MATERIALIZED (SELECT a.doc_id AS a, b.m AS b FROM hub a JOIN (SELECT h, min(doc_id) AS m FROM hub GROUP BY h) b USING (h)
   WHERE a.doc_id <> b.m),
e2 AS MATERIALIZED (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, e2.b FROM reach JOIN e2 ON reach.r = e2.a)"""


@query(
    "leakage_components",
    "WITH RECURSIVE " + _HUBS + " SELECT id AS doc_id, min(r) AS component_id FROM reach GROUP BY id",
)
def leakage_components(spark, sf):
    return S.leakage_components(_hubs(spark, sf), "doc_id", "hub")


@query(
    "eligible_classes",
    f"WITH {_EMB}, "
    + """x AS (SELECT signal_id, class_id, CASE WHEN signal_id % 50 = 0 THEN 'shared-' || (signal_id // 200) ELSE group_id END AS group_id FROM e),
k AS (SELECT * FROM x WHERE group_id IN (SELECT group_id FROM x GROUP BY 1 HAVING count(DISTINCT class_id) = 1))
SELECT signal_id, class_id, group_id FROM k WHERE class_id IN (SELECT class_id FROM k GROUP BY 1 HAVING count(DISTINCT group_id) >= 2)""",
)
def eligible_classes(spark, sf):
    """Every fiftieth signal is moved to a group that crosses classes."""
    df = ids(spark, sf).withColumn(
        "group_id",
        F.when(
            F.col("signal_id") % 50 == 0,
            F.concat(F.lit("shared-"), F.floor(F.col("signal_id") / 200).cast("long")),
        ).otherwise(F.col("group_id")),
    )
    return S.eligible_classes(df, "signal_id", "class_id", "group_id").select(
        "signal_id", "class_id", "group_id"
    )


SEEDS = (1, 2, 3, 4, 5)
SQL_QUERY_LIBRARY = f"""
seed_list AS (SELECT unnest([1, 2, 3, 4, 5]) AS seed),
gr AS (SELECT DISTINCT class_id, group_id FROM e),
ql AS MATERIALIZED (SELECT seed, class_id, group_id, CASE WHEN row_number() OVER (PARTITION BY seed, class_id
  ORDER BY {_h("seed", "'query'", "class_id", "group_id")}, group_id) = 1 THEN 'query' ELSE 'library' END AS role FROM gr, seed_list)"""


@query(
    "split_query_library",
    f"WITH {_EMB}, {SQL_QUERY_LIBRARY} SELECT seed::BIGINT AS seed, class_id, group_id, role FROM ql",
)
def split_query_library(spark, sf):
    return S.query_library(ids(spark, sf), "class_id", "group_id", SEEDS).withColumn(
        "seed", F.col("seed").cast("long")
    )


@query(
    "split_stratified",
    f"""WITH {_EMB} SELECT signal_id, class_id, CASE WHEN row_number() OVER (PARTITION BY class_id ORDER BY
 {_h("'7|stratified'", "class_id", "signal_id")}, signal_id) <= 10 THEN 'validation' ELSE 'train' END AS role FROM e""",
)
def split_stratified(spark, sf):
    df = ids(spark, sf).select("signal_id", "class_id")
    return S.stratified(df, "class_id", "signal_id", 10, 7)


@query(
    "few_shot",
    f"""WITH {_EMB}, s AS (SELECT *, unnest([1, 2, 3]) AS seed FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, class_id ORDER BY {_h("'few_shot'", "seed", "class_id", "signal_id")}, signal_id) AS rank FROM s)
SELECT seed::BIGINT AS seed, class_id, signal_id, k::BIGINT AS shots, CASE WHEN rank <= k THEN 'train' ELSE 'validation' END AS role
FROM r, (VALUES (5), (10), (20)) t(k) WHERE rank <= k OR (rank > 20 AND rank <= 30)""",
)
def few_shot(spark, sf):
    df = S.few_shot(ids(spark, sf), "class_id", "signal_id", (1, 2, 3))
    return df.select(
        F.col("seed").cast("long").alias("seed"),
        "class_id",
        "signal_id",
        F.col("shots").cast("long").alias("shots"),
        "role",
    )


@query(
    "group_kfold",
    f"""WITH {_EMB}, g AS (SELECT DISTINCT group_id FROM e),
f AS (SELECT group_id, (row_number() OVER (ORDER BY {_h("'kfold|0'", "group_id")}, group_id) - 1) % 5 AS fold FROM g)
SELECT group_id, fold::BIGINT AS fold, seed::BIGINT AS seed, CASE (fold - seed + 5) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS role
FROM f, range(0, 5) t(seed)""",
)
def group_kfold(spark, sf):
    df = S.group_kfold(ids(spark, sf), "group_id")
    return df.select(
        "group_id",
        F.col("fold").cast("long").alias("fold"),
        F.col("seed").cast("long").alias("seed"),
        "role",
    )


_ROLE_U = sql_uniform(key(f"'{SEED}|role'", "c_custkey"))


@query(
    "hash_roles",
    f"""WITH u AS (SELECT c_custkey, {_ROLE_U} AS u FROM customer)
SELECT c_custkey, CASE WHEN u < 0.6 THEN 'fit' WHEN u < 0.8 THEN 'template' ELSE 'holdout' END AS role FROM u""",
)
def hash_roles(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", S.hash_role(F.col("c_custkey"), SEED, 0.6, 0.8).alias("role")
    )


_QUOTA = """c AS (SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY 1),
s AS (SELECT *, (100 - count(*) OVER ()) AS ex, sum(n) OVER () - count(*) OVER () AS cap FROM c),
q AS (SELECT *, (ex * (n - 1)) // cap AS fl, (ex * (n - 1)) % cap AS rem FROM s),
quota AS MATERIALIZED (SELECT c_mktsegment, n, (1 + fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, c_mktsegment) <= ex - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM q)"""


@query("class_quotas", f"WITH {_QUOTA} SELECT c_mktsegment, n, quota, true AS feasible FROM quota")
def class_quotas(spark, sf):
    c = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return S.class_quotas(c, "c_mktsegment", 100)


@query(
    "round_robin_sample",
    f"""WITH {_QUOTA},
d AS (SELECT c_mktsegment, c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey
  ORDER BY {_h("'9|record'", "c_mktsegment", "c_nationkey", "c_custkey")}, c_custkey) AS depth FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY depth, {_h("'9|sample'", "c_mktsegment", "c_nationkey")}, c_nationkey) AS k FROM d)
SELECT c_mktsegment, c_nationkey::BIGINT AS c_nationkey, c_custkey, depth::BIGINT AS depth FROM r JOIN quota USING (c_mktsegment) WHERE k <= quota""",
)
def round_robin_sample(spark, sf):
    c = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", "c_custkey")
    quotas = S.class_quotas(
        c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "c_mktsegment", 100
    )
    df = S.round_robin(c, quotas, "c_mktsegment", "c_nationkey", "c_custkey", 9)
    return df.select(
        "c_mktsegment",
        F.col("c_nationkey").cast("long").alias("c_nationkey"),
        "c_custkey",
        F.col("depth").cast("long").alias("depth"),
    )


@query(
    "calibration_pairs",
    f"""WITH {_EMB}, n AS (SELECT count(*) AS n FROM e),
a AS (SELECT sum(c) * (sum(c) - 1) // 2 - sum(c * (c - 1) // 2) AS adm, sum(c) AS n FROM (SELECT count(*) AS c FROM e GROUP BY group_id)),
r AS (SELECT *, row_number() OVER (ORDER BY {_h("'5|pair|0'", "signal_id")}, signal_id) - 1 AS k FROM e),
d AS (SELECT draw, floor({sql_uniform("'5|left|' || draw")} * n)::BIGINT AS a, floor({sql_uniform("'5|right|' || draw")} * n)::BIGINT AS b
  FROM a, LATERAL (SELECT unnest(range(0, floor(200 * 2.0 / (adm / (n * n / 2.0)))::BIGINT + 64)) AS draw)),
p AS (SELECT least(x.signal_id, y.signal_id) AS left_id, greatest(x.signal_id, y.signal_id) AS right_id, min(draw) AS draw
  FROM d JOIN r x ON x.k = d.a JOIN r y ON y.k = d.b WHERE x.group_id <> y.group_id AND x.signal_id <> y.signal_id GROUP BY ALL)
SELECT left_id, right_id FROM p ORDER BY draw, left_id, right_id LIMIT 200""",
)
def calibration_pairs(spark, sf):
    return S.calibration_pairs(ids(spark, sf), "signal_id", "group_id", 200, 5)


@query(
    "role_ledger",
    f"""WITH {_EMB}, {SQL_QUERY_LIBRARY}
SELECT seed::BIGINT AS seed, role, count(*)::BIGINT AS n_records, count(DISTINCT group_id)::BIGINT AS n_groups,
 count(DISTINCT class_id)::BIGINT AS n_classes, 0::BIGINT AS n_repeated FROM e JOIN ql USING (class_id, group_id) GROUP BY ALL""",
)
def role_ledger(spark, sf):
    """Every record's role per seed, summarised with its uniqueness check."""
    e = ids(spark, sf)
    roles = S.query_library(e, "class_id", "group_id", SEEDS)
    ledger = e.join(roles, ["class_id", "group_id"])
    per = ledger.groupBy("seed", "role").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct("group_id").alias("n_groups"),
        F.count_distinct("class_id").alias("n_classes"),
        (F.count(F.lit(1)) - F.count_distinct("signal_id")).alias("n_repeated"),
    )
    return per.withColumn("seed", F.col("seed").cast("long"))


@query(
    "split_leakage",
    f"""WITH u AS (SELECT doc_id, md5(text) AS d, {sql_uniform(key(f"'{SEED}|role'", "doc_id"))} AS u FROM documents),
r AS (SELECT d, CASE WHEN u < 0.6 THEN 'fit' WHEN u < 0.8 THEN 'template' ELSE 'holdout' END AS role FROM u)
SELECT d AS digest, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM r GROUP BY d HAVING count(DISTINCT role) > 1""",
)
def split_leakage(spark, sf):
    """Identical documents whose copies fall into different roles."""
    d = table(spark, sf, "documents").select(
        F.md5("text").alias("digest"), S.hash_role(F.col("doc_id"), SEED, 0.6, 0.8).alias("role")
    )
    return S.split_leakage(d, "digest").withColumn("roles", F.array_join("roles", ","))


@query(
    "split_contract",
    f"""WITH {_EMB}, {SQL_QUERY_LIBRARY},
items AS (SELECT 'library-' || seed AS split, signal_id AS id, class_id AS class FROM e, seed_list
  UNION ALL SELECT 'orders', c_custkey, c_nationkey FROM customer),
roles AS (SELECT 'library-' || seed AS split, signal_id AS id, role FROM e JOIN ql USING (class_id, group_id)
  UNION ALL SELECT 'orders', o_custkey, CASE o_orderstatus WHEN 'F' THEN 'library' WHEN 'O' THEN 'query' ELSE 'other' END FROM orders),
r AS (SELECT split, id, count(*) AS n, count(DISTINCT role) AS kinds, bool_or(role = 'query') AS q, bool_or(role = 'library') AS l FROM roles GROUP BY ALL),
both_ AS (SELECT coalesce(i.split, r.split) AS split, i.id AS item, i.class, r.id AS given, r.n, r.kinds, r.q, r.l
  FROM items i FULL JOIN r ON i.split = r.split AND i.id = r.id),
held AS (SELECT DISTINCT split, class FROM both_ WHERE item IS NOT NULL AND l),
c AS (SELECT split, count(item)::BIGINT AS n_items, count(*) FILTER (given IS NULL)::BIGINT AS n_unassigned, count(*) FILTER (n > 1)::BIGINT AS n_repeated,
  count(*) FILTER (kinds > 1)::BIGINT AS n_conflicts, count(*) FILTER (item IS NULL)::BIGINT AS n_unknown,
  count(*) FILTER (item IS NOT NULL AND q AND NOT EXISTS (SELECT 1 FROM held h WHERE h.split = both_.split AND h.class = both_.class))::BIGINT AS n_absent_class
  FROM both_ GROUP BY split)
SELECT *, n_unassigned + n_repeated + n_unknown = 0 AS complete, n_unassigned + n_repeated + n_unknown + n_absent_class = 0 AS valid FROM c""",
)
def split_contract(spark, sf):
    """Query/library splits of the signals, and customers whose roles are their orders' states."""
    e = ids(spark, sf)
    roles = e.join(S.query_library(e, "class_id", "group_id", SEEDS), ["class_id", "group_id"])
    seeds = F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    name = F.concat(F.lit("library-"), F.col("seed")).alias("split")
    items = e.select("signal_id", "class_id", seeds).select(
        name, F.col("signal_id").cast("long").alias("id"), F.col("class_id").cast("long").alias("class")
    )
    items = items.unionByName(
        table(spark, sf, "customer").select(
            F.lit("orders").alias("split"),
            F.col("c_custkey").cast("long").alias("id"),
            F.col("c_nationkey").cast("long").alias("class"),
        )
    )
    status = F.col("o_orderstatus")
    by_orders = table(spark, sf, "orders").select(
        F.lit("orders").alias("split"),
        F.col("o_custkey").cast("long").alias("id"),
        F.when(status == "F", "library").when(status == "O", "query").otherwise("other").alias("role"),
    )
    given = roles.select(name, F.col("signal_id").cast("long").alias("id"), "role").unionByName(by_orders)
    return S.split_contract(items, given, ["split"], "id", "class")


@query(
    "assign_stratum",
    """SELECT CASE WHEN p_retailprice >= 900 AND p_retailprice < 950 THEN 'low' WHEN p_retailprice >= 950 AND p_retailprice < 1000 THEN 'mid'
 WHEN p_retailprice >= 1000 AND p_retailprice <= 1100 THEN 'high' END AS stratum, count(*)::BIGINT AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1""",
)
def assign_stratum(spark, sf):
    from ..operators.filters import stratum

    bounds = [("low", 900, 950), ("mid", 950, 1000), ("high", 1000, 1100)]
    return (
        table(spark, sf, "part")
        .select(stratum(F.col("p_retailprice"), bounds).alias("stratum"), "p_retailprice")
        .groupBy("stratum")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("p_retailprice").alias("lo"),
            F.max("p_retailprice").alias("hi"),
        )
    )


@query(
    "filter_allowed",
    """SELECT l_discount AS alpha, l_linestatus AS status, count(*)::BIGINT AS n FROM lineitem
WHERE l_linestatus = 'O' AND l_discount IN (0.0, 0.05, 0.1) GROUP BY ALL""",
)
def filter_allowed(spark, sf):
    from ..operators.filters import allowed

    df = table(spark, sf, "lineitem").select(
        F.col("l_discount").alias("alpha"), F.col("l_linestatus").alias("status")
    )
    return allowed(df, status="O", alphas=(0.0, 0.05, 0.1)).groupBy("alpha", "status").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "assign_blocks",
    """SELECT vec_id // 40 AS block, count(*)::BIGINT AS n, max(vec_id % 40)::BIGINT AS last_index, sum(label)::BIGINT AS label_sum FROM embeddings GROUP BY 1""",
)
def assign_blocks(spark, sf):
    """Matrix rows (here the stored row number) to surrogate blocks of forty."""
    block, index = S.assign_blocks(F.col("signal_id"), 40)
    return (
        ids(spark, sf)
        .select(block.alias("block"), index.alias("i"), "class_id")
        .groupBy("block")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("i").alias("last_index"),
            F.sum("class_id").alias("label_sum"),
        )
    )


@query(
    "id_set_ops",
    """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000)
SELECT (SELECT count(*) FROM (SELECT id FROM a UNION SELECT id FROM b))::BIGINT AS n_union,
 (SELECT count(*) FROM (SELECT id FROM a INTERSECT SELECT id FROM b))::BIGINT AS n_both,
 (SELECT count(*) FROM (SELECT id FROM a EXCEPT SELECT id FROM b))::BIGINT AS n_left_only,
 (SELECT count(*) FROM (SELECT id FROM b EXCEPT SELECT id FROM a))::BIGINT AS n_right_only""",
)
def id_set_ops(spark, sf):
    from ..operators.filters import set_sizes

    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return set_sizes(a, b, "id")
