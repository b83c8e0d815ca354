"""Leakage-safe splits, quotas and samples; order comes from hashes, never from data order."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H
from .checkpoints import ensure_checkpoint_dir


def leakage_components(edges: DataFrame, id_col: str, hub_col: str) -> DataFrame:
    """Union ids that share any hub; the component is its smallest id.

    Each round takes the minimum label per hub (a partial aggregate, so a hub
    with a third of all rows is cheap), pushes it back to the members, then
    follows the label's own label, which halves the remaining distance.  All joins
    are merges of shuffled sides: no table of ids passes the driver as a broadcast.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(id_col, hub_col).distinct().checkpoint()
    labels = edges.select(id_col).distinct().withColumn("label", F.col(id_col))
    while True:
        hubs = (
            edges.join(labels.hint("merge"), id_col).groupBy(hub_col).agg(F.min("label").alias("hub_label"))
        )
        low = edges.join(hubs.hint("merge"), hub_col).groupBy(id_col).agg(F.min("hub_label").alias("low"))
        jump = labels.select(F.col(id_col).alias("low"), F.col("label").alias("far"))
        step = (
            labels.join(low.hint("merge"), id_col)
            .join(jump.hint("merge"), "low", "left")
            .select(
                id_col,
                F.least("label", "low", F.coalesce("far", "low")).alias("new"),
                F.col("label").alias("old"),
            )
            .checkpoint()
        )
        changed = step.filter(F.col("new") < F.col("old")).limit(1).count()
        labels = step.select(id_col, F.col("new").alias("label"))
        if changed == 0:
            return labels.withColumnRenamed("label", "component_id")


def eligible_classes(df: DataFrame, id_col: str, class_col: str, group_col: str) -> DataFrame:
    """Drop groups that span classes, then classes left with one group."""
    clean = df.groupBy(group_col).agg(
        F.min(class_col).alias("_a"), F.max(class_col).alias("_b")
    ).filter(F.col("_a") == F.col("_b"))
    kept = df.join(clean.select(group_col), group_col, "left_semi")
    groups = kept.select(class_col, group_col).distinct()
    rich = groups.groupBy(class_col).count().filter(F.col("count") >= 2)
    return kept.join(rich.select(class_col), class_col, "left_semi")


def query_library(groups: DataFrame, class_col: str, group_col: str, seeds) -> DataFrame:
    """One hashed group per (seed, class) becomes the query, the rest the library.

    The winner is a minimum over hashes: a partial aggregate, not a sort.
    """
    g = groups.select(class_col, group_col).distinct()
    g = g.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    g = g.withColumn("_h", H.digest(F.col("seed"), "query", F.col(class_col), F.col(group_col)))
    win = g.groupBy("seed", class_col).agg(
        F.min(F.struct("_h", group_col)).alias("_w")
    ).select("seed", class_col, F.col(f"_w.{group_col}").alias("_q"))
    return g.join(win, ["seed", class_col]).select(
        "seed",
        class_col,
        group_col,
        F.when(F.col(group_col) == F.col("_q"), "query").otherwise("library").alias("role"),
    )


def hash_rank(df: DataFrame, keys: list[str], id_col: str, *salt) -> DataFrame:
    """Position of each row in its key's hashed permutation (1-based ``rank``).

    Ranks of a hot key are split over 256 hash-prefix buckets: a count per
    bucket gives the offset, a window inside the bucket gives the rest.
    """
    h = H.digest(*salt, *[F.col(k) for k in keys], F.col(id_col))
    df = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", id_col))
    return (
        df.join(offsets, [*keys, "_b"])
        .withColumn("rank", F.col("_off") + inside)
        .drop("_h", "_b", "_off")
    )


def stratified(df: DataFrame, class_col: str, id_col: str, n_validation: int, seed) -> DataFrame:
    """The first n of each class's hashed order validate, the rest train."""
    r = hash_rank(df, [class_col], id_col, seed, "stratified")
    return r.withColumn(
        "role", F.when(F.col("rank") <= n_validation, "validation").otherwise("train")
    ).drop("rank")


def few_shot(df, class_col, id_col, seeds, shots=(5, 10, 20), n_validation=10) -> DataFrame:
    """Nested selections of one permutation per (seed, class); the next rows validate."""
    top = max(shots)
    d = df.select(class_col, id_col, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    r = hash_rank(d, ["seed", class_col], id_col, "few_shot")
    plan = F.array(
        *[
            F.struct(F.lit(k).alias("shots"), F.lit("train").alias("role"), (F.col("rank") <= k).alias("ok"))
            for k in shots
        ],
        *[
            F.struct(
                F.lit(k).alias("shots"),
                F.lit("validation").alias("role"),
                ((F.col("rank") > top) & (F.col("rank") <= top + n_validation)).alias("ok"),
            )
            for k in shots
        ],
    )
    return (
        r.filter(F.col("rank") <= top + n_validation)
        .select("seed", class_col, id_col, "rank", F.inline(plan))
        .filter("ok")
        .drop("ok")
    )


def group_kfold(groups: DataFrame, group_col: str, folds: int = 5, seeds=range(5)) -> DataFrame:
    """Groups dealt round-robin in hashed order; seed s tests fold s, validates s+1."""
    g = groups.select(group_col).distinct().withColumn("_all", F.lit(0))
    g = hash_rank(g, ["_all"], group_col, "kfold").select(
        group_col, ((F.col("rank") - 1) % folds).alias("fold")
    )
    g = g.select("*", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    gap = F.pmod(F.col("fold") - F.col("seed"), F.lit(folds))
    return g.withColumn(
        "role", F.when(gap == 0, "test").when(gap == 1, "validation").otherwise("train")
    )


def hash_role(group: Column, seed, fit: float, holdout: float) -> Column:
    """Role from a group's hash against two thresholds."""
    u = H.uniform(seed, "role", group)
    return F.when(u < fit, "fit").when(u < holdout, "template").otherwise("holdout")


def class_quotas(counts: DataFrame, class_col: str, size: int) -> DataFrame:
    """One row per class, the rest proportional to what is left, largest remainders first.

    ``counts`` has one row per class with column ``n``.  The table of classes is
    small next to the data, and only its sums are global.
    """
    sums = counts.agg(F.sum("n").alias("_total"), F.count(F.lit(1)).alias("_k"))
    c = counts.join(F.broadcast(sums), F.lit(True))  # a single row
    extra, capacity = F.lit(size) - F.col("_k"), F.col("_total") - F.col("_k")
    product = extra * (F.col("n") - 1)
    c = c.withColumns(
        {
            "_q": F.when(capacity > 0, F.floor(product / capacity)).otherwise(0),
            "_r": F.when(capacity > 0, product % capacity).otherwise(0),
        }
    )
    given = c.agg(F.sum("_q").alias("_given"))
    c = c.join(F.broadcast(given), F.lit(True))
    c = c.withColumn("_all", F.lit(0))
    order = F.row_number().over(Window.partitionBy("_all").orderBy(F.desc("_r"), class_col))
    return c.withColumn("_o", order).select(
        class_col,
        "n",
        (
            1 + F.col("_q") + F.when(F.col("_o") <= extra - F.col("_given"), 1).otherwise(0)
        ).cast("long").alias("quota"),
        ((F.col("_total") >= size) & (F.col("_k") <= size)).alias("feasible"),
    )


def round_robin(df, quotas, class_col, sample_col, id_col, seed) -> DataFrame:
    """One record per sample and round, samples in hashed order, until the quota.

    Rounds are cut where a whole round fits; only the last round of a class is
    ranked, so the sort never covers a hot class.
    """
    r = hash_rank(df, [class_col, sample_col], id_col, seed, "record").withColumnRenamed(
        "rank", "depth"
    )
    per_round = r.groupBy(class_col, "depth").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(class_col).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    )
    rounds = per_round.withColumn("_before", F.coalesce(before, F.lit(0))).join(
        quotas.select(class_col, "quota"), class_col
    )
    rounds = rounds.filter(F.col("_before") < F.col("quota"))
    r = r.join(rounds.select(class_col, "depth", "_n", "_before", "quota"), [class_col, "depth"])
    whole = F.col("_before") + F.col("_n") <= F.col("quota")
    last = r.filter(~whole).withColumn(
        "_s", H.digest(seed, "sample", F.col(class_col), F.col(sample_col))
    )
    # rank the last round by sample hash in 256 buckets
    last = last.withColumn("_b", F.substring("_s", 1, 2))
    sizes = last.groupBy(class_col, "_b").agg(F.count(F.lit(1)).alias("_m"))
    off = F.sum("_m").over(
        Window.partitionBy(class_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.withColumn("_off", F.coalesce(off, F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(class_col, "_b").orderBy("_s", sample_col))
    last = (
        last.join(sizes.select(class_col, "_b", "_off"), [class_col, "_b"])
        .withColumn("_k", F.col("_off") + inside)
        .filter(F.col("_before") + F.col("_k") <= F.col("quota"))
    )
    keep = [class_col, sample_col, id_col, "depth"]
    return r.filter(whole).select(*keep).unionByName(last.select(*keep))


def calibration_pairs(df, id_col, entity_col, target: int, seed, oversample: float = 2.0) -> DataFrame:
    """``target`` distinct pairs from different entities; all pairs if fewer exist.

    Draws are hashed (left rank, right rank) tuples joined to hash-ranked rows,
    so no pair list is formed; only the small-population case enumerates.
    """
    sizes = df.groupBy(entity_col).count()
    n, same, biggest = sizes.agg(
        F.sum("count"),
        F.sum(F.col("count") * (F.col("count") - 1) / 2),
        F.max_by(entity_col, "count"),
    ).first()
    admissible = int(n * (n - 1) // 2 - same)
    spark = df.sparkSession
    ids = hash_rank(df.select(id_col, entity_col).withColumn("_all", F.lit(0)), ["_all"], id_col, seed, "pair")

    def side(k, i, e):
        return ids.select((F.col("rank") - 1).alias(k), F.col(id_col).alias(i), F.col(entity_col).alias(e))

    left, right = side("a", "ia", "ea"), side("b", "ib", "eb")
    def distinct(slots):
        pairs = slots.join(right, "b").filter(F.col("ea") != F.col("eb"))
        return pairs.groupBy(
            F.least("ia", "ib").alias("left_id"), F.greatest("ia", "ib").alias("right_id")
        ).agg(F.min("draw").alias("draw"))

    if admissible <= target:
        # every admissible pair has a member outside the biggest entity, and
        # those members times all rows are at most about twice the pairs
        return distinct(
            left.filter(F.col("ea") != F.lit(biggest)).select(
                "*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"), F.lit(0).alias("draw")
            )
        ).select("left_id", "right_id")
    draws = int(target * oversample / (admissible / (n * n / 2))) + 64
    while True:
        slots = spark.range(draws).select(
            F.col("id").alias("draw"),
            H.draw_index(n, seed, "left", F.col("id")).alias("a"),
            H.draw_index(n, seed, "right", F.col("id")).alias("b"),
        )
        pairs = distinct(slots.join(left, "a"))
        # the first accepted draws win, so drawing more never changes the choice
        if pairs.count() >= target:
            return pairs.orderBy("draw", "left_id", "right_id").limit(target).select("left_id", "right_id")
        draws *= 2


def assign_blocks(row_number: Column, block_size: int) -> tuple[Column, Column]:
    """Surrogate block and index within it from a matrix row number."""
    return (
        F.floor(row_number / block_size).cast("long"),
        F.pmod(row_number, F.lit(block_size)).cast("long"),
    )


def split_leakage(roles: DataFrame, key: str, role: str = "role") -> DataFrame:
    """Keys that occur in more than one role."""
    return (
        roles.groupBy(key)
        .agg(F.sort_array(F.collect_set(role)).alias("roles"))
        .filter(F.size("roles") > 1)
    )


def split_contract(
    items: DataFrame,
    roles: DataFrame,
    keys: list[str],
    id_col: str,
    class_col: str,
    role: str = "role",
    query: str = "query",
    library: str = "library",
) -> DataFrame:
    """Whether the roles of each split (``keys``) are a complete partition whose queries find their class.

    ``items`` (keys, id, class) lists who must have a role, ``roles`` (keys, id,
    role) who got which.  Counts of one union prove the partition: n_unassigned
    items have no role, n_repeated ids have several rows, n_conflicts ids have
    different roles, n_unknown ids are no items.  n_absent_class items in the
    query role have no item of their class in the library role.  A null role is
    no role, null ids are one id and null classes one class.
    """
    class_type = items.schema[class_col].dataType
    own = items.select(*keys, id_col, class_col, F.lit(1).alias("_item"), F.lit(None).cast("string").alias("_role"))
    given = roles.select(
        *keys, id_col, F.lit(None).cast(class_type).alias(class_col), F.lit(0).alias("_item"), F.col(role).alias("_role")
    )
    per_id = own.unionByName(given).groupBy(*keys, id_col).agg(
        F.max("_item").alias("_item"),
        F.max(class_col).alias(class_col),
        F.count("_role").alias("_n"),
        (F.min("_role") != F.max("_role")).alias("_conflict"),
        F.max(F.col("_role") == query).alias("_query"),
        F.max(F.col("_role") == library).alias("_library"),
    )

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    item = F.col("_item") == 1
    per_class = per_id.groupBy(*keys, class_col).agg(
        n(item).alias("n_items"),
        n(item & (F.col("_n") == 0)).alias("n_unassigned"),
        n(F.col("_n") > 1).alias("n_repeated"),
        n(F.col("_conflict")).alias("n_conflicts"),
        n(~item).alias("n_unknown"),
        n(item & F.col("_query")).alias("_queries"),
        n(item & F.col("_library")).alias("_libraries"),
    )
    absent = F.sum(F.when(F.col("_libraries") == 0, F.col("_queries")).otherwise(0))
    counts = ["n_items", "n_unassigned", "n_repeated", "n_conflicts", "n_unknown"]
    out = per_class.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts], absent.alias("n_absent_class"))
    complete = (F.col("n_unassigned") == 0) & (F.col("n_repeated") == 0) & (F.col("n_unknown") == 0)
    return out.withColumn("complete", complete).withColumn("valid", complete & (F.col("n_absent_class") == 0))
