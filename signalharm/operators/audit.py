"""Audits: coverage gates, violations, duplicates, axis relations, leakage, diffs."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .checkpoints import ensure_checkpoint_dir
from .splits import leakage_components


def effect_violations(cells: DataFrame) -> DataFrame:
    """Per condition: broken contracts, bad axes and effects that do not grow."""
    w = Window.partitionBy("signal_id", "perturbation_id").orderBy("alpha")
    grows = F.coalesce(F.col("effect") > F.lag("effect").over(w), F.lit(True))
    return (
        cells.withColumn("grows", grows)
        .groupBy("perturbation_id", "alpha")
        .agg(
            F.count(F.lit(1)).alias("n_cells"),
            F.count_if(~F.col("contract_holds")).alias("n_contract"),
            F.count_if(~F.col("axis_increasing")).alias("n_axis"),
            F.count_if(~F.col("grows")).alias("n_not_monotone"),
        )
    )


def coverage(
    sources: DataFrame,
    done: DataFrame,
    perturbations,
    n_strengths: int,
    source_gate: float = 0.95,
    cluster_gate: float = 0.90,
) -> DataFrame:
    """Complete sources and clusters per perturbation against the gates.

    A cluster counts only when every one of its sources is complete.
    """
    counts = done.groupBy("signal_id", "perturbation_id").agg(
        F.count_distinct("alpha").alias("n_done"), F.count(F.lit(1)).alias("n_rows")
    )
    planned = sources.select(
        "*", F.explode(F.array(*[F.lit(p) for p in perturbations])).alias("perturbation_id")
    )
    cells = planned.join(counts, ["signal_id", "perturbation_id"], "left").fillna(
        0, ["n_done", "n_rows"]
    )
    ok = F.col("n_done") == n_strengths
    clusters = cells.groupBy("perturbation_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_ok"),
        F.sum(F.lit(n_strengths) - F.col("n_done")).alias("missing"),
        F.sum(F.col("n_rows") - F.col("n_done")).alias("duplicates"),
    )
    full = F.count_if(F.col("n") == F.col("n_ok"))
    out = clusters.groupBy("perturbation_id").agg(
        F.sum("n").alias("n_sources"),
        F.sum("n_ok").alias("n_complete_sources"),
        full.alias("n_complete_clusters"),
        F.count(F.lit(1)).alias("n_clusters"),
        F.sum("missing").alias("n_missing_cells"),
        F.sum("duplicates").alias("n_duplicate_cells"),
    )
    return out.withColumn(
        "passes",
        (F.col("n_complete_sources") / F.col("n_sources") >= source_gate)
        & (F.col("n_complete_clusters") / F.col("n_clusters") >= cluster_gate)
        & (F.col("n_duplicate_cells") == 0),
    )


def content_digest(axis, y) -> Column:
    """Identity of a signal's content."""
    text = F.concat_ws(
        "#",
        F.array_join(F.transform(axis, lambda v: v.cast("string")), ","),
        F.array_join(F.transform(y, lambda v: v.cast("string")), ","),
    )
    return F.sha2(text, 256)


def axis_relation(raw, processed) -> Column:
    """Relation of two axes with the matching slice bounds (0-based, end exclusive)."""

    def start(container, part):
        """Offset of ``part`` inside ``container``; null when not contiguous."""
        return A.lets(
            {"c": container, "p": part},
            lambda s: A.let(
                F.array_position(s["c"], F.get(s["p"], F.lit(0))).cast("int"),
                lambda k: F.when(
                    (k > 0) & (F.slice(s["c"], F.greatest(k, F.lit(1)), F.size(s["p"])) == s["p"]), k - 1
                ),
            ),
        )

    def run(s):
        def row(name, raw_start, raw_len, proc_start, proc_len):
            return F.struct(
                F.lit(name).alias("relation"),
                raw_start.cast("int").alias("raw_start"),
                (raw_start + raw_len).cast("int").alias("raw_end"),
                proc_start.cast("int").alias("processed_start"),
                (proc_start + proc_len).cast("int").alias("processed_end"),
            )

        zero, none = F.lit(0), F.lit(None).cast("int")
        nr, np_ = F.size(s["r"]), F.size(s["p"])
        apart = (F.array_max(s["r"]) < F.array_min(s["p"])) | (
            F.array_max(s["p"]) < F.array_min(s["r"])
        )
        return (
            F.when(s["r"] == s["p"], row("exact_equal", zero, nr, zero, np_))
            .when(
                s["pin"].isNotNull(),
                row("processed_exact_contiguous_subset_of_raw", s["pin"], np_, zero, np_),
            )
            .when(
                s["rin"].isNotNull(),
                row("raw_exact_contiguous_subset_of_processed", zero, nr, s["rin"], nr),
            )
            .when(apart, row("no_axis_overlap", none, none, none, none))
            .otherwise(row("overlap_requires_alignment", none, none, none, none))
        )

    return A.lets(
        {"r": raw, "p": processed, "pin": start(raw, processed), "rin": start(processed, raw)}, run
    )


def exact_duplicate_pairs(df: DataFrame, digest: str, role: str, left: str, right: str) -> DataFrame:
    """Cross-role pairs per digest, counted as a product: pairs are never formed.

    A digest that holds a third of all rows is two partial counts.
    """
    n = df.groupBy(digest).agg(
        F.count_if(F.col(role) == left).alias("n_left"),
        F.count_if(F.col(role) == right).alias("n_right"),
    )
    return n.filter((F.col("n_left") > 0) & (F.col("n_right") > 0)).withColumn(
        "n_pairs", F.col("n_left") * F.col("n_right")
    )


def pair_status(df: DataFrame, key: str) -> DataFrame:
    """Raw/processed pairing per measurement key.

    ``df`` has ``kind`` in {raw, processed} and boolean ``accepted``.
    """

    def n(kind, accepted=False):
        c = F.col("kind") == kind
        return F.count_if(c & F.col("accepted") if accepted else c)

    g = df.groupBy(key).agg(
        n("raw").alias("sr"),
        n("processed").alias("sp"),
        n("raw", True).alias("ar"),
        n("processed", True).alias("ap"),
    )
    many = (F.col("sr") > 1) | (F.col("sp") > 1)
    return g.withColumn(
        "pair_status",
        F.when((F.col("ar") == 0) & (F.col("ap") == 0), "rejected_only")
        .when(many, "ambiguous")
        .when((F.col("ar") == 1) & (F.col("ap") == 1), "paired_unique")
        .when(F.col("ar") == 1, "raw_only")
        .otherwise("processed_only"),
    ).select(key, "pair_status")


def reproduce(left: DataFrame, right: DataFrame, keys, fields, tolerance: float = 1e-9) -> DataFrame:
    """Published against recomputed: state per key and the mismatching fields."""
    a = left.select(*keys, *[F.col(f).alias(f"l_{f}") for f in fields], F.lit(True).alias("_l"))
    b = right.select(*keys, *[F.col(f).alias(f"r_{f}") for f in fields], F.lit(True).alias("_r"))
    j = a.join(b, keys, "full_outer")
    differs = [
        F.when(
            ~(
                F.coalesce(F.abs(F.col(f"l_{f}") - F.col(f"r_{f}")) <= tolerance, F.lit(False))
                | (F.col(f"l_{f}").isNull() & F.col(f"r_{f}").isNull())
            ),
            F.lit(f),
        )
        for f in fields
    ]
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    mismatch = F.when(both, F.array_compact(F.array(*differs))).otherwise(
        F.array().cast("array<string>")
    )
    return j.select(
        *keys,
        mismatch.alias("mismatches"),
        F.when(F.col("_l").isNull(), "missing_left")
        .when(F.col("_r").isNull(), "missing_right")
        .when(F.size(mismatch) == 0, "match")
        .otherwise("mismatch")
        .alias("state"),
    )


def signal_states(df: DataFrame, id_col: str = "signal_id", y: str = "y") -> DataFrame:
    """id, state: ``comparable``, or why a signal has no standardised form.

    ``empty`` (null or no values), ``not_finite`` (a null, NaN or infinite value)
    or ``constant`` (its SNV has no scale).
    """
    return df.select(id_col, _state(F.col(y)).alias("state"))


def _state(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(v.isNull() | (F.size(v) == 0), "empty")
        .when(~finite, "not_finite")
        .when(F.array_min(v) == F.array_max(v), "constant")
        .otherwise("comparable")
    )


def _near_cells(reps: DataFrame, threshold: float, segments: int) -> DataFrame:
    """rep, n, c: the cell of every representative by its segment means, without the vector."""

    def cell(k):
        size = F.greatest(F.floor(F.col("n") / segments), F.lit(1)).cast("int")  # short vectors have fewer segments
        width = F.lit(threshold) * F.sqrt(F.col("n") / size) + 1e-12
        return F.coalesce(F.floor(A.mean(F.slice("v", F.lit(k) * size + 1, size)) / width).cast("long"), F.lit(0))

    return A.pin(reps.select("rep", "n", "v"), {"c": F.array(*[cell(k) for k in range(segments)])}).drop("v")


def near_candidates(reps: DataFrame, threshold: float, segments: int = 4) -> DataFrame:
    """left_id, right_id (left < right) of neighbouring cells: the exchange holds ids and cells alone.

    Of two neighbouring cells that differ, one probes the other: a cell looks at
    itself and at the half of its neighbours that come after it in the order of
    cells, so 1 + (3^segments - 1) / 2 probes find what 3^segments would.
    """
    cells = _near_cells(reps, threshold, segments)
    steps = [()]
    for _ in range(segments):
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    ahead = [s for s in steps if s >= (0,) * segments]
    probe = F.explode(F.array(*[F.array(*[F.get("c", F.lit(k)) + d for k, d in enumerate(s)]) for s in ahead]))
    left = cells.select(F.col("rep").alias("a"), F.col("c").alias("home"), "n", probe.alias("c"))
    right = cells.select(F.col("rep").alias("b"), "n", "c")
    met = left.join(right, ["n", "c"]).filter((F.col("home") != F.col("c")) | (F.col("a") < F.col("b")))
    return met.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


def near_duplicates(
    df: DataFrame, id_col: str = "signal_id", threshold: float = 1e-3, y: str = "y", segments: int = 4
) -> DataFrame:
    """Pairs whose SNV vectors differ by at most ``threshold`` in root mean square.

    Exact blocking: if rms(a - b) <= t, the mean over any segment of length L
    differs by at most t*sqrt(n/L).  Each segment mean becomes a cell of that
    width and neighbours differ by at most one cell per segment.  Identical
    vectors collapse to one representative with a multiplicity first, so a
    group of copies is one probe set.  Two phases: cells give candidate pairs of
    ids, then the vectors of the candidates alone are fetched and compared.  The
    result is whole in that form: one row per pair of distinct vectors with the
    copies on both sides and the number of record pairs, and one row per group
    of copies (left = right).  Signals without a standardised form take no part;
    ``signal_states`` names them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    usable = df.where(_state(F.col(y)) == "comparable").select(id_col, F.size(y).alias("n"), F.col(y).alias("_y"))
    snv = A.pin(usable, {"v": A.snv(F.col("_y"))}).filter(F.col("v").isNotNull()).drop("_y")
    reps = snv.groupBy("v", "n").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("m")).checkpoint()
    sides = [reps.select(F.col("rep").alias(f"{s}_id"), F.col("v").alias(s), F.col("m").alias(f"{s}_copies")) for s in ("left", "right")]
    distance = A.rms(F.zip_with("left", "right", lambda a, b: a - b))
    near = (
        near_candidates(reps, threshold, segments)
        .join(sides[0], "left_id")
        .join(sides[1], "right_id")
        .withColumn("distance", distance)
        .filter(F.col("distance") <= threshold)
        .withColumn("n_pairs", F.col("left_copies") * F.col("right_copies"))
    )
    names = ["left_id", "right_id", "left_copies", "right_copies", "n_pairs", "distance"]
    m = F.col("m")
    copies = reps.filter(m > 1).select(
        F.col("rep").alias("left_id"),
        F.col("rep").alias("right_id"),
        m.alias("left_copies"),
        m.alias("right_copies"),
        F.expr("m * (m - 1) div 2").alias("n_pairs"),
        F.lit(0.0).alias("distance"),
    )
    return near.select(*names).unionByName(copies)


def near_duplicate_groups(
    df: DataFrame, id_col: str = "signal_id", threshold: float = 1e-3, y: str = "y", segments: int = 4
) -> DataFrame:
    """component, n_signals, n_vectors, n_links: near duplicates united, without a list of record pairs.

    A component is the smallest id that links of distinct vectors or copies
    reach; ``n_links`` counts pairs of records at most ``threshold`` apart.
    Signals without a near duplicate are no component.
    """
    pairs = near_duplicates(df, id_col, threshold, y, segments).checkpoint()
    left, m = F.col("left_id").alias("hub"), F.col("right_copies").alias("m")
    members = pairs.select(F.col("left_id").alias("id"), F.col("left_copies").alias("m"), left)
    members = members.union(pairs.select("right_id", m, left))  # all that meet one left id are linked
    labels = leakage_components(members, "id", "hub").withColumnRenamed("component_id", "component")
    vectors = members.select("id", "m").distinct().join(labels, "id")
    sizes = vectors.groupBy("component").agg(F.sum("m").alias("n_signals"), F.count(F.lit(1)).alias("n_vectors"))
    links = pairs.join(labels, F.col("left_id") == F.col("id")).groupBy("component").agg(F.sum("n_pairs").alias("n_links"))
    return sizes.join(links, "component")


def dataset_diff(source: DataFrame, target: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Missing, extra and mismatching rows of a stored copy, one row.

    ``fields`` maps an output name to the null-safe mismatch condition over
    columns prefixed ``s_`` and ``t_``.
    """
    s = source.select(key, *[F.col(c).alias(f"s_{c}") for c in source.columns if c != key])
    t = target.select(key, *[F.col(c).alias(f"t_{c}") for c in target.columns if c != key])
    j = s.withColumn("_s", F.lit(True)).join(t.withColumn("_t", F.lit(True)), key, "full_outer")
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    return j.agg(
        F.count_if(F.col("_t").isNull()).alias("n_missing"),
        F.count_if(F.col("_s").isNull()).alias("n_extra"),
        *[F.count_if(both & c).alias(name) for name, c in fields.items()],
    )


def union_all(frames) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def attach_downstream(metric_harm: DataFrame, downstream: DataFrame) -> DataFrame:
    """Join metric harm to task harm and report holes per metric.

    ``downstream`` carries one copy of y per metric; copies must agree, so the
    table collapses to one row per cell with a minimum equal to its maximum.
    """
    cell = ["cluster_id", "perturbation_id", "alpha"]
    y = downstream.groupBy(*cell).agg(F.min("y").alias("y"), F.max("y").alias("_y"))
    y = y.withColumn("y", F.when(F.col("y") == F.col("_y"), F.col("y"))).drop("_y")
    expected = y.agg(F.count(F.lit(1)).alias("_n"))
    per = (
        metric_harm.join(y, cell)
        .groupBy("metric")
        .agg(F.count(F.lit(1)).alias("n_joined"), F.sum(F.col("x") * F.col("y")).alias("cross_sum"))
    )
    return per.join(F.broadcast(expected), F.lit(True)).withColumn(  # one-row side
        "n_holes", F.col("_n") - F.col("n_joined")
    ).drop("_n")


def metric_states(obs: DataFrame, grid: DataFrame, planned) -> DataFrame:
    """Planned against complete cells per output."""
    slots = grid.agg(F.count(F.lit(1)).alias("n_planned")).select(
        "n_planned", F.explode(F.array(*[F.lit(m) for m in planned])).alias("metric")
    )
    done = obs.groupBy("metric").agg(F.count("x").alias("n_complete"))
    out = slots.join(done, "metric", "left").fillna(0, ["n_complete"])
    return out.withColumn(
        "state", F.when(F.col("n_planned") == F.col("n_complete"), "complete").otherwise("not_evaluable")
    )


def paired_observations(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Completeness and equality of two observation tables on the same cells."""
    cell = [*keys, "cluster_id", "perturbation_id", "alpha"]
    a = left.select(*cell, F.col("x").alias("lx"), F.col("y").alias("ly"), F.lit(1).alias("_l"))
    b = right.select(*cell, F.col("x").alias("rx"), F.col("y").alias("ry"), F.lit(1).alias("_r"))
    j = a.join(b, cell, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.groupBy(*keys).agg(
        F.count_if(both).alias("n_paired"),
        F.count_if(F.col("_r").isNull()).alias("n_left_only"),
        F.count_if(F.col("_l").isNull()).alias("n_right_only"),
        F.count_if(both & (F.col("lx") == F.col("rx"))).alias("n_equal_x"),
        F.count_if(both & (F.col("ly") == F.col("ry"))).alias("n_equal_y"),
    )


def set_digest(df: DataFrame, keys: list[str], id_col: str, digest: str) -> DataFrame:
    """Counts, distinct contents and an identity of the id set per key.

    The identity is the count and two sums of hash parts: commutative, so it
    combines map-side and never gathers the ids of a key.
    """
    contents = df.groupBy(*keys, digest).agg(F.count(F.lit(1)).alias("_n"))
    counts = contents.groupBy(*keys).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("n_distinct")
    )
    h = F.md5(F.col(id_col).cast("string"))

    def part(start):
        return F.sum(F.conv(F.substring(h, start, 13), 16, 10).cast("decimal(20,0)"))

    ids = df.groupBy(*keys).agg(
        F.sha2(F.concat_ws("|", F.count(F.lit(1)), part(1), part(14)), 256).alias("id_set")
    )
    return counts.join(ids, keys)
