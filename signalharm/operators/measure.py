"""Measure tables: regions, matched peaks, long-form vectors, oriented harm."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.measures import ARROW_BUNDLES, BUNDLES, MEASURES, Pair
from ..functions.peaks import match_peaks


def region_values(axis, y, lo, hi) -> Column:
    """Nodes with lo <= x <= hi as ``array<struct<x, y>>``."""
    return A.lets(
        {"z": F.arrays_zip(axis.alias("x"), y.alias("y")), "lo": lo, "hi": hi},
        lambda s: F.filter(s["z"], lambda p: (p["x"] >= s["lo"]) & (p["x"] <= s["hi"])),
    )


def region_conflicts(df: DataFrame) -> DataFrame:
    """Pairs of touching regions with different roles, one of them the signal.

    ``df.regions`` is ``array<struct<role, lo, hi>>`` per signal.
    """
    pairs = F.flatten(
        F.transform(
            "regions",
            lambda a: F.transform(
                F.filter(
                    "regions",
                    lambda b: (a["role"] < b["role"])
                    & (a["lo"] <= b["hi"])
                    & (b["lo"] <= a["hi"])
                    & ((a["role"] == "signal") | (b["role"] == "signal")),
                ),
                lambda b: F.struct(a["role"].alias("left_role"), b["role"].alias("right_role")),
            ),
        )
    )
    return df.select("signal_id", F.explode(pairs).alias("c")).select("signal_id", "c.*")


def snr(df: DataFrame) -> DataFrame:
    """Three signal-to-noise ratios; null without exactly one region per role,
    with fewer than two noise points, with constant noise, or where the noise or
    reference region touches the signal region."""

    def nodes(role):
        only = F.filter("regions", lambda r: r["role"] == role)
        return A.let(
            only,
            lambda r: F.when(
                F.size(r) == 1,
                region_values(
                    F.col("axis"), F.col("y"), F.get(r, F.lit(0))["lo"], F.get(r, F.lit(0))["hi"]
                ),
            ),
        )

    def ys(c):
        return F.transform(c, lambda p: p["y"])

    def xs(c):
        return F.transform(c, lambda p: p["x"])

    df = df.withColumns({"_s": nodes("signal"), "_n": nodes("noise"), "_r": nodes("reference")})
    df = df.withColumns(
        {
            "_nm": A.mean(ys("_n")),
            "_ns": A.std_pop(ys("_n")),
            "_rm": A.mean(ys("_r")),
            "_rs": A.std_pop(ys("_r")),
            "_w": A.node_widths(xs("_s")),
        }
    )
    def touches(role):
        only = F.filter("regions", lambda r: r["role"] == role)
        return F.exists(
            F.filter("regions", lambda r: r["role"] == "signal"),
            lambda a: F.exists(only, lambda b: (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])),
        )

    ok = (F.size("_n") >= 2) & (F.col("_ns") > 0) & ~touches("noise")
    area = A.dot(F.col("_w"), F.transform(ys("_s"), lambda v: v - F.col("_nm")))
    return df.withColumns(
        {
            "snr_peak": F.when(ok, (F.array_max(ys("_s")) - F.col("_nm")) / F.col("_ns")),
            "snr_area": F.when(
                ok & (F.size("_s") >= 2),
                area / (F.col("_ns") * F.sqrt(A.sum_squares("_w"))),
            ),
            "snr_mean": F.when(
                (F.size("_r") >= 2) & (F.col("_rs") > 0) & ~touches("reference"),
                (A.mean(ys("_s")) - F.col("_rm")) / F.col("_rs"),
            ),
        }
    ).drop("_s", "_n", "_r", "_nm", "_ns", "_rm", "_rs", "_w")


def matched_errors(df: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Mean errors over one-to-one matches of ``ref_peaks`` and ``peaks``.

    A zero reference height makes the relative height error null.
    """

    def errors(m):
        a = F.get(F.col("ref_peaks"), m["l"])
        b = F.get(F.col("peaks"), m["r"])
        return F.struct(
            m["d"].alias("position_error"),
            F.when(a["height"] != 0, F.abs(b["height"] - a["height"]) / F.abs(a["height"])).alias(
                "relative_height_error"
            ),
            F.abs(b["fwhm"] - a["fwhm"]).alias("fwhm_error"),
            F.abs(b["area"] - a["area"]).alias("area_error"),
        )

    df = A.pin(df, {"_m": match_peaks(F.col("ref_peaks"), F.col("peaks"), tolerance)})
    df = A.pin(df, {"_e": F.transform("_m", errors)})
    names = ("position_error", "relative_height_error", "fwhm_error", "area_error")

    def average(name):
        return F.when(F.size("_e") > 0, A.mean(F.transform("_e", lambda e: e[name])))

    return A.pin(df, {n: average(n) for n in names}).drop("_m", "_e")


def _with_bundles(pairs: DataFrame, outputs, p: Pair) -> tuple[DataFrame, dict[str, Column]]:
    """Pairs with the shared expressions of ``outputs``, each once, and the value of every output."""
    names = sorted({MEASURES[o].bundle for o in outputs if MEASURES[o].bundle})
    pinned = A.pin(pairs, {"axis": F.col("axis"), **{f"_b_{n}": BUNDLES[n](p) for n in names if n not in ARROW_BUNDLES}})
    pinned = pinned.withColumns({f"_b_{n}": BUNDLES[n](p) for n in names if n in ARROW_BUNDLES})
    values = {
        o: (m.value(F.col(f"_b_{m.bundle}")) if (m := MEASURES[o]).bundle else m.expression(p)).cast("double") for o in outputs
    }
    return pinned, values


def self_values(signals: DataFrame, outputs, column: str = "base") -> DataFrame:
    """Signals with a map from output to the value of the signal paired with itself."""
    p = Pair(F.col("axis"), F.col("y"), F.col("axis"), F.col("y"))
    pinned, values = _with_bundles(signals, outputs, p)
    own = A.pin(pinned, {column: F.create_map(*[x for o, v in values.items() for x in (F.lit(o), v)])})
    return own.drop(*[c for c in own.columns if c.startswith("_b_")])


def measure_vector(pairs: DataFrame, outputs=None) -> DataFrame:
    """Long form: one row per (pair, output) with value, state and the reason where it is null."""
    outputs = list(MEASURES) if outputs is None else list(outputs)
    p = Pair(F.col("ref_axis"), F.col("ref_y"), F.col("axis"), F.col("y"))
    pinned, values = _with_bundles(pairs, outputs, p)

    def cell(output):
        reason = MEASURES[output].reason(p) if MEASURES[output].reason else F.lit("undefined_for_input")
        return A.let(
            values[output],
            lambda v: F.struct(
                F.lit(output).alias("output_id"), v.alias("value"), F.when(v.isNull(), reason).otherwise("").alias("reason_code")
            ),
        )

    keep = [c for c in pairs.columns if c not in {"ref_axis", "ref_y", "axis", "y"}]
    return (
        pinned.select(*keep, F.explode(F.array(*map(cell, outputs))).alias("_m"))
        .select(*keep, "_m.output_id", "_m.value", "_m.reason_code")
        .withColumn("state", F.when(F.col("value").isNull(), "not_evaluable").otherwise("complete"))
    )


def oriented(output_id, base, current, measures=None) -> Column:
    """Harm with positive = worse; non-monotonic outputs are refused (null)."""
    rules = MEASURES if measures is None else measures

    def rule(m):
        if m.direction == "lower":
            return current - base
        if m.direction == "higher":
            return base - current
        if m.direction == "target":
            return F.abs(current - m.target) - F.abs(base - m.target)
        return F.lit(None).cast("double")

    pairs = [(m.output_id, rule(m)) for m in rules.values()]
    first, rest = pairs[0], pairs[1:]
    return reduce(
        lambda acc, kv: acc.when(output_id == kv[0], kv[1]),
        rest,
        F.when(output_id == first[0], first[1]),
    )


def cluster_harm(long: DataFrame, cluster: str, keys: list[str], weight: str) -> DataFrame:
    """Weighted mean of ``harm`` per (cluster, keys); incomplete cells give null."""
    w = F.col(weight)
    g = long.groupBy(cluster, *keys).agg(
        (F.sum(F.col("harm") * w) / F.sum(w)).alias("harm"),
        F.sum(w).alias("total_weight"),
        F.count(F.lit(1)).alias("n"),
        (F.count("harm") == F.count(F.lit(1))).alias("complete"),
    )
    return g.withColumn("harm", F.when(F.col("complete"), F.col("harm")))


def band_join(left: DataFrame, right: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Positions within ``tolerance`` of each other, inclusive.

    Buckets of the tolerance's width give the equi key; the left side probes
    its own bucket and both neighbours, so a hot signal is spread over buckets.
    """
    bucket = F.floor(F.col("pos") / tolerance)
    a = left.select(
        key, F.col("pos").alias("ref_pos"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b")
    )
    b = right.select(key, F.col("pos").alias("cand_pos"), bucket.alias("_b"))
    distance = F.abs(F.col("cand_pos") - F.col("ref_pos"))
    return a.join(b, [key, "_b"]).filter(distance <= tolerance).drop("_b").withColumn("distance", distance)


TIE_DIGITS = 9


def settled(harms: DataFrame, keys: list[str], column: str = "x", digits: int = TIE_DIGITS) -> DataFrame:
    """Make harms that differ by less than rounding noise equal, whatever their unit.

    Values become multiples of 10 ** -``digits`` times the largest harm of their
    keys, rounded down to a power of ten.  Scaling all signals scales the
    multiples alike, so ranks and ties stay.
    """
    top = harms.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(F.abs(column)).alias("_top"))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    parts = F.pow(F.lit(10.0), digits - F.floor(F.log10("_top")))
    value = F.when(F.col("_top") > 0, F.round(F.col(column) * parts) / parts).otherwise(F.col(column))
    return harms.join(top, same).withColumn(column, value).drop("_top", *(f"_{k}" for k in keys))
