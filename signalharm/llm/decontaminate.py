"""Benchmark decontamination by winnowing, with DataFrame functions alone.

Both sides keep the smallest hash of ``GRAM``-word grams in every window of
``words - GRAM + 1`` grams.  Equal spans of ``words`` words have equal grams,
hence the same smallest hash: a join of these fingerprints meets every document
that shares a span.  Hits are then extended: the windows of those documents are
compared word by word with the items' windows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalharm.functions.arrays import pin
from signalharm.llm.common import small, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GRAM = 4
WINDOW = 13
#: Broadcast a fingerprint or window table up to this many rows (at most about 20 MB); join by shuffle beyond.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _hash2(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _least2(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _marked(name: str, length: int) -> Column:
    return F.transform(name, lambda x: F.xxhash64(x, F.lit(length)))


def _pairs(name: str, apart: int, f) -> Column:
    """``f`` of each element and the one ``apart`` after it."""
    n = F.greatest(F.size(name) - apart, F.lit(0))
    return F.zip_with(F.slice(name, 1, n), F.slice(name, 1 + apart, n), f)


def _spanning(df: DataFrame, name: str, source: str, length: int, f) -> DataFrame:
    """Add ``name``: f over every run of ``length`` elements of ``source``, in log2(length) passes.

    Runs overlap, so ``f`` may meet elements twice; that suits minima and hashes.
    """
    df, covered = pin(df, {name: F.col(source)}), 1
    while covered < length:
        step = min(covered, length - covered)
        df = pin(df, {name: _pairs(name, step, f)})
        covered += step
    return df


def fingerprints(df: DataFrame, window: int, short: list[int]) -> DataFrame:
    """``df`` (with ``words``) with ``prints``: winnowed hashes, and those of all grams of the short lengths."""
    out = pin(df, {"h": F.transform("words", lambda w: F.xxhash64(w))})
    out = _spanning(out, "grams", "h", min(GRAM, window), _hash2)
    out = _spanning(out, "mins", "grams", window - min(GRAM, window) + 1, _least2)
    parts = [F.col("mins")]
    for n in short:
        out = _spanning(out, f"short{n}", "h", n, _hash2)
        parts.append(_marked(f"short{n}", n))
    kept = [c for c in out.columns if c not in ("h", "grams", "mins", *(f"short{n}" for n in short))]
    return out.select(*kept, F.array_distinct(F.concat(*parts)).alias("prints"))


def _windows(length: int) -> Column:
    n = F.size("words") - length + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        at,
        lambda i: F.struct(
            (i - 1).alias("at"), F.lit(length).alias("length"), F.concat_ws(" ", F.slice("words", i, length)).alias("window")
        ),
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share: int = 20,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input document: words, words inside shared windows, items that share one.

    ``contaminated``: at least one hit word and ``share`` * n_hit >= n_words.  An
    item of fewer words than a window is one window; one of none, or null, has
    no window.  Null documents have no words.  Repeated documents get a row
    each; items of one text each count.  Null ids are kept; null item ids count
    as the text "null".  Other columns are not read.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))  # tells texts of one id apart
    items = pin(
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("t")),
        {"words": words_of(F.col("t").cast("string"))},
    )
    items = stored(items.where(F.size("words") > 0).select("item", "words"), "items")
    lengths = [r[0] for r in items.where(F.size("words") < window).select(F.size("words").alias("n")).distinct().collect()]
    short = sorted(lengths)  # fewer than `window` values

    long_items = items.where(F.size("words") >= window)
    prints = fingerprints(long_items, window, []).select(F.explode("prints").alias("print"))
    for n in short:
        own = fingerprints(items.where(F.size("words") == n), window, [n])
        prints = prints.union(own.select(F.explode("prints").alias("print")))
    prints = stored(prints.distinct(), "fingerprints")

    dealt = fingerprints(pin(texts, {"words": words_of(F.col("text"))}).drop("text"), window, short)
    met = dealt.select("doc_id", "text_hash", F.explode("prints").alias("print"))
    met = met.join(small(prints, broadcast_rows), "print", "left_semi").select("doc_id", "text_hash").distinct()
    met = stored(met, "candidates")

    every = [window, *short]
    one_window = F.size("words").cast("int")
    own = items.withColumn("length", F.least(one_window, F.lit(window)))
    own = own.select("item", F.explode(F.concat(*[F.when(F.col("length") == n, _windows(n)).otherwise(F.array()) for n in every])).alias("w"))
    own = own.groupBy("w.length", "w.window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    own = stored(own, "windows")

    again = small(met, broadcast_rows).withColumnsRenamed({"doc_id": "met_id", "text_hash": "met_hash"})
    hit = texts.join(again, F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("text_hash") == F.col("met_hash")), "left_semi")
    hit = pin(hit.distinct(), {"words": words_of(F.col("text"))}).drop("text")
    hit = hit.select("doc_id", "text_hash", F.inline(F.concat(*[_windows(n) for n in every])))
    hit = hit.join(small(own, broadcast_rows), ["length", "window"])
    hit = hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("at", "length")).alias("spans"), F.collect_set("items").alias("items"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    hit = hit.select(
        F.col("doc_id").alias("hit_id"),
        F.col("text_hash").alias("hit_hash"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )

    rows = texts.select("doc_id", "text_hash", F.regexp_count("text", F.lit(CASED_WORD)).cast("long").alias("n_words"))
    out = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )
