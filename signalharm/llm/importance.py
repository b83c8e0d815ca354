"""Importance resampling towards the distribution of a target corpus.

Texts are bags of hashed word runs.  Bucket counts of the corpus and of the
target give each bucket a gain (its log likelihood ratio in thousandths); a
document's weight is the mean gain of its features, and Gumbel noise from its id
turns the highest scores into a draw without replacement.

Bucket numbers are CRC-32 values.  The distinct features of a batch are grouped
by their length in bytes; each group is a two-dimensional uint8 array whose
columns update the CRCs of all its rows at once.
"""

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalharm.llm.common import map_texts, slices, stored
from signalharm.llm.repeats import spread

BUCKETS = 10_000
#: Longest run of words that is a feature.
MAX_RUN = 2
MIN_WORDS = 20
#: Documents drawn, in hundredths of those with MIN_WORDS words.
PERCENT = 25
SEED = 7
#: A longer text is read in pieces of about this size, each with the last words of the one before.
PIECE_BYTES = 2 << 20
#: Bytes of a CRC matrix at most, or one row.
MATRIX_BYTES = 4 << 20

#: Bytes of words stay, A-Z in lower case; the others part words.
TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

def _crc_table() -> np.ndarray:
    """The byte table of CRC-32: eight shifts of each byte by the reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


CRC_TABLE = _crc_table()


def crc_by_length(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte strings ``data[begin : begin + size]``, in their order."""
    out = np.zeros(len(size), np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, at = np.unique(size[order], return_index=True)
    for n, rows in zip(lengths.tolist(), np.split(order, at[1:])):
        step = max(1, MATRIX_BYTES // max(1, n))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            if len(part) == 1:  # nothing to do side by side
                out[part] = zlib.crc32(data[begin[part[0]] : begin[part[0]] + n].tobytes())
                continue
            crc = np.full(len(part), 0xFFFFFFFF, np.uint32)
            for column in np.ascontiguousarray(data[begin[part][:, None] + np.arange(n)].T):
                crc = CRC_TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
            out[part] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _joined(words: pa.Array, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data, begin, size of runs of words (rows of word numbers), joined by spaces."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    body = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    length = np.diff(offsets)
    size = length[runs].sum(axis=1) + runs.shape[1] - 1
    begin = np.cumsum(size) - size
    data = np.full(int(size.sum()), 32, np.uint8)
    at = begin.copy()
    for word in runs.T:
        n = length[word]
        data[spread(at, n)] = body[spread(offsets[:-1][word], n)]
        at += n + 1
    return data, begin, size


def runs_of(words: list[bytes], counts: list[int], max_run: int, buckets: int, skip: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, buckets) of all runs of 1 to ``max_run`` words of texts with so many words each.

    Runs that end within the first ``skip`` words are left out.
    """
    coded = pa.compute.dictionary_encode(pa.array(words, pa.large_binary()))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    number, runs = codes, np.arange(len(coded.dictionary))[:, None]
    for k in range(1, max_run + 1):
        at = np.flatnonzero(text[: len(text) - k + 1] == text[k - 1 :]) if len(text) >= k else np.zeros(0, np.int64)
        if k > 1:  # a run is a shorter run and one more word of its text
            _, first, found = np.unique(number[at] * len(coded.dictionary) + codes[at + k - 1], return_index=True, return_inverse=True)
            runs, number = codes[at[first][:, None] + np.arange(k)], np.zeros(max(0, len(text) - k + 1), np.int64)
            number[at] = found
        bucket = (crc_by_length(*_joined(coded.dictionary, runs)) % np.uint32(buckets)).astype(np.int64)
        at = at[at + k > skip]
        yield text[at], bucket[number[at]]


def pieces(texts: list[bytes], max_run: int) -> Iterator[tuple[int, list[bytes], list[int], int]]:
    """(number of the first text, words, words per text, words to skip): short texts together, a long one in pieces."""
    first, words, counts, held = 0, [], [], 0
    for i, t in enumerate(texts):
        t = t.translate(TO_WORDS)
        if len(t) <= PIECE_BYTES:
            own = t.split()
            words += own
            counts.append(len(own))
            held += len(t)
        if held > PIECE_BYTES or len(t) > PIECE_BYTES or i + 1 == len(texts):
            if counts:
                yield first, words, counts, 0
            first, words, counts, held = i + 1, [], [], 0
        if len(t) > PIECE_BYTES:
            tail, at = [], 0
            while at < len(t):
                end = t.find(b" ", at + PIECE_BYTES)
                end = len(t) if end < 0 else end
                own = tail + t[at:end].split()
                yield i, own, [len(own)], len(tail)
                tail, at = own[len(own) - min(len(own), max_run - 1) :], end


def bucket_counts(docs: DataFrame, text_col: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                for _, words, counts, skip in pieces(texts, max_run):
                    for _, bucket in runs_of(words, counts, max_run, buckets, skip):
                        total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": total[at]})

    own = docs.select(F.col(text_col).cast("string").alias("text"))
    found = own.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():  # one row a bucket
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of each bucket, smoothed by one, in whole thousandths."""
    m = float(len(corpus))
    ratio = (target + 1.0) * (corpus.sum() + m) / ((corpus + 1.0) * (target.sum() + m))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """One row per input row: doc_id, n_words, n_features, weight (the floored mean gain; 0 without features)."""

    def make():
        def step(part: pa.RecordBatch) -> dict:
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            n_words, n, total = (np.zeros(len(texts), np.int64) for _ in range(3))
            for first, words, counts, skip in pieces(texts, max_run):
                at = slice(first, first + len(counts))
                n_words[at] += np.array(counts) - skip
                for text, bucket in runs_of(words, counts, max_run, len(gains), skip):
                    n[at] += np.bincount(text, minlength=len(counts))
                    total[at] += np.bincount(text, weights=gains[bucket], minlength=len(counts)).astype(np.int64)
            return {"n_words": n_words, "n_features": n, "weight": total // np.maximum(n, 1)}

        return step

    return map_texts(docs, id_col, text_col, {"n_words": "long", "n_features": "long", "weight": "long"}, make)


def ranked(rows: DataFrame, *order: F.Column) -> DataFrame:
    """``rows`` with ``rank``, 1, 2, 3... in this order; equal rows by their place in the stored table.

    Rows are dealt by ranges, which a key of any size can be cut into by the
    place, and numbered in each; a range's base is the size of those before.
    """
    rows = stored(rows.withColumn("__place", F.monotonically_increasing_id()), "to-rank")
    dealt = rows.repartitionByRange(*order, "__place").sortWithinPartitions(*order, "__place")

    def numbered(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            more = [pa.array(np.full(len(batch), part, np.int32)), pa.array(np.arange(n + 1, n + 1 + len(batch)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "__range", "__number"])
            n += len(batch)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = stored(dealt.mapInArrow(numbered, ddl + ", __range int, __number long"), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"))  # a row for each range
    bases = sizes.select(F.col("__range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    out = dealt.join(F.broadcast(bases), "__range").withColumn("rank", F.col("__base") + F.col("__number"))
    return out.drop("__place", "__range", "__number", "__base")


def draw(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    max_run: int = MAX_RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (null if not drawn).

    Words are lower-cased in A-Z only.  Null and empty texts have no features and
    the weight 0.  Texts of any length are read in pieces, whole.  A null id is
    hashed as an empty one and ranked after others of its score.  Repeated rows
    are scored each; rows of one id and score are ranked in any order.  An empty
    target or table is a corpus without features.  Other columns are not read.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, max_run, buckets), bucket_counts(target, target_col, max_run, buckets))
    own = weights(docs, gains, id_col, text_col, max_run)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(key, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    own = stored(own.withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= min_words
    drawn = percent * own.where(fit).count() // 100
    out = ranked(own.where(fit), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = own.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
