"""Token ids as files: one zstandard frame per document, one dictionary for all.

A shard row holds the frames of neighbouring documents (ascending id), their
offsets and the SHA-256 of the dictionary, which lies beside the shards.  A
short document is read by decoding its own frame.  The container is Parquet, so
Spark's commit protocol decides which task's files count.
"""

import hashlib
import json
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from signalharm.llm.common import discard, map_texts, noted_paths, release_memory, slices, stored

SHARD_BYTES = 1 << 20
SHARD_DOCS = 4096
DICT_BYTES = 64 << 10
#: The dictionary is trained on this many documents at most, on the first ids of each.
SAMPLE_DOCS = 2000
SAMPLE_IDS = 4096
END_ID = 0
#: Bytes of pre-tokens and ids that a worker remembers before it starts anew, about, and the longest chunk it remembers.
CACHE_BYTES, CACHED_CHARS = 96 << 20, 64
#: A space after a non-space character always begins a new pre-token.
SPACED = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")
#: The byte-level pre-tokenizer on characters whose classes are beyond doubt.
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\x20-\x7e\n{LATIN}]*")
ONE_WORD = re.compile(rf" ?[{LATIN}]+")
PRE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^ \n0-9{LATIN}]+|[ \n]+(?![^ \n])|[ \n]+")
#: The same on many plain chunks at once, which SEP ends.
SEP = "\x00"
PRE_MANY = re.compile(rf"{SEP}|'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^ \n0-9{LATIN}{SEP}]+|[ \n]+(?![^ \n{SEP}])|[ \n]+")


class Encoder:
    """Ids as the tokenizer gives them; pre-tokens are encoded once while cached, chunks between spaces put together from them.

    The byte-level pre-tokenizer never joins a non-space character with a space
    after it and looks only to the right, so the chunks' ids put together are
    the text's ids.  Other kinds of tokenizer encode whole texts.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        spec = json.loads(self.model.to_str())
        pre = spec["pre_tokenizer"] or {}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = (
            pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not (spec["normalizer"] or spec["truncation"] or spec["padding"])
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])
            and all(len(PRE.findall(s)) > 1 for s in self.special)
        )
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in printable)
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.letters_many = self.letters | {ord(SEP): SEP}
        self.bpe = self.model.model.tokenize
        self.cache: dict[str, bytes] = {}
        self.held, self.cache_bytes = 0, cache_bytes

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if not self.split:
            return [np.array(e.ids, "<u4") for e in self.model.encode_batch(texts, add_special_tokens=False)]
        if self.held > self.cache_bytes:
            self.cache, self.held = {}, 0
        plain = [i for i, t in enumerate(texts) if t and not (t[0].isspace() or SPACED.search(t))]
        out = dict(zip(plain, self._spaced([texts[i] for i in plain])))
        return [out[i] if i in out else np.frombuffer(b"".join(map(self._chunk, CUT.split(t))), "<u4") for i, t in enumerate(texts)]

    def _spaced(self, texts: list[str]) -> list[np.ndarray]:
        """Texts whose spaces all begin chunks: one lookup per distinct chunk of the slice."""
        if not texts:
            return []
        split = pa.compute.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = pa.compute.dictionary_encode(split.values)
        first = split.offsets.to_numpy()[:-1]
        # through numpy: ``to_pylist`` makes a scalar an element
        words, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy()
        heads = split.values.take(pa.array(first)).to_pylist()  # a text's first chunk has no space before it
        codes[first] = np.arange(len(words), len(words) + len(heads))
        chunks = [*map(" ".__add__, words), *heads]
        known = list(map(self.cache.get, chunks))
        new = [i for i, x in enumerate(known) if x is None]
        learnt = self._many([chunks[i] for i in new])
        for i in new:
            known[i] = learnt[c] if (c := chunks[i]) in learnt else self._chunk(c)
        flat = np.frombuffer(b"".join(known), "<u4")
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin, n = (np.cumsum(size) - size)[codes], size[codes]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(begin - ends + n, n)]
        return np.split(ids, (ends - n)[first[1:]])

    def _many(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of the plain chunks among these: one search for all, one call of the model a pre-token that is not remembered."""
        plain = [c for c in chunks if len(c) <= CACHED_CHARS and PLAIN.fullmatch(c)]
        whole = "".join([c + SEP for c in plain])
        if any(s in whole for s in self.special):
            plain = [c for c in plain if not any(s in c for s in self.special)]
            whole = "".join([c + SEP for c in plain])
        parts = PRE_MANY.findall(whole)
        self.cache[SEP] = b""
        fresh = [p for p in dict.fromkeys(parts) if p not in self.cache]
        mapped = SEP.join(fresh).encode().decode("latin-1").translate(self.letters_many).split(SEP) if fresh else []
        self._remember({p: array("I", [t.id for t in self.bpe(m)]).tobytes() for p, m in zip(fresh, mapped)})
        ids = list(map(self.cache.__getitem__, parts))
        del self.cache[SEP]  # as a chunk it is an ordinary character
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        ends = ends[np.fromiter(map(SEP.__eq__, parts), bool, len(parts))].tolist()
        flat = b"".join(ids)
        return {c: flat[i:j] for c, i, j in zip(plain, [0, *ends], ends)}

    def _remember(self, known: dict[str, bytes]) -> None:
        self.cache.update(known)
        # with the entry and the two objects
        self.held += 190 * len(known) + sum(map(len, known)) + sum(map(len, known.values()))

    def _chunk(self, chunk: str) -> bytes:
        ids = self.cache.get(chunk)
        if ids is None:
            # most chunks are one word: one pre-token
            parts = (chunk,) if ONE_WORD.fullmatch(chunk) else PRE.findall(chunk) if PLAIN.fullmatch(chunk) else ()
            if len(parts) != 1 and any(s in chunk for s in self.special) or not parts:
                ids = array("I", self.model.encode(chunk, add_special_tokens=False).ids).tobytes()
            elif len(parts) > 1:
                ids = b"".join(map(self._chunk, parts))
            else:
                mapped = (
                    chunk.replace(" ", self.letters[32]).replace("\n", self.letters[10])
                    if chunk.isascii()
                    else chunk.encode().decode("latin-1").translate(self.letters)
                )
                ids = array("I", [t.id for t in self.bpe(mapped)]).tobytes()
            if len(chunk) <= CACHED_CHARS:
                self._remember({chunk: ids})
        return ids


@lru_cache(maxsize=1)
def encoder(path: str, cache_bytes: int) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, cache_bytes)


def with_end(ids: np.ndarray) -> bytes:
    """Little-endian unsigned 32-bit ids with the end id."""
    return ids.tobytes() + np.array([END_ID], dtype="<u4").tobytes()


def train_dictionary(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = CACHE_BYTES
) -> bytes:
    """A dictionary from a bounded sample: at most SAMPLE_DOCS documents, SAMPLE_IDS ids of each."""
    import zstandard

    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    n = own.count()
    if n == 0:
        return b""
    share = min(1.0, SAMPLE_DOCS / n)
    sample = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def run(batches):
        encode = encoder(tokenizer, cache_bytes)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_pydict({"ids": [with_end(x[:SAMPLE_IDS]) for x in ids]})
        release_memory()

    samples = [bytes(r.ids) for r in sample.mapInArrow(run, "ids binary").limit(SAMPLE_DOCS + SAMPLE_DOCS // 2).collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their ids are the dictionary
        return b"".join(samples)[:DICT_BYTES]


SHARDS = (
    "part int, seq int, first_id {id}, last_id {id}, before long, ids array<{id}>, offsets array<long>,"
    " counts array<long>, dict_sha256 string, frames binary"
)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    partitions: int | None = None,
    cache_bytes: int = CACHE_BYTES,
) -> None:
    """Encode every text, append the end id and write shards in ascending id order below ``path``.

    The frames are made where the texts lie and stored; only frames are
    exchanged.  Null texts are empty: the end id alone.  Null ids come first.
    Rows with one id are in the order of the CRC-32 of their ids, which also
    parts them: a hot id is spread over tasks.  A text of any length is one
    frame.  A worker remembers about ``cache_bytes`` of chunks: fewer cost time,
    more memory.  An empty table writes an empty file.
    """
    import zstandard

    spark = docs.sparkSession
    words = train_dictionary(docs, tokenizer, id_col, text_col, cache_bytes)
    sha = hashlib.sha256(words).hexdigest()
    spark.createDataFrame([(sha, bytearray(words))], "dict_sha256 string, dictionary binary").write.parquet(f"{path}/dictionary")

    def make():
        encode = encoder(tokenizer, cache_bytes)
        zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words) if words else None)

        def step(part: pa.RecordBatch) -> dict:
            raw = [with_end(x) for x in encode([t or "" for t in part.column("text").to_pylist()])]
            return {"n": [len(x) // 4 for x in raw], "tie": [zlib.crc32(x) for x in raw], "frame": [zstd.compress(x) for x in raw]}

        return step

    with noted_paths() as paths:
        coded = stored(map_texts(docs, id_col, text_col, {"n": "long", "tie": "long", "frame": "binary"}, make), "frames")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = coded.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    write_shards(ordered, sha, f"{path}/shards")
    discard(spark, paths)


def write_shards(ordered: DataFrame, sha: str, path: str) -> None:
    """Pack the frames of every partition into shards.  ``ordered``: doc_id, n, tie, frame."""
    ddl = SHARDS.format(id=ordered.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        encoder.cache_clear()  # the worker's encoding is over
        release_memory()
        part_id = TaskContext.get().partitionId()
        seq, before = 0, 0
        ids, offsets, counts, frames, held = [], [0], [], [], 0

        def shard():
            return pa.RecordBatch.from_pydict(
                {
                    "part": [part_id], "seq": [seq], "first_id": [ids[0]], "last_id": [ids[-1]], "before": [before],
                    "ids": [ids], "offsets": [offsets], "counts": [counts], "dict_sha256": [sha], "frames": [b"".join(frames)],
                },
                schema=schema,
            )

        for batch in batches:
            for piece in slices(batch, "frame"):
                for i, n, frame in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "n", "frame"))):
                    ids.append(i)
                    counts.append(n)
                    frames.append(frame)
                    held += len(frame)
                    offsets.append(held)
                    if held >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                        yield shard()
                        seq, before = seq + 1, before + sum(counts)
                        ids, offsets, counts, frames, held = [], [0], [], [], 0
        if ids:
            yield shard()
        release_memory()

    ordered.mapInArrow(run, ddl).write.option("compression", "none").parquet(path)


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    words = bytes(row.dictionary)
    if hashlib.sha256(words).hexdigest() != row.dict_sha256:
        raise ValueError(f"{path}: the dictionary does not have its hash")
    return row.dict_sha256, words


def read_token_files(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array), ids_crc32 of every stored document.

    ``only``: ids to read; other shards are skipped by their first and last id,
    other frames by their offsets.
    """
    return _decoded(spark, path, True, only)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids, from the files."""
    return _decoded(spark, path, False, None)


def _decoded(spark: SparkSession, path: str, with_ids: bool, only: list[int] | None) -> DataFrame:
    import zstandard

    sha, words = _dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    id_type = shards.schema["first_id"].dataType.simpleString()
    totals = shards.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = totals.groupBy("part").agg(F.sum("n").alias("n"))  # one row per written partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if only is not None:
        shards = shards.where(F.exists(F.lit(only), lambda i: (i >= F.coalesce("first_id", i)) & (i <= F.col("last_id"))))  # null ids come first
    wanted = None if only is None else set(only)
    ddl = f"doc_id {id_type}, start long, n_tokens long, {'ids array<long>, ' if with_ids else ''}ids_crc32 long"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError("a shard was written with another dictionary")
                out = {f.name: [] for f in schema}
                start = row["base"] + row["before"]
                for k, (i, n) in enumerate(zip(row["ids"], row["counts"])):
                    if wanted is None or i in wanted:
                        raw = zstd.decompress(row["frames"][row["offsets"][k] : row["offsets"][k + 1]])
                        out["doc_id"].append(i)
                        out["start"].append(start)
                        out["n_tokens"].append(len(raw) // 4)
                        out["ids_crc32"].append(zlib.crc32(raw))
                        if with_ids:
                            out["ids"].append(np.frombuffer(raw, "<u4").astype("i8"))
                    start += n
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    # one row per written partition
    return shards.join(F.broadcast(bases), "part").drop("part", "seq", "first_id", "last_id").mapInArrow(run, ddl)
