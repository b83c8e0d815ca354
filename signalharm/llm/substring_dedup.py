"""Removal of word passages that an earlier document has.

Seeds are winnowed anchors: the smallest ``GRAM``-word hash of each window.
Documents meet in the bucket of a shared anchor and bring the windows around it.
Windows are grouped by hash, not extended from a matched pair: every window of a
repeat holds a shared anchor, so its group tells whether an earlier document has
it, and no pairs are formed.  The covered windows are united to maximal repeats.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalharm.llm.common import stored
from signalharm.llm.repeats import (
    LAST,
    Block,
    buckets_for,
    hot_covered,
    merged,
    pack,
    shared_anchors,
    shared_runs,
    spread,
    with_shared,
    word_symbols,
)

LENGTH = 50
GRAM = 10
#: Text of the input per bucket of anchors.
BUCKET_BYTES = 16 << 20
ENTRIES = "bucket int, block long, anchors binary, owners binary, texts binary, starts binary, counts binary, hashes binary"
COVERED = "block long, texts binary, begins binary, ends binary"


def earlier(keys: np.ndarray, hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Which windows (anchor, hash) occur with a smaller owner."""
    order = np.lexsort((hashes, keys))
    k, h, own = keys[order], hashes[order], owners[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(first)
    least = np.repeat(np.minimum.reduceat(own, at), np.diff(np.append(at, len(k)))) if len(at) else own
    out = np.empty(len(k), bool)
    out[order] = least < own
    return out


def pieces(bucket: np.ndarray):
    """(bucket, slice) of each stretch of equal buckets."""
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)]):
        if a < b:
            yield int(bucket[a]), slice(a, b)


def covered_rows(block: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    """One row per block with its intervals."""
    order = np.argsort(block, kind="stable")
    block, text, begin, end = block[order], text[order], begin[order], end[order]
    rows = {"block": [], "texts": [], "begins": [], "ends": []}
    for b, s in pieces(block):
        t, x, y = merged(text[s], begin[s], end[s])
        rows["block"].append(b)
        for name, v in (("texts", t), ("begins", x), ("ends", y)):
            rows[name].append(v.astype(np.int32).tobytes())
    return pa.table(rows, schema=pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("texts", "begins", "ends"))]))


def find_covered(blocks: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """block, texts, begins, ends: word intervals covered by windows that an earlier document has."""
    shared = shared_anchors(blocks, word_symbols, length, gram, buckets)

    def entries(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, bucket, anchor, text, start, count, hashes = shared_runs(row, word_symbols, length, gram, buckets, True)
                out = {c.split()[0]: [] for c in ENTRIES.split(", ")}
                for b, s in pieces(bucket):
                    out["bucket"].append(b)
                    out["block"].append(block.id)
                    out["anchors"].append(anchor[s].tobytes())
                    out["owners"].append(block.owner[text[s]].tobytes())
                    out["texts"].append(text[s].astype(np.int32).tobytes())
                    out["starts"].append(start[s].astype(np.int32).tobytes())
                    out["counts"].append(count[s].astype(np.int32).tobytes())
                    out["hashes"].append(hashes[spread(start[s], count[s])].tobytes())
                types = {"bucket": pa.int32(), "block": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()})

    def extended(rows: pa.Table) -> pa.Table:
        def read(name, dtype):
            return [np.frombuffer(x, dtype) for x in rows.column(name).to_pylist()]

        per = read("anchors", np.uint64)
        block = np.repeat(rows.column("block").to_numpy(), [len(x) for x in per])
        anchor, owner = np.concatenate(per), np.concatenate(read("owners", np.int64))
        text, start = (np.concatenate(read(n, np.int32)).astype(np.int64) for n in ("texts", "starts"))
        count = np.concatenate(read("counts", np.int32)).astype(np.int64)
        hashes = np.concatenate(read("hashes", np.uint64))
        hit = earlier(np.repeat(anchor, count), hashes, np.repeat(owner, count))
        at = spread(start, count)[hit]
        return covered_rows(np.repeat(block, count)[hit], np.repeat(text, count)[hit], at, at + length)

    sent = with_shared(blocks, shared).mapInArrow(entries, ENTRIES)
    found = sent.groupBy("bucket").applyInArrow(extended, COVERED)
    hot = hot_covered(blocks, shared, word_symbols, length, gram, buckets, lambda block, anchor, at: anchor, covered_rows, COVERED)
    return stored(found.union(hot) if hot else found, "covered")


def of_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The united intervals of a row's ``covered`` list."""
    found = row["covered"] or []
    parts = [np.concatenate([np.frombuffer(x[n], np.int32) for x in found] or [np.zeros(0, np.int32)]) for n in ("texts", "begins", "ends")]
    return merged(*(p.astype(np.int64) for p in parts))


def with_covered(blocks: DataFrame, covered: DataFrame) -> DataFrame:
    lists = covered.groupBy("block").agg(F.collect_list(F.struct("texts", "begins", "ends")).alias("covered"))
    return blocks.join(stored(lists, "covered-lists").hint("merge"), "block", "left")


def remove_repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_text: bool = False
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, n_spans (and kept_text).

    A word goes if a window of ``length`` words around it also starts in a
    document with a smaller id.  Words are split at ASCII white space.  Null and
    empty texts have no words.  A null id counts as larger than all others; rows
    that share an id never remove words from each other, so repeated rows give
    equal results.  Other columns are not read.
    """
    blocks = pack(docs, id_col, text_col)
    covered = find_covered(blocks, length, gram, buckets_for(blocks, BUCKET_BYTES))
    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long"

    def applied(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, word_symbols)
                text, begin, end = of_block(row)
                cuts = np.searchsorted(text, np.arange(len(block.owner) + 1))
                done = {}
                for k, raw in enumerate(block.texts()):
                    words, s = raw.split(), slice(cuts[k], cuts[k + 1])
                    n, at, kept = len(words), 0, []
                    for a, b in zip((begin[s] - block.bounds[k]).tolist(), (end[s] - block.bounds[k]).tolist()):
                        kept += words[at:a]
                        at = b
                    kept = b" ".join(kept + words[at:])
                    done[k] = (n, int((end[s] - begin[s]).sum()), kept, int(cuts[k + 1] - cuts[k]))
                out = {"doc_id": block.ids, "n_words": [], "n_removed": [], "kept_sha256": [], "n_spans": []}
                texts = []
                for i, k in zip(block.ids, block.text_no.tolist()):
                    n, removed, kept, spans = done[k]
                    if (LAST if i is None else i) > block.owner[k] and n >= length:  # a whole earlier copy in this block
                        removed, kept, spans = n, b"", 1
                    out["n_words"].append(n)
                    out["n_removed"].append(removed)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["n_spans"].append(spans)
                    texts.append(kept.decode())
                types = {"kept_sha256": pa.string()}
                arrays = {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(arrays | ({"kept_text": texts} if with_text else {}))

    return with_covered(blocks, covered).mapInArrow(applied, fields + (", kept_text string" if with_text else ""))
