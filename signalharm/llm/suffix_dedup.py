"""Removal of byte strings that an earlier document has: suffix arrays in a logarithmic index.

A bucket's documents arrive in batches of ascending id.  A batch gets a suffix
array: its window starts sorted by the suffix, cut after ``length`` bytes (first
by the leading eight bytes, then by a hash of all).  It is merge-scanned against
every level of the index: a suffix that stands beside an equal one of a smaller
id is a match of at least ``length`` bytes.  Then the batch becomes a level, and
levels merge while the last is no larger than the new one, so a suffix takes
part in logarithmically many merges.  Only suffixes at windows whose anchor
occurs in several documents are indexed: no other can match.  Suffixes of hot anchors are
sorted and reduced to distinct ones in each block first (``repeats``).
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalharm.llm.common import stored
from signalharm.llm.repeats import (
    LAST,
    Block,
    buckets_for,
    byte_symbols,
    hot_covered,
    pack,
    shared_anchors,
    shared_runs,
    spread,
    windows,
    with_shared,
)
from signalharm.llm.substring_dedup import COVERED, covered_rows, of_block, pieces, with_covered

LENGTH = 50
GRAM = 16
BUCKET_BYTES = 4 << 20
#: Suffixes of one batch, about.
BATCH = 1 << 20
ENTRIES = "bucket int, block long, owners binary, texts binary, starts binary, counts binary, body binary"


class Level:
    """Distinct cut suffixes in order, each with the smallest id that has it."""

    def __init__(self, lead: np.ndarray, rest: np.ndarray, owner: np.ndarray):
        self.lead, self.rest, self.owner = lead, rest, owner

    def __len__(self) -> int:
        return len(self.lead)


def merge(a: Level, b: Level) -> tuple[Level, np.ndarray]:
    """The merged level, and for each suffix of ``b`` the smallest id that has it in either."""
    lead, rest = np.concatenate([a.lead, b.lead]), np.concatenate([a.rest, b.rest])
    owner = np.concatenate([a.owner, b.owner])
    order = np.lexsort((rest, lead))
    lead, rest = lead[order], rest[order]
    first = np.ones(len(lead), bool)
    first[1:] = (lead[1:] != lead[:-1]) | (rest[1:] != rest[:-1])
    at = np.flatnonzero(first)
    least = np.minimum.reduceat(owner[order], at) if len(at) else owner
    found = np.empty(len(order), np.int64)
    found[order] = np.repeat(least, np.diff(np.append(at, len(order))))
    return Level(lead[at], rest[at], least), found[len(a) :]


EMPTY = Level(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


class LogIndex:
    """Levels of geometrically growing size."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, lead: np.ndarray, rest: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Index a batch; for each of its suffixes the smallest id that has it so far."""
        new, least = merge(EMPTY, Level(lead, rest, owner))
        batch = Level(lead, rest, owner)
        scanned = []
        for level in self.levels:
            both, found = merge(level, batch)
            least = np.minimum(least, found)
            scanned.append(both)
        while self.levels and len(self.levels[-1]) <= len(new):
            new, _ = merge(self.levels.pop(), new)
        self.levels.append(new)
        return least


def leading(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | body[at + i]
    return out


def find_covered(blocks: DataFrame, length: int, gram: int, buckets: int, batch_size: int = BATCH) -> DataFrame:
    """block, texts, begins, ends: byte intervals covered by strings that an earlier document has."""
    shared = shared_anchors(blocks, byte_symbols, length, gram, buckets)

    def entries(batches):
        zstd = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for row in batch.to_pylist():
                block, bucket, _, text, start, count, _ = shared_runs(row, byte_symbols, length, gram, buckets, False)
                body = np.frombuffer(block.body, np.uint8)
                out = {c.split()[0]: [] for c in ENTRIES.split(", ")}
                for b, s in pieces(bucket):
                    out["bucket"].append(b)
                    out["block"].append(block.id)
                    out["owners"].append(block.owner[text[s]].tobytes())
                    out["texts"].append(text[s].astype(np.int32).tobytes())
                    out["starts"].append(start[s].astype(np.int32).tobytes())
                    out["counts"].append(count[s].astype(np.int32).tobytes())
                    out["body"].append(zstd.compress(body[spread(start[s], count[s] + length - 1)].tobytes()))
                types = {"bucket": pa.int32(), "block": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.binary())) for k, v in out.items()})

    def scanned(rows: pa.Table) -> pa.Table:
        def read(name, dtype):
            return [np.frombuffer(x, dtype) for x in rows.column(name).to_pylist()]

        per = read("owners", np.int64)
        block, owner = np.repeat(rows.column("block").to_numpy(), [len(x) for x in per]), np.concatenate(per)
        text, start, count = (np.concatenate(read(n, np.int32)).astype(np.int64) for n in ("texts", "starts", "counts"))
        body = np.frombuffer(b"".join(map(zstandard.decompress, rows.column("body").to_pylist())), np.uint8)
        size = count + length - 1
        begin = np.cumsum(size) - size
        by_id = np.argsort(owner, kind="stable")
        # a batch ends with a document
        batch = np.cumsum(count[by_id]) // batch_size
        last = np.append(owner[by_id][1:] != owner[by_id][:-1], True)
        cuts = [0, *(np.flatnonzero(last & (np.append(batch[1:], -1) != batch)) + 1).tolist()]
        index, found = LogIndex(), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = by_id[a:b]
            part, bounds = body[spread(begin[own], size[own])], np.concatenate([[0], np.cumsum(size[own])])
            lead, rest = [], []
            for s, _, h, valid, _ in windows(*byte_symbols(part.tobytes(), bounds), length, gram, True):
                at = np.flatnonzero(valid)
                rest.append(h[at])
                lead.append(leading(part, s + at))
            lead, rest = np.concatenate(lead), np.concatenate(rest)
            ids = np.repeat(owner[own], count[own])
            hit = index.add(lead, rest, ids) < ids
            at = spread(start[own], count[own])[hit]
            found.append((np.repeat(block[own], count[own])[hit], np.repeat(text[own], count[own])[hit], at, at + length))
        return covered_rows(*(np.concatenate(x) for x in zip(*found)))

    def lead(block, anchor, at):
        return leading(np.frombuffer(block.body, np.uint8), at)

    sent = with_shared(blocks, shared).mapInArrow(entries, ENTRIES)
    found = sent.groupBy("bucket").applyInArrow(scanned, COVERED)
    hot = hot_covered(blocks, shared, byte_symbols, length, gram, buckets, lead, covered_rows, COVERED)
    return stored(found.union(hot) if hot else found, "covered")


def remove_repeated_strings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
    batch_size: int = BATCH,
    with_bytes: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left).

    A byte goes if a string of ``length`` bytes around it also starts in a
    document with a smaller id.  Null and empty texts have no bytes.  A null id
    counts as larger than all others; rows that share an id never remove bytes
    from each other.  Matches do not cross documents.  Other columns are not read.
    """
    blocks = pack(docs, id_col, text_col)
    covered = find_covered(blocks, length, gram, buckets_for(blocks, BUCKET_BYTES), batch_size)
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def applied(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, lambda body, bounds: (np.zeros(0, np.uint64), bounds))
                text, begin, end = of_block(row)
                cuts = np.searchsorted(text, np.arange(len(block.owner) + 1))
                done = {}
                for k, raw in enumerate(block.texts()):
                    s, at, kept = slice(cuts[k], cuts[k + 1]), 0, []
                    for a, b in zip((begin[s] - block.bounds[k]).tolist(), (end[s] - block.bounds[k]).tolist()):
                        kept.append(raw[at:a])
                        at = b
                    done[k] = (len(raw), int((end[s] - begin[s]).sum()), int(cuts[k + 1] - cuts[k]), b"".join([*kept, raw[at:]]))
                out = {"doc_id": block.ids, "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
                left = []
                for i, k in zip(block.ids, block.text_no.tolist()):
                    n, removed, spans, kept = done[k]
                    if (LAST if i is None else i) > block.owner[k] and n >= length:  # a whole earlier copy in this block
                        removed, spans, kept = n, 1, b""
                    out["n_bytes"].append(n)
                    out["n_removed"].append(removed)
                    out["n_spans"].append(spans)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    left.append(kept)
                types = {"kept_sha256": pa.string()}
                arrays = {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}
                yield pa.RecordBatch.from_pydict(arrays | ({"kept": left} if with_bytes else {}))

    return with_covered(blocks, covered).mapInArrow(applied, fields + (", kept binary" if with_bytes else ""))
