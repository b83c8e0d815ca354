"""Repeated windows of ``length`` symbols across documents: blocks, anchors, intervals.

A window's anchor is the smallest gram hash inside it, so equal windows have
equal anchors.  Texts are packed into blocks once; every further step reads the
blocks and exchanges packed arrays with buckets of anchors:

1. a block sends its distinct anchors, a bucket tells which of them occur in
   more than one document, and which are hot: in more than ``HOT_BLOCKS`` blocks,
   or with more than ``HOT_WINDOWS`` windows in one;
2. a block sends the windows of those anchors, a bucket finds the windows that
   an earlier document has and sends back the covered intervals;
3. of hot anchors a block sends each distinct window once, with its smallest
   owner, to a bucket of the window's own hash; the bucket tells whether another
   block has it from a smaller owner, and the block marks its occurrences.

A row is one block or one (block, bucket).  A passage in every document costs a
bucket one anchor (step 1) or one window (step 3) per block, and an anchor brings
at most ``HOT_BLOCKS * HOT_WINDOWS`` windows to step 2.  No pairs are formed.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalharm.llm.common import slices, stored

BLOCK_BYTES = 4 << 20
#: Windows that are hashed at once.
STEP = 1 << 17
LAST = np.iinfo(np.int64).max
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: An anchor in more blocks, or with more windows in a block, goes by its windows' hashes.
HOT_BLOCKS, HOT_WINDOWS = 16, 1024

Symbols = Callable[[bytes, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """block, ids, text_no, sizes, body: texts packed in blocks; a text that a block holds twice is kept once."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        zstd, part, seq = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId(), 0
        ids, number, texts, held = [], [], {}, 0

        def block():
            return pa.RecordBatch.from_pydict(
                {
                    "block": [(part << 32) + seq],
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "text_no": pa.array([number], pa.list_(pa.int32())),
                    "sizes": pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                    "body": [zstd.compress(b"".join(texts))],
                }
            )

        for batch in batches:
            for piece in slices(batch, "text"):
                raw = piece.column("text").cast(pa.binary()).to_pylist()
                for i, t in zip(piece.column("doc_id").to_pylist(), raw):
                    t = t or b""
                    if t not in texts:
                        texts[t] = len(texts)
                        held += len(t)
                    ids.append(i)
                    number.append(texts[t])
                    if held >= BLOCK_BYTES or len(ids) >= 65536:
                        yield block()
                        seq, ids, number, texts, held = seq + 1, [], [], {}, 0
        if ids:
            yield block()

    ddl = "block long, ids array<long>, text_no array<int>, sizes array<int>, body binary"
    return stored(own.mapInArrow(run, ddl), "blocks")


class Block:
    """The symbols of one block and its texts' owners.

    ``bounds``: where each text's symbols begin, and the end; ``owner``: the
    smallest id of each text; a null id is larger than any other.
    """

    def __init__(self, row: dict, symbols: Symbols):
        self.id = row["block"]
        self.ids = row["ids"]
        self.text_no = np.array(row["text_no"], np.int64)
        sizes = np.array(row["sizes"], np.int64)
        self.body = zstandard.decompress(row["body"], max_output_size=int(sizes.sum()) or 1) if len(sizes) else b""
        self.ends = np.cumsum(sizes)
        self.symbols, self.bounds = symbols(self.body, np.concatenate([[0], self.ends]))
        known = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.owner = np.full(len(sizes), LAST)
        np.minimum.at(self.owner, self.text_no, known)

    def texts(self) -> Iterator[bytes]:
        begin = 0
        for end in self.ends.tolist():
            yield self.body[begin:end]
            begin = end


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * A
    h += b
    h ^= h >> np.uint64(29)
    h *= B
    h ^= h >> np.uint64(32)
    return h


def _over(h: np.ndarray, have: int, length: int, f) -> np.ndarray:
    """f over runs of ``length`` symbols from runs of ``have``, by doubling; the last two runs may overlap."""
    while have < length:
        step = min(have, length - have)
        h = f(h[:-step], h[step:])
        have += step
    return h


def windows(symbols: np.ndarray, bounds: np.ndarray, length: int, gram: int, hashes: bool = False):
    """Yield (start, anchors, window hashes or None, valid) for stretches of window starts.

    A window that crosses a text's end is not valid.
    """
    room = np.diff(bounds)
    for s in range(0, max(0, len(symbols) - length + 1), STEP):
        part = symbols[s : s + STEP + length - 1]
        grams = _over(part, 1, gram, _mixed)
        anchors = _over(grams, 1, length - gram + 1, np.minimum)
        at = np.arange(s, s + len(anchors))
        text = np.searchsorted(bounds, at, side="right") - 1
        valid = at + length <= bounds[text] + room[text]
        yield s, anchors, _over(grams, gram, length, _mixed) if hashes else None, valid, text


def anchor_runs(block: Block, length: int, gram: int, hashes: bool = False):
    """Runs of neighbouring valid windows of one text with one anchor: anchor, text, start, count (and all window hashes)."""
    out, kept = [], []
    for s, anchors, h, valid, text in windows(block.symbols, block.bounds, length, gram, hashes):
        change = np.ones(len(anchors), bool)
        change[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
        at = np.flatnonzero(change)
        count = np.diff(np.append(at, len(anchors)))
        good = valid[at]
        out.append((anchors[at][good], text[at][good], s + at[good], count[good]))
        if hashes:
            kept.append(h)
    if not out:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty, np.zeros(0, np.uint64)
    anchor, text, start, count = (np.concatenate(x) for x in zip(*out))
    return anchor, text, start, count, np.concatenate(kept) if hashes else None


def bucket_of(anchor: np.ndarray, buckets: int) -> np.ndarray:
    # minima are small numbers: mix them before they are dealt
    return ((anchor * A) >> np.uint64(33)).astype(np.int64) % buckets


def distinct_anchors(anchor: np.ndarray, text: np.ndarray, count: np.ndarray, owner: np.ndarray, buckets: int):
    """Distinct anchors in order of bucket and value, whether several owners have them, their windows, and each bucket's slice."""
    bucket = bucket_of(anchor, buckets)
    order = np.lexsort((anchor, bucket))
    value, own = anchor[order], owner[text[order]]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    at = np.flatnonzero(first)
    many = np.minimum.reduceat(own, at) < np.maximum.reduceat(own, at) if len(at) else np.zeros(0, bool)
    size = np.add.reduceat(count[order], at) if len(at) else count
    cuts = np.searchsorted(bucket[order][at], np.arange(buckets + 1))
    return value[at], many, size, cuts


def _rows(found: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(found, schema=schema)


def shared_anchors(blocks: DataFrame, symbols: Symbols, length: int, gram: int, buckets: int) -> DataFrame:
    """block, shared (two bitmaps per bucket): which of a block's distinct anchors occur in several documents,
    and which of these are hot (empty without any)."""
    hot_blocks, hot_windows = HOT_BLOCKS, HOT_WINDOWS
    ask = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("anchors", "many", "heavy"))])

    def asked(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, symbols)
                anchor, text, _, count, _ = anchor_runs(block, length, gram)
                value, many, size, cuts = distinct_anchors(anchor, text, count, block.owner, buckets)
                heavy = size > hot_windows
                full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                yield _rows(
                    {
                        "bucket": full,
                        "block": [block.id] * len(full),
                        "anchors": [value[cuts[b] : cuts[b + 1]].tobytes() for b in full],
                        "many": [np.packbits(many[cuts[b] : cuts[b + 1]]).tobytes() for b in full],
                        "heavy": [np.packbits(heavy[cuts[b] : cuts[b + 1]]).tobytes() for b in full],
                    },
                    ask,
                )

    def answered(rows: pa.Table) -> pa.Table:
        packed = [np.frombuffer(x, np.uint64) for x in rows.column("anchors").to_pylist()]
        many, heavy = (
            np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(a)) for m, a in zip(rows.column(n).to_pylist(), packed)])
            for n in ("many", "heavy")
        )
        value = np.concatenate(packed)
        order = np.argsort(value, kind="stable")
        ordered = value[order]
        first = np.ones(len(value), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(value)))
        several = (size > 1) | (np.maximum.reduceat(many[order], at) > 0)
        hottest = several & ((size > hot_blocks) | (np.maximum.reduceat(heavy[order], at) > 0))
        shared, hot = np.empty(len(value), bool), np.empty(len(value), bool)
        shared[order], hot[order] = np.repeat(several, size), np.repeat(hottest, size)
        cuts = np.cumsum([len(a) for a in packed])[:-1]
        bits = [np.packbits(x).tobytes() for x in np.split(shared, cuts)]
        hots = [np.packbits(x).tobytes() if x.any() else b"" for x in np.split(hot, cuts)]
        return pa.table(
            {"block": rows.column("block"), "bucket": rows.column("bucket"), "shared": pa.array(bits, pa.binary()), "hot": pa.array(hots, pa.binary())}
        )

    asks = blocks.mapInArrow(asked, "bucket int, block long, anchors binary, many binary, heavy binary")
    replies = asks.groupBy("bucket").applyInArrow(answered, "block long, bucket int, shared binary, hot binary")
    return stored(replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "shared", "hot")).alias("shared")), "shared-anchors")


def with_shared(blocks: DataFrame, shared: DataFrame) -> DataFrame:
    """Blocks and their bitmaps, a bit for each anchor: the same join at every size."""
    return blocks.join(shared.hint("merge"), "block")


def shared_runs(row: dict, symbols: Symbols, length: int, gram: int, buckets: int, hashed: bool, hot: bool = False):
    """The block of a row with ``shared``, and its runs with shared anchors that are hot, or not: bucket, anchor, text,
    start, count (, hashes)."""
    block = Block(row, symbols)
    anchor, text, start, count, hashes = anchor_runs(block, length, gram, hashed)
    value, _, _, cuts = distinct_anchors(anchor, text, count, block.owner, buckets)
    marked = np.zeros(len(value), bool)
    for reply in row["shared"]:
        a, b = cuts[reply["bucket"]], cuts[reply["bucket"] + 1]
        hottest = np.unpackbits(np.frombuffer(reply["hot"], np.uint8), count=b - a) if reply["hot"] else np.zeros(b - a, np.uint8)
        marked[a:b] = hottest if hot else np.unpackbits(np.frombuffer(reply["shared"], np.uint8), count=b - a) & ~hottest
    wanted = np.sort(value[marked])
    if len(wanted) == 0:
        keep = np.zeros(len(anchor), bool)
    else:
        keep = wanted[np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)] == anchor
    anchor, text, start, count = anchor[keep], text[keep], start[keep], count[keep]
    bucket = bucket_of(anchor, buckets)
    order = np.lexsort((start, anchor, bucket))
    return block, bucket[order], anchor[order], text[order], start[order], count[order], hashes


class HotWindows:
    """A block's windows of hot anchors: ``text``, ``at`` and ``owner`` of each, and the distinct ones in order of bucket.

    Distinct windows have two keys (``lead`` of the block, anchors and positions, and the hash) and ``least``, the
    smallest owner in the block; ``number`` tells which of them a window is.
    """

    def __init__(self, row: dict, symbols: Symbols, length: int, gram: int, buckets: int, lead: Callable):
        self.block, _, anchor, text, start, count, _ = shared_runs(row, symbols, length, gram, buckets, False, True)
        self.text, self.at = np.repeat(text, count), spread(start, count)
        self.owner = self.block.owner[self.text]
        size = count + length - 1
        part, bounds = self.block.symbols[spread(start, size)], np.concatenate([[0], np.cumsum(size)])
        found = [h[valid] for _, _, h, valid, _ in windows(part, bounds, length, gram, True)]
        rest = np.concatenate(found) if found else np.zeros(0, np.uint64)
        head = lead(self.block, np.repeat(anchor, count), self.at)
        bucket = bucket_of(rest, buckets)
        order = np.lexsort((rest, head, bucket))
        h, r = head[order], rest[order]
        first = np.ones(len(order), bool)
        first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(first)
        self.head, self.rest = h[first], r[first]
        self.least = np.minimum.reduceat(self.owner[order], first) if len(first) else self.owner
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.cuts = np.searchsorted(bucket[order][first], np.arange(buckets + 1))


def hot_windows(blocks: DataFrame, shared: DataFrame, symbols: Symbols, length: int, gram: int, buckets: int, lead: Callable) -> DataFrame:
    """bucket, block, heads, rests, owners: each distinct window of a hot anchor once per block."""
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((n, pa.binary()) for n in ("heads", "rests", "owners"))])

    def asked(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = HotWindows(row, symbols, length, gram, buckets, lead)
                full = [(b, slice(own.cuts[b], own.cuts[b + 1])) for b in range(buckets) if own.cuts[b] < own.cuts[b + 1]]
                found = {"bucket": [b for b, _ in full], "block": [own.block.id] * len(full)}
                for name, x in (("heads", own.head), ("rests", own.rest), ("owners", own.least)):
                    found[name] = [x[s].tobytes() for _, s in full]
                yield _rows(found, schema)

    return with_shared(blocks, shared).mapInArrow(asked, "bucket int, block long, heads binary, rests binary, owners binary")


def hot_covered(blocks: DataFrame, shared: DataFrame, symbols: Symbols, length: int, gram: int, buckets: int, lead: Callable, covered: Callable, ddl: str) -> DataFrame | None:
    """``covered(block, text, begin, end)`` (rows of ``ddl``) of the windows of hot anchors that an earlier document has.

    None without hot anchors.
    """
    shared = shared.where(F.exists("shared", lambda x: F.length(x["hot"]) > 0))
    if not shared.limit(1).count():
        return None

    def answered(rows: pa.Table) -> pa.Table:
        head, rest = (np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column(n).to_pylist()]) for n in ("heads", "rests"))
        per = [np.frombuffer(x, np.int64) for x in rows.column("owners").to_pylist()]
        owner = np.concatenate(per)
        order = np.lexsort((rest, head))
        h, r = head[order], rest[order]
        first = np.ones(len(order), bool)
        first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(first)
        least = np.repeat(np.minimum.reduceat(owner[order], at), np.diff(np.append(at, len(order))))
        before = np.empty(len(order), bool)
        before[order] = least < owner[order]
        bits = [np.packbits(x).tobytes() for x in np.split(before, np.cumsum([len(x) for x in per])[:-1])]
        return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "before": pa.array(bits, pa.binary())})

    asks = hot_windows(blocks, shared, symbols, length, gram, buckets, lead)
    replies = asks.groupBy("bucket").applyInArrow(answered, "block long, bucket int, before binary")
    replies = stored(replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "before")).alias("before")), "hot-windows")

    def marked(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = HotWindows(row, symbols, length, gram, buckets, lead)
                before = np.zeros(len(own.least), bool)
                for reply in row["before"]:
                    a, b = own.cuts[reply["bucket"]], own.cuts[reply["bucket"] + 1]
                    before[a:b] = np.unpackbits(np.frombuffer(reply["before"], np.uint8), count=b - a)
                hit = before[own.number] | (own.least[own.number] < own.owner)
                at = own.at[hit]
                yield from covered(np.full(len(at), own.block.id), own.text[hit], at, at + length).to_batches()

    return with_shared(blocks, shared).join(replies.hint("merge"), "block").mapInArrow(marked, ddl)


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + count, count)


def merged(text: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Unite overlapping and touching intervals of each text."""
    order = np.lexsort((begin, text))
    text, begin, end = text[order], begin[order], end[order]
    if len(text) == 0:
        return text, begin, end
    # texts' symbols lie one after the other, so one running maximum serves all
    reach = np.maximum.accumulate(end)
    new = np.ones(len(text), bool)
    new[1:] = (begin[1:] > reach[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], begin[at], np.maximum.reduceat(end, at)


def word_symbols(body: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and where each text's words begin."""
    digest, out, sizes = xxhash.xxh64_intdigest, [], [0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        words = body[a:b].split()
        out.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        sizes.append(len(words))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.cumsum(sizes)


_TABLE = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)


def byte_symbols(body: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _TABLE[np.frombuffer(body, np.uint8)], bounds


def buckets_for(blocks: DataFrame, bytes_each: int) -> int:
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    return int(min(4096, max(1, -(-total // bytes_each))))
