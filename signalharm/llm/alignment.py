"""Alignment of the tokens of two tokenizers by byte offsets, with corpus-wide link counts.

A text (with a space before it) is cut where a space follows a character that is
no white space.  Both tokenizers end a token there: the first one's pre-tokenizer
never joins them, and no piece of the second spans them.  So a text's alignment
is that of its chunks, one after the other.  Blocks of texts are written once as
numbers of their distinct chunks with these chunks' ids on both sides.

First pass: each block aligns its chunks and counts the links of each id pair.
Segments of the distinct pairs get a minimal perfect hash; blocks' counts become
dense vectors indexed by it, which are summed in a tree.  Second pass: each block
looks up its pairs in the segments (the key at a number is verified), aligns its
texts again from their ids and sums the counts over their links.
"""

import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalharm.llm import perfect_hash
from signalharm.llm.common import slices, stored
from signalharm.llm.repeats import spread

#: Distinct pairs of a segment, about.
SEGMENT_KEYS = 1 << 18
SHARE = 64
#: Count vectors that one group of the tree adds, and blocks whose questions one group answers.
FAN, ASKING = 16, 256
#: Characters of a block of texts.
BLOCK_CHARS = 4 << 20
#: Bytes of remembered chunks, and the longest that is remembered.
MEMORY, LONGEST = 96 << 20, 64
WORD = re.compile(r" [A-Za-z]+")
CUT = re.compile(r"(?<=\S)(?= )")
SEPARATORS = b",|;"


def _written(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """``a1,a2|b1;`` for each group that ends at these tokens: the digits and the mark of each token in a fixed width."""
    if not len(a):
        return b""
    n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
    at_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]  # a token's place among all
    at_b = np.arange(len(b)) + np.cumsum(n_a)[group_b]
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), SEPARATORS[0], np.uint8)
    ids[at_a], ids[at_b] = a, b
    mark[at_a[last_a]], mark[at_b[last_b]] = SEPARATORS[1], SEPARATORS[2]
    width = len(str(int(ids.max())))
    digits = np.zeros((len(ids), width + 1), np.uint8)
    for k in range(width):
        digits[:, width - 1 - k] = 48 + ids // 10**k % 10
    digits[:, width] = mark
    return digits[np.arange(width + 1) >= (width - _digits(ids))[:, None]].tobytes()


def _digits(ids: np.ndarray) -> np.ndarray:
    return np.searchsorted(10 ** np.arange(1, 19), ids, side="right") + 1


class Tokens:
    """Two tokenizers and the ids of remembered chunks."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.letters = {b: c for c, b in letters.items()}
        tokens = self.a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bodies = [np.frombuffer(b"".join(x), np.uint8) for x in (bytes_a, bytes_b)]
        self.sizes = [np.array([len(t) for t in x], np.int64) for x in (bytes_a, bytes_b)]
        #: Whether no piece has a space after another character, so that chunks are independent.
        self.cut = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = np.array(self.b.encode("a ")[len(self.b.encode("a")) :], np.uint32).tobytes()
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        return CUT.split(" " + text) if self.cut else [" " + text]

    def ids(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """The first and second ids (32-bit numbers) of each of these distinct chunks."""
        known = self.known
        new = [c for c in chunks if c not in known]
        # one word of letters after a space is one pre-token: the model alone
        word = [i for i, c in enumerate(new) if WORD.fullmatch(c)]
        first: list[bytes] = [b""] * len(new)
        bpe, mark = self.a.model.tokenize, self.letters[32]
        for i in word:
            first[i] = array("I", [t.id for t in bpe(mark + new[i][1:])]).tobytes()
        rest = sorted(set(range(len(new))).difference(word))
        for k in range(0, len(rest), 1024):
            part = rest[k : k + 1024]
            for i, x in zip(part, self.a.encode_batch([new[i] for i in part], add_special_tokens=False)):
                first[i] = array("I", x.ids).tobytes()
        found = {}
        for k in range(0, len(new), 1024):
            part = new[k : k + 1024]
            for i, (c, x) in enumerate(zip(part, self.b.encode([c[1:] for c in part], num_threads=1)), k):
                # the last space of a text: no text stands for it alone
                found[c] = first[i], self.space if c == " " else array("I", x).tobytes()
        out = [known[c] if c in known else found[c] for c in chunks]
        if self.held > MEMORY:
            self.known, self.held = {}, 0
        for c, x in found.items():
            if len(c) <= LONGEST:
                self.known[c] = x
                self.held += 300 + len(c) + len(x[0]) + len(x[1])
        return out

    def same(self, side: int, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each chunk's tokens have its bytes (``size`` of ``raw`` each)."""
        n = self.sizes[side][ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.concatenate([[0], np.cumsum(counts)])
        own = ends[at[1:]] - ends[at[:-1]]
        ok = own == size
        begin = (np.cumsum(self.sizes[side]) - self.sizes[side])[ids]
        chunk = np.repeat(np.arange(len(counts)), counts)
        kept = ok[chunk]
        written = self.bodies[side][spread(begin[kept], n[kept])]
        wanted = raw[spread((np.cumsum(size) - size)[ok], size[ok])]
        differs = np.flatnonzero(written != wanted)
        where = np.flatnonzero(ok)
        ok[where[np.searchsorted(np.cumsum(size[ok]), differs, side="right")]] = False
        return ok


@lru_cache(maxsize=1)
def tokens(path_a: str, path_b: str) -> Tokens:
    """One for all tasks of a Python worker."""
    return Tokens(path_a, path_b)


PACKED = ("counts", "codes", "a", "n_a", "b", "n_b", "valid")


def tokenized(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """block, ids, text_no and packed arrays: texts as numbers of a block's distinct chunks, and these chunks' ids on both sides.

    A text that a block holds twice is kept once.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        both, zstd = tokens(path_a, path_b), zstandard.ZstdCompressor(level=1)
        part, seq, ids, number, texts, held = TaskContext.get().partitionId(), 0, [], [], {}, 0

        def block():
            distinct: dict[str, int] = {}
            counts, codes = [], []
            for t in texts:
                own = both.chunks(t) if t else []
                codes += [distinct.setdefault(c, len(distinct)) for c in own]
                counts.append(len(own))
            found = both.ids(list(distinct))
            encoded = [c.encode() for c in distinct]
            raw, size = np.frombuffer(b"".join(encoded), np.uint8), np.array([len(c) for c in encoded], np.int64)
            arrays = {"counts": np.array(counts, np.uint32), "codes": np.array(codes, np.uint32)}
            valid = np.ones(len(distinct), bool)
            for side, name in enumerate("ab"):
                x = np.frombuffer(b"".join([f[side] for f in found]), np.uint32)
                n = np.array([len(f[side]) for f in found], np.int64) // 4
                arrays |= {name: x, f"n_{name}": n.astype(np.uint32)}
                valid &= both.same(side, x.astype(np.int64), n, raw, size)
            arrays["valid"] = valid.astype(np.uint32)
            return pa.RecordBatch.from_pydict(
                {
                    "block": [(part << 32) + seq],
                    "ids": pa.array([ids], pa.list_(pa.int64())),
                    "text_no": pa.array([number], pa.list_(pa.int32())),
                    # bytes of one place side by side: most numbers are small
                    **{k: [zstd.compress(arrays[k].view(np.uint8).reshape(-1, 4).T.tobytes())] for k in PACKED},
                }
            )

        for batch in batches:
            for piece in slices(batch, "text"):
                for i, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    t = t or ""
                    if t not in texts:
                        texts[t] = len(texts)
                        held += len(t)
                    ids.append(i)
                    number.append(texts[t])
                    if held >= BLOCK_CHARS or len(ids) >= 65536:
                        yield block()
                        seq, ids, number, texts, held = seq + 1, [], [], {}, 0
        if ids:
            yield block()

    ddl = "block long, ids array<long>, text_no array<int>, " + ", ".join(f"{k} binary" for k in PACKED)
    return stored(own.mapInArrow(run, ddl), "tokenized")


def _unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


class BlockAlignment:
    """The alignment of a block's distinct chunks, one after the other, and its texts as numbers of chunks.

    ``links`` (first id << 32 | second id) and ``n_links``, ``n_groups``, ``n_a``, ``n_b`` of each chunk; chunks whose
    bytes differ have none.
    """

    def __init__(self, row: dict, sizes: list[np.ndarray]):
        self.counts, self.codes, a, self.n_a, b, self.n_b, valid = (_unpacked(row[k]) for k in PACKED)
        self.copies = np.bincount(np.array(row["text_no"], np.int64), minlength=len(self.counts))
        valid = valid.astype(bool)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)
        # a text with one chunk whose bytes differ has no tokens
        bad = np.bincount(self.text, weights=~valid[self.codes], minlength=len(self.counts))
        self.valid = (bad == 0) & (self.counts > 0)
        self.a, self.b = a[np.repeat(valid, self.n_a)], b[np.repeat(valid, self.n_b)]
        self.n_a, self.n_b = np.where(valid, self.n_a, 0), np.where(valid, self.n_b, 0)
        end_a, end_b = np.cumsum(sizes[0][self.a]), np.cumsum(sizes[1][self.b])
        # every stretch between two neighbouring ends of either side is one link
        ends = np.union1d(end_a, end_b)
        link_a = np.searchsorted(end_a, ends)
        self.links = self.a[link_a] << 32 | self.b[np.searchsorted(end_b, ends)]
        chunk_a = np.repeat(np.arange(len(valid)), self.n_a)
        self.n_links = np.bincount(chunk_a[link_a], minlength=len(valid))
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        self.last = np.searchsorted(end_a, common), np.searchsorted(end_b, common)
        self.n_groups = np.bincount(chunk_a[self.last[0]], minlength=len(valid))

    def sums(self, per_chunk: np.ndarray) -> np.ndarray:
        """Sum over each text's chunks, 0 for texts without tokens."""
        ends = np.concatenate([[0], np.cumsum(per_chunk[self.codes])])
        cuts = np.concatenate([[0], np.cumsum(self.counts)])
        return np.where(self.valid, ends[cuts[1:]] - ends[cuts[:-1]], 0)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked pairs and their links over the block, a text as often as it is there."""
        uses = np.zeros(len(self.n_links), np.int64)
        np.add.at(uses, self.codes, np.where(self.valid, self.copies, 0)[self.text])
        order = np.argsort(self.links, kind="stable")
        ordered = self.links[order]
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
        count = np.add.reduceat(np.repeat(uses, self.n_links)[order], at) if len(at) else at
        return ordered[at][count > 0], count[count > 0]

    def written(self) -> list[bytes]:
        """Each chunk's groups."""
        text = _written(self.a, self.b, *self.last)
        size = np.zeros(len(self.n_a), np.int64)
        for ids, n in ((self.a, self.n_a), (self.b, self.n_b)):
            size += np.bincount(np.repeat(np.arange(len(n)), n), weights=_digits(ids) + 1, minlength=len(n)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
        return [text[x:y] for x, y in zip(cuts, cuts[1:])]


def count_pairs(blocks: DataFrame, sizes: list[np.ndarray]) -> DataFrame:
    """block, keys, counts (packed 64-bit numbers): links of each pair of a first and a second id, over a block."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, count = BlockAlignment(row, sizes).pairs()
                yield pa.RecordBatch.from_pydict({"block": [row["block"]], "keys": [keys.tobytes()], "counts": [count.tobytes()]})

    return stored(blocks.mapInArrow(run, "block long, keys binary, counts binary"), "block-pairs")


def _longs(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def segment_count(pairs: DataFrame) -> int:
    """Segments for the distinct pairs, estimated from one in SHARE of all possible pairs (it decides the layout only)."""
    share = np.uint64(SHARE)

    def run(batches):
        for batch in batches:
            for keys in _longs(batch.column("keys")):
                yield pa.RecordBatch.from_pydict({"k": keys[perfect_hash.mixed(keys.astype(np.uint64), 62) % share == 0]})

    return max(1, -(-pairs.select("keys").mapInArrow(run, "k long").distinct().count() * SHARE // SEGMENT_KEYS))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (perfect_hash.mixed(keys.astype(np.uint64), 63) % np.uint64(segments)).astype(np.int64)


def by_segment(pairs: DataFrame, segments: int) -> DataFrame:
    """segment, block, keys, counts: each block's pairs, parted by segment and in the order of their keys."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = (np.frombuffer(row[n], np.int64) for n in ("keys", "counts"))
                segment = segment_of(keys, segments)
                order = np.lexsort((keys, segment))
                cuts = np.searchsorted(segment[order], np.arange(segments + 1))
                full = [s for s in range(segments) if cuts[s] < cuts[s + 1]]
                parts = [order[cuts[s] : cuts[s + 1]] for s in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([row["block"]] * len(full), pa.int64()),
                        pa.array([keys[p].tobytes() for p in parts], pa.binary()),
                        pa.array([counts[p].tobytes() for p in parts], pa.binary()),
                    ],
                    ["segment", "block", "keys", "counts"],
                )

    return pairs.mapInArrow(run, "segment int, block long, keys binary, counts binary")


def hash_segments(parted: DataFrame) -> DataFrame:
    """segment, sizes, bits, keys: the minimal perfect hash of each segment's distinct pairs, and the key at each number."""

    def distinct(rows: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(_longs(rows.column("keys"))))
        return pa.table({"segment": rows.column("segment")[:1], "keys": pa.array([keys.tobytes()], pa.binary())})

    def hashed(rows: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate(_longs(rows.column("keys"))))
        levels = perfect_hash.build(keys)
        ordered = np.empty(len(keys), np.int64)
        ordered[perfect_hash.numbers(keys, levels)] = keys
        sizes, bits = perfect_hash.packed(levels)
        return pa.table(
            {
                "segment": rows.column("segment")[:1],
                "sizes": pa.array([sizes], pa.list_(pa.int32())),
                "bits": pa.array([bits], pa.binary()),
                "keys": pa.array([ordered.tobytes()], pa.binary()),
            }
        )

    parts = _tree(parted.select("segment", "block", "keys"), distinct, "keys binary")
    return stored(parts.groupBy("segment").applyInArrow(hashed, "segment int, sizes array<int>, bits binary, keys binary"), "segments")


def _tree(rows: DataFrame, add, ddl: str) -> DataFrame:
    """Rows of a segment added FAN blocks at a time, level by level, until at most FAN are left in each."""
    most = rows.groupBy("segment").count().agg(F.max("count")).first()[0] or 0
    groups = -(-most // FAN)  # a hash deals blocks to groups of about FAN
    rows = rows.withColumn("leaf", F.pmod(F.xxhash64("block"), F.lit(max(1, groups))).cast("int")).drop("block")
    while groups > 1:

        def level(part: pa.Table) -> pa.Table:
            return add(part).append_column("leaf", part.column("leaf")[:1])

        rows = rows.groupBy("segment", "leaf").applyInArrow(level, f"segment int, {ddl}, leaf int")
        rows = stored(rows.withColumn("leaf", F.floor(F.col("leaf") / FAN).cast("int")), "tree-level")
        groups = -(-groups // FAN)
    return rows.drop("leaf")


def sum_counts(parted: DataFrame, segments: DataFrame) -> DataFrame:
    """segment, total: the dense vector of counts of each segment, indexed by the hash."""

    def dense(rows: pa.Table, own: pa.Table) -> pa.Table:
        levels = perfect_hash.unpacked(own.column("sizes")[0].as_py(), own.column("bits")[0].as_py())
        keys = np.concatenate(_longs(rows.column("keys")))
        total = np.zeros(sum(int(x.sum()) for x in levels), np.int64)
        np.add.at(total, perfect_hash.numbers(keys, levels), np.concatenate(_longs(rows.column("counts"))))
        return pa.table(
            {"segment": rows.column("segment")[:1], "leaf": rows.column("leaf")[:1], "total": pa.array([total.tobytes()], pa.binary())}
        )

    def added(rows: pa.Table) -> pa.Table:
        return pa.table({"segment": rows.column("segment")[:1], "total": pa.array([sum(_longs(rows.column("total"))).tobytes()], pa.binary())})

    leaves = max(1, -(-(parted.groupBy("segment").count().agg(F.max("count")).first()[0] or 0) // ASKING))
    rows = parted.withColumn("leaf", F.pmod(F.xxhash64("block"), F.lit(leaves)).cast("int"))
    shape = segments.select("segment", "sizes", "bits", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("leaf"))
    vectors = rows.groupBy("segment", "leaf").cogroup(shape.groupBy("segment", "leaf"))
    vectors = vectors.applyInArrow(lambda r, s: dense(r, s) if len(r) else EMPTY_VECTORS, "segment int, leaf int, total binary")
    vectors = stored(vectors.withColumnRenamed("leaf", "block"), "count-vectors")
    return stored(_tree(vectors, added, "total binary").groupBy("segment").applyInArrow(added, "segment int, total binary"), "counts")


EMPTY_VECTORS = pa.schema([("segment", pa.int32()), ("leaf", pa.int32()), ("total", pa.binary())]).empty_table()
EMPTY_REPLIES = pa.schema([("block", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary()), ("best", pa.binary())]).empty_table()


def best_counts(segments: DataFrame, totals: DataFrame) -> dict[int, int]:
    """The largest count of a pair of each second id: at most as many rows as its vocabulary has."""

    def run(batches):
        best: dict[int, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                keys, total = (np.frombuffer(row[n], np.int64) for n in ("keys", "total"))
                b = keys & 0xFFFFFFFF
                order = np.lexsort((total, b))
                last = np.flatnonzero(np.append(np.diff(b[order]) != 0, True)) if len(b) else np.zeros(0, np.int64)
                for i, n in zip(b[order][last].tolist(), total[order][last].tolist()):
                    best[i] = max(n, best.get(i, 0))
        yield pa.RecordBatch.from_pydict({"b": pa.array(list(best), pa.int64()), "n": pa.array(list(best.values()), pa.int64())})

    rows = segments.join(totals, "segment").select("keys", "total").mapInArrow(run, "b long, n long").groupBy("b").agg(F.max("n").alias("n"))
    return {r.b: r.n for r in rows.collect()}


def look_up(parted: DataFrame, segments: DataFrame, totals: DataFrame, best: dict[int, int]) -> DataFrame:
    """block, replies: for each segment the counts of a block's pairs, in the order of their keys, and which are their second id's best."""
    most = np.zeros(max(best, default=0) + 1, np.int64)
    most[list(best)] = list(best.values())

    def answered(asked: pa.Table, own: pa.Table) -> pa.Table:
        levels = perfect_hash.unpacked(own.column("sizes")[0].as_py(), own.column("bits")[0].as_py())
        held, total = (np.frombuffer(own.column(n)[0].as_py(), np.int64) for n in ("keys", "total"))
        counts, bits = [], []
        for keys in _longs(asked.column("keys")):
            at = perfect_hash.numbers(keys, levels)
            if (at < 0).any() or (held[at] != keys).any():
                raise ValueError("a pair is not in its segment")
            counts.append(total[at].tobytes())
            bits.append(np.packbits(total[at] == most[keys & 0xFFFFFFFF]).tobytes())
        out = {"block": asked.column("block"), "segment": asked.column("segment")}
        return pa.table(out | {"counts": pa.array(counts, pa.binary()), "best": pa.array(bits, pa.binary())})

    salts = max(1, -(-(parted.groupBy("segment").count().agg(F.max("count")).first()[0] or 0) // ASKING))
    asked = parted.select("segment", "block", "keys").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    own = segments.join(totals, "segment").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    replies = asked.groupBy("segment", "salt").cogroup(own.groupBy("segment", "salt"))
    replies = replies.applyInArrow(lambda a, o: answered(a, o) if len(a) else EMPTY_REPLIES, "block long, segment int, counts binary, best binary")
    return stored(replies.groupBy("block").agg(F.collect_list(F.struct("segment", "counts", "best")).alias("replies")), "pair-counts")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and the written groups).

    A text with a space before it is encoded by the first tokenizer (byte-level
    BPE), as it is by the second (sentencepiece, which adds the space).  Null and
    empty texts, and texts whose tokens' bytes differ from it, have no tokens:
    zeros and ''.  Repeated rows and copies count each; a null id stays null;
    other columns are not read.  A text of any length lies in one block; stretches
    without spaces are encoded as one chunk.
    """
    blocks = tokenized(docs, path_a, path_b, id_col, text_col)
    sizes = tokens(path_a, path_b).sizes  # a number for each id of the vocabularies
    pairs = count_pairs(blocks, sizes)
    segments_n = segment_count(pairs)
    parted = stored(by_segment(pairs, segments_n), "parted-pairs")
    segments = hash_segments(parted)
    totals = sum_counts(parted, segments)
    replies = look_up(parted, segments, totals, best_counts(segments, totals))
    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def applied(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = BlockAlignment(row, sizes)
                keys, _ = own.pairs()
                order = np.lexsort((keys, segment_of(keys, segments_n)))  # as the replies lie
                replies = sorted(row["replies"] or [], key=lambda r: r["segment"])
                count, best = np.zeros((2, len(keys) + 1), np.int64)  # the last is of pairs that only texts without tokens have
                count[order] = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in replies] or [count[:0]])
                bits = [np.unpackbits(np.frombuffer(r["best"], np.uint8), count=len(r["counts"]) // 8) for r in replies]
                best[order] = np.concatenate(bits or [best[:0]])
                at = np.searchsorted(keys, own.links)
                at[np.append(keys, -1)[at] != own.links] = len(keys)
                chunk = np.repeat(np.arange(len(own.n_links)), own.n_links)
                count_sum, n_best = np.zeros((2, len(own.n_links)), np.int64)
                np.add.at(count_sum, chunk, count[at])
                np.add.at(n_best, chunk, best[at])
                columns = {
                    "n_a": own.n_a,
                    "n_b": own.n_b,
                    "n_groups": own.n_groups,
                    "n_links": own.n_links,
                    "n_best": n_best,
                    "count_sum": count_sum,
                }
                number = pa.array(row["text_no"], pa.int32())
                arrays = {"doc_id": pa.array(row["ids"], pa.int64())} | {k: pa.array(own.sums(v)).take(number) for k, v in columns.items()}
                written, codes, at, digests, groups = own.written(), own.codes.tolist(), 0, [], []
                for n, ok in zip(own.counts.tolist(), own.valid.tolist()):
                    text = b"".join([written[c] for c in codes[at : at + n]])[:-1] if ok else b""
                    digests.append(hashlib.sha256(text).hexdigest() if ok else "")
                    groups += [text.decode()] * with_groups
                    at += n
                arrays["groups_sha256"] = pa.array(digests, pa.string()).take(number)
                yield pa.RecordBatch.from_pydict(arrays | ({"groups": pa.array(groups, pa.string()).take(number)} if with_groups else {}))

    return blocks.join(replies, "block", "left").mapInArrow(applied, fields + (", groups string" if with_groups else ""))
