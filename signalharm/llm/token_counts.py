"""Exact token counts of whole texts with a sentencepiece BPE model.

Short texts are encoded as they are.  Huge ones are encoded as overlapping
chunks with offsets; two neighbours are spliced at a token start that both have
and that is proven stable: no vocabulary piece holds the two characters beside
it in this order, so no merge can ever cross it.  Where an overlap has no such
boundary it is doubled, in the end to the rest of the text.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from signalharm.llm.common import map_texts

SPACE = "▁"
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256


@lru_cache(maxsize=2)
def load(path: str):
    """The model and the set of adjacent character pairs inside its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pairs = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            pairs.update(map("".join, zip(piece, piece[1:])))
    return model, pairs


def _starts(model, text: str, begin: int, end: int) -> list[int]:
    """Offsets in ``text`` of the tokens of its part; the dummy prefix stands at ``begin``."""
    raw = np.frombuffer(text[begin:end].encode(), np.uint8)
    # the library gives bytes: number the characters by their first bytes
    chars = begin - 1 + np.cumsum((raw & 0xC0) != 0x80)
    at = np.array([p.begin for p in model.encode(text[begin:end], return_type="proto").pieces], dtype=np.int64)
    return chars[at].tolist() if len(at) else []


def count_long(text: str, model, pairs: set[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text`` from overlapping chunks; equal to encoding it whole."""
    n, total, wide, more = len(text), 0, overlap, chunk
    cut = 0  # a proven boundary: tokens before it are counted
    end = min(chunk, n)
    starts = _starts(model, text, 0, end)
    while end < n:
        first = max(0, cut - 1)  # one character more keeps a chunk's dummy prefix before the cut
        begin, stop = max(first, end - wide), min(n, end + more)
        following = _starts(model, text, begin, stop)
        stable = [
            p
            for p in set(starts).intersection(following)
            if max(cut, begin) < p < end and text[p - 1 : p + 1].replace(" ", SPACE) not in pairs
        ]
        if stable:
            splice = max(stable)
            total += sum(cut <= s < splice for s in starts)
            cut, starts, end, wide, more = splice, following, stop, overlap, chunk
        elif begin > first:
            wide *= 2
        else:  # no boundary back to the last cut: go on from there, twice as far
            starts, end, more = following, stop, 2 * more
    return total + sum(cut <= s for s in starts)


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, n_chunks.

    Null and empty texts have 0 tokens.  Long texts are spliced from chunks; a
    stretch without any proven boundary is encoded again at most as often as its
    length doubles.  Repeated rows are counted each; a null
    id stays null; other columns are not read.
    """

    def make():
        model, pairs = load(model_path)

        def step(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            short = [t for t in texts if len(t) <= chunk]
            counts = iter([len(x) for x in model.encode(short, num_threads=1)] if short else [])
            tokens = [next(counts) if len(t) <= chunk else count_long(t, model, pairs, chunk, overlap) for t in texts]
            return {
                "n_bytes": pa.compute.binary_length(part.column("text")).cast(pa.int64()).fill_null(0),
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
                "n_chunks": [max(1, -(-len(t) // chunk)) for t in texts],
            }

        return step

    fields = {"n_bytes": "long", "n_tokens": "long", "over_limit": "boolean", "n_chunks": "long"}
    return map_texts(docs, id_col, text_col, fields, make)
