"""Secrets in texts: fixed patterns plus a token-efficiency test.

A tokenizer trained on prose packs words and names into few tokens; random
strings fall apart.  A run of key characters whose characters per token stay
below ``MAX_RATIO`` is a random string, unless it is a digest of a known length
or an identifier: a UUID, a number (no letters), a one-case or capitalised word.
CamelCase and snake_case of ordinary words pass the ratio by themselves.
"""

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from signalharm.llm.common import map_texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
MAX_RATIO = 2.2
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=2)
def load(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three fixed patterns, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def known(run: str) -> bool:
    """Digests and identifiers."""
    if DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run):
        return True
    return not any(c.isalpha() for c in run) or WORD.fullmatch(run) is not None


def random_spans(text: str, taken: list[tuple[int, int, int]], encoding, max_ratio: float) -> list[tuple[int, int, int]]:
    """Runs that the vocabulary can't compress and that no fixed pattern overlaps."""
    out = []
    for m in RUN.finditer(text):
        a, b = m.span()
        if known(m[0]) or any(s < b and a < e for s, _, e in taken):
            continue
        if b - a < max_ratio * len(encoding.encode_ordinary(m[0])):
            out.append((a, 3, b))
    return out


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
) -> DataFrame:
    """One row per input row: id, counts by kind, digest of the fixed spans, all spans.

    Offsets are code points, ends exclusive.  Null is an empty text: no spans.
    Repeated rows are scanned each; other columns are not read.
    """

    def make():
        encoding = load(vocabulary, pattern)

        def step(part: pa.RecordBatch) -> dict:
            base, extra = [], []
            for text in part.column("text").to_pylist():
                base.append(base_spans(text or ""))
                extra.append(random_spans(text or "", base[-1], encoding, max_ratio))
            return {
                **{f"n_{KINDS[k]}": [sum(x[1] == k for x in b) for b in base] for k in range(3)},
                "base_sha256": [hashlib.sha256(_joined(b).encode()).hexdigest() for b in base],
                "spans": [_joined(sorted(b + e)) for b, e in zip(base, extra)],
                "n_random": [len(e) for e in extra],
            }

        return step

    fields = {f"n_{k}": "long" for k in KINDS[:3]} | {"base_sha256": "string", "spans": "string", "n_random": "long"}
    return map_texts(docs, id_col, text_col, fields, make)
