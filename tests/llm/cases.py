"""Rows that every operator must bear, and brute-force versions."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        *(T.StructField(n, T.StringType()) for n in ("block", "slot", "words", "fp", "item", "score", "hit_id", "spans")),
    ]
)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    shared, line = sentence(rng, 70), sentence(rng, 55)
    texts = [sentence(rng, rng.randint(5, 200)) for _ in range(30)]
    texts += [texts[0], texts[0], texts[1] + " more", None, "", "   \n ", "one", "same " * 300, "same " * 120]
    texts += [f"{sentence(rng, 9)} {shared} {sentence(rng, 30)}" for _ in range(12)]
    texts += [f"{line}\n{shared}", sentence(rng, 4000) + " " + line, "漢字 " * 80 + line + "\x00 <s> <|endoftext|> tail  \t x"]
    out = [(i, t, "en", f"s{i % 3}" if i % 5 else "s0", 0) for i, t in enumerate(texts)]
    out += [(7, texts[7], "en", "s1", 0), (None, texts[3], None, None, None), (None, None, None, None, None)]
    return [(*r, *(["x"] * 8)) for r in out]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
