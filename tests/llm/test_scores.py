"""Exact top scores, importance resampling and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalharm.llm import alignment, exact_topk, importance, perfect_hash
from tests.llm import cases

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# ---- importance


def naive_features(text, max_run=2):
    words = WORD.findall((text or "").encode().lower())
    return len(words), [b" ".join(words[i : i + k]) for k in range(1, max_run + 1) for i in range(len(words) - k + 1)]


def naive_draw(rows, target, buckets=10_000, percent=25, min_words=20, seed=7):
    def bag(texts):
        return Counter(zlib.crc32(f) % buckets for t in texts for f in naive_features(t)[1])

    s, t = bag(r[1] for r in rows), bag(target)
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {
        b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in range(buckets)
    }
    out = []
    for i, text in rows:
        n_words, features = naive_features(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n_words, len(features), weight, score))
    fit = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(fit) // 100
    return out, fit, drawn


TARGET_SCHEMA = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType())])


def test_importance(spark, monkeypatch):
    monkeypatch.setattr(importance, "PIECE_BYTES", 700)  # long texts are read in pieces
    rows = cases.rows()
    target = [("a", rows[0][1]), ("b", None), ("c", rows[45][1]), ("d", "")]
    got = importance.draw(cases.documents(spark), spark.createDataFrame(target, TARGET_SCHEMA)).collect()
    want, fit, drawn = naive_draw([r[:2] for r in rows], [t for _, t in target])
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, n, w, s) for i, _, n, w, s in want)
    taken = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in taken] == list(range(1, drawn + 1)) and drawn > 5
    assert [(r.score, r.doc_id) for r in taken] == [(r[4], r[0]) for r in fit[:drawn]]
    assert importance.draw(cases.empty(spark), spark.createDataFrame(target, TARGET_SCHEMA)).count() == 0
    nothing = importance.draw(cases.documents(spark), spark.createDataFrame([], TARGET_SCHEMA)).collect()
    want, _, _ = naive_draw([r[:2] for r in rows], [])
    assert Counter((r.doc_id, r.weight) for r in nothing) == Counter((r[0], r[3]) for r in want)


def test_ranks_of_one_key_spread(spark):
    """A third of the rows share id, text and score: they are cut into ranges all the same."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS score")
    got = importance.ranked(rows, F.col("score").desc(), F.col("doc_id").asc_nulls_last()).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))
    by_rank = [r.score for r in sorted(got, key=lambda r: r["rank"])]
    assert by_rank == sorted(by_rank, reverse=True)


def test_crc_matrices():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 2, 3, 7, 7, 7, 40)))) for _ in range(500)] + [b"x" * 3000]
    size = np.array([len(t) for t in texts])
    got = importance.crc_by_length(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [zlib.crc32(t) for t in texts]
    for max_run in (1, 2, 3):
        words, counts, skip = b"a b a b c c a b".split(), [4, 0, 3, 1], 0
        got = Counter()
        for text, bucket in importance.runs_of(words, counts, max_run, 1 << 30, skip):
            got.update(zip(text.tolist(), bucket.tolist()))
        want, at = Counter(), 0
        for i, n in enumerate(counts):
            own = words[at : at + n]
            want.update((i, zlib.crc32(b" ".join(own[j : j + k])) % (1 << 30)) for k in range(1, max_run + 1) for j in range(n - k + 1))
            at += n
        assert got == want


# ---- exact top scores

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), *(T.StructField(n, T.StringType()) for n in ("c", "q", "v", "rank", "tau"))]
)


def naive_top(rows, dim, every, k, scale=64.0):
    own = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in own:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in own if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return Counter(out)


def test_exact_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 24)) / 5)]
    rows += [(600 + i, rows[40][1]) for i in range(250)]  # a third of the rows are one vector
    rows += [(900 + i, [0.0] * 24) for i in range(3)] + [(i, rows[7][1]) for i in (40, 7, 910)]  # repeated ids and rows
    rows += [(None, rows[3][1]), (920, None), (921, [None] * 24), (922, [math.nan] * 24), (923, [math.inf] * 24), (924, [1.0]), (925, [])]
    table = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], VECTORS).repartition(5)
    for options in ({}, {"k": 3, "tile_rows": 128, "seeds": 64, "block": 5}, {"seeds": 2}, {"scale": 1e12}):
        got = exact_topk.top_scores(table, **options)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        scale = options.get("scale", 64.0)
        if scale > 1e9:  # scores within 64 bits but beyond doubles' whole numbers
            small = [(i, v if v is None else [None if x is None else x / 1e4 for x in v]) for i, v in rows]
            got = exact_topk.top_scores(spark.createDataFrame([(*r, *["x"] * 5) for r in small], VECTORS), **options)
            assert Counter(map(tuple, got.collect())) == naive_top(small, 24, 20, 20, scale)
            continue
        assert Counter(map(tuple, got.collect())) == naive_top(rows, 24, 20, options.get("k", 20))
    assert exact_topk.top_scores(table.limit(0)).count() == 0
    few = exact_topk.top_scores(spark.createDataFrame([(20 * i, [0.1 * i, 1.0], *["x"] * 5) for i in range(4)], VECTORS)).collect()
    assert len(few) == 12  # all candidates, where they are fewer than k


def test_branch_and_bound_prunes():
    """Vectors of falling mass: most pairs end before the last block, none that matters."""
    rng = np.random.default_rng(2)
    rows = np.floor(64 * rng.normal(size=(4000, 64)) * 0.9 ** np.arange(64)).astype(np.int64)
    ids, order = np.arange(4000), np.arange(64)
    tau = exact_topk.thresholds(ids[:100], rows[:100], ids[:1000], rows[:1000], 20)
    tiles = exact_topk.Tile(ids[:100], rows[:100], order, 8), exact_topk.Tile(ids, rows, order, 8)
    at, found, score, ended = exact_topk.search(*tiles, tau, 20)
    assert ended < 0.1 * 100 * 4000
    full = rows[:100] @ rows.T
    full[np.arange(100), np.arange(100)] = np.iinfo(np.int64).min
    for i in range(100):
        want = sorted((-s, j) for j, s in enumerate(full[i].tolist()))[:20]
        assert [(-s, j) for s, j in zip(score[at == i].tolist(), found[at == i].tolist())] == want


# ---- alignment


def test_perfect_hash():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        levels = perfect_hash.unpacked(*perfect_hash.packed(perfect_hash.build(keys)))
        assert sorted(perfect_hash.numbers(keys, levels).tolist()) == list(range(len(keys)))
        other = perfect_hash.numbers(np.setdiff1d(rng.integers(0, 2**62, 100), keys), levels)
        assert ((other >= -1) & (other < max(1, len(keys)))).all()


def naive_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters, extra = {}, 0
    for x in range(256):
        if 33 <= x < 127 or 161 <= x < 173 or 174 <= x:
            letters[chr(x)] = x
        else:
            letters[chr(256 + extra)], extra = x, extra + 1

    def bytes_a(i):
        token = a.id_to_token(i)
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    done, count = [], Counter()
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        raw_a, raw_b = b"".join(map(bytes_a, ids_a)), b"".join(map(bytes_b, ids_b))
        if not text or not raw_a == raw_b == (" " + text).encode():
            done.append((i, None))
            continue
        spans_a, spans_b = [], []
        for ids, raw, spans in ((ids_a, bytes_a, spans_a), (ids_b, bytes_b, spans_b)):
            at = 0
            for t in ids:
                spans.append((at, at + len(raw(t)), t))
                at += len(raw(t))
        common = sorted({e for _, e, _ in spans_a} & {e for _, e, _ in spans_b})
        links, j = [], 0
        for x, y, t in spans_a:
            while spans_b[j][1] <= x:
                j += 1
            m = j
            while m < len(spans_b) and spans_b[m][0] < y:
                links.append((t, spans_b[m][2]))
                m += 1
        count.update(links)
        groups, before = [], 0
        for e in common:
            groups.append("|".join(",".join(str(t) for x, y, t in s if before < y <= e) for s in (spans_a, spans_b)) if len(spans_a) < 400 else "")
            before = e
        done.append((i, (len(ids_a), len(ids_b), len(common), links, ";".join(groups))))
    best = Counter()
    for (_, t), n in count.items():
        best[t] = max(best[t], n)
    out = []
    for i, x in done:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, groups = x
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a < 400 else None
        out.append((i, n_a, n_b, n_groups, len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), digest))
    return out


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SEGMENT_KEYS", 64)  # many segments, several levels of the tree
    monkeypatch.setattr(alignment, "FAN", 2)
    monkeypatch.setattr(alignment, "ASKING", 2)
    more = ["  two  spaces \n here  ", "tail ", " ", "a▁b", "ﬁ ligature Ａ full", "<s> </s> <|endoftext|> <unk> plain", "\x00\t\r\n x", "naïve café — “quoted” text's don't", "1234567 89,01", "mot" * 400, "é combined", "😀😀 smile", "　wide space  line"]
    rows = cases.rows() + [(200 + i, t, *cases.rows()[0][2:]) for i, t in enumerate(more)]
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = alignment.align_tokenizers(cases.documents(spark, rows), *paths).collect()
    want = naive_alignment([r[:2] for r in rows])
    assert Counter(tuple(r)[:7] for r in got) == Counter(w[:7] for w in want)
    digests = {w[0]: w[7] for w in want}
    for r in got:
        if digests[r.doc_id] is not None and r.doc_id not in (None, 7):
            assert r.groups_sha256 == digests[r.doc_id], r.doc_id
    assert alignment.align_tokenizers(cases.empty(spark), *paths).count() == 0


def test_written_groups():
    rng = np.random.default_rng(4)
    for n in (3, 70, 500):
        a, b = rng.integers(0, 50_000, n), rng.integers(0, 32_000, n + 5)
        last_a = np.unique(np.append(rng.integers(0, n, n // 3), n - 1))
        last_b = np.sort(rng.choice(n + 4, len(last_a) - 1, replace=False)) if len(last_a) > 1 else np.zeros(0, int)
        last_b = np.append(last_b, n + 4)
        want, i, j = "", 0, 0
        for x, y in zip(last_a + 1, last_b + 1):
            want += ",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])) + ";"
            i, j = x, y
        assert alignment._written(a, b, last_a, last_b).decode() == want


def test_short_ways_of_a_score_change_nothing():
    """A word is looked up only if a term begins like it, a token decoded only if it holds a disguise."""
    from signalharm.llm import toxicity as T

    odds = {"bad ": 3.0, "awfu": 2.5, "awful ": 4.0, "vile ": 2.0, "ÿber ": 2.2, "horribl": 5.0}
    model, channel = T.Model(odds, [-1.0, 0.5, 0.5, 0.5]), T.Channel([(g, 5) for g in range(0, 28**3, 7)])
    for word in ("bad", "ba", "badly", "awful", "awfully", "vile", "viler", "ÿber", "horrible", "", "a"):
        want = max(odds.get(word + " ", 0.0), *(odds.get(word[:n], 0.0) for n in T.STEMS if len(word) > n), 0.0)
        assert model.odds_of(word) == want, word
    tokens = ["Bad", "İstanbul", "b4d", "a.w.f.u.l", "x²y", "VILE", "good", "Awfully!", "3.14", "snake_case", "ß", "fool"]
    for token in tokens:
        out = set(T.WORD.findall(token.lower()))
        for m in T.LETTERS.finditer(token):
            if T.DISGUISED.search(m[0]):
                out |= T.decoded(m[0], channel)
        assert T.token_words(token, channel) == out, token
    texts = [" ".join(tokens[i:] + tokens[:i] + ["bad " * i]) for i in range(6)] + ["", "good", "a w f u l"]
    first = [model.score(t, channel) for t in texts]
    assert "Bad" in model.hits and "good" in model.known and "good" not in model.hits
    assert first == [model.score(t, channel) for t in texts] == [T.Model(odds, model.weights).score(t, channel) for t in texts]
    assert first[0][0] > first[-2][0]
