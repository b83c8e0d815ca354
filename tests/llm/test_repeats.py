"""Byte and word repeats against brute force."""

import hashlib

import pytest

from signalharm.llm import substring_dedup, suffix_dedup
from tests.llm import cases

LAST = 1 << 62


def brute(data, length, unit):
    """(id, units, removed, digest of the rest) of each row."""
    seqs = [(r[0] if r[0] is not None else LAST, unit(r[1] or "")) for r in data]
    first = {}
    for i, w in seqs:
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            first[key] = min(i, first.get(key, LAST))
    out = []
    for i, w in seqs:
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        left = [x for x, g in zip(w, gone) if not g]
        kept = bytes(left) if isinstance(w, bytes) else b" ".join(left)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, gram, parts", [(50, 10, 4), (50, 10, 1), (6, 2, 4)])
def test_word_passages(spark, length, gram, parts):
    docs = cases.documents(spark).repartition(parts)
    got = substring_dedup.remove_repeated_passages(docs, length=length, gram=gram).collect()
    found = sorted((r.doc_id if r.doc_id is not None else LAST, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert found == brute(cases.rows(), length, lambda t: t.encode().split())
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("length, gram, batch", [(50, 16, 1 << 20), (50, 16, 500), (9, 4, 2000)])
def test_byte_strings(spark, length, gram, batch):
    got = suffix_dedup.remove_repeated_strings(cases.documents(spark), length=length, gram=gram, batch_size=batch).collect()
    found = sorted((r.doc_id if r.doc_id is not None else LAST, r.n_bytes, r.n_removed, r.kept_sha256) for r in got)
    assert found == brute(cases.rows(), length, str.encode)


def test_texts_left(spark):
    a, b = "x" * 60 + "first", "start" + "x" * 60
    data = [(1, a, *cases.rows()[0][2:]), (2, b, *cases.rows()[0][2:])]
    got = suffix_dedup.remove_repeated_strings(cases.documents(spark, data), with_bytes=True).collect()
    assert {r.doc_id: (bytes(r.kept), r.n_spans) for r in got} == {1: (a.encode(), 0), 2: (b"start", 1)}
    words = " ".join(f"w{i}" for i in range(60))
    data = [(1, words, *cases.rows()[0][2:]), (2, "head " + words + " tail", *cases.rows()[0][2:])]
    got = substring_dedup.remove_repeated_passages(cases.documents(spark, data), with_text=True).collect()
    assert {r.doc_id: (r.kept_text, r.n_spans) for r in got} == {1: (words, 0), 2: ("head tail", 1)}


def test_empty(spark):
    assert suffix_dedup.remove_repeated_strings(cases.empty(spark)).count() == 0
    assert substring_dedup.remove_repeated_passages(cases.empty(spark)).count() == 0


def test_levels_grow_geometrically():
    import numpy as np

    index, rng, held = suffix_dedup.LogIndex(), np.random.default_rng(1), {}
    for i in range(40):
        lead = rng.integers(0, 300, 50).astype(np.uint64)
        least = index.add(lead, lead, np.full(50, i, np.int64))
        for x, m in zip(lead.tolist(), least.tolist()):
            assert m == held.setdefault(x, i)
    sizes = [len(x) for x in index.levels]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) <= 6


def test_shuffled_replies(spark, monkeypatch):
    from signalharm.llm import repeats

    got = substring_dedup.remove_repeated_passages(cases.documents(spark)).collect()
    found = sorted((r.doc_id if r.doc_id is not None else LAST, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert found == brute(cases.rows(), 50, lambda t: t.encode().split())


@pytest.mark.parametrize("limits", [(1, 1024), (0, 1024), (4, 2)])
def test_hot_anchors(spark, monkeypatch, limits):
    from signalharm.llm import repeats

    monkeypatch.setattr(repeats, "HOT_BLOCKS", limits[0])
    monkeypatch.setattr(repeats, "HOT_WINDOWS", limits[1])
    docs = cases.documents(spark)
    got = substring_dedup.remove_repeated_passages(docs).collect()
    found = sorted((r.doc_id if r.doc_id is not None else LAST, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert found == brute(cases.rows(), 50, lambda t: t.encode().split())
    got = suffix_dedup.remove_repeated_strings(docs).collect()
    found = sorted((r.doc_id if r.doc_id is not None else LAST, r.n_bytes, r.n_removed, r.kept_sha256) for r in got)
    assert found == brute(cases.rows(), 50, str.encode)


def test_a_hot_window_is_sent_once_a_block(spark, monkeypatch):
    import numpy as np

    from signalharm.llm import repeats

    monkeypatch.setattr(repeats, "HOT_WINDOWS", 10)

    passage = " ".join(f"w{i}" for i in range(60))
    data = [(i, f"a{i} {passage} z{i}", *cases.rows()[0][2:]) for i in range(200)]
    blocks = repeats.pack(cases.documents(spark, data).coalesce(2), "doc_id", "text")
    shared = repeats.shared_anchors(blocks, repeats.word_symbols, 50, 10, 8)
    cool = repeats.with_shared(blocks, shared).collect()
    assert not any(len(repeats.shared_runs(r.asDict(True), repeats.word_symbols, 50, 10, 8, False)[1]) for r in cool)
    sent = repeats.hot_windows(blocks, shared, repeats.word_symbols, 50, 10, 8, lambda block, anchor, at: anchor).collect()
    times = {}
    for r in sent:
        for h in np.frombuffer(r.rests, np.uint64).tolist():
            times[h] = times.get(h, 0) + 1
    # 11 windows inside the passage once a block, and at most two a document around it
    assert max(times.values()) == len(cool)
    assert 11 * len(cool) <= sum(times.values()) <= 11 * len(cool) + 2 * len(data)
    assert len({r.bucket for r in sent}) == 8
