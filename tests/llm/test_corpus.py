"""Decontamination, mixing, toxicity and the pipeline."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from signalharm.llm import common, decontaminate, mixing, toxicity
from signalharm.llm.common import table, without
from tests.llm import cases

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(data, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[p : p + n])].add("null" if item is None else str(item))
    out = []
    for r in data:
        w, hit, found = words(r[1]), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if own := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((-1 if r[0] is None else r[0], len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_contamination(spark, limit):
    data, rng = cases.rows(), random.Random(4)
    long = words(data[50][1])
    items = [(1, " ".join(data[3][1].split()[:40])), (2, "Same same " * 10), (3, None), (4, "... !!"), (5, "one"), (None, " ".join(long[100:115]))]
    items += [(6, " ".join(words(data[4][1])[2:9])), (7, cases.sentence(rng, 30)), (8, " ".join(data[3][1].split()[:40])), (8, "same")]
    items += [("9", " ".join(words(data[5][1])[:13]).upper() + " " + "x" * 5)]
    bench = spark.createDataFrame([(None if i is None else str(i), t, "x") for i, t in items], "item_id string, text string, words string")
    got = decontaminate.contamination(cases.documents(spark), bench, broadcast_rows=limit).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert found == brute_contamination(data, items)
    assert any(r.contaminated for r in got)


def test_contamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(cases.documents(spark), bench).collect()
    assert len(got) == len(cases.rows()) and not any(r.n_hit for r in got)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(cases.empty(spark), some).count() == 0


def edf(shares, slots):
    """Slots of one period, one after the other."""
    done, out = dict.fromkeys(shares, 0), []
    for t in range(slots):
        ready = [(-(-(done[s] + 1) * slots // a), s) for s, a in sorted(shares.items()) if done[s] < a and done[s] * slots // a <= t]
        _, s = min(ready)
        out.append((s, done[s], t))
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 5.0, "b": 1.0, "c": 2.5}, {f"s{i}": 1.0 + (i == 3) * 9 for i in range(17)}])
def test_schedule(spark, weights):
    slots = 60
    plan = mixing.shares(spark.createDataFrame(list(weights.items()), "source string, weight double"), slots)
    shares = {r.source: r.share for r in plan.collect()}
    assert sum(shares.values()) == slots and set(shares) == set(weights)
    got = sorted(((r.source, r.turn, r.slot_in_period) for r in mixing.period(plan).collect()), key=lambda r: r[2])
    assert got == edf(shares, slots)
    done = dict.fromkeys(shares, 0)
    for s, _, t in got:  # less than one block away from the weight after every slot
        done[s] += 1
        assert all(abs(done[x] - (t + 1) * a / slots) < 1 for x, a in shares.items())


def test_mixture(spark):
    data = cases.rows() + [(1000 + i, "t", "en", "s0", 0, *(["x"] * 8)) for i in range(300)]
    got = mixing.mixture(cases.documents(spark, data), slots=40, block_rows=4).collect()
    assert len(got) == len(data)
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source, r.block] += 1
    last = {s: max(b for x, b in sizes if x == s) for s, _ in sizes}
    assert all(n == 4 for (s, b), n in sizes.items() if b < last[s])
    assert {r.source for r in got} == {"s0", "s1", "s2", ""}
    assert all(r.in_mix for r in got if r.source != "s0") and not all(r.in_mix for r in got)
    assert mixing.mixture(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mixture(cases.documents(spark), spark.createDataFrame([("s0", 1.0)], "source string, weight double"))
    flat = spark.createDataFrame([("s0", 1.0), ("s1", 1.0), ("s2", 1.0), ("", 1.0)], "source string, weight double")
    assert mixing.mixture(cases.documents(spark), flat).count() == len(cases.rows())


BAD = ("idiot", "moron", "dreckig")


def toxic_rows(n=1200, seed=9):
    rng, data, labels = random.Random(seed), [], []
    for i in range(n):
        text, toxic = cases.sentence(rng, 40), int(i % 8 == 0)
        if toxic:
            own = text.split()
            for _ in range(3):
                w = rng.choice(BAD)
                w = rng.choice([w, w, w.replace("o", "0").replace("i", "1"), " ".join(w), w[:2] + w[2] * 3 + w[3:]])
                own.insert(rng.randrange(len(own)), w)
            text = " ".join(own)
        data.append((i, text, "en", "s", 0, *(["x"] * 8)))
        if i % 10 != 7:
            labels.append((i, toxic))
    return data, labels


def test_toxicity(spark):
    data, labels = toxic_rows()
    docs = cases.documents(spark, data + cases.rows()[-8:])
    marks = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    channel, model = toxicity.fit(docs, marks)
    got = toxicity.toxicity(docs, channel, model).collect()
    assert len(got) == len(data) + 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = dict(labels)
    test = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id < len(data)]
    assert len(test) > 150
    assert sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.97
    for text in ("d u m i d i o t", "1d10t", "iiidiottt", "i.d.i.o.t"):
        assert any("idiot" in w for w in toxicity.words_of(f"abc {text} abc", channel)), text
    assert toxicity.toxicity(cases.empty(spark), channel, model).count() == 0


def test_toxicity_without_labels(spark):
    docs = cases.documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, *toxicity.fit(docs, none)).collect()
    assert len(got) == len(cases.rows()) and not any(r.predicted for r in got)
    got = toxicity.toxicity(cases.empty(spark), *toxicity.fit(cases.empty(spark), none))
    assert got.count() == 0


def test_without(spark):
    docs = cases.documents(spark)
    left = without(docs, spark.createDataFrame([(7,), (None,), (7,)], "doc_id long"))
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r[0] for r in cases.rows() if r[0] not in (7, None))


def test_pipeline(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0.5 * before < docs.count() <= before, name
        before = docs.count()
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(texts.values())) == len(texts)  # no exact copies
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert not any(x[5] for x in brute_contamination([(i, t) for i, t in texts.items()], items))
    toxic = {r.doc_id for r in table(spark, sf, "labels").where("toxic = 1").collect()}
    assert len(kept & toxic) < 0.5 * len(toxic)  # a few hundred rows to learn from
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in final) == sorted(kept)
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path, monkeypatch):
    rng, sf = random.Random(4), str(tmp_path)
    passage, other, third, *plain = (cases.sentence(rng, 40) for _ in range(8))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = lambda stage, rows: sorted(stage(spark, frame(rows), sf).collect(), key=str)
    clean = [(None, plain[0], "a"), (None, plain[1], "a"), (5, plain[2], "a"), (5, plain[3], "a")]
    got = left(corpus_pipeline.drop_contaminated, clean + [(None, passage, "a"), (5, passage, "a")])
    assert sorted(r.text for r in got) == sorted(x[1] for x in clean)
    got = left(corpus_pipeline.drop_near_duplicates, clean + [(8, other, "a"), (9, other, "a"), (None, other, "a"), (8, other, "a"), *[(None, third, "a")] * 3])
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(x[0] or 0, x[1]) for x in clean] + [(8, other), (0, third)])
    model = toxicity.Model({"idiot ": 9.0}, [-3.0, 2.0, 0.0, 0.0])
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: (toxicity.Channel([]), model))
    got = left(corpus_pipeline.drop_toxic, clean + [(None, "you idiot", "a"), (5, "an idiot", "a")])
    assert sorted(r.text for r in got) == sorted(x[1] for x in clean)
    many = frame([(None, f"t{i}", "a" if i < 2000 else "b") for i in range(2300)])
    want = mixing.mixture(many).where("in_mix").count()
    assert corpus_pipeline.mix_sources(spark, many, sf).count() == want and 0 < want < 2300


def test_pipeline_on_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def trained_channel(spark):
    text = " ".join(["you are an idiot and a stupid fool", "the letter will tell a little story", "well good food is all we need"] * 60)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return toxicity.Channel([(r.gram, r.n) for r in toxicity.char_counts(docs).collect()])


def best_reading(s, channel, breaks):
    """The best score over all readings, one by one."""
    t, log = toxicity, channel.log

    def walk(i, p, q):
        if i == len(s):
            return log[p][q][0] if q else 0.0
        c, best = s[i], -math.inf
        plain = "a" <= c <= "z"
        letters = [(c, 0.0)] if plain else [(x, t.SUBSTITUTE) for x in t.LEET.get(c, "")]
        starts = [(0.0, p, q)] + ([(log[p][q][0] - t.BREAK, q, 0)] if breaks and q else [])
        for own, a, b in starts:
            if not plain:
                best = max(best, own - (t.DROP if c in t.MARKS or not letters else t.LOSE) + walk(i + 1, a, b))
            for x, cost in letters:
                k = ord(x) - 96
                if k == b:
                    best = max(best, own - t.DROP + walk(i + 1, a, b))
                    cost += t.KEEP * (a == b)
                best = max(best, own - cost + log[a][b][k] + walk(i + 1, b, k))
        return best

    return walk(0, 0, 0)


def test_viterbi_finds_the_best_reading(spark):
    channel, rng = trained_channel(spark), random.Random(2)
    for breaks in (False, True):
        for _ in range(60):
            s = "".join(rng.choice("aidot1l0.-s5!t~") for _ in range(rng.randint(0, 7)))
            assert channel._viterbi(s, breaks)[0] == pytest.approx(best_reading(s, channel, breaks))


def test_disguises_are_restored(spark):
    channel = trained_channel(spark)
    for text in ("1diot", "idio7", "i.d.i.o.t", "i/d/i/o/t", "iiddiioott", "id-iot", "idiot!", "!d!ot", "i d i o t", "!D10T"):
        assert "idiot" in toxicity.words_of(f"abc {text} abc", channel), text
    for text in ("5tupid", "$tupid", "st-up-id", "s_t_u_p_i_d", "stupiiiid"):
        assert "stupid" in toxicity.words_of(text, channel), text
    assert {"you", "an", "idiot"} <= toxicity.words_of("y o u a r e a n i d i o t", channel)
    long = " ".join("theletterwilltellalittlestory" * 40 + "idiot" + "wellgoodfood" * 40)  # far more than one window
    assert "idiot" in toxicity.words_of(long, channel)
    assert "idiot" in toxicity.words_of("the.letter.will.tell." * 30 + "1d10t" + ".well.good.food" * 30, channel) | toxicity.words_of("1d10t", channel)
    assert {"letter", "will", "little"} <= toxicity.words_of("the letter will tell a little story", channel)


def test_noted_paths_of_equal_lists(spark):
    with common.noted_paths() as outer:
        with common.noted_paths() as inner:
            common.stored(spark.range(2), "a")
        common.stored(spark.range(3), "b")
    common.stored(spark.range(4), "c")
    assert len(inner) == 1 and len(outer) == 2 and outer[0] == inner[0]
