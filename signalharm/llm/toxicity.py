"""Toxicity of texts after a noisy-channel restoration.

Writers hide words by digits and symbols for letters, by spaces between letters
and by repetition.  A stretch with a symbol, a mark between letters or a letter twice
becomes a lattice: each character stands for itself or for letters it may
replace, marks and repeats may stand for nothing, and in letters parted by spaces
a word may end anywhere.  Viterbi finds the reading that a character trigram model of
the corpus likes best, given the channel's costs.  Words and word beginnings of
the written and the restored text then give the features of a logistic score.
"""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalharm.llm.common import map_texts, slices, stored

#: The classifier is fitted on at most this many labelled rows, chosen by a hash of the id.
FIT_ROWS = 20_000
#: Terms of the model at most, those with the largest likelihood ratios.
TERMS = 5000
#: A term needs this log odds ratio, likelihood ratio, and share of the toxic rows.
MIN_ODDS, MIN_RATIO, MIN_SHARE = 2.0, 15.0, 0.004
STEMS = (4, 5, 6, 7)
#: Character classes of the trigram model: 0 what is no letter, 1-26 a-z, 27 other letters.
CLASSES = 28
#: Letters that a character may stand for.
LEET = {
    "4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "il",
    "|": "l", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z",
}
#: Marks that may stand between letters for nothing.
MARKS = "._*-/~'"
#: Natural-log costs: a symbol for a letter, a mark or a repeat for nothing, a symbol for nothing, a third letter kept,
#: a break between two words that is not written.
SUBSTITUTE, DROP, LOSE, KEEP, BREAK = 1.0, 0.2, 2.5, 1.5, 1.0
WORD = re.compile(r"[^\W\d_]+")
#: What the decoder reads: a symbol or digit that may be a letter, a mark between letters, a letter twice.
DISGUISED = re.compile(r"[0-9@$!|(#+]|[A-Za-z][._*/~'-]+(?=[A-Za-z])|([A-Za-z])\1")
LETTERS = re.compile(r"[A-Za-z0-9@$!|(#+._*/~'-]+")
#: Longer stretches are decoded in windows of so many characters; neighbours share OVERLAP.
WINDOW, OVERLAP = 96, 32
#: Tokens that a worker remembers before it starts anew, and the longest that it remembers.
MEMORY, LONGEST = 200_000, 64


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for i in range(256):
        c = bytes([i]).decode("latin-1").lower()
        out[i] = ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() or i == 63 else 0
    out[63] = 0
    return out


CODE = _classes()


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, n: character trigram counts over all texts."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                raw = "  ".join(t for t in part.column("text").to_pylist() if t).encode("latin-1", "replace")
                c = CODE[np.frombuffer(b"  " + raw + b"  ", np.uint8)]
                total += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": at, "n": total[at]})

    own = docs.select(F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Channel:
    """Restores stretches of text under a trigram model (log probabilities, shape 28 x 28 x 28)."""

    def __init__(self, grams: list[tuple[int, int]]):
        count = np.full(CLASSES**3, 0.1)
        for g, n in grams:
            count[g] += n
        count = count.reshape(CLASSES, CLASSES, CLASSES)
        self.log = np.log(count / count.sum(axis=2, keepdims=True)).tolist()
        self.known: dict[tuple[str, bool], list[str]] = {}

    def restore(self, written: str, breaks: bool = False) -> list[str]:
        """The words of the likeliest reading; ``breaks``: words may part where nothing is written."""
        key = (written, breaks)
        found = self.known.get(key)
        if found is None:
            found = self._viterbi(written.lower(), breaks)[1].split()
            if len(written) <= LONGEST:
                if len(self.known) > MEMORY:
                    self.known.clear()
                self.known[key] = found
        return found

    def _viterbi(self, s: str, breaks: bool = False) -> tuple[float, str]:
        """Score and text of the best path.  A state is the last two classes (0: a word's edge)."""
        log = self.log
        best = {(0, 0): (0.0, "")}
        for c in s:
            plain = "a" <= c <= "z"
            options = [(ord(c) - 96, c, 0.0)] if plain else [(ord(x) - 96, x, SUBSTITUTE) for x in LEET.get(c, "")]
            nothing = None if plain else DROP if c in MARKS or not options else LOSE
            if breaks:  # a word may end before this character
                for (p, q), (score, text) in list(best.items()):
                    if q:
                        ended = score - BREAK + log[p][q][0]
                        if (q, 0) not in best or ended > best[q, 0][0]:
                            best[q, 0] = (ended, text + " ")
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (p, q), (score, text) in best.items():
                if nothing is not None and ((p, q) not in after or score - nothing > after[p, q][0]):
                    after[p, q] = (score - nothing, text)
                for k, x, cost in options:
                    if k == q:  # a repeat may stand for nothing; keeping a third one is dear
                        if (p, q) not in after or score - DROP > after[p, q][0]:
                            after[p, q] = (score - DROP, text)
                        cost += KEEP * (p == q)
                    total = score - cost + log[p][q][k]
                    if (q, k) not in after or total > after[q, k][0]:
                        after[q, k] = (total, text + x)
            best = after
        return max((score + (log[p][q][0] if q else 0.0), text) for (p, q), (score, text) in best.items())


def decoded(stretch: str, channel: Channel, breaks: bool = False) -> set[str]:
    """Words of a stretch of any length, read in overlapping windows."""
    out: set[str] = set()
    for i in range(0, max(1, len(stretch) - OVERLAP), WINDOW - OVERLAP):
        out.update(channel.restore(stretch[i : i + WINDOW], breaks))
    return out


def token_words(token: str, channel: Channel) -> set[str]:
    """Words of one token as written, and as restored where anything in it may stand for something else."""
    out = {token.lower()} if token.isascii() and token.isalpha() else set(WORD.findall(token.lower()))
    if not DISGUISED.search(token):  # then no stretch of it is
        return out
    for m in LETTERS.finditer(token):
        if DISGUISED.search(m[0]):
            out |= decoded(m[0], channel)
    return out


def spaced(tokens: list[str]) -> list[str]:
    """Stretches of three or more single characters between spaces, put together."""
    out, run = [], []
    for i in [i for i, t in enumerate(tokens) if len(t) == 1]:
        if run and run[-1] + 1 != i:
            out += ["".join(tokens[j] for j in run)] * (len(run) >= 3)
            run = []
        run.append(i)
    return out + ["".join(tokens[j] for j in run)] * (len(run) >= 3)


def words_of(text: str, channel: Channel) -> set[str]:
    """Distinct words of the written and the restored text."""
    tokens = text.split()
    out = set().union(*(token_words(t, channel) for t in set(tokens)))
    return out.union(*(decoded(x, channel, True) for x in spaced(tokens)))


def terms_of(words: set[str]) -> set[str]:
    """Whole words (marked by a closing space) and their beginnings."""
    return {w + " " for w in words} | {w[:n] for n in STEMS for w in words if len(w) > n}


class Model:
    """Log odds of terms and the weights of three sums over them."""

    def __init__(self, odds: dict[str, float], weights: list[float]):
        self.odds, self.weights = odds, weights
        self.heads = {t.removesuffix(" ")[: STEMS[0]] for t in odds}
        #: Tokens read, and those among them that hold words of the model.
        self.known: set[str] = set()
        self.hits: dict[str, tuple] = {}

    def odds_of(self, word: str) -> float:
        """The largest log odds of a word and its beginnings; 0 without."""
        if word[: STEMS[0]] not in self.heads:  # no term begins so
            return 0.0
        odds = self.odds
        return max(odds.get(word + " ", 0.0), *(odds.get(word[:n], 0.0) if len(word) > n else 0.0 for n in STEMS))

    def sums(self, words: set[str]) -> list[float]:
        """Intercept; largest log odds; log of the hit words; log of their odds' sum."""
        return self._sums({w: d for w in words if (d := self.odds_of(w))})

    @staticmethod
    def _sums(hits: dict[str, float]) -> list[float]:
        return [1.0, max(hits.values(), default=0.0), math.log1p(len(hits)), math.log1p(sum(hits.values()))]

    def score(self, text: str, channel: Channel) -> tuple[float, int]:
        """The text's score and its disguised stretches; a token is read once while it is remembered."""
        tokens, known = text.split(), self.known
        if len(known) > MEMORY:
            known.clear()
            self.hits.clear()
        hits: dict[str, float] = {}
        parts = spaced(tokens)
        distinct = {*tokens}
        fresh = distinct - known
        for t in self.hits.keys() & distinct:
            hits.update(self.hits[t])
        for t in fresh:
            found = tuple((w, d) for w in token_words(t, channel) if (d := self.odds_of(w)))
            hits.update(found)
            if len(t) <= LONGEST:
                known.add(t)
                if found:
                    self.hits[t] = found
        hits.update({w: d for x in parts for w in decoded(x, channel, True) if (d := self.odds_of(w))})
        z = sum(a * b for a, b in zip(self.weights, self._sums(hits)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(parts)


def held_out(doc_id: F.Column) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> tuple[Channel, Model]:
    """The trigram model of all texts, and a classifier of labelled rows that are not held out."""
    channel = Channel([(r.gram, r.n) for r in char_counts(docs, text_col).collect()])  # 28 cubed rows at most
    own = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = stored(own.orderBy(F.xxhash64("label_id"), "label_id").limit(fit_rows), "fit-labels")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    train = texts.join(F.broadcast(own), F.col("doc_id") == F.col("label_id"))  # at most fit_rows rows

    def read(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict(
                    {
                        "text_hash": [zlib.crc32(t.encode()) | len(t) << 32 for t in texts],
                        "toxic": part.column("toxic"),
                        "words": [sorted(words_of(t, channel)) for t in texts],
                    }
                )

    # copies would make their every word look toxic: a text counts once
    train = train.mapInArrow(read, "text_hash long, toxic int, words array<string>").dropDuplicates(["text_hash"])
    train = stored(train, "fit-words")

    def counted(batches):
        found: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist()):
                for term in terms_of(set(words)):
                    found.setdefault(term, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_pydict(
            {"term": list(found), "clean": [x[0] for x in found.values()], "toxic": [x[1] for x in found.values()]},
            schema=pa.schema([("term", pa.string()), ("clean", pa.int64()), ("toxic", pa.int64())]),
        )

    size = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:  # nothing to tell apart: the share of the only class is the score
        return channel, Model({}, [3.0 if n1 else -3.0, 0.0, 0.0, 0.0])
    counts = train.mapInArrow(counted, "term string, clean long, toxic long")
    counts = counts.groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") + 0.5) / (n0 + 1.0))
    both = (F.col("t") + F.col("c")) / float(n1 + n0)
    ratio = 2 * F.col("t") * F.log(F.col("t") / n1 / both) + F.when(F.col("c") > 0, 2 * F.col("c") * F.log(F.col("c") / n0 / both)).otherwise(0.0)
    chosen = counts.where(F.col("t") >= max(3, math.ceil(MIN_SHARE * n1))).select("term", odds.alias("odds"), ratio.alias("ratio"))
    chosen = chosen.where((F.col("odds") >= MIN_ODDS) & (F.col("ratio") >= MIN_RATIO)).orderBy(F.desc("ratio"), "term").limit(TERMS)
    model = Model({r.term: r.odds for r in chosen.collect()}, [0.0] * 4)

    def summed(batches):
        for batch in batches:
            x = [model.sums(set(w)) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "y"])

    rows = train.mapInArrow(summed, "x array<double>, y int").collect()  # at most fit_rows rows of four numbers
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - 0.1 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w.tolist()
    return channel, model


def toxicity(docs: DataFrame, channel: Channel, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), n_spaced (stretches of
    spaced letters).

    Null and empty texts have no words and get the score of a text without hits.
    Stretches of any length are decoded, the long ones in overlapping windows.
    A null id counts as the text "" and so as held out.  Repeated rows are
    scored each.  Other columns are not read.
    """

    def make():
        def step(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            scores = [model.score(t, channel) for t in texts]
            return {
                "score": [s for s, _ in scores],
                "predicted": [int(s >= 0.5) for s, _ in scores],
                "n_spaced": [n for _, n in scores],
            }

        return step

    out = map_texts(docs, id_col, text_col, {"score": "double", "predicted": "int", "n_spaced": "long"}, make)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_spaced")
