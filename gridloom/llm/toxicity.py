"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a general and of a learned lexicon (words and word beginnings), nearness of
lexicon words to second-person pronouns, capitals, punctuation, and obfuscation (lexicon words that appear only once
digits and symbols are read as letters, separators dropped or repeats shortened). The lexicon entries, the trees and
the calibration are learned from labelled rows whose crc32(doc_id) mod 5 is not 0, of which FIT_ROWS at most, chosen by
hash, are used; labels, lang, source and doc_id are never inputs of a score.

Cases: null text is empty; empty texts get a score like any other; null doc_id is not held out and never learned from;
null labels are skipped, repeated labels count as toxic if one of them is; without both classes every score is the
share of toxic labels (0 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let_go, small_batches, table

#: Labelled rows that are learned from, at most.
FIT_ROWS = 16_000
#: Learned lexicon entries, at most.
LEXICON_ROWS = 400
#: Toxic documents that a learned entry must be in.
MIN_DOCS = 4
STEMS = range(4, 8)
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32
GENERAL = frozenset(
    "idiot idiots stupid moron morons scum loser losers trash worthless pathetic disgusting clown clowns dumb fool ugly hate kill die shut garbage vermin filth filthy freak coward imbecile retard jerk creep liar disgrace".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te ti toi tú vos usted ustedes vous votre ton ta tes".split())
WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"\b(?=\w*[a-zA-Z])(?:\w*[0-9@$!*]\w*|\w(?:[.\-_*]\w){2,})[a-zA-Z]*")
LEET = str.maketrans("013457@$!", "oieastasi")
REPEATS = re.compile(r"(.)\1{2,}")
NAMES = ["words", "chars", "general", "learned_words", "learned_stems", "any_hit", "strongest", "second_person", "near_second", "capitals", "capital_words", "punctuation", "exclaims", "symbols", "digits", "masked", "masked_hits", "repeats", "word_length"]
_CLASS = np.zeros(256, dtype=np.intp)
_CLASS[ord("A") : ord("Z") + 1] = 1
for _c in b".,;:?'\"()-":
    _CLASS[_c] = 2
_CLASS[ord("!")] = 3
for _c in b"@#$%^&*_=+~<>|\\/":
    _CLASS[_c] = 4
_CLASS[ord("0") : ord("9") + 1] = 5


#: Words whose entry a worker keeps before it starts anew; results do not depend on it.
CACHE_WORDS = 400_000
_LETTER = np.zeros(256, dtype=bool)
for _c in range(256):
    _LETTER[_c] = chr(_c).isalpha() if _c < 128 else True
_LETTER[ord("_")] = True
_DIGIT, _SIGN, _JOIN = (np.isin(np.arange(256), list(s)) for s in (b"0123456789", b"0123456789@$!*", b".-_*"))


class Words:
    """What each word is worth: (general, learned weight, stem weight, second person), or 0 for nothing."""

    def __init__(self, words_lex: dict[str, float], stems_lex: dict[str, float]):
        self.words, self.stems, self.known = words_lex, stems_lex, {}

    def entry(self, w: str):
        stem = max([self.stems[w[:k]] for k in STEMS if w[:k] in self.stems], default=0.0)
        e = (w in GENERAL, self.words.get(w, 0.0), stem, w in SECOND_PERSON)
        return e if any(e) else 0

    def entries(self, words: list[str]) -> list[tuple[int, tuple]]:
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            for i, e in enumerate(got):
                if e is None:
                    got[i] = self.known[words[i]] = self.entry(words[i])
        return [(i, e) for i, e in enumerate(got) if e]


def may_mask(data: np.ndarray) -> bool:
    """False only if MASKED matches nowhere: it needs a letter or _ beside a sign, or a join between word characters."""
    letter, sign = _LETTER[data], _SIGN[data]
    word = letter | _DIGIT[data]
    return bool((letter[:-1] & sign[1:] | sign[:-1] & letter[1:]).any() or (word[:-2] & _JOIN[data][1:-1] & word[2:]).any())


def features(text: str, lexicon: Words) -> list[float]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    classes = np.bincount(_CLASS[data], minlength=6)
    words = WORD.findall(text.lower())
    n, n_chars = max(1, len(words)), max(1, len(text))
    found = lexicon.entries(words)
    persons = [i for i, e in found if e[3]]
    hits = [i for i, e in found if e[0] or e[1] or e[2]]
    near = 0.0
    if hits and persons:
        for i in hits:
            at = bisect_left(persons, i)
            near = max(near, max(1 / (1 + abs(i - p)) for p in persons[max(0, at - 1) : at + 1]))
    masked = MASKED.findall(text) if may_mask(data) else []
    plain = [re.sub(r"[^a-z]", "", m.lower().translate(LEET)) for m in masked]
    same = data[1:] == data[:-1]
    run = same[1:] & same[:-1]
    n_runs = int(np.count_nonzero(run[1:] & ~run[:-1]) + run[0]) if len(run) else 0
    shortened = [REPEATS.sub(r"\1", w) for w in words if REPEATS.search(w)] if n_runs else []
    hidden = sum(w in GENERAL or w in lexicon.words for w in plain + shortened)
    return [
        np.log1p(len(words)), np.log1p(len(text)), 100 * sum(e[0] for _, e in found) / n, 100 * sum(e[1] > 0 for _, e in found) / n, 100 * sum(e[2] > 0 for _, e in found) / n, float(len(hits) + hidden),
        max([max(e[1], e[2]) for _, e in found], default=0.0), 100 * len(persons) / n, near, classes[1] / n_chars, sum(map(str.isupper, WORD.findall(text))) / n, classes[2] / n_chars, classes[3] / n_chars,
        classes[4] / n_chars, classes[5] / n_chars, 100 * len(masked) / n, float(hidden), 100 * n_runs / n, sum(map(len, words)) / n,
    ]


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    knots: tuple[np.ndarray, np.ndarray] | None = None
    prior: float = 0.0
    lexicon: Words | None = None

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), dtype=np.intp)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.knots is None:
            return np.full(len(texts), self.prior)
        if self.lexicon is None:
            self.lexicon = Words(self.words, self.stems)
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), len(NAMES))
        return np.interp(self.margins(x), *self.knots)


def fit_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list]:
    """Newton boosting of complete trees over quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    base = float(np.log(p / (1 - p)))
    margin, trees, inner = np.full(len(y), base), [], 2**DEPTH - 1
    for _ in range(TREES):
        prob = 1 / (1 + np.exp(-margin))
        g, h = y - prob, prob * (1 - prob)
        feature, cut, at = np.zeros(inner, dtype=np.intp), np.full(inner, np.inf), np.zeros(len(y), dtype=np.intp)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            node = at - first
            best = np.full(width, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = len(c) + 1
                key = node * b + binned[:, j]
                gs = np.bincount(key, g, width * b).reshape(width, b)
                hs = np.bincount(key, h, width * b).reshape(width, b)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                k = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[i], feature[first + i], cut[first + i] = gain[i, k[i]], j, c[k[i]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf_of = at - inner
        leaf = RATE * np.bincount(leaf_of, g, inner + 1) / (np.bincount(leaf_of, h, inner + 1) + 1)
        trees.append((feature, cut, leaf))
        margin += leaf[leaf_of]
    return base, trees


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots at the blocks' means, so that scores rise between them, within (0, 1)."""
    blocks: list[list[float]] = []  # sum of y, weight, sum of margins
    for m, v in sorted(zip(margin.tolist(), y.tolist(), strict=True)):
        blocks.append([v, 1.0, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    xs = np.array([b[2] / b[1] for b in blocks])
    ys = np.array([(b[0] + 0.5 * y.mean()) / (b[1] + 0.5) for b in blocks])
    ys = np.maximum.accumulate(ys)
    spread = 10.0 * (1 + np.abs(xs).max())
    return np.concatenate([[xs[0] - spread], xs, [xs[-1] + spread]]), np.clip(np.concatenate([[0.5 * ys[0]], ys, [(1 + ys[-1]) / 2]]), 0, 1)


def fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5


def _feature_rows(words: dict[str, float], stems: dict[str, float]):
    def run(frames):
        let_go()
        lexicon = Words(words, stems)
        for frame in frames:
            yield pd.DataFrame({"toxic": frame["toxic"], "fold": frame["fold"], "x": [features(t, lexicon) for t in frame["text"]]})

    return run


def _learn_entries(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that toxic documents have far more often, from the fitting folds only."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != ""))
    tokens = F.concat(F.transform(words, lambda w: F.concat(F.lit("="), w)), *[F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.substring(w, 1, k)) for k in STEMS])
    counts = sample.where("fold <> 4").select("toxic", F.explode(F.array_distinct(tokens)).alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log(((F.col("t") + 0.5) / (n_toxic + 1)) / ((F.col("c") + 0.5) / (n_clean + 1)))
    kept = counts.where(F.col("t") >= MIN_DOCS).withColumn("odds", odds).where("odds > 3").orderBy(F.desc(F.col("odds") * F.log1p("t")), "w").limit(LEXICON_ROWS).collect()
    return {r["w"][1:]: r["odds"] for r in kept if r["w"][0] == "="}, {r["w"]: r["odds"] for r in kept if r["w"][0] != "="}


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from at most FIT_ROWS labelled rows; folds 1 to 3 give lexicon and trees, fold 4 the calibration."""
    small_batches(docs.sparkSession)
    marked = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where(fold("label_id") != 0)
    chosen = marked.groupBy("label_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id").limit(FIT_ROWS)
    chosen = docs.sparkSession.createDataFrame([(r["label_id"], r["toxic"]) for r in chosen.collect()], "label_id long, toxic int")
    sample = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    sample = sample.select("text", "toxic", fold().alias("fold")).repartition(docs.sparkSession.sparkContext.defaultParallelism).persist()
    by: dict[tuple[int, bool], int] = {}
    for r in sample.groupBy("toxic", (F.col("fold") == 4).alias("held")).agg(F.count("*").alias("n")).collect():
        by[(r["toxic"], r["held"])] = r["n"]
    total = sum(by.values())
    prior = sum(n for (t, _), n in by.items() if t == 1) / total if total else 0.0
    if not by.get((1, False)) or not by.get((0, False)):
        sample.unpersist()
        return Model(prior=prior)
    words, stems = _learn_entries(sample, by[(1, False)], by[(0, False)])
    rows = sample.mapInPandas(_feature_rows(words, stems), "toxic int, fold long, x array<double>").toPandas()  # FIT_ROWS at most
    sample.unpersist()
    x, y, held = np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(dtype=float), rows["fold"].to_numpy() == 4
    base, trees = fit_trees(x[~held], y[~held])
    model = Model(words, stems, base, trees, prior=prior)
    use = held if 0 < y[held].sum() < held.sum() else ~held
    model.knots = isotonic(model.margins(x[use]), y[use])
    return model


def _scorer(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        let_go()
        for batch in batches:
            scores = model.scores([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], schema=schema)

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _cleaner(model: Model):
    def run(batches):
        let_go()
        for batch in batches:
            keep = model.scores([t or "" for t in batch.column("text").to_pylist()]) < 0.5
            yield batch.filter(pa.array(keep))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5, with all their columns."""
    return docs.mapInArrow(_cleaner(fit(docs, labels)), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
