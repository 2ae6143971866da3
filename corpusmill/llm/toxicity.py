"""Toxicity by weak supervision: voters, a generative label model and a linear classifier.

Voters look at a text's distinct words: a fixed lexicon of insults in a few groups, patterns (insults aimed at the
reader, insults in capitals, masked insults), and induced lexicons, word stems that a bounded sample of labelled rows
ties to toxicity, dealt to several voters. A vote is given or not.

The label model has a rate of toxic documents, for each voter its vote's probability in toxic and in clean documents, and
the voters' correlations among toxic ones; a vote's evidence is divided by what it shares with the other votes, so that
copies of one signal count once. All are estimated together by EM over the counts of vote patterns of all rows that
may be learned from, labelled or not. The model's
posteriors are the labels from which a logistic regression is trained on the bounded sample, over the voters, their
words and stems, and all words that WORD_DOCS of the sample's texts have, whether a voter knows them or not. The
regression scores every text; words whose weight is under LEAST_WEIGHT don't count.

Rows may be learned from if crc32(doc_id as text) mod 3 is not 1. labels, lang, source and doc_id are no inputs.

Defined cases: a null or empty text has no votes and gets the score of its intercept; without labelled rows of both
classes only the fixed lexicon and the patterns vote; repeated label rows count with their largest label; rows with a
null doc_id are never learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

#: Labelled rows of each class that features are induced from and the regression is fitted on, at most.
SAMPLE_PER_CLASS = 4000
#: Toxic documents of the sample that must hold an induced feature, voters these are dealt to; documents that must hold any word, and the weight that keeps it.
INDUCED_DOCS, INDUCED_VOTERS, WORD_DOCS, LEAST_WEIGHT = 4, 5, 8, 0.05
#: Lengths of the stems of words that are longer; a stem in so many distinct words is a feature of its own.
STEMS, SHARED = (4, 5, 6, 7), (1, 2, 4)
THRESHOLD = 0.7
#: Correlation among toxic documents up to which voters count as independent: lesser ones are what the posteriors leave of the class itself, and would take the signal.
APART = 0.3

LEXICON = {
    "intelligence": "idiot idiots moron morons stupid imbecile dumb fool idiota imbécil estúpido dummkopf blödmann crétin abruti",
    "worth": "loser losers worthless pathetic failure nobody useless perdedor inútil versager wertlos nul minable",
    "filth": "scum trash garbage filth vermin disgusting basura escoria abschaum müll dreck ordure racaille",
    "mockery": "clown clowns joke freak creep weirdo payaso witzfigur bouffon",
    "abuse": "bastard asshole bitch shit fuck fucking cabrón mierda arschloch scheiße connard salaud merde",
    "threat": "kill die hurt destroy mátate stirb crève",
}
_FIXED = {w: g for g, words in LEXICON.items() for w in words.split()}
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’¡¿…"
_AIMED = re.compile(r"\b(?:you|you're|your|du|ihr|tu|vous|eres|usted)\b[^.!?\n]{0,30}?\b(?:" + "|".join(map(re.escape, _FIXED)) + r")\b")
_MASKED = re.compile(r"\b(?:[i1!]d[i1!][o0]t|m[o0]r[o0]n|st[u*]p[i1!*]d|l[o0]s[e3]r|f[u*@]+c?k|sh[i1!*]t|b[i1!*]tch)\b")


def may_learn(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


_NONE = ("", ())


class Words:
    """Distinct words of a text without the marks around them, and their features: each word, its stems, and stems that several words share."""

    def __init__(self, vocabulary: dict[str, int] | None = None):
        self.vocabulary, self.known = vocabulary or {}, {}
        self.bases: dict[str, list[tuple[int, int]]] = {}
        for name, i in self.vocabulary.items():
            base, _, least = name.partition("*")
            self.bases.setdefault(base, []).append((int(least or 1), i))

    @staticmethod
    def names(word: str) -> list[str]:
        return [word, *(f"{word[:n]}-" for n in STEMS if len(word) > n)]

    @classmethod
    def all_names(cls, text: str) -> set[str]:
        """Every feature of a text: word, stem-, and stem-*n for n distinct words with the stem."""
        counts = Counter(x for w in {w.strip(_EDGE) for w in set(text.lower().split())} if w for x in cls.names(w))
        return {x if n == 1 else f"{x}*{n}" for x, c in counts.items() for n in SHARED if c >= n}

    def features(self, text: str) -> set[int]:
        """Numbers of the text's features that the vocabulary has."""
        known, bases, hits = self.known, self.bases, set()
        for w in set(text.lower().split()):
            found = known.get(w)
            if found is None:
                if len(known) > 100_000:
                    known.clear()
                word = w.strip(_EDGE)
                names = tuple([x for x in self.names(word) if x in bases]) if word else ()
                found = known[w] = (word, names) if names else _NONE
            if found[1]:
                hits.add(found)
        counts = Counter(x for _, names in hits for x in names)
        return {i for x, c in counts.items() for least, i in bases[x] if c >= least}


def _names(batches):
    """Features of the sample's texts, a row for each distinct one of a text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            names, toxic = [], []
            for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                own = Words.all_names(text or "")
                names += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32())], names=["name", "toxic"])


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of SAMPLE_PER_CLASS labelled rows of each class at most, by hash of doc_id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(may_learn(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_PER_CLASS) for y in (1, 0)]
    chosen = some[0].unionByName(some[1])
    return docs.select(F.col("doc_id").alias("_doc"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("text", "toxic")


def vocabulary(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Features that the sample ties to toxicity, strongest first, and its other words, commonest first. The bounded sample bounds both."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return [], []
    counts = sample.mapInArrow(_names, "name string, toxic int").groupBy("name").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    lift = F.log(((F.col("t") + 0.5) / (sizes[1] + 1)) / ((F.col("c") + 0.5) / (sizes[0] + 1)))
    tied = (F.col("t") >= INDUCED_DOCS) & (lift > 3.2)
    plain = ~F.col("name").rlike("-([*][0-9]+)?$") & (F.col("t") + F.col("c") >= WORD_DOCS)
    found = counts.withColumn("tied", tied).where(tied | plain).orderBy(F.desc("t"), F.desc("c"), "name").select("name", "tied").collect()
    return [r["name"] for r in found if r["tied"]], [r["name"] for r in found if not r["tied"]]


class Voters:
    """Votes of a text as bits: the lexicon's groups, the patterns, the induced lexicons."""

    def __init__(self, stems: list[str], plain: list[str] = ()):
        """plain: words that are features but no votes."""
        self.stems = [s for s in stems if s not in _FIXED]
        self.plain = [w for w in plain if w not in _FIXED]
        self.groups = list(LEXICON)
        self.names = [*self.groups, "aimed", "capitals", "masked", *(f"induced{i}" for i in range(INDUCED_VOTERS if self.stems else 0))]
        vocabulary = {w: i for i, w in enumerate(_FIXED)}
        self.words = Words(vocabulary | {s: len(_FIXED) + i for i, s in enumerate([*self.stems, *self.plain])})
        self.size = len(self.words.vocabulary) + len(self.names)
        self.bit = [self.groups.index(_FIXED[w]) for w in _FIXED] + [len(self.groups) + 3 + i % INDUCED_VOTERS for i in range(len(self.stems))]

    def look(self, text: str | None) -> tuple[set[int], int]:
        """Features of the text, and its votes as a bit mask."""
        found, votes = self.words.features(text or ""), 0
        for f in found:
            if f < len(self.bit):
                votes |= 1 << self.bit[f]
        n = len(self.groups)
        if any(f < len(_FIXED) for f in found):
            if _AIMED.search(text.lower()):
                votes |= 1 << n
            if any(w.strip(_EDGE).lower() in _FIXED for w in text.split() if w.isupper() and len(w) > 2):
                votes |= 1 << n + 1
        if text and _MASKED.search(text.lower()):
            votes |= 1 << n + 2
        base = len(self.words.vocabulary)
        return found | {base + i for i in range(len(self.names)) if votes >> i & 1}, votes


class LabelModel:
    """Two classes; voters vote with a probability of their own in each, and the evidence of correlated votes is shared."""

    def fit(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
        """patterns: rows of 0 and 1 by voter; counts: how many documents have each. EM finds rates and accuracies as if votes were independent, and from there each round estimates them and the correlations from the posteriors of the one before."""
        x, c = patterns.astype(float), counts.astype(float)
        hits, self.share = x.sum(1), np.ones(x.shape[1])
        post = np.where(hits >= 2, 0.9, np.where(hits == 1, 0.5, 0.02))
        for together in (False, True):
            for _ in range(rounds):
                one, zero = c * post, c * (1 - post)
                self.prior = np.clip(one.sum() / max(c.sum(), 1), 1e-4, 0.5)
                self.p1 = np.clip((one @ x + 1) / (one.sum() + 2), 1e-4, 1 - 1e-4)
                self.p0 = np.clip((zero @ x + 0.01) / (zero.sum() + 2), 1e-5, 1 - 1e-4)
                self.p0 = np.minimum(self.p0, self.p1)  # a vote never speaks for clean
                if together:
                    self.share = self._shares(x, c, post)
                new = self._posterior(x, self.share)
                moved, post = np.abs(new - post).max(), new
                if moved < 1e-6:
                    break
        return self

    def _shares(self, x: np.ndarray, c: np.ndarray, post: np.ndarray) -> np.ndarray:
        """How many votes' evidence each voter shares: one and its correlations with the others among toxic documents. (Votes that meet in clean ones are what tells that they are none.)"""
        weight = c * post
        if weight.sum() <= 1:
            return np.ones(x.shape[1])
        d = x - weight @ x / weight.sum()
        cov = (d * weight[:, None]).T @ d / weight.sum()
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-4))
        rho = np.clip(cov / scale[:, None] / scale[None, :], 0, 1) - np.eye(x.shape[1])
        return 1 + np.clip((rho - APART) / (1 - APART), 0, 1).sum(1)

    def _posterior(self, x: np.ndarray, share: np.ndarray) -> np.ndarray:
        on, off = np.log(self.p1 / self.p0) / share, np.log((1 - self.p1) / (1 - self.p0)) / share
        z = np.log(self.prior / (1 - self.prior)) + x @ on + (1 - x) @ off
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(patterns.astype(float), self.share)


def _bits(masks, m: int) -> np.ndarray:
    return (np.asarray(masks, dtype=np.int64)[:, None] >> np.arange(m)) & 1


def logistic(rows: list[list[int]], size: int, y: np.ndarray, weight: np.ndarray, rounds: int = 300, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept for sparse rows of 0 and 1 with labels y in [0, 1]; Adam over all rows."""
    indptr, cols = np.cumsum([0] + [len(r) for r in rows]), np.array([c for r in rows for c in r], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), np.diff(indptr))
    w, b = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        z = np.bincount(owner, w[cols], minlength=len(rows)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(cols, d[owner], minlength=size) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray, intercept: float):
        self.voters, self.weights, self.intercept = voters, weights, intercept

    def score(self, text: str | None) -> float:
        z = self.intercept + sum(self.weights[f] for f in self.voters.look(text)[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels).persist()
    try:
        stems, plain = vocabulary(sample)
        voters = Voters(stems, plain)

        def patterns(batches):
            own = Voters(stems)
            counts = Counter()
            for batch in batches:
                counts.update(own.look(t)[1] for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["votes", "n"])

        def looked(batches):
            own = Voters(stems, plain)
            for batch in batches:
                seen = [own.look(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([sorted(f) for f, _ in seen], pa.list_(pa.int32())), pa.array([v for _, v in seen], pa.int64())], names=["features", "votes"])

        free = docs.where("doc_id IS NOT NULL").where(may_learn(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"))
        met = free.mapInArrow(patterns, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()  # 2 ** voters rows at most
        rows = sample.select("text").mapInArrow(looked, "features array<int>, votes long").collect()  # SAMPLE_PER_CLASS of each class
    finally:
        sample.unpersist()
    m = len(voters.names)
    model = LabelModel().fit(_bits([r["votes"] for r in met] or [0], m), np.array([r["n"] for r in met] or [1]))
    if not rows:  # nothing labelled: the patterns themselves are the training rows
        base = len(voters.words.vocabulary)
        masks = [r["votes"] for r in met] or [0]
        rows, weight = [{"features": [base + i for i in range(m) if v >> i & 1], "votes": v} for v in masks], np.array([r["n"] for r in met] or [1], dtype=float)
    else:
        weight = np.ones(len(rows))
    y = model.posterior(_bits([r["votes"] for r in rows], m))
    weights, intercept = logistic([list(r["features"]) for r in rows], voters.size, y, weight)
    at = len(_FIXED) + len(voters.stems)
    kept = [i for i in range(len(voters.plain)) if abs(weights[at + i]) >= LEAST_WEIGHT]
    few = Voters(stems, [voters.plain[i] for i in kept])
    return Model(few, np.concatenate([weights[:at], weights[at:][kept], weights[at + len(voters.plain) :]]), intercept)


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs and a score; the text is read once to learn and once to score."""
    small_batches(docs.sparkSession)
    model = train(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((model.voters.stems, model.voters.plain, model.weights, model.intercept))
    held: dict = {}

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        if not held:
            stems, plain, weights, intercept = sent.value
            held["model"] = Model(Voters(stems, plain), weights, intercept)
        return pa.array([held["model"].score(t) for t in text.to_pylist()], pa.float64())

    return docs.withColumn(name, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
