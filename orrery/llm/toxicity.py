"""Toxicity: a counterfactual-regularised classifier.

Features of a text are the presence of its words (lower case, letters) and of words' beginnings of three to seven
letters, of which the FEATURES with the largest chi-square on labelled texts are kept, and all identity terms. A logistic
model is fitted to the labels; for every labelled text that names an identity group, the text with the terms of each pair
exchanged is scored too and the squared difference of the two log-odds is penalised, so that naming a group can't
by itself make a neutral sentence toxic.

Training uses at most DOCS labelled documents (whole texts, chosen by a hash of doc_id: the documented bound).

Edge cases: null and empty texts have the score of no feature at all; null labels are not learned from; without labels
every score is 0; repeated rows give equal rows; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, sample, training

DOCS, FEATURES, THRESHOLD, REMEMBERED = 12_000, 1000, 0.3, 200_000
#: Strength of the weight decay and of the counterfactual penalty; passes of the optimiser.
DECAY, SWAP, STEPS = 1e-3, 1.0, 400
#: Pairs of identity terms that are exchanged.
PAIRS = [
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("gay", "straight"), ("lesbian", "heterosexual"), ("muslim", "christian"),
    ("muslims", "christians"), ("jewish", "catholic"), ("jews", "catholics"), ("black", "white"), ("african", "european"), ("asian", "american"),
    ("immigrants", "citizens"), ("transgender", "cisgender"), ("disabled", "abled"), ("old", "young"),
]
EXCHANGE = {a: b for p in PAIRS for a, b in (p, p[::-1])}
words_of = re.compile(r"[^\W\d_]+").findall


def features(chunk: str) -> list[str]:
    """Words of a chunk of lower-case text and their beginnings, marked ^."""
    words = words_of(chunk)
    return words + ["^" + w[:n] for w in words for n in range(3, min(8, len(w)))]


class Reader:
    """Texts to the sets of their features among ``known``, with a bounded table of chunks between white space."""

    def __init__(self, known: frozenset[str]):
        self.known, self.chunks = known, {}

    def of(self, text: str | None) -> set[str]:
        out: set[str] = set()
        get = self.chunks.get
        for c in set(text.lower().split()) if text else ():
            if (got := get(c)) is None:
                if len(self.chunks) >= REMEMBERED:
                    self.chunks.clear()
                got = self.chunks[c] = tuple(f for f in features(c) if f in self.known)
            if got:
                out.update(got)
        return out


def exchanged(text: str) -> str | None:
    """The text with identity terms exchanged, or None if it has none."""
    found = []
    out = re.sub(r"[^\W\d_]+", lambda m: found.append(1) or EXCHANGE[m[0].lower()] if m[0].lower() in EXCHANGE else m[0], text)
    return out if found else None


class Classifier:
    def __init__(self, weights: dict[str, float], bias: float | None):
        self.weights, self.bias = weights, bias
        self.reader = Reader(frozenset(weights))

    def score(self, text: str | None) -> float:
        if self.bias is None:
            return 0.0
        z = self.bias + sum(sorted(self.weights[f] for f in self.reader.of(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: list[tuple[list[str], int]], pairs: list[tuple[list[str], list[str]]], names: list[str]) -> Classifier:
    """rows: active features and label; pairs: features of a text and of its exchanged form."""
    at = {f: i for i, f in enumerate(names)}

    def csr(sets):
        ids = [[at[f] for f in s if f in at] for s in sets]
        return np.repeat(np.arange(len(ids)), [len(i) for i in ids]), np.array([x for i in ids for x in i], int), len(ids)

    r, c, n = csr([f for f, _ in rows])
    y = np.array([t for _, t in rows], float)
    ra, ca, m = csr([a for a, _ in pairs])
    rb, cb, _ = csr([b for _, b in pairs])
    w, b = np.zeros(len(names)), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m1, m2, g1, g2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(r, w[c], n), -50, 50)))
        e = (p - y) / n
        g = np.bincount(c, e[r], len(w)) + DECAY * w
        if m:  # the penalty on the difference between a text and its exchanged form
            d = (np.bincount(ra, w[ca], m) - np.bincount(rb, w[cb], m)) / m
            g += 2 * SWAP * (np.bincount(ca, d[ra], len(w)) - np.bincount(cb, d[rb], len(w)))
        gb = e.sum()
        m1, m2, g1, g2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g, 0.9 * g1 + 0.1 * gb, 0.999 * g2 + 0.001 * gb * gb
        k1, k2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.05 * (m1 / k1) / (np.sqrt(m2 / k2) + 1e-8)
        b = b - 0.05 * (g1 / k1) / (np.sqrt(g2 / k2) + 1e-8)
    return Classifier({f: float(w[i]) for f, i in at.items() if w[i]}, float(b))


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """docs (doc_id, text) and labels (doc_id, toxic), both of rows that may be learned from."""
    chosen = sample(labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", DOCS)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most DOCS rows of 12 bytes

    def counted(frames):
        for f in frames:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(f["text"], f["toxic"]):
                seen[int(toxic > 0)].update({f for c in set(text.lower().split()) for f in features(c)} if text else ())
            yield pd.DataFrame([(w, float(seen[1][w]), float(n - seen[1][w])) for w, n in (seen[0] + seen[1]).items()], columns=["f", "pos", "neg"])

    n_pos, n_all = rows.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("double")), F.lit(0.0)), F.count("*").cast("double")).first()
    if not n_all:
        return Classifier({}, None)
    counts = rows.mapInPandas(counted, "f string, pos double, neg double").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    df, want = F.col("pos") + F.col("neg"), F.lit(n_pos / n_all)
    gap = F.col("pos") - df * want
    names = [r[0] for r in counts.filter(df >= 3).select("f", (gap * gap / (df * want * (1 - want) + 1e-9)).alias("chi")).orderBy(F.desc("chi"), "f").limit(FEATURES).collect()]
    names = sorted({*names, *EXCHANGE})
    known = docs.sparkSession.sparkContext.broadcast(frozenset(names))

    def active(frames):
        reader = Reader(known.value)
        for f in frames:
            swaps = [exchanged(t) if t else None for t in f["text"]]
            yield pd.DataFrame({"a": [sorted(reader.of(t)) for t in f["text"]], "toxic": f["toxic"].astype(int), "b": [None if s is None else sorted(reader.of(s)) for s in swaps]})

    got = rows.mapInPandas(active, "a array<string>, toxic int, b array<string>").collect()
    got = sorted((list(a), int(t > 0), None if b is None else list(b)) for a, t, b in got)
    return fit([(a, t) for a, t, _ in got], [(a, b) for a, _, b in got if b is not None], names)


def score_column(spark, model: Classifier, text: str | Column = "text") -> Column:
    """Score of a text from 0 to 1."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype="float64")

    return score(text)


def judge(docs: DataFrame, labels: DataFrame, mod: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs.filter(training("doc_id", mod)), labels.filter(training("doc_id", mod)))
    got = docs.select("doc_id", held_out("doc_id", mod).alias("held_out"), score_column(docs.sparkSession, model).alias("score"))
    return got.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
