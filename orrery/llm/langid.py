"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations into pieces, from one forward pass; a text's is the product over its words. The
probabilities come from expectation maximisation on the words of labelled documents.

The languages are those of all labelled documents. Training uses at most DOCS documents of each (whole texts, chosen by a
hash of doc_id) and their WORDS most frequent words of each language: the documented bounds. Words are runs of letters in
lower case. A word is scored whole, the forward sums being scaled as they grow small; only a run of more than LONG letters
is cut. In training, where words of more than CHUNK letters are rare, these count as chunks of that length.

Edge cases: a null text or one without a letter is "und" with score 0; without any labelled document every text is
"und"; ties go to the language first in order; repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, held_out, training

DOCS, WORDS, ROUNDS, CHUNK, LONG, REMEMBERED = 1000, 12_000, 3, 32, 512, 400_000
#: Probability of a letter that no piece covers, in every language; mass added to every piece.
UNSEEN, ADDED = 1e-7, 0.05
START, FACTOR = "▁", 0x9E3779B97F4A7C15
letters = regex.compile(r"\p{L}+").findall


def pieces_of(path: str) -> list[str]:
    """Ordinary pieces of a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not odd(i)]


def chunks(word: str, size: int) -> list[str]:
    word = START + word
    return [word[i : i + size] for i in range(0, len(word), size)] if len(word) > size else [word]


class Segmenter:
    """Piece probabilities of each language and the sum over segmentations, for many words of one length at a time."""

    def __init__(self, langs: list[str], pieces: list[str], probs: np.ndarray):
        self.langs, self.pieces, self.longest = langs, pieces, min(CHUNK, max(map(len, pieces), default=1))
        codes = {p: self.code(p) for p in pieces}
        order = np.argsort(np.array([codes[p] for p in pieces], np.uint64), kind="stable")
        self.codes = np.array([codes[p] for p in pieces], np.uint64)[order]
        self.index, self.probs = order, np.vstack([probs, np.full((1, len(langs)), UNSEEN)])
        starts = {self.code(p[:n]) for p in pieces for n in range(1, len(p) + 1)}
        self.starts = np.array(sorted(starts), np.uint64)

    @staticmethod
    def code(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * FACTOR + ord(c) + 1) % (1 << 64)
        return h

    def edges(self, letters_: np.ndarray):
        """(start, end, rows, pieces) of the pieces in the words, a row of letters each, by start; single letters that no piece covers included."""
        n, m = letters_.shape
        for i in range(m):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i + 1, min(m, i + self.longest) + 1):
                h = h * np.uint64(FACTOR) + letters_[rows, j - 1] + np.uint64(1)
                at = np.minimum(np.searchsorted(self.codes, h), len(self.codes) - 1)
                hit = self.codes[at] == h
                if j == i + 1:
                    yield i, j, rows, np.where(hit, self.index[at], len(self.pieces))
                elif hit.any():
                    yield i, j, rows[hit], self.index[at[hit]]
                at = np.minimum(np.searchsorted(self.starts, h), len(self.starts) - 1)
                alive = self.starts[at] == h
                rows, h = rows[alive], h[alive]
                if not len(rows):
                    break

    def forward(self, letters_: np.ndarray, edges) -> np.ndarray:
        """Probability of each beginning of each word in each language."""
        n, m = letters_.shape
        alpha = np.zeros((m + 1, n, len(self.langs)))
        alpha[0] = 1
        for i, j, rows, piece in edges:
            alpha[j, rows] += alpha[i, rows] * self.probs[piece]
        return alpha

    def log_forward(self, letters_: np.ndarray) -> np.ndarray:
        """Natural logarithm of the last sums of :meth:`forward`; every CHUNK // 2 letters all later sums are divided by the largest."""
        n, m = letters_.shape
        alpha, scale, at = np.zeros((m + 1, n, len(self.langs))), np.zeros((n, len(self.langs))), 0
        alpha[0] = 1
        for i, j, rows, piece in self.edges(letters_):
            if i > at and i % (CHUNK // 2) == 0:
                at = i
                some = alpha[i : i + self.longest + 1]
                top = some.max(axis=0)
                some /= top
                scale += np.log(top)
            alpha[j, rows] += alpha[i, rows] * self.probs[piece]
        return np.log(np.maximum(alpha[-1], 1e-300)) + scale

    def blocks(self, words: list[str], size: int):
        """(numbers of words, letters) of chunks of one length."""
        by: dict[int, list[tuple[int, str]]] = {}
        for k, w in enumerate(words):
            for c in chunks(w, size):
                by.setdefault(len(c), []).append((k, c))
        for n, got in sorted(by.items()):
            yield np.array([k for k, _ in got]), np.frombuffer("".join(c for _, c in got).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).astype(np.uint64)

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability in each language."""
        out = np.zeros((len(words), len(self.langs)))
        for k, block in self.blocks(words, LONG):
            np.add.at(out, k, self.log_forward(block))
        return out


def expected(seg: Segmenter, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece: forward and backward sums of every word, weighted by its counts in each language."""
    uses = np.zeros_like(seg.probs)
    for k, block in seg.blocks(words, CHUNK):
        edges = list(seg.edges(block))
        alpha = seg.forward(block, edges)
        beta = np.zeros_like(alpha)
        beta[-1] = 1
        for i, j, rows, piece in reversed(edges):
            beta[i, rows] += beta[j, rows] * seg.probs[piece]
        scale = counts[k] / np.maximum(alpha[-1], 1e-300)
        for i, j, rows, piece in edges:
            np.add.at(uses, piece, alpha[i, rows] * seg.probs[piece] * beta[j, rows] * scale[rows])
    return uses[:-1]


def least_hashes(rows: DataFrame, most: int) -> dict[str, int]:
    """For each language the largest of the ``most`` least hashes of its documents' ids.

    Hashes are even over 64 bits, so a bound for twice as many documents holds them; where ids repeat too often for that, it
    rises until there are enough or it holds all. What a group gathers follows ``most``, not the documents or partitions."""
    hashed = rows.select("lang", F.xxhash64("doc_id").alias("h"))
    share = {lang: 2 * most / n for lang, n in hashed.groupBy("lang").count().collect()}
    last = {}
    while share:
        tops = [(g, min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63))) for g, s in share.items()]
        bound = rows.sparkSession.createDataFrame(tops, "lang string, top long")  # a row for each language
        below = hashed.join(F.broadcast(bound), "lang").filter("h <= top").groupBy("lang").agg(F.sort_array(F.collect_set("h")).alias("hs"))
        for lang, n, h in below.select("lang", F.size("hs"), F.element_at("hs", F.least(F.size("hs"), F.lit(most)))).collect():
            if n >= most or share[lang] >= 1:
                last[lang] = h
        share = {g: 8 * s for g, s in share.items() if g not in last}
    return last


def train(docs: DataFrame, path: str) -> Segmenter | None:
    """Model from labelled documents (doc_id, text, lang); None if there are none."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    last = least_hashes(rows, DOCS)
    langs = sorted(last)
    if not langs:
        return None
    bound = docs.sparkSession.createDataFrame(list(last.items()), "lang string, last long")  # a row for each language
    rows = rows.join(F.broadcast(bound), "lang").filter(F.xxhash64("doc_id") <= F.col("last"))

    def counted(frames):
        for f in frames:
            seen: dict[str, Counter] = {}
            for lang, text in zip(f["lang"], f["text"]):
                seen.setdefault(lang, Counter()).update(letters(text.lower()))
            yield pd.DataFrame([(g, w, n) for g, c in seen.items() for w, n in c.items()], columns=["lang", "word", "n"])

    counts = rows.select("lang", "text").mapInPandas(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words: dict[str, list[int]] = {}
    at = {g: k for k, g in enumerate(langs)}
    for lang, word, n in counts.withColumn("place", place).filter(F.col("place") <= WORDS).select("lang", "word", "n").collect():
        words.setdefault(word, [0] * len(langs))[at[lang]] = n
    found = sorted(words.items())
    pieces = pieces_of(path)
    counts = np.array([n for _, n in found], float).reshape(-1, len(langs))
    probs = np.full((len(pieces), len(langs)), 1 / max(1, len(pieces)))
    for _ in range(ROUNDS):
        uses = ADDED + expected(Segmenter(langs, pieces, probs), [w for w, _ in found], counts)
        probs = uses / uses.sum(axis=0)
    return Segmenter(langs, pieces, probs)


class Scorer:
    """Texts to (language, posterior), with a bounded table of words seen by a worker."""

    def __init__(self, seg: Segmenter | None):
        self.seg = seg
        self.clear()

    def clear(self):
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.seg.langs) + 1 if self.seg else 1))

    def learn(self, new: list[str]) -> None:
        """Remember chunks between white space: the sum over the words in each."""
        inside = [letters(c) for c in new]
        distinct = list(dict.fromkeys(w for words in inside for w in words))
        at = {w: i for i, w in enumerate(distinct)}
        logs = self.seg.log_probs(distinct)
        rows = np.zeros((len(new), logs.shape[1] + 1))
        for k, words in enumerate(inside):
            for w in words:
                rows[k, :-1] += logs[at[w]]
            rows[k, -1] = len(words)
        for k, c in enumerate(new):
            self.known[c] = len(self.known)
        self.rows = np.concatenate([self.rows, rows])

    def of(self, texts: list[str | None]) -> list[tuple[str, float]]:
        cut = [t.lower().split() if t else [] for t in texts]
        if self.seg is None:
            return [("und", 0.0)] * len(cut)
        distinct = set().union(*cut)
        new = sorted(distinct.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.clear()
            new = sorted(distinct)
        if new:
            self.learn(new)
        out, at = [], self.known.__getitem__
        for row in cut:
            total = self.rows[list(map(at, row))].sum(axis=0) if row else np.zeros(len(self.seg.langs) + 1)
            if not total[-1]:
                out.append(("und", 0.0))
                continue
            total = total[:-1]
            best = int(total.argmax())
            out.append((self.seg.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def predict_column(spark, seg: Segmenter | None, text: str | Column = "text") -> Column:
    """struct<lang_pred, score>; the model is bounded by the vocabulary and the number of languages."""
    model = spark.sparkContext.broadcast(seg)
    scorers: list[Scorer] = []

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not scorers:
            scorers.append(Scorer(model.value))
        return pd.DataFrame([p for run in batches(texts) for p in scorers[0].of(run)], columns=["lang_pred", "score"])

    return predict(text)


def identify(docs: DataFrame, path: str, mod: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those that aren't held out."""
    seg = train(docs.filter(training("doc_id", mod)), path)
    got = docs.select("doc_id", held_out("doc_id", mod).alias("held_out"), predict_column(docs.sparkSession, seg).alias("_p"))
    return got.select("doc_id", "held_out", "_p.*")
