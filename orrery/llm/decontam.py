"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters and digits in lower case; a window has as many words as an item, or all words of a document that
has fewer, and slides by one word. Windows
and items have 64-bit SimHashes of their 5-word shingles (an item of fewer words is one shingle). Item fingerprints are
indexed in BLOCKS blocks of bits: of two fingerprints within RADIUS, some block differs in at most RADIUS // BLOCKS bits,
so looking up a block and its neighbours within that many bits finds every item within RADIUS. Candidates are verified by
the exact weighted (multiset) Jaccard similarity of their shingles, at least 0.8.

A window without any shingle of an item has similarity 0 with it, so only windows of the item's size around a common
shingle are fingerprinted: this loses nothing.

Items are held by each task in passes of at most ITEMS words in all, so memory is bounded whatever the benchmark's size.

Edge cases: items that are null or have no word match nothing; null and empty documents match nothing; repeated items and
documents give a row each; a null item_id is kept; texts are searched whole; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, LEAST, RADIUS, BLOCKS, ITEMS, REMEMBERED = 5, 0.8, 19, 8, 2_000_000, 200_000
words_of = re.compile(r"[^\W_]+").findall
OUT = "doc_id long, item_id long, similarity double, first_word long, n_words long"


class Words:
    """Texts to arrays of their words' 64-bit hashes, with a bounded table of the chunks between white space."""

    def __init__(self):
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> np.ndarray:
        chunks = text.lower().split() if text else []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, h = self.known, xxhash.xxh64_intdigest
        for c in set(chunks).difference(known):
            known[c] = tuple(h(w.encode("utf-8", "surrogatepass")) for w in words_of(c))
        return np.fromiter(chain.from_iterable(map(known.__getitem__, chunks)), np.uint64)


def shingled(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-word shingles of an array of words' hashes."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def signs(h: np.ndarray) -> np.ndarray:
    """(n, 64) of +1 and -1 by bit."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1, 8).copy().view("<u8")[:, 0]


class Index:
    """Items of a benchmark and the blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.words = Words()
        self.ids, self.sizes, self.counts, prints = [], [], [], []
        self.by_shingle: dict[int, dict[int, list[int]]] = {}
        for item_id, text in items:
            words = self.words.of(text)
            if not len(words):
                continue
            k, n = min(SHINGLE, len(words)), len(self.ids)
            h = shingled(words, k)
            self.ids.append(item_id)
            self.sizes.append(len(words))
            self.counts.append(Counter(h.tolist()))
            prints.append(int(packed(signs(h).sum(axis=0, keepdims=True))[0]))
            for s in self.counts[-1]:
                self.by_shingle.setdefault(k, {}).setdefault(s, []).append(n)
        bits = 64 // BLOCKS
        self.prints = np.array(prints, np.uint64)
        self.near = [0] + [sum(1 << b for b in c) for n in range(1, RADIUS // BLOCKS + 1) for c in combinations(range(bits), n)]
        self.blocks: list[dict[int, list[int]]] = [{} for _ in range(BLOCKS)]
        for n, p in enumerate(prints):
            for b in range(BLOCKS):
                self.blocks[b].setdefault(p >> (b * bits) & ((1 << bits) - 1), []).append(n)
        self.sorted = {k: np.sort(np.array(list(d), np.uint64)) for k, d in self.by_shingle.items()}

    def within(self, print_: int) -> set[int]:
        """Items whose fingerprints are within RADIUS."""
        bits = 64 // BLOCKS
        found = {n for b in range(BLOCKS) for e in self.near for n in self.blocks[b].get(print_ >> (b * bits) & ((1 << bits) - 1) ^ e, ())}
        return {n for n in found if (int(self.prints[n]) ^ print_).bit_count() <= RADIUS}

    def search(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item that the text holds."""
        words = self.words.of(text)
        best: dict[int, tuple[float, int]] = {}
        for k, shingles in self.by_shingle.items():
            if len(words) < k:
                continue
            h = shingled(words, k)
            at = np.minimum(np.searchsorted(self.sorted[k], h), len(self.sorted[k]) - 1)
            hits = np.nonzero(self.sorted[k][at] == h)[0]
            starts: dict[int, set[int]] = {}
            for p in hits.tolist():
                for n in shingles[int(h[p])]:
                    size = self.sizes[n]
                    wide = min(size, len(words))
                    starts.setdefault(size, set()).update(range(max(0, p - wide + k), min(p, len(words) - wide) + 1))
            for size, found in starts.items():
                for run in np.split(s := np.array(sorted(found)), np.nonzero(np.diff(s) != 1)[0] + 1):
                    self.windows(h, run, size, k, min(size, len(words)) - k + 1, best)
        return [(self.ids[n], s, a, min(self.sizes[n], len(words))) for n, (s, a) in sorted(best.items())]

    def windows(self, h: np.ndarray, run: np.ndarray, size: int, k: int, m: int, best: dict) -> None:
        """Windows of m shingles that start at each of a run of words, in pieces of bounded size."""
        for lo in range(0, len(run), 4096):
            part = run[lo : lo + 4096]
            if not len(part):
                continue
            sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signs(h[part[0] : part[-1] + m]), axis=0)])
            for a, p in zip(part.tolist(), packed(sums[m : m + len(part)] - sums[: len(part)]).tolist()):
                if (near := [n for n in self.within(p) if self.sizes[n] == size]):
                    own = Counter(h[a : a + m].tolist())
                    for n in near:
                        both = sum((own & self.counts[n]).values())
                        similarity = both / (m + size - k + 1 - both)
                        if similarity >= LEAST and similarity > best.get(n, (0.0,))[0]:
                            best[n] = similarity, a


def passes(items: DataFrame):
    """Lists of items of at most ITEMS words in all; a longer item is one list."""
    run, size = [], 0
    for item_id, text in items.select("item_id", "text").filter("text is not null").toLocalIterator():
        n = len(words_of(text))
        if run and size + n > ITEMS:
            yield run
            run, size = [], 0
        run.append((item_id, text))
        size += n
    if run:
        yield run


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of the best window of each item in each document that holds it."""
    spark, out = docs.sparkSession, None
    for run in passes(items):
        index = spark.sparkContext.broadcast(run)
        got = docs.select("doc_id", "text").mapInPandas(searcher(index), OUT)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], OUT)


def searcher(items):
    def search(frames):
        index = Index(items.value)
        for f in frames:
            rows = [(d, *m) for d, t in zip(f["doc_id"], f["text"]) for m in index.search(t)]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "similarity", "first_word", "n_words"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

    return search


def held_column(docs: DataFrame, items: DataFrame):
    """True for texts that hold any item: for filters that keep all columns."""
    spark, held = docs.sparkSession, F.lit(False)
    for run in passes(items):
        data = spark.sparkContext.broadcast(run)
        held = held | holds_udf(data)(F.col("text"))
    return held


def holds_udf(items):
    cache: list[Index] = []

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        if not cache:
            cache.append(Index(items.value))
        return pd.Series([bool(cache[0].search(t)) for t in texts], dtype=bool)

    return holds
