"""BPE encoding and decoding with a contiguous rank array per word.

A text is cut at the vocabulary's special tokens, normalised (NFC, lower case) and split into short words. Each word is
one list of parts and one list of the ranks of adjacent parts: scan for the least rank, delete the boundary there, and
refresh the two neighbouring ranks; words of one length are merged together, a row of a matrix for each. Words of more than LONG parts use the same merges from a heap, whose time doesn't
grow with the square of the length. Merged words are remembered per Python worker, in a bounded table.

Edge cases: a null text counts as empty (no ids); empty texts have no ids and decode to the empty string; texts of any
length are encoded whole; repeated rows give equal rows; other columns of the input are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches

NONE, SHIFT = 1 << 60, 17
MASK = (1 << SHIFT) - 1
#: Parts above which a word is merged from a heap, and words remembered by a worker.
LONG, REMEMBERED = 256, 200_000
#: Digest columns of a document.
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one vocabulary file (JSON of a byte-level BPE with a word-end suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = [None] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            self.letters[i] = t
        self.inner = [vocab.get(c) for c in byte_letters()]
        self.last = [vocab.get(c + end) for c in byte_letters()]
        self.pair = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.pair.setdefault(vocab[a] << SHIFT | vocab[b], rank << SHIFT | vocab[a + b])
        self.words_of = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}")
        self.ready()

    def ready(self) -> None:
        """What can't be sent to a worker."""
        self.find = regex.compile(self.words_of).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split
        self.blank = regex.compile(r"[^\p{White_Space}]+").findall
        self.odd = regex.compile("[\x1c-\x1f]").search  # str.split() takes these for white space
        self.known: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}
        self.pairs = np.array(sorted(self.pair), np.int64)
        self.merged = np.array([self.pair[p] for p in self.pairs.tolist()], np.int64)
        self.inner_ids, self.last_ids = np.array(self.inner, np.int64), np.array(self.last, np.int64)
        self.number = [str(i) for i in range(len(self.letters))]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "cut", "blank", "odd", "known", "words", "number")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.ready()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [p for p in [*(self.inner[b] for b in word[:-1]), self.last[word[-1]]] if p is not None]
        if len(parts) > LONG:
            return self.merge_long(parts)
        get = self.pair.get
        ranks = [get(a << SHIFT | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = least & MASK
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << SHIFT | parts[i], NONE)
            if i < len(ranks):
                ranks[i] = get(parts[i] << SHIFT | parts[i + 1], NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        n, get = len(parts), self.pair.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << SHIFT | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i]
            if parts[i] < 0 or j < 0 or get(parts[i] << SHIFT | parts[j]) != r:
                continue
            parts[i], parts[j], right[i] = r & MASK, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (r := get(parts[a] << SHIFT | parts[right[a]])) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def merge_many(self, words: list[str]) -> list[list[int]]:
        """Ids of many words: the same scan, deletion and refresh, one row of a matrix for each word of like length."""
        out: list[list[int]] = [[] for _ in words]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        by_length: dict[int, list[int]] = {}
        for k, b in enumerate(raw):
            if len(b) > 48:
                out[k] = self.merge(b)
            else:
                by_length.setdefault(len(b), []).append(k)
        for n, at in sorted(by_length.items()):
            letters = np.frombuffer(b"".join(raw[k] for k in at), np.uint8).reshape(len(at), n)
            parts = np.concatenate([self.inner_ids[letters[:, :-1]], self.last_ids[letters[:, -1:]]], axis=1)
            at, ranks = np.array(at), self.rank(parts[:, :-1], parts[:, 1:])
            while True:
                least = ranks.min(axis=1) if ranks.shape[1] else np.full(len(at), NONE)
                if (done := least == NONE).any():
                    for k, row in zip(at[done].tolist(), parts[done].tolist()):
                        out[k] = row
                    at, parts, ranks, least = at[~done], parts[~done], ranks[~done], least[~done]
                if not len(at):
                    break
                i, rows, m = (ranks == least[:, None]).argmax(axis=1), np.arange(len(at)), parts.shape[1]
                parts[rows, i] = least & MASK
                keep = np.arange(m) != (i + 1)[:, None]
                parts = parts[keep].reshape(len(at), m - 1)
                ranks = ranks[np.arange(m - 1) != i[:, None]].reshape(len(at), m - 2)
                if m > 2:
                    for j, ok in ((i - 1, i > 0), (i, i < m - 2)):
                        r, c = rows[ok], j[ok]
                        ranks[r, c] = self.rank(parts[r, c], parts[r, c + 1])
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and id that two adjacent parts merge to, or NONE."""
        want = a << SHIFT | b
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.merged[at], NONE)

    def normal(self, piece: str) -> str:
        return piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()

    def learn(self, missing: set[str]) -> None:
        """Remember the ids of chunks between white space."""
        split = {c: self.find(c) for c in missing}
        new = list({w for words in split.values() for w in words}.difference(self.words))
        if len(self.words) + len(new) > REMEMBERED:
            self.words.clear()
            new = list({w for words in split.values() for w in words})
        self.words.update(zip(new, self.merge_many(new)))
        for c, words in split.items():
            self.known[c] = self.words[words[0]] if len(words) == 1 else [i for w in words for i in self.words[w]]

    def chunks(self, text: str | None) -> list:
        """Chunks between white space, and special tokens as their ids. No word goes across white space."""
        out: list = []
        for piece in self.cut(text or ""):
            if piece in self.special:
                out.append(self.special[piece])
            else:
                piece = self.normal(piece)
                out += self.blank(piece) if self.odd(piece) else piece.split()
        return out

    def encode_many(self, texts) -> list[list[int]]:
        """Ids of whole texts; the special tokens' own strings give their ids."""
        cut = [self.chunks(t) for t in texts]
        missing = {c for c in set().union(*cut) if c.__class__ is str and c not in self.known}
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.known.clear()
                missing = {c for row in cut for c in row if c.__class__ is str}
            self.learn(missing)
        out, known = [], self.known
        for row in cut:
            ids: list[int] = []
            for c in row:
                if c.__class__ is int:
                    ids.append(c)
                else:
                    ids += known[c]
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary has no decoder of its own: its tokens joined by spaces, special ones included."""
        return " ".join(map(self.letters.__getitem__, ids))

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(" ".join(map(self.number.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


def encode_column(spark, path: str, text: str | Column = "text") -> Column:
    """array<int> of a text's ids. The vocabulary (bounded: one file of a few MB) is read by the driver and broadcast."""
    model = spark.sparkContext.broadcast(WordBpe(path))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([i for run in batches(texts) for i in model.value.encode_many(run)], dtype=object)

    return ids(text)


def decode_column(spark, path: str, ids: str | Column = "ids") -> Column:
    """Text of an array of ids; a null array gives null."""
    model = spark.sparkContext.broadcast(WordBpe(path))

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else model.value.decode(list(x)))

    return text(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: encoded whole, then decoded from its ids."""
    model = docs.sparkSession.sparkContext.broadcast(WordBpe(path))

    @F.pandas_udf(DIGEST)
    def digest(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.value.digest(i) for run in batches(texts) for i in model.value.encode_many(run)], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest("text").alias("_d")).select("doc_id", "_d.*")
