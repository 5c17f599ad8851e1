"""Suffix-array dedup with a run-length index: bytes covered by a string of LENGTH bytes that also starts elsewhere.

Where to look. In each window of LENGTH bytes the GRAM-byte string with the least hash (leftmost of equals) is the
window's anchor, which depends on nothing but the window's content. So two equal windows have equal anchors; a window
whose anchor occurs for no other window start can't repeat. The windows of one anchor in a text are a piece.

The index. Pieces that share an anchor are laid one after another in a block. The block's suffixes are sorted, giving a
Burrows-Wheeler transform, of which only the runs are kept, with text positions sampled at both sides of each boundary
between runs and the common length of the two suffixes there. Inside a run the matching length of a position is that of
the position before less one, so matching statistics stream over the text from the samples alone: the reach of a position
is the largest of sample position plus common length so far. What lies within a reach of LENGTH or more is marked.
Positions before the first of a piece count as boundaries, and matches end where pieces end. Every window start lies in
one piece only, so nothing matches itself.

Scale. Equal pieces are one piece with a count (of two or more, all is marked); an anchor with more than GROUP different
pieces is worked on by windows: their 128-bit hashes are counted over the cluster, so no task holds the group.

Edge cases: a null text counts as empty; texts shorter than LENGTH keep all; repeated rows, with equal or null doc_ids
too, are texts of their own; long texts are cut at fixed numbers of window starts, which loses no window; other columns
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop
from .runs import grouped

LENGTH, GRAM, GROUP, SEED = 400, 100, 4096, 3
#: Window starts and bytes that are worked on at a time; a block of the index.
STARTS, BLOCK = 1 << 20, 1 << 19
BASE = 0x9E3779B97F4A7C15
NOBODY = -(1 << 63)


class Roller:
    """Hashes of all strings of a length in an array of bytes."""

    def __init__(self, seed: int = SEED, size: int = 2 * STARTS + 4 * LENGTH):
        self.letters = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64)
        self.up, self.down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)

    def hashes(self, text: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.letters[text] * self.up[: len(text)], out=total[1:])
        h = (total[n:] - total[:-n]) * self.down[: len(text) - n + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of each n values in a row."""
    have = 1
    while 2 * have <= n:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (n - have)], h[n - have :]) if have < n else h


def stretches(texts: list[bytes]):
    """Lists of (number of the text, first byte, bytes) of about STARTS bytes in all; long texts in several stretches."""
    out, size = [], 0
    for k, t in enumerate(texts):
        for s in range(0, len(t) - LENGTH + 1, STARTS):
            part = t[s : s + STARTS + LENGTH - 1]
            out.append((k, s, part))
            size += len(part)
            if size >= STARTS:
                yield out
                out, size = [], 0
    if out:
        yield out


def pieces(texts: list[bytes], roller: Roller):
    """Arrays (text number, first byte, bytes, anchor hash, content hash) of the pieces of each stretch of texts."""
    bits = np.uint64((1 << 22) - 1)
    for found in stretches(texts):
        joined = b"".join(p for _, _, p in found)
        raw = np.frombuffer(joined, np.uint8)
        sizes = np.array([len(p) for _, _, p in found])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        h = roller.hashes(raw, GRAM)
        at = (least((h & ~bits) | np.arange(len(h), dtype=np.uint64), LENGTH - GRAM + 1) & bits).astype(np.int64)
        owner = np.repeat(np.arange(len(found)), sizes)[: len(at)]
        valid = np.arange(len(at)) <= (begin + sizes - LENGTH)[owner]
        starts = np.nonzero(valid)[0]
        new = np.ones(len(starts), bool)
        new[1:] = (at[starts[1:]] != at[starts[:-1]]) | (owner[starts[1:]] != owner[starts[:-1]])
        first = starts[new]
        last = starts[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(starts) - 1]])]
        digest = xxhash.xxh3_64_intdigest
        content = np.array([digest(joined[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist())], np.uint64)
        who = owner[first]
        yield np.array([f[0] for f in found])[who], np.array([f[1] for f in found])[who] + first - begin[who], last - first + LENGTH, h[at[first]].view(np.int64), content.view(np.int64)


class RunLengthIndex:
    """Run-length Burrows-Wheeler transform of some strings, with sampled boundaries of runs."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings])
        self.begin = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]])
        text = np.zeros(int((self.sizes + 1).sum()), np.int64)
        for b, s in zip(self.begin.tolist(), strings):
            text[b : b + len(s)] = np.frombuffer(s, np.uint8)
            text[b : b + len(s)] += 1
        self.text, n = text, len(text)
        self.end = np.repeat(self.begin + self.sizes, self.sizes + 1)
        order, self.levels = self.sort(n)
        before = text[order - 1]
        before[order == 0] = 0
        self.heads = 1 + np.nonzero((before[1:] != before[:-1]) | (before[1:] == 0))[0]  # first of each run but the first
        self.run_letters = before[np.concatenate([[0], self.heads])]
        self.above, self.below = order[self.heads - 1], order[self.heads]  # samples at the end of a run and the head of the next
        self.common = self.shared(self.above, self.below)

    def sort(self, n: int):
        """Suffix order, and the ranks by 7, 14, 28, ... letters."""
        padded = np.concatenate([self.text, np.zeros(7, np.int64)])
        key = np.zeros(n, np.int64)
        for k in range(7):
            key = key << 9 | padded[k : k + n]
        levels, size = [], 7
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.zeros(n, np.int64)
            rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
            levels.append((size, rank.astype(np.int32)))
            if n < 2 or rank[order[-1]] == n - 1 or size >= n:
                return order, levels
            key = rank << 32
            key[: n - size] |= rank[size:] + 1 if size < n else 0
            size *= 2

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at a and b share, up to the ends of their strings."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        got, n = np.zeros(len(a), np.int64), len(self.text)
        for size, rank in reversed(self.levels):
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            got += np.where((rank[x] == rank[y]) & (got + size <= most), size, 0)
        for _ in range(6):
            x, y = np.minimum(a + got, n - 1), np.minimum(b + got, n - 1)
            got += (self.text[x] == self.text[y]) & (got < most)
        return got

    def matching(self) -> np.ndarray:
        """Matching statistics: how far each position repeats some other one, streamed from the samples."""
        n = len(self.text)
        reach = np.zeros(n, np.int64)
        for at in (self.above, self.below):
            np.maximum.at(reach, at, at + self.common)
        return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)

    def marks(self, length: int = LENGTH):
        """(string, first byte, byte after the last) of all that lies in matches of the length."""
        at = np.nonzero(self.matching() >= length)[0]
        if not len(at):
            return np.zeros((0, 3), np.int64)
        ends = at + self.matching()[at]
        reach = np.maximum.accumulate(ends)
        new = np.concatenate([[True], at[1:] > reach[:-1]])
        first = at[new]
        last = reach[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(at) - 1]])]
        who = np.searchsorted(self.begin, first, "right") - 1
        return np.stack([who, first - self.begin[who], last - self.begin[who]], axis=1)


def spans_of(docs: DataFrame) -> DataFrame:
    """owner, dig, spans (array of struct a, b) of the documents (owner, dig, text) that have repeated bytes."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def anchored(batches):
        roller = Roller()
        for b in batches:
            texts = b.column("body").to_pylist()
            for who, first, size, h, content in pieces(texts, roller):
                take = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(content), b.column("owner").take(take), b.column("dig").take(take), pa.array(first), pa.array(size)], names=["h", "d", "owner", "dig", "s", "n"])

    body = docs.select("owner", "dig", F.col("text").cast("binary").alias("body"))
    every = cut(body.filter(F.length("body") >= LENGTH).mapInArrow(anchored, "h long, d long, owner long, dig long, s long, n long"), "anchors")
    shared = cut(every.groupBy("h").agg(F.count("*").alias("c"), F.min("d").alias("x"), F.max("d").alias("y")).filter("c > 1").select("h", (F.col("x") != F.col("y")).alias("several")), "shared")
    repeated = cut(every.join(shared, "h"), "repeated")
    drop(every)
    kinds = cut(repeated.groupBy("h", "d").agg(F.count("*").alias("same"), F.min(F.struct("owner", "dig", "s")).alias("at"), F.first("n").alias("n"), F.first("several").alias("several")), "kinds")
    several = kinds.filter("several")
    crowded = cut(several.groupBy("h").count().filter(F.col("count") > GROUP).select("h"), "crowded")
    wanted = cut(several.join(crowded.withColumn("hot", F.lit(True)), "h", "left").select("h", "d", "n", F.coalesce("hot", F.lit(False)).alias("hot"), "at.*"), "wanted")
    asked = cut(wanted.groupBy("owner", "dig").agg(F.collect_list(F.struct("h", "d", "s", "n", "hot")).alias("asked")), "asked")

    def fetched(batches):
        for b in batches:
            for body_, asked_ in zip(b.column("body").to_pylist(), b.column("asked").to_pylist()):
                rows = [(q["h"], q["d"], q["hot"], body_[q["s"] : q["s"] + q["n"]]) for q in asked_]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["h", "d", "hot", "piece"])

    fetched_rows = cut(body.join(asked, ["owner", "dig"]).mapInArrow(fetched, "h long, d long, hot boolean, piece binary"), "pieces")

    def indexed(batches):
        for t in grouped(batches, "h"):
            h, d, piece = t.column("h").to_pylist(), t.column("d").to_pylist(), t.column("piece").to_pylist()
            block, size = {}, 0
            for k in range(len(h) + 1):
                if k == len(h) or size >= BLOCK and h[k] != h[k - 1]:
                    if block:
                        yield from marked(block)
                    block, size = {}, 0
                if k < len(h) and (h[k], d[k]) not in block:  # repeated rows bring a piece twice
                    block[h[k], d[k]] = piece[k]
                    size += len(piece[k])

    def marked(block):
        names = list(block)
        rows = RunLengthIndex(list(block.values())).marks()
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array([names[k][0] for k in rows[:, 0]]), pa.array([names[k][1] for k in rows[:, 0]]), pa.array(rows[:, 1]), pa.array(rows[:, 2])], names=["h", "d", "a", "b"])

    def windowed(batches):
        rollers = Roller(SEED + 1), Roller(SEED + 2)
        for b in batches:
            for h, d, piece in zip(*(b.column(c).to_pylist() for c in ("h", "d", "piece"))):
                w = [r.hashes(np.frombuffer(piece, np.uint8), LENGTH).view(np.int64) for r in rollers]
                k = len(w[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, h)), pa.array(np.full(k, d)), pa.array(np.arange(k)), pa.array(w[0]), pa.array(w[1])], names=["h", "d", "a", "w1", "w2"])

    schema = "h long, d long, a long, b long"
    marks = fetched_rows.filter("not hot").repartition(n, "h").sortWithinPartitions("h").mapInArrow(indexed, schema)
    marks = marks.union(kinds.filter("same > 1").select("h", "d", F.lit(0).cast("long"), F.col("n")))
    if not crowded.isEmpty():
        windows = fetched_rows.filter("hot").dropDuplicates(["h", "d"]).mapInArrow(windowed, "h long, d long, a long, w1 long, w2 long")
        again = cut(windows.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2"), "again")
        hits = windows.join(again, ["w1", "w2"]).select("h", "d", "a")
        runs = hits.groupBy("h", "d").agg(F.sort_array(F.collect_list("a")).alias("at"))
        marks = marks.union(runs.mapInArrow(joined_runs, schema))
    marks = cut(marks.groupBy("h", "d").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "marks")
    found = repeated.join(marks, ["h", "d"]).select("owner", "dig", F.transform("spans", lambda x: F.struct((x["a"] + F.col("s")).alias("a"), (x["b"] + F.col("s")).alias("b"))).alias("spans"))
    return cut(found.groupBy("owner", "dig").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")


def joined_runs(batches):
    """Window starts of a piece as spans of bytes."""
    for b in batches:
        out: list[list[int]] = [[], [], [], []]
        for h, d, at in zip(*(b.column(c).to_pylist() for c in ("h", "d", "at"))):
            at = np.array(at)
            new = np.concatenate([[True], at[1:] > at[:-1] + LENGTH])
            for a, z in zip(at[new].tolist(), at[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(at) - 1]])].tolist()):
                for o, v in zip(out, (h, d, a, z + LENGTH)):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=["h", "d", "a", "b"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(docs: DataFrame, finish, schema: str) -> DataFrame:
    """Apply ``finish(doc_ids, bodies, spans)`` to batches of documents with their merged spans of repeated bytes."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"owner": F.coalesce("doc_id", F.lit(NOBODY)), "dig": F.xxhash64("text")})
    spans = spans_of(rows)

    def apply(batches):
        for b in batches:
            found = [merged([(s["a"], s["b"]) for s in x]) if x else [] for x in b.column("spans").to_pylist()]
            yield finish(b.column("doc_id"), b.column("body").to_pylist(), found)

    body = rows.select("doc_id", "owner", "dig", F.col("text").cast("binary").alias("body"))
    return body.join(spans, ["owner", "dig"], "left").select("doc_id", "body", "spans").mapInArrow(apply, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (doc_id, text)."""

    def finish(ids, bodies, spans):
        rows = []
        for body, found in zip(bodies, spans):
            h, at = hashlib.sha256(), 0
            for a, b in found:
                h.update(body[at:a])
                at = b
            h.update(body[at:])
            rows.append((len(body), sum(b - a for a, b in found), len(found), h.hexdigest()))
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return without(docs, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
