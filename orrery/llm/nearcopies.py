"""Near copies by word shingles: documents whose sets of shingles have a Jaccard similarity of at least some bound.

A document's shingles are hashed to 64 bits; documents with equal sets of hashes are one from then on. Candidates come from
two sources. The first is the SimHash operator: fingerprints of the shingles, linked by its Golay-code keys. At a similarity
of 0.8 fingerprints differ by 10 bits on average, too far for any such key, so each distinct set also gives BANDS keys of
DEPTH minhashes. Two sets of similarity s share one with probability 1 - (1 - s^DEPTH)^BANDS (0.9998 at 0.8, more above),
whatever their length. Each key links all its sets to the least one, so candidates grow with the documents and never with
the square of a key's. Every similarity is then computed exactly within a group of connected candidates; a search from each
document finds all that it reaches, and compares only with those not yet reached.

A group of up to TOKENS shingles is one task's. A larger one is dealt out to blocks of that size (see :func:`split_links`).

Edge cases: words are cut and lowered as in simhash.py; a text of fewer words than a shingle is one shingle; null and empty
texts have no shingle and are like each other only; documents with a null doc_id are compared as all others; repeated
rows give a row each; an empty table gives an empty result; texts are read whole; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import cut, least_rows
from .components import components
from .runs import grouped

SHINGLE, SIMILARITY, BANDS, DEPTH, SEED, STEP = 5, 0.8, 48, 8, 42, 1 << 11
#: Shingles of a block of a large group, and nodes of most shared keys that go to all its blocks.
TOKENS, PIVOTS = 1 << 20, 8


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    return np.unique(simhash.hashes(text, shingle))


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def factors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and offsets of the minhashes, and factors that join a band's minhashes to a key."""
    rng = np.random.default_rng(SEED)
    n = BANDS * DEPTH
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32), rng.integers(0, 1 << 64, (BANDS, DEPTH), np.uint64) | np.uint64(1)


def keys_of(hashes: np.ndarray, tables) -> np.ndarray:
    """The keys of a set of hashes, one for each band; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    a, b, join = tables
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for s in range(0, len(short), STEP):
        np.minimum(least, (short[s : s + STEP, None] * a + b).min(axis=0), out=least)
    x = (least.reshape(BANDS, DEPTH) * join).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def reached(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The number of the piece of each set; sets of at least this similarity, and what they reach, are one piece."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(sizes)])
    piece, mark = np.full(len(sets), -1), np.zeros(token.max(initial=-1) + 1, np.int64)
    rest, at = np.arange(len(sets)), token  # sets that nothing has reached, and their tokens
    n = 0
    while len(rest):
        wait = [rest[0]]
        piece[rest[0]] = n
        rest, at = without(rest, at, sizes, np.arange(len(rest)) > 0)
        while wait and len(rest):
            x = wait.pop()
            own = token[first[x] : first[x + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[at], np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]))
            mark[own] = 0
            like = common >= similarity * (sizes[rest] + sizes[x] - common) - 1e-9
            if like.any():
                piece[rest[like]] = n
                wait += rest[like].tolist()
                rest, at = without(rest, at, sizes, ~like)
        n += 1
    return piece


def without(rest, at, sizes, keep):
    return rest[keep], at[np.repeat(keep, sizes[rest])]


def crossed(few: list[np.ndarray], many: list[np.ndarray], piece: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Alike pairs (few[i], many[j]): one for each i and piece of ``many``; pieces that an i joins are one for the next."""
    sizes, piece, out = np.array([len(s) for s in many], np.int64), piece.copy(), ([], [])
    _, token = np.unique(np.concatenate([*many, *few]), return_inverse=True)
    at, starts = token[: sizes.sum()], np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark, end = np.zeros(token.max() + 1, np.int64), len(at)
    for i, own in enumerate(few):
        start, end = end, end + len(own)
        mark[token[start:end]] = 1
        common = np.add.reduceat(mark[at], starts)
        mark[token[start:end]] = 0
        like = np.flatnonzero(common >= similarity * (sizes + len(own) - common) - 1e-9)
        met, where = np.unique(piece[like], return_index=True)
        out[0].append(np.full(len(met), i))
        out[1].append(like[where])
        if len(met) > 1:
            piece[np.isin(piece, met)] = met[0]
    return np.concatenate(out[0]), np.concatenate(out[1])


def runs_of(batches):
    """The columns of each run of equal ``gid``, as Arrow arrays by name, without rows that repeat a node on one side."""
    for t in grouped(batches, "gid"):
        gid = t.column("gid").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])).tolist()
        for s, e in zip(starts, [*starts[1:], len(gid)]):
            run = t.slice(s, e - s)
            _, first = np.unique(np.stack([run.column("side").to_numpy(), run.column("node").to_numpy()]), axis=1, return_index=True)
            yield {c: run.column(c).take(pa.array(first)).combine_chunks() for c in run.column_names}


def sets_in(held: pa.ListArray) -> list[np.ndarray]:
    values, cuts = held.values.to_numpy(), held.offsets.to_numpy()
    return [values[s:e] for s, e in zip(cuts[:-1], cuts[1:])]


def dealt(groups: DataFrame) -> DataFrame:
    """Whole groups in the order of gid."""
    return groups.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gid").sortWithinPartitions("gid")


def linked_inside(groups: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) from each node to the least of those it reaches within its group; ``groups`` has gid, side, node and set."""

    def pieces(batches):
        for run in runs_of(batches):
            node, piece = run["node"].to_numpy(), reached(sets_in(run["set"]), similarity)
            low = np.full(piece.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, piece, node)
            rest = node != low[piece]
            yield pa.RecordBatch.from_arrays([pa.array(node[rest]), pa.array(low[piece][rest])], names=["a", "b"])

    return dealt(groups.select("gid", "side", "node", "set")).mapInArrow(pieces, "a long, b long")


def linked_across(groups: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect each node of side 1 with all that is like it on side 0 of its group; ``groups`` has gid, side, node, piece and set."""

    def pairs(batches):
        for run in runs_of(batches):
            node, side, sets = run["node"].to_numpy(), run["side"].to_numpy(), sets_in(run["set"])
            few, many = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
            if len(few) and len(many):
                i, j = crossed([sets[k] for k in few], [sets[k] for k in many], run["piece"].to_numpy()[many], similarity)
                x, y = node[few[i]], node[many[j]]
                yield pa.RecordBatch.from_arrays([pa.array(x[x != y]), pa.array(y[x != y])], names=["a", "b"])

    return dealt(groups.select("gid", "side", "node", "piece", "set")).mapInArrow(pairs, "a long, b long")


def block(what: str, count: str):
    """A node's block of ``count``."""
    return F.pmod(F.xxhash64(F.lit(what), "node"), F.col(count)).alias(f"{what}_block")


def every(what: str, count: str):
    """A row for each block of ``count``."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).alias(f"{what}_block")


def split_links(sets: DataFrame, degrees: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all that is linked within large groups; ``sets`` has root, node, size and set, ``degrees`` node and degree.

    Each group is dealt out to blocks of about TOKENS shingles, and its PIVOTS nodes of most shared keys go to every block:
    that finds the links of copies of some originals. Then each node outside the group's largest piece is compared with
    all nodes of the group, block by block, so that no link is lost whatever the shape of a group; the price is the shingles
    of such nodes times those of the group. Only numbers of blocks are joined by group, salted by node."""
    salts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("node"), F.lit(salts)).alias("salt")

    def told(df, facts):
        """``df`` with the facts of each group."""
        return df.withColumn("salt", salt).join(facts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["root", "salt"]).drop("salt")

    def blocks(df, name):
        return df.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(TOKENS)).cast("long").alias(name))

    nodes = sets.select("root", "node", "size").distinct()
    whole = cut(blocks(nodes, "blocks"), "blocks")
    order = Window.partitionBy("root").orderBy(F.desc("degree"), "node")
    pivots = cut(nodes.join(degrees, "node").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= PIVOTS).select("node"), "pivots")
    inside = told(sets, whole).select("root", "node", "set", block("many", "blocks"))
    centre = told(sets.join(pivots, "node", "left_semi"), whole).select("root", "node", "set", every("many", "blocks"))
    groups = inside.union(centre).select(F.xxhash64("root", "many_block").alias("gid"), F.lit(0).alias("side"), "node", "set")
    near = cut(linked_inside(groups, similarity), "near")
    of = cut(pieces_of(nodes, near), "pieces")
    largest = of.groupBy("root", "piece").agg(F.sum("size").alias("n")).groupBy("root").agg(F.max_by("piece", F.struct("n", "piece")).alias("largest"))
    minor = cut(told(of, largest).filter("piece <> largest").select("root", "node", "size"), "minor")
    facts = cut(whole.join(blocks(minor, "minors"), "root"), "facts")
    if facts.isEmpty():
        return near
    held = sets.join(of.select("node", "piece"), "node")
    few = told(held.join(minor.select("node"), "node", "left_semi"), facts).select("root", "node", "piece", "set", F.lit(1).alias("side"), block("few", "minors"), every("many", "blocks"))
    many = told(held, facts).select("root", "node", "piece", "set", F.lit(0).alias("side"), every("few", "minors"), block("many", "blocks"))
    groups = few.union(many).select(F.xxhash64("root", "few_block", "many_block").alias("gid"), "side", "node", "piece", "set")
    return near.union(cut(linked_across(groups, similarity), "across"))


def pieces_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` (node and others) with ``piece``, the least node that each reaches by the edges."""
    found = components(edges).select("node", F.col("root").alias("piece"))
    return nodes.join(found, "node", "left").withColumn("piece", F.coalesce("piece", "node"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, fp (16 bytes), component_id (null where no member has a doc_id) and first (one fp of the component) of every document (doc_id, text)."""

    def keyed(batches):
        tables = factors()
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                all_ = simhash.hashes(t, shingle)
                s = np.unique(all_)
                rows.append((digest(s), simhash.majority(all_), len(s), keys_of(s, tables)))
            fp, mark, size, keys = zip(*rows) if rows else ((),) * 4
            arrays = [pa.array(fp, pa.binary()), pa.array(np.array(mark, np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], names=["doc_id", "fp", "print", "size", "keys"])

    prints = cut(docs.select("doc_id", "text").mapInArrow(keyed, "doc_id long, fp binary, print long, size long, keys array<long>"), "prints")
    one = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("print").alias("print"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    distinct = cut(one.withColumn("node", F.monotonically_increasing_id()), "distinct")
    keys = distinct.select("node", F.explode("keys").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).filter("least < most").select("key", "least", "n"), "shared")
    held = distinct.filter("size > 0").select("node", "print")
    marks = cut(held.groupBy(F.col("print").alias("fp")).agg(F.min("node").alias("rep")), "marks")
    same = held.join(marks.select(F.col("fp").alias("print"), F.col("rep").alias("b")), "print").filter("node <> b").select(F.col("node").alias("a"), "b")
    edges = keys.join(shared, "key").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    found = cut(components(edges.union(same).union(simhash.links(marks)).distinct()), "candidates")
    roots = found.select("node", "root").union(found.select("root", "root")).distinct()
    members = cut(distinct.join(roots, "node").select("node", "fp", "root", "rep", "size"), "members")

    def sets_of(batches):
        seen = set()  # texts of rows without a doc_id
        for b in batches:
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                s = shingles(t, shingle)
                d = digest(s)
                if i is None and d in seen:
                    continue
                if i is None:
                    seen.add(d)
                rows.append((i, d, s.view(np.int64)))
            ids, of, sets = zip(*rows) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(of, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "of", "set"])

    texts = docs.select("doc_id", "text")
    known = texts.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").union(texts.filter("doc_id is null"))
    sets = known.mapInArrow(sets_of, "doc_id long, of binary, set array<long>")
    sets = sets.join(members, (sets["of"] == members.fp) & sets.doc_id.eqNullSafe(members.rep)).select("root", "node", "size", "set")
    large = cut(members.groupBy("root").agg(F.sum("size").alias("size")).filter(F.col("size") > TOKENS).select("root"), "large")
    small = sets.join(large, "root", "left_anti").select(F.col("root").alias("gid"), F.lit(0).alias("side"), "node", "set")
    stars = cut(linked_inside(small, similarity), "stars").select(F.col("a").alias("node"), F.col("b").alias("piece"))
    if not large.isEmpty():
        apart = cut(sets.join(large, "root", "left_semi"), "sets")
        degrees = keys.join(shared, "key").groupBy("node").agg(F.sum("n").alias("degree"))
        stars = stars.union(components(split_links(apart, degrees, similarity)).select("node", "root"))
    of = cut(distinct.join(stars, "node", "left").select(F.col("fp").alias("of"), "rep", F.coalesce("piece", "node").alias("piece")), "pieces")
    classes = of.groupBy("piece").agg(F.min("rep").alias("component_id"), F.min("of").alias("first"))
    named = cut(of.select("of", "piece").join(classes, "piece"), "classes")
    return prints.select("doc_id", "fp").join(named, prints.fp == named["of"]).select("doc_id", "fp", "component_id", "first")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without those that are like one with a lesser doc_id; see :func:`orrery.llm.common.least_rows`."""

    @F.pandas_udf("binary")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(shingles(t, shingle)) for t in texts], dtype=object)

    return least_rows(docs, cut(near_copies(docs.select("doc_id", "text"), shingle, similarity), "found"), fp)
