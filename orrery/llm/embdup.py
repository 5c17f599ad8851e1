"""Embedding near-dedup by cross-polytope hashing after fast Hadamard rotations.

Equal vectors of a label are one node. A node's unit vector is rotated TABLES x HASHES times (three rounds of random signs
and a fast Hadamard transform); the hash is the signed axis nearest to the rotated vector. A table's bucket joins HASHES
hashes. Each node goes to its own bucket and, multiprobe, to those with the second nearest axis of one hash; two nodes are
candidates if they share any bucket, and each pair is verified once, in the first bucket that both have, by cosine in
double precision. A bucket gives a number of links for each node and a spanning forest of the links, never its pairs. A
bucket of more than BLOCK nodes is cut into blocks, and each two blocks meet in a task of their own.

Edge cases: rows whose vector or label is null, and vectors that are zero, empty, or hold null or non-finite components
link with nothing; only vectors of one length are compared; a row with a null vec_id links like any other, is never kept, and
its component_id is null where no vec_id can be reached; repeated rows count as other vectors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .runs import grouped

TABLES, HASHES, BLOCK, SEED, LEAST = 6, 2, 1024, 11, 0.98


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x


def axes(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> np.ndarray:
    """(n, tables, hashes, 2): the nearest and the second nearest signed axis of each rotation."""
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    rng = np.random.default_rng(SEED)
    out = np.zeros((n, tables, hashes, 2), np.int64)
    for t in range(tables):
        for k in range(hashes):
            x = np.zeros((n, size))
            x[:, :d] = unit
            for signs in rng.choice([-1.0, 1.0], (3, size)):
                x = hadamard(x * signs) / np.sqrt(size)
            first = np.abs(x).argmax(axis=1)
            rows = np.arange(n)
            sign = x[rows, first] < 0
            out[:, t, k, 0] = first * 2 + sign
            x[rows, first] = 0
            second = np.abs(x).argmax(axis=1)
            out[:, t, k, 1] = second * 2 + (x[rows, second] < 0)
    return out


def buckets(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> np.ndarray:
    """(n, tables, 1 + hashes) bucket numbers: its own first, then those of the other probes."""
    a = axes(unit, tables, hashes)
    base = 4 * (1 << max(1, (unit.shape[1] - 1).bit_length()))
    power = base ** np.arange(hashes)
    own = (a[..., 0] * power).sum(axis=2)
    return np.stack([own, *(own + (a[:, :, k, 1] - a[:, :, k, 0]) * power[k] for k in range(hashes))], axis=2)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def verify(x: np.ndarray, probes: np.ndarray, table: int, bucket: int, left: np.ndarray, right: np.ndarray, least: float):
    """Rows (i, j), i in left and j in right, of linked pairs whose first common bucket is this one; left == right takes each pair once."""
    u = unit_rows(x)
    i, j = np.nonzero(u[left] @ u[right].T >= least - 1e-9)
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    # the product of matrices may round otherwise than the plain formula does
    a, b = x[i].astype(np.float64), x[j].astype(np.float64)
    ok = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) >= least
    i, j = i[ok], j[ok]
    same = probes[i][:, :, :, None] == probes[j][:, :, None, :]
    earlier = same[:, :table].any(axis=(1, 2, 3))
    here = np.where(same[:, table], probes[i][:, table, :, None], np.iinfo(np.int64).max).min(axis=(1, 2))
    ok = ~earlier & (here == bucket)
    return i[ok], j[ok]


def near_duplicates(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id long, embedding array<float>, label)."""
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = F.col("embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fit = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & ~F.exists(e, bad) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", e.alias("x"), F.when(fit, F.struct(F.col("label").cast("string").alias("label"), F.size(e).alias("dim"))).alias("g"))
    rows = rows.withColumn("digest", F.when(F.col("g").isNotNull(), F.sha2(F.to_json(F.struct("g", "x")).cast("binary"), 256)))
    nodes = rows.filter("g is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("same"), F.first("g").alias("g"), F.first("x").alias("x"))
    nodes = cut(nodes.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # numbers that hold once written
    kind = vectors.schema["embedding"].dataType.simpleString()

    def hashed(batches):
        for b in batches:
            dims = np.array(b.column("g").field("dim"))
            for d in np.unique(dims):
                at = np.nonzero(dims == d)[0]
                part = b.take(pa.array(at))
                x = np.array(part.column("x").flatten()).reshape(-1, d)
                probes = buckets(unit_rows(x))
                t, k = probes.shape[1:]
                labels = np.array(pd.util.hash_array(np.array(part.column("g").field("label").to_pylist(), object))).view(np.int64)
                for s in range(0, len(at), 2048):
                    p = probes[s : s + 2048].reshape(-1, t * k)
                    row, col = np.nonzero(first_of(p, t, k))
                    keys = (labels[s + row] ^ (np.int64(d) << 40)) * np.int64(-7046029254386353131) + (col // k) * np.int64(1 << 52) + p[row, col]
                    some = part.slice(s, 2048)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array((col // k).astype(np.int32)), pa.array(p[row, col]), pa.array(list(p[row]), pa.list_(pa.int64())), some.column("rep").take(take), some.column("same").take(take), some.column("x").take(take)],
                        names=["key", "t", "bucket", "probes", "rep", "same", "x"],
                    )

    keyed = nodes.mapInArrow(hashed, "key long, t int, bucket long, probes array<long>, rep long, same long, x " + kind)
    crowded = cut(keyed.groupBy("key").count().filter(F.col("count") > BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("cuts")), "crowded")
    dealt = keyed.withColumns({"part": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    if not crowded.isEmpty():
        split = keyed.join(crowded, "key").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
        split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        split = split.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("cuts", "other")
        dealt = dealt.join(crowded, "key", "left_anti").unionByName(split)
    dealt = dealt.withColumn("task", F.xxhash64("key", "i", "j")).repartition(n, "task").sortWithinPartitions("task")

    def counted(batches):
        for t in grouped(batches, "task"):
            task = t.column("task").to_numpy()
            edge = np.concatenate([[0], np.nonzero(np.diff(task))[0] + 1, [len(task)]])
            out: list[list] = [[], [], []]
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a > 1:
                    for o, got in zip(out, group(t.slice(a, b - a))):
                        o.append(got)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["rep", "n", "other"])

    def group(t: pa.Table):
        """(rep, links, -1) for each node with links and (rep, 0, other) for each branch of the forest."""
        t = t.combine_chunks()
        m = t.num_rows
        x = np.array(t.column("x").chunk(0).flatten()).reshape(m, -1)
        probes = np.array(t.column("probes").chunk(0).flatten()).reshape(m, TABLES, 1 + HASHES)
        rep, same, part = (t.column(c).to_numpy() for c in ("rep", "same", "part"))
        i_, j_ = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left = np.nonzero(part == i_)[0]
        right = left if i_ == j_ else np.nonzero(part == j_)[0]
        links, label, branches = np.zeros(m, np.int64), np.arange(m), []
        for s in range(0, len(left), 256):
            rows_ = left[s : s + 256]
            for lo, hi in ((rows_, rows_), (rows_, left[s + 256 :])) if right is left else ((rows_, right),):
                if not len(lo) or not len(hi):
                    continue
                i, j = verify(x, probes, t.column("t")[0].as_py(), t.column("bucket")[0].as_py(), lo, hi, least)
                np.add.at(links, i, same[j])
                np.add.at(links, j, same[i])
                for p, q in zip(i.tolist(), j.tolist()) if (label[i] != label[j]).any() else ():
                    if label[p] != label[q]:
                        branches.append((p, q))
                        label[label == label[p]] = label[q]
        at = np.nonzero(links)[0]
        p, q = (np.array([b[k] for b in branches], np.int64) for k in (0, 1))
        return np.concatenate([rep[at], rep[p]]), np.concatenate([links[at], np.zeros(len(p), np.int64)]), np.concatenate([np.full(len(at), -1, np.int64), rep[q]])

    found = cut(dealt.mapInArrow(counted, "rep long, n long, other long"), "links")
    total = found.filter("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    reach = components(found.filter("n = 0").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classes = nodes.select(F.col("digest").alias("of"), "rep", "same", "least").join(total, "rep", "left").join(reach, F.col("rep") == F.col("node"), "left")
    classes = cut(classes.select("of", "least", (F.coalesce("n", F.lit(0)) + F.col("same") - 1).alias("n"), F.coalesce("root", "rep").alias("top")), "classes")
    classes = cut(classes.drop("least").join(classes.groupBy("top").agg(F.min("least").alias("root")), "top"), "components")
    out = rows.select("vec_id", "digest").join(classes, F.col("digest") == F.col("of"), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def first_of(p: np.ndarray, t: int, k: int) -> np.ndarray:
    """True where a bucket isn't among the row's earlier ones of the same table."""
    p = p.reshape(-1, t, k)
    out = np.ones(p.shape, bool)
    for a in range(1, k):
        for b in range(a):
            out[:, :, a] &= p[:, :, a] != p[:, :, b]
    return out.reshape(-1, t * k)
