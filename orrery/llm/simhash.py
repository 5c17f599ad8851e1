"""SimHash near-dedup by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits. Distinct fingerprints are cut into segments of 22, 21 and 21 bits, each read as a
word of the perfect binary Golay code of length 23 (zero padded). All words within one bit of a segment decode to one or
six codewords; two segments that differ in at most two bits share one of them. Of two fingerprints that differ in at most
two bits, some segment is free of errors and the next one (in a circle) has at most two: so (exact segment, codeword
index of the next) in one of three positions is a key that both have. Keys are joined and every candidate's distance is
verified.

A key shared by more than BUCKET distinct fingerprints is worked on without pairs: fingerprints within two bits have a
common word within one bit, so 65 rows for each fingerprint, grouped by word, give the same links up to reachability.

Edge cases: a null text counts as empty, whose fingerprint is zero and links like any other; so does a document with a null
doc_id, whose component_id is null only where no doc_id can be reached; repeated rows give a row each; an empty table gives
an empty result; texts are fingerprinted whole; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, least_rows
from .components import components
from .runs import grouped

SHINGLE, BUCKET, SEED = 3, 1000, 42
#: Fixed value: generator polynomial of the code.
GENERATOR = 0b110001110101
#: Lowest bit and number of bits of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's word shingles in order, repeats included; of a text without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - k]]).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], "<u8")


def majority(found: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 of none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(found), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, as an unsigned number."""
    return majority(hashes(text, shingle))


def fingerprint_column(text: str | Column = "text", shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return signed(text)


def code_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low and high half of a 23-bit word, and the error of each syndrome."""

    def rest(v: int) -> int:
        while v.bit_length() > 11:
            v ^= GENERATOR << (v.bit_length() - 12)
        return v

    low, high = np.array([rest(v) for v in range(1 << 12)]), np.array([rest(v << 12) for v in range(1 << 11)])
    error = np.zeros(1 << 11, np.int64)
    for n in (1, 2, 3):
        for bits in itertools.combinations(range(23), n):
            e = sum(1 << b for b in bits)
            error[rest(e)] = e
    return low, high, error


def codewords(words: np.ndarray, tables) -> np.ndarray:
    """(n, 24) codeword indexes of the words within one bit of each 23-bit word, in order."""
    low, high, error = tables
    near = words[:, None] ^ np.array([0, *(1 << b for b in range(23))])
    syndrome = low[near & 0xFFF] ^ high[near >> 12]
    return np.sort((near ^ error[syndrome]) >> 11, axis=1)


def keys_of(prints: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for each of the keys of the fingerprints (uint64)."""
    parts = [((prints >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        found = codewords(parts[(k + 1) % 3], tables)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        r, c = np.nonzero(new)
        rows.append(r)
        keys.append(k << 40 | parts[k][r] << 12 | found[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def forest(keys: np.ndarray, prints: np.ndarray, most: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of verified links that connect, without cycles, all rows linked within runs of equal keys."""
    n = len(keys)
    label, out = np.arange(n), ([], [])
    i = np.arange(n - 1)
    lag = 1
    while len(i):
        i = i[(i + lag < n)]
        i = i[keys[i] == keys[i + lag]]
        a = i[np.bitwise_count(prints[i] ^ prints[i + lag]) <= most]
        while len(a := a[label[a] != label[a + lag]]):
            x, y = label[a], label[a + lag]
            top, where = np.unique(np.maximum(x, y), return_index=True)  # each tree hangs on at most one other at a time
            out[0].append(a[where])
            out[1].append(a[where] + lag)
            up = np.arange(n)
            up[top] = np.minimum(x, y)[where]
            while not (up == (hop := up[up])).all():
                up = hop
            label = up[label]
        lag += 1
    return tuple(np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for o in out)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between the numbers (rep long) of distinct fingerprints (fp long) within two bits, enough to connect all."""
    spark = distinct.sparkSession
    tables = spark.sparkContext.broadcast(code_tables())

    def keyed(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            r, k = keys_of(fp.view(np.uint64), tables.value)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[r]), b.column("rep").take(pa.array(r))], names=["key", "fp", "rep"])

    def verified(batches):
        for t in grouped(batches, "key"):
            rep = t.column("rep").to_numpy()
            i, j = forest(t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    def midpoints(batches):
        flips = np.array([0, *(1 << b for b in range(64))], np.uint64)
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            near = (fp[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near), b.column("rep").take(pa.array(np.repeat(np.arange(len(fp)), 65)))], names=["mid", "rep"])

    keys = distinct.mapInArrow(keyed, "key long, fp long, rep long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = cut(keys.groupBy("key").count().filter(F.col("count") > BUCKET).select("key"), "hot")
    if hot.isEmpty():
        return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(verified, "a long, b long")
    cold = keys.join(hot, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key").mapInArrow(verified, "a long, b long")
    crowded = keys.join(hot, "key", "left_semi").select("fp", "rep").distinct().mapInArrow(midpoints, "mid long, rep long")
    crowded = crowded.repartition(n)
    least = cut(crowded.groupBy("mid").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).filter("least < most").select("mid", "least"), "mids")
    joined = crowded.join(least, "mid").filter("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()
    return cold.union(joined)


def linked(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long), component_id and first (one fp of the component) of every document (doc_id, text)."""
    prints = cut(docs.select("doc_id", fingerprint_column("text", shingle).alias("fp")), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.col("fp").alias("rep"), "least"), "distinct")
    found = components(links(distinct.select("fp", "rep")))
    of = distinct.join(found, distinct.fp == found.node, "left").select(F.col("fp").alias("of"), F.coalesce("root", "fp").alias("first"), "least")
    of = cut(of, "classes")
    least = of.groupBy("first").agg(F.min("least").alias("component_id"))
    classes = cut(of.select("of", "first").join(least, "first"), "components")
    return prints.join(classes, prints.fp == classes["of"]).select("doc_id", "fp", "component_id", "first")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document (doc_id, text)."""
    return linked(docs, shingle).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without those that are linked to one with a lesser doc_id; see :func:`orrery.llm.common.least_rows`."""
    return least_rows(docs, cut(linked(docs.select("doc_id", "text"), shingle), "found"), lambda text: fingerprint_column(text, shingle))
