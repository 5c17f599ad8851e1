"""Language-model scoring with a hashed maximum-entropy model.

A token's probability is that of its class given the two tokens before it, times its own within the class. Classes are the
leaves of a tree of three levels with BRANCH branches at each node (the class-factored softmax), and each branch taken is a
softmax whose log-odds are a sum of rows of weights: one for the bigram feature (token before), one for the trigram feature
(both tokens before), one for the skip feature (second token before), each hashed with the node into ROWS rows, and a row
of the node's own, fixed at its branches' shares of all training tokens. The CLUSTERED most frequent tokens are put in order by what stands next to them (recursive halving of
their co-occurrences with the NEAR most frequent tokens) and cut into leaves of about equal weight, so that a leaf holds
one frequent token or several that are alike; the end of a text is a leaf, and all other tokens fall into FORMS leaves
under the last branch of the root, by the hash of their last letters. Within a leaf, probabilities are smoothed counts.

The weights are trained by distributed gradient updates on all training documents, whole: ROUNDS rounds take disjoint parts
of them (by a hash of doc_id). In a round every task makes AdaGrad steps over its documents, STEP tokens each, from the
weights that were broadcast; the changes of all tasks are averaged on the executors, each weight's by the squared gradients
it has seen, and the driver broadcasts the result (a fixed size). Counts and co-occurrences cover all training documents.
Tokens are known by 64-bit hashes. The TOP most frequent tokens' counts are broadcast (a fixed bound); counts of the others
reach the documents by a join. Texts are scored in sparse numpy batches.

Edge cases: a null text counts as empty and has one token, its end; a null doc_id is neither held out nor learned from;
repeated rows give a row each; with no training document all counts are zero; texts are scored whole; other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, held_out, training

BRANCH, FORMS, ROWS, TOP, CLUSTERED, ROUNDS, RATE, DAMPED, SLICES = 16, 256, 1 << 16, 200_000, 1 << 15, 3, 0.6, 4.0, 64
LEAVES, NODES = BRANCH**3, 1 + BRANCH + BRANCH**2
#: Contexts on either side of a token, numbers that they are projected on, least count of a clustered token.
NEAR, SKETCH, LEAST = 64, 32, 4
END, BEGIN = 1, 2
#: Tokens remembered by a worker, tokens of a step, tokens whose log-odds are worked out at a time.
REMEMBERED, STEP, CHUNK, SEED = 400_000, 1 << 15, 1 << 11, 7
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def form_of(token: bytes) -> int:
    return xxhash.xxh32_intdigest(token[-2:]) % FORMS


def hash_of(token: bytes) -> int:
    return xxhash.xxh3_64_intdigest(token)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Numbers(dict):
    """Numbers of tokens from 1 on, given out at the first look; ``fresh`` gathers the new ones."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        self.fresh.append(token)
        n = self[token] = len(self) + 1
        return n


class Tokens:
    """Hashes, forms and what ``look(hashes, forms)`` says of tokens, in arrays by the number of a token, with a bounded table."""

    def __init__(self, look=lambda hashes, forms: ()):
        self.turn, self.look = 0, look
        self.clear()

    def clear(self):
        self.turn += 1
        self.known = Numbers()
        self.hashes, self.forms = np.array([END], np.int64), np.array([0], np.int64)
        self.seen = self.look(self.hashes, self.forms)

    def numbers(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of the texts one after another, each text's end (number 0) included, and tokens of each text."""
        if len(self.known) > REMEMBERED:
            self.clear()
        at, out, sizes = self.known.__getitem__, [], []
        for t in texts:
            cut_ = tokens_of(t)
            out += map(at, cut_)
            out.append(0)
            sizes.append(len(cut_) + 1)
        if fresh := self.known.fresh:
            h, f = np.array([hash_of(t) for t in fresh], np.uint64).view(np.int64), np.array([form_of(t) for t in fresh], np.int64)
            self.hashes, self.forms = np.concatenate([self.hashes, h]), np.concatenate([self.forms, f])
            self.seen = tuple(np.concatenate(x) for x in zip(self.seen, self.look(h, f)))
            fresh.clear()
        return np.array(out, np.int64), np.array(sizes, np.int64)


class Vocabulary:
    """The most frequent tokens: hashes in order, counts, ranks by count, leaves (of those that are clustered, else -1)."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n: int, distinct: int):
        """hashes and counts by falling count, the end of texts first."""
        order = np.argsort(hashes)
        self.hashes, self.counts, self.rank = hashes[order], counts[order], order.astype(np.int32)
        self.n, self.distinct = n, distinct
        self.leaf = np.where(self.hashes == END, 0, -1).astype(np.int32)
        self.totals = np.zeros(LEAVES)  # log10 of all that a leaf's smoothed counts add up to

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each token among the most frequent, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def ranks(self, hashes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray]:
        """(rank by count, CLUSTERED if not among the most frequent,) of tokens."""
        at = self.find(hashes)
        return (np.where(at >= 0, self.rank[at], CLUSTERED) if len(self.rank) else np.full(len(hashes), CLUSTERED),)

    def look(self, hashes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, count or -1 if not among the most frequent) of tokens."""
        rare = LEAVES - FORMS + forms
        if not len(self.hashes):
            return np.where(hashes == END, 0, rare), np.full(len(hashes), -1)
        at = self.find(hashes)
        leaf = self.leaf[at]
        return np.where(hashes == END, 0, np.where((at >= 0) & (leaf >= 0), leaf, rare)), np.where(at >= 0, self.counts[at], -1)


def before(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two places before each token."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    one = np.concatenate([[BEGIN], hashes[:-1]])
    one[first] = BEGIN
    two = np.concatenate([[BEGIN], one[:-1]])
    two[first] = BEGIN
    return one.astype(np.int64).view(np.uint64), two.astype(np.int64).view(np.uint64)


def histories(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(3, n) hashes of each token's bigram, trigram and skip feature."""
    one, two = before(hashes, sizes)

    def mixed(x, salt):
        x = (x + np.uint64(salt)) * FACTOR
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xBF58476D1CE4E5B9)

    return np.stack([mixed(one, 1), mixed(one * np.uint64(0x94D049BB133111EB) ^ two, 2), mixed(two, 3)])


def digits(leaf: np.ndarray) -> np.ndarray:
    """(3, n) branches taken on the way to each leaf."""
    return np.stack([leaf // BRANCH**2, leaf // BRANCH % BRANCH, leaf % BRANCH])


def rows_of(history: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """(3 levels, 4, n) rows of weights: three features and the node's own."""
    out = np.empty((3, 4, len(leaf)), np.int64)
    for k, node in enumerate((np.zeros(len(leaf), np.int64), 1 + leaf // BRANCH**2, 1 + BRANCH + leaf // BRANCH)):
        x = (history + node.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * FACTOR
        out[k, :3] = (x >> np.uint64(64 - (ROWS - 1).bit_length())).astype(np.int64)
        out[k, 3] = ROWS + node
    return out


def odds(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(3, n, BRANCH) log-odds of the branches at each level, the largest being 0."""
    z = weights.take(rows[:, 0].ravel(), axis=0, mode="clip")
    for k in (1, 2, 3):
        z += weights.take(rows[:, k].ravel(), axis=0, mode="clip")
    z -= z.max(axis=1, keepdims=True)
    return z.reshape(3, -1, BRANCH)


def log_leaf(weights: np.ndarray, history: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """Natural logarithm of each token's leaf's probability."""
    out = np.zeros(len(leaf))
    for s in range(0, len(leaf), CHUNK):
        part = leaf[s : s + CHUNK]
        z = odds(weights, rows_of(history[:, s : s + CHUNK], part))
        taken = np.take_along_axis(z, digits(part)[:, :, None], 2)[:, :, 0]
        np.exp(z, out=z)
        out[s : s + CHUNK] = (taken - np.log(z.sum(axis=2))).sum(axis=0)
    return out


def gradient(weights: np.ndarray, history: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """(BRANCH, ROWS) summed gradient of the leaves' log-likelihood; the nodes' own rows are fixed."""
    rows, taken = rows_of(history, leaf), digits(leaf)[:, :, None]
    e = np.empty((BRANCH, 3, len(leaf)))
    for s in range(0, len(leaf), CHUNK):
        z, hit = odds(weights, rows[:, :, s : s + CHUNK]), taken[:, s : s + CHUNK]
        np.exp(z, out=z)
        z /= -z.sum(axis=2, keepdims=True)
        np.put_along_axis(z, hit, np.take_along_axis(z, hit, 2) + 1, 2)
        e[:, :, s : s + CHUNK] = z.transpose(2, 0, 1)
    at, e = rows[:, :3].transpose(1, 0, 2).ravel(), e.reshape(BRANCH, -1)
    out = np.empty((BRANCH, ROWS), np.float32)
    for k in range(BRANCH):
        out[k] = np.bincount(at, np.concatenate([e[k]] * 3), ROWS)
    return out


def counted_rows(hashes: np.ndarray, forms: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    at = np.nonzero(total)[0]
    return pa.RecordBatch.from_arrays([pa.array(hashes[at]), pa.array(forms[at].astype(np.int32)), pa.array(total[at])], names=["h", "form", "n"])


def count(docs: DataFrame) -> DataFrame:
    """h, form and count of every token of the documents."""

    def counted(batches_):
        for b in batches_:
            tokens, total, turn = Tokens(), np.zeros(1, np.int64), 1
            for run in batches(b.column("text").to_pylist()):
                numbers, _ = tokens.numbers(run)
                if tokens.turn > turn and len(total) > 1:  # the table was full and began anew
                    yield counted_rows(hashes, forms, total)
                    total = np.zeros(1, np.int64)
                add = np.bincount(numbers, minlength=len(tokens.hashes))
                add[: len(total)] += total
                total, turn, hashes, forms = add, tokens.turn, tokens.hashes, tokens.forms
            yield counted_rows(tokens.hashes, tokens.forms, total)

    return docs.select("text").mapInArrow(counted, "h long, form int, n long").groupBy("h").agg(F.first("form").alias("form"), F.sum("n").alias("n"))


def added(f: pd.DataFrame) -> pd.DataFrame:
    """Sum of one slice of the tasks' tables."""
    return pd.DataFrame({"k": [f["k"].iloc[0]], "g": [np.sum([np.frombuffer(g, np.float32) for g in f["g"]], axis=0, dtype=np.float64).astype(np.float32).tobytes()]})


def gathered(docs: DataFrame, work, join) -> np.ndarray | None:
    """One table from the tables of all tasks: ``work(frames)`` yields a task's, as bytes of SLICES slices, and ``join`` is applied to each slice on the executors."""
    tasks = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    parts = tasks.mapInPandas(work, "k int, g binary").groupBy("k").applyInPandas(join, "k int, g binary")
    rows = sorted(parts.collect())  # one table's size, whatever the number of tasks
    return np.frombuffer(b"".join(r["g"] for r in rows), np.float32) if rows else None


def sliced(*tables: np.ndarray) -> pd.DataFrame:
    """The slices of some tables, those with one number one after another."""
    return pd.DataFrame({"k": range(SLICES), "g": [b"".join(c) for c in zip(*([x.tobytes() for x in np.array_split(t.ravel(), SLICES)] for t in tables))]})


def near(docs: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """(CLUSTERED, SKETCH) co-occurrences of the most frequent tokens with the NEAR most frequent ones before and after them, over what frequencies let expect."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)
    share = np.zeros(NEAR + 1)
    top = vocab.rank < NEAR
    share[vocab.rank[top]] = vocab.counts[top] / max(1, vocab.n)
    scale = 1 / np.sqrt(share + 1e-6)
    signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (2 * (NEAR + 1), SKETCH)).astype(np.float32)

    def counted(frames):
        tokens, total = Tokens(words.value.ranks), np.zeros((CLUSTERED, 2, NEAR + 1), np.float32)
        for f in frames:
            for run in batches(f["text"]):
                numbers, _ = tokens.numbers(run)
                rank = tokens.seen[0][numbers]
                for side, (me, other) in enumerate(((rank[1:], rank[:-1]), (rank[:-1], rank[1:]))):
                    hit = (me < CLUSTERED) & (other < NEAR)
                    total[:, side] += np.bincount(me[hit] * (NEAR + 1) + other[hit], minlength=CLUSTERED * (NEAR + 1)).reshape(CLUSTERED, NEAR + 1)
        yield sliced((total * scale.astype(np.float32)).reshape(CLUSTERED, -1) @ signs)

    got = gathered(docs.select("text"), counted, added)
    if got is None:
        return np.zeros((CLUSTERED, SKETCH))
    n = np.zeros(CLUSTERED)
    top = vocab.rank < CLUSTERED
    n[vocab.rank[top]] = vocab.counts[top]
    expected = n[:, None] * np.tile(share * scale, 2) @ signs
    x = (got.reshape(CLUSTERED, SKETCH) - expected) / np.sqrt(n + 5)[:, None]
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True) + SKETCH)


def arranged(x: np.ndarray, weight: np.ndarray, ids: np.ndarray, depth: int = 9) -> np.ndarray:
    """The tokens in an order in which those with like rows of x are close: halves along the direction of the largest spread, and so on."""
    if not depth or len(ids) < 4:
        return ids
    w = weight[ids, None]
    y = x[ids] - (x[ids] * w).sum(axis=0) / w.sum()
    spread = (y * w).T @ y
    along = y @ np.linalg.eigh(spread)[1][:, -1]
    order = ids[np.argsort(along, kind="stable")]
    total = np.cumsum(weight[order])
    half = max(1, min(len(ids) - 1, int(np.searchsorted(total, total[-1] / 2))))
    return np.concatenate([arranged(x, weight, order[:half], depth - 1), arranged(x, weight, order[half:], depth - 1)])


def vocabulary(docs: DataFrame, counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary with its leaves, and the log of each leaf's share of all tokens."""
    top = counts.orderBy(F.desc(F.col("h") == END), F.desc("n"), "h").limit(TOP).toPandas()
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocab = Vocabulary(top["h"].to_numpy(np.int64), top["n"].to_numpy(np.int64), int(n), int(distinct))
    held = np.zeros(LEAVES)  # counts and distinct tokens of each leaf
    kinds = np.zeros(LEAVES)
    for f, a, v in counts.groupBy("form").agg(F.sum("n"), F.count("*")).collect():
        held[LEAVES - FORMS + f], kinds[LEAVES - FORMS + f] = a, v
    ids = np.nonzero((top["n"].to_numpy() >= LEAST) & (np.arange(len(top)) < CLUSTERED) & (top["h"].to_numpy() != END))[0]
    size, form = top["n"].to_numpy(float), top["form"].to_numpy()
    leaf = np.where(top["h"].to_numpy() == END, 0, -1)
    if len(ids):
        order = arranged(near(docs, vocab), np.sqrt(size), ids)
        mass = np.cumsum(size[order] ** 0.3)
        leaf[order] = 1 + ((mass - size[order] ** 0.3 / 2) / mass[-1] * (LEAVES - FORMS - 1)).astype(int)
    moved = np.nonzero(leaf >= 0)[0]
    for table, amount in ((held, size), (kinds, np.ones(len(top)))):
        np.add.at(table, leaf[moved], amount[moved])
        np.add.at(table, LEAVES - FORMS + form[moved], -amount[moved])
    vocab.leaf = leaf[vocab.rank].astype(np.int32)
    vocab.totals = np.log10(held + kinds + 1)
    return vocab, np.log(held + 0.1)


def first_weights(share: np.ndarray) -> np.ndarray:
    """Weights of no feature: each node's own row gives its branches their shares."""
    out = np.zeros((ROWS + NODES, BRANCH), np.float32)
    mass = np.exp(share)
    own = np.concatenate([mass.reshape(BRANCH, -1).sum(axis=1), mass.reshape(BRANCH**2, -1).sum(axis=1), mass])
    out[ROWS:] = np.log(own).reshape(NODES, BRANCH)
    out[ROWS:] -= out[ROWS:].max(axis=1, keepdims=True)
    return out


def learned(weights: np.ndarray, squares: np.ndarray, history: np.ndarray, leaf: np.ndarray) -> None:
    """AdaGrad steps over some tokens; both tables change in place."""
    for s in range(0, len(leaf), STEP):
        g = gradient(weights, history[:, s : s + STEP], leaf[s : s + STEP])
        squares += g * g
        g /= np.sqrt(squares)
        g *= np.float32(RATE)
        weights[:ROWS] += g.T


def short(x: np.ndarray) -> np.ndarray:
    """Floats in 16 bits: the upper half of their 32, rounded."""
    return ((np.ascontiguousarray(x, np.float32).view(np.uint32) + np.uint32(0x8000)) >> np.uint32(16)).astype(np.uint16)


def long(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint32) << np.uint32(16)).view(np.float32)


def averaged(f: pd.DataFrame) -> pd.DataFrame:
    """Mean of one slice of the tasks' changes and of the squared gradients that they saw, each weighted by the latter."""
    change = size = square = 0
    for g in f["g"]:
        d, s = (long(h).astype(np.float64) for h in np.split(np.frombuffer(g, np.uint16), 2))
        change, size, square = change + d * s, size + s, square + s * s
    mean = [np.divide(x, size, out=np.zeros_like(size), where=size > 0).astype(np.float32) for x in (change, square)]
    return pd.DataFrame({"k": [f["k"].iloc[0]], "g": [b"".join(m.tobytes() for m in mean)]})


def train(docs: DataFrame, vocab: Vocabulary, share: np.ndarray) -> np.ndarray:
    """Weights from the documents' texts by ROUNDS rounds of distributed updates."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(vocab)
    part = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS)).alias("round"), "text")
    weights = first_weights(share)
    squares = np.full((BRANCH, ROWS), DAMPED, np.float32)
    for k in range(ROUNDS):
        held = spark.sparkContext.broadcast((weights, squares))

        def updated(frames, held=held):
            tokens, (start, seen), any_ = Tokens(words.value.look), held.value, False
            w, s = start.copy(), seen.copy()
            for f in frames:
                for run in batches(f["text"]):
                    numbers, sizes = tokens.numbers(run)
                    h = tokens.hashes[numbers]
                    learned(w, s, histories(h, sizes), tokens.seen[0][numbers])
                    any_ = True
            if any_:
                yield sliced(short((w - start)[:ROWS]), short(np.ascontiguousarray((s - seen).T)))

        got = gathered(part.filter(F.col("round") == k).select("text"), updated, averaged)
        held.destroy()
        if got is None:
            continue
        change, more = got.reshape(SLICES, 2, -1).transpose(1, 0, 2).reshape(2, ROWS, BRANCH)  # SLICES divides ROWS
        weights[:ROWS] += change
        squares += more.T
    return weights


def score(docs: DataFrame, mod: int = 7) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (doc_id, text)."""
    spark = docs.sparkSession
    learn = docs.filter(training("doc_id", mod))
    counts = cut(count(learn), "counts")
    vocab, share = vocabulary(learn, counts)
    words, weights = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(train(learn, vocab, share))
    names = ["uid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "model", "rare"]

    def local(batches_):
        tokens = Tokens(words.value.look)
        for b in batches_:
            uids, ids, held, texts = b.column("uid"), b.column("doc_id"), b.column("held_out"), b.column("text").to_pylist()
            at = 0
            for run in batches(texts):
                numbers, sizes = tokens.numbers(run)
                h, leaf, seen = tokens.hashes[numbers], tokens.seen[0][numbers], tokens.seen[1][numbers]
                chosen = log_leaf(weights.value, histories(h, sizes), leaf) / np.log(10) - words.value.totals[leaf]
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                add = lambda x: np.add.reduceat(x, first)
                rare = seen < 0
                cuts = np.concatenate([[0], np.cumsum(add(rare.astype(np.int64)))])
                yield pa.RecordBatch.from_arrays(
                    [
                        uids.slice(at, len(sizes)), ids.slice(at, len(sizes)), held.slice(at, len(sizes)), pa.array(sizes), pa.array(add((seen > 0).astype(np.int64))),
                        pa.array(add(np.log10(np.maximum(seen, 0) + 1.0))), pa.array(add(chosen)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(h[rare])),
                    ],
                    names=names,
                )
                at += len(sizes)

    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double, rare array<long>"
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", held_out("doc_id", mod).alias("held_out"), "text").mapInArrow(local, schema)
    rows = cut(rows, "texts")
    rare = rows.select("uid", F.explode("rare").alias("h")).groupBy("uid", "h").agg(F.count("*").alias("tf"))
    more = rare.join(counts.select("h", "n"), "h").groupBy("uid").agg(F.sum("tf").alias("k"), F.sum(F.col("tf") * F.log10(F.col("n") + 1.0)).alias("l"))
    more = cut(more, "rare")
    all_ = rows.drop("rare").join(more, "uid", "left")
    logs = F.col("logs") + F.coalesce("l", F.lit(0.0))
    floor = float(np.log10(vocab.n + vocab.distinct + 1.0))
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
