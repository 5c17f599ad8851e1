"""Operators that compare documents with each other."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from orrery.llm import components, embdup, lm, nearcopies, simhash, suffixdup


def reach(n, pairs):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return label


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    pairs = [p for p in pairs if p[0] != p[1]]
    df = spark.createDataFrame(pairs + pairs[:5], "a long, b long").repartition(5)
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    want = reach(400, pairs)
    assert all(got.get(k, k) == want[k] for k in range(400))
    assert components.components(df.limit(0)).count() == 0
    nodes, least = components.roots(np.array([5, 7, 9]), np.array([7, 9, 1]))
    assert dict(zip(nodes.tolist(), least.tolist())) == {1: 1, 5: 1, 7: 1, 9: 1}


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_golay_keys_meet_within_two_bits():
    tables = simhash.code_tables()
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 200, np.uint64)
    for flips in (0, 1, 2):
        b = a.copy()
        for k in range(len(a)):
            for bit in rng.choice(64, flips, False):
                b[k] ^= np.uint64(1 << int(bit))
        ra, ka = simhash.keys_of(a, tables)
        rb, kb = simhash.keys_of(b, tables)
        of = lambda r, k: [set(k[r == i].tolist()) for i in range(len(a))]
        assert all(x & y for x, y in zip(of(ra, ka), of(rb, kb)))


@pytest.mark.parametrize("bucket", [1000, 2])
def test_simhash_equals_brute_force(spark, docs_of, prose, edge, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    texts = [prose(60, k) for k in range(30)] + [prose(60, 3)] * 5 + [prose(400, 4).replace(",", "", k) for k in range(12)] + edge
    ids = [k * 3 % 101 for k in range(len(texts))]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(texts, ids)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in ids] == prints
    order = np.argsort(ids)
    pos = {int(o): k for k, o in enumerate(order)}
    pairs = [(pos[a], pos[b]) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = reach(len(ids), pairs)
    assert [got[i]["component_id"] for i in ids] == [ids[order[want[pos[k]]]] for k in range(len(ids))]


def test_simhash_nulls_repeats_and_one_of_each(spark, docs_of, prose, monkeypatch):
    # the numbers in these texts stand for their fingerprints; a null doc_id is the bridge between two others
    with monkeypatch.context() as m:
        m.setattr(simhash, "fingerprint_column", lambda text, shingle=3: simhash.F.col(text).cast("long") if isinstance(text, str) else text.cast("long"))
        chain_ = docs_of(["0", "3", "15", "-1"], [1, None, 2, None])
        chain_ = simhash.cut(simhash.linked(chain_), "chain").select("doc_id", "component_id")
    bridge = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in chain_.collect())
    assert bridge == [(-1, -1), (-1, 1), (1, 1), (2, 1)]
    texts = [prose(50, 1), prose(50, 1), prose(50, 2), prose(50, 3), prose(50, 1), prose(50, 9), prose(50, 2)]
    df = docs_of(texts, [4, 4, 7, None, None, None, 9])
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["component_id"]) for r in simhash.near_duplicates(df).collect() if r["doc_id"] is not None)
    assert [c for _, c in got] == [4, 4, 7, 7]
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each(df).collect())
    assert kept == sorted([(False, 4, texts[0]), (False, 7, texts[2]), (True, 0, texts[3]), (True, 0, texts[5])])
    assert simhash.one_of_each(df).columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def grams(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def alike(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) >= 0.8 * len(a | b) - 1e-9


def changed(text, n, seed):
    r, w = random.Random(seed), text.split()
    for k in r.sample(range(len(w)), n):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


@pytest.mark.parametrize("tokens, pivots", [(nearcopies.TOKENS, nearcopies.PIVOTS), (700, 1), (400, 0)])
def test_near_copies_equal_brute_force(spark, docs_of, prose, edge, monkeypatch, tokens, pivots):
    """Also where each group is split into blocks of two sets or one, with and without pivots."""
    monkeypatch.setattr(nearcopies, "TOKENS", tokens)
    monkeypatch.setattr(nearcopies, "PIVOTS", pivots)
    texts = [prose(300, k) for k in range(12)] + [changed(prose(300, k % 6), n, 10 * n + k) for k in range(12) for n in (1, 2, 4, 7)] + [prose(300, 3) + " end", *edge]
    ids = [k * 7 % 211 for k in range(len(texts))]
    order = np.argsort(ids).tolist()
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if alike(texts[order[i]], texts[order[j]])]
    want = reach(len(ids), pairs)
    got = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs_of(texts, ids)).collect()}
    assert [got[ids[o]] for o in order] == [ids[order[w]] for w in want]


def test_crossed_connects_what_is_alike():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 10, 14).astype(np.int64)) for _ in range(60)]
    few, many = sets[:25], sets[25:]
    like = [(i, j) for i, a in enumerate(few) for j, b in enumerate(many) if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9]
    got = list(zip(*(x.tolist() for x in nearcopies.crossed(few, many, np.arange(len(many)), 0.8))))
    assert set(got) <= set(like) and len(got) < len(like)
    joined = lambda pairs: reach(60, [(25 + j, i) for i, j in pairs])
    assert joined(got) == joined(like)


def test_near_copies_nulls_and_repeats(spark, docs_of, prose):
    t = [prose(200, k) for k in range(5)]
    texts = [t[0], t[0], t[1], changed(t[1], 2, 1), changed(t[0], 2, 2), t[2], changed(t[2], 2, 3), t[3], t[4], changed(t[1], 1, 4)]
    df = docs_of(texts, [4, 4, 7, 9, None, None, None, None, 4, 4])
    kept = [(r["doc_id"], r["text"]) for r in nearcopies.one_of_each(df).collect()]
    nulls = [x for i, x in kept if i is None]
    assert len(nulls) == 2 and t[3] in nulls and set(nulls) <= {t[2], texts[6], t[3]}
    assert sorted((i, x) for i, x in kept if i is not None) == sorted([(4, t[0]), (4, texts[9]), (4, t[4])])
    assert nearcopies.one_of_each(df).columns == df.columns and nearcopies.one_of_each(df.limit(0)).count() == 0


def test_pipeline_drops_near_copies_with_changed_words(spark, docs_of, prose):
    import corpus_pipeline as p

    texts = [prose(300, 1), changed(prose(300, 1), 4, 5), prose(300, 2), changed(prose(300, 2), 60, 6)]
    assert not alike(texts[2], texts[3]) and alike(texts[0], texts[1])
    assert sorted(r["doc_id"] for r in p.drop_near_duplicates(spark, docs_of(texts), None).collect()) == [0, 2, 3]


@pytest.mark.parametrize("of_each", [simhash.one_of_each, nearcopies.one_of_each])
def test_one_of_each_keeps_columns_of_any_names(spark, prose, of_each):
    names = ["m", "_id", "_c", "_of", "_fp", "fp", "id", "row", "of", "odd", "first", "component_id", "a.b"]
    rows = [(4, prose(60, 1)), (4, prose(60, 1)), (None, prose(60, 1)), (None, prose(60, 2)), (None, prose(60, 2)), (6, prose(60, 3)), (6, prose(60, 4))]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], ["doc_id", "text", *names])
    got = of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, {(4, prose(60, 1)), (None, prose(60, 2)), (6, prose(60, 3)), (6, prose(60, 4))}))


def test_embeddings_with_null_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.2], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(7, v, 1), (None, [2.0, 0.0, 0.41], 1), (3, v, 1), (3, v, 1), (None, w, 2), (9, w, None)], "vec_id long, embedding array<float>, label int")
    got = sorted(map(str, (tuple(r) for r in embdup.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(7, 3, 3, False), (None, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 0, None, False), (9, 0, 9, True)]))


def brute_links(vecs, labels):
    n = len(vecs)
    fit = [v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for v, lab in zip(vecs, labels)]
    out = []
    for a in range(n):
        for b in range(a):
            if fit[a] and fit[b] and labels[a] == labels[b] and len(vecs[a]) == len(vecs[b]):
                x, y = np.array(vecs[a], np.float32).astype(float), np.array(vecs[b], np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    out.append((a, b))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embdup, "BLOCK", block)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 64))
    vecs = [(base[k % 12] + rng.normal(scale=0.08 if k % 3 else 0.02, size=64)).tolist() for k in range(120)] + [base[0].tolist()] * 6 + [[0.0] * 64, None, [float("nan")] * 64, [1.0, None] * 32, [], base[1][:32].tolist(), (base[2] * 7).tolist()]
    labels = [k % 12 % 3 for k in range(120)] + [0] * 6 + [0, 0, 0, 0, 0, 1, None]
    df = spark.createDataFrame([(k, v, lab, 5) for k, (v, lab) in enumerate(zip(vecs, labels))], "vec_id long, embedding array<float>, label int, n int")
    got = {r["vec_id"]: r for r in embdup.near_duplicates(df).collect()}
    pairs = brute_links(vecs, labels)
    count = Counter(x for p in pairs for x in p)
    found = sum(r["n_links"] for r in got.values())
    assert len(got) == len(vecs) and found >= 0.97 * 2 * len(pairs) and all(got[k]["n_links"] <= count[k] for k in got)
    want = reach(len(vecs), pairs)
    assert np.mean([got[k]["component_id"] == want[k] for k in got]) > 0.97
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert embdup.near_duplicates(df.limit(0)).count() == 0


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(3, 8))
    h = np.array([[1]])
    for _ in range(3):
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(embdup.hadamard(x), x @ h)


def brute_removed(bodies, length=400):
    c = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        out.append(np.cumsum(hit)[:-1] > 0)
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_suffixes_equal_brute_force(spark, docs_of, prose, edge, monkeypatch, group):
    monkeypatch.setattr(suffixdup, "GROUP", group)
    passage, other = prose(90, 77), prose(120, 78)
    texts = [prose(150, k) for k in range(6)] + [prose(40, 20 + k) + passage + prose(40, 30 + k) for k in range(6)] + [prose(150, 2), "q" * 900, "ab" * 500, passage[:399], passage[:400], other[:410] + "Z" + other[11:500], *edge, passage * 2]
    ids = list(range(len(texts)))
    ids[3], ids[4], ids[5] = None, None, 2
    got = suffixdup.digests(docs_of(texts, ids)).collect()
    bodies = [(t or "").encode() for t in texts]
    want = []
    for i, b, m in zip(ids, bodies, brute_removed(bodies)):
        kept = bytes(np.frombuffer(b, np.uint8)[~m].tobytes()) if len(b) else b""
        spans = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        want.append((str(i), len(b), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert suffixdup.digests(docs_of([])).count() == 0


def test_run_length_index_marks_repeats():
    rng = random.Random(1)
    word = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    for _ in range(20):
        p = word(12)
        strings = [word(5) + p + word(7), word(9) + p, word(30)]
        index = suffixdup.RunLengthIndex(strings)
        got = [np.zeros(len(s), bool) for s in strings]
        for k, a, b in index.marks(10):
            got[k][a:b] = True
        assert all((g == w).all() for g, w in zip(got, brute_removed(strings, 10)))
        assert len(index.run_letters) <= len(index.text)


def test_long_texts_are_cut_without_loss(monkeypatch, prose):
    monkeypatch.setattr(suffixdup, "STARTS", 1000)
    body = prose(1500, 5).encode()
    starts = []
    for who, first, size, h, d in suffixdup.pieces([body], suffixdup.Roller(size=10_000)):
        for a, n in zip(first.tolist(), size.tolist()):
            starts += range(a, a + n - 400 + 1)
    assert starts == list(range(len(body) - 399))


def test_lm_counts_and_beats_unigrams(spark, edge):
    rng = random.Random(8)
    pairs = [("red", "fox"), ("blue", "bird"), ("old", "oak"), ("big", "dog")]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(80)] + edge
    df = spark.createDataFrame([(k, t, 1.0) for k, t in enumerate(texts)] + [(None, "red fox", 1.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in lm.score(df).collect()}
    assert len(got) == len(texts) + 1
    toks = lambda t: (t or "").encode().lower().split() + [None]
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))}
    c = Counter(w for k, t in enumerate(texts) if not out[k] for w in toks(t))
    n, v = sum(c.values()), len(c)
    for k, t in enumerate(texts):
        r = got[k]
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in toks(t))
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[k], len(toks(t)), sum(c[w] > 0 for w in toks(t)), n)
        assert r["base_score"] == pytest.approx(want)
    held = [k for k in range(80) if out[k]]
    assert sum(got[k]["score"] for k in held) > 0.75 * sum(got[k]["base_score"] for k in held)
    assert lm.score(df.limit(0)).count() == 0


def test_lm_learns_word_order_from_every_document(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(8)]) for k in range(2200)]
    ids = spark.createDataFrame([(k,) for k, _ in rows], "doc_id long").filter(lm.training("doc_id", 7))
    late = {r[0] for r in ids.orderBy(lm.F.xxhash64("doc_id")).collect()[1500:]}
    assert len(late) > 300

    def scores(order):  # the documents beyond the first 1500 hashes in another word order: equal counts
        texts = [(k, " ".join(order(w) if k in late else w)) for k, w in rows]
        return {r["doc_id"]: (r["base_score"], r["score"]) for r in lm.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()}

    one, two = scores(sorted), scores(lambda w: sorted(w, reverse=True))
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 7 == 2]
    assert all(one[k][0] == pytest.approx(two[k][0]) for k in held)
    assert sum(abs(one[k][1] - two[k][1]) for k in held) > 0.01 * len(held)


def test_lm_features_use_all_rows():
    h = np.random.default_rng(2).integers(4, 1 << 62, 300_000)
    rows = lm.rows_of(lm.histories(h, np.array([len(h)])), h % lm.LEAVES)
    assert lm.ROWS * lm.BRANCH >= 8192 * 128 and len(np.unique(rows[:, :3])) == lm.ROWS
    assert len(np.unique(rows[:, 3])) == lm.NODES and rows.max() < lm.ROWS + lm.NODES


def lm_case(n, seed=3):
    rng = np.random.default_rng(seed)
    weights = rng.normal(size=(lm.ROWS + lm.NODES, lm.BRANCH)) * 0.3
    hashes = rng.integers(4, 1 << 62, n)
    return weights, lm.histories(hashes, np.array([n // 2, n - n // 2])), rng.integers(0, lm.LEAVES, n)


def test_lm_gradient_is_that_of_the_likelihood():
    w, history, leaf = lm_case(50)
    like = lambda x: lm.log_leaf(x, history, leaf).sum()
    g, rows, taken = lm.gradient(w, history, leaf), lm.rows_of(history, leaf), lm.digits(leaf)
    for at in ((rows[0, 0, 4], taken[0, 4]), (rows[1, 1, 7], 5), (rows[2, 2, 9], taken[2, 9])):
        up, down = w.copy(), w.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        assert g[at[1], at[0]] == pytest.approx((like(up) - like(down)) / 2e-5, abs=1e-3)


def test_lm_leaves_add_up_to_one():
    w, history, _ = lm_case(6)
    total = sum(np.exp(lm.log_leaf(w, history, np.full(6, leaf))) for leaf in range(lm.LEAVES))
    assert np.allclose(total, 1)


def test_lm_changes_are_averaged_by_squares():
    d, s = np.array([[1.0, 2.0], [3.0, 2.0]], np.float32), np.array([[1.0, 0.0], [3.0, 4.0]], np.float32)
    f = lm.pd.DataFrame({"k": [0, 0], "g": [lm.short(a).tobytes() + lm.short(b).tobytes() for a, b in zip(d, s)]})
    got = np.frombuffer(lm.averaged(f)["g"][0], np.float32)
    assert got.tolist() == [2.5, 2.0, 2.5, 4.0]
    x = np.random.default_rng(1).normal(size=100).astype(np.float32)
    assert np.allclose(lm.long(lm.short(x)), x, rtol=0.005)


def test_lm_score_equals_plain_sums(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["red", "fox", "blue", "bird", "old", "oak", f"once{k}"]) for _ in range(30)) for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "TOP", 4)  # the others' counts come by the join
    kept = {}
    first = lm.train
    monkeypatch.setattr(lm, "train", lambda docs, vocab, share: kept.setdefault("w", (vocab, first(docs, vocab, share)))[1])
    got = {r["doc_id"]: r["score"] for r in lm.score(df).collect()}
    vocab, w = kept["w"]
    learn = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 7 != 2]
    count = Counter(x for t in learn for x in [*t.encode().split(), None])
    def leaf_of(x):
        if x is None:
            return 0
        return int(vocab.look(np.array([lm.hash_of(x)], np.uint64).view(np.int64), np.array([lm.form_of(x)]))[0][0])

    held = Counter()
    for x, n in count.items():
        held[leaf_of(x)] += n + 1
    assert len(vocab.hashes) == 4 < len(count)
    for k in (0, 7, 31):
        toks, one, two, want = [*texts[k].encode().split(), None], lm.BEGIN, lm.BEGIN, 0.0
        for x in toks:
            h = lm.END if x is None else int(np.array([lm.hash_of(x)], np.uint64).view(np.int64)[0])
            feats = lm.histories(np.array([two, one, h] if two != lm.BEGIN else [one, h] if one != lm.BEGIN else [h], np.int64), np.array([3 if two != lm.BEGIN else 2 if one != lm.BEGIN else 1]))[:, -1:]
            leaf = leaf_of(x)
            want += lm.log_leaf(w, feats, np.array([leaf]))[0] / math.log(10) + math.log10((count[x] + 1) / (held[leaf] + 1))
            one, two = h, one
        assert got[k] == pytest.approx(want, rel=1e-4)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in p.STAGES[:-1]:
        new = stage(spark, kept, sf_dir).cache()
        assert new.columns == docs.columns and 0 < new.count() <= kept.count(), name
        kept = new
    assert p.STAGES[-1][1](spark, kept, sf_dir).count() == kept.count()
    fp = [brute_print(r[0]) for r in kept.select("text").collect()]
    assert len(set(fp)) > 0.95 * len(fp)
    assert kept.filter("doc_id < 0").count() == 0


def test_pipeline_stages_on_edge_cases(spark, sf_dir, prose, edge):
    import corpus_pipeline as p

    rows = [(k, t, 1, "x") for k, t in enumerate([prose(50, 1), prose(50, 1), *edge])] + [(None, prose(50, 1), 2, "y"), (None, None, 3, "z"), (0, prose(50, 1), 4, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, m int, score string").withColumnRenamed("m", "_id")
    for docs in (df, df.limit(0)):
        for name, stage in p.STAGES[:-1]:
            kept = stage(spark, docs, sf_dir)
            assert kept.columns == docs.columns and kept.count() <= docs.count(), name
        assert p.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
