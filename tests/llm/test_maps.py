"""Operators that work on one document at a time."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from orrery.llm import bpe, decontam, langid, pii, toxicity, urlfilter
from orrery.llm.registry import vocabulary


@pytest.fixture(scope="module")
def word_bpe():
    return bpe.WordBpe(vocabulary("word_bpe_49k.json"))


def test_bpe_equals_library(word_bpe, prose, edge):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rng = random.Random(3)
    bits = ["a", "É", "'s", "'LL", "1", "½", " ", "　", "!!", "日本", "\U0001f600", "́", "ß", "İ", "Σ", "\x1f", "\n", "<|startoftext|>", "<|endoftext|>"]
    texts = [prose(300, k) for k in range(5)] + ["".join(rng.choice(bits) for _ in range(rng.randrange(80))) for _ in range(200)] + [t for t in edge if t is not None] + ["donaudampf" * 60]
    ids = word_bpe.encode_many(texts)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids == want
    assert [word_bpe.decode(i) for i in ids] == [lib.decode(i, skip_special_tokens=False) for i in want]
    assert word_bpe.encode(None) == []
    for w in ("unbelievable", "donaudampfschiff" * 40):
        assert word_bpe.merge_many([w]) == [word_bpe.merge(w.encode())] == [word_bpe.merge_long([*(word_bpe.inner[b] for b in w.encode()[:-1]), word_bpe.last[w.encode()[-1]]])]


def test_bpe_query_on_edge_cases(spark, docs_of, edge):
    got = bpe.digests(docs_of(edge, [None, *range(len(edge) - 2), 3]), vocabulary("word_bpe_49k.json")).collect()
    assert len(got) == len(edge)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got[:2]] == [(0, empty, empty)] * 2
    assert bpe.digests(docs_of([]), vocabulary("word_bpe_49k.json")).count() == 0


def test_bpe_columns(spark):
    path = vocabulary("word_bpe_49k.json")
    df = spark.createDataFrame([("hello world",), (None,)], "text string").withColumn("ids", bpe.encode_column(spark, path))
    rows = df.withColumn("back", bpe.decode_column(spark, path)).collect()
    assert rows[0]["back"] == "hello</w> world</w>" and list(rows[1]["ids"]) == []


def brute_log(seg, word):
    """Sum over all segmentations by recursion."""
    piece = {p: seg.probs[i] for i, p in enumerate(seg.pieces)}

    def total(w):
        if not w:
            return np.ones(len(seg.langs))
        out = np.zeros(len(seg.langs))
        for n in range(1, len(w) + 1):
            if w[:n] in piece:
                out = out + piece[w[:n]] * total(w[n:])
            elif n == 1:
                out = out + langid.UNSEEN * total(w[1:])
        return out

    return np.log(total(langid.START + word))


def test_langid_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"]
    seg = langid.Segmenter(["x", "y"], pieces, rng.dirichlet(np.ones(8), 2).T)
    for w in ("abab", "baba", "aqb", "a"):
        assert np.allclose(seg.log_probs([w])[0], brute_log(seg, w))
    # long words are summed whole: the same as by exact fractions
    from fractions import Fraction

    for w in ("ab" * 100, "q" * 60 + "aba" * 20):
        sums = [[Fraction(1)] * 2] + [[Fraction(0)] * 2 for _ in range(len(w) + 1)]
        text = langid.START + w
        for i in range(len(text)):
            for j in range(i + 1, min(len(text), i + 3) + 1):
                p = seg.probs[pieces.index(text[i:j])] if text[i:j] in pieces else [langid.UNSEEN] * 2 if j == i + 1 else [0, 0]
                for g in (0, 1):
                    sums[j][g] += sums[i][g] * Fraction(float(p[g]))
        want = [math.log(x.numerator) - math.log(x.denominator) for x in sums[len(text)]]
        assert np.allclose(seg.log_probs([w])[0], want)


def test_langid_takes_all_languages_and_only_letters(spark, monkeypatch):
    monkeypatch.setattr(langid, "DOCS", 5)
    rows = [(k, "tion ing the " * 5, "big") for k in range(400)] + [(1000 + k, "schrift zwei ung " * 5, "rare") for k in range(2)]
    rows += [(2000, "½ ² Ⅷ", None), (2001, "schrift zwei", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary("piece_bpe_32k.model")).collect()}
    assert (got[2000]["lang_pred"], got[2000]["score"]) == ("und", 0) and got[2001]["lang_pred"] == "rare"
    assert langid.letters("a½b Ⅷ é_1²") == ["a", "b", "é"]


def test_langid_learns_and_handles_edges(spark, edge):
    r = random.Random(5)
    word = lambda parts: "".join(r.choice(parts) for _ in range(3))
    parts = {"aa": ["ti", "on", "ing"], "bb": ["eau", "ou", "ê"]}
    rows = [(k, " ".join(word(parts[g]) for _ in range(30)), g, "src") for k in range(60) for g in [("aa", "bb")[k % 2]]]
    rows += [(100 + k, t, None, None) for k, t in enumerate(edge)] + [(None, "tion", "aa", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.identify(df, vocabulary("piece_bpe_32k.model")).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["lang_pred"] == ("aa", "bb")[k % 2] for k in range(60))
    assert all(got[100 + k]["lang_pred"] == "und" and got[100 + k]["score"] == 0 for k, t in enumerate(edge) if not any(c.isalpha() for c in t or ""))
    assert not got[None]["held_out"]
    assert langid.identify(df.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(2)
    hosts = ["com", "example.com", "a.example.com", "net", "x.net", "org", "EXAMPLE.org", "com:80", "notexample.com", ""]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/7', '/en/7/8', '/de/81?q=/en/', '/es/#x', '?en/'])}" for _ in range(300)] + [None, "", "nothing", "http://", "a://b://c"]
    rules = [*urlfilter.RULES, ("example.com", "/", "allow"), ("a.example.com", "/en/", "block")]

    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda f: len(f[0])) if fit else (None, "allow")
        return host, path, *best

    df = spark.createDataFrame([(i % 290, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(tuple(map(str, r)) for r in urlfilter.judge(df, rules).collect())
    assert got == sorted(tuple(map(str, (i % 290, *judge(u)))) for i, u in enumerate(urls))
    assert urlfilter.judge(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlfilter.judge(df, []).collect()} == {"allow"}
    again = [*rules, *rules[::-1], ("", "/en/", "block")]
    assert len(urlfilter.passes(again, 20)) > 3 and urlfilter.passes([], 20) == [[]]
    assert sorted(tuple(map(str, r)) for r in urlfilter.judge(df, again, most=20).collect()) == got  # several passes
    odd = spark.createDataFrame([(None, urls[-1]), (None, urls[-1]), (1, None)], "page_id long, url string")
    assert urlfilter.judge(odd, rules, most=1).filter("page_id is null").count() == 2


def test_toxicity_learns_and_ignores_groups(spark, prose):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        words = prose(25, k).split()
        if bad:
            words.insert(rng.randrange(25), rng.choice(["vile", "rotten"]))
        if bad and k % 3 or k % 40 == 1:
            words.insert(0, "muslim")
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(1000, "muslim people met"), (1001, "christian people met"), (1002, None), (1003, "")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(docs, lab).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[k]["predicted"] == int(k % 4 == 0) for k in range(400) if got[k]["held_out"]]) > 0.9
    gap = lambda: abs(math.log(got[1000]["score"]) - math.log(got[1001]["score"]))
    assert gap() < 1.0 and got[1002]["score"] == got[1003]["score"]
    assert toxicity.judge(docs.limit(0), lab.limit(0)).count() == 0


def test_counterfactual_penalty_shrinks_the_gap():
    rows = [(["muslim", "vile"], 1), (["muslim"], 1), (["christian"], 0), (["ok"], 0)] * 20
    names = ["christian", "muslim", "ok", "vile"]
    pairs = [(["muslim"], ["christian"]), (["christian"], ["muslim"])] * 20
    free, held = toxicity.fit(rows, [], names), toxicity.fit(rows, pairs, names)
    gap = lambda m: abs(m.weights.get("muslim", 0) - m.weights.get("christian", 0))
    assert gap(held) < gap(free) / 3
    assert toxicity.exchanged("Women and men") == "men and women" and toxicity.exchanged("none") is None


def brute_spans(text):
    """The patterns as they are written."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_pii_patterns_equal_brute_force():
    rng = random.Random(9)
    bits = ["a.b", "@", "x-y.com", ".", "12", "255", "256", " ", "-", "+1", "(243) ", "555-5526", "4111111111111111", "4111 1111 1111 1111", "é", "1.2.3.4.5.6.7.8", "+", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("a" * 200000) == [] and pii.base_spans("1" * 200000) == [] and pii.base_spans(None) == []


def test_pii_gradients():
    m = pii.Tagger()
    rng = np.random.default_rng(1)
    chars, tags = rng.integers(0, 99, (3, 7)), np.zeros((3, 7), int)
    tags[0, 2:5] = [1, 2, 2]
    loss, grads = m.loss(chars, tags)
    for name in ("wf", "wb", "out", "trans", "emb", "bf", "bias"):
        at = tuple(rng.integers(0, s) for s in m.p[name].shape) if name != "emb" else (chars[0, 3], 2)
        old = m.p[name][at]
        m.p[name][at] = old + 1e-5
        up = m.loss(chars, tags)[0]
        m.p[name][at] = old - 1e-5
        down = m.loss(chars, tags)[0]
        m.p[name][at] = old
        assert grads[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_pii_finds_and_redacts(spark, prose, edge):
    rng = random.Random(1)
    secret = lambda: rng.choice([f"u{rng.randrange(99)}@mail{rng.randrange(9)}.example.com", f"{rng.randrange(256)}.{rng.randrange(256)}.1.{rng.randrange(256)}", f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"])
    rows = [(k, f"{prose(10, k)} {secret()} {prose(10, k + 1)}") for k in range(150)] + [(1000 + k, t) for k, t in enumerate(edge)] + [(None, "a@b.cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        base = brute_spans(t or "")
        assert got[k]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert set(pii.joined(base).split(",")) <= set(got[k]["spans"].split(","))
        assert (got[k]["n_email"], got[k]["n_phone"]) == tuple(sum(s[0] == x for s in base) for x in ("email", "phone"))
    model = pii.train(df)
    assert model is not None
    out = [r[0] for r in df.filter("doc_id < 20").select(pii.redact_column(spark, model)).collect()]
    assert all(re.search("<(email|ip|phone)>", t) and "example.com" not in t for t in out)
    assert pii.train(df.filter("doc_id = 1001")) is None
    assert pii.find(df.limit(0)).count() == 0


def test_pii_best_paths_equal_all_paths():
    import itertools

    rng = np.random.default_rng(4)
    for t in (1, 2, 4):
        e = rng.normal(size=(t, pii.TAGS)) * 3
        fine = lambda p: not (p[0] and p[0] % 2 == 0) and all(pii.ALLOWED[a, b] for a, b in zip(p, p[1:]))
        want = max((p for p in itertools.product(range(pii.TAGS), repeat=t) if fine(p)), key=lambda p: sum(e[k, x] for k, x in enumerate(p)))
        longer = rng.normal(size=(9, pii.TAGS))
        assert pii.best_paths([longer, e])[1].tolist() == list(want)


def test_pii_network_adds_what_the_patterns_miss(spark, prose):
    rng = random.Random(2)
    n = lambda k: str(rng.randrange(10 ** (k - 1), 10**k))
    mail, phone, ip = (lambda: f"u{n(2)}@mail{n(1)}.example.com"), (lambda: f"+1 ({n(3)}) {n(3)}-{n(4)}"), (lambda: ".".join(str(rng.randrange(256)) for _ in range(4)))
    rows = [(k, f"{prose(12, k)} {(mail, phone, ip)[k % 3]()} {prose(12, k + 1)}") for k in range(600)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    missed = [("email", f"{rng.choice('abc')}{n(3)} at mail{n(1)} dot example dot com") for _ in range(20)] + [("email", f"max{n(2)}[at]mail{n(1)}[dot]example[dot]com") for _ in range(20)]
    missed += [("phone", f"({n(3)}) {n(3)}-{n(4)}") for _ in range(20)] + [("phone", f"{n(3)}-{n(3)}-{n(4)}") for _ in range(20)] + [("ip", ip().replace(".", "[.]")) for _ in range(20)]
    texts, want = [], []
    for k, (kind, x) in enumerate(missed):
        left = prose(15, 700 + k) + " "
        texts.append(left + x + " " + prose(15, 800 + k))
        want.append((kind, len(left), len(left) + len(x)))
    assert all(pii.base_spans(t) == [] for t in texts)
    got = pii.added_spans(texts, model)
    found = sum(w in g for g, w in zip(got, want))
    assert found >= 0.8 * len(want), [t for t, g, w in zip(texts, got, want) if w not in g][:5]
    clean = [f"{prose(10, k)} {x} {prose(10, k + 9)}" for k, x in enumerate(["2024-05-17", "version 3.11.4", "at 10.30", "1,234,567.89", "look at the dot", "555", "12:30:45", "1990 - 2000", "4.0."] * 4)]
    assert pii.added_spans(clean, model) == [[]] * len(clean)
    # spans longer than a window, and marks all over a long text
    long_ = "x" * 90 + f"{n(2)}@mail.example.com"
    assert pii.added_spans([long_], model) == [[]] and pii.added_spans(["1" * 20_000, "", " dot " * 3000], model)[1:] == [[], []]


def test_decontamination_equals_brute_force(spark, prose, edge):
    items = [(1, prose(40, 1)), (2, prose(25, 2)), (3, "only three words"), (4, None), (5, ""), (2, prose(25, 2))]
    near = prose(40, 1).split()
    near[1] = "changed"
    far = prose(40, 1).split()
    far[5] = far[15] = far[25] = far[33] = "changed"
    texts = [prose(200, 50) + " " + prose(40, 1) + " " + prose(60, 51), " ".join(near), " ".join(far), prose(100, 52), "say only three words!", prose(25, 2) + " x " + prose(40, 1), " ".join(prose(40, 1).split()[:38]), " ".join(prose(40, 1).split()[:30]), *edge]
    docs = spark.createDataFrame([(k, t, 0.0) for k, t in enumerate(texts)], "doc_id long, text string, similarity double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, bench).collect()}
    want = {(k, i) for k, t in enumerate(texts) for i, x in items if x and brute_match(t or "", x)}
    assert got == want and (0, 1) in got and (1, 1) in got and (2, 1) not in got and (6, 1) in got and (7, 1) not in got
    held = docs.filter(decontam.held_column(docs, bench)).count()
    assert held == len({d for d, _ in want})
    assert decontam.matches(docs, bench.limit(0)).count() == 0 == decontam.matches(docs.limit(0), bench).count()


def brute_match(text, item):
    from collections import Counter

    a, b = decontam.words_of(text.lower()), decontam.words_of(item.lower())
    k = min(5, len(b))
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = grams(b)
    wide = min(len(a), len(b))
    for s in range(len(a) - wide + 1 if wide >= k else 0):
        own = grams(a[s : s + wide])
        if sum((own & want).values()) / sum((own | want).values()) >= 0.8:
            return True
    return False


def test_simhash_index_finds_all_within_radius(prose):
    index = decontam.Index([(k, prose(20, k)) for k in range(60)])
    rng = random.Random(1)
    for n, p in enumerate(index.prints.tolist()):
        q = p
        for b in rng.sample(range(64), decontam.RADIUS):
            q ^= 1 << b
        assert n in index.within(q)


def test_least_hashes_equal_a_sort(spark):
    rng = random.Random(8)
    rows = [(rng.choice("aaab"), i) for i in range(3000)] + [("a", 7)] * 3000 + [("c", 1)] * 50 + [("d", i) for i in range(40)]
    df = spark.createDataFrame(rows, "lang string, doc_id long")
    held: dict[str, set] = {}
    for r in df.selectExpr("lang", "xxhash64(doc_id) AS h").collect():
        held.setdefault(r["lang"], set()).add(r["h"])
    assert langid.least_hashes(df, 100) == {g: sorted(h)[:100][-1] for g, h in held.items()}
    assert langid.least_hashes(df.limit(0), 100) == {}
