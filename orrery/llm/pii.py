"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Their spans in at most DOCS documents
(whole texts chosen by a hash of doc_id; at most WINDOWS windows: the documented bounds) are the labels from which the
network is trained in numpy. So that it learns more than the patterns, each labelled span is also shown in written-out and
spaced forms that they don't match (labelled alike), and its place also holds numbers that are not personal data (labelled
as none). Windows are laid over every stretch of text within half a window of a mark (MARK: a digit, an at sign, or one of
the written-out forms of at and dot), each overlapping the next by half. Each window is decoded to the probabilities of
its tags; the windows of a stretch are reconciled globally: the best path of tags over the whole stretch under the means
of all windows, so a span may be longer than a window. Spans of which the network is SURE and that pass an exact check of
their kind's form are added where they overlap no pattern's span.

Edge cases: null and empty texts have no spans; texts of any length are searched whole, in time proportional to their
length; without training windows only the patterns' spans remain; repeated rows give equal rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sample

KINDS = ("email", "ip", "card", "phone")
DOCS, WINDOWS, WIDE, HIDDEN, LETTERS, EPOCHS, SEED = 1500, 8000, 64, 16, 12, 10, 5
#: Least mean probability of a span's tags; letters of a stretch that are decoded at a time, and how many of them again.
SURE, PART, AGAIN = 0.6, 4096, 512
DIGEST = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

# The patterns of the base spans. The one of e-mail addresses is searched from its at sign.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]|[\[({<]\s?(?:at|dot)\s?[\])}>]|\sdot\s", re.I)
NUMERIC = re.compile(r"[0-9@]")
AT = re.compile(r"\s*[\[({<]\s?(?:at|@)\s?[\])}>]\s*|\s+at\s+|\s*@\s*", re.I)
DOT = re.compile(r"\s*[\[({<]\s?(?:dot|\.)\s?[\])}>]\s*|\s+dot\s+", re.I)


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind and start."""
    text, out, end = text or "", [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not NUMERIC.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


# --- the network -----------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # none; begin and inside of each kind
ALLOWED = np.array([[(b == 0 or b % 2 == 1 or a == b or a == b - 1) for b in range(TAGS)] for a in range(TAGS)])


def codes(text: str) -> np.ndarray:
    """Character classes: 0 outside of the text, then printable ASCII, other letters, white space and the rest."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    other = np.where(c > 191, 96, np.where((c == 32) | ((c > 8) & (c < 14)), 97, 98))
    return np.where((c > 32) & (c < 127), c - 32, other).astype(np.int64)


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Tagger:
    """Bidirectional LSTM over characters, a linear layer and CRF transitions."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        w = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"emb": rng.normal(0, 0.5, (99, LETTERS)), "out": w(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in "fb":
            self.p["w" + d], self.p["b" + d] = w(LETTERS + HIDDEN, 4 * HIDDEN), np.zeros(4 * HIDDEN)
            self.p["b" + d][HIDDEN : 2 * HIDDEN] = 1

    def lstm(self, x: np.ndarray):
        """(2, n, t, HIDDEN) outputs of both directions, the second from the last letter to the first, and what the way back needs."""
        n, t, _ = x.shape
        both = np.stack([x, x[:, ::-1]])
        w, b = np.stack([self.p["wf"], self.p["wb"]]), np.stack([self.p["bf"], self.p["bb"]])
        own = (both.reshape(2, n * t, LETTERS) @ w[:, :LETTERS] + b[:, None]).reshape(2, n, t, 4 * HIDDEN)
        h, c, steps, out = np.zeros((2, n, HIDDEN), x.dtype), np.zeros((2, n, HIDDEN), x.dtype), [], np.empty((2, n, t, HIDDEN), x.dtype)
        for k in range(t):
            g = own[:, :, k] + h @ w[:, LETTERS:]
            ifo, u, past = sigmoid(g[..., : 3 * HIDDEN]), np.tanh(g[..., 3 * HIDDEN :]), (h, c)
            c = ifo[..., HIDDEN : 2 * HIDDEN] * c + ifo[..., :HIDDEN] * u
            tc = np.tanh(c)
            h = ifo[..., 2 * HIDDEN :] * tc
            out[:, :, k] = h
            steps.append((*past, ifo, u, tc))
        return out, (both, w, steps)

    def lstm_back(self, grad: np.ndarray, held, grads: dict) -> np.ndarray:
        """Put the gradients of both directions' weights into ``grads``; returns that of the letters' embeddings."""
        both, w, steps = held
        _, n, t, _ = both.shape
        gates, before = np.empty((2, n, t, 4 * HIDDEN), both.dtype), np.empty((2, n, t, HIDDEN), both.dtype)
        gh, gc = np.zeros((2, n, HIDDEN), both.dtype), np.zeros((2, n, HIDDEN), both.dtype)
        for k in range(t - 1, -1, -1):
            h, c, ifo, u, tc = steps[k]
            i, f, o = ifo[..., :HIDDEN], ifo[..., HIDDEN : 2 * HIDDEN], ifo[..., 2 * HIDDEN :]
            gh = gh + grad[:, :, k]
            gc = gc + gh * o * (1 - tc * tc)
            g = gates[:, :, k]
            g[..., :HIDDEN], g[..., HIDDEN : 2 * HIDDEN], g[..., 2 * HIDDEN : 3 * HIDDEN], g[..., 3 * HIDDEN :] = gc * u, gc * c, gh * tc, gc * i * (1 - u * u)
            g[..., : 3 * HIDDEN] *= ifo * (1 - ifo)
            before[:, :, k] = h
            gh, gc = g @ w[:, LETTERS:].transpose(0, 2, 1), gc * f
        flat = gates.reshape(2, n * t, -1)
        for d, name in enumerate("fb"):
            grads["w" + name] = np.concatenate([both[d].reshape(n * t, -1), before[d].reshape(n * t, -1)], axis=1).T @ flat[d]
            grads["b" + name] = flat[d].sum(axis=0)
        gx = (flat @ w[:, :LETTERS].transpose(0, 2, 1)).reshape(2, n, t, LETTERS)
        return gx[0] + gx[1][:, ::-1]

    def emissions(self, chars: np.ndarray):
        x = self.p["emb"][chars]
        out, held = self.lstm(x)
        h = np.concatenate([out[0], out[1][:, ::-1]], axis=2)
        return h @ self.p["out"] + self.p["bias"], (x, h, held)

    def sums(self, e: np.ndarray):
        """Of all paths: probability of each tag at each letter, expected transitions, log of the total."""
        n, t, _ = e.shape
        top = e.max(axis=2, keepdims=True)
        own, step = np.exp(e - top), np.where(ALLOWED, np.exp(self.p["trans"]), 0).astype(e.dtype)
        a, b, c = np.empty_like(e), np.ones_like(e), np.empty((n, t, 1), e.dtype)
        x = own[:, 0]
        for k in range(t):
            if k:
                x = (x @ step) * own[:, k]
            c[:, k] = x.sum(axis=1, keepdims=True)
            x = a[:, k] = x / c[:, k]
        own /= c
        for k in range(t - 2, -1, -1):
            b[:, k] = (own[:, k + 1] * b[:, k + 1]) @ step.T
        pairs = step * np.einsum("nta,ntb->ab", a[:, :-1], own[:, 1:] * b[:, 1:])
        return a * b, pairs, np.log(c).sum(axis=(1, 2)) + top.sum(axis=(1, 2))

    def loss(self, chars: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the CRF and its gradients."""
        e, (x, h, held) = self.emissions(chars)
        n, t, _ = e.shape
        ge, gt, z = self.sums(e)
        rows, steps = np.arange(n)[:, None], np.arange(t)
        gold = e[rows, steps, tags].sum() + self.p["trans"][tags[:, :-1], tags[:, 1:]].sum()
        ge[rows, steps, tags] -= 1
        np.add.at(gt, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), -1)
        ge, gt = ge / n, np.where(ALLOWED, gt, 0) / n
        grads = {"out": h.reshape(n * t, -1).T @ ge.reshape(n * t, -1), "bias": ge.sum(axis=(0, 1)), "trans": gt}
        gh = ge @ self.p["out"].T
        gx = self.lstm_back(np.stack([gh[..., :HIDDEN], gh[:, ::-1, HIDDEN:]]), held, grads).reshape(-1, LETTERS)
        at = chars.ravel()
        grads["emb"] = np.stack([np.bincount(at, gx[:, k], len(self.p["emb"])) for k in range(LETTERS)], axis=1)
        return float((z.sum() - gold) / n), grads

    def train(self, chars: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, size: int = 64, rate: float = 0.015) -> list[float]:
        rng, step, losses = np.random.default_rng(SEED), 0, []
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        m1, m2 = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        steps = epochs * max(1, len(chars) // size)
        for _ in range(epochs):
            total = 0.0
            for at in np.array_split(order := rng.permutation(len(chars)), max(1, len(order) // size)):
                loss, grads = self.loss(chars[at], tags[at])
                pace = rate * (1 - 0.9 * step / steps)
                total, step = total + loss * len(at), step + 1
                norm = np.sqrt(sum((g * g).sum() for g in grads.values()))
                for k, g in grads.items():
                    g = (g * min(1, 5 / (norm + 1e-9))).astype(np.float32)
                    m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - np.float32(pace) * (m1[k] / np.float32(1 - 0.9**step)) / (np.sqrt(m2[k] / np.float32(1 - 0.999**step)) + np.float32(1e-8))
            losses.append(total / len(chars))
        return losses

    def marginals(self, chars: np.ndarray) -> np.ndarray:
        """Probability of each tag at each letter of each window."""
        return self.sums(self.emissions(chars)[0])[0]


def best_paths(scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best allowed tags of each row of letters, given (letters, TAGS) scores; no path begins inside of a span."""
    out: list = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
    for lo in range(0, len(order), 256):
        some = order[lo : lo + 256]
        t = len(scores[some[-1]])
        e = np.full((len(some), t, TAGS), -1e4)
        e[:, :, 0] = 0
        for r, k in enumerate(some):
            e[r, : len(scores[k])] = scores[k]
        v = e[:, 0] + np.where((np.arange(TAGS) % 2 == 0) & (np.arange(TAGS) > 0), -1e4, 0)
        barred, back = np.where(ALLOWED, 0, -1e4), np.zeros(e.shape, np.int8)
        for k in range(1, t):
            x = v[:, :, None] + barred
            back[:, k] = x.argmax(axis=1)
            v = x.max(axis=1) + e[:, k]
        tags, rows = np.zeros((len(some), t), np.int64), np.arange(len(some))
        tags[:, -1] = v.argmax(axis=1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[rows, k, tags[:, k]]
        for r, k in enumerate(some):
            out[k] = tags[r, : len(scores[k])]
    return out


def window_starts(text: str) -> list[int]:
    """Starts of windows, half a window apart, over all that is within half a window of a mark; some begin before the text."""
    half, out = WIDE // 2, []
    for m in MARK.finditer(text):
        for k in range(m.start() // half, (m.end() - 1) // half + 1):
            for s in ((k - 1) * half, k * half):
                if not out or s > out[-1]:
                    out.append(s)
    return out


def window(chars: np.ndarray, start: int) -> np.ndarray:
    out = np.zeros(WIDE, np.int64)
    a, b = max(0, start), min(len(chars), start + WIDE)
    out[a - start : b - start] = chars[a:b]
    return out


def windows_of(text: str, spans) -> list[tuple[bytes, bytes]]:
    """Windows of a text and their tags; of overlapping spans the first kind counts."""
    tags, chars = np.zeros(len(text), np.int64), codes(text)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * KINDS.index(kind)
            tags[a] -= 1
    return [(window(chars, s).astype(np.uint8).tobytes(), window(tags, s).astype(np.uint8).tobytes()) for s in window_starts(text)]


def noisy(rng: random.Random, kind: str, text: str) -> str:
    """The same personal data as people write it to be read by people."""
    if kind == "email":
        at, dot = rng.choice([("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", "."), (" @ ", "."), (" AT ", " DOT ")])
        name, host = text.rsplit("@", 1)
        if rng.random() < 0.7:  # other names and hosts, of other lengths
            letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(a, b)))
            name = rng.choice([letters(1, 12), letters(2, 8) + rng.choice("._-") + letters(2, 8)])
            host = ".".join([letters(2, 12) for _ in range(rng.randrange(1, 4))] + [rng.choice(["com", "org", "net", "de", "fr", "es", "edu", "info"])])
        return name + at + host.replace(".", dot)
    if rng.random() < 0.7:  # other digits
        text = ".".join(str(rng.randrange(256)) for _ in range(4)) if kind == "ip" else re.sub("[0-9]", lambda m: rng.choice("0123456789"), text)
    if kind == "ip":
        return text.replace(".", rng.choice([" . ", "[.]", "(.)", ". "]))
    d = digits(text)
    if kind == "card":
        return rng.choice([".", "/", "  ", " - ", "_"]).join(d[i : i + 4] for i in range(0, len(d), 4))
    d = d[-10:].rjust(10, "5")
    a, b, c = d[:3], d[3:6], d[6:]
    return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}/{b}-{c}", f"({a}){b}-{c}"])


def decoy(rng: random.Random) -> str:
    """Numbers and words that look like personal data and are none."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    year = str(rng.randrange(1900, 2040))
    return rng.choice([
        f"{year}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{year}", f"{n(2)}/{n(2)}/{year}", f"{n(1)}.{n(2)}.{n(1)}", f"{n(2)}:{n(2)}:{n(2)}", f"{year}-{n(2)}-{n(2)} {n(2)}:{n(2)}", f"{n(1)},{n(3)},{n(3)}.{n(2)}",
        f"{year} - {year}", n(rng.randrange(1, 13)), f"{n(1)}.{n(1)}", f"v{n(1)}.{n(2)}", f"no. {n(6)}", f"${n(3)}.{n(2)}", f"{n(2)} %", f"at {n(2)}.{n(2)}", "look at the dot on the map", "a dot of ink", f"ISBN {n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}",
        f"{n(3)} x {n(3)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"@{rng.choice(['home', 'noon', 'all'])}", f"{n(2)}, {n(2)}, {n(2)}, {n(2)}", f"{n(3)} {n(3)}",
    ])


def labelled(text: str) -> list[tuple[bytes, bytes]]:
    """Windows of a text with the patterns' spans, and of the places of these with noisy forms and with decoys."""
    base = base_spans(text)
    out = windows_of(text, base)
    rng = random.Random(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest())
    for kind, a, b in base:
        left, right = text[max(0, a - rng.randrange(WIDE)) : a], text[b : b + rng.randrange(WIDE)]
        if NUMERIC.search(left) or NUMERIC.search(right):
            continue
        for tag in (kind, kind, kind, None, None):
            what = noisy(rng, kind, text[a:b]) if tag else decoy(rng)
            out += windows_of(left + what + right, [(tag, len(left), len(left) + len(what))] if tag else [])
        other = rng.choice(["ip", "phone", "card"])  # two of them side by side
        more = re.sub("9", lambda m: rng.choice("0123456789"), {"ip": "19.9.99.19", "phone": "+9 (999) 999-9999", "card": "9999999999999999"}[other])
        at = len(left) + b - a + 1
        out += windows_of(left + text[a:b] + " " + more + right, [(kind, len(left), at - 1), (other, at, at + len(more))])
    return out


def train(docs: DataFrame) -> Tagger | None:
    """Network from at most WINDOWS windows of at most DOCS documents with a digit or an at sign."""
    rows = sample(docs.filter(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]")), "doc_id", DOCS)

    def windows(frames):
        for f in frames:
            yield pd.DataFrame([w for t in f["text"] for w in labelled(t)], columns=["chars", "tags"])

    chosen = cut(rows.select("text").mapInPandas(windows, "chars binary, tags binary").distinct().orderBy(F.xxhash64("chars", "tags"), "chars", "tags").limit(WINDOWS), "windows")

    def fitted(frames):  # one task, whose threads Spark bounds; the driver gets the weights alone
        got = pd.concat([pd.DataFrame({"chars": [], "tags": []}), *frames])
        if len(got):
            got = got.sort_values(["chars", "tags"])
            as_rows = lambda c: np.stack([np.frombuffer(x, np.uint8) for x in got[c]]).astype(np.int64)
            model = Tagger()
            model.train(as_rows("chars"), as_rows("tags"))
            yield pd.DataFrame({"p": [pickle.dumps(model.p)]})

    found = chosen.coalesce(1).mapInPandas(fitted, "p binary").collect()
    if not found:
        return None
    model = Tagger()
    model.p = pickle.loads(found[0][0])
    return model


def plausible(kind: str, text: str) -> bool:
    """The exact check of an added span: the form of its kind, written-out and spaced forms included."""
    d = digits(text)
    if kind == "email":
        if re.search(r"\sat\s", text, re.I) and not DOT.search(text):
            return False  # "look at example.com" names a site
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", DOT.sub(".", AT.sub("@", text))))
    if kind == "ip":
        return bool(re.fullmatch(r"[0-9]{1,3}(\s?[\[(]?\s?\.\s?[\])]?\s?[0-9]{1,3}){3}", text)) and all(int(p) <= 255 for p in re.findall("[0-9]+", text))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d) and bool(re.fullmatch(r"[0-9]+([\s./_-]{1,3}[0-9]{2,})*", text))
    if text[0] == "+":
        return 8 <= len(d) <= 15 and bool(re.fullmatch(r"\+[0-9][0-9\s()./-]*[0-9]", text))
    return bool(re.fullmatch(r"(\([0-9]{3}\)\s?|[0-9]{3}[\s./-]{1,3})[0-9]{3}[\s./-]{1,3}[0-9]{4}", text))


def stretches(starts: list[int]) -> list[list[int]]:
    """Runs of windows that overlap."""
    out: list[list[int]] = []
    for k, s in enumerate(starts):
        if k and s - starts[k - 1] < WIDE:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def parts_of(text: str):
    """(first letter, letter before which its spans begin, window starts) of the parts of a text's stretches; parts of one stretch overlap."""
    step, again = (PART - AGAIN) // (WIDE // 2), AGAIN // (WIDE // 2)
    for run in stretches(window_starts(text)):
        for lo in range(0, len(run), step):
            some = run[lo : lo + step + again]
            yield some[0], run[lo + step] if lo + step < len(run) else some[-1] + WIDE, some


def added_spans(texts: list[str], model: Tagger | None) -> list[list[tuple[str, int, int]]]:
    """Spans that the network adds to each text's base spans."""
    found: list[set] = [set() for _ in texts]
    wait, size = [], 0
    for k, text in enumerate(texts if model is not None else []):
        for part in parts_of(text):
            wait.append((k, *part))
            size += len(part[2])
            if size >= 1024:
                tagged(texts, wait, model, found)
                wait, size = [], 0
    if wait:
        tagged(texts, wait, model, found)
    out = []
    for text, spans in zip(texts, found):
        base = base_spans(text) if spans else []
        out.append([s for s in sorted(spans, key=lambda s: s[1]) if all(s[2] <= a or s[1] >= b for _, a, b in base)])
    return out


def tagged(texts: list[str], parts, model: Tagger, found: list[set]) -> None:
    """Put the spans of some parts of texts into ``found``: windows are decoded together, then each part has its best path."""
    chars = {k: codes(texts[k]) for k in {p[0] for p in parts}}
    got = model.marginals(np.stack([window(chars[k], s) for k, _, _, starts in parts for s in starts]))
    edge = np.minimum(np.arange(WIDE) + 1, WIDE - np.arange(WIDE)).astype(float)[:, None]
    means, at = [], 0
    for k, first, _, starts in parts:
        sums, seen = np.zeros((starts[-1] + WIDE - first, TAGS)), np.zeros((starts[-1] + WIDE - first, 1))
        for s in starts:
            sums[s - first : s - first + WIDE] += edge * got[at]
            seen[s - first : s - first + WIDE] += edge
            at += 1
        means.append(sums / seen)
    for (k, first, last, _), mean, tags in zip(parts, means, best_paths([np.log(m + 1e-9) for m in means])):
        for a in np.nonzero(tags % 2 == 1)[0].tolist():
            b = a + 1
            while b < len(tags) and tags[b] == tags[a] + 1:
                b += 1
            x, y = first + a, first + b
            if 0 <= x < last and y <= len(texts[k]) and mean[np.arange(a, b), tags[a:b]].mean() >= SURE and plausible(kind := KINDS[(tags[a] - 1) // 2], texts[k][x:y]):
                found[k].add((kind, x, y))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def all_spans(texts: list[str], model: Tagger | None) -> list[tuple[list, list]]:
    return [(base_spans(t), more) for t, more in zip(texts, added_spans(texts, model))]


def digest_column(spark, model: Tagger | None, text: str | Column = "text") -> Column:
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DIGEST)
    def digest(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for base, more in all_spans([t or "" for t in texts], held.value):
            rows.append((*(sum(k == s[0] for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return digest(text)


def redact_column(spark, model: Tagger | None, text: str | Column = "text") -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one; null stays null."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for t, (base, more) in zip(texts, all_spans([t or "" for t in texts], held.value)):
            parts, end = [], 0
            for kind, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
                if a >= end:
                    parts += [t[end:a], f"<{kind}>"]
                end = max(end, b)
            out.append(t if t is None else "".join(parts) + t[end:])
        return pd.Series(out, dtype=object)

    return redact(text)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the patterns' spans, their digest and all spans of every document (doc_id, text)."""
    return docs.select("doc_id", digest_column(docs.sparkSession, train(docs)).alias("_d")).select("doc_id", "_d.*")
