"""Personal data by a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from the spans that the base patterns label in a bounded
sample of documents, and from the same values in forms that the patterns don't read: numbers
without a country code or with other separators, addresses with [at] or [.]. A tagged span
must hold a digit, an at sign or an [at], so only text around such characters can hold one: it
is cut into overlapping windows, each is decoded by Viterbi, and each character takes its tag
from the window in which it lies most centrally. Base spans stay; tagged spans that meet none
of them and have the form of their kind are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, one_text, saved

KINDS = ("email", "ip", "card", "phone")
#: Documents, and windows of them, that the network learns from at most.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOWS_PER_DOC = 1200, 1600, 4
LENGTH, STRIDE, REACH = 48, 24, 16
EMBED, HIDDEN, EPOCHS, BATCH, RATE = 12, 16, 10, 32, 0.02
_TAGS = 1 + 2 * len(KINDS)  # outside, then the first and the next characters of each kind
_DECODE = 512

_ANCHOR = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


# ---------------------------------------------------------------- base patterns
def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str | None) -> list[Span]:
    """The contract's spans, sorted by kind and start. An address is read from its at sign
    outwards, so a long run without one costs no more than its length."""
    if not text or not _ANCHOR.search(text):
        return []
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- windows
def windows(text: str) -> list[tuple[int, int, int]]:
    """(start, end, segment) of the windows around the anchors; those of one segment overlap."""
    out, segment = [], 0
    first = last = None
    for m in [*_ANCHOR.finditer(text), None]:
        p = m.start() if m else None
        if first is not None and (p is None or p - last > 2 * REACH):
            lo, hi = max(0, first - REACH), min(len(text), last + 1 + REACH)
            start = lo
            while start + LENGTH < hi:
                out.append((start, start + LENGTH, segment))
                start = min(start + STRIDE, max(lo, hi - LENGTH))
            out.append((start, min(start + LENGTH, hi), segment))
            segment += 1
            first = None
        if first is None:
            first = p
        last = p
    return out


def encode(pieces: list[str]) -> np.ndarray:
    """Character classes: ASCII as it is, letters beyond it 128, others 129, no character 130."""
    out = np.full((len(pieces), LENGTH), 130, np.int64)
    if pieces:
        flat = np.frombuffer("".join(p.ljust(LENGTH, "￿") for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, LENGTH)
        out = np.where(flat < 128, flat, np.where(flat == 0xFFFF, 130, np.where((flat >= 0xC0) & (flat < 0x2000), 128, 129))).astype(np.int64)
    return out


def labelled(text: str) -> list[tuple[str, bytes]]:
    """Windows of a text with the tags of its base spans."""
    spans = base_spans(text)
    tags = np.zeros(len(text), np.uint8)
    for kind, a, b in reversed(spans):
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return [(text[a:b], tags[a:b].tobytes()) for a, b, _ in windows(text)]


def forms(kind: int, value: str) -> list[str]:
    """Other ways to write a value, which the base patterns don't read."""
    digits = _digits(value)
    if kind == 0:
        local, _, domain = value.partition("@")
        return [f"{local} [at] {domain}", f"{local}(at){domain}", f"{local}[at]{domain}"]
    if kind == 1:
        a, b, c, d = value.split(".")
        return [f"{a}[.]{b}[.]{c}[.]{d}", f"{a}.{b}.{c}[.]{d}", f"{a}(.){b}(.){c}(.){d}"]
    if kind == 2:
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [mark.join(groups) for mark in (".", "/", " - ", "  ")]
    n = digits[-10:]
    if len(n) < 10:
        return []
    a, b, c = n[:3], n[3:6], n[6:]
    return [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[: -10] or '1'} {a} {b} {c}"]


def rewritten(piece: str, tags: bytes) -> list[tuple[str, bytes]]:
    """Training windows with each span that lies inside this one in its other forms."""
    out, i = [], 0
    while i < len(tags):
        kind, j = (tags[i] - 1) // 2, i + 1
        while tags[i] and j < len(tags) and tags[j] == 2 + 2 * kind:
            j += 1
        if tags[i] % 2 and j < len(tags):
            for new in forms(kind, piece[i:j]):
                mark = bytes([1 + 2 * kind]) + bytes([2 + 2 * kind]) * (len(new) - 1)
                text, own = piece[:i] + new + piece[j:], tags[:i] + mark + tags[j:]
                cut = max(0, min(len(text) - LENGTH, i - (LENGTH - len(new)) // 2))
                out.append((text[cut : cut + LENGTH], own[cut : cut + LENGTH]))
        i = j
    return [(t, m) for t, m in out if any(m)]


# ---------------------------------------------------------------- network
def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """The parameters, their gradients and the decoding."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"embed": g(131, EMBED) * 3, "out": g(2 * HIDDEN, _TAGS), "bias": np.zeros(_TAGS, np.float32), "move": np.zeros((_TAGS, _TAGS), np.float32), "first": np.zeros(_TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"{d}x": g(EMBED, 4 * HIDDEN), f"{d}h": g(HIDDEN, 4 * HIDDEN), f"{d}b": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"{d}b"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        wrong = np.zeros((_TAGS, _TAGS), np.float32)
        for k in range(len(KINDS)):  # a next character follows a character of its kind
            wrong[:, 2 + 2 * k] = -1e4
            wrong[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.wrong = wrong
        self.wrong_first = np.where((np.arange(_TAGS) > 0) & (np.arange(_TAGS) % 2 == 0), -1e4, 0).astype(np.float32)

    def _lstm(self, x: np.ndarray, d: str, keep: bool):
        """x: steps x batch x features, already in this direction's order."""
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        wh, pre = self.p[f"{d}h"], x @ self.p[f"{d}x"] + self.p[f"{d}b"]
        hs, trace = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            z = pre[t] + h @ wh
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, was = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                trace.append((i, f, o, g, before, tc, was))
        return hs, trace

    def emissions(self, x: np.ndarray, keep: bool = False):
        e = self.p["embed"][x.T]  # steps x batch x features
        f, tf = self._lstm(e, "f", keep)
        b, tb = self._lstm(e[::-1], "b", keep)
        h = np.concatenate([f, b[::-1]], axis=2)
        return h @ self.p["out"] + self.p["bias"], (e, h, tf, tb)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags y (batch x steps) and its gradients."""
        em, (e, h, tf, tb) = self.emissions(x, True)
        steps, n, _ = em.shape
        move, first = self.p["move"] + self.wrong, self.p["first"] + self.wrong_first
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0] + first
        for t in range(1, steps):
            alpha[t] = em[t] + _log_sum(alpha[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(move + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _log_sum(alpha[-1], 1)
        node = np.exp(alpha + beta - z[None, :, None])
        rows = np.arange(n)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        gold = em[0, rows, y[:, 0]] + first[y[:, 0]]
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + move + (em[t] + beta[t])[:, None, :] - z[:, None, None])
            g["move"] += pair.sum(axis=0)
            np.add.at(g["move"], (y[:, t - 1], y[:, t]), -1)
            gold = gold + em[t, rows, y[:, t]] + move[y[:, t - 1], y[:, t]]
        g["first"] += node[0].sum(axis=0)
        np.add.at(g["first"], y[:, 0], -1)
        dem = node.astype(np.float32)
        dem[np.arange(steps)[:, None], rows[None, :], y.T] -= 1
        g["out"] += np.tensordot(h, dem, ((0, 1), (0, 1)))
        g["bias"] += dem.sum(axis=(0, 1))
        dh = dem @ self.p["out"].T
        de = self._back(e, dh[:, :, :HIDDEN], tf, "f", g) + self._back(e[::-1], dh[::-1, :, HIDDEN:], tb, "b", g)[::-1]
        np.add.at(g["embed"], x.T, de)
        for k in g:
            g[k] /= n
        return float((z - gold).mean()), g

    def _back(self, x: np.ndarray, dhs: np.ndarray, trace: list, d: str, g: dict) -> np.ndarray:
        wh, wx = self.p[f"{d}h"], self.p[f"{d}x"]
        dh, dc = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
        dz = np.empty((len(x), x.shape[1], 4 * HIDDEN), np.float32)
        was = np.stack([s[6] for s in trace])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, c_in, before, tc, _ = trace[t]
            dh = dh + dhs[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * c_in * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - c_in * c_in)], axis=1)
            dc = dc * f
            dh = dz[t] @ wh.T
        g[f"{d}x"] += np.tensordot(x, dz, ((0, 1), (0, 1)))
        g[f"{d}h"] += np.tensordot(was, dz, ((0, 1), (0, 1)))
        g[f"{d}b"] += dz.sum(axis=(0, 1))
        return dz @ wx.T

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Tagger:
        """Adam over shuffled batches."""
        r, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                _, g = self.gradients(x[order[at : at + BATCH]], y[order[at : at + BATCH]])
                rate = RATE * (1 - epoch / epochs)
                for k, a in g.items():
                    m[k] += 0.1 * (a - m[k])
                    v[k] += 0.01 * (a * a - v[k])
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely tags of each window (Viterbi)."""
        out = np.zeros(x.shape, np.uint8)
        move, first = self.p["move"] + self.wrong, self.p["first"] + self.wrong_first
        for at in range(0, len(x), _DECODE):
            em, _ = self.emissions(x[at : at + _DECODE])
            steps, n, _ = em.shape
            score, back = em[0] + first, np.empty(em.shape, np.uint8)
            for t in range(1, steps):
                all_ways = score[:, :, None] + move
                back[t] = all_ways.argmax(axis=1)
                score = all_ways.max(axis=1) + em[t]
            tag = score.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                out[at : at + n, t] = tag
                if t:
                    tag = back[t][np.arange(n), tag]
        return out


# ---------------------------------------------------------------- reconciling
def well_formed(kind: int, piece: str, before: str, after: str) -> bool:
    """Whether a tagged span has the form of its kind and stands by itself."""
    if before.isalnum() or after.isalnum() or not _ANCHOR.search(piece):
        return False
    digits = _digits(piece)
    if kind == 0:
        return re.fullmatch(r"[^\s@]+(?:@|\x20?[\[(]at[\])]\x20?)[^\s@]+\.[^\s@]*\w", piece, re.I) is not None
    if kind == 1:
        parts = re.sub(r"\[\.\]|\(\.\)", ".", piece).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return re.fullmatch(r"[0-9]+(?:[\x20./-]{0,3}[0-9]+)*", piece) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    if re.fullmatch(r"[0-9]{3}\.[0-9]{3}\.[0-9]{4}", piece):
        return True
    return re.fullmatch(r"[+(]?[0-9][0-9\x20().-]*[0-9]", piece) is not None and 7 <= len(digits) <= 15 and re.search(r"[()\x20-]", piece) is not None


def reconcile(text: str, spots: list[tuple[int, int, int]], tags: np.ndarray) -> list[Span]:
    """One sequence of tags for a text from those of its windows, as spans: where windows
    overlap, the one whose ends are farther away decides."""
    out: list[Span] = []
    at = 0
    while at < len(spots):
        end = at
        while end < len(spots) and spots[end][2] == spots[at][2]:
            end += 1
        lo, hi = spots[at][0], spots[end - 1][1]
        tag, near = np.zeros(hi - lo, np.uint8), np.full(hi - lo, -1)
        for w in range(at, end):
            a, b, _ = spots[w]
            place = np.arange(b - a)
            depth = np.minimum(place, b - a - 1 - place)
            better = depth > near[a - lo : b - lo]
            tag[a - lo : b - lo][better] = tags[w, : b - a][better]
            near[a - lo : b - lo][better] = depth[better]
        i = 0
        while i < len(tag):
            if not tag[i]:
                i += 1
                continue
            j, kind = i + 1, (int(tag[i]) - 1) // 2
            while j < len(tag) and tag[j] == 2 + 2 * kind:
                j += 1
            out.append((kind, lo + i, lo + j))
            i = j
        at = end
    return out


def all_spans(texts: list[str | None], tagger: Tagger | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in texts]
    if tagger is None:
        return base, base
    spots = [windows(t) if t else [] for t in texts]
    every, at = [], 0
    pieces = [t[a:b] for t, s in zip(texts, spots) for a, b, _ in s]
    tags = tagger.decode(encode(pieces))
    for text, s, own in zip(texts, spots, base):
        more = []
        for kind, a, b in reconcile(text or "", s, tags[at : at + len(s)]):
            while a < b and text[a] == " ":
                a += 1
            while b > a and text[b - 1] == " ":
                b -= 1
            if all(b <= x or y <= a for _, x, y in own) and well_formed(kind, text[a:b], text[a - 1 : a], text[b : b + 1]):
                more.append((kind, a, b))
        at += len(s)
        every.append(sorted([*own, *more]) if more else own)
    return base, every


# ---------------------------------------------------------------- Spark
def fit(docs: DataFrame, windows_most: int = SAMPLE_WINDOWS) -> Tagger | None:
    """A tagger from windows of at most SAMPLE_DOCS documents with a digit or an at sign, in
    the order of a hash of the id; None if there is no window."""
    some = docs.filter("doc_id IS NOT NULL").filter(F.col("text").rlike(r"[0-9@]|[\[(][aA][tT][\])]"))
    ids = saved(some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS), "sample")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [w for t in pdf["text"] for w in _spread(labelled(t))]
            if rows:
                yield pd.DataFrame(rows, columns=["piece", "tags"])

    rows = one_text(docs, ids, SAMPLE_DOCS).select("text")
    got = rows.mapInPandas(run, "piece string, tags binary").toPandas()
    if not len(got):
        return None
    got["hit"] = [any(t) for t in got["tags"]]
    got["order"] = pd.util.hash_array(got["piece"].to_numpy())
    got = got.drop_duplicates("piece").sort_values(["order", "piece"])
    half = got[got["hit"]].head(windows_most // 2)
    got = pd.concat([half, got[~got["hit"]].head(windows_most - len(half))])
    pairs = list(zip(got["piece"], map(bytes, got["tags"])))
    more = [x for p in pairs for x in rewritten(*p)]
    more = [more[i] for i in np.random.default_rng(5).permutation(len(more))[:windows_most]]
    pairs += more
    y = np.zeros((len(pairs), LENGTH), np.int64)
    for i, (_, t) in enumerate(pairs):
        y[i, : len(t)] = np.frombuffer(t, np.uint8)
    for i, row in enumerate(y):  # a window may begin inside a span
        if row[0] and row[0] % 2 == 0:
            y[i, 0] -= 1
    return Tagger().fit(encode([p for p, _ in pairs]), y)


def _spread(found: list) -> list:
    """At most WINDOWS_PER_DOC of a document's windows, spread over it."""
    step = max(1, -(-len(found) // WINDOWS_PER_DOC))
    return found[::step]


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with the columns base_spans and pii_spans: arrays of (kind, start, end), kind
    being its number, sorted; positions in code points, end exclusive."""
    base, every, one = fresh(docs.columns, "base_spans", "pii_spans", "_found")
    kind = "array<struct<kind:int,start:int,stop:int>>"
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand weights

    @F.pandas_udf(f"b {kind}, a {kind}")
    def of(text: pd.Series) -> pd.DataFrame:
        out = [[], []]
        for i in range(0, len(text), _DECODE):
            for col, spans in zip(out, all_spans(list(text.iloc[i : i + _DECODE]), shared.value)):
                col += [[{"kind": k, "start": a, "stop": b} for k, a, b in s] for s in spans]
        return pd.DataFrame({"b": out[0], "a": out[1]})

    return docs.withColumn(one, of(F.col("text"))).withColumns({base: F.col(one)["b"], every: F.col(one)["a"]}).drop(one)


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans. A null or
    empty text has no span, a very long one is read whole; where two tags are as likely the lower
    one is taken; repeated rows repeat; empty in, empty out; extra columns, of whatever name, don't
    matter."""
    rows = find(docs.select("doc_id", "text"), fit(docs))
    name = F.array(*map(F.lit, KINDS))

    def joined(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["stop"])), ",")

    counts = [F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]  # noqa: B023
    return rows.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("pii_spans").alias("spans"))
