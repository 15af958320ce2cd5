"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is mined from the training documents: words, and beginnings of words, that toxic
documents hold far more often than others. Features are its densities, its nearness to words of
the second person, capitals, punctuation and signs of obfuscation, all over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewfold.llm.common import texts_of

FIT_ROWS, FIT_CHARS, FIT_TOTAL, MIN_DOCS = 6_000, 200_000, 60_000_000, 6
TREES, DEPTH, RATE, BINS, FOLDS = 80, 3, 0.15, 32, 3
WORD = re.compile(r"[^\W_]+(?:[*@$!'][^\W_]+)*")
SECOND = frozenset("you your yours u ur tu te toi vous votre ton ta du dich dir ihr euch dein deine usted ustedes ti tus vosotros".split())
#: Digits and signs that stand for letters.
PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, "'": None})
MIXED = re.compile(r"[^\W\d_]+[\d@$!*]+[^\W\d_]+")
NAMES = ("log_words", "hits", "hits_share", "kinds", "weight_sum", "weight_share", "weight_max", "stem_hits", "stem_share", "near_second", "second_share", "capital_share", "shout_words", "exclaim", "question", "punctuation", "mixed", "mixed_hits")


def _terms(word: str) -> list[str]:
    """The word, and its beginnings of 4 to 9 letters marked by a star."""
    return [word, *(word[:k] + "*" for k in range(4, min(10, len(word))))]


def lexicons(texts: list[str], toxic: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[dict[str, float]]:
    """For each fold the lexicon of the other folds' texts, and last that of all: term to smoothed
    log-odds, for terms in MIN_DOCS toxic documents at least whose odds are over e^2.5 times the
    base. Texts are read once; a lexicon's counts are those of all less those of its fold."""
    sets = [{w if w.isalpha() else w.translate(PLAIN) for w in WORD.findall(t.lower())} for t in texts]
    positive = [Counter() for _ in range(folds)]
    for s, y, f in zip(sets, toxic, fold):
        if y:
            positive[f].update({x for w in s for x in _terms(w)})
    every = sum(positive, Counter())
    wanted = {t for t, c in every.items() if c >= MIN_DOCS}
    heads = {t[:4] for t in wanted}
    negative = [Counter() for _ in range(folds)]
    for s, y, f in zip(sets, toxic, fold):
        if not y:
            negative[f].update({x for w in s if w[:4] in heads for x in _terms(w) if x in wanted})
    against = sum(negative, Counter())
    out = []
    for f in (*range(folds), None):
        use = fold != f if f is not None else np.ones(len(fold), dtype=bool)
        n1 = int(toxic[use].sum())
        n1, n0 = max(1, n1), max(1, int(use.sum() - n1))
        lex = {}
        for t in sorted(wanted):
            pos = every[t] - (positive[f][t] if f is not None else 0)
            neg = against[t] - (negative[f][t] if f is not None else 0)
            odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
            if pos >= MIN_DOCS and odds > 2.5:
                lex[t] = float(odds)
        out.append(lex)
    return out


def features(text: str | None, lexicon: dict[str, float], heads: frozenset) -> list[float]:
    text = text or ""
    tokens = WORD.findall(text)
    n = len(tokens)
    hits = stems = near = second = shout = mixed_hits = 0
    weights: list[float] = []
    kinds: set[str] = set()
    last_you, last_hits = -10, []
    mixed = 0
    for k, token in enumerate(tokens):
        w = token.lower()
        if len(token) > 1 and token.isupper():
            shout += 1
        if w in SECOND:
            second += 1
            last_you = k
            near += sum(k - h <= 4 for h in last_hits[-4:])
        plain = w if w.isalpha() else w.translate(PLAIN)
        odd = plain is not w and MIXED.fullmatch(w) is not None
        mixed += odd
        if plain[:4] not in heads and plain not in lexicon:
            continue
        best = lexicon.get(plain)
        if best is not None:
            hits += 1
        else:
            for j in range(min(9, len(plain) - 1), 3, -1):
                best = lexicon.get(plain[:j] + "*")
                if best is not None:
                    stems += 1
                    break
        if best is not None:
            weights.append(best)
            kinds.add(plain)
            mixed_hits += odd
            near += k - last_you <= 4
            last_hits.append(k)
    chars = max(len(text), 1)
    letters = max(sum(map(len, tokens)), 1)
    capitals = sum(sum(map(str.isupper, t)) for t in tokens) if shout else sum(t[0].isupper() for t in tokens)
    m = max(n, 1)
    return [
        np.log1p(n), hits, hits / m, len(kinds), sum(weights), sum(weights) / m, max(weights, default=0.0), stems, stems / m,
        near, second / m, capitals / letters, shout / m, text.count("!") / chars, text.count("?") / chars,
        sum(map(text.count, ".,;:!?")) / chars, mixed / m, mixed_hits,
    ]


class Boosted:
    """Boosted regression trees on the logistic loss, over BINS quantile bins per feature."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        b = self._bins(x)
        mean = min(max(float(y.mean()) if n else 0.5, 1e-6), 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        self.grown: list[list[tuple]] = []
        z = np.full(n, self.base)
        for _ in range(self.trees if n else 0):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            nodes: list[tuple] = []
            z += self.rate * self._grow(b, g, h, np.arange(n), 0, nodes)[1]
            self.grown.append(nodes)
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros(x.shape, dtype=np.int64)

    def _grow(self, b, g, h, rows, level, nodes) -> tuple[int, np.ndarray]:
        """Adds a subtree; its root's number and the values it gives (for all rows)."""
        at = len(nodes)
        nodes.append(())
        out = np.zeros(len(g))
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None, None)
        if level < self.depth and len(rows) >= 20:
            for j in range(b.shape[1]):
                k = len(self.cuts[j]) + 1
                if k < 2:
                    continue
                gl = np.bincount(b[rows, j], weights=g[rows], minlength=k).cumsum()[:-1]
                hl = np.bincount(b[rows, j], weights=h[rows], minlength=k).cumsum()[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(hl < 1) | (hs - hl < 1)] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (float(gain[i]), j, i)
        if best[1] is None:
            value = float(-gs / (hs + 1))
            nodes[at] = (-1, 0, 0, 0, value)
            out[rows] = value
            return at, out
        _, j, i = best
        go = b[rows, j] <= i
        left, a = self._grow(b, g, h, rows[go], level + 1, nodes)
        right, c = self._grow(b, g, h, rows[~go], level + 1, nodes)
        nodes[at] = (j, i, left, right, 0.0)
        return at, a + c

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, z = self._bins(x), np.full(len(x), self.base)
        for nodes in self.grown:
            feature, cut, left, right, value = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = np.where(f >= 0, b[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], True)
                at = np.where(f >= 0, np.where(go, left[at], right[at]), at)
            z += self.rate * value[at]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and rising values, smoothed by half a row of each class."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least z, greatest z
    for v, t in zip(z[order].tolist(), y[order].tolist()):
        blocks.append([t, 1.0, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2], hi]
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    values = np.array([(b[0] + 0.5 * 0.1) / (b[1] + 0.1) for b in blocks for _ in (0, 1)])
    return knots, np.maximum.accumulate(values) if len(values) else values


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    heads: frozenset
    trees: Boosted
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts) -> np.ndarray:
        x = np.array([features(t, self.lexicon, self.heads) for t in texts], dtype=float).reshape(-1, len(NAMES))
        z = self.trees.raw(x)
        if not len(self.knots):
            return 1 / (1 + np.exp(-z))
        # a small slope keeps the ranking within the calibrated steps
        return np.clip(np.interp(z, self.knots, self.values) * 0.98 + 0.02 / (1 + np.exp(-z)), 0.0, 1.0)


def fit_toxicity(texts: list[str], toxic) -> ToxicityModel:
    """Out-of-fold lexicons give the trees honest features, and out-of-fold trees the calibration;
    the model kept has the lexicon of all rows."""
    toxic = np.array(toxic, dtype=float)
    fold = np.arange(len(texts)) % FOLDS
    *parts, lex = lexicons(texts, toxic, fold)
    heads = [frozenset(t[:4] for t in p) for p in parts]
    x = np.array([features(t, parts[f], heads[f]) for t, f in zip(texts, fold)], dtype=float).reshape(-1, len(NAMES))
    z = np.zeros(len(texts))
    for f in range(FOLDS):
        z[fold == f] = Boosted().fit(x[fold != f], toxic[fold != f]).raw(x[fold == f])
    knots, values = isotonic(z, toxic)
    return ToxicityModel(lex, frozenset(t[:4] for t in lex), Boosted().fit(x, toxic), knots, values)


def held_out(id_col: str):
    """crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", fit_rows: int = FIT_ROWS, fit_total: int = FIT_TOTAL) -> ToxicityModel:
    """Fit on labelled documents that are not held out: the first ``fit_rows`` labels by hash of
    the id, of texts up to FIT_CHARS characters, and of these the first that have ``fit_total``
    characters together. Only these rows reach the driver; their lengths come first."""
    use = labels.select(F.col(label_id).alias("__id"), F.col(label_col).cast("int").alias("__y")).where(F.col("__id").isNotNull() & F.col("__y").isNotNull() & ~held_out("__id"))
    use = use.groupBy("__id").agg(F.max("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).where(F.length("t") <= FIT_CHARS).join(F.broadcast(use), "__id")
    total, kept = 0, []
    for r in sorted(rows.select(F.xxhash64("__id").alias("h"), "__id", F.length("t").alias("n")).limit(4 * fit_rows).collect()):
        total += r.n
        if total > fit_total and kept:
            break
        kept.append(r.h)
    if kept and total > fit_total:
        rows = rows.where(F.xxhash64("__id") <= kept[-1])
    found = rows.select("__id", "t", "__y").limit(4 * fit_rows).toArrow().sort_by([("__id", "ascending"), ("t", "ascending")])
    return fit_toxicity(found.column("t").to_pylist(), found.column("__y").to_pylist())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``: score is the calibrated
    probability that the text is labelled toxic, predicted is 1 from 0.5.

    Scores come from the text alone. Null texts count as empty, and are scored too; a null id is held
    out; repeated rows are scored alike. Without any usable label all scores are 0.5. Other columns are not looked at; an empty
    table gives no rows. Scoring keeps the texts where they are: no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, **kw))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        m = model.value
        each = [m.scores([None if t is None else t.decode() for (t,) in rows]) for rows in texts_of(pa.record_batch([text], ["t"]), 0)]
        return pa.array(np.concatenate([np.zeros(0), *each]))

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), score(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
