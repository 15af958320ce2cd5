"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each document. A two-class latent
model (Dawid and Skene, 1979) fitted by expectation-maximisation on the counts of vote patterns
of all documents estimates the labellers' accuracies; its posteriors then train a linear scorer
over hashed features of word shapes, which scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewfold.llm.common import discard, store, texts_of

BITS, FIT_ROWS, EM_ROUNDS, EPOCHS = 14, 20_000, 60, 300
#: Function words of the four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on with as was be by this are or an from"
    " der die und das in den von zu mit sich auf ist im nicht ein eine als auch es für"
    " de la le et les des en un une du que qui dans est pour au par sur pas avec"
    " el los las que y en un una del se por con no su para al lo como más o".split()
)
_CLASSES = bytes(ord("a") if 97 <= c <= 122 or c >= 128 else ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_shapes: dict[bytes, bytes] = {}


def _shape(word: bytes) -> bytes:
    """A word's character classes with runs joined; kept for the words' raw shapes seen."""
    s = _shapes.get(word)
    if s is None:
        s = bytes(c for k, c in enumerate(word) if k == 0 or c != word[k - 1])
        if len(_shapes) < 20_000 and len(word) <= 40:
            _shapes[word] = s
    return s


def _band(x: float, good: float, bad: float) -> int:
    """1 on good's side, 0 on bad's side, -1 between."""
    if good < bad:
        return 1 if x <= good else 0 if x >= bad else -1
    return 1 if x >= good else 0 if x <= bad else -1


LABELLERS = ("symbols", "capitals", "bars", "repeats", "shouting", "function_words", "punctuation", "lines", "length", "variety")


def describe(text: bytes | None) -> tuple[list[int], dict[int, float]] | None:
    """Votes (1 good, 0 bad, -1 none) and hashed features of a whole text; None without words."""
    text = text or b""
    words = text.split()
    n = len(words)
    if n == 0:
        return None
    raw = Counter(text.translate(_CLASSES).split())
    shapes: Counter = Counter()
    for w, c in raw.items():
        shapes[_shape(w)] += c
    count = lambda chars: sum(text.count(c) for c in chars)
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    caps = sum(c * w.count(b"A") for w, c in raw.items())
    letters = caps + sum(c * w.count(b"a") for w, c in raw.items())
    variety = sum(len(set(words[k : k + 40])) for k in range(0, n, 40)) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    twice = 1 - len(set(lines)) / len(lines)
    function = sum(w in FUNCTION_WORDS for w in text.lower().decode("utf-8", "replace").split()) / n
    marks = count((b"%", b"&", b"*", b"#", b"$", b"@", b"^", b"~")) / len(text)
    bars, shout = text.count(b"|") / n, count((b"!", b"?")) / n
    stops = count((b".", b",")) / n
    votes = [
        _band(marks, 0.02, 0.08),
        _band(caps / letters, 0.25, 0.5) if letters else -1,
        _band(bars, 0.05, 0.25),
        _band(again, 0.05, 0.15) if n >= 8 else -1,
        _band(shout, 0.1, 0.4),
        _band(function, 0.15, 0.03) if n >= 12 else -1,
        _band(stops, 0.03, 0.0) if n >= 12 else -1,
        _band(twice, 0.2, 0.5) if len(lines) >= 4 else -1,
        _band(len(text) / n, 25.0, 60.0),
        _band(variety, 0.6, 0.45) if n >= 12 else -1,
    ]
    slot = lambda name: zlib.crc32(name) & ((1 << BITS) - 1)
    feats: dict[int, float] = {}
    for s, c in shapes.items():
        k = slot(b"s" + s)
        feats[k] = feats.get(k, 0.0) + c / n
    for name, x in ((b"marks", marks * 5), (b"again", again), (b"variety", variety), (b"bars", min(bars, 2.0)), (b"shout", min(shout, 2.0)), (b"caps", caps / max(letters, 1)), (b"twice", twice if len(lines) >= 4 else 0.0), (b"function", function)):
        k = slot(b"f" + name)
        feats[k] = feats.get(k, 0.0) + x
    return votes, feats


def pattern(votes: list[int]) -> int:
    """The votes as one number in base 3."""
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def fit_labellers(counts: dict[int, int], k: int = len(LABELLERS), rounds: int = EM_ROUNDS) -> tuple[float, np.ndarray, dict[int, float]]:
    """(share of good, P(vote | class) as (labeller, class, vote + 1), posterior by pattern)."""
    pats = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[p] for p in pats.tolist()], dtype=float)
    votes = np.array([[p // 3 ** (k - 1 - j) % 3 for j in range(k)] for p in pats.tolist()], dtype=np.int64).reshape(len(pats), k)
    q = np.where((votes == 1).any(axis=1), 0.1, 0.95)  # bad votes are rare and telling
    table, share = np.full((k, 2, 3), 0.5), 0.5
    for _ in range(rounds):
        share = float((q * n).sum() / max(n.sum(), 1))
        for j in range(k):
            for c, r in ((0, 1 - q), (1, q)):
                t = np.bincount(votes[:, j], weights=r * n, minlength=3)[1:] + 1.0
                table[j, c, 1:] = t / t.sum()
        table[:, :, 0] = 1.0  # no vote tells nothing
        log = [np.log(max(x, 1e-12)) + sum(np.log(table[j, c, votes[:, j]]) for j in range(k)) for c, x in ((0, 1 - share), (1, share))]
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return share, table, dict(zip(pats.tolist(), q.tolist()))


def fit_linear(rows: list[tuple[list[int], list[float], float]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic weights (the last is the bias) from (slots, values, posterior), by Adagrad over
    all rows at once; the rarer class is weighted up to equal the other."""
    size = 1 << BITS
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-8)
    if not rows:
        return w
    at = np.concatenate([np.array(i, dtype=np.int64) for i, _, _ in rows])
    val = np.concatenate([np.array(v, dtype=float) for _, v, _ in rows])
    row = np.repeat(np.arange(len(rows)), [len(i) for i, _, _ in rows])
    y = np.array([p for _, _, p in rows])
    each = y / max(y.sum(), 1) + (1 - y) / max((1 - y).sum(), 1)
    each /= each.sum()
    for _ in range(epochs):
        z = np.bincount(row, weights=val * w[at], minlength=len(y)) + w[size]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        g = np.append(np.bincount(at, weights=val * err[row], minlength=size), err.sum())
        g[:size] += decay * w[:size]
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


@dataclass
class QualityModel:
    weights: np.ndarray
    posteriors: dict[int, float]
    share: float
    table: np.ndarray
    threshold: float = 0.5

    def score(self, text: bytes | None) -> float:
        d = describe(text)
        if d is None:
            return 0.0
        z = self.weights[-1] + sum(self.weights[k] * v for k, v in d[1].items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, pattern, slots, values)`` for each row; pattern -1 for a text without words."""

    def run(batches):
        for rows in (x for b in batches for x in texts_of(b)):
            made = [describe(t) for _, t in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([-1 if d is None else pattern(d[0]) for d in made], pa.int64()),
                    pa.array([[] if d is None else list(d[1]) for d in made], pa.list_(pa.int32())),
                    pa.array([[] if d is None else list(d[1].values()) for d in made], pa.list_(pa.float64())),
                ],
                ["doc_id", "pattern", "slots", "values"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, pattern long, slots array<int>, values array<double>")


def _fit(made: DataFrame, fit_rows: int) -> QualityModel:
    counts = {r[0]: r[1] for r in made.where("pattern >= 0").groupBy("pattern").count().collect()}
    share, table, q = fit_labellers(counts)
    total = sum(counts.values())
    part = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(min(1.0, fit_rows / max(total, 1)) * (1 << 30))
    rows = made.where((F.col("pattern") >= 0) & part).limit(2 * fit_rows).collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.pattern))
    return QualityModel(fit_linear([(r.slots, r.values, q[r.pattern]) for r in rows]), q, share, table)


def fit_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> QualityModel:
    """The labellers' model from the vote patterns of all documents (3^10 at most), and the linear
    scorer from about ``fit_rows`` of them, chosen by hash of the id."""
    made = store(features(docs, id_col, text_col), "votes")
    model = _fit(made, fit_rows)
    discard(made)
    return model


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, weak_good, score, keep)`` for each row of ``docs``: the labellers' posterior
    and the scorer's probability that it is good, keep from 0.5.

    A text without words, null ones too, has null weak_good, score 0 and is not kept. Null ids
    and repeated rows are scored like any other. Other columns are not looked at; an empty
    table gives no rows. Texts are read once; the scorer then runs over what was kept of them."""
    made = store(features(docs, id_col, text_col), "votes")
    model = made.sparkSession.sparkContext.broadcast(_fit(made, fit_rows))

    @F.arrow_udf("struct<weak:double,score:double>")
    def predict(pattern: pa.Array, slots: pa.Array, values: pa.Array) -> pa.Array:
        m = model.value
        pats = pattern.to_pylist()
        sizes = np.diff(slots.offsets.to_numpy())
        at, val = (x.flatten().to_numpy() for x in (slots, values))
        z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=val * m.weights[at], minlength=len(sizes)) + m.weights[-1]
        score = np.where(np.array(pats) < 0, 0.0, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return pa.StructArray.from_arrays([pa.array([m.posteriors.get(p) for p in pats], pa.float64()), pa.array(score)], ["weak", "score"])

    done = made.withColumn("p", predict("pattern", "slots", "values"))
    return done.select("doc_id", F.col("p.weak").alias("weak_good"), F.col("p.score").alias("score"), (F.col("p.score") >= 0.5).alias("keep"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs``, with all columns, that the scorer keeps. Each row goes by its own text: null
    ids and repeated rows are judged like any other, texts without words, null ones too, go; an
    empty table gives no rows. The texts stay where they are: no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, id_col, text_col, fit_rows))

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        m = model.value
        return pa.array([m.score(t) >= m.threshold for rows in texts_of(pa.record_batch([text], ["t"]), 0) for (t,) in rows], pa.bool_())

    return docs.where(good(F.col(text_col)))
