"""Mixing sources to target weights by iterative proportional fitting.

Token totals per cell (source, language, topic) are raked until their marginals meet the targets;
a cell's multiplier, scaled to a token budget, is its documents' sampling probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewfold.llm.common import fresh, texts_of

DIMS = ("source", "lang", "topic")
#: Share of each marginal's own token share that its target keeps: share^power, normalised.
POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.0}
#: Rounds end earlier when every marginal meets its target to within TOLERANCE of the total.
ROUNDS, TOLERANCE, FRACTION, MAX_CELLS = 25, 1e-12, 0.5, 1_000_000
_GAP = np.isin(np.arange(256), (9, 10, 13, 32))
#: Topics of the query, by the first letters of words; ties go to the first.
TOPICS = {"a-d": "abcd", "e-h": "efgh", "i-p": "ijklmnop", "q-z": "qrstuvwxyz"}


def measure(text: bytes | None, kinds: np.ndarray, n: int) -> tuple[int, int]:
    """Words, parted by spaces, tabs and line ends, and the topic (of ``n``) to which most words'
    first byte belongs by ``kinds``; ties and no words: the first."""
    x = np.frombuffer(text or b"", dtype=np.uint8)
    gap = np.ones(len(x) + 1, dtype=bool)
    gap[1:] = _GAP[x]
    first = x[gap[:-1] & ~gap[1:]]
    return len(first), int(np.bincount(kinds[first], minlength=n + 1)[:n].argmax())


def tokens_and_topic(text: Column, topics: dict[str, str] = TOPICS) -> Column:
    """Struct (n, topic) of a whole text, in Arrow batches."""
    names = list(topics)
    kinds = np.full(256, len(names), dtype=np.int64)
    for k, letters in enumerate(topics.values()):
        kinds[list((letters.lower() + letters.upper()).encode())] = k

    @F.arrow_udf("struct<n:long,topic:string>")
    def run(texts: pa.Array) -> pa.Array:
        made = [measure(t, kinds, len(names)) for rows in texts_of(pa.record_batch([texts], ["t"]), 0) for (t,) in rows]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in made], pa.int64()), pa.array([names[k] for _, k in made], pa.string())], ["n", "topic"])

    return run(text)


def rake(cells: list[tuple], totals: np.ndarray, targets: list[dict], rounds: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells after at most ``rounds`` rounds over the dimensions in turn, each
    scaling a dimension's sums to its target shares of the total. Rounds end once every marginal is
    within ``tolerance`` of the total; targets that no weights of these cells can meet go on to the
    end. Targets are for values that hold weight."""
    w = totals.astype(float).copy()
    index = [np.unique([c[d] for c in cells], return_inverse=True) for d in range(len(targets))]
    goals = [np.array([t.get(x, 0.0) for x in names]) for (names, _), t in zip(index, targets)]
    goals = [g * (totals.sum() / g.sum()) if g.sum() > 0 else g for g in goals]
    sums = lambda at, goal: np.bincount(at, weights=w, minlength=len(goal))
    for _ in range(rounds):
        if all(np.abs(sums(at, goal) - goal).max(initial=0) <= tolerance * totals.sum() for (_, at), goal in zip(index, goals)):
            break
        for (_, at), goal in zip(index, goals):
            now = sums(at, goal)
            w *= np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[at]
    return w


def probabilities(totals: np.ndarray, weights: np.ndarray, budget: float) -> np.ndarray:
    """min(1, s * weight / total) with s such that the expected tokens are ``budget``: cells in
    falling order of their multiplier are filled up until the rest can share what is left."""
    f = np.where(totals > 0, weights / np.where(totals > 0, totals, 1), 0.0)
    order = np.lexsort((np.arange(len(f)), -f))
    left = np.cumsum((totals * f)[order][::-1])[::-1]  # of the cells from each one on
    full = np.cumsum(totals[order]) - totals[order]
    some = np.flatnonzero(left > 0)
    if not len(some):
        return np.zeros(len(f))
    s = (budget - full[some]) / left[some]
    fits = np.flatnonzero(s * f[order[some]] <= 1)
    return np.minimum(1.0, np.maximum(s[fits[0] if len(fits) else -1], 0.0) * f)


def tempered(cells: list[tuple], totals: np.ndarray, d: int, power: float) -> dict:
    sums: dict = {}
    for c, t in zip(cells, totals):
        sums[c[d]] = sums.get(c[d], 0.0) + float(t)
    return {k: v**power for k, v in sums.items() if v > 0}


def unit(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id: the first 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(docs: DataFrame, dims=DIMS, targets: dict[str, dict] | None = None, powers: dict[str, float] = POWERS, fraction: float = FRACTION, rounds: int = ROUNDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", topics: dict[str, str] = TOPICS, topic_col: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens, topic, weight, probability, sampled`` (columns of these names are
    replaced). Target shares of a dimension are ``targets[dim]`` or else tempered by
    ``powers[dim]``; values that ``targets[dim]`` leaves out get no weight.

    Null dimension values count as ''. A text without words counts as one token, so that every
    document can be drawn. A document is drawn when a number made from its id is below its
    probability, so rows repeated under one id are drawn together, and again in any order of
    rows. ``weight`` is the cell's calibrated multiplier over the probability, for what
    truncation at 1 leaves out. An empty table gives no rows.

    ``topic_col``: the column that holds each document's topic, where a classifier has given one;
    without it, ``topics`` names topics by the first letters (ASCII, either case) of words, a
    stand-in. Rounds end when the targets are met, see ``rake``. The corpus is only summed per cell, with map-side combining; the texts are not moved. The
    cells, source by language by topic, are raked on the driver up to MAX_CELLS, which is
    checked, and their probabilities then sent to the executors; more cells raise an error, as
    such targets can't be met from the tokens of single documents."""
    spark = docs.sparkSession
    new = ("n_tokens", "topic", "weight", "probability", "sampled")
    keep = [c for c in docs.columns if c not in new]
    m, factor = fresh(docs, "m"), fresh(docs, "f")
    topic = F.col(f"`{m}`.topic") if topic_col is None else F.coalesce(F.col(f"`{topic_col}`").cast("string"), F.lit(""))
    marked = docs.withColumn(m, tokens_and_topic(F.col(text_col), topics))
    marked = marked.select(*(F.col(f"`{c}`") for c in keep), F.greatest(F.col(f"`{m}`.n"), F.lit(1)).cast("long").alias("n_tokens"), topic.alias("topic"))
    keys = [fresh(docs, d) for d in dims]
    named = [F.coalesce(F.col(d).cast("string"), F.lit("")).alias(k) for d, k in zip(dims, keys)]
    rows = marked.select(*named, "n_tokens").groupBy(*keys).agg(F.sum("n_tokens").alias("t")).orderBy(*keys).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells")
    cells, totals = [tuple(r)[:-1] for r in rows], np.array([float(r.t) for r in rows])
    goals = [(targets or {}).get(d) or tempered(cells, totals, k, powers.get(d, 1.0)) for k, d in enumerate(dims)]
    weights = rake(cells, totals, goals, rounds) if cells else totals
    probs = probabilities(totals, weights, fraction * totals.sum()) if cells else totals
    schema = ", ".join(f"`{k}` string" for k in keys) + f", `{factor}` double, probability double"
    found = spark.createDataFrame([(*c, float(w / t), float(p)) for c, w, t, p in zip(cells, weights, totals, probs)], schema)
    out = marked.select("*", *named).join(F.broadcast(found), keys)
    out = out.withColumn("weight", F.when(F.col("probability") > 0, F.col(factor) / F.col("probability")).otherwise(F.lit(0.0))).withColumn("sampled", unit(id_col, seed) < F.col("probability"))
    return out.select(*(F.col(f"`{c}`") for c in keep), *new)


def sample(docs: DataFrame, **kw) -> DataFrame:
    """The drawn rows, with the columns of ``docs`` and the new ones; see ``mix`` for nulls, empty
    texts, repeated rows, clashing names and empty tables."""
    return mix(docs, **kw).where("sampled")
