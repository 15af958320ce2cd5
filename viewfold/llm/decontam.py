"""Benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: each row is a shard of up to SHARD_WORDS words or SHARD_DOCS
documents with, per term, the sorted positions of that term in the shard. A gap follows each
document, so no phrase can cross from one to the next. Searching a shard intersects the
offset-adjusted lists of each window's terms, from the term that is rarest in the shard on, and
needs nothing from any other shard: no shuffle, and a passage that many documents share is spread
over their shards. All windows are intersected together, BLOCK candidates at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewfold.llm.common import discard, store, texts_of, with_row_key

#: Keeps 0-9, a-z and all bytes of characters beyond ASCII, lower-cases A-Z; the rest parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHARD_DOCS, SHARD_WORDS = 4096, 500_000
WINDOW, BLOCK = 10, 1 << 18
#: Characters of benchmark text whose windows are held at a time: each takes some 45 bytes a window.
SLICE_CHARS = 8_000_000
KEY = ("file", "row")
INDEX = "doc_ids array<long>, file array<long>, row array<long>, starts array<int>, n_words array<int>, terms array<string>, ends array<int>, positions binary"
MATCHES = "doc_id long, file long, row long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, near_items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary=None, key: list[str] | None = None) -> DataFrame:
    """One row per shard. ``vocabulary`` (a broadcast of {term: number}) leaves out the postings
    of terms that are not in it; None keeps all. Every document is in the shard's directory, null
    and empty texts with no words. A text is never cut, so a shard may exceed SHARD_WORDS by one
    document. ``key``: two columns of longs that are kept as ``file`` and ``row``."""

    def shard(rows, parts, terms):
        counts = np.array([n for *_, n in rows], dtype=np.int32)
        starts = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int32)
        at = np.concatenate([p + s for s, (p, _) in zip(starts, parts)])
        own = np.concatenate([q for _, q in parts])
        order = np.argsort(own.astype(np.uint16) if len(terms) < 65536 else own, kind="stable")
        used, n = np.unique(own, return_counts=True)
        longs = [pa.array([[r[k] for r in rows]], pa.list_(pa.int64())) for k in range(3)]
        return pa.RecordBatch.from_arrays(
            [
                *longs,
                pa.array([starts], pa.list_(pa.int32())),
                pa.array([counts], pa.list_(pa.int32())),
                pa.array([[terms[k].decode() for k in used]], pa.list_(pa.string())),
                pa.array([np.cumsum(n).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([at[order].astype("<i4").tobytes()], pa.binary()),
            ],
            ["doc_ids", *KEY, "starts", "n_words", "terms", "ends", "positions"],
        )

    def run(batches):
        known = vocabulary.value if vocabulary is not None else {}
        names = list(known)
        docs_, parts, size = [], [], 0
        for b in batches:
            for rows in texts_of(b):
                for i, t, f, r in rows:
                    w = words_of(t)
                    if vocabulary is None:
                        for x in w:
                            if x not in known:
                                known[x] = len(known)
                                names.append(x)
                    own = np.fromiter(map(known.get, w, repeat(-1)), np.int32, len(w))
                    at = np.flatnonzero(own >= 0).astype(np.int32)
                    docs_.append((i, f, r, len(w)))
                    parts.append((at, own[at]))
                    size += len(w)
                    if len(docs_) >= SHARD_DOCS or size >= SHARD_WORDS:
                        yield shard(docs_, parts, names)
                        docs_, parts, size = [], [], 0
                        if vocabulary is None:
                            known, names = {}, []
        if docs_:
            yield shard(docs_, parts, names)

    extra = [F.col(k) for k in key] if key else [F.lit(None).cast("long")] * 2
    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *(c.alias(k) for c, k in zip(extra, KEY))).mapInArrow(run, INDEX)


@dataclass
class Windows:
    """Distinct windows of some items. ``terms`` numbers their words; ``groups`` holds, for each
    length, the windows as rows of numbers, and the items of each as ``ends`` in ``owners``."""

    names: list[str]
    terms: dict[bytes, int]
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def windows_of(items: list[tuple[str, bytes]], width: int = WINDOW) -> Windows:
    """An item of fewer words than ``width``, but not none, is one window."""
    terms: dict[bytes, int] = {}
    names = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(names)}
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, text in items:
        w = [terms.setdefault(x, len(terms)) for x in words_of(text)]
        n = min(width, len(w))
        if n:
            found.setdefault(n, []).append((number[item], np.lib.stride_tricks.sliding_window_view(np.array(w, dtype=np.int32), n)))
    groups = []
    for n, parts in sorted(found.items()):
        owner = np.repeat(np.array([k for k, _ in parts], dtype=np.int32), [len(x) for _, x in parts])
        rows, which = np.unique(np.concatenate([x for _, x in parts]), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), owner], axis=1), axis=0)
        groups.append((rows.astype(np.int32), np.cumsum(np.bincount(pairs[:, 0], minlength=len(rows))), pairs[:, 1].astype(np.int32)))
    return Windows(names, terms, groups)


def rarest(windows: Windows, n: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``n`` terms of each window of which there are fewest by ``seen`` (ties by the term), as
    distinct rows, filled up with -1, and the items of each row as ends and owners."""
    order = np.empty(len(windows.terms), dtype=np.int64)
    order[[windows.terms[t] for t in sorted(windows.terms, key=lambda t: (seen[windows.terms[t]], t))]] = np.arange(len(windows.terms))
    rows, pairs = [], []
    for mat, ends, owners in windows.groups:
        for k, w in enumerate(mat):
            own = sorted({*w.tolist()}, key=order.__getitem__)[:n]
            rows.append(own + [-1] * (n - len(own)))
            pairs += [(len(rows) - 1, o) for o in owners[ends[k - 1] if k else 0 : ends[k]].tolist()]
    if not rows:
        return np.zeros((0, n), dtype=np.int32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
    made, which = np.unique(np.array(rows, dtype=np.int32), axis=0, return_inverse=True)
    both = np.unique([(which.ravel()[r], o) for r, o in pairs], axis=0)
    # np.unique orders rows, not the terms in them
    return made, np.cumsum(np.bincount(both[:, 0], minlength=len(made))), both[:, 1].astype(np.int32)


class Postings:
    """A shard's lists, all in one sorted array of term * size + position."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray, starts: np.ndarray, n_terms: int):
        n = np.diff(ends, prepend=0)
        self.size, self.starts = int(starts[-1]) + 1, starts
        self.df, self.begin = np.zeros(n_terms, dtype=np.int64), np.zeros(n_terms, dtype=np.int64)
        keep = terms >= 0
        order = np.argsort(terms[keep], kind="stable")
        own, lens = terms[keep][order], n[keep][order]
        self.df[own] = lens
        self.begin[own] = np.cumsum(lens) - lens
        first = (ends - n)[keep][order]
        at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(first, lens)
        self.keys = np.repeat(own, lens).astype(np.int64) * self.size + positions[at]

    def candidates(self, rows: np.ndarray, terms: np.ndarray):
        """(row, position) of every position of each row's term, in blocks of BLOCK or one row."""
        many = np.cumsum(self.df[terms])
        at = 0
        while at < len(rows):
            upto = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + BLOCK, "right")))
            n = self.df[terms[at:upto]]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[terms[at:upto]], n)
            yield np.repeat(rows[at:upto], n), self.keys[k] % self.size
            at = upto

    def phrases(self, mat: np.ndarray):
        """(row, position of its first term) wherever a row's terms stand one after another."""
        some = np.flatnonzero(self.df[mat].min(axis=1) > 0) if len(mat) else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.df[mat[some]], axis=1, kind="stable")
        place = np.zeros(len(mat), dtype=np.int64)
        place[some] = np.arange(len(some))
        for w, p in self.candidates(some, mat[some, order[:, 0]] if len(some) else some):
            o = order[place[w]]
            p = p - o[:, 0]
            for k in range(1, mat.shape[1]):
                ok = p >= 0
                w, p, o = w[ok], p[ok], o[ok]
                want = mat[w, o[:, k]].astype(np.int64) * self.size + p + o[:, k]
                at = np.searchsorted(self.keys, want)
                at[at == len(self.keys)] = 0
                ok = self.keys[at] == want if len(self.keys) else np.zeros(len(want), dtype=bool)
                w, p, o = w[ok], p[ok], o[ok]
            ok = p >= 0
            yield w[ok], p[ok]

    def near(self, rare: np.ndarray, span: int, first: np.ndarray):
        """(row, position of its ``first`` term) wherever each of its other terms is within ``span``
        words in the same document."""
        some = np.flatnonzero(np.where(rare >= 0, self.df[rare], 1).min(axis=1) > 0) if len(rare) else np.zeros(0, dtype=np.int64)
        for w, p in self.candidates(some, first[some]):
            for k in range(rare.shape[1]):
                d = np.searchsorted(self.starts, p, "right")
                lo, hi = np.maximum(p - span, self.starts[d - 1]), np.minimum(p + span, self.starts[d] - 1)
                base = rare[w, k].astype(np.int64) * self.size
                ok = (rare[w, k] < 0) | (np.searchsorted(self.keys, base + hi, "right") > np.searchsorted(self.keys, base + lo))
                w, p = w[ok], p[ok]
            yield w, p


def term_counts(items: DataFrame, vocabulary) -> dict[bytes, int]:
    """How often each term of the broadcast ``vocabulary`` occurs in the texts ``t``."""

    def run(batches):
        known = vocabulary.value
        n = np.zeros(len(known), dtype=np.int64)
        for b in batches:
            for rows in texts_of(b, 0):
                for (t,) in rows:
                    for w in words_of(t):
                        if (k := known.get(w)) is not None:
                            n[k] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at])], ["k", "n"])

    got = {r.k: r.n for r in items.select("t").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}
    return {t: got.get(k, 0) for t, k in vocabulary.value.items()}


def search(index: DataFrame, windows, near_span: int | None = None, near_terms: int = 4, frequency=None) -> DataFrame:
    """One row per document of the index. ``windows``: a broadcast of what ``windows_of`` gives.

    Exact matches give ``items``, the merged covered word ranges ``spans`` (end exclusive) and
    ``n_hit``, the words in them. With ``near_span``, ``near_items`` are items of which some
    window's ``near_terms`` rarest terms all stand within that many words of the rarest, in any
    order. Which are rarest is told by ``frequency`` (a broadcast of {term: number}), or else by the
    windows, and so is the same in every shard."""

    def owned(docs, rows, ends, owners):
        """Distinct (document, item) of matches (document, window)."""
        docs, rows = np.unique(np.stack([docs, rows], axis=1), axis=0).T if len(docs) else (docs, rows)
        first = np.where(rows > 0, ends[rows - 1], 0)
        n = ends[rows] - first
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.stack([np.repeat(docs, n), owners[at]], axis=1)

    def listed(pairs, names, n):
        """Each document's sorted item names."""
        out: list[list[str]] = [[] for _ in range(n)]
        for d, k in np.unique(np.concatenate([np.zeros((0, 2), dtype=np.int64), *pairs]), axis=0).astype(np.int64).tolist():
            out[d].append(names[k])
        return out

    def run(batches):
        wins = windows.value
        number = wins.terms
        if near_span is not None:
            seen = frequency.value if frequency is not None else Counter(t for mat, *_ in wins.groups for t in mat.ravel().tolist())
            seen = np.array([seen.get(t if frequency is not None else k, 0) for t, k in number.items()], dtype=np.int64)
            rare, rare_ends, rare_owners = rarest(wins, near_terms, seen)
        for b in batches:
            for at in range(b.num_rows):
                ids, file, row, starts, n_words, terms, ends, positions = (c[at] for c in b.columns)
                counts, starts = np.array(n_words.values, dtype=np.int64), np.array(starts.values, dtype=np.int64)
                own = np.array([number.get(t.encode(), -1) for t in terms.as_py()], dtype=np.int64)
                lists = Postings(own, np.array(ends.values, dtype=np.int64), np.frombuffer(positions.as_buffer(), dtype="<i4"), starts, len(number))
                doc_of = lambda p: np.searchsorted(starts, p, "right") - 1  # noqa: B023, E731
                mark = np.zeros(int(starts[-1]) + 1, dtype=bool)
                found, near = [], []
                for mat, w_ends, owners in wins.groups:
                    for w, p in lists.phrases(mat):
                        mark[(p[:, None] + np.arange(mat.shape[1])).ravel()] = True
                        found.append(owned(doc_of(p), w, w_ends, owners))
                if near_span is not None:
                    for w, p in lists.near(rare, near_span, rare[:, 0]):
                        near.append(owned(doc_of(p), w, rare_ends, rare_owners))
                n = len(counts)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
                spans: list[list[dict]] = [[] for _ in range(n)]
                hit = np.zeros(n, dtype=np.int64)
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    d = int(doc_of(s))
                    spans[d].append({"start": s - int(starts[d]), "end": e - int(starts[d])})
                    hit[d] += e - s
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values,
                        file.values,
                        row.values,
                        pa.array(counts),
                        pa.array(hit),
                        pa.array(listed(found, wins.names, n), pa.list_(pa.string())),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(listed(near, wins.names, n), pa.list_(pa.string())),
                    ],
                    ["doc_id", *KEY, "n_words", "n_hit", "items", "spans", "near_items"],
                )

    return index.mapInArrow(run, MATCHES)


def _found(docs: DataFrame, key: list[str], benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int, near_span: int | None, slice_chars: int) -> tuple[DataFrame, DataFrame]:
    """(matches of each row with its key, the stored index)."""
    spark = docs.sparkSession
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t"))
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = chars // slice_chars + 1
    index, found = None, []
    for k in range(slices):
        part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(slices)) == k)
        wins = windows_of([(r.i, (r.t or "").encode()) for r in part.toLocalIterator()], width)
        known = spark.sparkContext.broadcast(wins.terms)
        if index is None:
            index = store(build_index(docs, id_col, text_col, known if slices == 1 else None, key), "postings")
        frequency = None if near_span is None else spark.sparkContext.broadcast(term_counts(rows.distinct(), known))
        found.append(search(index, spark.sparkContext.broadcast(wins), near_span, frequency=frequency))
        known.unpersist()
    if slices == 1:
        return found[0], index
    merged = found[0]
    for x in found[1:]:
        merged = merged.unionByName(x)

    def union(k, pdf):
        import pandas as pd

        spans: list[list[int]] = []
        for s, e in sorted((x["start"], x["end"]) for row in pdf["spans"] for x in row):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        join = lambda c: sorted({x for row in pdf[c] for x in row})
        return pd.DataFrame([[pdf["doc_id"].iloc[0], *k, pdf["n_words"].iloc[0], sum(e - s for s, e in spans), join("items"), [{"start": s, "end": e} for s, e in spans], join("near_items")]], columns=["doc_id", *KEY, "n_words", "n_hit", "items", "spans", "near_items"])

    # pandas has no whole numbers beside nulls, so ids go as text
    whole = merged.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy(*KEY).applyInPandas(union, MATCHES.replace("doc_id long", "doc_id string"))
    return whole.withColumn("doc_id", F.col("doc_id").cast("long")), index


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, near_span: int | None = None, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items, spans, near_items``.

    The index holds the postings of the benchmark's terms only; nothing else is ever looked up.
    The benchmark goes to the executors only up to ``slice_chars`` characters at a time, which
    is measured first. For a larger one the index holds all terms and is searched once for each
    slice of whole items; the slices' matches are merged by row of ``docs``.

    Null texts have no words; rows that share an id, or have none, each have their own matches;
    items without an id or without words are ignored; repeated items count once; an empty table of
    either kind gives no rows or no hits. Other columns are not looked at."""
    keyed, key, _ = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return _found(keyed, key, benchmark, "doc_id", "text", item_col, item_text_col, width, near_span, slice_chars)[0].drop(*KEY)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Rows of ``docs``, with all columns, without those that hold any benchmark window. Each row is
    judged by its own text: ids may be null or repeated. Null and empty texts stay; so does
    everything where the benchmark has no words.

    What goes is stored as places of rows, a small table if few go, so that texts are only
    shuffled when it is too large to be sent."""
    keyed, key, stored = with_row_key(docs)
    found, index = _found(keyed, key, benchmark, id_col, text_col, item_col, item_text_col, width, None, slice_chars)
    gone = store(found.where("n_hit > 0").select(*(F.col(k).alias(n) for k, n in zip(KEY, key))), "gone")
    discard(index)
    return keyed.join(gone, key, "left_anti").drop(*key)
