"""Line dedup over overlapping windows of consecutive lines.

A text's content lines are its lines that are not blank, stripped of outer ASCII white space. Each
run of three consecutive content lines is a window, known by a 128-bit hash. A window's first
occurrence, in order of (doc_id, position), stays; the content lines under any later occurrence
are covered, overlapping windows merge, and covered lines go. Blank lines are left as they are,
except that a blank line inside a covered run goes with it.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewfold.llm.common import fresh, store, texts_of

WIDTH = 3


def _windows(text: bytes | None, width: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """Lines, the index of each content line, and the window digest at each content line."""
    lines = (text or b"").split(b"\n")
    at = [i for i, x in enumerate(lines) if x.strip()]
    h = xxhash.xxh3_128_digest
    each = [h(lines[i].strip()) for i in at]
    return lines, at, [h(b"".join(each[k : k + width])) for k in range(len(each) - width + 1)]


def _strip(text: bytes | None, later: frozenset, width: int) -> tuple[bytes | None, int]:
    """The text without covered lines, and how many content lines went."""
    lines, at, wins = _windows(text, width)
    seen: set[bytes] = set()
    gone, upto = set(), 0
    n = 0
    for k, w in enumerate(wins):
        if w in later or w in seen:
            first = max(k, upto)
            for j in range(first, k + width):
                gone.update(range(at[j - 1] + 1 if j > k else at[j], at[j] + 1))
            n += k + width - first
            upto = k + width
        seen.add(w)
    if not gone:
        return text, 0
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), n


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, count_col: str | None = "n_removed") -> DataFrame:
    """``docs`` with the lines under later occurrences of repeated windows taken out of the text,
    and ``count_col``, the number of content lines removed (left out if None).

    All rows and columns come back. A text with fewer than ``width`` content lines has no window
    and stays as it is, null and empty ones too. Rows with a null id come last, in an
    order by hash of the text. Rows
    repeated under one id are one document: each keeps what that id has first. A window that
    recurs within a document is a later occurrence there as well.

    A document sends each distinct window once; minimum and count combine on the map side, and
    the join back is by window, which adaptive execution can split, so a window that many
    documents share stays cheap. The text is moved once, to meet its document's list."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1) - F.pmod(F.xxhash64(text_col), F.lit(1 << 47)))

    def emit(batches):
        for b in batches:
            ids, hs = [], []
            for rows in texts_of(b):
                for i, t in rows:
                    own = set(_windows(t, width)[2])
                    hs += own
                    ids += [i] * len(own)
            two = np.frombuffer(b"".join(hs), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), pa.array(ids, pa.int64())], ["h0", "h1", "d"])

    wins = docs.select(key.alias("d"), F.col(text_col)).mapInArrow(emit, "h0 long, h1 long, d long")
    wins = store(wins, "windows")
    repeated = wins.groupBy("h0", "h1").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("h0", "h1", "first")
    own, list_, made = (fresh(docs, c) for c in ("key", "later", "cut"))
    later = wins.join(repeated, ["h0", "h1"]).where("d > first").groupBy(F.col("d").alias(own)).agg(F.collect_list(F.struct("h0", "h1")).alias(list_))

    names = [c for c in docs.columns if c != count_col]
    joined = docs.withColumn(own, key).join(later, own, "left")

    @F.arrow_udf("struct<text:string,n:long>")
    def cut(text: pa.Array, later: pa.Array) -> pa.Array:
        out: list[bytes | None] = []
        ns: list[int] = []
        for rows in texts_of(pa.record_batch([text, later], ["text", "later"]), 0):
            for t, x in rows:
                kept, n = _strip(t, frozenset(struct.pack("<qq", y["h0"], y["h1"]) for y in x or ()), width)
                out.append(kept)
                ns.append(n)
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["text", "n"])

    done = joined.withColumn(made, cut(F.col(text_col), F.col(list_)))
    cols = [F.col(f"`{made}`.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return done.select(*cols, *([F.col(f"`{made}`.n").alias(count_col)] if count_col else []))
