"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Bit *i* gets a non-zero vector phi(i) of r+1 bits, the 2^(r+1)-1
vectors being dealt out in turn; the mask of table v keeps the bits with <phi(i), v> odd. For any
set of at most r differing bits some v is orthogonal to all their vectors, so that none of them
is in its mask: every pair within the radius agrees in at least one table (Pagh, 2016). For
radius 4 there are 31 masks of 32 to 34 bits, so unrelated fingerprints hardly ever share a key.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewfold.llm.common import connected_components, discard, store, texts_of, with_row_key

SEED = 42
BLOCK = 1 << 16
#: Fingerprints of a bucket from which on it is covered anew.
SPLIT = 1024


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """One mask for each non-zero vector v of radius+1 bits, as unsigned integers."""
    n = (1 << (radius + 1)) - 1
    phi = [i % n + 1 for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (phi[i] & v).bit_count() & 1) for v in range(1, n + 1)]


def simhash(text: bytes | None, width: int = 4, seed: int = SEED) -> int:
    """Unsigned fingerprint of a UTF-8 text: A-Z lower-cased, words parted by ASCII white space,
    shingles of ``width`` words with repeats. No words, or null: zero."""
    words = (text or b"").lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = [*accumulate(len(w) + 1 for w in words)]
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s : e - 1], seed) for s, e in zip(starts, ends[width - 1 :])], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, fp)`` and the longs ``carry`` for each row, fp as a signed long with the
    fingerprint's bits."""

    def run(batches):
        for b in batches:
            fps = [simhash(r[1], width) for rows in texts_of(b) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.array(fps, dtype="<u8").view("<i8")), *b.columns[2:]], ["doc_id", "fp", *carry])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col), *carry).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carry)))


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def finer_masks(radius: int, bits: int = 64) -> list[list[int]]:
    """For each covering mask the covering masks of the bits outside it."""
    out = []
    for m in covering_masks(radius, bits):
        free = [i for i in range(bits) if not m >> i & 1]
        out.append([m | sum(1 << i for k, i in enumerate(free) if f >> k & 1) for f in covering_masks(radius, len(free))])
    return out


def near_links(classes: DataFrame, radius: int = 4, split: int = SPLIT) -> DataFrame:
    """Components of distinct fingerprints ``fp`` under links of at most ``radius`` bits:
    ``(fp, component)`` for those with a link, component being a fingerprint of the group.

    Pairs inside a bucket are never listed. First each member is held against the least and the
    greatest fingerprint of its bucket, which joins most of a large group in linear work. Then
    only buckets that still hold several components count: their members outside the bucket's
    commonest component are compared with its members of other components, exactly.

    A bucket of more than ``split`` fingerprints is covered anew: its pairs can only differ
    outside its mask, and masks over the bits there cover the radius again. For radius 4 no more
    than 17 bits are then free, which bounds a bucket whatever the number of documents."""
    masks = covering_masks(radius)
    keys = [F.struct(F.lit(k).alias("mask"), F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key")) for k, m in enumerate(masks)]
    buckets = classes.select("fp", F.inline(F.array(*keys)))
    ends = lambda df: df.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    # the planner takes exploded rows for no more than what they come from, and would send them to every executor
    made = [members := store(buckets.hint("merge").join(ends(buckets), "key"), "buckets")]
    if (members.agg(F.max("n")).first()[0] or 0) > split:
        finer = F.array(*(F.lit(_signed(m)) for ms in finer_masks(radius) for m in ms))
        n = len(masks)
        one = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.xxhash64(F.col("key"), k, F.col("fp").bitwiseAND(F.get(finer, F.col("mask") * n + k))))
        cut = members.where(F.col("n") > split).select("fp", F.explode(one).alias("key"))
        small = members.where(F.col("n") <= split).select("fp", "key", "lo", "hi")
        made.append(members := store(small.unionByName(cut.hint("merge").join(ends(cut).drop("n"), "key").select("fp", "key", "lo", "hi")), "buckets"))
    close = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= radius
    to_lo = members.where(close("fp", "lo")).select(F.col("fp").alias("a"), F.col("lo").alias("b"))
    to_hi = members.where(close("fp", "hi")).select(F.col("fp").alias("a"), F.col("hi").alias("b"))
    made.append(stars := connected_components(to_lo.unionByName(to_hi)))

    named = members.select("key", "fp").join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", F.coalesce("component", "fp").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    made.append(open_ := store(named.join(mixed, "key"), "open"))
    sizes = open_.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max("n").alias("n")).join(sizes, ["key", "n"]).groupBy("key").agg(F.min("c").alias("main"))
    rest = open_.join(main, "key").where("c <> main").select("key", F.col("fp").alias("fp1"), F.col("c").alias("a"))
    across = rest.join(open_.withColumnRenamed("c", "b"), "key").where((F.col("a") != F.col("b")) & close("fp1", "fp")).select("a", "b").distinct()
    made.append(merged := connected_components(across))

    grown = stars.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select(F.col("node").alias("fp"), F.coalesce("to", "component").alias("component"))
    alone = merged.join(stars, "node", "left_anti").select(F.col("node").alias("fp"), "component")
    out = store(grown.unionByName(alone), "components")
    for x in made:
        discard(x)
    return out


def _grouped(fps: DataFrame, radius: int, order: Sequence[str] = ()) -> DataFrame:
    """``(fp, best)`` for each fingerprint, stored: the first row of its component by doc_id, null
    ids last, then by ``order``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *order))
    classes = store(fps.groupBy("fp").agg(first.alias("best")), "classes")
    groups = near_links(classes.select("fp"), radius)
    linked = groups.join(classes, "fp")
    least = linked.groupBy("component").agg(F.min("best").alias("least"))
    named = linked.join(least, "component").select("fp", "least")
    out = store(classes.join(named, "fp", "left").select("fp", F.coalesce("least", "best").alias("best")), "ids")
    discard(classes)
    discard(groups)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``: documents link when their
    fingerprints differ in at most ``radius`` bits, component_id is the smallest id reachable.

    Equal fingerprints are one class, so copies are never paired. Null and empty texts have
    fingerprint zero and link like any other. Rows with a null id take part, but no component is
    named after them unless it has no other id (then component_id is null). Rows repeated under
    one id all come back. An empty table gives no rows; other columns are not looked at."""
    fps = store(fingerprints(docs, id_col, text_col, width), "fp")
    # stored, so that the join has exchanges of its own that can be split where copies abound
    return fps.join(_grouped(fps, radius), "fp").select("doc_id", "fp", F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last; of rows that
    share the id the first by place in the table. So rows repeated under one id and copies without
    an id also stay once, and different texts under one id stay each. Null and empty texts are
    copies of one another. All columns come back; an empty table gives no rows.

    What goes is stored as places of rows, a small table if few go, so that texts are only
    shuffled when it is too large to be sent."""
    keyed, key, stored = with_row_key(docs)
    fps = store(fingerprints(keyed, id_col, text_col, width, key), "fp")
    best = _grouped(fps, radius, key)
    same = [F.col(k) == F.col(f"best.{k}") for k in key]
    gone = store(fps.join(best, "fp").where(~(same[0] & same[1])).select(*key), "gone")
    for x in (fps, best):
        discard(x)
    return keyed.join(gone, key, "left_anti").drop(*key)
