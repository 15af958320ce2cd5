"""Near-duplicate vectors by a random-projection tree forest.

Each tree splits the vectors again and again by a random direction at the median. Vectors within
MARGIN of the split go to both sides (spill), so close pairs are seldom parted; several trees
make a miss in all of them very unlikely. Vectors that share a leaf are compared exactly.

The first levels are fitted on a bounded sample, on the driver. A leaf that still holds too many
vectors of a label is split again in the executors by a subtree fitted on a sample of its own, and
so on, so that leaves don't grow with the table. What can't be split, as all its vectors are close
to one another, is compared in blocks.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewfold.llm.common import connected_components, discard, store

TREES, LEAF_ROWS, MARGIN, FIT_ROWS, CHUNK = 6, 1024, 0.03, 32768, 2048
#: Vectors of a label in a leaf from which on it is split again; rows of a leaf that fit its subtree; rows routed at a time.
SPLIT_ROWS, SUB_ROWS, SLICE_ROWS = 8192, 4096, 16384


def grow_tree(sample: np.ndarray, depth: int, seed: int, margin: float = MARGIN) -> list[tuple]:
    """Nodes in heap-free order: (direction, threshold, left, right), or None for a leaf. A node
    stays a leaf when its spill would leave a child with nearly all of its rows."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple | None] = []

    def build(x: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(None)
        if level == 0 or len(x) < 8:
            return at
        for _ in range(4):
            v = rng.standard_normal(x.shape[1])
            v /= np.linalg.norm(v)
            p = x @ v
            t = float(np.median(p))
            left, right = p <= t + margin, p >= t - margin
            if max(left.sum(), right.sum()) <= 0.85 * len(x):
                nodes[at] = (v, t, build(x[left], level - 1), build(x[right], level - 1))
                break
        return at

    build(sample, depth)
    return nodes


def route(nodes: list[tuple], x: np.ndarray, margin: float = MARGIN) -> list[tuple[int, np.ndarray]]:
    """(leaf, row numbers) for each leaf that rows of ``x`` reach."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if not len(rows):
            continue
        if nodes[k] is None:
            out.append((k, rows))
            continue
        v, t, left, right = nodes[k]
        p = x[rows] @ v
        todo += [(left, rows[p <= t + margin]), (right, rows[p >= t - margin])]
    return out


def _unit(blobs, dim: int) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype="<f8").reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)  # else squares of very large or small components are lost
    return x / np.linalg.norm(x, axis=1, keepdims=True)


ROUTED = "leaf long, label string, cls long, w long, v binary, own array<long>, done boolean"


def _descend(leaf: int, sub: int) -> int:
    """A number for a leaf of a leaf's subtree."""
    return (leaf * 0x5851F42D4C957F2D + sub + 1) % (1 << 63)


def _split_leaves(routed: DataFrame, leaf_rows: int, split_rows: int, margin: float, longest: int) -> DataFrame:
    """Stored ``routed`` rows with leaves of more than ``split_rows`` rows of a label split, round by
    round. A leaf's rows are dealt into slices, each of which gets the leaf's subtree."""
    key = ["leaf", "label"]
    for level in range(48):
        sizes = routed.where(~F.col("done") & (F.length("v") == 8 * longest)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_rows)
        sizes = store(sizes, "sizes")
        if not sizes.limit(1).count():
            discard(sizes)
            break
        big = routed.join(sizes, key)
        share = F.pmod(F.xxhash64("cls", F.lit(level)), F.lit(1 << 30)) < (F.lit(SUB_ROWS) / F.col("n") * (1 << 30)).cast("long")

        def grow(k, pdf):
            import pandas as pd

            x = _unit(pdf["v"], longest)
            n = int(pdf["n"].iloc[0])
            depth = max(1, min(math.ceil(math.log2(n / leaf_rows)), int(math.log2(max(len(x), 1) / 64)) if len(x) >= 128 else 1))
            nodes = grow_tree(x[np.argsort(pdf["cls"].to_numpy(), kind="stable")], depth, (k[0] + 104729 * level) % (1 << 31), margin)  # noqa: B023
            return pd.DataFrame({"leaf": [k[0]], "label": [k[1]], "n": [n], "tree": [pickle.dumps(nodes)]})

        trees = big.where(share).select(*key, "cls", "v", "n").groupBy(*key).applyInPandas(grow, "leaf long, label string, n long, tree binary")
        slices = F.explode(F.sequence(F.lit(0), (F.col("n") / SLICE_ROWS).cast("int")))
        own_slice = F.pmod(F.xxhash64("cls"), (F.col("n") / SLICE_ROWS).cast("int") + 1).cast("int")

        def send(rows, tree):
            nodes = pickle.loads(tree.column("tree")[0].as_py()) if tree.num_rows else [None]
            if not rows.num_rows:
                return rows.select(["leaf", "label", "cls", "w", "v", "own", "done"])
            leaf, found = rows.column("leaf")[0].as_py(), []
            for sub, at in route(nodes, _unit(rows.column("v").to_pylist(), longest), margin):
                part = rows.take(pa.array(at)).select(["leaf", "label", "cls", "w", "v", "own", "done"])
                found.append(part.set_column(0, "leaf", pa.array([_descend(leaf, sub)] * len(at), pa.int64())).set_column(6, "done", pa.array([len(nodes) == 1] * len(at))))
            return pa.concat_tables(found)

        dealt = big.withColumn("slice", own_slice).groupBy(*key, "slice")
        sent = dealt.cogroup(trees.withColumn("slice", slices).groupBy(*key, "slice")).applyInArrow(send, ROUTED)
        new = store(routed.join(sizes, key, "left_anti").select("leaf", "label", "cls", "w", "v", "own", "done").unionByName(sent), "leaves")
        for x in (routed, sizes):
            discard(x)
        routed = new
    if level:
        own = routed.groupBy("cls").agg(F.array_sort(F.collect_set("leaf")).alias("own"))
        new = store(routed.drop("own").join(own, "cls").select("leaf", "label", "cls", "w", "v", "own", "done"), "leaves")
        discard(routed)
        routed = new
    return routed


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", threshold: float = 0.93, trees: int = TREES, leaf_rows: int = LEAF_ROWS, margin: float = MARGIN, fit_rows: int = FIT_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``.

    Two vectors link when their labels are equal and not null and their cosine, in double
    precision, is at least ``threshold``. n_links counts the other rows a row links with
    directly; component_id is the smallest id reachable, the row's own included; kept says
    whether it is its own. A row whose vector is null, empty, all zero or holds a null or
    non-finite component, or whose label is null (unless ``label_col`` is None), links with
    nothing and is kept. Rows with a null id count as links but name no component. Rows
    that share an id are separate rows of one component name. Vectors of different lengths never
    link. Other columns are not looked at; an empty table gives no rows.

    Equal vectors of a label are one class with a weight, so copies are never paired. The trees'
    first splits are fitted on about ``fit_rows`` classes, the first by hash, and leaves of more than
    ``split_rows`` classes of a label are split further; every class is routed through every
    tree. Leaves that stay larger than CHUNK classes are compared in pairs of chunks, each a
    group of its own, which is exact: N classes that are all close to one another cost their N^2
    comparisons and N^2 / CHUNK rows. A pair that meets in several leaves counts in the first
    only, which both rows' lists of leaves tell, so links are counted where they are found and
    never listed: a leaf gives each row's count and one link to its local component."""
    spark = vectors.sparkSession
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    vec = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == F.lit(math.inf)), F.lit(True))) & F.exists("v", lambda v: v != 0)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), vec.alias("v"))
    base = base.withColumn("v", F.when(fit & F.col("label").isNotNull(), F.transform("v", lambda v: v + F.lit(0.0))))
    base = store(base.withColumn("cls", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v", F.size("v")))).select("vec_id", "label", "cls", "v"), "vectors")
    classes = store(base.where("cls is not null").groupBy("cls", "label", "v").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least")), "classes")

    n = classes.count()
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    longest = classes.agg(F.max(F.size("v"))).first()[0] or 1
    upto = min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 9 * fit_rows // (10 * max(n, 1)))  # hashes are spread evenly
    sample = sorted(classes.select("cls", "v").where(F.col("cls") <= upto).collect()) if n else []
    rows = [np.array(r.v) for r in sample if len(r.v) == longest]
    x = _unit([r.astype("<f8").tobytes() for r in rows], longest) if rows else np.zeros((0, longest))
    # only vectors of a label are compared
    depth = min(max(0, math.ceil(math.log2(max(most, 1) / leaf_rows))), max(0, int(math.log2(max(len(x), 1) / 16))))
    forest = spark.sparkContext.broadcast([grow_tree(x, depth, 7919 * k + 1, margin) for k in range(trees)])

    def leaves(batches):
        for b in batches:
            ids = np.array(b.column("cls").to_pylist(), dtype=np.int64)
            labels, ws, vs = b.column("label").to_pylist(), b.column("w").to_pylist(), b.column("v").to_pylist()
            blobs = [np.array(v, dtype="<f8").tobytes() for v in vs]
            own: list[list[int]] = [[] for _ in vs]
            dims = np.array([len(v) for v in vs])
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                u = _unit([blobs[i] for i in at], dim)
                for t, nodes in enumerate(forest.value):
                    for leaf, rows in route(nodes, u, margin) if dim == longest else [(0, np.arange(len(at)))]:
                        for i in at[rows].tolist():
                            own[i].append((t << 32) | leaf)
            for o in own:
                o.sort()
            flat = [(i, leaf) for i, o in enumerate(own) for leaf in o]
            if flat:
                i = [a for a, _ in flat]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f for _, f in flat], pa.int64()), pa.array([labels[k] for k in i], pa.string()), pa.array(ids[i]), pa.array([ws[k] for k in i], pa.int64()), pa.array([blobs[k] for k in i], pa.binary()), pa.array([own[k] for k in i], pa.list_(pa.int64())), pa.array([False] * len(i))],
                    ["leaf", "label", "cls", "w", "v", "own", "done"],
                )

    routed = store(classes.select("cls", "label", "w", "v").mapInArrow(leaves, ROUTED), "leaves")
    routed = _split_leaves(routed, leaf_rows, split_rows, margin, longest)
    sizes = routed.groupBy("leaf", "label", F.length("v").alias("size")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    cut = routed.withColumn("size", F.length("v")).join(sizes, ["leaf", "label", "size"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("mine", F.pmod(F.col("cls"), F.col("chunks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cut = cut.select("leaf", "label", "size", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "cls", "w", "v", "own")

    def compare(key, pdf):
        import pandas as pd

        leaf, lo, hi = key[0], key[3], key[4]
        u = _unit(pdf["v"], key[2] // 8)
        mine, w = pdf["mine"].to_numpy(), pdf["w"].to_numpy()
        a, b = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        linked = np.empty((len(a), len(b)), dtype=bool)
        for k in range(0, len(a), 256):
            linked[k : k + 256] = u[a[k : k + 256]] @ u[b].T >= threshold
        if lo == hi:
            np.fill_diagonal(linked, False)
        ra, rb = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(ra):
            return pd.DataFrame({"cls": [], "n": [], "to": []}).astype("int64")
        linked = linked[np.ix_(ra, rb)]
        a, b = a[ra], b[rb]
        earlier = [[x for x in o if x < leaf] for o in pdf["own"]]
        number = {x: k for k, x in enumerate({x for i in [*a, *b] for x in earlier[i]})}
        if number:
            sets = np.zeros((len(pdf), len(number)), dtype=np.float32)
            for i in {*a.tolist(), *b.tolist()}:
                sets[i, [number[x] for x in earlier[i]]] = 1
            linked &= sets[a] @ sets[b].T == 0
        cls = pdf["cls"].to_numpy()
        count = np.zeros(len(pdf), dtype=np.int64)
        np.add.at(count, a, linked @ w[b])
        if lo != hi:
            np.add.at(count, b, linked.T @ w[a])
        # the least class of each row's local component: labels spread along the links until none changes
        to, far = cls.copy(), np.iinfo(np.int64).max
        while True:
            before = to.copy()
            np.minimum.at(to, a, np.where(linked, to[b][None, :], far).min(axis=1))
            np.minimum.at(to, b, np.where(linked, to[a][:, None], far).min(axis=0))
            if (to == before).all():
                break
        return pd.DataFrame({"cls": cls, "n": count, "to": to})[count > 0]

    found = store(cut.groupBy("leaf", "label", "size", "lo", "hi").applyInPandas(compare, "cls long, n long, to long"), "links")
    comps = connected_components(found.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    known = store(classes.select("cls", "w", "least").join(counts, "cls", "left").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    # stored, so that the join has exchanges of its own that can be split where copies abound
    by_class = store(known.join(least, "component").select("cls", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id"), "by_class")
    linked = base.where("cls is not null").select("vec_id", "cls").join(by_class, "cls").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    alone = base.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for x in (routed, classes, found, comps, known):
        discard(x)
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
