"""Near-duplicate operators and line dedup against brute force, with edge cases."""

import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from viewfold.llm import linedup, simhash
from viewfold.llm.common import connected_components
from viewfold.llm.neardup_vectors import near_vectors

def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("local", [2_000_000, 3])
def test_components_of_random_graphs(spark, local):
    rnd = random.Random(4)
    for n, m in ((30, 20), (200, 190), (50, 0)):
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(n // 3)]
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), local=local).collect()}
        want = groups(n, links)
        assert all(got.get(k, k) == want[k] for k in range(n))


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31 and all(32 <= m.bit_count() <= 34 for m in masks)
    rnd = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
        assert any(m & diff == 0 for m in masks)


def test_finer_masks_cover_what_a_bucket_leaves_open():
    rnd = random.Random(2)
    for m, finer in zip(simhash.covering_masks(4), simhash.finer_masks(4)):
        free = [b for b in range(64) if not m >> b & 1]
        assert all(f & m == m and (64 - f.bit_count()) <= 17 for f in finer)
        for _ in range(100):
            diff = sum(1 << b for b in rnd.sample(free, rnd.randint(1, 4)))
            assert any(f & diff == 0 for f in finer)


def slow_simhash(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def near_rows():
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rnd.choice(words) for _ in range(150)]
        for _ in range(rnd.randint(1, 25)):
            t = list(base)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append(" ".join(t))
    rows += ["", None, "One", "one", "a b c", "É é\x1cx", "  ", rows[0], rows[0].upper()]
    return [(3 * k + 1, t) for k, t in enumerate(rows)]


def test_simhash_groups_equal_brute_force(spark):
    rows = near_rows()
    fps = [slow_simhash(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    want = groups(len(rows), links)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows).withColumn("fp", F.lit("x"))).collect()}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert got[i].fp & (2**64 - 1) == fps[k]
        assert got[i].component_id == rows[want[k]][0]


@pytest.mark.parametrize("split", [simhash.SPLIT, 3])
def test_near_links_on_spread_fingerprints(spark, split):
    """Chains and rings of fingerprints around a few centres, where stars alone do not join all."""
    rnd = random.Random(3)
    fps = set()
    for _ in range(6):
        x = rnd.getrandbits(64)
        for _ in range(120):
            fps.add(x)
            for b in rnd.sample(range(64), rnd.randint(1, 4)):
                x ^= 1 << b
    fps = sorted(f - 2**64 if f >> 63 else f for f in fps)
    links = [(a, b) for a in range(len(fps)) for b in range(a) if ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 4]
    want = groups(len(fps), links)
    got = {r.fp: r.component for r in simhash.near_links(docs(spark, [(f,) for f in fps], "fp long"), split=split).collect()}
    byc, byw = {}, {}
    for k, f in enumerate(fps):
        byc.setdefault(got.get(f, f), set()).add(f)
        byw.setdefault(want[k], set()).add(f)
    assert sorted(map(sorted, byc.values())) == sorted(map(sorted, byw.values()))


def test_simhash_keeps_one_and_handles_nulls_and_repeats(spark):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (9, "x y z"), (9, "x y z")]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, component_id string")
    assert sorted((r.doc_id or -1) for r in simhash.keep_one(df).collect()) == [2, 9]
    more = [*rows, (9, "quite another text"), (None, "m n o p"), (None, "M N O P"), (None, ""), (None, None)]
    got = simhash.keep_one(spark.createDataFrame(more, "doc_id long, text string"))
    assert sorted((r.doc_id or -1, (r.text or "").lower()) for r in got.collect()) == [(-1, ""), (-1, "m n o p"), (2, "a b c d e"), (9, "quite another text"), (9, "x y z")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.keep_one(df).columns == df.columns


def test_long_text(spark):
    t = " ".join(f"w{k % 977}" for k in range(200_000))
    assert simhash.simhash(t.encode()) == slow_simhash(t)


# vectors


def brute_vectors(rows, threshold=0.93):
    ok = []
    for _, v, lab in rows:
        good = lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=float) / np.linalg.norm(v) if good else None)
    links = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= threshold]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = groups(len(rows), links)
    least = {}
    for k, c in enumerate(comp):
        least[c] = min(least.get(c, rows[k][0]), rows[k][0])
    return {rows[k][0]: (n[k], least[comp[k]]) for k in range(len(rows))}


def vector_rows(n_groups=25, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n_groups):
        c = rng.normal(size=16)
        lab = int(rng.integers(0, 3))
        for _ in range(int(rng.integers(1, 30))):
            rows.append((c + rng.normal(size=16) * 0.15, lab))
    rows += [(rows[0][0], rows[0][1])] * 40
    order = rng.permutation(len(rows))
    return [(int(i), rows[k][0].tolist(), rows[k][1]) for i, k in enumerate(order)]


@pytest.mark.parametrize("settings", [{}, {"leaf_rows": 32, "fit_rows": 4000}, {"leaf_rows": 16, "fit_rows": 40, "split_rows": 40}])
def test_vectors_equal_brute_force(spark, settings):
    rows = vector_rows()
    rows += [(10_000, None, 1), (10_001, [0.0] * 16, 1), (10_002, [1.0, float("nan")] + [0.0] * 14, 1), (10_003, rows[0][1], None), (10_004, [1.0, None], 1), (10_005, [], 1), (10_006, [1.0, 0.0], 1), (10_007, [2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: r for r in near_vectors(df, **settings).collect()}
    want = brute_vectors(rows)
    assert len(got) == len(rows)
    total = sum(n for n, _ in want.values())
    assert sum(min(got[i].n_links, n) for i, (n, _) in want.items()) >= 0.99 * total
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    if not settings:
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_chunks_are_exact(spark, monkeypatch):
    import viewfold.llm.neardup_vectors as nv

    monkeypatch.setattr(nv, "CHUNK", 16)
    rows = vector_rows(8, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got == brute_vectors(rows)


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [1e300, 1.0], 1), (4, [1.0, 0.0], 1), (5, [-1.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_planted_pairs_of_a_large_table(spark):
    """50 000 vectors of four labels, 2 000 of them near another one; small fits, so that leaves are
    split in the executors."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(50_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k, c in zip(range(0, 4000, 2), rng.uniform(0.935, 0.99, 2000)):
        side = rng.normal(size=32)
        side -= side @ x[k] * x[k]
        x[k + 1] = c * x[k] + math.sqrt(1 - c * c) * side / np.linalg.norm(side)
    label = np.arange(50_000) // 2 % 4
    want = np.zeros(50_000, dtype=int)
    for lab in range(4):
        own = np.flatnonzero(label == lab)
        for at in range(0, len(own), 2000):
            want[own[at : at + 2000]] = (x[own[at : at + 2000]] @ x[own].T >= 0.93).sum(axis=1) - 1
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist(), "label": label}))
    got = near_vectors(df, fit_rows=1000, split_rows=2048).collect()
    found = np.zeros(50_000, dtype=int)
    for r in got:
        found[r.vec_id] = r.n_links
    assert len(got) == 50_000 and (found <= want).all() and want.sum() >= 4000
    assert found.sum() >= 0.95 * want.sum()


def test_vectors_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    near = df.unionByName(df.limit(200).select((F.col("vec_id") + 100_000).alias("vec_id"), F.transform("embedding", lambda x: x * 2).alias("embedding"), "label"))
    rows = [(r.vec_id, r.embedding, r.label) for r in near.collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(near).collect()} == brute_vectors(rows)
    assert near_vectors(df.limit(0)).count() == 0


# lines


def slow_lines(rows, width=3):
    """(id, text) in order of id: texts without later occurrences, and lines taken."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        body = [lines[k].strip(" \t\r\x0b\x0c") for k in at]
        gone = set()
        for k in range(len(at) - width + 1):
            w = tuple(body[k : k + width])
            if w in seen:
                gone.update(range(k, k + width))
            seen.add(w)
        drop = {at[k] for k in gone}
        out[i] = ([lines[k] for k in range(len(lines)) if k not in drop], len(gone))
    return out


def line_rows(seed=0):
    rnd = random.Random(seed)
    pool = [[f"line {g} {k}" for k in range(rnd.randint(3, 7))] for g in range(8)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            lines += rnd.choice(pool) if rnd.random() < 0.5 else [f"own {rnd.random()}"]
        rows.append((i * 2, "\n".join(lines)))
    return rows


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    want = slow_lines(rows)
    got = {r.doc_id: r for r in linedup.line_dedup(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, (lines, n) in want.items():
        assert got[i].n_removed == n
        assert [x for x in got[i].text.split("\n") if x] == [x for x in lines if x]


def test_lines_edge_cases(spark):
    p = "a\nb\nc"
    rows = [(1, p), (2, f"x\n{p}\ny"), (3, "a\nb"), (4, None), (5, ""), (None, p), (2, f"x\n{p}\ny"), (7, "q\n\n q \nq\nq"), (8, "  a \n\nb\nc\nz")]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_removed int")
    got = sorted(((r.doc_id if r.doc_id is not None else 99, r.text, r.n_removed) for r in linedup.line_dedup(df).collect()), key=str)
    want = [(1, p, 0), (2, "x\ny", 3), (2, "x\ny", 3), (3, "a\nb", 0), (4, None, 0), (5, "", 0), (99, "", 3), (7, "q\n", 3), (8, "z", 3)]
    assert got == sorted(want, key=str)
    assert linedup.line_dedup(df.limit(0)).count() == 0
