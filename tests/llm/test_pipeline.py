"""run() against stages written plainly over the rows in memory."""

import random

import numpy as np

import corpus_pipeline
from viewfold.llm import mixing, quality
from tests.llm.test_pairs import groups, slow_simhash
from tests.llm.test_texts import slow_contamination

SF = "/root/testdata/sf0.001"


def slow_lines(rows):
    seen, out = set(), []
    for d in sorted(rows, key=lambda r: r["doc_id"]):
        lines = d["text"].split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        gone: set[int] = set()
        for k in range(len(at) - 2):
            w = tuple(lines[j].strip() for j in at[k : k + 3])
            if w in seen:
                gone.update(range(at[k], at[k + 2] + 1))
            seen.add(w)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or text.strip():
            out.append(d | ({"text": text, "n_chars": len(text)} if gone else {}))
    return out


def test_run_equals_plain_stages(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in df.collect()]
    model = quality.fit_quality(df)
    rows = [r for r in rows if model.score(r["text"].encode()) >= 0.5]
    rows = slow_lines(rows)
    fps = [slow_simhash(r["text"]) for r in rows]
    comp = groups(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    least: dict[int, int] = {}
    for k, c in enumerate(comp):
        least[c] = min(least.get(c, rows[k]["doc_id"]), rows[k]["doc_id"])
    rows = [r for r, c in zip(rows, comp) if r["doc_id"] == least[c]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = slow_contamination([(r["doc_id"], r["text"]) for r in rows], items)
    rows = [r for r in rows if not bad[r["doc_id"]][1]]
    want = {r["doc_id"]: r["text"] for r in rows}
    mixed = mixing.mix(spark.createDataFrame(rows, df.schema)).where("sampled").collect()
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in mixed)
    assert all(r.text == want[r.doc_id] for r in got)
    assert 0.3 * len(rows) < len(got) < 0.9 * len(rows)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_take_odd_rows(spark):
    rnd = random.Random(0)
    rows = [(k if rnd.random() < 0.9 else None, rnd.choice([None, "", "the cat of the house is on the mat, and it was good.", "x"]), rnd.choice([None, "en"]), rnd.choice([None, "s"]), None) for k in range(40)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, topic int")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).count()
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert np.isfinite(len(rows))
