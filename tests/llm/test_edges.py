"""Very long texts and columns named like inner ones, for every operator over documents."""

import pytest
from pyspark.sql import functions as F

from viewfold.llm import chat, decontam, linedup, lmscore, mixing, pii, quality, simhash, toxicity
from viewfold.llm.common import scratch, shared_dir, store

LONG = " ".join(f"word{k % 5000}" for k in range(200_000))
LINES = "\n".join(f"line {k % 3000} of the text" for k in range(60_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, LINES), (3, "short text here"), (None, LONG[:1000]), (4, None), (4, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_long_texts_are_scored_whole(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in lmscore.score_documents(docs.where("doc_id <> 4"), labels).collect()}
    assert got[1].n_tokens == 200_000 and got[2].n_tokens == 300_000
    mixed = {r.doc_id: r.n_tokens for r in mixing.mix(docs.withColumns({"source": F.lit("s"), "lang": F.lit("en")}), fraction=1.0).collect()}
    assert mixed[1] == 200_000 and mixed[2] == 300_000 and mixed[4] == 1


def test_long_texts_lose_their_repeated_lines(docs):
    got = {r.doc_id: r for r in linedup.line_dedup(docs.where("doc_id <> 4")).collect()}
    assert got[2].n_removed == 57_000 and got[2].text == "\n".join(LINES.split("\n")[:3000])
    assert got[1].text == LONG and got[1].n_removed == 0


def test_long_texts_are_searched_to_their_end(spark, docs):
    items = [(7, " ".join(f"word{k}" for k in range(4990, 5000)) + " tail"), (8, "word4999 short text")]
    both = docs.withColumn("text", F.when(F.col("doc_id") == 1, F.concat("text", F.lit(" tail"))).otherwise(F.col("text")))
    got = [r for r in decontam.find_contamination(both, spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id == 1]
    assert [(r["items"], r.n_words, r.n_hit) for r in got] == [(["7"], 200_001, 40 * 10 + 1)]


def test_long_chats_come_back(spark):
    rows = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", LINES)], "conv_id long, turn int, role string, text string")
    back = chat.read_back(chat.format_chats(rows)).first()
    assert [t.text for t in back.turns] == [LONG, LINES] and back.loss_text == LINES


def test_columns_named_like_inner_ones_stay(spark):
    inner = ("__key", "__later", "__cut", "__file", "__row", "__m", "__f", "__source", "__lang", "__topic", "__id", "__y", "fp", "file", "row", "h0", "d")
    rows = [(k, f"the text of {k} is here and it is good for us\na\nb\nc {k}", "s", "en") for k in range(6)] + [(6, "the text of 5 is here and it is good for us\na\nb\nc 5", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    df = df.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in inner})
    b = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    for out, n in ((linedup.line_dedup(df), 7), (simhash.keep_one(df), 6), (decontam.drop_contaminated(df, b), 7), (mixing.mix(df), 7), (quality.keep_good(df), None)):
        got = out.collect()
        assert n is None or len(got) == n
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in inner)
    assert pii.find_pii(df).count() == quality.score_quality(df).count() == toxicity.score_toxicity(df, labels).count() == lmscore.score_documents(df, labels.withColumnRenamed("toxic", "quality")).count() == 7


def test_scratch_deletes_what_is_stored_inside(spark):
    with scratch() as made:
        kept, gone = store(spark.range(3)), store(spark.range(4))
        made.remove(kept)
    assert kept.count() == 3 and kept._stored_at.startswith(shared_dir(spark))
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        gone.collect()
