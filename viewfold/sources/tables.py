"""Readers: detection tables, derived fixtures, images, audio, ground truth and frame thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FRAME_WIDTH, FRAME_HEIGHT = 640, 480
#: Cameras among which the tracks of the fixture are dealt.
STREAMS = 8
ZONES = {"dock": [(100, 100), (400, 100), (400, 400), (100, 400)], "gate": [(300, 200), (500, 200), (500, 450), (300, 450)], "diamond": [(320, 60), (560, 240), (320, 420), (80, 240)]}
LINES = [(300, 0, 300, 480), (0, 240, 640, 240), (40, 50, 600, 440)]


def read_frames(spark: SparkSession, path: str, fps: float | None = None, width: int | None = None, height: int | None = None) -> DataFrame:
    """A table of frames or detections, with the source's properties overridden where given."""
    df = spark.read.parquet(path)
    for name, value in (("fps", fps), ("frame_width", width), ("frame_height", height)):
        if value is not None:
            df = df.withColumn(name, F.lit(value))
    return df


def stream_frames(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream of files; ``files_per_trigger`` is the bound on what waits."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def frames_from(spark: SparkSession, items, schema: str) -> DataFrame:
    """Frames from any iterable of rows, numbered in its order; the frame count is unknown (-1)."""
    df = spark.createDataFrame([(k, *(x if isinstance(x, tuple) else (x,))) for k, x in enumerate(items)], "frame_id long, " + schema)
    return df.withColumn("frame_count", F.lit(-1).cast("long"))


def read_images(spark: SparkSession, path: str, glob: str = "*", content: bool = False) -> DataFrame:
    """Image files as rows; bytes are read only where ``content`` is asked for. The folder's name
    is the class, as in folder-per-class ground truth."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    cols = ["path", "length", "modificationTime", F.element_at(F.split("path", "/"), -2).alias("class_name")]
    return df.select(*cols, *(["content"] if content else []))


_COCO = "images array<struct<id:long,file_name:string,width:int,height:int>>, annotations array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:long,name:string>>"


def parse_coco(docs: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """images, annotations and categories of COCO documents, one a row, boxes as corners."""
    doc = docs.select(F.from_json(text, _COCO).alias("d")).select("d.*")
    a = doc.select(F.inline("annotations"))
    box = [F.col("bbox")[k] for k in range(4)]
    annotations = a.select("*", box[0].alias("x1"), box[1].alias("y1"), (box[0] + box[2]).alias("x2"), (box[1] + box[3]).alias("y2"))
    return {"images": doc.select(F.inline("images")), "annotations": annotations, "categories": doc.select(F.inline("categories")).distinct()}


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same from files, each of which is one document."""
    return parse_coco(spark.read.text(path, wholetext=True))


def parse_regression_truth(docs: DataFrame, text: str = "value") -> DataFrame:
    """(file_name, value) of documents {"images": [{"file_name": …, "value": …}]}."""
    return docs.select(F.inline(F.from_json(text, "images array<struct<file_name:string,value:double>>")["images"]))


def read_regression_truth(spark: SparkSession, path: str) -> DataFrame:
    return parse_regression_truth(spark.read.text(path, wholetext=True))


def _samples_at(x: memoryview) -> tuple[int, int]:
    """Start and end of a WAV file's samples: of its data chunk, which other chunks may precede. What
    is no such file is samples from its first byte."""
    if len(x) < 12 or x[:4] != b"RIFF" or x[8:12] != b"WAVE":
        return 0, len(x)
    at = 12
    while at + 8 <= len(x):
        n = int.from_bytes(x[at + 4 : at + 8], "little")
        if x[at : at + 4] == b"data":
            return at + 8, min(len(x), at + 8 + n)
        at += 8 + n + n % 2
    return len(x), len(x)


def audio_blocks(df: DataFrame, block: int, data_col: str = "content", key: str = "path") -> DataFrame:
    """16-bit samples of each WAV file's bytes, in blocks of ``block`` samples; the last may be
    shorter. (key, block_id, samples)"""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k, x in zip(b.column(0), b.column(1)):
                data = memoryview(x.as_buffer())
                first, last = _samples_at(data)
                a = np.frombuffer(data[first : first + (last - first) // 2 * 2], dtype="<i2")
                for at in range(0, -(-len(a) // block), 256):
                    part = [a[j * block : (j + 1) * block] for j in range(at, min(-(-len(a) // block), at + 256))]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(part), b.column(0).type), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.list_(pa.int16()))], [key, "block_id", "samples"])

    return df.select(key, data_col).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, block_id long, samples array<smallint>")


def overlapped_blocks(blocks: DataFrame, key: str = "stream_id", order: str = "block_id", samples: str = "samples") -> DataFrame:
    """Blocks with half overlap: the block before (zeros before the first), then the block."""
    before = F.lag(samples).over(W.partitionBy(key).orderBy(order))
    return blocks.withColumn(samples, F.concat(F.coalesce(before, F.transform(samples, lambda x: x - x)), F.col(samples)))


def thin_to_fps(frames: DataFrame, source_fps: int, fps: int, key: str | None = None) -> DataFrame:
    """Drops evenly spread frames of each second so that about ``fps`` of ``source_fps`` are
    left, and numbers the rest anew per stream. Nothing is dropped when fps is not below."""
    n = int(source_fps - fps)
    if n > 0:
        step = (source_fps - 1) / (n - 1) if n > 1 else 0
        gone = [int(step * k) for k in range(n)]
        frames = frames.where(~(F.col("frame_id") % source_fps).isin(gone))
    over = (W.partitionBy(key) if key else W.partitionBy(F.lit(0))).orderBy("frame_id")
    return frames.withColumn("out_id", F.row_number().over(over).cast("long") - 1)


def with_metadata(frames: DataFrame, source_fps: float, target_fps: float, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT) -> DataFrame:
    return frames.withColumn("meta", F.struct(F.col("ts").alias("timestamp"), F.col("frame_id"), F.lit(source_fps).alias("source_fps"), F.lit(target_fps).alias("target_fps"), F.lit(width).alias("width"), F.lit(height).alias("height")))


# derived fixtures over the driver's tables


def _load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per order, one box per line item."""
    x = F.col("l_partkey") * 7 % 561
    y = F.col("l_suppkey") * 13 % 401
    side = F.col("l_quantity").cast("long") + 20
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return _load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.row_number().over(order).cast("long").alias("det_idx"), F.col("l_returnflag").alias("label"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("category_id"),
        F.round(1.0 - F.col("l_discount") * 5 - F.col("l_tax"), 4).alias("score"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + side).cast("double").alias("x2"), (y + side).cast("double").alias("y2"),
        "l_partkey", "l_suppkey", "l_quantity",
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 frames or so of STREAMS streams, a track per user; boxes move 11 px right and 7 px down a frame."""
    events = _load(spark, sf_dir, "events")
    k = F.broadcast(events.agg(F.greatest(F.lit(5), F.expr("count(DISTINCT user_id) div 3")).alias("k")))
    g = events.crossJoin(k).select(F.expr("event_id div k").alias("frame_id"), "ts", "user_id", "event_type", "value")
    first = g.groupBy("frame_id").agg(F.min("ts").alias("fts"))
    x = (F.col("user_id") * 37 + F.col("frame_id") * 11) % 600
    y = (F.col("user_id") * 53 + F.col("frame_id") * 7) % 420
    rows = g.groupBy("frame_id", "user_id").agg(F.min("event_type").alias("label"), F.round(F.max("value") / 500.0, 4).alias("score"))
    return rows.join(first, "frame_id").select(
        "frame_id", F.col("fts").alias("ts"), F.col("user_id").alias("track_id"), "label", (F.col("user_id") % STREAMS).alias("stream_id"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 40).cast("double").alias("x2"), (y + 60).cast("double").alias("y2"), "score",
    )


def frames_of(tracks_df: DataFrame, streams: int = 0) -> DataFrame:
    """The frames' times; with ``streams``, of each of so many streams that share the clock."""
    out = tracks_df.groupBy("frame_id").agg(F.min("ts").alias("ts"))
    return out.withColumn("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(streams - 1).cast("long")))) if streams else out


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal per user: the events' values in order of event_id."""
    return _load(spark, sf_dir, "events").select(F.col("event_id").alias("n"), "ts", "value", "user_id")

