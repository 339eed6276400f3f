"""Listings of videos and images, stored indexes and score tables, and decoded frames as a data source."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: File endings, fixed by the stored collections.
VIDEO_ENDINGS = ("mp4", "mov", "mkv", "avi", "flv", "webm", "m4v", "mpg", "mpeg")
CLIP_ENDINGS = ("mp4", "mov", "mkv", "avi", "webm", "m4v", "mpg", "mpeg")
PHOTO_ENDINGS = ("jpg", "jpeg", "png", "bmp", "webp")
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "tiff", "webp")


def listing(spark: SparkSession, path: str, endings: tuple[str, ...] = VIDEO_ENDINGS) -> DataFrame:
    """path and length of the files below `path` with one of the endings, in any case; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.lower("path").rlike(rf"\.({'|'.join(endings)})$")).orderBy("path")


def named(spark: SparkSession, names: str) -> DataFrame:
    """A comma-separated list as rows."""
    return spark.createDataFrame([(names,)], "names string").select(F.explode(F.split("names", ",")).alias("p")).select(F.trim("p").alias("path")).where("path <> ''")


def videos(df: DataFrame) -> DataFrame:
    """Ids from the path, rates and lengths with their fallbacks; one row a path."""
    fps = F.coalesce(F.nullif(F.col("fps"), F.lit(0.0)), F.lit(25.0))
    length = F.coalesce(F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")), F.lit(0.0))
    return df.dropDuplicates(["path"]).withColumns({"video_id": F.substring(F.sha2("path", 256), 1, 32), "duration_sec": length, "fps": fps})


def stored_frames(frames: DataFrame, embeddings: DataFrame, video: str, run: str, dim: int, least: float = 0.0) -> DataFrame:
    """Frames of one run with vectors of the right length, normalised, best first."""
    from prismlane.functions import vectors as V

    f = frames.where((F.col("video_id") == video) & F.col("frame_id").like(f"{video}:{run}:%"))
    out = f.join(embeddings, "frame_id").where(F.size("embedding") == dim).withColumn("aesthetic", F.coalesce("aesthetic", F.lit(0.0))).where(F.col("aesthetic") >= least)
    return out.withColumn("embedding", F.transform(V.doubles(F.col("embedding")), lambda x: x / (V.norm(F.col("embedding")) + 1e-9))).orderBy(F.desc("aesthetic"), F.desc("quality"), "frame_index")


def vector_from_bytes(df: DataFrame, col: str, out: str = "embedding") -> DataFrame:
    """Little-endian float32 bytes as an array."""

    @F.pandas_udf("array<float>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, "<f4").tolist())

    return df.withColumn(out, read(col))


def markdown_scores(spark: SparkSession, path: str) -> DataFrame:
    """name and score from a two-column Markdown table; N/A or no number is null."""
    rows = spark.read.text(path).where(F.col("value").startswith("|"))
    cells = F.split(F.regexp_replace("value", r"^\||\|\s*$", ""), r"\|")
    out = rows.select(F.trim(cells[0]).alias("name"), F.trim(cells[1]).alias("s")).where(~F.col("s").rlike("^:?-+:?$"))
    return out.select("name", F.expr("try_cast(s as double)").alias("score")).where("name not in ('Image', 'image', 'File', 'file')")


class _Part(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str], decoder: Callable) -> None:
        self.options, self.decoder = options, decoder

    def partitions(self) -> list[_Part]:
        n, chunk = int(self.options["frames"]), int(self.options.get("chunk", "7500"))
        return [_Part(self.options["path"], a, min(n, a + chunk)) for a in range(0, n, chunk)]

    def read(self, part: _Part) -> Iterator[tuple]:
        step = int(self.options.get("step", "1"))
        fps = float(self.options.get("fps", "25")) or 25.0
        first = -(-part.start // step) * step
        for i in range(first, part.end, step):
            h, w, raw = self.decoder(part.path, i)
            yield (part.path, i, i / fps, h, w, raw)


def frame_source(decoder: Callable[[str, int], tuple[int, int, bytes]], name: str = "frames") -> type[DataSource]:
    """A data source that decodes every step-th frame, one partition a chunk; register it and read with path, frames, fps, step, chunk."""

    class Frames(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "video_path string, frame_index int, timestamp_sec double, h int, w int, bgr binary"

        def reader(self, schema) -> DataSourceReader:
            return FrameReader(self.options, decoder)

    return Frames
