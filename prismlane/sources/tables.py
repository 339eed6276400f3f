"""Stored tables and the views that stand in for frames, detections and scores on the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


#: Expressions over events, in words that Spark and other SQL engines read alike.
PIXEL_VIEW = [
    "event_id", "user_id as video_id", "event_type", "value * 5e-1 as sharpness_var", "(event_id % 17) / 1e2 as noise_sigma",
    "(event_id % 23) / 1e3 as clip_shadows", "(event_id % 29) / 15e2 as clip_highlights", "(event_id % 101) / 1e2 as mean_luma",
    "(event_id % 19) / 1e0 as color_cast", "(event_id * 37) % 1700 + 200 as width", "(event_id * 53) % 1000 + 150 as height",
    "(event_id % 11) / 1e1 as face_conf", "(event_id % 47) / 1e2 as face_rel_area", "(event_id % 97) / 97e0 as subject_x",
    "(event_id % 89) / 89e0 as subject_y", "(event_id % 13) / 1e2 as skin", "(event_id % 31) / 5e0 as motion",
    "(event_id % 37) / 4e2 as person_ratio", "(event_id % 120) / 1e0 as face_sharpness", "(event_id % 3) as num_faces",
    "(event_id % 101) / 1e0 - 5e1 as eye_dy", "(event_id % 61) / 1e0 + 1e0 as eye_dx", "(event_id % 43) / 43e0 as bright_share",
    "(event_id % 83) / 83e0 as max_luma", "value / 50e0 as aesthetic", "4e0 + (event_id % 20) / 1e1 as nima", "(event_id % 50) / 5e1 as piq",
    "event_id % 41 = 0 as overlay_card", "event_id % 19 = 0 as text_prominent",
]

#: Boxes inside 640 x 480.
BOX_VIEW = ["event_id", "user_id as video_id", "event_id % 50 as frame_idx", "(event_id * 7) % 400 as x", "(event_id * 13) % 300 as y", "20 + event_id % 80 as w", "20 + (event_id * 3) % 80 as h"]


def pixels(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "events").selectExpr(*PIXEL_VIEW)


def boxes(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "events").selectExpr(*BOX_VIEW)


def frames(spark: SparkSession, base: str, vectors: bool = True) -> DataFrame:
    """video_id, frame_index, timestamp_sec, aesthetic, tech_score, has_smile, event_type, event_id, vec_id[, embedding].

    The only window is per video; the vectors come by an equi join on vec_id.
    """
    emb = load(spark, base, "embeddings")
    n = emb.agg(F.count("*")).scalar()  # part of the plan, no job of its own
    e = load(spark, base, "events").select(
        F.col("user_id").alias("video_id"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("frame_index"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) - F.lit(1704067200.0)).alias("timestamp_sec"),
        (F.col("value") / F.lit(50.0)).alias("aesthetic"),
        F.get_json_object("props", "$.k").cast("double").alias("tech_score"),
        (F.col("event_type") == "click").alias("has_smile"),
        "event_type",
        "event_id",
        (F.col("event_id") % n).alias("vec_id"),
    )
    return e.join(emb.select("vec_id", "embedding"), "vec_id") if vectors else e


def image_scores(spark: SparkSession, base: str) -> DataFrame:
    """image_id, clip, nima, piq, brisque, quality; the last four null where there is no label."""
    d, lab = load(spark, base, "documents").select("doc_id", "n_chars"), load(spark, base, "labels").select("doc_id", "quality")
    some = F.col("quality").isNotNull()
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("image_id"),
        (F.lit(3.0) + (F.col("n_chars") % 500) / F.lit(100.0)).alias("clip"),
        F.when(some, F.lit(3.5) + (F.col("doc_id") % 37) / F.lit(10.0)).alias("nima"),
        F.when(some, F.lit(0.4) + (F.col("doc_id") % 61) / F.lit(100.0)).alias("piq"),
        F.when(some, (F.col("doc_id") % 53).cast("double")).alias("brisque"),
        "quality",
    )


FRAMES_SQL = """select e.user_id as video_id, cast(row_number() over (partition by e.user_id order by e.ts, e.event_id) as int) as frame_index,
 epoch_us(e.ts)/1e6 - 1704067200.0::double as timestamp_sec, e.value/50.0::double as aesthetic, cast(json_extract_string(e.props,'$.k') as double) as tech_score,
 e.event_type='click' as has_smile, e.event_type as event_type, e.event_id, v.vec_id, v.embedding::double[] as embedding
 from (select ev.*, n.n from events ev, (select count(*) as n from embeddings) n) e join embeddings v on v.vec_id = e.event_id % e.n"""
SCORES_SQL = """select d.doc_id as image_id, 3.0::double+(d.n_chars % 500)/100.0::double as clip,
 case when l.quality is null then null else 3.5::double+(d.doc_id % 37)/10.0::double end as nima,
 case when l.quality is null then null else 0.4::double+(d.doc_id % 61)/100.0::double end as piq,
 case when l.quality is null then null else (d.doc_id % 53)::double end as brisque, l.quality from documents d left join labels l on l.doc_id = d.doc_id"""
PIXELS_SQL = f"select {', '.join(PIXEL_VIEW)} from events"
BOXES_SQL = f"select {', '.join(BOX_VIEW)} from events"
