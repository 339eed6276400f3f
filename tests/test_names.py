"""File names of the keyframe pipeline where scores and times stand on halves."""

import os

import duckdb
from pyspark.sql import functions as F

from prismlane.plans import catalogue
from prismlane.plans import pipelines as P
from prismlane.plans import queries_more as Q

from .conftest import MEDIUM, SMALL, TABLES, same_rows


def test_keyframes_on_more_videos(spark):
    """150 videos: one selected frame's score, 8.504999999999999, is a sum that misses a half by its last bit."""
    con = duckdb.connect()
    for t in TABLES:
        p = f"{MEDIUM}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    same_rows(catalogue.QUERIES["keyframes_pipeline"](spark, MEDIUM), con.sql(catalogue.ORACLE_SQL["keyframes_pipeline"]))


def test_times_in_names(spark):
    """Times round as scores do."""
    f = Q._easy(Q.frame_features(spark, SMALL)).withColumn("timestamp_sec", F.lit(8.504999999999999))
    selected, _ = P.keyframes(f, Q._cfg())
    names = [r["file"] for r in selected.collect()]
    assert names and all("_t8.51_clip-" in n for n in names)
