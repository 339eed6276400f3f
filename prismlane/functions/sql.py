"""The library as SQL functions of a session: bodies are SQL, so Catalyst inlines them like any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "pl_dot(a array<double>, b array<double>)": ("double", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "pl_norm(a array<double>)": ("double", "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))"),
    "pl_cosine_distance(a array<double>, b array<double>)": ("double", "1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "pl_hamming(a bigint, b bigint)": ("int", "bit_count(a ^ b)"),
    "pl_hash_from_hex(h string)": ("bigint", "cast(conv(h, 16, -10) as bigint)"),
    "pl_overall(clip double, nima double, piq double)": ("double", "(clip + nima) * piq"),
    "pl_selection_gate(clip double, nima double, piq double)": ("boolean", "coalesce(clip >= 5D and nima >= 4.75D and piq >= 0.7D and (clip + nima) * piq >= 8D, false)"),
    "pl_image_gate(clip double, nima double, piq double)": ("boolean", "coalesce(clip >= 5D and nima >= 5D and piq >= 0.8D and (clip + nima) * piq >= 9D, false)"),
    "pl_iou(ax int, ay int, aw int, ah int, bx int, by int, bw int, bh int)": (
        "double",
        "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by + bh) - greatest(ay, by)) / "
        "(aw * ah + bw * bh - greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by + bh) - greatest(ay, by)) + 1e-9D)",
    ),
    "pl_slug(s string)": ("string", "regexp_replace(lower(s), '[^a-z0-9_-]', '_')"),
    "pl_sampling_step(fps double, per_second double)": ("int", "greatest(1, cast(bround(coalesce(nullif(fps, 0D), 25D) / per_second) as int))"),
}
#: Table functions: columns and body.
TABLES = {
    "pl_chunk_plan(duration double, chunk double)": (
        "chunk_id int, start_sec double, end_sec double",
        "select id, id * chunk, case when duration > 0 then least((id + 1) * chunk, duration) end from (select explode(sequence(0, case when duration > 0 then cast(ceil(duration / chunk) as int) - 1 else 0 end)) as id)",
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions as temporary ones and returns their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} returns {kind} return {body}")
    for head, (columns, body) in TABLES.items():
        spark.sql(f"create or replace temporary function {head} returns table ({columns}) return {body}")
    return [h.split("(")[0] for h in (*FUNCTIONS, *TABLES)]
