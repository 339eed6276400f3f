"""python -m prismlane keyframes|twopass|clusters|persons|speakers|images --input DIR --output DIR [--set name=value ...]"""

from __future__ import annotations

import argparse
import ast
import dataclasses

from prismlane import config
from prismlane.plans import pipelines
from prismlane.session import local_session

MOST_PHOTOS = 1024


def settings(kind: type, pairs: list[str]):
    known = {f.name for f in dataclasses.fields(kind)}
    found = dict(p.split("=", 1) for p in pairs)
    if bad := set(found) - known:
        raise SystemExit(f"unknown settings: {', '.join(sorted(bad))}; known: {', '.join(sorted(known))}")

    def value(text: str):
        try:
            return ast.literal_eval(text)
        except (ValueError, SyntaxError):
            return text

    return kind(**{k: value(v) for k, v in found.items()})


def query_photos(queries) -> list:
    """All of them, in an order of their own: they become literals of the plan, so there may not be more than MOST_PHOTOS."""
    rows = queries.select("embedding").orderBy("embedding").take(MOST_PHOTOS + 1)
    if len(rows) > MOST_PHOTOS:
        raise SystemExit(f"more than {MOST_PHOTOS} query photos; give fewer, or one run for each part")
    return rows


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="prismlane", description=__doc__)
    args.add_argument("pipeline", choices=["keyframes", "twopass", "clusters", "persons", "speakers", "images"])
    args.add_argument("--input", required=True, help="folder with the Parquet tables frames, faces, samples, queries, segments, seen, turns or scores")
    args.add_argument("--output", required=True)
    args.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE")
    a = args.parse_args(argv)
    spark = local_session("*")
    read = lambda t: spark.read.parquet(f"{a.input}/{t}.parquet")
    if a.pipeline == "keyframes":
        out = dict(zip(("selected", "decisions"), pipelines.keyframes(read("frames"), settings(config.KeyframeConfig, a.set))))
    elif a.pipeline == "twopass":
        out = dict(zip(("selected", "decisions"), pipelines.two_pass_keyframes(read("frames"), settings(config.TwoPassConfig, a.set))))
    elif a.pipeline == "speakers":
        out = {"clips": pipelines.speaker_clips(read("segments"), read("seen"), read("turns"), settings(config.SpeakerConfig, a.set))}
    elif a.pipeline == "clusters":
        out = dict(zip(("clusters", "segments"), pipelines.face_clusters(read("faces"), settings(config.ClusterConfig, a.set))))
    elif a.pipeline == "persons":
        photos = [list(map(float, r["embedding"])) for r in query_photos(read("queries"))]
        out = {"clips": pipelines.person_clips(read("faces"), read("samples"), photos, settings(config.PersonConfig, a.set))}
    else:
        out = {"images": pipelines.score_images(read("scores"), settings(config.ImageConfig, a.set))}
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{a.output}/{name}")


if __name__ == "__main__":
    main()
