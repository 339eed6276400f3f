"""Code shipped to workers, and the tables kept between jobs, which the library keeps in the folder that driver and executors share."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

from prismlane.shared import discard, new_path, shared_dir, stash  # noqa: F401


def by_value(name: str) -> None:
    """Functions of this module travel with the job, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def free_name(wanted: str, taken) -> str:
    """wanted, or with underscores added until no column of `taken` has that name in any case."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted
