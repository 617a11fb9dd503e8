"""Files for the workers and models that are spread to them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession

from lectern.plans.session import put_bytes


def put(spark: SparkSession, data: bytes, name: str) -> str:
    """Hand ``data`` to the workers as a file: written into the shared folder, fetched once by each executor, replacements of lost
    ones included. Returns its name for SparkFiles.get."""
    own = f"{name}-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(put_bytes(spark, data, own))
    return own


def full_frames(f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A batch function that hands on no empty frames, whose column types can't be told."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in f(batches):
            if len(out):
                yield out

    return run
