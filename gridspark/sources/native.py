"""The engine's own lossless format: Parquet for each group of variables and a JSON header."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridspark.model import Dataset, Var


def save(ds: Dataset, path: str, mode: str = "error") -> None:
    head = {"dims": ds.dims, "vars": {v: {"dims": list(x.dims), "attrs": x.attrs} for v, x in ds.vars.items()}, "attrs": ds.attrs, "coords": sorted(ds.coords)}
    for key in ds.frames:
        ds.to_frame(key).write.mode(mode).parquet(f"{path}/group={'.'.join(key) or '_'}")
    ds.spark.createDataFrame([(json.dumps(head, default=str),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/_header")


def load(spark: SparkSession, path: str) -> Dataset:
    head = json.loads(spark.read.text(f"{path}/_header").select(F.col("value")).first()[0])
    vars_ = {v: Var(tuple(x["dims"]), x["attrs"]) for v, x in head["vars"].items()}
    frames = {k: spark.read.parquet(f"{path}/group={'.'.join(k) or '_'}") for k in dict.fromkeys(x.dims for x in vars_.values())}
    return Dataset(head["dims"], vars_, frames, head["attrs"], frozenset(head["coords"]))
