"""Trained artifacts as tables: the profile, the forest and the calibration, in versions of one folder."""

from __future__ import annotations

import hashlib
import json
import time

import numpy as np
from pyspark.sql import SparkSession

from ..operators import baseline, iforest
from ..operators.calibrate import Calibration
from ..plans.session import Folder

CURRENT = "current"


def save(spark: SparkSession, model: dict, path: str, keys: int | None = 5000) -> str:
    """Write a model (profile, forest, calibration) and make it the current one; its version, which follows from what
    the model holds. `keys`: how many keys of a kind the profile keeps (None: all)."""
    folder = Folder(spark, path)
    forest, cal = model["forest"], model["calibration"]
    about = {
        "names": list(forest["names"]), "mean": forest["mean"].tolist(), "scale": forest["scale"].tolist(), "size": int(forest["size"]), "offset": float(forest["offset"]),
        "calibration": {"quantiles": list(cal.quantiles), "mean": cal.mean, "std": cal.std, "n": cal.n, "offset": cal.offset},
    }
    text = json.dumps(about)
    version = hashlib.sha256((text + forest["nodes"].to_csv(index=False)).encode()).hexdigest()[:16]
    if f"about-{version}.json" in folder.names():  # written before; its tables may be in use
        folder.publish(CURRENT, version)
        return version
    for name in ("nodes", "profile"):
        folder.delete(f"{version}/{name}")
    spark.createDataFrame(forest["nodes"], iforest.NODES).write.parquet(f"{path}/{version}/nodes")  # some trees of bounded size
    profile = model["profile"] if keys is None else baseline.top_keys(model["profile"], keys)
    profile.select("kind", "key", "n", "first_seen").write.parquet(f"{path}/{version}/profile")
    folder.create(f"about-{version}.json", text)
    folder.publish(CURRENT, version)
    return version


def load(spark: SparkSession, path: str, version: str | None = None) -> dict | None:
    """The model of a version (the current one) with its `version`; None where there is none."""
    folder = Folder(spark, path)
    names = folder.names()
    if version is None and (version := folder.latest(CURRENT)) is None:
        return None
    if f"about-{version}.json" not in names:
        return None
    about = json.loads(folder.read(f"about-{version}.json"))
    nodes = spark.read.schema(iforest.NODES).parquet(f"{path}/{version}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
    forest = {"nodes": nodes, "mean": np.array(about["mean"]), "scale": np.array(about["scale"]), "size": about["size"], "names": about["names"], "offset": about["offset"]}
    cal = about["calibration"]
    profile = spark.read.schema("kind string, key string, n long, first_seen long").parquet(f"{path}/{version}/profile")
    return {"profile": profile, "forest": forest, "calibration": Calibration(**{**cal, "quantiles": tuple(cal["quantiles"])}), "version": version}


def wait(spark: SparkSession, path: str, seconds: float, every: float = 10.0) -> dict:
    """The current model as soon as there is one; TimeoutError after `seconds`."""
    until = time.monotonic() + seconds
    while (model := load(spark, path)) is None:
        if time.monotonic() >= until:
            raise TimeoutError(f"no model in {path} after {seconds} s")
        time.sleep(min(every, max(until - time.monotonic(), 0.0)))
    return model
