"""Fitted models as folders, with the fingerprint of the table that they were fitted on."""

from __future__ import annotations

import json
from dataclasses import asdict
from hashlib import sha256

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.mixed_model import Choice, Given, Input, Line, MixedModel, Noise, Steps, Table

VERSION = 1


def fingerprint(df: DataFrame) -> str:
    """A hash of the rows as a multiset, and of the columns' names and types: the same in any order of rows or columns and any partitioning.

    Two 64-bit hashes of every row are summed, with the number of rows, in one pass; a changed cell changes both sums, and
    a row that stands twice counts twice.
    """
    names = sorted(df.columns)
    parts = [F.struct(F.col(f"`{c}`").isNull(), F.col(f"`{c}`")) for c in names]
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string")
    row = df.agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    types = [(c, df.schema[c].dataType.simpleString()) for c in names]
    return sha256(json.dumps([types, row.n, row.a, row.b]).encode()).hexdigest()


def save_model(model: MixedModel, folder: str, fitted_on: DataFrame) -> str:
    """Write the model's network, levels and mechanisms, and return the fingerprint of the table, which is kept with them."""
    spark, mark = fitted_on.sparkSession, fingerprint(fitted_on.select(*model.network))
    state = {"version": VERSION, "fingerprint": mark, "network": model.network, "kinds": model.kinds, "levels": model.levels, "mechanisms": {}}
    for k, (n, m) in enumerate(sorted(model.mechanisms.items())):
        body = asdict(m) if not isinstance(m, Steps) else {"levels": m.levels, "inputs": [asdict(i) for i in m.inputs], "noise": asdict(m.noise), "explained": m.explained, "trees": None}
        if isinstance(m, Steps) and m.trees is not None:
            body["trees"] = f"trees-{k:04d}"
            m.trees.write().save(f"{folder}/{body['trees']}")
        state["mechanisms"][n] = [type(m).__name__, body]
    spark.createDataFrame([(json.dumps(state),)], "value string").write.text(f"{folder}/model")
    return mark


def load_model(spark: SparkSession, folder: str, fitted_on: DataFrame | None = None) -> MixedModel:
    """The stored model; ValueError for another version, or if the table given is not the one that it was fitted on."""
    state = json.loads(spark.read.text(f"{folder}/model").first().value)
    if state["version"] != VERSION:
        raise ValueError(f"version {state['version']} of a stored model")
    if fitted_on is not None and fingerprint(fitted_on.select(*state["network"])) != state["fingerprint"]:
        raise ValueError("the table is not the one that the model was fitted on")

    def noise(x: dict) -> Noise:
        return Noise(tuple(x["quantiles"]), x["low"], x["step"], tuple(x["density"]), x["whole"])

    def mechanism(kind: str, x: dict):
        if kind == "Table":
            return Table(x["levels"], x["parents"], [(tuple(k), ps) for k, ps in x["rows"]], x["overall"])
        if kind == "Given":
            return Given(x["text"], x["parents"], noise(x["noise"]), x["shift"], x["explained"])
        inputs = [Input(**i) for i in x["inputs"]]
        if kind == "Choice":
            return Choice(x["levels"], inputs, x["intercepts"], x["weights"])
        if kind == "Line":
            return Line(inputs, x["intercept"], x["weights"], noise(x["noise"]), x["explained"])
        return Steps(x["levels"], inputs, x["trees"] and GBTRegressionModel.load(f"{folder}/{x['trees']}"), noise(x["noise"]), x["explained"])

    return MixedModel(state["network"], state["kinds"], state["levels"], {n: mechanism(*m) for n, m in state["mechanisms"].items()})
