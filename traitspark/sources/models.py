"""Store of fitted models on the shared file system."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..functions.scalars import file_label
from ..operators.forest import ForestFit
from ..operators.linear import LinearFit
from ..operators.perceptron import PerceptronFit

# The registered models in report order.
MODEL_NAMES = ("Linear Regression", "Lasso", "Ridge", "Elastic Net", "PLS", "Random Forest", "MLP")
NOT_LINEAR = ("Random Forest", "MLP")
SELECTED_PAIR = (MODEL_NAMES[0], MODEL_NAMES[5])

__all__ = ["MODEL_NAMES", "NOT_LINEAR", "SELECTED_PAIR", "file_label", "load_models", "save_models"]


_TREE_COLUMNS = ("feature", "threshold", "left", "value", "weight", "gain")
_TREE_SCHEMA = (
    "tree int, feature array<int>, threshold array<double>, left array<int>, value array<double>, "
    "weight array<double>, gain array<double>"
)


def _folder(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name.replace(' ', '_')}"


def save_models(spark: SparkSession, root: str, models: Sequence) -> None:
    """Write each model to its own folder, replacing an earlier version."""
    for m in models:
        if isinstance(m, LinearFit):
            meta = {"type": "linear", "kind": m.kind, "features": m.features, "params": m.params}
            numbers = [m.intercept, *m.coef]
        elif isinstance(m, PerceptronFit):
            meta = {
                "type": "perceptron", "features": m.features, "params": m.params,
                "sizes": list(m.sizes), "n_epochs": m.n_epochs,
            }
            numbers = list(m.weights)
        elif isinstance(m, ForestFit):
            meta = {"type": "forest", "features": m.features, "params": m.params}
            numbers = []
            trees = spark.createDataFrame([(i, *(t[c] for c in _TREE_COLUMNS)) for i, t in enumerate(m.trees)], _TREE_SCHEMA)
            trees.write.mode("overwrite").parquet(_folder(root, m.name) + "/trees")
        else:
            raise TypeError(f"cannot save {type(m).__name__}")
        row = spark.createDataFrame([(m.name, json.dumps(meta), numbers)], "name string, meta string, numbers array<double>")
        row.coalesce(1).write.mode("overwrite").parquet(_folder(root, m.name) + "/model")


def load_models(
    spark: SparkSession, root: str, names: Sequence[str] = MODEL_NAMES, fitted: bool = True
) -> dict:
    """Models that exist, in registry order; ``fitted=False`` gives their untrained forms."""
    out = {}
    for name in names:
        try:
            row = spark.read.parquet(_folder(root, name) + "/model").first()
        except AnalysisException:
            continue  # not saved yet
        meta = json.loads(row["meta"])
        if meta["type"] == "linear":
            model = LinearFit(
                name, meta["kind"], meta["features"], row["numbers"][0], list(row["numbers"][1:]), meta["params"]
            )
        elif meta["type"] == "perceptron":
            model = PerceptronFit(
                name, meta["features"], meta["sizes"], list(row["numbers"]), meta["params"], meta["n_epochs"]
            )
        else:
            # one row a tree, as many and as large as the fit had them on the driver
            rows = spark.read.parquet(_folder(root, name) + "/trees").orderBy("tree").collect()
            model = ForestFit(name, meta["features"], [{c: list(r[c]) for c in _TREE_COLUMNS} for r in rows], meta["params"])
        out[name] = model if fitted else model.reset()
    return out
