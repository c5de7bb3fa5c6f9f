"""The boundary to models: inputs, batch prediction, baseline models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import encode_dna, normalized_distances, normalized_states, onehot_dna
from ..schema import SITE
from ..staging import staged


def build_model_input(neighbors: DataFrame, windows: DataFrame | None = None, labels: DataFrame | None = None, own: bool = False) -> DataFrame:
    """One row per site and cell: ``state`` and ``dist`` scaled, and if given ``dna`` (one-hot), ``value`` and ``weight``.

    With ``own`` value and weight stand beside the neighbours, so that nothing is joined.
    """
    kept = ["value", "weight"] if own else []
    out = neighbors.select(*SITE, "cell", normalized_states(F.col("state")).alias("state"), normalized_distances(F.col("dist")).alias("dist"), *kept)
    if windows is not None:
        out = out.join(windows.select(*SITE, onehot_dna(encode_dna(F.col("seq"))).alias("dna")), SITE, "left")
    if labels is not None:
        out = out.join(labels.select(*SITE, "cell", "value", "weight"), [*SITE, "cell"], "left")
    return out


def predict_batches(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str] = SITE) -> DataFrame:
    """``keys, output, z`` from a function that turns a batch into a frame with a column for each output, row by row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = predict(pdf).reset_index(drop=True)
            rows = pd.concat([pdf[keys].reset_index(drop=True), found], axis=1)
            yield rows.melt(id_vars=keys, value_vars=list(found.columns), var_name="output", value_name="z")[[*keys, "output", "z"]]

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("output", T.StringType()), T.StructField("z", T.DoubleType())])
    return df.mapInPandas(run, schema)


#: Numbers of all models that are fitted together (for each output, as many as the square of its features).
MAX_NUMBERS = 20_000_000
_SUMS = "cell string, part long, sums array<double>"
#: Partial sums of a cell that one task adds up.
FAN_IN = 64


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    """Arrays of ``p`` numbers as rows, without Python objects."""
    return _floats(column.flatten()).reshape(-1, p)


def _coded(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Different values, and which of them each row has."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, p: int, of: Callable[[str, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> dict[str, np.ndarray]:
    """For each cell the sum over its rows of what ``of(cell, features, labels, weights)`` gives for some of them.

    Each task adds up its own rows; then ``FAN_IN`` partial sums of a cell meet at a time, in as many levels as that takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, part = _matrix(batch.column("x"), p), batch.column("part")[0].as_py()
            y, w = _floats(batch.column("y")), _floats(batch.column("weight"))
            names, cells = _coded(batch.column("cell"))
            for k, c in enumerate(names):
                own = cells == k
                total[c] = total.get(c, 0.0) + of(c, x[own], y[own], w[own])
        if total:
            sums = pa.array([list(s) for s in total.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([part] * len(total), pa.int64()), sums], ["cell", "part", "sums"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "sums": [np.sum(pdf["sums"].to_list(), axis=0)]})

    n = rows.rdd.getNumPartitions()  # of the plan; nothing runs
    sums = rows.select("cell", "x", "y", "weight", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, _SUMS)
    while n > 1:
        sums = sums.groupBy("cell", F.expr(f"part div {FAN_IN}").alias("part")).applyInPandas(add, _SUMS)
        n = -(-n // FAN_IN)
    return {r.cell: np.array(r.sums) for r in sums.collect()}  # within MAX_NUMBERS


def fit_logistic(rows: DataFrame, p: int, iterations: int = 25, ridge: float = 0.01) -> dict[str, tuple[np.ndarray, float]]:
    """Coefficients and intercept of every cell's weighted logistic regression, from ``cell, x, y, weight``.

    The ridge is on features scaled to unit variance, and not on the intercept. Newton's
    method; each iteration sums gradient and curvature of all cells in one pass. Cells of one
    class get an infinite intercept of its sign.
    """
    first = _summed(rows, p, lambda c, x, y, w: np.r_[w.sum(), w @ x, w @ x**2, w @ y, y.min() * len(y), y.max() * len(y), len(y)])
    found, todo, scale = {}, {}, {}
    for c, s in first.items():
        mean = s[1 : p + 1] / s[0]
        std = np.sqrt(np.maximum(s[p + 1 : 2 * p + 1] / s[0] - mean**2, 0))
        std = np.where(std > 1e-9, std, 0)
        share = s[2 * p + 1] / s[0]
        if share <= 0 or share >= 1:
            found[c] = np.zeros(p), np.inf if share >= 1 else -np.inf
        else:
            scale[c] = mean, np.divide(1, std, out=np.zeros(p), where=std > 0), s[0]
            todo[c] = np.r_[np.zeros(p), np.log(share / (1 - share))]
    for _ in range(iterations):
        if not todo:
            break

        def step(c: str, x: np.ndarray, y: np.ndarray, w: np.ndarray, now: dict = dict(todo)) -> np.ndarray:
            if c not in now:
                return np.zeros(p + 1 + (p + 1) ** 2)
            mean, inverse, total = scale[c]
            a = np.c_[(x - mean) * inverse, np.ones(len(x))]
            z = 1 / (1 + np.exp(-np.clip(a @ now[c], -500, 500)))
            w = w / total
            return np.r_[a.T @ (w * (z - y)), ((a * (w * z * (1 - z))[:, None]).T @ a).ravel()]

        for c, s in _summed(rows, p, step).items():
            if c in todo:
                b, penalty = todo[c], np.r_[np.full(p, ridge), 0]
                change = np.linalg.solve(s[p + 1 :].reshape(p + 1, p + 1) + np.diag(penalty + 1e-12), s[: p + 1] + penalty * b)
                todo[c] = b - change
                if np.abs(change).max() < 1e-10 or _ == iterations - 1:
                    mean, inverse, _total = scale[c]
                    own = todo.pop(c)
                    found[c] = own[:p] * inverse, float(own[p] - own[:p] @ (mean * inverse))
    return found


def fit_output_models(inputs: DataFrame, outputs: list[str], features: list[str] = ["state", "dist"], keys: list[str] = SITE, iterations: int = 25) -> DataFrame:
    """``keys, output, y, z``: for each output (a cell) a weighted logistic regression on its features, applied to all its rows.

    ``inputs`` has ``cell``, array columns ``features`` without nulls, ``value`` (null: not used for the
    fit) and ``weight``. All outputs are fitted in the same passes, as many at a time as
    ``MAX_NUMBERS`` allows. An output of one class gets that class, one without labels null.
    """
    rows = staged(inputs.select(*keys, "cell", F.concat(*features).alias("x"), F.bround("value").alias("y"), "weight", F.col("value").alias("__value")), "model-inputs")
    size = rows.select(F.max(F.size("x"))).first()[0] or 0
    block = max(1, MAX_NUMBERS // (size + 2) ** 2)
    schema = T.StructType([*(rows.schema[k] for k in keys), *T._parse_datatype_string("output string, y double, z double").fields])
    out = None
    for at in range(0, len(outputs), block):  # once, but for very many outputs
        own = rows.filter(F.col("cell").isin(*outputs[at : at + block]))
        models = fit_logistic(own.filter("y IS NOT NULL").select("cell", "x", "y", "weight"), size, iterations)

        def predict(batches: Iterator[pa.RecordBatch], models: dict = models) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, (names, cells) = _matrix(batch.column("x"), size), _coded(batch.column("cell"))
                own = [models.get(c, (np.zeros(size), np.nan)) for c in names]
                b, a = np.array([m[0] for m in own]).reshape(-1, size), np.array([m[1] for m in own])
                with np.errstate(over="ignore"):
                    z = 1 / (1 + np.exp(-((x * b[cells]).sum(axis=1) + a[cells])))
                output = pa.array([f"cpg/{c}" for c in names], pa.string()).take(pa.array(cells))
                numbers = [pa.array(v, pa.float64(), mask=np.isnan(v)) for v in (_floats(batch.column("__value")), z)]
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], output, *numbers], schema.names)

        z = own.mapInArrow(predict, schema)
        out = z if out is None else out.unionByName(z)
    return inputs.sparkSession.createDataFrame([], schema) if out is None else out
