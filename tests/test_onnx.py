"""An ONNX model behind the scorer contract. The model file is encoded by hand: two matrix products."""

import struct

import numpy as np
from pyspark.sql import functions as F

from spectrel.operators import scoring
from spectrel.session import scratch_path


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | (128 if n else 0)])
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def tensor(name, array):
    raw = struct.pack(f"<{array.size}f", *array.ravel())
    return b"".join(field(1, d) for d in array.shape) + field(2, 1) + field(8, name) + field(9, raw)


def value_info(name, dims):
    shape = b"".join(field(1, field(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    return field(1, name) + field(2, field(1, field(1, 1) + field(2, shape)))


def node(op, inputs, outputs):
    return b"".join(field(1, i) for i in inputs) + b"".join(field(2, o) for o in outputs) + field(4, op)


def model(path, w, v):
    graph = (field(1, node("Flatten", ["x"], ["flat"])) + field(1, node("MatMul", ["flat", "w"], ["logits"]))
             + field(1, node("MatMul", ["flat", "v"], ["ilmenite"])) + field(2, "g")
             + field(5, tensor("w", w)) + field(5, tensor("v", v)) + field(11, value_info("x", ["n", 1, w.shape[0]]))
             + field(12, value_info("logits", ["n", w.shape[1]])) + field(12, value_info("ilmenite", ["n", 1])))
    with open(path, "wb") as f:
        f.write(field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13)))


def test_onnx_model_scores_in_batches(spark, tmp_path):
    rng = np.random.default_rng(0)
    w, v, x = rng.normal(size=(33, 6)).astype("f4"), rng.normal(size=(33, 1)).astype("f4") * .1, rng.uniform(size=(50, 33))
    path = str(tmp_path / "m.onnx")
    model(path, w, v)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(50, None)], "id int, features array<double>").repartition(4)
    out = {r["id"]: r for r in scoring.onnx_scorer(path, 33).score(df).collect()}
    for i, r in enumerate(x.astype("f4")):
        z = r @ w
        p = np.exp(z - z.max())
        assert np.allclose(out[i]["probabilities"], p / p.sum(), atol=1e-5)
        assert np.isclose(out[i]["ilmenite_fraction"], float((r @ v)[0]), atol=1e-5)
    assert out[50]["probabilities"] is None and out[50]["ilmenite_fraction"] is None
    full = scoring.score(df.where("id < 50"), scoring.onnx_scorer(path, 33), "multispectral")
    assert full.where(F.col("ilmenite_fraction").between(0, 1)).count() == 50


def test_payload_shape(spark):
    df = spark.createDataFrame([([.1, .7, .2, 0., 0., 0.], .4)], "probabilities array<double>, ilmenite_fraction double")
    scored = scoring.score(df, scoring.ColumnScorer(F.col("probabilities"), F.col("ilmenite_fraction")))
    row = scoring.payload(scored, version="v2").first()
    assert row["predicted_class"] == "olivine_rich" and row["predicted_class_index"] == 1 and row["model_version"] == "v2"
    assert [p["name"] for p in row["probabilities"]][:2] == ["ilmenite_rich", "olivine_rich"]
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
