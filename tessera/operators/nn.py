"""Network layers, scoring and parameters.

The layer kernels are batched numpy helpers (im2col + matmul) that run inside
``mapInPandas`` on Arrow batches; Spark partitions the rows and broadcasts the
parameters.  A network is a list of layer dicts:

    {"type": "conv", "out": 64, "k": 3}      3x3 stride 1, no padding, leaky ReLU
    {"type": "pool", "k": 2}                 max pool k x k, stride k (truncating)
    {"type": "dense", "out": 1000}           leaky ReLU
    {"type": "output", "out": 2}             softmax (cross-entropy loss)

Images are flat row-major ``height x width x channels`` arrays.  Conv weights
are laid out ``(out, in, kh, kw)``, dense weights ``(out, in)``.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.hashing import DEFAULT_SEED, hash_unit

LEAKY_SLOPE = 0.01

# The 11-layer network of the image classifier (32x32x3 in, 2 classes).
CLASSIFIER_LAYERS = [
    {"type": "conv", "out": 64, "k": 3},
    {"type": "conv", "out": 64, "k": 3},
    {"type": "pool", "k": 2},
    {"type": "conv", "out": 128, "k": 3},
    {"type": "conv", "out": 128, "k": 3},
    {"type": "pool", "k": 2},
    {"type": "conv", "out": 240, "k": 3},
    {"type": "pool", "k": 2},
    {"type": "dense", "out": 1000},
    {"type": "dense", "out": 1000},
    {"type": "output", "out": 2},
]


def classifier_layers(n_classes: int = 2) -> list[dict]:
    """The classifier with ``n_classes`` outputs."""
    return CLASSIFIER_LAYERS[:-1] + [{"type": "output", "out": int(n_classes)}]


# --- shapes and parameters ------------------------------------------------------

def layer_shapes(layers: list[dict], input_shape: tuple[int, int, int]) -> list[dict]:
    """Per layer: input shape, output shape and parameter shapes."""
    h, w, c = input_shape
    out = []
    flat = None
    for i, L in enumerate(layers):
        t = L["type"]
        if t == "conv":
            k = L.get("k", 3)
            info = {"in": (h, w, c), "W": (L["out"], c, k, k), "b": (L["out"],)}
            h, w, c = h - k + 1, w - k + 1, L["out"]
        elif t == "pool":
            k = L.get("k", 2)
            info = {"in": (h, w, c)}
            h, w = h // k, w // k
        elif t in ("dense", "output"):
            flat = h * w * c if flat is None else flat
            info = {"in": (flat,), "W": (L["out"], flat), "b": (L["out"],)}
            flat = L["out"]
            h, w, c = 1, 1, flat
        else:
            raise ValueError(f"unknown layer type {t}")
        info["out"] = (h, w, c)
        info["index"] = i
        info["type"] = t
        out.append(info)
    return out


def param_specs(layers: list[dict], input_shape) -> list[tuple[int, str, tuple, int]]:
    """``(layer, name, shape, fan_in)`` for every parameter array."""
    specs = []
    for info in layer_shapes(layers, input_shape):
        if "W" in info:
            W = info["W"]
            fan_in = int(np.prod(W[1:]))
            specs.append((info["index"], "W", W, fan_in))
            specs.append((info["index"], "b", info["b"], fan_in))
    return specs


def count_parameters(layers, input_shape) -> int:
    return int(sum(np.prod(s) for _, _, s, _ in param_specs(layers, input_shape)))


def formula_parameters(layers, input_shape) -> dict:
    """Integer test weights: ``w[i] = (i*7+3) % 5 - 2``, bias ``b[j] = j % 3 - 1``."""
    params = {}
    for layer, name, shape, _ in param_specs(layers, input_shape):
        n = int(np.prod(shape))
        i = np.arange(n)
        v = ((i * 7 + 3) % 5 - 2) if name == "W" else (i % 3 - 1)
        params[(layer, name)] = v.astype(np.float64).reshape(shape)
    return params


def init_parameters(spark: SparkSession, layers, input_shape, seed: int = DEFAULT_SEED) -> DataFrame:
    """T5: ReLU-scaled normal weights (He init), zero biases, as rows
    ``(layer, name, idx, value)`` generated by ``spark.range`` on executors.

    Normal numbers come by Box-Muller from two md5 fractions of
    ``seed:layer:idx``, times ``sqrt(2 / fan_in)``.
    """
    frames = []
    for layer, name, shape, fan_in in param_specs(layers, input_shape):
        n = int(np.prod(shape))
        r = spark.range(n).withColumnRenamed("id", "idx")
        if name == "W":
            u1 = F.lit(1.0) - hash_unit(seed, F.lit(layer), F.lit(1), "idx")
            u2 = hash_unit(seed, F.lit(layer), F.lit(2), "idx")
            z = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)
            val = z * F.lit(math.sqrt(2.0 / fan_in))
        else:
            val = F.lit(0.0)
        frames.append(r.select(F.lit(layer).alias("layer"), F.lit(name).alias("name"), "idx",
                               val.alias("value")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def init_parameter_chunks(spark: SparkSession, layers, input_shape, seed: int = DEFAULT_SEED,
                          chunk: int = 1 << 16) -> DataFrame:
    """T5 in chunk form ``(layer, name, chunk, values)``: values are gathered
    into arrays of ``chunk`` on the executors, so the driver receives a few
    rows per layer instead of one row per parameter."""
    p = init_parameters(spark, layers, input_shape, seed)
    g = p.groupBy("layer", "name", F.floor(F.col("idx") / F.lit(chunk)).cast("int").alias("chunk"))
    vals = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return g.agg(F.transform(vals, lambda x: x["value"]).alias("values"))


def parameters_to_numpy(rows: DataFrame, layers, input_shape) -> dict:
    """Gather ``(layer, name, chunk|idx, values|value)`` rows into arrays on the
    driver (the model is small and bounded by the layer list)."""
    specs = {(l, n): s for l, n, s, _ in param_specs(layers, input_shape)}
    pdf = rows.toPandas()
    out = {}
    if "values" in pdf.columns:
        for (l, n), g in pdf.groupby(["layer", "name"]):
            g = g.sort_values("chunk")
            out[(int(l), n)] = np.concatenate([np.asarray(v, dtype=np.float64) for v in g["values"]]) \
                .reshape(specs[(int(l), n)])
    else:
        for (l, n), g in pdf.groupby(["layer", "name"]):
            g = g.sort_values("idx")
            out[(int(l), n)] = g["value"].to_numpy(np.float64).reshape(specs[(int(l), n)])
    return out


def parameters_to_rows(params: dict, chunk: int = 1 << 16) -> list[tuple]:
    """Arrays to ``(layer, name, chunk, values)`` tuples of at most ``chunk`` values."""
    rows = []
    for (l, n), a in sorted(params.items()):
        flat = np.asarray(a, dtype=np.float64).ravel()
        for c in range(0, max(1, len(flat)), chunk):
            rows.append((int(l), n, c // chunk, flat[c:c + chunk].tolist()))
    return rows


# --- numpy kernels ----------------------------------------------------------------

def _windows(x: np.ndarray, k: int) -> np.ndarray:
    """(B, H, W, C) -> (B * (H-k+1) * (W-k+1), k * k * C), a row per k x k
    window; a window's lines stay whole, so they are copied in runs of k * C."""
    x = np.ascontiguousarray(x)
    B, H, W, C = x.shape
    s = x.strides
    view = np.lib.stride_tricks.as_strided(
        x, shape=(B, H - k + 1, W - k + 1, k, k * C),
        strides=(s[0], s[1], s[2], s[1], s[3]), writeable=False)
    return view.reshape(-1, k * k * C)


def _kernels(W: np.ndarray) -> np.ndarray:
    """Conv weights (F, C, k, k) as (F, k * k * C), in the order of ``_windows``."""
    return W.transpose(0, 2, 3, 1).reshape(W.shape[0], -1)


# windows are made for as many pictures at a time as keep them within this size
WINDOW_BYTES = 16 << 20


def _blocks(x: np.ndarray, k: int) -> list[slice]:
    B, H, W, C = x.shape
    per = max(1, WINDOW_BYTES // max(1, (H - k + 1) * (W - k + 1) * k * k * C * x.itemsize))
    return [slice(lo, lo + per) for lo in range(0, B, per)]


def conv_forward(x: np.ndarray, W: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(B, H, W, C) * (F, C, k, k) + b -> (B, H-k+1, W-k+1, F)."""
    k, kernels = W.shape[2], _kernels(W).T
    out = np.empty((x.shape[0], x.shape[1] - k + 1, x.shape[2] - k + 1, W.shape[0]), np.result_type(x, W, b))
    for part in _blocks(x, k):
        np.add((_windows(x[part], k) @ kernels).reshape(out[part].shape), b, out=out[part])
    return out


def conv_backward(x, W, dy, inputs: bool = True):
    """Gradients of the input (None without ``inputs``), the weights and the biases."""
    F_, C, k, _ = W.shape
    B, Ho, Wo = dy.shape[:3]
    dW, kernels = np.zeros((F_, k * k * C), np.result_type(x, dy)), _kernels(W)
    dx = np.zeros_like(x) if inputs else None
    for part in _blocks(x, k):
        dyf = dy[part].reshape(-1, F_)
        dW += dyf.T @ _windows(x[part], k)
        if inputs:
            dcols = (dyf @ kernels).reshape(-1, Ho, Wo, k, k, C)
            for i in range(k):
                for j in range(k):
                    dx[part, i:i + Ho, j:j + Wo, :] += dcols[:, :, :, i, j, :]
    return dx, dW.reshape(F_, k, k, C).transpose(0, 3, 1, 2), dy.reshape(B * Ho * Wo, -1).sum(axis=0)


def _cells(x: np.ndarray, k: int) -> list[np.ndarray]:
    """The k * k places of all whole k x k cells, each as (B, H//k, W//k, C), in row order."""
    Ho, Wo = x.shape[1] // k, x.shape[2] // k
    return [x[:, i:Ho * k:k, j:Wo * k:k, :] for i in range(k) for j in range(k)]


def pool_forward(x: np.ndarray, k: int = 2) -> np.ndarray:
    """Max over k x k cells, stride k; trailing rows/columns are dropped."""
    first, *rest = _cells(x, k)
    out = first.copy()
    for place in rest:
        np.maximum(out, place, out=out)
    return out


def pool_backward(x, y, dy, k=2):
    dx = np.zeros_like(x)
    free = np.ones(y.shape, dtype=bool)
    # the first maximum of a cell takes the gradient
    for place, d in zip(_cells(x, k), _cells(dx, k)):
        hit = free & (place == y)
        d[...] = np.where(hit, dy, 0)
        free &= ~hit
    return dx


def leaky(x):
    return np.maximum(x, LEAKY_SLOPE * x)


def leaky_grad(z):
    return np.where(z > 0, z.dtype.type(1), z.dtype.type(LEAKY_SLOPE))


def softmax_rows(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def forward(params: dict, layers, input_shape, x: np.ndarray, keep: bool = False, dtype=np.float64):
    """Forward pass of a batch of flat images; returns probabilities (and the
    per-layer cache when ``keep``)."""
    h, w, c = input_shape
    a = x.reshape(-1, h, w, c).astype(dtype)
    cache = []
    for i, L in enumerate(layers):
        t = L["type"]
        if t == "conv":
            z = conv_forward(a, params[(i, "W")], params[(i, "b")])
            cache.append((a, z))
            a = leaky(z)
        elif t == "pool":
            y = pool_forward(a, L.get("k", 2))
            cache.append((a, y))
            a = y
        else:
            a2 = a.reshape(a.shape[0], -1)
            z = a2 @ params[(i, "W")].T + params[(i, "b")]
            cache.append((a2, z))
            a = softmax_rows(z) if t == "output" else leaky(z)
    return (a, cache) if keep else a


def backward(params, layers, cache, probs, onehot, l2: float = 0.0) -> dict:
    """Gradients of mean cross-entropy (+ l2/2 * |W|^2) for one batch."""
    B = probs.shape[0]
    grads = {}
    d = (probs - onehot) / B
    for i in range(len(layers) - 1, -1, -1):
        t = layers[i]["type"]
        a_in, z = cache[i]
        if t in ("dense", "output"):
            if t == "dense":
                d = d.reshape(z.shape) * leaky_grad(z)
            grads[(i, "W")] = d.T @ a_in + l2 * params[(i, "W")]
            grads[(i, "b")] = d.sum(axis=0)
            d = d @ params[(i, "W")]
            d = d.reshape(a_in.shape)
        elif t == "pool":
            d = pool_backward(a_in, z, d.reshape(z.shape), layers[i].get("k", 2))
        else:
            d = d.reshape(z.shape) * leaky_grad(z)
            dx, dW, db = conv_backward(a_in, params[(i, "W")], d, inputs=i > 0)
            grads[(i, "W")] = dW + l2 * params[(i, "W")]
            grads[(i, "b")] = db
            d = dx
    return grads


# --- Spark operators ------------------------------------------------------------------

def slices(it: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into pieces of at most ``rows`` rows (bounds the
    memory of the numpy work in a task)."""
    for pdf in it:
        for start in range(0, len(pdf), rows):
            yield pdf.iloc[start:start + rows]


def _vectors(pdf: pd.DataFrame, col: str) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in pdf[col]]) if len(pdf) else np.zeros((0, 0))


SCORE_BATCH = 128


def apply_layers(df: DataFrame, layers, params: dict, input_shape, features: str = "features",
                 id_col: str = "id", out: str = "values", activation: bool = True,
                 batch: int = SCORE_BATCH, keep: tuple[str, ...] = ()) -> DataFrame:
    """N1-N3 (and N7 for a whole network): run ``layers`` on every row, in
    Arrow batches on the executors, ``batch`` rows at a time (bounds the
    activation memory of a task).  With ``activation=False`` the last layer's
    pre-activation is returned (a bare convolution or dense layer)."""
    spark = df.sparkSession
    bc = spark.sparkContext.broadcast({k: np.asarray(v, dtype=np.float64) for k, v in params.items()})
    h, w, c = input_shape

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = bc.value
        for pdf in slices(it, batch):
            x = _vectors(pdf, features).reshape(-1, h, w, c)
            a = x
            for i, L in enumerate(layers):
                t = L["type"]
                last = i == len(layers) - 1
                if t == "conv":
                    z = conv_forward(a, p[(i, "W")], p[(i, "b")])
                    a = z if (last and not activation) else leaky(z)
                elif t == "pool":
                    a = pool_forward(a, L.get("k", 2))
                else:
                    z = a.reshape(a.shape[0], -1) @ p[(i, "W")].T + p[(i, "b")]
                    if last and not activation:
                        a = z
                    else:
                        a = softmax_rows(z) if t == "output" else leaky(z)
            flat = a.reshape(a.shape[0], -1)
            res = {id_col: pdf[id_col].to_numpy()}
            for k in keep:
                res[k] = pdf[k].to_numpy()
            res[out] = list(flat)
            yield pd.DataFrame(res)

    schema = T.StructType([df.schema[id_col], *[df.schema[k] for k in keep],
                           T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select(id_col, *keep, features).mapInPandas(run, schema)


def score(df: DataFrame, layers, params: dict, input_shape, features: str = "features",
          id_col: str = "id", keep: tuple[str, ...] = (), batch: int = SCORE_BATCH) -> DataFrame:
    """Probabilities and predicted class of every row (``keep`` columns
    are carried through)."""
    probs = apply_layers(df, layers, params, input_shape, features, id_col, out="probs", batch=batch, keep=keep)
    return probs.withColumn("predicted", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
