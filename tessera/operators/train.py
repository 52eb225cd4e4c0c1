"""Training by synchronous parameter averaging, and its reports
(T1-T4, A9, A10, A11, J1)."""

from __future__ import annotations

import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import ms_to_minutes, softmax
from tessera.functions.hashing import DEFAULT_SEED, hash32, seeded_md5
from tessera.operators import nn
from tessera.operators.asof import asof_join
from tessera.operators.ordering import rank_in_groups
from tessera.sources.fs import filesystem

# Learning-rate steps (iteration -> rate) of the two programs.
LR_SCHEDULE_CPU = [(0, 0.01), (100, 0.008), (200, 0.005), (300, 0.003)]
LR_SCHEDULE_GPU = [(0, 0.003), (40, 0.001), (80, 0.0005), (100, 0.0001)]
BASE_LR_CPU = 0.01
BASE_LR_GPU = 0.003
L2 = 0.0005
AVERAGING_FREQUENCY = 3
EPOCHS = 1


def schedule_frame(spark, schedule) -> DataFrame:
    return spark.createDataFrame([(int(a), float(b)) for a, b in schedule], "from_iter bigint, lr double")


def lookup_lr(df: DataFrame, schedule: DataFrame, iteration: str = "iteration", out: str = "lr",
              base_lr: float | None = None) -> DataFrame:
    """As-of lookup, the rate of the latest step at or before the iteration.

    Before the first step ``base_lr`` applies.  Schedule and rows may be of any
    size (see ``asof.asof_join``).
    """
    joined = asof_join(df, schedule.select("from_iter", F.col("lr").alias(out)), iteration, [out], right_on="from_iter")
    return joined if base_lr is None else joined.withColumn(out, F.coalesce(out, F.lit(base_lr)))


def lr_at(iteration, schedule, base_lr: float | None = None):
    """J1 as a column for a literal schedule (no join at all)."""
    it = F.col(iteration) if isinstance(iteration, str) else iteration
    expr = F.lit(base_lr) if base_lr is not None else F.lit(None).cast("double")
    for frm, lr in sorted(schedule):
        expr = F.when(it >= F.lit(frm), F.lit(lr)).otherwise(expr)
    return expr


def average_parameters(params: DataFrame, by=("layer", "name", "chunk"), values: str = "values",
                       worker: str = "worker", weighted: bool = False, weight: str = "n") -> DataFrame:
    """Element-wise mean of the workers' parameter chunks.

    ``weighted`` weighs each worker's chunk by its column ``weight`` (the rows
    it has seen, say; not negative, and not 0 for all workers).  Uses the ML
    ``Summarizer`` mean, an aggregate with map-side partial merging, so each
    chunk is reduced on executors however many workers there are; only the
    means leave.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    w = F.col(weight).cast("double") if weighted else F.lit(1.0)
    v = params.select(*by, array_to_vector(values).alias("__v"), w.alias("__w"))
    return v.groupBy(*by).agg(Summarizer.mean(F.col("__v"), F.col("__w")).alias("__m")) \
        .select(*by, vector_to_array("__m").alias(values))


def timing_report(samples: DataFrame, epoch: str = "epoch", begin: str = "begin_ms",
                  end: str = "end_ms") -> DataFrame:
    """A10: per epoch ``(epoch, begin_ms, end_ms, ms, minutes)`` plus the
    total row (``epoch`` NULL) by rollup."""
    r = samples.rollup(epoch).agg(F.min(begin).alias("begin_ms"), F.max(end).alias("end_ms"))
    r = r.withColumn("ms", F.col("end_ms") - F.col("begin_ms"))
    return r.withColumn("minutes", ms_to_minutes("ms"))


def epochs_from_days(times: DataFrame, day: str = "day", ms: str = "ms") -> DataFrame:
    """Epoch = day number from the first day; begin/end = first/last ms of it.
    The per-day aggregate is small, so its window is cheap."""
    per = times.groupBy(day).agg(F.min(ms).alias("begin_ms"), F.max(ms).alias("end_ms"))
    first = F.min(day).over(Window.partitionBy())
    return per.select(F.datediff(F.col(day), first).alias("epoch"), "begin_ms", "end_ms")


# --- T1: synchronous parameter averaging ----------------------------------------

CHUNK = 1 << 16
ADAM_B1, ADAM_B2, ADAM_EPS = 0.9, 0.999, 1e-8

_STATS_SCHEMA = "worker int, iteration bigint, score double, n bigint"
# a score per worker and iteration, and the averaged state in pieces of at most
# CHUNK float64 values that begin at ``at``
_FIT_SCHEMA = pa.schema([("kind", pa.string()), ("worker", pa.int32()), ("iteration", pa.int64()), ("score", pa.float64()),
                         ("n", pa.int64()), ("at", pa.int64()), ("values", pa.binary())])
_FIT_TYPES = "kind string, worker int, iteration bigint, score double, n bigint, at bigint, values binary"


def _flat(arrays: dict) -> np.ndarray:
    """The arrays of a model as one vector, in key order."""
    return np.concatenate([np.asarray(arrays[k], dtype=np.float64).ravel() for k in sorted(arrays)])


def _views(flat: np.ndarray, shapes: dict) -> dict:
    """The arrays of a model as views of its vector."""
    out, at = {}, 0
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = flat[at:at + n].reshape(shapes[k])
        at += n
    return out


class Exchange:
    """Vectors handed from task to task of a barrier stage, as files of a folder that all can reach.

    A file counts once it has its full size.  (The calls of ``BarrierTaskContext``
    look for an answer once a second, too seldom for rounds of milliseconds.)
    """

    def __init__(self, folder: str, dtype, longest_pause: float = 0.02):
        self.fs, self.folder = filesystem(folder)
        self.dtype, self.longest_pause = np.dtype(dtype), longest_pause
        self.fs.create_dir(self.folder, recursive=True)

    def put(self, name: str, values: np.ndarray) -> None:
        with self.fs.open_output_stream(f"{self.folder}/{name}") as f:
            f.write(np.ascontiguousarray(values, dtype=self.dtype))

    def wait(self, names: list[str], sizes: list[int]) -> None:
        """Until every named vector is there, whole."""
        pause, left = 0.0005, {f"{self.folder}/{n}": s * self.dtype.itemsize for n, s in zip(names, sizes, strict=True)}
        while left := {i.path: left[i.path] for i in self.fs.get_file_info(list(left)) if i.size != left[i.path]}:
            time.sleep(pause)
            pause = min(2 * pause, self.longest_pause)

    def get(self, name: str, lo: int, hi: int) -> np.ndarray:
        with self.fs.open_input_file(f"{self.folder}/{name}") as f:
            return np.frombuffer(f.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), dtype=self.dtype)

    def drop(self, name: str) -> None:
        self.fs.delete_file(f"{self.folder}/{name}")


def task_slots(spark) -> int:
    """Tasks that run at the same time, as Spark counts them for a barrier stage."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def _lr_for(iteration: int, schedule, base_lr: float) -> float:
    lr = base_lr
    for frm, v in sorted(schedule or []):
        if iteration >= frm:
            lr = v
    return lr


def assign_rounds(samples: DataFrame, workers: int, batch: int, frequency: int, epoch: int,
                  seed: int = DEFAULT_SEED, id_col: str = "id") -> DataFrame:
    """Round structure of one epoch: ``worker = hash(seed, epoch, id) mod W``;
    inside a worker rows go in md5 order (ranked in hash sub-buckets); round
    r takes rows ``[r*f*b, (r+1)*f*b)``, mini-batch ``mb`` of b rows each."""
    d = samples.withColumn("worker", (hash32(seed, F.lit(epoch), id_col) % workers).cast("int"))
    d = d.withColumn("__md5", seeded_md5(seed, F.lit("order"), F.lit(epoch), id_col))
    d = rank_in_groups(d, ["worker"], "__md5", [id_col], out="wrn").drop("__md5")
    per_round = frequency * batch
    return (d.withColumn("round", F.floor((F.col("wrn") - 1) / per_round).cast("bigint"))
             .withColumn("mb", F.floor(((F.col("wrn") - 1) % per_round) / batch).cast("int")))


def train(samples: DataFrame, layers, input_shape, batch: int = 20,
          averaging_frequency: int = AVERAGING_FREQUENCY, epochs: int = EPOCHS,
          lr_schedule=LR_SCHEDULE_CPU, base_lr: float = BASE_LR_CPU, l2: float = L2,
          seed: int = DEFAULT_SEED, workers: int | None = None, updater: str = "adam",
          params: dict | None = None, features: str = "features", onehot: str = "onehot",
          id_col: str = "id", stage_dir: str | None = None,
          dtype: str = "float32") -> tuple[dict, DataFrame]:
    """Fit by synchronous parameter averaging.

    Each round every worker starts from the shared parameters (and updater
    state), fits ``averaging_frequency`` mini-batches, and the parameters and
    Adam moments are averaged (A9) over the workers that had rows.  Rows of an
    epoch are staged once as Parquet in the shared folder (cutting lineage) and
    an epoch is one job: a barrier stage whose tasks hold the workers, read
    their rows in round order and average among themselves (see
    ``_epoch_fn``), so a round costs its mini-batches and no Spark job.
    Returns the final parameters and the per-iteration, per-worker scores.

    ``workers`` defaults to the cluster's default parallelism (one worker per
    task slot); where slots are fewer, a task holds several workers.  Worker
    fits compute in ``dtype`` (single precision by default, as the reference
    library does); parameters and moments are averaged in double precision.
    """
    from tessera.session import shared_path

    spark = samples.sparkSession
    if workers is None:
        workers = max(1, spark.sparkContext.defaultParallelism)
    if params is None:
        p_rows = nn.init_parameter_chunks(spark, layers, input_shape, seed, CHUNK)
        params = nn.parameters_to_numpy(p_rows, layers, input_shape)
    shapes = {k: np.shape(v) for k, v in params.items()}
    flat = _flat(params)
    n_params = len(flat)
    if updater == "adam":
        flat = np.concatenate([flat, np.zeros(2 * n_params)])  # parameters, first and second moments
    base = stage_dir or shared_path(spark, "train")
    iteration = 0
    fitted = []
    rows = samples.select(id_col, features, onehot)
    if dtype == "float32":  # as the fits would cast them, in half the bytes
        rows = rows.withColumn(features, F.transform(features, lambda x: x.cast("float")))
    for epoch in range(epochs):
        staged_path = f"{base}/epoch={epoch}"
        (assign_rounds(rows, workers, batch, averaging_frequency, epoch, seed, id_col)
         .select("round", "worker", "mb", "wrn", features, onehot).write.mode("overwrite").parquet(staged_path))
        staged = spark.read.parquet(staged_path)
        counts = {r["worker"]: r["count"] for r in staged.groupBy("worker").count().collect()}
        if not counts:
            continue
        tasks = min(workers, task_slots(spark))
        bc = spark.sparkContext.broadcast(flat)
        run = _epoch_fn(bc, counts, tasks, f"{base}/exchange", iteration, shapes, layers, input_shape, features, onehot,
                        batch, averaging_frequency, l2, lr_schedule, base_lr, updater, dtype)
        fitted.append(f"{base}/fitted/epoch={epoch}")
        (staged.repartitionById(tasks, F.col("worker") % tasks).sortWithinPartitions("round", "worker", "mb", "wrn")
         .mapInArrow(run, _FIT_TYPES, barrier=True).write.mode("overwrite").parquet(fitted[-1]))
        state = spark.read.parquet(fitted[-1]).filter("kind = 'state'").select("at", "values").toPandas().sort_values("at")
        flat = np.concatenate([np.frombuffer(v, dtype=np.float64) for v in state["values"]])
        bc.unpersist()
        iteration += averaging_frequency * -(-max(counts.values()) // (averaging_frequency * batch))
    params = {k: v.copy() for k, v in _views(flat[:n_params], shapes).items()}
    if not fitted:  # no round ran
        return params, spark.createDataFrame([], _STATS_SCHEMA)
    stats = spark.read.parquet(*fitted).filter("kind = 'stat'").select("worker", "iteration", "score", "n")
    return params, stats


def _matrix(column: pa.Array, dt) -> np.ndarray:
    """A list column as a matrix; rows without a list or of other lengths raise."""
    if column.null_count or len(set(np.diff(column.offsets.to_numpy()))) > 1:
        raise ValueError("samples need arrays of one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dt)


def _minibatches(batches, features: str, onehot: str, dt):
    """``((round, worker, mb), x, y)`` of sorted Arrow batches; a mini-batch may lie in two of them."""
    key, xs, ys = None, [], []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("round", "worker", "mb")], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            k = tuple(keys[lo].tolist())
            if k != key and xs:
                yield key, np.concatenate(xs), np.concatenate(ys)
                xs, ys = [], []
            key = k
            xs.append(_matrix(b.column(features).slice(lo, hi - lo), dt))
            ys.append(_matrix(b.column(onehot).slice(lo, hi - lo), dt))
    if xs:
        yield key, np.concatenate(xs), np.concatenate(ys)


def _epoch_fn(bc, counts, tasks, folder, first_iteration, shapes, layers, input_shape, features, onehot, batch, frequency,
              l2, lr_schedule, base_lr, updater, dtype):
    """All rounds of an epoch, run by the tasks of a barrier stage; worker w is
    held by task ``w mod tasks``.

    The state (parameters, then Adam moments) is one vector, and every task
    averages one slice of it.  In a round a worker fits its mini-batches from
    the shared state and hands its new state on; a task takes its slice of all
    workers' states, in their order and in double precision, hands the mean on,
    and joins the tasks' slices to the next shared state.  A task holds a state
    of its own, the shared one and a slice, however many workers there are.
    """
    per_round = frequency * batch

    def fit(state, minibatches, key, it):
        """One mini-batch, in place."""
        found, x, y = next(minibatches)
        if found != key:
            raise RuntimeError(f"mini-batch {found} where {key} is due")
        n = sum(int(np.prod(s)) for s in shapes.values())
        p = _views(state[:n], shapes)
        probs, cache = nn.forward(p, layers, input_shape, x, keep=True, dtype=state.dtype)
        loss = float(-np.mean(np.sum(y * np.log(np.clip(probs, np.finfo(state.dtype).tiny, None)), axis=1)))
        grads = nn.backward(p, layers, cache, probs, y, l2=l2)
        g = np.concatenate([grads[k].ravel() for k in sorted(shapes)])
        lr = _lr_for(it, lr_schedule, base_lr)
        if updater == "adam":
            m, v = state[n:2 * n], state[2 * n:]
            m[:] = ADAM_B1 * m + (1 - ADAM_B1) * g
            v[:] = ADAM_B2 * v + (1 - ADAM_B2) * g ** 2
            mh = m / (1 - ADAM_B1 ** (it + 1))
            vh = v / (1 - ADAM_B2 ** (it + 1))
            state[:n] -= lr * mh / (np.sqrt(vh) + ADAM_EPS)
        else:
            state[:n] -= lr * g
        return loss, len(x)

    def run(batches):
        dt = np.dtype(dtype)
        ctx = BarrierTaskContext.get()
        task = ctx.partitionId()
        # a folder for this attempt of the stage
        ex = Exchange(f"{folder}/{ctx.allGather(uuid.uuid4().hex)[0]}", dt)
        shared = bc.value.astype(dt)
        cuts = [len(shared) * t // tasks for t in range(tasks + 1)]
        lo, hi = cuts[task], cuts[task + 1]
        minibatches = _minibatches(batches, features, onehot, dt)
        rounds = -(-max(counts.values()) // per_round)
        for r in range(rounds):
            active = [w for w in sorted(counts) if counts[w] > r * per_round]
            own, stats = [w for w in active if w % tasks == task], []
            for w in own:
                state = shared.copy()
                for mb in range(-(-min(per_round, counts[w] - r * per_round) // batch)):
                    it = first_iteration + r * frequency + mb
                    stats.append(("stat", w, it, *fit(state, minibatches, (r, w, mb), it), None, None))
                ex.put(f"worker-{w}-{r}", state)
            if stats:
                yield _fit_rows(stats)
            ex.wait([f"worker-{w}-{r}" for w in active], [len(shared)] * len(active))
            mean = np.zeros(hi - lo)
            for w in active:
                mean += ex.get(f"worker-{w}-{r}", lo, hi)
            mean /= len(active)
            ex.put(f"slice-{task}-{r}", mean)
            ex.wait([f"slice-{t}-{r}" for t in range(tasks)], np.diff(cuts).tolist())
            shared = np.concatenate([ex.get(f"slice-{t}-{r}", 0, cuts[t + 1] - cuts[t]) for t in range(tasks)])
            # all slices of this round are there, so all tasks have read its states and the slices before it
            for w in own:
                ex.drop(f"worker-{w}-{r}")
            if r:
                ex.drop(f"slice-{task}-{r - 1}")
        if next(minibatches, None) is not None:
            raise RuntimeError("rows are left after the last round")
        for c in range(0, hi - lo, CHUNK):
            yield _fit_rows([("state", None, None, None, None, lo + c, mean[c:c + CHUNK].tobytes())])

    return run


def _fit_rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_FIT_SCHEMA.names, row)) for row in rows], schema=_FIT_SCHEMA)


def evaluate_model(test: DataFrame, layers, params: dict, input_shape, features: str = "features",
                   label: str = "label", id_col: str = "id", eval_batch: int = 128) -> DataFrame:
    """Score held-out rows (N7) and return ``(actual, predicted)`` for A7/A8;
    the label rides through the scoring step, so no join is needed.  A row costs
    a pass through the network, so rows are dealt evenly to all task slots
    however few files they come from."""
    rows = test.select(id_col, F.col(label).alias("actual"), features).repartition(task_slots(test.sparkSession))
    scored = nn.score(rows, layers, params,
                      input_shape, features, id_col, keep=("actual",), batch=eval_batch)
    return scored.select("actual", "predicted")


# --- softmax regression as aggregates (T1, T3) -------------------------------------

def softmax_regression_step(samples: DataFrame, params: DataFrame | None, n_features: int, n_classes: int,
                            lr: float, l2: float = 0.0, features: str = "features", label: str = "label") -> DataFrame:
    """One full-batch gradient step of softmax regression, as a frame
    ``(layer, name, idx, value)``: weights ``W`` at ``class * n_features + j``
    and biases ``b`` at ``class``.

    ``params`` is such a frame (None: zeros).  The model is one row, joined to
    every sample; errors are summed per feature with partial aggregation, so
    only model-sized rows are shuffled and nothing is collected.  ``l2`` decays
    the weights, not the biases.
    """
    ks = range(n_classes)
    if params is None:
        d = samples.select(F.col(label).alias("y"), F.col(features).alias("x"))
        z = [F.lit(0.0)] * n_classes
    else:
        def vector(name):
            rows = F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("idx", "value"))))
            return F.transform(rows, lambda r: r["value"])
        model = params.agg(vector("W").alias("w"), vector("b").alias("b"))
        d = samples.select(F.col(label).alias("y"), F.col(features).alias("x")).join(F.broadcast(model), F.lit(True))
        z = [F.aggregate(F.zip_with(F.slice("w", k * n_features + 1, n_features), "x", lambda a, v: a * v),
                         F.get("b", k), lambda a, v: a + v) for k in ks]
    d = d.select("y", "x", F.array(*z).alias("z"))
    d = d.select("y", "x", softmax("z").alias("p"))
    error = [F.get("p", k) - F.when(F.col("y") == k, 1.0).otherwise(0.0) for k in ks]
    d = d.select("x", F.array(*error).alias("e"))
    n = d.agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = (d.select("e", F.posexplode("x").alias("j", "v")).groupBy("j")
         .agg(F.array(*[F.sum(F.col("v") * F.get("e", k)) for k in ks]).alias("g"))
         .select(F.lit("W").alias("name"), "j", F.posexplode("g").alias("k", "g"))
         .select("name", (F.col("k") * n_features + F.col("j")).cast("bigint").alias("idx"), "g"))
    b = (d.agg(F.array(*[F.sum(F.get("e", k)) for k in ks]).alias("g"))
         .select(F.lit("b").alias("name"), F.posexplode("g").alias("idx", "g"))
         .select("name", F.col("idx").cast("bigint").alias("idx"), "g"))
    step = w.unionByName(b).join(F.broadcast(n), F.lit(True)).select("name", "idx", (F.col("g") / F.col("n")).alias("g"))
    if params is not None:
        step = step.join(params.select("name", "idx", F.col("value").alias("old")), ["name", "idx"])
    else:
        step = step.withColumn("old", F.lit(0.0))
    decay = F.when(F.col("name") == "W", F.lit(l2)).otherwise(0.0) * F.col("old")
    return step.select(F.lit(0).alias("layer"), "name", "idx", (F.col("old") - F.lit(lr) * (F.col("g") + decay)).alias("value"))
