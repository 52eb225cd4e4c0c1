"""

Every query takes ``(spark, sf_dir)``, reads the supplied tables through the
adapters, and returns a DataFrame whose column names match the oracle SQL in
``tessera.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import pixels as PX
from tessera.functions.columns import (
    has_extension, leaky_relu, mcxent_logits, one_hot, predict_index, round_array, scale_pixels, softmax,
)
from tessera.operators import augment as AUG
from tessera.operators.asof import asof_join
from tessera.operators import evaluate as EV
from tessera.operators import extract, gpulog, nn, prepare
from tessera.operators import rebalance as R
from tessera.operators.ordering import written
from tessera.operators import train as TR
from tessera.operators.timing import ProgramTimes
from tessera.plans import adapters as A
from tessera.plans.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


# --- extract --------------------------------------------------------------------

def _pictures(spark, sf_dir, overwrite=False):
    return extract.parse_records(A.records(spark, sf_dir, overwrite))


@query("extract_records")
def q_extract_records(spark, sf_dir):
    p = _pictures(spark, sf_dir)
    return p.select("_id", "category_id", "name", F.md5("picture").alias("picture_md5"), "pos")


@query("extract_totals")
def q_extract_totals(spark, sf_dir):
    return extract.totals(_pictures(spark, sf_dir))


@query("category_counts")
def q_category_counts(spark, sf_dir):
    return extract.category_counts(_pictures(spark, sf_dir))


@query("category_ids")
def q_category_ids(spark, sf_dir):
    return extract.category_ids(_pictures(spark, sf_dir))


@query("category_report")
def q_category_report(spark, sf_dir):
    return extract.report_lines(_pictures(spark, sf_dir))


@query("last_picture_per_id")
def q_last_picture_per_id(spark, sf_dir):
    last = extract.last_per_id(_pictures(spark, sf_dir, overwrite=True))
    return last.select("category_id", "_id", "name", F.md5("picture").alias("picture_md5"), "pos")


@query("extract_progress")
def q_extract_progress(spark, sf_dir):
    return extract.progress(_pictures(spark, sf_dir), every=1000)


# --- prepare --------------------------------------------------------------------


@query("label_from_path")
def q_label_from_path(spark, sf_dir):
    pages = A.page_paths(spark, sf_dir).select(F.lit("pages").alias("source"), "id", "path")
    files = (A.embedding_paths(spark, sf_dir).filter(has_extension("path"))
             .select(F.lit("embeddings").alias("source"), "id", "path"))
    both = pages.unionByName(files)
    return prepare.with_labels(both)


@query("index_labels")
def q_index_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return prepare.index_labels(part, "p_type").select("p_partkey", "p_type", "label_idx")


@query("index_many_labels")
def q_index_many_labels(spark, sf_dir):
    """P5 where nearly every row has a label of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("source", F.lit("")))).alias("label"))
    return prepare.index_labels(docs, "label")


@query("one_hot_labels")
def q_one_hot_labels(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return emb.select("vec_id", F.posexplode(one_hot("label", 10)).alias("idx", "value"))


@query("scale_pixels")
def q_scale_pixels(spark, sf_dir):
    return A.grey_pictures(spark, sf_dir).select("id", scale_pixels("pixels").alias("pixels"))


def _balanced(spark, sf_dir):
    return prepare.balance_classes(A.embedding_images(spark, sf_dir), "label", "id")


@query("balance_classes")
def q_balance_classes(spark, sf_dir):
    b, _ = _balanced(spark, sf_dir)
    return b.select("id", "label", "label_idx", "rn", "pos")


@query("train_test_split")
def q_train_test_split(spark, sf_dir):
    b, bal = _balanced(spark, sf_dir)
    return prepare.split_train_test(b, bal).select("id", "label", "pos", "split", "split_pos")


@query("assign_batches")
def q_assign_batches(spark, sf_dir):
    b, bal = _balanced(spark, sf_dir)
    s = prepare.assign_batches(prepare.split_train_test(b, bal), 20)
    return s.select("id", "split", "split_pos", "batch_id")


@query("min_max_scale")
def q_min_max_scale(spark, sf_dir):
    b, bal = _balanced(spark, sf_dir)
    s = written(prepare.split_train_test(b, bal).withColumnRenamed("pixels", "features"))
    stats = prepare.fit_min_max(s.filter(F.col("split") == "train"), "features")
    out = prepare.apply_min_max(s, stats, "features")
    return out.select("id", "split", round_array("features", 6).alias("features"))


@query("dataset_roundtrip")
def q_dataset_roundtrip(spark, sf_dir):
    from tessera.session import shared_path
    from tessera.sources.dataset import read_dataset, write_dataset
    samples, _ = prepare.prepare_samples(A.embedding_images(spark, sf_dir), batch=20)
    path = write_dataset(samples, shared_path(spark, "datasets"))
    return read_dataset(spark, path).select("id", "pos", "split", "split_pos", "batch_id", "label",
                                            "features", "onehot")


# --- monitor --------------------------------------------------------------------


@query("gpu_parse")
def q_gpu_parse(spark, sf_dir):
    lines = gpulog.drop_headers(A.gpu_log(spark, sf_dir))
    return gpulog.parse_lines(lines).select("line_no", "util", "mem_mib", "mem_pct")


def _steps(spark, sf_dir):
    return gpulog.steps(A.gpu_log(spark, sf_dir), max_history=500)


@query("gpu_steps")
def q_gpu_steps(spark, sf_dir):
    return _steps(spark, sf_dir)[0]


#: Steps kept of each user's log, few enough to cut some logs.
USER_HISTORY = 9


@query("gpu_steps_by_log")
def q_gpu_steps_by_log(spark, sf_dir):
    """W3, W4, L1 with P12 for a log per user: steps, or the malformed line of the log."""
    steps, bad = gpulog.steps_by_log(A.user_logs(spark, sf_dir), max_history=USER_HISTORY)
    return (steps.withColumn("malformed", F.lit(None).cast("string"))
            .unionByName(bad.select("log", "line_no", F.col("value").alias("malformed")), allowMissingColumns=True))


@query("gpu_means_by_log")
def q_gpu_means_by_log(spark, sf_dir):
    """A6 for a log per user, over whole logs."""
    steps, _ = gpulog.steps_by_log(A.user_logs(spark, sf_dir))
    return gpulog.gpu_means(steps, "log")


@query("gpu_means")
def q_gpu_means(spark, sf_dir):
    return gpulog.gpu_means(_steps(spark, sf_dir)[0])


@query("gpu_series")
def q_gpu_series(spark, sf_dir):
    st, n = _steps(spark, sf_dir)
    return gpulog.flatten_series(st, n)


@query("gpu_resample")
def q_gpu_resample(spark, sf_dir):
    st, n = _steps(spark, sf_dir)
    return gpulog.resample(gpulog.flatten_series(st, n), 300)


@query("read_gpu_log")
def q_read_gpu_log(spark, sf_dir):
    from tessera.session import shared_path
    from tessera.sources.textlog import read_gpu_log, write_lines
    path = write_lines(A.gpu_log(spark, sf_dir), shared_path(spark, "gpulog"))
    return read_gpu_log(spark, path)


# --- rebalance ------------------------------------------------------------------


REBALANCE_TARGET = 60


@query("class_deficits")
def q_class_deficits(spark, sf_dir):
    return R.class_deficits(A.class_images(spark, sf_dir), REBALANCE_TARGET)


@query("class_deficits_empty")
def q_class_deficits_empty(spark, sf_dir):
    """A4 with a list of classes: languages are classes without a picture."""
    docs = table(spark, sf_dir, "documents")
    labels = docs.select(F.col("source").alias("label")).union(docs.select("lang"))
    return R.class_deficits(A.class_images(spark, sf_dir), REBALANCE_TARGET, labels)


@query("cap_per_class")
def q_cap_per_class(spark, sf_dir):
    return R.cap_per_class(A.class_images(spark, sf_dir), REBALANCE_TARGET).select("label", "name", "rn")


#: Draws from each class of the query with one picture a class.
FEW_TARGET = 9_000


@query("draw_sources")
def q_draw_sources(spark, sf_dir):
    imgs = A.class_images(spark, sf_dir)
    return R.draw_sources(imgs, R.class_deficits(imgs, REBALANCE_TARGET))


@query("draw_from_few")
def q_draw_from_few(spark, sf_dir):
    """J2 from classes with few originals: one picture a language and source, each drawn thousands of times."""
    imgs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("doc_id").cast("string").alias("name")).withColumnRenamed("lang", "label")
    return R.draw_sources(imgs, R.class_deficits(imgs, FEW_TARGET))


@query("rebalance")
def q_rebalance(spark, sf_dir):
    return R.rebalance(A.class_images(spark, sf_dir), REBALANCE_TARGET)


@query("generation_report")
def q_generation_report(spark, sf_dir):
    return R.generation_report(R.rebalance(A.class_images(spark, sf_dir), REBALANCE_TARGET))


# --- pixels, layers and network outputs ---------------------------------------


def _images8(spark, sf_dir):
    return A.embedding_images(spark, sf_dir)


for _name, _fn in [("flip_left_right", PX.flip_left_right), ("flip_top_bottom", PX.flip_top_bottom),
                   ("rotate180", PX.rotate180), ("rotate270", PX.rotate270)]:
    def _make(fn):
        def q(spark, sf_dir):
            return _images8(spark, sf_dir).select("id", fn("pixels", 8, 8, 1).alias("pixels"))
        return q
    query(_name)(_make(_fn))

CONV_TEST = [{"type": "conv", "out": 2, "k": 3}]
POOL_TEST = [{"type": "pool", "k": 2}]
DENSE_TEST = [{"type": "dense", "out": 10}]
SCORE_TEST = [{"type": "conv", "out": 2, "k": 3}, {"type": "pool", "k": 2}, {"type": "output", "out": 2}]


def _layer_query(layers, activation):
    def q(spark, sf_dir):
        params = nn.formula_parameters(layers, (8, 8, 1))
        out = nn.apply_layers(_images8(spark, sf_dir), layers, params, (8, 8, 1), features="pixels",
                              activation=activation, out="out")
        return out.select("id", round_array("out", 6).alias("out"))
    return q


query("conv2d")(_layer_query(CONV_TEST, False))
query("max_pool")(_layer_query(POOL_TEST, False))
query("dense")(_layer_query(DENSE_TEST, False))


@query("score_network")
def q_score_network(spark, sf_dir):
    params = nn.formula_parameters(SCORE_TEST, (8, 8, 1))
    s = nn.score(_images8(spark, sf_dir), SCORE_TEST, params, (8, 8, 1), features="pixels")
    return s.select("id", round_array("probs", 6).alias("probs"), "predicted")


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").alias("z"))


@query("leaky_relu")
def q_leaky_relu(spark, sf_dir):
    return _logits(spark, sf_dir).select("id", round_array(leaky_relu("z"), 6).alias("out"))


@query("softmax")
def q_softmax(spark, sf_dir):
    return _logits(spark, sf_dir).select("id", round_array(softmax("z"), 6).alias("probs"))


@query("mcxent")
def q_mcxent(spark, sf_dir):
    lg = _logits(spark, sf_dir)
    return lg.select("id", "label", F.round(mcxent_logits("z", "label"), 6).alias("loss"))


@query("predict")
def q_predict(spark, sf_dir):
    return _logits(spark, sf_dir).select("id", predict_index("z").alias("predicted"))


# --- evaluation -------------------------------------------------------------------


def _predictions(spark, sf_dir):
    return (A.predictions_labels(spark, sf_dir).withColumn("source", F.lit("labels"))
            .unionByName(A.predictions_embeddings(spark, sf_dir).withColumn("source", F.lit("embeddings"))))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return EV.confusion_matrix(_predictions(spark, sf_dir), by=["source"])


@query("class_metrics")
def q_class_metrics(spark, sf_dir):
    per = EV.class_metrics(EV.confusion_matrix(_predictions(spark, sf_dir), by=["source"]), by=["source"])
    return per.select("source", "cls", "n_true", "n_pred", "tp",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    m = EV.classification_metrics(EV.confusion_matrix(_predictions(spark, sf_dir), by=["source"]), by=["source"])
    return m.select("source", *[F.round(c, 6).alias(c) for c in
                                ("accuracy", "macro_precision", "macro_recall", "macro_f1")], "n_classes", "n")


# --- training reports -----------------------------------------------------------


@query("lr_schedule")
def q_lr_schedule(spark, sf_dir):
    """Both programs' schedules by as-of join; the GPU's comes as a column too."""
    it = A.iterations(spark, sf_dir)
    cpu = TR.lookup_lr(it, TR.schedule_frame(spark, TR.LR_SCHEDULE_CPU), out="lr_cpu", base_lr=TR.BASE_LR_CPU)
    return cpu.withColumn("lr_gpu", TR.lr_at("iteration", TR.LR_SCHEDULE_GPU, TR.BASE_LR_GPU))


@query("asof_prices")
def q_asof_prices(spark, sf_dir):
    """J1 between two tables: each event meets the latest order of its group at or before it."""
    ev, steps = A.priced_events(spark, sf_dir), A.price_steps(spark, sf_dir)
    return asof_join(ev, steps, "at", ["order_id", "price"], by=["grp"], tie="order_id")


def _worker_chunks(spark, sf_dir):
    from tessera.functions.hashing import seeded_md5
    from tessera.operators.ordering import rank_in_groups
    emb = table(spark, sf_dir, "embeddings").withColumn("__md5", seeded_md5(12345, "vec_id"))
    ranked = rank_in_groups(emb, ["label"], "__md5", ["vec_id"], out="rn", size_col="n")
    return ranked.select(F.col("label").alias("worker"), F.lit(0).alias("layer"), F.lit("W").alias("name"),
                         (F.col("rn") - 1).alias("chunk"), "n",
                         F.transform("embedding", lambda x: x.cast("double")).alias("values"))


@query("average_parameters_weighted")
def q_average_parameters_weighted(spark, sf_dir):
    """A9 with each worker's row count as its weight."""
    avg = TR.average_parameters(_worker_chunks(spark, sf_dir), weighted=True)
    return avg.select("layer", "name", "chunk", round_array("values", 6).alias("vals"))


@query("average_parameters")
def q_average_parameters(spark, sf_dir):
    params = _worker_chunks(spark, sf_dir)
    avg = TR.average_parameters(params)
    return avg.select("layer", "name", "chunk", round_array("values", 6).alias("vals"))


@query("timing_report")
def q_timing_report(spark, sf_dir):
    return TR.timing_report(TR.epochs_from_days(A.event_times(spark, sf_dir)))


@query("program_times")
def q_program_times(spark, sf_dir):
    """A10: a program that extracts, balances, splits and takes a training step,
    with the times it recorded itself: one row a stage and a total row.  The
    times differ from run to run, so the columns tell whether they fit."""
    from tessera.session import shared_path
    run = ProgramTimes(spark, shared_path(spark, "times"), "classifier")
    base = shared_path(spark, "program")

    def stage(name, df):
        run.write(name, df, lambda d: d.write.parquet(f"{base}/{name}"))
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    stage("extract", _pictures(spark, sf_dir))
    samples, _ = prepare.prepare_samples(A.embedding_images(spark, sf_dir), n_classes=10, batch=20)
    samples = stage("prepare", samples).withColumn("features", F.transform("features", lambda x: x.cast("double")))
    with run.measure("training"):
        model = TR.softmax_regression_step(samples.filter("split = 'train'"), None, 64, 10, lr=0.5)
        stage("model", model)
    times = run.table()
    total = TR.timing_report(times, epoch="stage").join(times.select("stage", "seq", "rows", "first_ms", "last_ms"), "stage", "left")
    inside = (F.col("first_ms") >= F.col("begin_ms")) & (F.col("last_ms") <= F.col("end_ms")) & (F.col("first_ms") <= F.col("last_ms"))
    return total.select(F.coalesce("stage", F.lit("total")).alias("stage"), "rows", inside.alias("tasks_inside"),
                        (F.col("ms") == F.col("end_ms") - F.col("begin_ms")).alias("has_time"),
                        (F.abs(F.col("minutes") * 60000 - F.col("ms")) <= 1).alias("minutes_fit"))


@query("init_parameters")
def q_init_parameters(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    d = emb.agg(F.max(F.size("embedding")).alias("n_in"), F.countDistinct("label").alias("k")).first()
    layers = [{"type": "output", "out": int(d["k"])}]
    p = nn.init_parameters(spark, layers, (1, 1, int(d["n_in"])), seed=12345)
    return p.select("layer", "name", "idx", F.round("value", 6).alias("value"))


# --- training -------------------------------------------------------------------

SOFTMAX_LAYERS = [{"type": "output", "out": 10}]
SMALL_CNN = [{"type": "conv", "out": 4, "k": 3}, {"type": "pool", "k": 2},
             {"type": "dense", "out": 16}, {"type": "output", "out": 10}]


def _emb_samples(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label",
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return emb.withColumn("onehot", one_hot("label", 10))


def _rounded(params):
    return params.select("layer", "name", "idx", (F.round("value", 9) + 0.0).alias("value"))


@query("train_step")
def q_train_step(spark, sf_dir):
    return _rounded(TR.softmax_regression_step(_emb_samples(spark, sf_dir), None, 64, 10, lr=0.01))


@query("train_two_steps")
def q_train_two_steps(spark, sf_dir):
    """T1 with T3: two full-batch steps, weight decay in the second."""
    samples = _emb_samples(spark, sf_dir)
    one = TR.softmax_regression_step(samples, None, 64, 10, lr=0.5)
    return _rounded(TR.softmax_regression_step(samples, one, 64, 10, lr=0.5, l2=0.01))


def _train_query(layers, input_shape, workers):
    def q(spark, sf_dir):
        samples, _ = prepare.prepare_samples(A.embedding_images(spark, sf_dir), n_classes=10, batch=20)
        samples = samples.withColumn("features", F.transform("features", lambda x: x.cast("double")))
        train_rows = samples.filter(F.col("split") == "train")
        _, stats = TR.train(train_rows, layers, input_shape, batch=20, averaging_frequency=3, epochs=1,
                            workers=workers)
        return stats.select("worker", "iteration", F.round("score", 6).alias("score"), "n")
    return q


query("train_softmax")(_train_query(SOFTMAX_LAYERS, (1, 1, 64), 4))
query("train_cnn")(_train_query(SMALL_CNN, (8, 8, 1), 2))


# --- augmentation ---------------------------------------------------------------


@query("augment")
def q_augment(spark, sf_dir):
    return AUG.augment(_images8(spark, sf_dir), 8, 8, 1, keep=("label",))


# --- file sources -----------------------------------------------------------------

@query("read_bson")
def q_read_bson(spark, sf_dir):
    from tessera.session import shared_path
    from tessera.sources.bson import read_bson, write_bson
    path = write_bson(A.records(spark, sf_dir), shared_path(spark, "bson"))
    p = extract.parse_records(read_bson(spark, path))
    return p.select("_id", "category_id", "name", F.md5("picture").alias("picture_md5"), "pos")


@query("load_images")
def q_load_images(spark, sf_dir):
    from tessera.session import shared_path
    from tessera.sources.images import load_images, write_png_folders
    imgs = A.embedding_images(spark, sf_dir).select(
        "id", "label", F.transform("pixels", lambda x: F.floor((x + 1) * 127).cast("int")).alias("pixels"))
    path = write_png_folders(imgs, shared_path(spark, "images"), 8, 8)
    return load_images(spark, path, 32, 32, 3).select(
        F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("long").alias("id"), "label", "height", "width", "channels", "pixels")


@query("scan_images")
def q_scan_images(spark, sf_dir):
    """List the picture files that were written, one folder per label."""
    from tessera.session import shared_path
    from tessera.sources.images import scan_images, write_png_folders
    imgs = A.embedding_images(spark, sf_dir).select(
        "id", "label", F.transform("pixels", lambda x: F.floor((x + 1) * 127).cast("int")).alias("pixels"))
    files = scan_images(spark, write_png_folders(imgs, shared_path(spark, "images"), 8, 8))
    return files.select(F.substring_index("path", "/", -1).alias("name"), "label", (F.col("length") > 0).alias("filled"))


@query("picture_files")
def q_picture_files(spark, sf_dir):
    """The last picture of every id as a file of its category, read back."""
    from tessera.session import shared_path
    from tessera.sources.sinks import write_by_category
    last = extract.last_per_id(_pictures(spark, sf_dir, overwrite=True))
    path = write_by_category(last, shared_path(spark, "pictures"), fmt="files")
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return back.select(F.substring_index(F.substring_index("path", "/", -2), "/", 1).cast("int").alias("category_id"),
                       F.substring_index("path", "/", -1).alias("name"), F.md5("content").alias("picture_md5"))


@query("report_files")
def q_report_files(spark, sf_dir):
    """The three reports as text files, read back."""
    from tessera.session import shared_path
    from tessera.sources.sinks import write_report
    path = write_report(extract.report_lines(_pictures(spark, sf_dir)), shared_path(spark, "reports"))
    return spark.read.text(path).select("report", F.col("value").alias("line"))


# --- whole programs -----------------------------------------------------------------

# The steps that only move pixels, applied by draws (fixed values: op and probability).
EXACT_STEPS = [{"op": "flip_random", "p": 0.7}, {"op": "flip_left_right", "p": 0.5}, {"op": "flip_top_bottom", "p": 0.5},
               {"op": "rotate_random_90", "p": 0.9}, {"op": "rotate180", "p": 0.8}, {"op": "rotate270", "p": 0.6}]


@query("augment_exact")
def q_augment_exact(spark, sf_dir):
    """G1 with G2, G3, G4, G6, G7, G8, composed to one gather."""
    return AUG.augment(_images8(spark, sf_dir), 8, 8, 1, EXACT_STEPS, keep=("label",))


@query("rebalance_images_exact")
def q_rebalance_images_exact(spark, sf_dir):
    """U1 + G1 + S9 with the steps that only move pixels."""
    from tessera.session import shared_path
    from tessera.sources.sinks import write_rebalanced
    imgs = A.embedding_images(spark, sf_dir).select(
        F.col("label").cast("string").alias("label"), F.col("id").cast("string").alias("name"), "pixels")
    out = R.rebalance_images(imgs, 8, 8, 1, target=2 * REBALANCE_TARGET, steps=EXACT_STEPS)
    back = spark.read.schema(out.schema).parquet(write_rebalanced(out, shared_path(spark, "rebalanced")))
    return back.select("label", "name", "source", "generated", "pixels")


@query("rebalance_images")
def q_rebalance_images(spark, sf_dir):
    """U1 + G1 + S9: embeddings as 8x8 pictures per label rebalanced to 60,
    generated ones augmented, written one folder per class and read back."""
    from tessera.session import shared_path
    from tessera.sources.sinks import write_rebalanced
    imgs = A.embedding_images(spark, sf_dir).select(
        F.col("label").cast("string").alias("label"), F.col("id").cast("string").alias("name"), "pixels")
    out = R.rebalance_images(imgs, 8, 8, 1, target=REBALANCE_TARGET)
    back = spark.read.schema(out.schema).parquet(write_rebalanced(out, shared_path(spark, "rebalanced")))
    return back.select("label", "name", "source", "generated", "pixels")


@query("train_evaluate")
def q_train_evaluate(spark, sf_dir):
    """T1 -> N7 -> A7 -> A8: train on the balanced train split, score the
    test split, report the metrics."""
    samples, _ = prepare.prepare_samples(A.embedding_images(spark, sf_dir), n_classes=10, batch=20)
    samples = written(samples.withColumn("features", F.transform("features", lambda x: x.cast("double"))))
    params, _ = TR.train(samples.filter(F.col("split") == "train"), SOFTMAX_LAYERS, (1, 1, 64), batch=20,
                         averaging_frequency=3, epochs=1, workers=4)
    pred = TR.evaluate_model(samples.filter(F.col("split") == "test"), SOFTMAX_LAYERS, params, (1, 1, 64))
    m = EV.classification_metrics(EV.confusion_matrix(pred))
    return m.select(*[F.round(c, 6).alias(c) for c in
                      ("accuracy", "macro_precision", "macro_recall", "macro_f1")], "n_classes", "n")


@query("train_classifier")
def q_train_classifier(spark, sf_dir):
    """The image classifier program end to end: pictures written from the
    embeddings, decoded and resized to 32x32x3 (S3), scaled to [0,1] (P7),
    balanced, split and batched (B1 B2 W2), trained with the 11-layer network
    by parameter averaging (T1), scored (N7) and evaluated (A7 A8)."""
    from tessera.session import shared_path
    from tessera.sources.images import load_images, write_png_folders
    imgs = A.embedding_images(spark, sf_dir).select(
        "id", "label", F.transform("pixels", lambda x: F.floor((x + 1) * 127).cast("int")).alias("pixels"))
    path = write_png_folders(imgs, shared_path(spark, "classifier-images"), 8, 8)
    # decoded once: the balance counts its classes and cuts them in passes of their own
    pics = written(load_images(spark, path, 32, 32, 3).select(
        F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("long").alias("id"), "label", "pixels"))
    samples, bal = prepare.prepare_samples(pics, batch=20, scale=True)
    samples = written(samples)
    layers = nn.classifier_layers(bal.n_classes)
    params, _ = TR.train(samples.filter(F.col("split") == "train"), layers, (32, 32, 3), batch=20,
                         averaging_frequency=3, epochs=1, workers=8)
    pred = TR.evaluate_model(samples.filter(F.col("split") == "test"), layers, params, (32, 32, 3))
    m = EV.classification_metrics(EV.confusion_matrix(pred))
    return m.select(*[F.round(c, 6).alias(c) for c in
                      ("accuracy", "macro_precision", "macro_recall", "macro_f1")], "n_classes", "n")
