"""Monitor: an nvidia-smi CSV log turned into a utilisation and memory series
(P9-P12, W3-W6, L1, L2, A6).

Input rows are ``(line_no, value)``; ``line_no`` orders the file.  The step
rule reads the log from its end (see ``steps``); here it is evaluated with
running counts instead of a backwards loop:

* ``blk``: headers at or before a line (its block), ``d``: data lines at or
  before it, both bucketed prefix sums (no single-task window).
* ``r``: data lines after it in its block, ``end_d(blk) - d``, from a grouped
  maximum joined back on ``blk``.
* ``N`` (devices): size of the last non-empty block that has a header above it.
* a chunk ``r div N`` is a step when it is full and something precedes it.
* the last ``max_history + 1`` steps are a top-k of the distinct steps.

``steps_by_log`` applies the same rule to a table of many logs, with no driver
action per log: N by a grouped maximum, the last steps by a grouped top-k of
blocks (a block's number of steps follows from its size and N).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import (
    GPU_TOTAL_MEMORY_MIB, is_header, memory_percent, parse_gpu_mem, parse_gpu_util,
)
from tessera.operators.ordering import running_totals, written

MAX_HISTORY = 500
RESAMPLE_POINTS = 300
# Lines per prefix-sum bucket (in line_no units).
LINE_BUCKET = 1 << 20
# Lines of the log's end that are looked at first, and by how much more each time.
TAIL_LINES, WIDER = 1 << 16, 16


def drop_headers(log: DataFrame) -> DataFrame:
    """Keep data lines only."""
    return log.filter(~is_header("value"))


def parse_lines(lines: DataFrame, total_mib: int = GPU_TOTAL_MEMORY_MIB, strict: bool = True) -> DataFrame:
    """``util``, ``mem_mib`` and ``mem_pct`` of data lines.

    With ``strict`` a malformed line raises, naming the line and its number;
    otherwise ``bad`` marks it.
    """
    util, mem = parse_gpu_util("value"), parse_gpu_mem("value")
    bad = util.isNull() | mem.isNull()
    err = F.raise_error(F.concat(F.lit("line: "), F.col("value"),
                                 F.lit(" line_number: "), F.col("line_no").cast("string")))
    if strict:
        util = F.when(bad, err.cast("int")).otherwise(util)
    out = lines.withColumn("util", util).withColumn("mem_mib", mem)
    out = out.withColumn("mem_pct", memory_percent("mem_mib", total_mib))
    return out if strict else out.withColumn("bad", bad)


def _blocks(log: DataFrame, bucket: int, group: tuple[str, ...] = ()) -> DataFrame:
    hdr = is_header("value")
    d = log.withColumn("__h", hdr.cast("int")).withColumn("__d", (~hdr).cast("int"))
    d = d.withColumn("__lb", F.floor(F.col("line_no") / F.lit(bucket)))
    d = running_totals(d, {"blk": "__h", "d": "__d"}, ["__lb"], ["line_no"], group)
    return d.filter(F.col("__d") == 1).drop("__h", "__d", "__lb")


def steps(log: DataFrame, max_history: int = MAX_HISTORY, bucket: int = LINE_BUCKET,
          total_mib: int = GPU_TOTAL_MEMORY_MIB, tail: int = TAIL_LINES) -> tuple[DataFrame, int]:
    """``(step, gpu, util, mem_pct, line_no)`` for the last
    ``max_history + 1`` steps, steps numbered 0.. in time order.

    Returns the frame and the device count N (0 when the log has no step).
    Only the end of the log is numbered and parsed: its last ``tail`` lines
    from their first header on, or more where they hold too few steps.  What
    begins with a header has the same blocks as the whole log, so the result
    does not depend on ``tail``.
    """
    lo, hi = log.agg(F.min("line_no"), F.max("line_no")).first()
    while True:
        whole = lo is None or tail > hi - lo
        part = log if whole else log.filter(F.col("line_no") > F.lit(hi - tail))
        header = None if whole else part.filter(is_header("value")).agg(F.min("line_no")).first()[0]
        if whole or header is not None:
            out, n, kept = _steps_of(part if whole else part.filter(F.col("line_no") >= F.lit(header)), max_history, bucket, total_mib)
            if whole or kept == max_history + 1:
                return out, n
        tail *= WIDER


def _steps_of(log: DataFrame, max_history: int, bucket: int, total_mib: int) -> tuple[DataFrame, int, int]:
    """The steps of a log, N, and the number of steps kept.

    Data lines are numbered and parsed once (written to the shared folder); three small results
    reach the driver: N, the kept steps (at most ``max_history + 1`` rows)
    and the first malformed line, if any.
    """
    spark = log.sparkSession
    data = written(parse_lines(_blocks(log, bucket), total_mib, strict=False))
    blocks = data.groupBy("blk").agg(F.max("d").alias("end_d"), F.count(F.lit(1)).alias("size"))
    last = blocks.filter(F.col("blk") > 0).orderBy(F.col("blk").desc()).select("size").limit(1).collect()
    empty = spark.createDataFrame([], "step bigint, gpu int, util int, mem_pct int, line_no bigint")
    if not last:
        _raise_bad(data)
        return empty, 0, 0
    n = int(last[0]["size"])
    lines = lines_for(data, blocks, n)
    # L1: top-k of the distinct steps, newest first; at most max_history + 1 rows.
    kept = (lines.groupBy("blk", "chunk").agg(F.min("line_no").alias("first_line"))
            .orderBy(F.col("blk").desc(), F.col("chunk").asc()).limit(max_history + 1).collect())
    if not kept:
        _raise_bad(data)
        return empty, n, 0
    kept = sorted(kept, key=lambda r: (r["blk"], -r["chunk"]))
    if len(kept) == max_history + 1:
        # The backwards scan reads one line past the kept window, the one that
        # completes its last step, and parses it unless it is a header.
        first = data.filter((F.col("line_no") < F.lit(kept[0]["first_line"])) & (F.col("blk") == F.lit(kept[0]["blk"]))) \
            .agg(F.max("line_no")).first()[0]
        _raise_bad(data.filter(F.col("line_no") >= F.lit(kept[0]["first_line"] if first is None else first)))
    else:
        _raise_bad(data)
    numbered = spark.createDataFrame([(r["blk"], r["chunk"], i) for i, r in enumerate(kept)],
                                     "blk bigint, chunk bigint, step bigint")
    # Every kept line lies at or after the first kept step: cut both sides of
    # the block join to that tail before joining.
    tail = lines_for(data.filter(F.col("line_no") >= F.lit(kept[0]["first_line"])),
                     blocks.filter(F.col("blk") >= F.lit(kept[0]["blk"])), n)
    out = tail.join(F.broadcast(numbered), ["blk", "chunk"])
    out = out.select("step", (F.lit(n - 1) - F.col("r") % F.lit(n)).cast("int").alias("gpu"),
                     "util", "mem_pct", "line_no")
    return out, n, len(kept)


def lines_for(data: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Data lines with ``r`` and ``chunk``, kept when their chunk is a step."""
    lines = data.join(blocks, "blk").withColumn("r", F.col("end_d") - F.col("d"))
    lines = lines.withColumn("chunk", F.floor(F.col("r") / F.lit(n)).cast("bigint"))
    full = (F.col("chunk") + 1) * F.lit(n) <= F.col("size")
    preceded = (F.col("blk") > 0) | (F.col("size") > (F.col("chunk") + 1) * F.lit(n))
    return lines.filter(full & preceded)


def _raise_bad(parsed: DataFrame) -> None:
    """P12 for a whole log: stop at the malformed line nearest the end."""
    bad = parsed.filter("bad").select("line_no", "value").orderBy(F.col("line_no").desc()).limit(1).collect()
    if bad:
        raise ValueError(f"line: {bad[0]['value']} line_number: {bad[0]['line_no']}")


def steps_by_log(logs: DataFrame, log_col: str = "log", max_history: int = MAX_HISTORY, bucket: int = LINE_BUCKET,
                 total_mib: int = GPU_TOTAL_MEMORY_MIB) -> tuple[DataFrame, DataFrame]:
    """W3, W4, L1, L2 for many logs: ``(steps, malformed)``.

    ``logs`` has ``log_col``, line_no and value.  Steps are as in ``steps``,
    with the log and its device count ``n``; a log without a step gives no row.
    Malformed is one row ``(log, line_no, value)`` for each log whose parsed
    lines hold a malformed one, the one nearest its end; such a log has no
    steps.  Parsed are the lines of the kept steps and the data line before
    them in their block, or all lines where fewer steps exist.  Lines with a
    null log are a log of their own.
    """
    d = logs.select(F.struct(F.col(f"`{log_col}`").alias("log")).alias("__log"), "line_no", "value")
    data = parse_lines(_blocks(d, bucket, ("__log",)), total_mib, strict=False)
    blocks = data.groupBy("__log", "blk").agg(F.max("d").alias("end_d"), F.count(F.lit(1)).alias("size"))
    devices = blocks.filter(F.col("blk") > 0).groupBy("__log").agg(F.max_by("size", "blk").alias("n"))
    counted = blocks.join(devices, "__log")
    whole = F.when(F.col("blk") > 0, F.col("size")).otherwise(F.col("size") - 1)
    counted = counted.withColumn("chunks", F.floor(whole / F.col("n")).cast("bigint")).filter(F.col("chunks") > 0)
    # at most max_history + 1 blocks of a log hold its kept steps
    newest = Window.partitionBy("__log").orderBy(F.col("blk").desc())
    late = counted.withColumn("__at", F.row_number().over(newest)).filter(F.col("__at") <= max_history + 1).drop("__at")
    after = F.coalesce(F.sum("chunks").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = late.withColumn("after", after).filter(F.col("after") <= max_history)
    late = late.withColumn("used", F.least("chunks", F.lit(max_history + 1) - F.col("after")))
    # the oldest kept block tells how many steps are kept, and where parsing begins
    ends = late.groupBy("__log").agg(F.max(F.col("after") + F.col("used")).alias("kept"),
                                     F.min_by(F.struct("end_d", "used", "size"), "blk").alias("first"), F.max("n").alias("n"))
    from_d = F.col("first.end_d") - F.least(F.col("first.used") * F.col("n"), F.col("first.size") - 1)
    ends = ends.select("__log", "kept", F.when(F.col("kept") == max_history + 1, from_d).alias("from_d"))
    malformed = (data.filter("bad").join(ends, "__log", "left").filter(F.col("from_d").isNull() | (F.col("d") >= F.col("from_d")))
                 .groupBy("__log").agg(F.max(F.struct("line_no", "value")).alias("last")))
    lines = (data.join(late, ["__log", "blk"]).withColumn("r", F.col("end_d") - F.col("d"))
             .withColumn("chunk", F.floor(F.col("r") / F.col("n")).cast("bigint")).filter(F.col("chunk") < F.col("used")))
    out = lines.join(ends.select("__log", "kept"), "__log").join(malformed.select("__log"), "__log", "left_anti")
    out = out.select(F.col("__log.log").alias(log_col), "n", (F.col("kept") - 1 - F.col("after") - F.col("chunk")).alias("step"),
                     (F.col("n") - 1 - F.col("r") % F.col("n")).cast("int").alias("gpu"), "util", "mem_pct", "line_no")
    return out, malformed.select(F.col("__log.log").alias(log_col), "last.line_no", "last.value")


def gpu_means(steps_df: DataFrame, *log: str) -> DataFrame:
    """Mean utilisation and memory percent per device (of each log), half-even to 1 place."""
    return steps_df.groupBy(*log, "gpu").agg(
        F.bround(F.avg("util"), 1).alias("util_avg"),
        F.bround(F.avg("mem_pct"), 1).alias("mem_avg"))


def flatten_series(steps_df: DataFrame, n_gpus: int) -> DataFrame:
    """One series ``x = step * N + gpu`` (step-major), x = 0..n-1."""
    return steps_df.select((F.col("step") * F.lit(n_gpus) + F.col("gpu")).alias("x"), "util", "mem_pct")


def resample(series: DataFrame, points: int = RESAMPLE_POINTS, x: str = "x",
             ys: tuple[str, ...] = ("util", "mem_pct")) -> DataFrame:
    """``points`` evenly spaced samples from the first to the last x,
    piecewise linear between neighbours.

    ``x`` must be consecutive integers (as ``flatten_series`` gives), so the
    left neighbour of grid point ``xi`` is ``floor(xi)``: two equi-joins of a
    ``points``-row grid, no window over the series.
    """
    spark = series.sparkSession
    b = series.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if b["lo"] is None:
        return spark.createDataFrame([], "i bigint, x double, " + ", ".join(f"{y} double" for y in ys))
    lo, hi = float(b["lo"]), float(b["hi"])
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    grid = spark.range(points).select(
        F.col("id").alias("i"),
        F.when(F.col("id") == points - 1, F.lit(hi)).otherwise(F.col("id") * F.lit(step) + F.lit(lo)).alias("gx"))
    grid = grid.withColumn("x0", F.floor("gx").cast("bigint"))
    s = series.select(F.col(x).cast("bigint").alias("__x"), *[F.col(y).cast("double").alias(y) for y in ys])
    # Only the series rows next to a grid point are needed: at most 2 * points
    # keys, broadcast; the series side is streamed.
    keys = grid.select(F.col("x0").alias("__x")).union(grid.select((F.col("x0") + 1).alias("__x"))).distinct()
    near = s.join(F.broadcast(keys), "__x")
    left = near.select(F.col("__x").alias("x0"), *[F.col(y).alias(f"{y}_0") for y in ys])
    right = near.select((F.col("__x") - 1).alias("x0"), *[F.col(y).alias(f"{y}_1") for y in ys])
    j = grid.join(left, "x0", "left").join(right, "x0", "left")
    frac = F.col("gx") - F.col("x0")
    cols = [F.round(F.col(f"{y}_0") + frac * (F.coalesce(F.col(f"{y}_1"), F.col(f"{y}_0")) - F.col(f"{y}_0")), 6)
            .alias(y) for y in ys]
    return j.select("i", F.round("gx", 6).alias("x"), *cols)
