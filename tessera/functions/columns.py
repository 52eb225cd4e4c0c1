"""Scalar column functions used by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image file extensions the image listing accepts (the image
# loader's allowed formats, both cases).
ALLOWED_IMAGE_EXTENSIONS = (
    "bmp", "gif", "jpg", "jpeg", "jp2", "pbm", "pgm", "ppm", "pnm", "png", "tif", "tiff",
    "exr", "webp",
    "BMP", "GIF", "JPG", "JPEG", "JP2", "PBM", "PGM", "PPM", "PNM", "PNG", "TIF", "TIFF",
    "EXR", "WEBP",
)

# GPU log conventions.
GPU_HEADER_PREFIX = "util"
GPU_TOTAL_MEMORY_MIB = 4037
# Fixed value: milliseconds to minutes as printed by the timing report.
MS_TO_MINUTES = 1.6666666666667e-5

EXTENSION_PATTERN = r"\.([^./]*)$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- record extraction (P1-P3) -------------------------------------------------

def first_picture(imgs="imgs", field: str = "picture") -> Column:
    """``picture`` of the first element of the nested list.

    An empty or missing list is an error, as in a strict ``list.get(0)``.
    """
    arr = _c(imgs)
    return F.when(
        F.coalesce(F.size(arr), F.lit(-1)) < 1,
        F.raise_error(F.lit("record without pictures")),
    ).otherwise(F.get(arr, 0)[field])


def picture_name(id_col="_id", suffix: str = ".jpg") -> Column:
    """File name ``<id>.jpg``, from the id as the record has it."""
    return F.concat(_c(id_col).cast("string"), F.lit(suffix))


def parse_int_strict(col, what: str = "value") -> Column:
    """Parse to int (sign and digits); NULL and anything else raises, like parseInt."""
    s = _c(col).cast("string")
    parsed = F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("int"))
    return F.when(
        parsed.isNull(),
        F.raise_error(F.concat(F.lit(f"not an integer {what}: "), F.coalesce(s, F.lit("NULL")))),
    ).otherwise(parsed)


# --- labels and features (P4-P7) ----------------------------------------------

def label_from_path(path="path") -> Column:
    """The label is the name of the parent folder; NULL for a path without one."""
    return F.try_element_at(F.split(_c(path), "/"), F.lit(-2))


def has_extension(path="path", extensions=ALLOWED_IMAGE_EXTENSIONS) -> Column:
    """S2 predicate: the file extension is one of ``extensions``."""
    return F.regexp_extract(_c(path), EXTENSION_PATTERN, 1).isin(list(extensions))


def one_hot(label="label", k: int = 2) -> Column:
    """One-hot vector of length ``k``; a label outside 0..k-1 raises."""
    lab = _c(label)
    vec = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                      lambda i: F.when(i == lab, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when((lab < 0) | (lab >= k) | lab.isNull(),
                  F.raise_error(F.concat(F.lit("label out of range: "), lab.cast("string")))
                  ).otherwise(vec)


def scale_pixels(pixels="pixels", lo: float = 0.0, hi: float = 1.0, max_value: float = 255.0) -> Column:
    """Map 0..max_value to [lo, hi]."""
    if lo == 0.0 and hi == 1.0:
        return F.transform(_c(pixels), lambda x: x / F.lit(float(max_value)))
    return F.transform(_c(pixels),
                       lambda x: x / F.lit(float(max_value)) * F.lit(hi - lo) + F.lit(lo))


# --- GPU log lines (P9-P12) ---------------------------------------------------

def is_header(value="value") -> Column:
    """Header lines start with ``util``."""
    return _c(value).startswith(GPU_HEADER_PREFIX)


def _field(value, i: int, unit: str) -> Column:
    part = F.get(F.split(_c(value), ","), i)
    return F.replace(F.trim(part), F.lit(unit), F.lit("")).try_cast("int")


def parse_gpu_util(value="value") -> Column:
    """P10: ``NN %`` before the first comma, as int (NULL when malformed)."""
    return _field(value, 0, " %")


def parse_gpu_mem(value="value") -> Column:
    """P10: ``MMM MiB`` after the first comma, as int (NULL when malformed)."""
    return _field(value, 1, " MiB")


def memory_percent(mem_mib="mem_mib", total_mib: int = GPU_TOTAL_MEMORY_MIB) -> Column:
    """Used memory as a whole percent of ``total_mib``, truncated."""
    return (_c(mem_mib) / F.lit(total_mib) * F.lit(100)).cast("int")


# --- time (P13) ---------------------------------------------------------------

def ms_to_minutes(ms="ms") -> Column:
    """Milliseconds to minutes with the report's factor."""
    return _c(ms) * F.lit(MS_TO_MINUTES)


def epoch_ms(ts="ts", ntz: bool = True) -> Column:
    """Whole milliseconds since the epoch (microseconds integer-divided by 1000)."""
    if ntz:
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})") \
            if isinstance(ts, str) else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
    else:
        micros = F.unix_micros(_c(ts))
    return F.floor(micros / F.lit(1000)).cast("bigint")


# --- network output functions (N4-N6, T6) -------------------------------------

def leaky_relu(values="values", alpha: float = 0.01) -> Column:
    """``x`` if positive else ``alpha * x`` (as double)."""
    return F.transform(_c(values), lambda x: F.when(x > 0, x.cast("double"))
                       .otherwise(F.lit(alpha) * x.cast("double")))


def _max_and_sum(values) -> Column:
    """Struct (m, s) of one fold: the running maximum and the sum of ``exp(x - m)``.

    Where a larger value turns up, the sum so far is scaled down to it, so no
    value is visited twice and nothing overflows.
    """
    def step(acc, x):
        x = x.cast("double")
        rises = x > acc["m"]
        return F.struct(F.when(rises, x).otherwise(acc["m"]).alias("m"),
                        F.when(rises, acc["s"] * F.exp(acc["m"] - x) + F.lit(1.0))
                        .otherwise(acc["s"] + F.exp(x - acc["m"])).alias("s"))
    start = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))
    return F.aggregate(_c(values), start, step)


def _bound(expr: Column, use) -> Column:
    """``use(expr)`` with ``expr`` evaluated once a row, also inside lambdas of ``use``."""
    return F.get(F.transform(F.array(expr), use), F.lit(0))


def softmax(values="values") -> Column:
    """``exp(x - max) / sum(exp(x - max))``, linear in the vector's length.

    An empty vector stays empty; a null value makes all values null.
    """
    return _bound(_max_and_sum(values), lambda f: F.transform(
        _c(values), lambda x: F.exp(x.cast("double") - f["m"]) / f["s"]))


def mcxent_logits(values="values", label="label") -> Column:
    """T6 from logits: ``ln sum exp(x) - x[label]``, without the probabilities in between."""
    x = F.element_at(_c(values), _c(label) + 1).cast("double")
    return _bound(_max_and_sum(values), lambda f: F.ln(f["s"]) + (f["m"] - x))


def predict_index(probs="probs") -> Column:
    """Index of the largest value (first one on ties)."""
    p = _c(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def mcxent(probs="probs", label="label") -> Column:
    """Cross-entropy ``-ln p[label]`` of one row."""
    return -F.ln(F.element_at(_c(probs), _c(label) + 1).cast("double"))


def round_array(values, digits: int = 6) -> Column:
    """Values rounded to ``digits``; what rounds to zero is 0.0, never -0.0."""
    return F.transform(_c(values), lambda x: F.round(x.cast("double"), digits) + F.lit(0.0))
