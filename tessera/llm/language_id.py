"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is the average embedding of its hashed byte n-grams; a linear layer and
a softmax give the languages.  Embeddings and layer are trained by stochastic
gradient descent in numpy on a bounded sample: at most ``PER_LANG`` labelled
documents of each language, the first ones in hash order of their ids.  The
model is linear after averaging, so embedding and layer fold into one table of
(buckets x languages) numbers, which is all the executors get.

Confidence is calibrated on documents that training did not see: a temperature
makes their mean score what their accuracy promises.  A softmax knows only the
learned languages, so a second number tells whether a text is written in any:
its familiarity, the mean log-probability of its n-grams under the n-gram counts
of the language it is taken for.  A document is rejected when

* its text has no letter,
* no language has the majority of the probability, or
* its familiarity lies more than ``LOOSE`` times as far below the median of
  those documents as the ALPHA quantile does.  So fewer than about ALPHA of
  documents like the labelled ones go, and what lies far below all of them does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tessera.llm.common import materialise
from tessera.llm.textarrays import slices

#: Sample bounds: labelled documents per language, and languages.
PER_LANG, LANGS = 1000, 200
GRAMS, BITS, DIM = (2, 3, 4), 15, 16
#: At least so many passes over the sample and so many steps in all.
EPOCHS, STEPS, RATE, BATCH = 6, 800, 20.0, 32
#: Share of the held documents that lies below the quantile, and how much further off a rejected text is.
ALPHA, LOOSE = 0.005, 2.0
#: A text is rejected when no language has so much of the probability.
MAJORITY = 0.5
#: Added to each bucket's share of a language's n-grams, in parts of an even share.
SMOOTH = 0.02
#: Bytes looked at together in a task.
LONG = 1 << 20

_FOLD = np.full(256, 32, np.uint8)  # what isn't a letter in ASCII ends a word
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # (buckets + 1) x languages; the last row is zero
    bias: np.ndarray
    temperature: float
    logs: np.ndarray  # (buckets + 1) x languages: log-probabilities of n-grams; the last row is zero
    familiar: float  # least familiarity

    def probabilities(self, sums: np.ndarray, grams: np.ndarray) -> np.ndarray:
        z = (sums / np.maximum(grams, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _buckets(data: np.ndarray, offsets: np.ndarray):
    """Bucket of the n-gram at every byte, for each size; 2**BITS where there is none.

    An n-gram lies in one text and has a letter; every text starts and ends with a space.
    """
    text = _FOLD[data].astype(np.uint32)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes up to the text's end
    code, letters = text.copy(), text != 32
    for g in range(2, max(GRAMS) + 1):
        code = code[:-1] * np.uint32(0x01000193) + text[g - 1:] if len(code) else code
        letters = letters[:-1] | (text[g - 1:] != 32) if len(letters) else letters
        if g in GRAMS:
            h = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
            out = np.full(len(data), 1 << BITS, np.int64)
            out[:len(h)] = np.where(letters & (left[:len(h)] >= g), h, 1 << BITS)
            yield out


def _parts(data: np.ndarray, offsets: np.ndarray):
    """Pieces of LONG bytes of a single long text, each with the bytes its last n-grams need; else all at once."""
    if len(offsets) > 2 or len(data) <= LONG:
        yield data, offsets
        return
    for a in range(0, len(data), LONG):
        part = data[a:a + LONG + max(GRAMS) - 1]
        yield part, np.array([0, len(part)])


def _counts(batches):
    """Each sampled text's buckets and counts."""
    for batch in batches:
        found = []
        for _, data, off in slices(batch.column("text"), LONG):
            grams = list(_buckets(data, off))
            for a, b in zip(off[:-1], off[1:], strict=True):
                n = sum(np.bincount(g[a:b], minlength=(1 << BITS) + 1) for g in grams)[:-1]
                at = np.flatnonzero(n)
                found.append((at.astype("<i4").tobytes(), n[at].astype("<i4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())],
            names=["lang", "buckets", "counts"])


def _train(rows: list, langs: tuple[str, ...], seed: int) -> Model:
    rng = np.random.default_rng(seed)
    xs = [(np.frombuffer(r.buckets, "<i4"), np.frombuffer(r.counts, "<i4")) for r in rows]
    ys = np.array([langs.index(r.lang) for r in rows])
    keep = [i for i, x in enumerate(xs) if len(x[0])]
    order = rng.permutation(keep)
    held = order[: max(1, len(order) // 5)] if len(order) > 4 else order
    seen = order[len(held):] if len(order) > 4 else order
    emb = rng.normal(0, 0.1, (1 << BITS, DIM))
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))

    def joined(ids):
        at = np.concatenate([xs[i][0] for i in ids])
        weight = np.concatenate([xs[i][1] / xs[i][1].sum() for i in ids])
        n = np.array([len(xs[i][0]) for i in ids])
        return at, weight, np.concatenate([[0], np.cumsum(n)[:-1]]), n

    def logits(ids):
        at, weight, first, _ = joined(ids)
        return np.add.reduceat(emb[at] * weight[:, None], first) @ out + bias

    each = max(1, -(-len(seen) // BATCH))
    epochs = max(EPOCHS, -(-STEPS // each))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(seen), each):
            if not len(part):
                continue
            rate = RATE * (1 - step / steps)
            step += 1
            at, weight, first, n = joined(part)
            mean = np.add.reduceat(emb[at] * weight[:, None], first)
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), ys[part]] -= 1
            p /= len(part)
            back = np.repeat(p @ out.T, n, axis=0) * weight[:, None]
            out -= rate / 20 * (mean.T @ p)
            bias -= rate / 100 * p.sum(axis=0)
            used, where = np.unique(at, return_inverse=True)
            emb[used] -= rate * np.stack([np.bincount(where, back[:, k], len(used)) for k in range(DIM)], axis=1)
    z, y = np.vstack([logits(held[a:a + BATCH]) for a in range(0, len(held), BATCH)]), ys[held]
    shares = np.zeros((1 << BITS, len(langs)))
    for i in seen:
        shares[xs[i][0], ys[i]] += xs[i][1] / xs[i][1].sum()  # every document counts as much
    shares = shares / np.maximum(shares.sum(axis=0), 1e-9) + SMOOTH / (1 << BITS)
    logs = np.vstack([np.log(shares / (1 + SMOOTH)), np.zeros(len(langs))]).astype(np.float32)
    told = z.argmax(axis=1)
    known = np.sort([float((logs[xs[i][0], k] * xs[i][1]).sum() / xs[i][1].sum()) for i, k in zip(held, told, strict=True)])
    median = float(np.median(known))
    familiar = median - LOOSE * (median - float(known[int(ALPHA * len(known))]))
    table = np.vstack([emb @ out, np.zeros(len(langs))]).astype(np.float32)
    return Model(langs, table, bias, calibrated(z, y), logs, familiar)


def calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature at which the mean score is (right + 1) / (n + 2), the accuracy that n documents promise."""
    promised = (float((z.argmax(axis=1) == y).sum()) + 1) / (len(y) + 2)
    lo, hi = 1e-4, 1e4  # the mean score falls as the temperature rises
    for _ in range(60):
        t = float(np.sqrt(lo * hi))
        s = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        lo, hi = (t, hi) if float((1 / s.sum(axis=1)).mean()) > promised else (lo, t)
    return float(np.sqrt(lo * hi))


def _spaced(text: str):
    return F.concat(F.lit(" "), F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(" "))


def _drawn(rows: DataFrame, per_lang: int, seed: int) -> DataFrame:
    """``(id, lang, rank)`` of each language's first ``per_lang`` rows in the order of a hash of their ids.

    Rows whose hash is far beyond the language's limit, as its count tells, are
    left out before any row is moved; where that leaves a language too few (ids
    that repeat share a hash), nothing is left out.
    """
    rows = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    limits = counts.select("lang", F.least(F.col("rows"), F.lit(per_lang)).alias("wanted"),
                           (F.lit(float(1 << 53)) * (2 * per_lang + 100) / F.col("rows")).alias("limit"))
    limits = materialise(limits, "limits")
    cut = rows.join(limits, "lang").where(F.col("draw") < F.col("limit"))
    left = limits.join(cut.groupBy("lang").agg(F.count(F.lit(1)).alias("left")), "lang", "left")
    few = left.where(F.coalesce("left", F.lit(0)) < F.col("wanted")).limit(1).count()
    order = Window.partitionBy("lang").orderBy("draw", "id")
    return (rows if few else cut).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang).select("id", "lang", "rank")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = PER_LANG, seed: int = 11) -> Model | None:
    """Train on a sample of ``labelled``; rows without text, language or id are not used.

    Returns None when no row is left.  Rows of one id that repeat may all be drawn.
    """
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    drawn = _drawn(rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")), per_lang, seed)
    ids = drawn.orderBy("rank", "lang").limit(per_lang * LANGS).select("id").distinct()
    sample = (rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), _spaced(text_col).alias("text"))
              .join(F.broadcast(ids), "id", "left_semi").select("lang", "text"))  # at most per_lang * LANGS ids
    found = sample.mapInArrow(_counts, "lang string, buckets binary, counts binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r.lang, bytes(r.buckets), bytes(r.counts)))
    return _train(found, tuple(sorted({r.lang for r in found})), seed)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all) with lang_pred, score and rejected.

    A null text or one without letters is ``und`` with score 0 and rejected;
    without a model every text is.  Columns of these names are replaced.  The
    whole text counts, in pieces of a bounded size.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "rejected")]
    # numbered, as names may hold dots or clash
    d = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], _spaced(text_col).alias("spaced"),
                    F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    schema = StructType([StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)] + [
        StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches):
        columns = [np.ascontiguousarray(model.table[:, k]) for k in range(len(model.langs))] if model else []
        logs = [np.ascontiguousarray(model.logs[:, k]) for k in range(len(model.langs))] if model else []
        for batch in batches:
            n = batch.num_rows
            said = np.zeros(n, bool) if model is None else batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            best, score, familiar = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if model is not None:
                for a, data, off in slices(batch.column("spaced"), LONG):
                    rows = len(off) - 1
                    sums, known, grams = np.zeros((rows, len(model.langs))), np.zeros((rows, len(model.langs))), np.zeros(rows)
                    for part, first in _parts(data, off):
                        for b in _buckets(part, first):
                            b = b[:LONG] if rows == 1 else b
                            grams += np.add.reduceat((b < 1 << BITS).astype(np.int32), first[:-1])
                            for k in range(len(model.langs)):
                                sums[:, k] += np.add.reduceat(columns[k][b], first[:-1], dtype=np.float64)
                                known[:, k] += np.add.reduceat(logs[k][b], first[:-1], dtype=np.float64)
                    p = model.probabilities(sums, grams)
                    told = p.argmax(axis=1)
                    best[a:a + rows], score[a:a + rows] = told, p.max(axis=1)
                    familiar[a:a + rows] = known[np.arange(rows), told] / np.maximum(grams, 1)
            score = np.where(said, score, 0.0)
            names = np.array([*(model.langs if model else ()), "und"], object)
            lang = names[np.where(said, best, len(names) - 1)]
            low = ~said | (score < MAJORITY) | (familiar < (model.familiar if model else 1.0))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f"k{i}") for i in range(len(keep))], pa.array(lang, pa.string()), pa.array(score), pa.array(low)],
                names=[*[f"k{i}" for i in range(len(keep))], "lang_pred", "score", "rejected"])

    return d.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score", "rejected")
