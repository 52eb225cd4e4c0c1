"""N-gram Jaccard join with adaptive multi-match prefixes, and its components.

Two texts link when their sets of word shingles have a Jaccard similarity of at
least ``percent`` / 100.  Shingles get one global order, rare ones first; of a
set of n, any partner shares one of the first n - need + 1, and at least l of
the first n - need + l.  Each document chooses its l: a longer prefix is looked
up more often, but asks for l shared shingles before its set is fetched and
compared.  The choice is the least estimated cost, from a table of approximate
shingle frequencies (a bounded count sketch over all documents).

Texts with equal sets become one node first.  Then, without listing all pairs
of a posting list:

1. star: every document of a list is paired with the list's leader, the one
   with the fewest rarer shingles; each document's best such pair is verified
   on the full sets;
2. rest: what is not yet in the component of its list's leader is paired with
   every document of another component in that list that sizes, positions and
   a 256-bit parity signature of the whole set allow, and verified.  Documents that
   share many shingles share most of them in a row, so a pair is made only where
   a run of shared shingles begins: where the listed shingles before the shared
   one differ.  Its first shared shingle is such a place, so no pair is lost; how
   many shingles the two prefixes share is then counted once a pair.

A pair that neither step looks at is in one component already, or shares too
few prefix shingles to be a link; so the components are exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialise
from tessera.llm.components import components
from tessera.llm.exact_dedup import decisions
from tessera.llm.textarrays import PIECE, lowered, mix, shingle_set, slices, words

#: Cells of the frequency sketch, and of one slice of it.
CELLS, SLICE = 1 << 20, 1 << 10
#: Longest adaptive prefix: so many shared shingles may be asked for.
MATCHES = 4
#: Bytes of sets that leave a task together.
BATCH_BYTES = 4 << 20
#: Cost of reading one posting and of fetching one candidate's set.
READ, FETCH = 1.0, 1.0


def _sets(column, size: int):
    """Sorted distinct shingles of every text of an Arrow column (each text ends with a space)."""
    for _, data, off in slices(column, PIECE):
        starts, _, hashes = words(lowered(data))
        cut = np.searchsorted(starts, off)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield shingle_set(hashes[a:b], size)


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) & np.uint64(CELLS - 1)).astype(np.int64)


def _ended(text_col: str):
    return F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit(" "))


def frequency_ranks(docs: DataFrame, size: int, text_col: str = "text") -> np.ndarray:
    """For each cell of the sketch, 4 * log2 of the number of documents' shingles in it.

    A task adds up one array of CELLS counts; slices of it are summed by
    another shuffle as they arrive.  The driver gets CELLS bytes.
    """
    def count(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for s in _sets(batch.column("text"), size):
                if len(s):
                    total[_cell(s)] += 1 if len(s) < 2 else 0
                    if len(s) > 1:
                        np.add.at(total, _cell(s), 1)
        total = total.reshape(-1, SLICE)
        used = np.flatnonzero(total.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 64)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([total[i].astype("<u4").tobytes() for i in part], pa.binary())], names=["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, "<u4").astype(np.int64)
        ranks = [np.floor(4 * np.log2(1 + v)).astype(np.uint8).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], names=["slice", "ranks"])

    parts = docs.select(_ended(text_col).alias("text")).mapInArrow(count, "slice int, counts binary")
    ranks = np.zeros((CELLS // SLICE, SLICE), np.uint8)
    for r in parts.repartition("slice").mapInArrow(add, "slice int, ranks binary").collect():  # CELLS / SLICE rows
        ranks[r["slice"]] = np.frombuffer(r.ranks, np.uint8)
    return ranks.reshape(-1)


def least_shared(n, percent: int):
    """Shingles that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def choose_prefix(ranks: np.ndarray, floor: float, percent: int) -> tuple[int, int]:
    """Prefix length and shared shingles asked for, of a set whose ranks are in global order."""
    n = len(ranks)
    need = least_shared(n, percent)
    most = min(MATCHES, need)
    lists = np.cumsum(np.maximum(2.0 ** (ranks[:n - need + most] / 4) - floor, 1.0))
    asked = np.arange(1, most + 1)
    length = n - need + asked
    read = lists[length - 1]
    best = int(np.argmin(READ * read + FETCH * read / asked))
    return int(length[best]), int(asked[best])


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """256 bits as four numbers: the parity of the shingles at each bit.

    Every shingle that only one of two sets has turns one bit, so their bits
    differ in no more places than the sets do.
    """
    turned = np.bincount((mix(shingles + np.uint64(1)) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(turned.astype(np.uint8)).view(np.int64)


def describe(docs: DataFrame, ranks: np.ndarray, size: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n (shingles), key (digest of the set; null if empty), asked, prefix, bits."""
    def run(batches):
        counts = 2.0 ** (ranks / 4)
        floor = float(counts.mean())
        for batch in batches:
            n, key, asked, prefix, bits = [], [], [], [], []
            for s in _sets(batch.column("text"), size):
                n.append(len(s)), bits.append(parity_bits(s))
                if not len(s):
                    key.append(None), asked.append(0), prefix.append([])
                    continue
                r = ranks[_cell(s)]
                order = np.argsort(r, kind="stable")  # s is sorted: ties by the shingle
                length, ell = choose_prefix(r[order], floor, percent)
                key.append(hashlib.md5(s.tobytes()).hexdigest())
                asked.append(ell), prefix.append(s[order[:length]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.string()), pa.array(asked, pa.int32()),
                 pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                names=["id", "n", "key", "asked", "prefix", "bits"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), _ended(text_col).alias("text")).mapInArrow(
        run, "id bigint, n bigint, key string, asked int, prefix array<bigint>, bits array<bigint>")


def _total(n, m, percent: int):
    """Shingles that sets of n and m share at least when they link."""
    return F.ceil((n + m) * percent / (100 + percent))


def _head(n, asked, percent: int):
    """Length of the shorter prefix that serves against partners of the same size or larger."""
    return n - _total(n, n, percent) + asked


def _may_link(p: str, q: str, percent: int):
    """Whether one shared prefix shingle of two postings (structs id, n, asked, pos) can be one of a link's.

    Sizes must fit; the shingle must be in the smaller one's shorter prefix;
    and shared shingles before and after its positions must be able to add up.
    """
    (i, n, a, at), (j, m, b, to) = ([F.col(f"{x}.{c}") for c in ("id", "n", "asked", "pos")] for x in (p, q))
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    inner = F.when((n < m) | ((n == m) & (i < j)), at < _head(n, a, percent)).otherwise(to < _head(m, b, percent))
    return fits & inner & (F.least(at, to) + 1 + F.least(n - at - 1, m - to - 1) >= _total(n, m, percent))


def _bits_allow(p: str, q: str, percent: int):
    """Whether the parity bits differ in no more places than two linked sets of these sizes can."""
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")
    differ = sum((F.bit_count(F.get(f"{p}_bits", k).bitwiseXOR(F.get(f"{q}_bits", k))) for k in range(4)), F.lit(0))
    return differ <= n + m - 2 * _total(n, m, percent)


def _enough(percent: int):
    """Whether the pair's counted shingles (columns shared; x, the smaller, and y: structs id, n, asked) suffice.

    Up to the smaller of the two prefixes' last shingles all shared ones were
    counted; beyond it there are at most as many as that set has left.
    """
    n, m = F.col("x.n"), F.col("y.n")
    beyond = F.greatest(n - _head(n, F.col("x.asked"), percent), F.ceil(m * percent / 100) - F.col("y.asked"))
    return F.col("shared") >= _total(n, m, percent) - beyond


def _pair(p: str, q: str):
    """``(x, y)`` of a pair of postings: structs n, id, asked, the smaller set first."""
    one, two = (F.struct(F.col(f"{c}.n").alias("n"), F.col(f"{c}.id").alias("id"), F.col(f"{c}.asked").alias("asked")) for c in (p, q))
    return F.least(one, two).alias("x"), F.greatest(one, two).alias("y")


def _star(joined: DataFrame, percent: int) -> DataFrame:
    """``(x, y, head, shared)`` of the candidate pairs of postings and their lists' leaders."""
    return (joined.where(_may_link("p", "leader", percent)).select(*_pair("p", "leader"), "head")
            .groupBy("x", "y", "head").agg(F.count(F.lit(1)).alias("shared")).where(_enough(percent)))


def _rest(of: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the candidate pairs between documents of one list and different components."""
    left = of.where("rest").select("token", F.col("p").alias("q"), F.col("p_bits").alias("q_bits"), F.col("before").alias("q_before"), F.col("component").alias("other"))
    begins = F.coalesce(F.col("before") != F.col("q_before"), F.lit(True))
    made = (left.join(of, "token").where((F.col("component") != F.col("other")) & (~F.col("rest") | (F.col("q.id") < F.col("p.id"))))
            .where(begins & _may_link("p", "q", percent) & _bits_allow("p", "q", percent)))
    pairs = materialise(made.select(*_pair("p", "q")).distinct(), "pairs")
    for c in ("x", "y"):
        own = nodes.select("id", F.col("prefix").alias(f"{c}_prefix"))
        pairs = pairs.join(own, F.col(f"{c}.id") == F.col("id")).drop("id")
    pairs = pairs.withColumn("head", _head(F.col("x.n"), F.col("x.asked"), percent).cast("int"))
    pairs = pairs.withColumn("shared", F.size(F.array_intersect(F.expr("slice(x_prefix, 1, head)"), F.col("y_prefix"))))
    return pairs.where(_enough(percent)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def fetch_sets(docs: DataFrame, ids: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, shingles)`` of the documents in ``ids``: the sorted set, eight bytes a shingle."""
    def made(ids, sets):
        return pa.RecordBatch.from_arrays([ids, pa.array(sets, pa.binary())], names=["id", "shingles"])

    def run(batches):
        for batch in batches:
            sets, first, held = [], 0, 0
            for i, s in enumerate(_sets(batch.column("text"), size), 1):
                sets.append(s.tobytes())
                held += len(sets[-1])
                if held > BATCH_BYTES or i == batch.num_rows:
                    yield made(batch.column("id").slice(first, i - first), sets)
                    sets, first, held = [], i, 0

    wanted = docs.select(F.col(id_col).cast("bigint").alias("id"), _ended(text_col).alias("text")).join(ids, "id", "left_semi")
    return materialise(wanted.mapInArrow(run, "id bigint, shingles binary"), "sets")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets reach the similarity."""
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                good.append(len(x) > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    got = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
           .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a"))
    return materialise(got.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "links")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id.

    Words are runs of non-space (ASCII white space) with A-Z in lower case; a
    text of fewer than ``size`` words is one shingle.  A null, empty or blank
    text has no shingles, links with nothing and is its own component.  A row
    with a null id takes no part and has a null component.  Rows that repeat an
    id are documents of their own; the component is that of their text.  An
    empty table gives no rows.
    """
    ranks = frequency_ranks(docs, size, text_col)
    rows = materialise(describe(docs, ranks, size, percent, id_col, text_col), "prefixes")
    some = rows.where("id is not null and key is not null")
    same = materialise(decisions(some.select("id", "key", "n"), "id", digest=F.col("key")), "classes")
    kept = same.where("kept").select("id", F.col("text_sha256").alias("key"))
    nodes = materialise(some.join(kept, ["id", "key"], "left_semi").select("id", "n", "asked", "prefix", "bits"), "nodes")
    listed = Window.partitionBy("token")
    postings = materialise(
        nodes.select("id", "n", "asked", F.posexplode("prefix").alias("pos", "token"))
        .select("token", F.struct("id", "n", "asked", "pos").alias("p"))
        .withColumn("leader", F.min(F.struct("p.pos", "p")).over(listed)["p"]).withColumn("listed", F.count(F.lit(1)).over(listed))
        .where("listed > 1").drop("listed"), "postings")

    lead = postings.where("p.id <> leader.id").withColumn("head", F.col("leader.id"))
    star = _star(lead, percent).select(
        F.col("head").alias("a"), F.when(F.col("x.id") == F.col("head"), F.col("y.id")).otherwise(F.col("x.id")).alias("b"), "shared")
    best = materialise(star.groupBy("b").agg(F.max(F.struct("shared", "a")).alias("top")).select("top.a", "b"), "pairs")
    first_ids = materialise(best.select(F.col("a").alias("id")).union(best.select("b")).distinct(), "ids")
    sets = fetch_sets(docs, first_ids, size, id_col, text_col)
    links = verify(best, sets, percent)
    comp = components(links)

    mine = nodes.select("id", F.col("bits").alias("p_bits")).join(comp, "id", "left")
    heads = comp.select(F.col("id").alias("head"), F.col("component").alias("head_component"))
    inside = Window.partitionBy("id").orderBy("p.pos")  # the postings go to their documents for the join too
    of = (postings.withColumn("id", F.col("p.id")).withColumn("before", F.lag("token").over(inside)).join(mine, "id")
          .join(heads, F.col("leader.id") == F.col("head"), "left")
          .select("token", "before", "p_bits", "p", F.coalesce("component", "p.id").alias("component"),
                  F.coalesce("head_component", "leader.id").alias("head_component")))
    of = materialise(of.withColumn("rest", F.col("component") != F.col("head_component")).drop("head_component"), "postings")
    more = materialise(_rest(of, nodes, percent), "pairs")
    if not more.isEmpty():
        ids = more.select(F.col("a").alias("id")).union(more.select("b")).distinct().join(first_ids, "id", "left_anti")
        sets = sets.unionByName(fetch_sets(docs, materialise(ids, "ids"), size, id_col, text_col))
        links = links.unionByName(verify(more, sets, percent))
        comp = components(links)

    out = same.join(comp.select(F.col("id").alias("keep_id"), "component"), "keep_id", "left")
    out = out.select("id", F.col("text_sha256").alias("key"), F.coalesce("component", "keep_id").alias("component"))
    out = out.groupBy("id", "key").agg(F.min("component").alias("component"))
    joined = rows.select("id", "n", "key").join(out, ["id", "key"], "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                         F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that are not the smallest id of their component.

    Rows with a null id stay.
    """
    groups = near_groups(docs, size, percent, id_col, text_col)
    gone = materialise(groups.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(fresh(docs, "__gone"))).distinct(), "gone")
    return docs.join(gone, F.col(id_col) == gone[gone.columns[0]], "left_anti")
