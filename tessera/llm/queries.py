"""The thin registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collocations, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, mixing, packing, periodic_runs, sharding, substring_dedup, url_reputation, warc
from tessera.llm.common import prepare
from tessera.plans.tables import table
from tessera.session import shared_path

QUERIES: dict = {}
ORACLE: dict = {}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


ORACLE["op1_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~held_out()))
    said = language_id.predict(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
    return said.select("doc_id", "held_out", "lang_pred", "score", "rejected")


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.containments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_item", "n_shared").distinct()


ORACLE["op3_decontaminate"] = r"""
WITH t AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT kind, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT kind, id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM w
      UNION SELECT kind, id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) FROM w,
        (SELECT DISTINCT len(w) AS k FROM w WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4) WHERE kind = 'd'),
n AS (SELECT id, count(*) AS n_item FROM g WHERE kind = 'b' GROUP BY id),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM g d JOIN g b USING (s) WHERE d.kind = 'd' AND b.kind = 'b' GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared FROM c JOIN n ON n.id = item_id WHERE n_shared * 100 >= n_item * 80
"""


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@_query
def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@_query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.numbered(sharding.assign(table(spark, sf_dir, "documents"), 16))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("intervals")


ORACLE["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
v AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, i, string_agg(word, ' ') OVER x AS s, count(*) OVER x AS c FROM v
      WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS gone FROM k WHERE c = 13),
r AS (SELECT DISTINCT doc_id, i + j AS i FROM g, range(0, 13) AS t(j) WHERE gone),
o AS (SELECT v.doc_id, count(*) AS n_words, count(r.i) AS n_removed,
      coalesce(string_agg(word, ' ' ORDER BY v.i) FILTER (WHERE r.i IS NULL), '') AS kept
      FROM v LEFT JOIN r ON r.doc_id = v.doc_id AND r.i = v.i GROUP BY v.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)
"""


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, out = shared_path(spark, "llm", "arc"), shared_path(spark, "llm", "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arc)
    warc.write_warc(warc.convert(warc.read_arc(spark, arc)), out)
    back = warc.read_warc(spark, out).where("record_type <> 'warcinfo'")
    return back.select(F.col("record_key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("bigint").alias("refers_to"))


ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND head < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND head < page_id THEN head END AS refers_to FROM f
"""


@_query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(table(spark, sf_dir, "documents"), size=3, percent=90)


ORACLE["op9_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS g FROM d),
g AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c
        FROM g x JOIN g y ON x.t = y.t AND x.doc_id <> y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 90 GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (n + m - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM s
"""


@_query
def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = url_reputation.page_outcomes(pages, table(spark, sf_dir, "labels"))
    return (url_reputation.judge(pages, outcomes)
            .select("page_id", "host", "path", "rule", "verdict"))


def reputation_sql(outcomes: str) -> str:
    """CTEs up to b (host, blocked) from u (page_id, host, path) and a query of (host, bad)."""
    wide = ", ".join(f"'{s}'" for s in url_reputation.WIDE_SUFFIXES)
    rho, few, least, most, z, limit = (getattr(url_reputation, x) for x in ("RHO", "FEW", "LEAST", "MOST", "Z", "LIMIT"))

    def fitted(table, parent, n, bad):
        return f"""(SELECT least({most}, greatest({least}, ({few} * {rho!r} + coalesce(sum(least(off, {n} - 1) / {n}), 0)) / ({few} + coalesce(sum(({n} - 1) / {n}), 0))))
        FROM (SELECT *, {n} * pow({bad} / {n} - m, 2) / (m * (1 - m)) - 1 AS off FROM (SELECT *, (all_bad - {bad} + 1) / (all_n - {n} + 2) AS m
        FROM (SELECT *, sum({n}) OVER (PARTITION BY {parent}) AS all_n, sum({bad}) OVER (PARTITION BY {parent}) AS all_bad FROM {table})
        WHERE all_n - {n} > 1e-9 AND {n} >= 2)))"""

    def counted(n, rho):
        return f"{n} / (1 + ({n} - 1) * {rho})"

    def level(rate, weight, rho, n, bad):
        left = f"({weight} / ({weight} + 1) * (1 - {rho}))"
        prior = f"({left} / (1 - {left}))"
        return f"({prior} * {rate} + {bad}) / ({prior} + {n}) AS rate, {prior} + {n} AS weight"
    return rf"""
o AS ({outcomes}),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM o WHERE host IS NOT NULL AND bad IS NOT NULL GROUP BY host),
g AS (SELECT host, n, bad FROM h UNION ALL SELECT DISTINCT host, 0, 0 FROM u WHERE host <> '' AND host NOT IN (SELECT host FROM h)),
k AS (SELECT *, CASE WHEN two IN ({wide}) THEN two ELSE string_split(host, '.')[-1] END AS suffix,
    CASE WHEN two IN ({wide}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain
    FROM (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM g)),
l AS (SELECT * FROM k WHERE n > 0),
rh AS (SELECT {fitted("l", "domain", "n", "bad")} AS rho),
he AS (SELECT l.*, {counted("n", "rho")} AS e, {counted("n", "rho")} * bad / n AS b FROM l, rh),
d0 AS (SELECT suffix, domain, sum(e) AS dn, sum(b) AS dbad FROM he GROUP BY suffix, domain),
rd AS (SELECT {fitted("d0", "suffix", "dn", "dbad")} AS rho),
d1 AS (SELECT d0.*, {counted("dn", "rho")} AS de, {counted("dn", "rho")} * dbad / dn AS db FROM d0, rd),
s0 AS (SELECT suffix, sum(de) AS sn, sum(db) AS sbad FROM d1 GROUP BY suffix),
rs AS (SELECT {fitted("s0", "1", "sn", "sbad")} AS rho),
s1 AS (SELECT s0.*, {counted("sn", "rho")} AS se, {counted("sn", "rho")} * sbad / sn AS sb FROM s0, rs),
al AS (SELECT coalesce(sum(se), 0) AS an, coalesce(sum(sb), 0) AS abad FROM s1),
j0 AS (SELECT k.host, k.n, k.bad, an, abad, coalesce(e, 0) AS e, coalesce(b, 0) AS b, coalesce(dn, 0) AS dn, coalesce(dbad, 0) AS dbad, coalesce(de, 0) AS de,
    coalesce(db, 0) AS db, coalesce(sn, 0) AS sn, coalesce(sbad, 0) AS sbad, coalesce(se, 0) AS se, coalesce(sb, 0) AS sb, rh.rho AS rho_h, rd.rho AS rho_d, rs.rho AS rho_s
    FROM k LEFT JOIN he USING (host) LEFT JOIN d1 ON d1.domain = k.domain LEFT JOIN s1 ON s1.suffix = k.suffix, al, rh, rd, rs),
j1 AS (SELECT *, (greatest(abad - sb, 0) + 1) / (greatest(an - se, 0) + 2) AS rate, greatest(an - se, 0) + 2 AS weight FROM j0),
j2 AS (SELECT * EXCLUDE (rate, weight), {level("rate", "weight", "rho_s", "greatest(sn - de, 0)", "greatest(sbad - db, 0)")} FROM j1),
j3 AS (SELECT * EXCLUDE (rate, weight), {level("rate", "weight", "rho_d", "greatest(dn - e, 0)", "greatest(dbad - b, 0)")} FROM j2),
j4 AS (SELECT * EXCLUDE (rate, weight), {level("rate", "weight", "rho_h", "n", "bad")} FROM j3),
b AS (SELECT host, rate, rate - {z} * sqrt(greatest(rate * (1 - rate), 0) / (weight + 1)) > {limit} AS blocked FROM j4)"""


def url_sql(rules: bool = True, outcomes: str = "SELECT host, greatest(toxic, 1 - quality) AS bad FROM u JOIN labels ON doc_id = page_id WHERE host <> ''") -> str:
    ranked = sorted(url_reputation.RULES if rules else [("allow", "never", "/")], key=lambda r: -len(r[1] + r[2]))
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in ranked)
    said = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in ranked)
    return rf"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
{reputation_sql(outcomes)},
j AS (SELECT page_id, host, path, CASE {case} END AS rule, coalesce(blocked, false) AS blocked FROM u LEFT JOIN b USING (host))
SELECT page_id, host, path, rule, coalesce(CASE rule {said} END, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""


ORACLE["op10_url_reputation"] = url_sql()


def repeating_text():
    """The text; where crc32(doc_id) ends in 0, its words from a on repeat with period p (a and p come from the checksum too)."""
    planted = F.expr(r"""array_join(get(transform(array(named_struct(
            'w', split(trim(BOTH ' ' FROM regexp_replace(text, '[\\x20\\x09-\\x0D]+', ' ')), ' '), 'g', crc32(cast(cast(doc_id AS string) AS binary)) div 10)),
        s -> get(transform(array(named_struct('w', s.w, 'a', s.g % size(s.w), 'p', 1 + (size(s.w) - s.g % size(s.w)) div (3 + s.g % 8))),
        t -> transform(t.w, (x, i) -> IF(i < t.a, x, get(t.w, cast(t.a + (i - t.a) % t.p AS int))))), 0)), 0), ' ')""")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, planted).otherwise(F.col("text"))


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", repeating_text().alias("text")))
    return periodic_runs.longest_run(found).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


ORACLE["op11_periodic_runs"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a, CASE WHEN n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM e),
u AS (SELECT doc_id, n, h, a, p, unnest(range(n)) AS i FROM p),
s AS (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM p),
v AS (SELECT u.doc_id, u.n, u.i, s.word FROM u JOIN s ON s.doc_id = u.doc_id
      AND s.i = CASE WHEN u.h % 10 = 0 AND u.i >= u.a THEN u.a + (u.i - u.a) % u.p ELSE u.i END),
k AS (SELECT doc_id, n, i, string_agg(word, ' ') OVER x AS gram, count(*) OVER x AS c FROM v
      WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
q AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.gram = y.gram AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
      WHERE x.c = 5 AND y.c = 5),
o AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q),
l AS (SELECT doc_id, q AS period, min(i) AS start, max(i) - min(i) + 5 + q AS length FROM o GROUP BY doc_id, q, island),
m AS (SELECT * FROM l WHERE length >= greatest(6, 4 * period)),
r AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m z WHERE z.doc_id = m.doc_id AND z.period < m.period AND z.start <= m.start
      AND z.start + z.length >= m.start + m.length)),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.i) AS kept FROM v LEFT JOIN x ON x.doc_id = v.doc_id AND x.i = v.i WHERE x.i IS NULL GROUP BY v.doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
    sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
"""


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i:i+m-1])) AS g FROM w, range(1, 6) AS s(m)),
f AS (SELECT lang, m, g, count(*) AS f FROM g GROUP BY lang, m, g HAVING count(*) >= 100),
u AS (SELECT lang, g[i:j] AS g, max(f) AS longer FROM f, range(1, 5) AS a(i), range(2, 6) AS b(j) WHERE m > 2 AND j > i AND j <= m AND j - i + 1 < m GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN u ON u.lang = f.lang AND u.g = f.g WHERE m > 1 AND coalesce(longer, 0) < f),
x AS (SELECT c.*, k FROM c, range(1, 5) AS s(k) WHERE k < m),
y AS (SELECT x.lang, x.g, x.m, x.f AS a, x.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * x.f * t.n // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.g = x.g[1:x.k] JOIN f r ON r.lang = x.lang AND r.g = x.g[x.k+1:x.m] JOIN t ON t.lang = x.lang),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM z QUALIFY rank <= 2000
"""


@_query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op13_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS pos FROM s),
c AS (SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS w FROM o
      WINDOW b AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT pos, rest, w FROM c WHERE 3 * source_size::HUGEINT * w >= weight * rest::HUGEINT ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN c.pos < f.pos THEN 3.0::DOUBLE * source_size ELSE (weight * f.rest)::DOUBLE / f.w END AS target FROM c, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM t),
g AS (SELECT *, target - passes * source_size AS budget FROM p),
r AS (SELECT d.*, source_size, target, passes, budget, sum(size) OVER (PARTITION BY d.source ORDER BY h)::DOUBLE AS upto, sum(size) OVER (PARTITION BY d.source, h)::DOUBLE AS own
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
    size * (passes + CASE WHEN upto <= budget OR (upto - own < budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM r
"""
