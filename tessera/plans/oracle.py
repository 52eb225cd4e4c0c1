"""DuckDB SQL for each registered query (same column names and types)."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["extract_records"] = """
SELECT CAST(event_id AS INTEGER) AS _id, CAST(user_id AS INTEGER) AS category_id,
       CAST(event_id AS VARCHAR) || '.jpg' AS name, md5(props) AS picture_md5, event_id AS pos
FROM events
"""

ORACLE["extract_totals"] = """
SELECT count(*) AS n_pictures, count(DISTINCT user_id) AS n_categories FROM events
"""

ORACLE["category_counts"] = """
SELECT CAST(user_id AS INTEGER) AS category_id, count(*) AS n FROM events GROUP BY user_id
"""

_IDS = """
SELECT CAST(user_id AS INTEGER) AS category_id, event_id AS pos, CAST(event_id AS INTEGER) AS _id FROM events
"""

ORACLE["category_ids"] = _IDS

ORACLE["category_report"] = f"""
SELECT 'count' AS report, CAST(NULL AS INTEGER) AS category_id, CAST(0 AS BIGINT) AS seq,
       'number of pictures: ' || count(*) || ', number of category: ' || count(DISTINCT user_id) AS line
FROM events
UNION ALL
SELECT 'cates', CAST(user_id AS INTEGER), 0, CAST(user_id AS VARCHAR) || ',' || CAST(count(*) AS VARCHAR) FROM events GROUP BY user_id
UNION ALL
SELECT 'ids', category_id, pos, CAST(category_id AS VARCHAR) || ',' || CAST(_id AS VARCHAR) FROM ({_IDS}) t
"""

ORACLE["last_picture_per_id"] = """
WITH r AS (
  SELECT CAST(user_id % 3 AS INTEGER) AS category_id, CAST(event_id % 2000 AS INTEGER) AS _id,
         props, event_id AS pos FROM events)
SELECT category_id, _id, CAST(_id AS VARCHAR) || '.jpg' AS name,
       md5(arg_max(props, pos)) AS picture_md5, max(pos) AS pos
FROM r GROUP BY category_id, _id
"""

ORACLE["extract_progress"] = """
WITH f AS (SELECT user_id, min(event_id) AS fp FROM events GROUP BY user_id)
SELECT e.event_id AS record_index, e.event_id AS n_pictures,
       (SELECT count(*) FROM f WHERE f.fp < e.event_id) AS n_categories
FROM events e WHERE e.event_id % 1000 = 0
"""

_EXT_LIST = ("'bmp','gif','jpg','jpeg','jp2','pbm','pgm','ppm','pnm','png','tif','tiff','exr','webp',"
             "'BMP','GIF','JPG','JPEG','JP2','PBM','PGM','PPM','PNM','PNG','TIF','TIFF','EXR','WEBP'")

ORACLE["label_from_path"] = f"""
SELECT 'pages' AS source, page_id AS id, url AS path, string_split(url, '/')[-2] AS label FROM pages
UNION ALL
SELECT 'embeddings', id, path, string_split(path, '/')[-2] FROM (
  SELECT vec_id AS id,
         '/data/' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR)
           || ['.jpg', '.png', '.bmp', '.txt', '.json'][vec_id % 5 + 1] AS path
  FROM embeddings) t
WHERE regexp_extract(path, '\\.([^./]*)$', 1) IN ({_EXT_LIST})
"""

ORACLE["index_labels"] = """
SELECT p_partkey, p_type, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS label_idx FROM part
"""

ORACLE["one_hot_labels"] = """
SELECT vec_id, CAST(i AS INTEGER) AS idx, CAST(CASE WHEN i = label THEN 1.0 ELSE 0.0 END AS DOUBLE) AS value
FROM embeddings, range(10) t(i)
"""

ORACLE["scale_pixels"] = """
SELECT vec_id AS id,
       list_transform(embedding, lambda x: least(greatest(CAST(floor((CAST(x AS DOUBLE) + 1) * 127) AS INTEGER), 0), 255) / CAST(255.0 AS DOUBLE)) AS pixels
FROM embeddings
"""

# Balanced, split and batched embeddings (seed 12345, 80/20, batch 20).
_BAL = """
ranked AS (
  SELECT vec_id AS id, label, embedding,
         row_number() OVER (PARTITION BY label ORDER BY md5('12345:' || CAST(vec_id AS VARCHAR)), vec_id) AS rn,
         count(*) OVER (PARTITION BY label) AS class_n
  FROM embeddings),
cls AS (SELECT min(class_n) AS m, count(DISTINCT label) AS l FROM ranked),
lidx AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx
         FROM (SELECT DISTINCT label FROM embeddings) d),
bal AS (
  SELECT r.id, r.label, x.label_idx, r.rn, (r.rn - 1) * c.l + x.label_idx AS pos, r.embedding,
         CAST(floor(0.8 * c.m * c.l + 0.5) AS BIGINT) AS n_train
  FROM ranked r JOIN lidx x USING (label) CROSS JOIN cls c
  WHERE r.rn <= c.m),
spl AS (
  SELECT *, CASE WHEN pos < n_train THEN 'train' ELSE 'test' END AS split,
         CASE WHEN pos < n_train THEN pos ELSE pos - n_train END AS split_pos
  FROM bal)
"""

ORACLE["balance_classes"] = f"""
WITH {_BAL}
SELECT id, label, label_idx, rn, pos FROM bal
"""

ORACLE["train_test_split"] = f"""
WITH {_BAL}
SELECT id, label, pos, split, split_pos FROM spl
"""

ORACLE["assign_batches"] = f"""
WITH {_BAL}
SELECT id, split, split_pos, CAST(split_pos // 20 AS BIGINT) AS batch_id FROM spl
"""

ORACLE["min_max_scale"] = f"""
WITH {_BAL},
st AS (SELECT CAST(min(list_min(embedding)) AS DOUBLE) AS lo, CAST(max(list_max(embedding)) AS DOUBLE) AS hi
       FROM spl WHERE split = 'train')
SELECT id, split, list_transform(embedding, lambda x: round((CAST(x AS DOUBLE) - st.lo) / (st.hi - st.lo), 6)) AS features
FROM spl CROSS JOIN st
"""

ORACLE["dataset_roundtrip"] = f"""
WITH {_BAL}
SELECT id, pos, split, split_pos, CAST(split_pos // 20 AS BIGINT) AS batch_id, label_idx AS label,
       embedding AS features,
       list_transform(range(10), lambda i: CAST(CASE WHEN i = label_idx THEN 1.0 ELSE 0.0 END AS DOUBLE)) AS onehot
FROM spl
"""

_LOG = """
ev AS (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) AS v FROM events),
log AS (
  SELECT event_id * 2 + 1 AS line_no, CAST(v % 101 AS VARCHAR) || ' %, ' || CAST(v * 13 % 4038 AS VARCHAR) || ' MiB' AS value FROM ev
  UNION ALL
  SELECT event_id * 2, 'utilization.gpu [%], memory.used [MiB]' FROM ev WHERE v % 3 = 0)
"""

_PARSE = """
CAST(replace(trim(split_part(value, ',', 1)), ' %', '') AS INTEGER) AS util,
CAST(replace(trim(split_part(value, ',', 2)), ' MiB', '') AS INTEGER) AS mem_mib
"""

_STEPS = f"""
{_LOG},
t AS (SELECT line_no, value, starts_with(value, 'util') AS hdr,
             sum(CASE WHEN starts_with(value, 'util') THEN 1 ELSE 0 END) OVER (ORDER BY line_no) AS blk
      FROM log),
dl AS (SELECT line_no, value, blk,
              row_number() OVER (PARTITION BY blk ORDER BY line_no DESC) - 1 AS r,
              count(*) OVER (PARTITION BY blk) AS size
       FROM t WHERE NOT hdr),
nn AS (SELECT size AS n FROM dl WHERE blk > 0 ORDER BY blk DESC LIMIT 1),
ch AS (SELECT dl.*, nn.n, dl.r // nn.n AS chunk FROM dl CROSS JOIN nn),
ok AS (SELECT * FROM ch WHERE (chunk + 1) * n <= size AND (blk > 0 OR size > (chunk + 1) * n)),
st AS (SELECT blk, chunk FROM ok GROUP BY blk, chunk ORDER BY blk DESC, chunk ASC LIMIT 501),
num AS (SELECT blk, chunk, row_number() OVER (ORDER BY blk, chunk DESC) - 1 AS step FROM st),
steps AS (
  SELECT num.step, CAST(ok.n - 1 - ok.r % ok.n AS INTEGER) AS gpu, p.util,
         CAST(trunc(p.mem_mib / 4037 * 100) AS INTEGER) AS mem_pct, ok.line_no, ok.n
  FROM ok JOIN num USING (blk, chunk)
  CROSS JOIN LATERAL (SELECT {_PARSE}) p)
"""

ORACLE["gpu_parse"] = f"""
WITH {_LOG}
SELECT line_no, util, mem_mib, CAST(trunc(mem_mib / 4037 * 100) AS INTEGER) AS mem_pct
FROM (SELECT line_no, {_PARSE} FROM log WHERE NOT starts_with(value, 'util')) p
"""

ORACLE["gpu_steps"] = f"""
WITH {_STEPS}
SELECT step, gpu, util, mem_pct, line_no FROM steps
"""

ORACLE["gpu_means"] = f"""
WITH {_STEPS}
SELECT gpu, round_even(avg(util), 1) AS util_avg, round_even(avg(mem_pct), 1) AS mem_avg
FROM steps GROUP BY gpu
"""

ORACLE["gpu_series"] = f"""
WITH {_STEPS}
SELECT step * n + gpu AS x, util, mem_pct FROM steps
"""

def _user_steps(history: int) -> str:
    return f"""
ev AS (SELECT *, CAST(floor(abs(value) * 100) AS BIGINT) AS v FROM events),
logs AS (
  SELECT user_id AS log, event_id * 2 + 1 AS line_no,
         CASE WHEN user_id % 40 = 7 AND event_id % 31 = 0 THEN 'lost, [N/A]'
              ELSE CAST(v % 101 AS VARCHAR) || ' %, ' || CAST(v % 4038 AS VARCHAR) || ' MiB' END AS value
  FROM ev
  UNION ALL
  SELECT user_id, event_id * 2, 'utilization.gpu [%], memory.used [MiB]' FROM ev WHERE event_id % (2 + user_id % 3) = 0),
t AS (SELECT *, sum(CASE WHEN starts_with(value, 'util') THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY line_no) AS blk FROM logs),
dl AS (SELECT *, row_number() OVER (PARTITION BY log, blk ORDER BY line_no DESC) - 1 AS r, count(*) OVER (PARTITION BY log, blk) AS size
       FROM t WHERE NOT starts_with(value, 'util')),
nn AS (SELECT log, arg_max(size, blk) AS n FROM dl WHERE blk > 0 GROUP BY log),
ok AS (SELECT dl.*, n, r // n AS chunk FROM dl JOIN nn USING (log) WHERE (r // n + 1) * n <= size AND (blk > 0 OR size > (r // n + 1) * n)),
num AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY blk DESC, chunk) - 1 AS back
        FROM (SELECT DISTINCT log, blk, chunk FROM ok) QUALIFY back <= {history}),
kept AS (SELECT log, count(*) AS kept FROM num GROUP BY log),
win AS (SELECT ok.*, back, kept FROM ok JOIN num USING (log, blk, chunk) JOIN kept USING (log)),
low AS (SELECT log, min(line_no) AS first_line, arg_min(blk, line_no) AS first_blk, any_value(kept) AS kept FROM win GROUP BY log),
start AS (SELECT low.log, CASE WHEN kept = {history + 1} THEN coalesce(
            (SELECT max(line_no) FROM dl WHERE dl.log = low.log AND dl.blk = first_blk AND dl.line_no < first_line), first_line) END AS from_line FROM low),
bad AS (SELECT log, max(line_no) AS line_no FROM dl LEFT JOIN start USING (log)
        WHERE value = 'lost, [N/A]' AND (from_line IS NULL OR line_no >= from_line) GROUP BY log),
steps AS (
  SELECT log, n, kept - 1 - back AS step, CAST(n - 1 - r % n AS INTEGER) AS gpu, p.util,
         CAST(trunc(p.mem_mib / 4037 * 100) AS INTEGER) AS mem_pct, line_no
  FROM (SELECT * FROM win WHERE log NOT IN (SELECT log FROM bad)) CROSS JOIN LATERAL (SELECT {_PARSE}) p)
"""


ORACLE["gpu_steps_by_log"] = f"""
WITH {_user_steps(9)}
SELECT log, n, step, gpu, util, mem_pct, line_no, CAST(NULL AS VARCHAR) AS malformed FROM steps
UNION ALL
SELECT log, NULL, NULL, NULL, NULL, NULL, line_no, 'lost, [N/A]' FROM bad
"""

ORACLE["gpu_means_by_log"] = f"""
WITH {_user_steps(500)}
SELECT log, gpu, round_even(avg(util), 1) AS util_avg, round_even(avg(mem_pct), 1) AS mem_avg FROM steps GROUP BY log, gpu
"""

ORACLE["gpu_resample"] = f"""
WITH {_STEPS},
s AS (SELECT step * n + gpu AS x, CAST(util AS DOUBLE) AS util, CAST(mem_pct AS DOUBLE) AS mem_pct FROM steps),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM s),
g AS (SELECT i, CASE WHEN i = 299 THEN CAST(hi AS DOUBLE)
                     ELSE i * (CAST(hi - lo AS DOUBLE) / CAST(299 AS DOUBLE)) + lo END AS gx
      FROM range(300) r(i) CROSS JOIN b),
g2 AS (SELECT i, gx, CAST(floor(gx) AS BIGINT) AS x0 FROM g)
SELECT g2.i AS i, round(g2.gx, 6) AS x,
       round(s0.util + (g2.gx - g2.x0) * (coalesce(s1.util, s0.util) - s0.util), 6) AS util,
       round(s0.mem_pct + (g2.gx - g2.x0) * (coalesce(s1.mem_pct, s0.mem_pct) - s0.mem_pct), 6) AS mem_pct
FROM g2 LEFT JOIN s s0 ON s0.x = g2.x0 LEFT JOIN s s1 ON s1.x = g2.x0 + 1
"""

ORACLE["read_gpu_log"] = f"""
WITH {_LOG}
SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, value FROM log
"""

_CLS = """
c AS (SELECT source AS label, CAST(doc_id AS VARCHAR) AS name FROM documents),
r AS (SELECT label, name,
             row_number() OVER (PARTITION BY label ORDER BY md5('12345:' || name), name) AS rn
      FROM c),
d AS (SELECT label, count(*) AS have, greatest(0, 60 - count(*)) AS to_generate FROM c GROUP BY label),
g AS (SELECT d.label, s.draw_no, d.have
      FROM d CROSS JOIN LATERAL generate_series(1, d.to_generate) AS s(draw_no)
      WHERE d.to_generate > 0 AND d.have > 0),
dr AS (SELECT g.label, g.draw_no, r.name AS source
       FROM g JOIN r ON r.label = g.label
        AND r.rn = ('0x' || substr(md5('12345:' || g.label || ':' || CAST(g.draw_no AS VARCHAR)), 1, 8))::BIGINT % g.have + 1),
rb AS (SELECT label, name, name AS source, false AS generated FROM r WHERE rn <= 60
       UNION ALL
       SELECT label, label || '_gen_' || CAST(draw_no AS VARCHAR), source, true FROM dr)
"""

ORACLE["class_deficits"] = f"""
WITH {_CLS}
SELECT label, CAST(have AS BIGINT) AS have, CAST(to_generate AS BIGINT) AS to_generate FROM d
"""

ORACLE["cap_per_class"] = f"""
WITH {_CLS}
SELECT label, name, rn FROM r WHERE rn <= 60
"""

ORACLE["draw_sources"] = f"""
WITH {_CLS}
SELECT label, CAST(draw_no AS BIGINT) AS draw_no, source FROM dr
"""

ORACLE["rebalance"] = f"""
WITH {_CLS}
SELECT label, name, source, generated FROM rb
"""

ORACLE["generation_report"] = f"""
WITH {_CLS}
SELECT label, count(*) FILTER (WHERE NOT generated) AS originals, count(*) FILTER (WHERE generated) AS generated
FROM rb GROUP BY label
"""


def _perm(expr: str) -> str:
    return f"SELECT vec_id AS id, list_transform(range(64), lambda i: embedding[{expr} + 1]) AS pixels FROM embeddings"


ORACLE["flip_left_right"] = _perm("(i // 8) * 8 + (7 - i % 8)")
ORACLE["flip_top_bottom"] = _perm("(7 - i // 8) * 8 + i % 8")
ORACLE["rotate180"] = _perm("63 - i")
ORACLE["rotate270"] = _perm("(7 - i % 8) * 8 + i // 8")

_PX = """
px AS (SELECT vec_id, unnest(range(64)) AS p, unnest(embedding) AS v FROM embeddings)
"""

_CONV = f"""
{_PX},
wt AS (SELECT f, dr, dc, CAST((((f * 3 + dr) * 3 + dc) * 7 + 3) % 5 - 2 AS DOUBLE) AS w
       FROM range(2) a(f) CROSS JOIN range(3) b(dr) CROSS JOIN range(3) c(dc)),
oc AS (SELECT r, c FROM range(6) a(r) CROSS JOIN range(6) b(c)),
cv AS (SELECT px.vec_id, oc.r, oc.c, wt.f,
              sum(CAST(px.v AS DOUBLE) * wt.w) + CAST(wt.f % 3 - 1 AS DOUBLE) AS z
       FROM oc CROSS JOIN wt JOIN px ON px.p = (oc.r + wt.dr) * 8 + (oc.c + wt.dc)
       GROUP BY px.vec_id, oc.r, oc.c, wt.f)
"""

ORACLE["conv2d"] = f"""
WITH {_CONV}
SELECT vec_id AS id, list(round(z, 6) ORDER BY (r * 6 + c) * 2 + f) AS out FROM cv GROUP BY vec_id
"""

ORACLE["max_pool"] = f"""
WITH {_PX}
SELECT vec_id AS id, list(m ORDER BY cell) AS out FROM (
  SELECT vec_id, (p // 8 // 2) * 4 + (p % 8) // 2 AS cell, round(max(CAST(v AS DOUBLE)), 6) AS m
  FROM px GROUP BY vec_id, cell) t
GROUP BY vec_id
"""

ORACLE["dense"] = f"""
WITH {_PX}
SELECT vec_id AS id, list(round(s + CAST(j % 3 - 1 AS DOUBLE), 6) ORDER BY j) AS out FROM (
  SELECT px.vec_id, j, sum(CAST(px.v AS DOUBLE) * CAST(((j * 64 + px.p) * 7 + 3) % 5 - 2 AS DOUBLE)) AS s
  FROM px CROSS JOIN range(10) t(j) GROUP BY px.vec_id, j) t
GROUP BY vec_id
"""

ORACLE["score_network"] = f"""
WITH {_CONV},
act AS (SELECT vec_id, r, c, f, CASE WHEN z > 0 THEN z ELSE CAST(0.01 AS DOUBLE) * z END AS a FROM cv),
pl AS (SELECT vec_id, r // 2 AS pr, c // 2 AS pc, f, max(a) AS m FROM act GROUP BY vec_id, r // 2, c // 2, f),
lo AS (SELECT vec_id, j,
              sum(m * CAST(((j * 18 + (pr * 3 + pc) * 2 + f) * 7 + 3) % 5 - 2 AS DOUBLE))
                + CAST(j % 3 - 1 AS DOUBLE) AS z
       FROM pl CROSS JOIN range(2) t(j) GROUP BY vec_id, j),
mx AS (SELECT vec_id, max(z) AS zm FROM lo GROUP BY vec_id),
ex AS (SELECT lo.vec_id, lo.j, lo.z, exp(lo.z - mx.zm) AS e, mx.zm FROM lo JOIN mx USING (vec_id)),
sm AS (SELECT vec_id, sum(e) AS s FROM ex GROUP BY vec_id)
SELECT ex.vec_id AS id, list(round(ex.e / sm.s, 6) ORDER BY ex.j) AS probs,
       CAST(min(ex.j) FILTER (WHERE ex.z = ex.zm) AS INTEGER) AS predicted
FROM ex JOIN sm USING (vec_id) GROUP BY ex.vec_id
"""

_LOGITS = """
lg AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z,
              embedding AS zf FROM embeddings),
ex AS (SELECT vec_id, label, z, zf, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM lg),
sm AS (SELECT vec_id, label, z, zf, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex)
"""

ORACLE["leaky_relu"] = f"""
WITH {_LOGITS}
SELECT vec_id AS id,
       list_transform(z, lambda x: round(CASE WHEN x > 0 THEN x ELSE CAST(0.01 AS DOUBLE) * x END, 6) + 0.0) AS out
FROM lg
"""

ORACLE["softmax"] = f"""
WITH {_LOGITS}
SELECT vec_id AS id, list_transform(p, lambda x: round(x, 6)) AS probs FROM sm
"""

ORACLE["mcxent"] = f"""
WITH {_LOGITS}
SELECT vec_id AS id, label, round(-ln(p[label + 1]), 6) AS loss FROM sm
"""

ORACLE["predict"] = f"""
WITH {_LOGITS}
SELECT vec_id AS id, CAST(list_position(zf, list_max(zf)) - 1 AS INTEGER) AS predicted FROM lg
"""

_CM = """
cm AS (
  SELECT 'labels' AS source, quality AS actual, toxic AS predicted, count(*) AS n
  FROM labels GROUP BY quality, toxic
  UNION ALL
  SELECT 'embeddings', label, CAST(vec_id % 10 AS INTEGER), count(*)
  FROM embeddings GROUP BY label, CAST(vec_id % 10 AS INTEGER)),
rw AS (SELECT source, actual AS cls, n AS n_true, 0 AS n_pred,
              CASE WHEN actual = predicted THEN n ELSE 0 END AS tp FROM cm
       UNION ALL
       SELECT source, predicted, 0, n, 0 FROM cm),
per AS (SELECT source, cls, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(n_pred) AS BIGINT) AS n_pred,
               CAST(sum(tp) AS BIGINT) AS tp
        FROM rw GROUP BY source, cls),
pr AS (SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred END AS precision,
              CASE WHEN n_true > 0 THEN tp / n_true END AS recall FROM per),
f AS (SELECT *, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL
                     WHEN precision + recall = 0 THEN 0.0
                     ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM pr)
"""

ORACLE["confusion_matrix"] = f"""
WITH {_CM}
SELECT source, actual, predicted, n FROM cm
"""

ORACLE["class_metrics"] = f"""
WITH {_CM}
SELECT source, cls, n_true, n_pred, tp, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1
FROM f
"""

ORACLE["classification_metrics"] = f"""
WITH {_CM}
SELECT source, round(sum(tp) / sum(n_true), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
       round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
       count(*) AS n_classes, CAST(sum(n_true) AS BIGINT) AS n
FROM f GROUP BY source
"""

ORACLE["lr_schedule"] = """
WITH i AS (SELECT event_id, CAST(floor(abs(value) * 100) AS BIGINT) % 400 AS n FROM events)
SELECT event_id, n AS iteration,
       CAST(CASE WHEN n >= 300 THEN 0.003 WHEN n >= 200 THEN 0.005 WHEN n >= 100 THEN 0.008 ELSE 0.01 END AS DOUBLE) AS lr_cpu,
       CAST(CASE WHEN n >= 100 THEN 0.0001 WHEN n >= 80 THEN 0.0005 WHEN n >= 40 THEN 0.001 ELSE 0.003 END AS DOUBLE) AS lr_gpu
FROM i
"""

ORACLE["asof_prices"] = """
WITH e AS (SELECT event_id, user_id % 25 AS grp, epoch_us(ts) AS at_us FROM events),
s AS (SELECT o_orderkey AS order_id, o_custkey % 25 AS grp, o_totalprice AS price,
             epoch_us(TIMESTAMP '2024-01-01') + date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1080000000 AS at_us FROM orders),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY grp, at_us ORDER BY order_id DESC) = 1)
SELECT e.event_id, e.grp, e.at_us AS at, u.order_id, u.price FROM e ASOF LEFT JOIN u ON e.grp = u.grp AND e.at_us >= u.at_us
"""

ORACLE["index_many_labels"] = """
WITH d AS (SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || '/' || coalesce(source, '')) AS label FROM documents)
SELECT doc_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM d
"""

ORACLE["average_parameters"] = """
WITH p AS (
  SELECT row_number() OVER (PARTITION BY label ORDER BY md5('12345:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS chunk,
         embedding FROM embeddings),
u AS (SELECT chunk, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM p),
a AS (SELECT chunk, i, avg(CAST(v AS DOUBLE)) AS m FROM u GROUP BY chunk, i)
SELECT 0 AS layer, 'W' AS name, chunk, list(round(m, 6) + 0.0 ORDER BY i) AS vals FROM a GROUP BY chunk
"""

ORACLE["average_parameters_weighted"] = """
WITH p AS (
  SELECT row_number() OVER (PARTITION BY label ORDER BY md5('12345:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS chunk,
         count(*) OVER (PARTITION BY label) AS n, embedding FROM embeddings),
u AS (SELECT chunk, n, unnest(range(len(embedding))) AS i, unnest(embedding) AS v FROM p),
a AS (SELECT chunk, i, sum(n * CAST(v AS DOUBLE)) / sum(n) AS m FROM u GROUP BY chunk, i)
SELECT 0 AS layer, 'W' AS name, chunk, list(round(m, 6) + 0.0 ORDER BY i) AS vals FROM a GROUP BY chunk
"""

ORACLE["program_times"] = """
WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
s AS (SELECT 'extract' AS stage, count(*) AS rows FROM events
      UNION ALL SELECT 'prepare', min(n) * count(*) FROM c
      UNION ALL SELECT 'model', 10 * 64 + 10)
SELECT stage, rows, true AS tasks_inside, true AS has_time, true AS minutes_fit FROM s
UNION ALL SELECT unnest(['training', 'total']), NULL, NULL, true, true
"""

ORACLE["draw_from_few"] = """
WITH i AS (SELECT lang AS label, CAST(min(doc_id) AS VARCHAR) AS source FROM documents GROUP BY lang)
SELECT label, draw_no, source FROM i, range(1, 9000) AS r(draw_no)
"""

ORACLE["timing_report"] = """
WITH e AS (SELECT CAST(ts AS DATE) AS day, epoch_us(ts) // 1000 AS ms FROM events),
d AS (SELECT day, min(ms) AS b, max(ms) AS e FROM e GROUP BY day),
x AS (SELECT CAST(date_diff('day', (SELECT min(day) FROM d), day) AS INTEGER) AS epoch, b, e FROM d)
SELECT epoch, min(b) AS begin_ms, max(e) AS end_ms, max(e) - min(b) AS ms,
       (max(e) - min(b)) * 1.6666666666667e-5 AS minutes
FROM x GROUP BY ROLLUP (epoch)
"""

ORACLE["init_parameters"] = """
WITH d AS (SELECT max(len(embedding)) AS n_in, count(DISTINCT label) AS k FROM embeddings),
w AS (SELECT 0 AS layer, 'W' AS name, g.idx,
             sqrt(-2.0 * ln(1.0 - ('0x' || substr(md5('12345:0:1:' || CAST(g.idx AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0))
             * cos(2 * pi() * (('0x' || substr(md5('12345:0:2:' || CAST(g.idx AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0))
             * sqrt(CAST(2.0 AS DOUBLE) / d.n_in) AS value
      FROM d CROSS JOIN LATERAL generate_series(0, d.n_in * d.k - 1) AS g(idx)),
b AS (SELECT 0 AS layer, 'b' AS name, g.idx, CAST(0.0 AS DOUBLE) AS value
      FROM d CROSS JOIN LATERAL generate_series(0, d.k - 1) AS g(idx))
SELECT layer, name, idx, round(value, 6) AS value FROM w
UNION ALL
SELECT layer, name, idx, value FROM b
"""

ORACLE["train_step"] = """
WITH x AS (SELECT label, unnest(range(64)) AS j, unnest(embedding) AS v FROM embeddings),
n AS (SELECT count(*) AS n FROM embeddings),
gw AS (SELECT k, j, sum(CAST(v AS DOUBLE) * (0.1 - CASE WHEN label = k THEN 1.0 ELSE 0.0 END)) AS g
       FROM x CROSS JOIN range(10) t(k) GROUP BY k, j),
gb AS (SELECT k, sum(0.1 - CASE WHEN label = k THEN 1.0 ELSE 0.0 END) AS g
       FROM embeddings CROSS JOIN range(10) t(k) GROUP BY k)
SELECT 0 AS layer, 'W' AS name, k * 64 + j AS idx, round(0.0 - 0.01 * (g / n.n), 9) AS value FROM gw CROSS JOIN n
UNION ALL
SELECT 0, 'b', k, round(0.0 - 0.01 * (CAST(g AS DOUBLE) / n.n), 9) FROM gb CROSS JOIN n
"""

ORACLE["read_bson"] = ORACLE["extract_records"]

_PNG = "list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor((x + CAST(1 AS FLOAT)) * CAST(127 AS FLOAT)) AS INTEGER))))"

ORACLE["load_images"] = f"""
WITH px AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, {_PNG} AS p FROM embeddings),
ps AS (SELECT i, greatest(0.0, least(7.0, (i + 0.5) * 8 / 32 - 0.5))::DOUBLE AS v FROM range(32) t(i)),
ax AS (SELECT i, CAST(floor(v) AS INTEGER) AS lo, least(CAST(floor(v) AS INTEGER) + 1, 7) AS hi, v - floor(v) AS f FROM ps),
g AS (SELECT id, label, r.i AS r, c.i AS c,
        round_even((p[r.lo*8+c.lo+1]*(1-c.f) + p[r.lo*8+c.hi+1]*c.f)*(1-r.f) + (p[r.hi*8+c.lo+1]*(1-c.f) + p[r.hi*8+c.hi+1]*c.f)*r.f, 0) AS v
      FROM px CROSS JOIN ax r CROSS JOIN ax c)
SELECT id, label, 32 AS height, 32 AS width, 3 AS channels, flatten(list([CAST(v AS INTEGER), CAST(v AS INTEGER), CAST(v AS INTEGER)] ORDER BY r, c)) AS pixels
FROM g GROUP BY id, label
"""

ORACLE["scan_images"] = """
SELECT CAST(vec_id AS VARCHAR) || '.png' AS name, CAST(label AS VARCHAR) AS label, true AS filled FROM embeddings
"""

ORACLE["picture_files"] = f"""
SELECT category_id, name, picture_md5 FROM ({ORACLE["last_picture_per_id"]}) t
"""

ORACLE["report_files"] = f"""
SELECT report, line FROM ({ORACLE["category_report"]}) t
"""

ORACLE["class_deficits_empty"] = """
WITH h AS (SELECT source AS label, count(*) AS have FROM documents GROUP BY source),
l AS (SELECT source AS label FROM documents UNION SELECT lang FROM documents)
SELECT label, coalesce(have, 0) AS have, greatest(0, 60 - coalesce(have, 0)) AS to_generate FROM l LEFT JOIN h USING (label)
"""

ORACLE["train_two_steps"] = """
WITH x AS (SELECT vec_id, label, unnest(range(64)) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
n AS (SELECT count(*)::DOUBLE AS n FROM embeddings), ks AS (SELECT k FROM range(10) t(k)),
w1 AS (SELECT k, j, 0.0 - 0.5 * (sum(v * (0.1 - CASE WHEN label = k THEN 1.0 ELSE 0.0 END)::DOUBLE) / any_value(n)) AS w FROM x, ks, n GROUP BY k, j),
b1 AS (SELECT k, 0.0 - 0.5 * (sum((0.1 - CASE WHEN label = k THEN 1.0 ELSE 0.0 END)::DOUBLE) / any_value(n)) AS b FROM embeddings, ks, n GROUP BY k),
z AS (SELECT vec_id, any_value(label) AS label, w1.k, sum(v * w) + any_value(b) AS z FROM x JOIN w1 USING (j) JOIN b1 ON b1.k = w1.k GROUP BY vec_id, w1.k),
e AS (SELECT vec_id, label, k, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z),
p AS (SELECT vec_id, k, e / sum(e) OVER (PARTITION BY vec_id) - CASE WHEN label = k THEN 1.0 ELSE 0.0 END AS d FROM e),
g AS (SELECT p.k, x.j, sum(v * d) AS g FROM x JOIN p USING (vec_id) GROUP BY p.k, x.j),
h AS (SELECT k, sum(d) AS g FROM p GROUP BY k)
SELECT 0 AS layer, 'W' AS name, k * 64 + j AS idx, round(w - 0.5 * (g / n + 0.01 * w), 9) + 0.0 AS value FROM g JOIN w1 USING (k, j), n
UNION ALL SELECT 0, 'b', k, round(b - 0.5 * (g / n), 9) + 0.0 FROM h JOIN b1 USING (k), n
"""


def _draw(key: str, step: int, k: int) -> str:
    return f"(('0x' || substr(md5('12345:' || {key} || ':{step}:{k}'), 1, 8))::BIGINT / 4294967296.0)"


_LR, _TB, _HALF, _LEFT, _RIGHT = "(i // 8) * 8 + (7 - i % 8)", "(7 - i // 8) * 8 + i % 8", "63 - i", "(i % 8) * 8 + 7 - i // 8", "(7 - i % 8) * 8 + i // 8"


def _moved(at: str) -> str:
    return f"list_transform(range(64), lambda i: p[{at} + 1])"


def _mixed(ys: str, xs: str, last_y: str = "7", last_x: str = "7") -> str:
    """Four neighbours at positions in 2**-16 of a pixel."""
    def px(y, x):
        return f"p[({y}) * 8 + ({x}) + 1]"
    y0, x0, y1, x1 = "(q.y >> 16)", "(q.x >> 16)", f"least((q.y >> 16) + 1, {last_y})", f"least((q.x >> 16) + 1, {last_x})"
    fy, fx = "(q.y & 65535)", "(q.x & 65535)"
    gy, gx = f"(65536 - {fy})", f"(65536 - {fx})"
    return (f"list_transform(list_transform(range(64), lambda i: {{'y': {ys}, 'x': {xs}}}), lambda q: "
            f"({px(y0, x0)} * ({gy} * {gx}) + {px(y0, x1)} * ({gy} * {fx}) + {px(y1, x0)} * ({fy} * {gx}) + {px(y1, x1)} * ({fy} * {fx})) / 4294967296.0::DOUBLE)")


def _affine(a: str, b: str, c: str, d: str) -> str:
    def at(u, v):
        return f"least(greatest((7 * 65536 + {u} * (2 * (i // 8) - 7) + {v} * (2 * (i % 8) - 7)) // 2, 0), 7 * 65536)"
    return _mixed(at(a, b), at(c, d))


def _fixed(x: str) -> str:
    return f"CAST(floor(({x}) * 65536 + 0.5) AS BIGINT)"


def _step(st: dict, key: str, k: int) -> tuple[dict[str, str], str]:
    """Columns computed once a picture, and the picture after the step."""
    u1, u2 = _draw(key, k, 1), _draw(key, k, 2)
    if st["op"] == "flip_left_right":
        return {}, _moved(_LR)
    if st["op"] == "flip_top_bottom":
        return {}, _moved(_TB)
    if st["op"] == "flip_random":
        return {"u": u1}, f"CASE WHEN u < 0.5 THEN {_moved(_LR)} ELSE {_moved(_TB)} END"
    if st["op"] == "rotate180":
        return {}, _moved(_HALF)
    if st["op"] == "rotate270":
        return {}, _moved(_RIGHT)
    if st["op"] == "rotate_random_90":
        return {"u": f"floor({u1} * 3)"}, f"CASE WHEN u = 0 THEN {_moved(_LEFT)} WHEN u = 1 THEN {_moved(_HALF)} ELSE {_moved(_RIGHT)} END"
    if st["op"] == "crop_random":  # 7 of 8 rows and columns
        def at(n, first):
            return f"least(greatest(((2 * ({n}) + 1) * 7 * 65536 - 8 * 65536) // 16, 0), 6 * 65536) + {first} * 65536"
        return {"a": f"CAST(floor({u1} * 2) AS BIGINT)", "b": f"CAST(floor({u2} * 2) AS BIGINT)"}, _mixed(at("i // 8", "a"), at("i % 8", "b"), "a + 6", "b + 6")
    angle = f"radians(-{st.get('left')} + {u1} * {st.get('left', 0) + st.get('right', 0)})"
    if st["op"] == "rotate":
        return {"a": _fixed(f"cos({angle})"), "b": _fixed(f"sin({angle})")}, _affine("a", "(-b)", "b", "a")
    if st["op"] == "shear":
        return {"a": _fixed(f"tan({angle})"), "u": u2}, f"CASE WHEN u < 0.5 THEN {_affine('65536', '0', 'a', '65536')} ELSE {_affine('65536', 'a', '0', '65536')} END"
    return {"a": _fixed(f"1.0 / ({st['lo']} + {u1} * ({st['hi']} - {st['lo']}))")}, _affine("a", "0", "0", "a")


def _stepped(rows: str, key: str, steps) -> str:
    """``rows`` with the list ``p`` of 8x8 pixels after the steps, each applied by its draw."""
    for k, st in enumerate(steps):
        made, after = _step(st, key, k)
        extra = "".join(f", {x} AS {n}" for n, x in made.items())
        drop = f" EXCLUDE ({', '.join(made)})" if made else ""
        rows = f"(SELECT *{drop} REPLACE (CASE WHEN {_draw(key, k, 0)} < {st['p']} THEN {after} ELSE p END AS p) FROM (SELECT *{extra} FROM {rows}))"
    return rows


_EXACT = [{"op": "flip_random", "p": 0.7}, {"op": "flip_left_right", "p": 0.5}, {"op": "flip_top_bottom", "p": 0.5},
          {"op": "rotate_random_90", "p": 0.9}, {"op": "rotate180", "p": 0.8}, {"op": "rotate270", "p": 0.6}]
# The eleven steps.
_ELEVEN = [{"op": "flip_random", "p": 1.0}, {"op": "flip_left_right", "p": 1.0}, {"op": "flip_top_bottom", "p": 1.0}, {"op": "crop_random", "p": 1.0},
           {"op": "rotate_random_90", "p": 0.9}, {"op": "rotate180", "p": 0.8}, {"op": "rotate270", "p": 0.6}, {"op": "flip_random", "p": 1.0},
           {"op": "rotate", "p": 0.5, "left": 4, "right": 4}, {"op": "shear", "p": 0.6, "left": 8, "right": 8}, {"op": "zoom", "p": 0.8, "lo": 1.0, "hi": 1.3}]


ORACLE["augment_exact"] = f"""
WITH e AS (SELECT vec_id AS id, label, embedding AS p FROM embeddings)
SELECT id, label, p AS pixels FROM {_stepped("e", "CAST(id AS VARCHAR)", _EXACT)}
"""

ORACLE["augment"] = f"""
WITH e AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p FROM embeddings)
SELECT id, label, list_transform(p, lambda x: CAST(x AS FLOAT)) AS pixels FROM {_stepped("e", "CAST(id AS VARCHAR)", _ELEVEN)}
"""

def _rebalanced(target: int, steps) -> str:
    cls = (_CLS.replace("SELECT source AS label, CAST(doc_id AS VARCHAR) AS name FROM documents",
                        "SELECT CAST(label AS VARCHAR) AS label, CAST(vec_id AS VARCHAR) AS name FROM embeddings").replace("60", str(target)))
    return f"""
WITH {cls},
e AS (SELECT rb.*, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS p FROM rb JOIN embeddings ON CAST(vec_id AS VARCHAR) = source)
SELECT label, name, source, generated, list_transform(p, lambda x: CAST(x AS FLOAT)) AS pixels FROM e WHERE NOT generated
UNION ALL SELECT label, name, source, generated, list_transform(p, lambda x: CAST(x AS FLOAT)) FROM {_stepped("(SELECT * FROM e WHERE generated)", "name", steps)}
"""


ORACLE["rebalance_images_exact"] = _rebalanced(120, _EXACT)
ORACLE["rebalance_images"] = _rebalanced(60, _ELEVEN)
