"""DuckDB SQL of the vector queries, over the same tables.

Approximate searches that depend on a seed have none; tests hold their recall against exact ones.
"""

from __future__ import annotations

K = 10
SQL: dict[str, str] = {}

_VECTORS = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings), q AS (SELECT * FROM v WHERE id % 50 = 0)"
_DISTANCE = {
    "l2": "list_distance({0}, {1})",
    "l2_squared": "list_sum(list_transform(list_zip({0}, {1}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "cosine": "1 - list_cosine_similarity({0}, {1})",
    "cosine_normalised": "1 - list_inner_product({0}, {1})",
    "angular": "acos(greatest(-1.0, least(1.0, list_cosine_similarity({0}, {1})))) / pi()",
    "inner_product": "-list_inner_product({0}, {1})",
    "l1": "list_sum(list_transform(list_zip({0}, {1}), lambda p: abs(p[1] - p[2])))",
}


def _ranked(pairs: str, k: int = K, by: str = "distance", order: str = "distance, doc_id") -> str:
    return f"SELECT query_id, doc_id, {by}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS INTEGER) AS rank FROM ({pairs})) WHERE rank <= {k}"


def _pairs(metric: str, where: str = "true", base: str = "v", query: str = "q") -> str:
    d = _DISTANCE[metric].format("b.x", "a.x")
    return f"SELECT a.id AS query_id, b.id AS doc_id, round({d}, 6) + 0.0 AS distance FROM {query} a, {base} b WHERE {where}"


def _knn(metric: str, where: str = "true", k: int = K) -> str:
    return f"WITH {_VECTORS} {_ranked(_pairs(metric, where), k)}"


for _metric in ("l2", "l2_squared", "cosine", "cosine_normalised", "angular", "inner_product"):
    SQL[f"knn_{_metric}"] = _knn(_metric)
SQL["knn_single_query"] = f"WITH {_VECTORS} SELECT doc_id, distance FROM ({_pairs('cosine', 'a.id = 0')}) ORDER BY distance, doc_id LIMIT {K}"
SQL["knn_unscaled"] = f"""
WITH v AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders),
pairs AS (SELECT a.id AS query_id, b.id AS doc_id, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) + 0.0 AS distance FROM v a, v b WHERE a.id % 50 = 0)
{_ranked("SELECT * FROM pairs")}
"""
SQL["knn_custom_distance"] = _knn("l1")
SQL["knn_filtered_equals"] = _knn("cosine", "b.label = 3")
SQL["knn_filtered_tree"] = _knn("l2", "(b.label IN (1, 2) OR (b.label >= 7 AND b.label < 9))")
SQL["knn_range"] = _knn("l2", "b.label BETWEEN 2 AND 5")
SQL["knn_label_set"] = _knn("cosine", "b.id % 3 = 0")
SQL["knn_routed"] = _knn("l2", "b.label = 4 AND b.id < 60")
SQL["knn_live_set"] = _knn("l2", "b.id % 7 <> 0")
SQL["knn_merged_shards"] = SQL["knn_box_tree"] = SQL["knn_ball_tree"] = _knn("l2")
SQL["knn_rerank"] = f"""
WITH {_VECTORS}, pool AS ({_ranked(_pairs("inner_product"), 30)}),
pairs AS (SELECT query_id, doc_id, round({_DISTANCE["l2"].format("b.x", "a.x")}, 6) AS distance FROM pool JOIN q a ON a.id = query_id JOIN v b ON b.id = doc_id)
{_ranked("SELECT * FROM pairs")}
"""
SQL["knn_rectangular"] = f"""
WITH {_VECTORS}, got AS ({_ranked(_pairs("l2", "b.id < 6"))}),
grid AS (SELECT id AS query_id, CAST(r AS INTEGER) AS rank FROM q, unnest(range(1, {K + 1})) AS t(r))
SELECT query_id, coalesce(doc_id, -1) AS doc_id, distance, rank FROM grid LEFT JOIN got USING (query_id, rank)
"""
SQL["neighbour_graph"] = f"WITH {_VECTORS} SELECT query_id AS src, doc_id AS dst, distance FROM ({_ranked(_pairs('l2', 'a.id <> b.id'))})"

SQL["normalised_vectors"] = """
WITH n AS (SELECT *, sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount + l_tax * l_tax) AS len FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity / len), 6) AS mean_u0, round(avg(l_extendedprice / len), 6) AS mean_u1,
  round(avg(l_discount / len), 6) AS mean_u2, round(avg(l_tax / len), 6) AS mean_u3
FROM n GROUP BY l_returnflag
"""
SQL["predicate_tree"] = """
SELECT count(*) AS n_rows, count(*) FILTER (hit) AS n_matches, round(count(*) FILTER (hit) / count(*), 6) AS selectivity
FROM (SELECT l_quantity BETWEEN 10 AND 40 AND (l_returnflag = 'A' OR l_linestatus IN ('F')) AND l_discount > 0.02 AS hit FROM lineitem)
"""
SQL["predicate_kinds"] = """
SELECT * FROM (VALUES ('number against text', 0), ('text against number', 0), ('whole against float', 0), ('missing field', 0), ('empty some', 0)) AS t(predicate, n_matches)
UNION ALL SELECT 'field exists', count(c_acctbal) FROM customer
UNION ALL SELECT 'empty every', count(*) FROM customer
UNION ALL SELECT 'not equal', count(*) FROM customer WHERE NOT coalesce(c_nationkey = 1, false)
"""

_TOKENS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
SQL["sparse_mips"] = f"""
WITH terms AS (SELECT doc_id, term, count(*)::DOUBLE AS weight FROM (SELECT doc_id, unnest({_TOKENS.format("text")}) AS term FROM documents) GROUP BY ALL),
pairs AS (
  SELECT a.doc_id AS query_id, b.doc_id, -round(sum(a.weight * b.weight), 6) AS distance
  FROM terms a JOIN terms b USING (term) WHERE a.doc_id % 50 = 0 GROUP BY ALL
)
{_ranked("SELECT * FROM pairs")}
"""
SQL["bm25"] = f"""
WITH docs AS (SELECT doc_id, {_TOKENS.format("text")} AS w FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM docs),
asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
pairs AS (
  SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) * times), 6) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN docs USING (doc_id), size GROUP BY ALL
)
{_ranked("SELECT * FROM pairs WHERE score > 0", by="score", order="score DESC, doc_id")}
"""
_HALF = "h AS (SELECT id, x[1:32] AS x FROM v), hq AS (SELECT * FROM h WHERE id % 50 = 0)"
_HALF_PAIRS = _pairs("l2", base="h", query="hq")
SQL["rank_fusion"] = f"""
WITH {_VECTORS}, {_HALF}, found AS (
  SELECT query_id, doc_id, rank FROM ({_ranked(_pairs("l2"), 20)})
  UNION ALL SELECT query_id, doc_id, rank FROM ({_ranked(_pairs("inner_product"), 20)})
  UNION ALL SELECT query_id, doc_id, rank FROM ({_ranked(_HALF_PAIRS, 20)})
), pairs AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM found GROUP BY ALL)
{_ranked("SELECT * FROM pairs", by="score", order="score DESC, doc_id")}
"""
SQL["late_interaction"] = f"""
WITH {_VECTORS}, pool AS ({_ranked(_pairs("l2"), 30)}),
tokens AS (SELECT id, i, x[i * 16 + 1 : i * 16 + 16] AS t FROM v, unnest(range(4)) AS u(i)),
best AS (
  SELECT query_id, doc_id, a.i, max(list_inner_product(a.t, b.t)) AS m
  FROM pool JOIN tokens a ON a.id = query_id JOIN tokens b ON b.id = doc_id GROUP BY ALL
), pairs AS (SELECT query_id, doc_id, round(sum(m), 6) AS score FROM best GROUP BY ALL)
{_ranked("SELECT * FROM pairs", by="score", order="score DESC, doc_id")}
"""

_JUDGED = f"{_VECTORS}, {_HALF}, truth AS ({_ranked(_pairs('l2'), 20)}), result AS ({_ranked(_HALF_PAIRS, 20)})"
_HITS = "SELECT t.query_id, greatest(t.rank, r.rank) AS place FROM truth t JOIN result r USING (query_id, doc_id)"
SQL["recall_at_k"] = f"WITH {_JUDGED}, hits AS ({_HITS}) SELECT id AS query_id, count(place) / 10 AS recall FROM q LEFT JOIN hits ON query_id = id AND place <= 10 GROUP BY id"
SQL["precision_at_k"] = SQL["recall_at_k"].replace("AS recall", "AS precision")
SQL["recall_curve"] = f"""
WITH {_JUDGED}, hits AS ({_HITS}),
per AS (SELECT id, k, count(place) / k AS recall FROM q CROSS JOIN (VALUES (1), (5), (10), (20)) AS t(k) LEFT JOIN hits ON query_id = id AND place <= k GROUP BY id, k)
SELECT k, round(avg(recall), 6) AS recall FROM per GROUP BY k
"""
SQL["mean_reciprocal_rank"] = f"""
WITH {_JUDGED}, first AS (SELECT r.query_id, min(r.rank) AS r FROM result r JOIN truth t USING (query_id, doc_id) WHERE t.rank <= 2 GROUP BY r.query_id)
SELECT count(*) AS n_queries, round(avg(coalesce(1 / r, 0)), 6) AS mrr FROM q LEFT JOIN first ON query_id = id
"""
SQL["recall_summary"] = f"""
WITH per AS ({SQL["recall_at_k"]}), s AS (SELECT list_sort(list(recall)) AS l, count(*) AS n, avg(recall) AS mean, min(recall) AS least, max(recall) AS most, stddev_pop(recall) AS deviation FROM per)
SELECT n, round(mean, 6) AS mean, round(least, 6) AS least, round(most, 6) AS most, round(deviation, 6) AS deviation,
  round(l[least(floor(n * 0.5)::INT + 1, n)], 6) AS p50, round(l[least(floor(n * 0.95)::INT + 1, n)], 6) AS p95, round(l[least(floor(n * 0.99)::INT + 1, n)], 6) AS p99
FROM s
"""

_NEAR = f"{_VECTORS}, near AS ({_ranked(_pairs('l2', 'a.id <> b.id'), 20)})"
_LID = """lids AS (
  SELECT query_id, round(CASE WHEN count(*) < 2 THEN 'NaN'::DOUBLE WHEN count(*) FILTER (distance > 0 AND distance < far) = 0 THEN 'Infinity'::DOUBLE
    ELSE -(count(*) FILTER (distance > 0 AND distance < far)) / sum(ln(distance / far)) FILTER (distance > 0 AND distance < far) END, 6) AS lid
  FROM (SELECT *, max(distance) OVER (PARTITION BY query_id) AS far FROM near) GROUP BY query_id)"""
SQL["lid"] = f"WITH {_NEAR}, {_LID} SELECT * FROM lids"
SQL["lid_aggregates"] = f"WITH {_NEAR}, {_LID} SELECT count(*) AS n, round(avg(lid), 6) AS mean, round(quantile_cont(lid, 0.5), 6) AS median, round(count(*) / sum(1 / lid), 6) AS harmonic FROM lids WHERE isfinite(lid) AND lid > 0"
SQL["lid_categories"] = f"""
WITH {_NEAR}, {_LID}, s AS (SELECT quantile_cont(lid, 0.5) AS m, stddev_pop(lid) AS d FROM lids WHERE isfinite(lid))
SELECT query_id, lid, CASE WHEN NOT isfinite(lid) OR lid > m + d THEN 'High' WHEN lid < m - d THEN 'Low' ELSE 'Normal' END AS category FROM lids, s
"""
_MU = "mu AS (SELECT b.distance / a.distance AS mu FROM near a JOIN near b USING (query_id) WHERE a.rank = 1 AND b.rank = 2 AND a.distance > 0 AND b.distance >= a.distance)"
SQL["two_nn"] = f"""
WITH {_NEAR}, {_MU}, r AS (SELECT mu, row_number() OVER (ORDER BY mu) AS i, count(*) OVER () AS n FROM mu),
used AS (SELECT ln(mu) AS x, -ln(1 - i / n) AS y FROM r WHERE i <= floor(n * 0.9) AND i / n < 0.9999 AND mu >= 1.0001)
SELECT count(*) AS n_used, round(sum(x * y) / sum(x * x), 6) AS dimension FROM used
"""
SQL["two_nn_interval"] = f"""
WITH {_NEAR}, {_MU}, s AS (SELECT count(*) AS n, count(*) / sum(ln(mu)) AS d FROM mu)
SELECT n, round(d, 6) AS dimension, round(d / sqrt(n), 6) AS error, round(greatest(0, d - 1.96 * d / sqrt(n)), 6) AS low, round(d + 1.96 * d / sqrt(n), 6) AS high FROM s
"""
_SPREAD = """SELECT count(*) AS n, max(c) AS most, list_sort(list(c))[floor(count(*) * 0.99)::INT + 1] AS p99,
  round((avg(c * c * c) - 3 * avg(c) * avg(c * c) + 2 * avg(c) * avg(c) * avg(c)) / pow(var_pop(c), 1.5), 6) AS skew,
  round(2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1) / count(*), 6) AS gini, round(count(*) FILTER (c > 0) / count(*), 6) AS nonzero
FROM (SELECT c, row_number() OVER (ORDER BY c) AS i FROM counts)"""
SQL["hubness"] = f"WITH {_NEAR}, counts AS (SELECT id, count(query_id) AS c FROM v LEFT JOIN near ON doc_id = id AND rank <= 10 GROUP BY id) {_SPREAD}"
SQL["coordinate_dispersion"] = f"""
WITH {_VECTORS}, d AS (SELECT i, var_pop(x[i]) AS s FROM v, unnest(range(1, 65)) AS t(i) GROUP BY i)
SELECT count(*) AS n_dimensions, round(sum(s), 6) AS total, round(max(s), 6) AS largest, round(sum(s) * sum(s) / sum(s * s), 6) AS effective FROM d
"""
SQL["duplicate_fraction"] = """
SELECT count(*) AS n, count(DISTINCT (l_quantity, l_discount, l_tax)) AS n_distinct, round(1 - count(DISTINCT (l_quantity, l_discount, l_tax)) / count(*), 6) AS duplicate_fraction FROM lineitem
"""
SQL["neighbour_gaps"] = f"""
WITH {_NEAR}, g AS (SELECT query_id, min(distance) FILTER (rank = 1) AS a, min(distance) FILTER (rank = 2) AS b, max(distance) AS k FROM near WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, round(a, 6) AS nearest, round(b - a, 6) AS gap, round(CASE WHEN a > 0 THEN b / a END, 6) AS ratio, round(k - a, 6) AS spread FROM g
"""
SQL["edge_density"] = f"""
WITH {_NEAR}, d AS (SELECT query_id, 1 / (avg(distance) + 0.1) AS density FROM near WHERE rank <= 10 GROUP BY query_id), e AS (SELECT min(density) AS lo, max(density) AS hi FROM d)
SELECT query_id, round(density, 6) AS density, CAST(floor(8 + CASE WHEN hi > lo THEN (density - lo) / (hi - lo) ELSE 0 END * 24) AS INTEGER) AS edges FROM d, e
"""
SQL["relative_contrast"] = f"""
WITH {_VECTORS}, pairs AS (SELECT a.id AS query_id, {_DISTANCE["l2"].format("b.x", "a.x")} AS d FROM q a, v b WHERE a.id <> b.id)
SELECT query_id, round(avg(d) / round(min(d), 6), 6) AS contrast FROM pairs GROUP BY query_id
"""
_PARTS = f"""parts AS (
  SELECT id, CAST(part AS BIGINT) AS part, x FROM (
    SELECT b.id, b.x, a.id AS part, row_number() OVER (PARTITION BY b.id ORDER BY round({_DISTANCE["l2_squared"].format("b.x", "a.x")}, 9), a.id) AS r FROM v b, v a WHERE a.id < 16
  ) WHERE r = 1)"""
SQL["centroid_assignment"] = f"WITH {_VECTORS}, {_PARTS} SELECT id AS vec_id, part FROM parts"
SQL["partition_imbalance"] = f"WITH {_VECTORS}, {_PARTS}, counts AS (SELECT i, count(part) AS c FROM unnest(range(16)) AS t(i) LEFT JOIN parts ON part = i GROUP BY i) {_SPREAD}"
SQL["index_footprint"] = """
WITH s AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings), l AS (
  SELECT 'flat' AS layout, n * d * 4 AS stored_bytes, 0 AS other_bytes, n * d * 4 AS flat FROM s
  UNION ALL SELECT 'graph', n * d * 4, n * (40 * 4 + 5), n * d * 4 FROM s
  UNION ALL SELECT 'inverted lists of product codes', n * 8, 64 * d * 4 + n * 4 + 8 * 256 * (d // 8) * 4, n * d * 4 FROM s
  UNION ALL SELECT 'scalar 8 bit', n * d, d * 8, n * d * 4 FROM s
  UNION ALL SELECT 'scalar 4 bit', n * CAST(ceil(d / 2) AS BIGINT), d * 8, n * d * 4 FROM s
  UNION ALL SELECT 'sign bits', n * CAST(ceil(d / 8) AS BIGINT), d * d * 4, n * d * 4 FROM s
)
SELECT layout, CAST(stored_bytes AS BIGINT) AS stored_bytes, CAST(other_bytes AS BIGINT) AS other_bytes, round((stored_bytes + other_bytes) / flat, 6) AS share_of_flat FROM l
"""
SQL["ivf_search"] = f"""
WITH {_VECTORS}, {_PARTS},
probe AS (
  SELECT query_id, part FROM (
    SELECT a.id AS query_id, c.id AS part, row_number() OVER (PARTITION BY a.id ORDER BY round({_DISTANCE["l2_squared"].format("a.x", "c.x")}, 9), c.id) AS r FROM q a, v c WHERE c.id < 16
  ) WHERE r <= 4),
pairs AS (SELECT query_id, b.id AS doc_id, round({_DISTANCE["l2"].format("b.x", "a.x")}, 6) AS distance FROM probe JOIN parts b USING (part) JOIN q a ON a.id = query_id)
{_ranked("SELECT * FROM pairs")}
"""


def _scalar_quantised(levels: int, pool: int) -> str:
    return f"""
WITH {_VECTORS}, each AS (SELECT id, i, x[i] AS x FROM v, unnest(range(1, 65)) AS t(i)),
ends AS (SELECT i, min(x) AS lo, max(x) AS hi FROM each GROUP BY i),
near AS (SELECT id, list(lo + greatest(0, least({levels}, floor((x - lo) / (hi - lo) * {levels} + 0.5))) * ((hi - lo) / {levels}) ORDER BY i) AS x FROM each JOIN ends USING (i) GROUP BY id),
pool AS ({_ranked(_pairs("l2", base="near"), pool)}),
pairs AS (SELECT query_id, doc_id, round({_DISTANCE["l2"].format("b.x", "a.x")}, 6) AS distance FROM pool JOIN q a ON a.id = query_id JOIN v b ON b.id = doc_id)
{_ranked("SELECT * FROM pairs")}
"""


SQL["scalar_quantised_search"] = _scalar_quantised(15, 30)
SQL["scalar8_quantised_search"] = _scalar_quantised(255, 100)
SQL["stored_filtered_search"] = SQL["knn_routed"]
SQL["streamed_index"] = SQL["knn_l2"]
SQL["stored_list_filter"] = _knn("l2", "b.id BETWEEN 20 AND 219 AND b.label IN (2, 5)")
SQL["vector_files"] = """
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first,
  round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 6) AS square, CAST(len(embedding) AS INTEGER) AS dimensions
FROM embeddings
"""
SQL["near_pairs"] = f"""
WITH v AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS x FROM embeddings GROUP BY ALL)
SELECT query_id AS a, doc_id AS b, distance FROM ({_pairs("l2", "a.id < b.id", "v", "v")}) WHERE distance <= 1.1
"""
SQL["kmeans_update"] = f"""
WITH {_VECTORS}, {_PARTS},
far AS (SELECT p.part, p.id, v.x, {_DISTANCE["l2_squared"].format("v.x", "c.x")} AS d FROM parts p JOIN v ON v.id = p.id JOIN v c ON c.id = p.part),
sums AS (SELECT part, count(*) AS n, sum(d) AS cost FROM far GROUP BY part)
SELECT CAST(sums.part AS INTEGER) AS list, n, round(cost, 6) AS cost, CAST(i - 1 AS INTEGER) AS dimension, round(avg(x[i]), 6) AS mean
FROM far JOIN sums ON sums.part = far.part, unnest(range(1, len(x) + 1)) AS t(i) GROUP BY ALL
"""
# the table is one leaf there, so its neighbour graph is exact
SQL["cluster_layers"] = f"""
WITH RECURSIVE {_VECTORS}, near AS ({_ranked(_pairs("l2", "a.id <> b.id", query="v"), 5)}),
core AS (SELECT query_id AS id, max(distance) AS core FROM near GROUP BY query_id),
edges AS (SELECT DISTINCT n.query_id AS a, n.doc_id AS b, greatest(n.distance, p.core, q.core) AS weight FROM near n JOIN core p ON p.id = n.query_id JOIN core q ON q.id = n.doc_id),
linked AS (SELECT a, b, weight FROM edges UNION SELECT b, a, weight FROM edges),
steps AS (SELECT * FROM (VALUES (0, 1.1), (1, 1.14), (2, 1.16), (3, 1.18), (4, 1.2)) AS t(layer, most)),
walk AS (SELECT layer, id, id AS root FROM steps, v UNION SELECT w.layer, e.b, w.root FROM walk w JOIN steps ON steps.layer = w.layer JOIN linked e ON e.a = w.id AND e.weight <= steps.most WHERE e.b > w.root),
members AS (SELECT layer, id, min(root) AS root FROM walk GROUP BY layer, id),
sizes AS (SELECT layer, root, count(*) AS n FROM members GROUP BY layer, root HAVING count(*) >= 3)
SELECT CAST(m.layer AS INTEGER) AS layer, m.id, s.root AS cluster, s.n FROM members m LEFT JOIN sizes s ON s.layer = m.layer AND s.root = m.root
"""
SQL["stored_after_changes"] = SQL["knn_live_set"]
SQL["knn_routed_probing"] = _knn("l2", "b.label < 5")
SQL["within_radius"] = f"WITH {_VECTORS} SELECT * FROM ({_pairs('l2', 'a.id <> b.id')}) WHERE distance <= 1.2"
SQL["knn_main_and_delta"] = f"""
WITH {_VECTORS}, live AS (SELECT id, CASE WHEN id % 5 = 0 THEN list_reverse(x) ELSE x END AS x FROM v WHERE id % 7 <> 0)
{_ranked(_pairs("l2", base="live"))}
"""
SQL["mean_recall"] = f"SELECT round(avg(recall), 6) AS mean_recall, count(*) AS n_queries FROM ({SQL['recall_at_k']})"
SQL["pooled_tokens"] = """
SELECT vec_id AS doc_id, CAST(i AS INTEGER) AS i, round((x[i + 1] + x[i + 17] + x[i + 33] + x[i + 49]) / 4, 6) AS m
FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), unnest(range(0, 16)) AS t(i)
"""

_LOG = """log AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, value FROM events),
last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)"""
SQL["live_rows"] = f"WITH {_LOG} SELECT id, seq, op, value FROM last WHERE op <> 'delete'"
SQL["streamed_live_rows"] = SQL["live_rows"]
SQL["hourly_changes"] = """
SELECT date_trunc('hour', ts) AS window_start, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'insert' ELSE 'update' END AS op, count(*) AS n FROM events GROUP BY ALL
"""
SQL["tombstones"] = f"WITH {_LOG} SELECT id, seq FROM last WHERE op = 'delete'"
SQL["merged_read"] = f"WITH {_LOG} SELECT id, seq, value FROM last WHERE op <> 'delete'"
SQL["buffer_state"] = f"""
WITH {_LOG}, two AS (SELECT *, lag(op) OVER (PARTITION BY id ORDER BY seq) AS before, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM log)
SELECT count(*) FILTER (op <> 'delete') AS staged, count(*) FILTER (op = 'delete' AND coalesce(before, 'delete') = 'delete') AS pending_deletes FROM two WHERE r = 1
"""
SQL["log_levels"] = f"""
WITH {_LOG}, aged AS (SELECT *, row_number() OVER (ORDER BY seq DESC, id DESC, op DESC) - 1 AS age FROM log),
held AS (SELECT aged.* FROM aged JOIN last USING (id, seq) WHERE last.op <> 'delete')
SELECT CASE WHEN age < 100 THEN 0 WHEN age < 500 THEN 1 WHEN age < 2100 THEN 2 WHEN age < 8500 THEN 3 ELSE 4 END AS level, count(*) AS n_live, min(seq) AS oldest, max(seq) AS newest FROM held GROUP BY 1
"""
SQL["space_use"] = f"""
WITH {_LOG}, s AS (SELECT (SELECT count(*) FROM log) AS stored, (SELECT count(*) FROM last WHERE op <> 'delete') AS live)
SELECT stored, live, round(stored / nullif(live, 0), 6) AS amplification, round(1 - live / stored, 6) AS dead_share, 1 - live / stored >= 0.2 AS compact FROM s
"""
