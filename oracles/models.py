"""SQL for ``opinion_spark.plans.models``."""

from __future__ import annotations

from oracles import fragments as f

_X = """x AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""

ASSIGNED = f"""{_X},
dist AS (
  SELECT a.vec_id, c.vec_id AS cluster, sum((a.v - c.v) * (a.v - c.v)) AS dist2
  FROM x a JOIN x c ON a.dim = c.dim AND c.vec_id < 5 GROUP BY a.vec_id, c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist2, cluster) AS r FROM dist),
assigned AS (
  SELECT vec_id, CAST(cluster AS INTEGER) AS kmean_label, dist2 FROM ranked WHERE r = 1)"""

_PARAMS = f"""{_X},
total AS (SELECT count(*) AS n FROM embeddings),
floors AS (SELECT 1e-9 * max(v) AS eps FROM (SELECT var_pop(v) AS v FROM x GROUP BY dim)),
params AS (
  SELECT label, dim, count(*) / any_value(total.n) AS prior, avg(v) AS mean,
         var_pop(v) + any_value(eps) AS var
  FROM x, total, floors GROUP BY label, dim)"""

PREDICTED = f"""{_PARAMS},
jll AS (
  SELECT x.vec_id, p.label, any_value(ln(p.prior))
         - 0.5 * sum(ln(2 * pi() * p.var)) - 0.5 * sum((x.v - p.mean) * (x.v - p.mean) / p.var) AS score
  FROM x JOIN params p ON x.dim = p.dim GROUP BY x.vec_id, p.label),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS r FROM jll),
predicted AS (SELECT vec_id, label AS y_pred, score FROM best WHERE r = 1)"""


def stratified(source: str, key: str, label: str, splits: int) -> str:
    """CTEs up to ``parts(split, key, label, is_test)``."""
    return f"""
sizes AS (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1),
whole AS (SELECT sum(n)::BIGINT AS total,
                 sum(n)::BIGINT - CAST(ceil(sum(n) * CAST(0.1 AS DOUBLE)) AS BIGINT) AS train FROM sizes),
shares AS (
  SELECT label, n, (n * train) // total AS base,
         row_number() OVER (ORDER BY (n * train) % total DESC, label) AS place
  FROM sizes, whole),
spare AS (SELECT any_value(train) - sum(base) AS extra FROM shares, whole),
quotas AS (
  SELECT label, n - base - CASE WHEN place <= extra THEN 1 ELSE 0 END AS quota FROM shares, spare),
numbers AS (SELECT CAST(unnest(range(1, {splits + 1})) AS INTEGER) AS split),
hashed AS (
  SELECT split, {key} AS key, {label} AS label,
         row_number() OVER (PARTITION BY split, {label} ORDER BY md5(split || ':' || {key})) AS place
  FROM {source}, numbers),
parts AS (
  SELECT split, key, h.label, place <= quota AS is_test
  FROM hashed h JOIN quotas q ON h.label = q.label)"""


_SPLIT_MODELS = f"""{_X}, {stratified('embeddings', 'vec_id', 'label', 10)},
train AS (SELECT p.split, x.label, x.dim, x.v FROM x JOIN parts p ON x.vec_id = p.key AND NOT is_test),
totals AS (SELECT split, count(*) AS n FROM parts WHERE NOT is_test GROUP BY split),
floors AS (
  SELECT split, 1e-9 * max(v) AS eps
  FROM (SELECT split, dim, var_pop(v) AS v FROM train GROUP BY split, dim) GROUP BY split),
params AS (
  SELECT t.split, label, dim, count(*) / any_value(n) AS prior, avg(v) AS mean,
         var_pop(v) + any_value(eps) AS var
  FROM train t JOIN totals o ON t.split = o.split JOIN floors f ON t.split = f.split
  GROUP BY t.split, label, dim),
jll AS (
  SELECT p.split, x.vec_id, x.label AS y_true, m.label, any_value(ln(m.prior))
         - 0.5 * sum(ln(2 * pi() * m.var)) - 0.5 * sum((x.v - m.mean) * (x.v - m.mean) / m.var) AS score
  FROM parts p JOIN x ON x.vec_id = p.key AND is_test
  JOIN params m ON m.split = p.split AND m.dim = x.dim
  GROUP BY p.split, x.vec_id, x.label, m.label),
best AS (
  SELECT *, row_number() OVER (PARTITION BY split, vec_id ORDER BY score DESC, label) AS r FROM jll),
pairs AS (SELECT split, y_true, label AS y_pred FROM best WHERE r = 1),
labels_ AS (SELECT DISTINCT split, l FROM (
  SELECT split, y_true AS l FROM pairs UNION ALL SELECT split, y_pred FROM pairs)),
per_label AS (
  SELECT b.split, b.l,
         count(*) FILTER (y_true = l AND y_pred = l) AS tp,
         count(*) FILTER (y_true = l) AS support,
         count(*) FILTER (y_pred = l) AS predicted
  FROM labels_ b JOIN pairs p ON b.split = p.split GROUP BY b.split, b.l)"""

_TERM_WEIGHTS = f"""{f.docs_cte('doc_id')},
lab AS (SELECT doc_id, quality AS label FROM labels WHERE quality IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents)),
words AS (SELECT doc_id, unnest(tokens) AS term FROM docs),
n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, tf.tf * ln(n.n / df.df) AS w FROM tf JOIN df USING (term), n)"""

_TERM_PARAMS = f"""{_TERM_WEIGHTS},
sizes AS (SELECT label, count(*) AS c FROM lab GROUP BY label),
cells AS (SELECT label, term, w FROM w JOIN lab USING (doc_id)),
s AS (SELECT label, term, sum(w) AS s1, sum(w * w) AS s2 FROM cells GROUP BY label, term),
per_term AS (
  SELECT term, sum(s2) / t.n - (sum(s1) / t.n) * (sum(s1) / t.n) AS v
  FROM s, (SELECT sum(c) AS n FROM sizes) t GROUP BY term, t.n),
floors AS (SELECT 1e-9 * max(v) AS eps FROM per_term),
params AS (
  SELECT z.label, p.term, z.c / (SELECT sum(c) FROM sizes) AS prior, coalesce(s1, 0) / z.c AS mean,
         greatest(coalesce(s2, 0) - coalesce(s1, 0) * (coalesce(s1, 0) / z.c), 0) / z.c + eps AS var
  FROM per_term p CROSS JOIN sizes z CROSS JOIN floors
  LEFT JOIN s ON s.term = p.term AND s.label = z.label)"""

# Absent cells are zeros: a class has a constant for the all-zero document, and each cell corrects it.
TERM_PREDICTED = f"""{_TERM_PARAMS},
base AS (
  SELECT label, ln(any_value(prior)) - 0.5 * sum(ln(2 * pi() * var) + mean * mean / var) AS base
  FROM params GROUP BY label),
adds AS (
  SELECT doc_id, label, sum(-0.5 * (w * w - 2 * w * mean) / var) AS add
  FROM w JOIN params USING (term) GROUP BY doc_id, label),
jll AS (
  SELECT d.doc_id, b.label, b.base + coalesce(a.add, 0) AS score
  FROM documents d CROSS JOIN base b LEFT JOIN adds a ON a.doc_id = d.doc_id AND a.label = b.label),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS r FROM jll),
predicted AS (SELECT doc_id, label AS y_pred, score FROM best WHERE r = 1)"""

TEXT_KMEANS_STEP = f"""{_TERM_WEIGHTS},
firsts AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS cluster
           FROM (SELECT DISTINCT doc_id FROM w) QUALIFY cluster < 5),
centres AS (SELECT cluster, term, w AS value FROM w JOIN firsts USING (doc_id)),
base AS (SELECT cluster, -sum(value * value) AS base FROM centres GROUP BY cluster),
adds AS (
  SELECT doc_id, cluster, sum(2 * w * value) AS add FROM w JOIN centres USING (term) GROUP BY doc_id, cluster),
near AS (
  SELECT d.doc_id, b.cluster, round(b.base + coalesce(a.add, 0), 6) AS score
  FROM documents d CROSS JOIN base b LEFT JOIN adds a ON a.doc_id = d.doc_id AND a.cluster = b.cluster),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cluster) AS r FROM near),
assigned AS (SELECT doc_id, CAST(cluster AS INTEGER) AS cluster FROM best WHERE r = 1),
sizes AS (SELECT cluster, count(*) AS n FROM assigned GROUP BY cluster)
SELECT cluster, term, {f.six('sum(w) / any_value(n)')} AS value
FROM w JOIN assigned USING (doc_id) JOIN sizes USING (cluster) GROUP BY cluster, term"""

SQL: dict[str, str] = {
    "train_test_split": """WITH n AS (SELECT ceil(count(*) * CAST(0.1 AS DOUBLE)) AS k FROM labels),
        h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('109:' || doc_id)) AS r FROM labels)
        SELECT doc_id, r <= k AS is_test FROM h, n""",
    "stratified_shuffle_split": f"""WITH {stratified('labels', 'doc_id', 'quality', 5)}
        SELECT key AS doc_id, label AS quality, split, is_test FROM parts""",
    "kfold_contiguous": """WITH o AS (
          SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels)
        SELECT doc_id, CAST(CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1)
          ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // greatest(n // 10, 1) END AS INTEGER) AS fold
        FROM o""",
    "kmeans_assign": f"WITH {ASSIGNED} SELECT vec_id, kmean_label, {f.six('dist2')} AS dist2 FROM assigned",
    "kmeans_lloyd_step": f"""WITH {ASSIGNED}
        SELECT a.kmean_label AS cluster, CAST(x.dim AS INTEGER) AS dim, {f.six('avg(x.v)')} AS value
        FROM assigned a JOIN x ON a.vec_id = x.vec_id GROUP BY 1, 2""",
    "wcss_total": f"""WITH {_X}
        SELECT 1 AS k, {f.six('sum(s)')} AS wcss
        FROM (SELECT var_pop(v) * count(*) AS s FROM x GROUP BY dim)""",
    "wcss_sweep_facts": """SELECT CAST(unnest(range(1, 26)) AS INTEGER) AS k, count(*) AS n_rows, count(*)::BIGINT AS n_assigned,
        CAST(unnest(range(1, 26)) AS BIGINT) AS n_clusters, true AS same_sum, true AS below_total FROM embeddings""",
    "text_kmeans_step": f"WITH {TEXT_KMEANS_STEP}",
    "gnb_fit": f"""WITH {_PARAMS}
        SELECT label, CAST(dim AS INTEGER) AS dim, {f.six('prior')} AS prior, {f.six('mean')} AS mean,
               {f.six('var')} AS var FROM params""",
    "gnb_predict": f"WITH {PREDICTED} SELECT vec_id, y_pred, {f.six('score')} AS score FROM predicted",
    "nb_repeated_cv": f"""WITH {_SPLIT_MODELS}
        SELECT split, {f.six('sum(tp) / sum(support)')} AS accuracy,
          {f.six('sum(tp) / sum(predicted)')} AS micro_precision,
          {f.six('sum(tp) / sum(support)')} AS micro_recall,
          {f.six('avg(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END)')} AS macro_precision,
          {f.six('avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END)')} AS macro_recall
        FROM per_label GROUP BY split""",
    "gnb_fit_terms": f"""WITH {_TERM_PARAMS}
        SELECT label, term, {f.six('mean')} AS mean, {f.six('var')} AS var FROM params""",
    "gnb_predict_terms": f"""WITH {TERM_PREDICTED}
        SELECT doc_id, y_pred, {f.significant('score')} AS score FROM predicted""",
    "svm_linear_score": f"""WITH {_X},
        classes AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS c),
        s AS (SELECT vec_id, c, sum(v * ((7 * c + 3 * dim) % 11 - 5) / 10.0) AS score
              FROM x, classes GROUP BY vec_id, c),
        best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, c) AS r FROM s)
        SELECT vec_id, c AS y_pred, {f.six('score')} AS score FROM best WHERE r = 1""",
    "svm_sweep_facts": f"""WITH s AS (SELECT unnest([0.1, 1, 100, 1000, 10000, 100000])::DOUBLE AS v),
        points AS (SELECT 'linear' AS kernel, v AS c, 0.0::DOUBLE AS gamma FROM s
                   UNION ALL SELECT 'rbf', a.v, b.v FROM s a, s b),
        rows AS (SELECT label % 3 - 1 AS label, row_number() OVER (ORDER BY md5('109:' || vec_id)) AS r, count(*) OVER () AS n FROM embeddings),
        marked AS (SELECT label, r <= ceil(n * CAST(0.1 AS DOUBLE)) AS is_test FROM rows),
        sizes AS (SELECT label, count(*) AS n FROM marked WHERE NOT is_test GROUP BY label),
        pairs AS (SELECT count(*) AS n_machines, sum(a.n + b.n) AS n FROM sizes a JOIN sizes b ON a.label < b.label),
        test AS (SELECT count(*) AS n_rows, sum(label) AS label_sum FROM marked WHERE is_test)
        SELECT kernel, c AS "C", gamma, n_machines, {f.six("c * n * 0.75")} AS objective_at_zero, true AS improved,
               n_rows, n_rows AS n_scored, label_sum::BIGINT AS label_sum
        FROM points, pairs, test""",
    "rff_transform": f"""WITH {_X},
        js AS (SELECT CAST(unnest(range(0, 500)) AS INTEGER) AS j),
        p AS (SELECT vec_id, j, sum(v * ((7 * j + 3 * dim) % 11 - 5) / 10.0) AS a FROM x, js GROUP BY 1, 2)
        SELECT vec_id, j, {f.six('sqrt(2.0 / 500) * cos(a + j / 10.0)')} AS z FROM p""",
}
