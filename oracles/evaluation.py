"""SQL for ``opinion_spark.plans.evaluation``."""

from __future__ import annotations

from oracles import fragments as f
from oracles.models import PREDICTED

_TAIL = """
seen AS (SELECT DISTINCT l FROM (
  SELECT y_true AS l FROM pairs UNION ALL SELECT y_pred FROM pairs)),
cells AS (
  SELECT a.l AS y_true, b.l AS y_pred,
         (SELECT count(*) FROM pairs p WHERE p.y_true = a.l AND p.y_pred = b.l) AS n
  FROM seen a, seen b),
per_label AS (
  SELECT l, sum(CASE WHEN y_true = l AND y_pred = l THEN n ELSE 0 END) AS tp,
         sum(CASE WHEN y_true = l THEN n ELSE 0 END) AS support,
         sum(CASE WHEN y_pred = l THEN n ELSE 0 END) AS predicted
  FROM seen, cells GROUP BY l),
scored AS (
  SELECT l, support,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS p,
         CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r,
         CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1
  FROM per_label),
micro AS (SELECT sum(tp) / sum(support) AS acc, sum(support) AS support FROM per_label)"""
_PAIRS = f"WITH pairs AS (SELECT quality AS y_true, toxic AS y_pred FROM labels), {_TAIL}"
_MODEL = f"""WITH {PREDICTED},
pairs AS (SELECT e.label AS y_true, p.y_pred FROM embeddings e JOIN predicted p USING (vec_id)), {_TAIL}"""
_FLAT = "(SELECT string_agg(CAST(n AS VARCHAR), ',' ORDER BY y_true, y_pred) FROM cells)"
_WEIGHTED = "sum({c} * support) / sum(support)"

SQL: dict[str, str] = {
    "confusion_matrix": f"{_PAIRS} SELECT y_true, y_pred, n FROM cells",
    "confusion_flat": f"{_PAIRS} SELECT {_FLAT} AS flat",
    "accuracy": f"{_PAIRS} SELECT {f.six('acc')} AS accuracy FROM micro",
    "micro_scores": f"""{_PAIRS}
        SELECT {f.six('acc')} AS micro_precision, {f.six('acc')} AS micro_recall FROM micro""",
    "macro_scores": f"""{_PAIRS}
        SELECT {f.six('avg(p)')} AS macro_precision, {f.six('avg(r)')} AS macro_recall FROM scored""",
    "classification_report": f"""{_PAIRS}
        SELECT CAST(l AS VARCHAR) AS label, {f.six('p')} AS precision, {f.six('r')} AS recall,
               {f.six('f1')} AS f1, CAST(support AS BIGINT) AS support FROM scored
        UNION ALL
        SELECT 'accuracy', {f.six('acc')}, {f.six('acc')}, {f.six('acc')}, CAST(support AS BIGINT) FROM micro
        UNION ALL
        SELECT 'macro avg', {f.six('avg(p)')}, {f.six('avg(r)')}, {f.six('avg(f1)')},
               CAST(sum(support) AS BIGINT) FROM scored
        UNION ALL
        SELECT 'weighted avg', {f.six(_WEIGHTED.format(c='p'))}, {f.six(_WEIGHTED.format(c='r'))},
               {f.six(_WEIGHTED.format(c='f1'))}, CAST(sum(support) AS BIGINT) FROM scored""",
    "model_report": f"""{_MODEL}
        SELECT {f.six('any_value(acc)')} AS accuracy, {f.six('any_value(acc)')} AS micro_precision,
               {f.six('any_value(acc)')} AS micro_recall, {f.six('avg(p)')} AS macro_precision,
               {f.six('avg(r)')} AS macro_recall, {_FLAT} AS flat
        FROM scored, micro""",
    "grid_score_summary": f"""WITH cs AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS c),
        folds AS (
          SELECT c, vec_id % 10 AS fold, avg(CASE WHEN label % c = 0 THEN 1.0 ELSE 0.0 END) AS score
          FROM embeddings, cs GROUP BY 1, 2),
        s AS (SELECT c, avg(score) AS m, 2 * stddev_pop(score) AS d FROM folds GROUP BY c)
        SELECT c, {f.six('m')} AS mean_score, {f.six('d')} AS two_std,
               row_number() OVER (ORDER BY m DESC, c) = 1 AS is_best FROM s""",
}
