"""SQL for ``opinion_spark.plans.corpus``."""

from __future__ import annotations

from opinion_spark.plans.relations import MATRIX_TERMS
from oracles import fragments as f
from oracles.models import TERM_PREDICTED
from oracles.text import CLASSES

_LONG = f"WITH {f.docs_cte('doc_id')}, words AS (SELECT doc_id, unnest(tokens) AS term FROM docs)"
_STOPPED = (
    f"WITH {f.docs_cte('doc_id', stop=True)}, "
    "words AS (SELECT doc_id, unnest(tokens) AS term FROM docs)"
)
_COUNTS = """
  n AS (SELECT count(*) AS n FROM documents),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
_CELLS = ", ".join(
    f"coalesce(round(sum(CASE WHEN tf.term = '{t}' THEN tf.tf * ln(n.n / df.df) END), 6), 0) + 0.0"
    f" AS t_{t}"
    for t in MATRIX_TERMS
)

SQL: dict[str, str] = {
    "global_words": f"{_STOPPED} SELECT doc_id, term AS word FROM words",
    "global_words_stored": f"{_LONG} SELECT term, count(*) AS tf FROM words GROUP BY term",
    "term_frequency": f"{_STOPPED} SELECT term, count(*) AS tf FROM words GROUP BY term",
    "char_frequency": """WITH c AS (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents)
        SELECT ch, count(*) AS n FROM c GROUP BY ch""",
    "vocabulary": f"{_STOPPED} SELECT DISTINCT term FROM words",
    "document_frequency": f"""{_LONG},
        {f.docs_cte(name='turns', source='conversations')},
        terms AS (SELECT DISTINCT unnest(tokens) AS term FROM turns),
        df AS (SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term)
        SELECT t.term, coalesce(df.df, 0) AS df FROM terms t LEFT JOIN df ON t.term = df.term""",
    "idf": f"{_LONG}, {_COUNTS} SELECT term, df, {f.six('ln(n.n / df.df)')} AS idf FROM df, n",
    "tfidf": f"""{_STOPPED}, {_COUNTS}
        SELECT doc_id, tf.term, tf.tf, {f.six('tf.tf * ln(n.n / df.df)')} AS weight
        FROM tf JOIN df ON tf.term = df.term, n""",
    "tf_per_document": f"""{_LONG}, {_COUNTS},
        {f.docs_cte(name='turns', source='conversations')},
        terms AS (SELECT DISTINCT unnest(tokens) AS term FROM turns)
        SELECT doc_id, tf.term, tf FROM tf JOIN terms ON tf.term = terms.term""",
    "doc_term_pivot": f"""{_LONG}, {_COUNTS}
        SELECT d.doc_id, {_CELLS} FROM documents d LEFT JOIN tf ON d.doc_id = tf.doc_id
        LEFT JOIN df ON tf.term = df.term, n GROUP BY d.doc_id""",
    "feature_vectors": f"""{_LONG}, {_COUNTS},
        numbered AS (SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS i FROM df),
        cells AS (SELECT doc_id, i, tf.tf * ln(n.n / df) AS w FROM tf JOIN numbered USING (term), n)
        SELECT d.doc_id, count(w) FILTER (w <> 0) AS n_terms, max(i) AS last_index,
               {f.six('coalesce(sum(w), 0)')} AS weight_sum,
               {f.six('coalesce(sum((i + 1) * w / 1000), 0)')} AS placed_sum
        FROM documents d LEFT JOIN cells c ON d.doc_id = c.doc_id GROUP BY d.doc_id""",
    "class_words": f"""{CLASSES}
        SELECT classified, term AS word, count(*) AS n
        FROM words w JOIN classes c ON w.doc_id = c.doc_id GROUP BY classified, term""",
    "predicted_class_words": f"""WITH {TERM_PREDICTED}
        SELECT y_pred, term AS word, count(*) AS n
        FROM words JOIN predicted USING (doc_id) GROUP BY y_pred, term""",
}
