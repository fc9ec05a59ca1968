"""SQL for ``opinion_spark.plans.tables``."""

from __future__ import annotations

_LABELLED = """SELECT d.doc_id, d.lang, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
_TAG = "regexp_extract(text, '#[A-Za-z0-9]+', 0)"
_WORDS = "CAST(len(string_split(text, ' ')) AS INTEGER)"
_STACKED = """
    SELECT doc_id AS id, text, NULL::BIGINT AS turn, 'documents' AS source_name, 0 AS keyword
    FROM documents
    UNION ALL SELECT item_id, text, NULL, 'benchmark', 1 FROM benchmark
    UNION ALL SELECT conv_id, text, turn, 'conversations', 2 FROM conversations"""

SQL: dict[str, str] = {
    "scan_documents": "SELECT * FROM documents",
    "scan_projected": "SELECT doc_id, lang, n_chars FROM documents",
    "tagged_sources": _STACKED,
    "lexicon_dedup": """SELECT concat_ws('-', c_mktsegment, c_nationkey) AS word,
        CAST(arg_max(floor(c_acctbal), c_custkey) AS BIGINT) AS weight
        FROM customer GROUP BY 1""",
    "named_dataset": "SELECT vec_id, label FROM embeddings",
    "drop_columns": "SELECT doc_id, lang, source FROM documents",
    "label_encode": """SELECT o_orderkey,
        CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 WHEN 'P' THEN 0 END AS classified,
        o_orderpriority FROM orders""",
    "bool_encode": "SELECT doc_id, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS verified FROM labels",
    "category_encode_other": """SELECT event_id,
        CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS code
        FROM events""",
    "presence_flag": f"""SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 END AS has_label
        FROM ({_LABELLED})""",
    "nonempty_flag": f"""SELECT doc_id, {_TAG} AS hashtag,
        CASE WHEN {_TAG} = '' THEN 0 ELSE 1 END AS hashtag_vp FROM documents""",
    "fill_zero": f"""SELECT doc_id, lang, coalesce(quality, 0) AS quality,
        coalesce(toxic, 0) AS toxic, CAST(0 AS BIGINT) AS item_id FROM ({_LABELLED})
        UNION ALL SELECT 0, '0', 0, 0, item_id FROM benchmark""",
    "filter_class": "SELECT doc_id, lang, source FROM documents WHERE lang = 'de'",
    "point_lookup": "SELECT * FROM documents WHERE doc_id = 7",
    "distinct_values": "SELECT DISTINCT lang, source FROM documents",
    "word_count": f"SELECT doc_id, {_WORDS} AS word_count FROM documents",
    "predictor_table": f"""SELECT d.doc_id AS id, text,
          CASE WHEN {_TAG} = '' THEN 0 ELSE 1 END AS hashtags,
          n_chars AS followers_count,
          CAST(coalesce(quality, 0) AS BIGINT) AS friends_count,
          CAST(coalesce(toxic, 0) AS BIGINT) AS favourites_count,
          CAST(0 AS BIGINT) AS favorite_count, CAST(0 AS BIGINT) AS retweet_count,
          CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS verified,
          CASE WHEN source = 'src1' THEN 2 ELSE 3 END AS source,
          {_WORDS} AS word_count, '' AS classified, 0 AS keyword
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        UNION ALL
        SELECT conv_id, text, CASE WHEN {_TAG} = '' THEN 0 ELSE 1 END, turn, 0, 0, 0, 0,
          CASE WHEN role = 'user' THEN 1 ELSE 0 END,
          CASE WHEN role = 'user' THEN 0 ELSE 3 END, {_WORDS}, '', 2
        FROM conversations""",
    "union_outer_columns": f"SELECT id, text, turn FROM ({_STACKED})",
    "consolidate_sources": """SELECT doc_id AS id, text, 'documents' AS part FROM documents
        UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark
        UNION ALL SELECT conv_id, text, 'conversations' FROM conversations
        UNION ALL SELECT page_id, html, 'pages' FROM pages""",
    "attach_columns_by_position": """
        WITH d AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
             l AS (SELECT quality, toxic, row_number() OVER (ORDER BY doc_id) AS r FROM labels)
        SELECT d.doc_id, d.lang, l.quality, l.toxic FROM d LEFT JOIN l ON d.r = l.r""",
}
