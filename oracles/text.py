"""SQL for ``opinion_spark.plans.text``."""

from __future__ import annotations

from oracles import fragments as f


def _per_document(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS out FROM documents"


def _joined(expression: str) -> str:
    return _per_document(f"coalesce(array_to_string({expression}, '|'), '')")


_LONG = f"WITH {f.docs_cte('doc_id')}, words AS (SELECT doc_id, unnest(tokens) AS term FROM docs)"
_LOWER = f"lambda t: lower({f.trim_ws('t')})"
_STEM = (
    "CASE WHEN length(term) <= 6 THEN term"
    " ELSE regexp_replace(term, '(tion|ing|ment)$', '') END"
)
_SCORES = f"""{_LONG}, {f.LEXICON_CTE},
scores AS (
  SELECT w.doc_id, sum(coalesce(l.weight, 0)) AS score
  FROM words w LEFT JOIN lexicon l ON w.term = l.word GROUP BY w.doc_id)"""
CLASSES = f"""{_SCORES},
classes AS (
  SELECT d.doc_id, d.lang, d.source, CAST(sign(coalesce(s.score, 0)) AS INTEGER) AS classified
  FROM documents d LEFT JOIN scores s ON d.doc_id = s.doc_id)"""

SQL: dict[str, str] = {
    "clean_escapes": _per_document(f.escapes("text")),
    "ascii_replace": _per_document(f.ascii_only("text")),
    "strip_mentions_urls": "SELECT page_id, "
    + f.squeeze(
        f.rx("url || ' ' || html", rf"([@#][A-Za-z0-9]+)|({f.WORD}+://{f.NOT_UWS}+)", " ")
    )
    + " AS out FROM pages",
    "strip_url_schemes": f"SELECT page_id, {f.no_schemes('url')} AS out FROM pages",
    "remove_numbers": _per_document(f.rx("text", r"\p{Nd}+", "")),
    "remove_punctuation": _per_document(f.no_punct("text")),
    "trim_whitespace": _per_document(f.trim_ws("(' ' || chr(9) || text || chr(10) || ' ')")),
    "collapse_whitespace": _per_document(f.rx("text", f"{f.UWS}+", " ")),
    "clean_text": _per_document(f.clean("text")),
    "clean_text_pages": "SELECT page_id, "
    + f.clean("(url || ' ' || html)")
    + " AS out FROM pages",
    "tokenize_words": _joined(f"list_transform({f.runs(f.breaks('text'))}, {_LOWER})"),
    "sentence_split": _joined(
        f"list_transform(string_split_regex({f.breaks('text')}, '[.?!][ \\n]'), {_LOWER})"
    ),
    "split_words": _joined(f"list_filter({f.runs('text')}, lambda t: NOT contains(t, ' '))"),
    "short_token_filter": _joined(
        f"list_filter({f.runs('text')}, lambda t: NOT contains(t, ' ') AND length(t) >= 2)"
    ),
    "clean_tokens": "WITH "
    + f.docs_cte("doc_id", stop=True)
    + " SELECT doc_id, coalesce(array_to_string(tokens, '|'), '') AS out FROM docs",
    "clean_sentences": f"""SELECT doc_id, coalesce(array_to_string(list_transform(
        string_split_regex({f.clean('text')}, '[.?!][ \\n]'), {_LOWER}), '|'), '') AS out
        FROM documents""",
    "stopword_substring": f"""WITH c AS (SELECT {f.clean('text')} AS c FROM documents),
        t AS (SELECT unnest({f.words('c')}) AS term FROM c)
        SELECT term, count(*) AS tf FROM t
        WHERE length(term) >= 2 AND NOT contains({f.BLOB}, term) GROUP BY term""",
    "stopword_anti_join": f"""{_LONG}
        SELECT term, count(*) AS tf FROM words
        WHERE term NOT IN (SELECT unnest(string_split({f.BLOB}, chr(10)))) GROUP BY term""",
    "vocab_stem": f"{_LONG} SELECT DISTINCT term, {_STEM} AS stem FROM words",
    "stem_documents": f"""WITH {f.docs_cte('doc_id')},
        words AS (SELECT doc_id, unnest(tokens) AS term,
                         generate_subscripts(tokens, 1) AS pos FROM docs),
        stems AS (SELECT doc_id, pos, {_STEM} AS stem FROM words)
        SELECT d.doc_id, coalesce(string_agg(stem, ' ' ORDER BY pos) FILTER (stem <> ''), '') AS preprocessed
        FROM documents d LEFT JOIN stems s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
    "stage_detail": f"""WITH c AS (SELECT doc_id, text, {f.clean('text')} AS cleaning FROM documents)
        SELECT doc_id, text, cleaning,
               coalesce(array_to_string({f.words('cleaning')}, '|'), '') AS tokenized,
               lower(coalesce(array_to_string({f.words('cleaning')}, ' '), '')) AS folding,
               coalesce(array_to_string({f.tokens('cleaning', True)}, '|'), '') AS tokens
        FROM c""",
    "preprocess_documents": "WITH "
    + f.docs_cte("doc_id", "lang", stop=True)
    + " SELECT doc_id, lang, coalesce(array_to_string(tokens, ' '), '') AS preprocessed FROM docs",
    "word_weight": f"""{_LONG}, {f.LEXICON_CTE}, terms AS (SELECT DISTINCT term FROM words)
        SELECT term, CAST(coalesce(weight, 0) AS INTEGER) AS weight
        FROM terms LEFT JOIN lexicon ON term = word""",
    "sentence_score": f"""{_LONG}
        SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN length(w.term) >= 4
                 THEN length(w.term) % 11 - 5 ELSE 0 END), 0) AS BIGINT) AS score
        FROM documents d LEFT JOIN words w ON d.doc_id = w.doc_id GROUP BY d.doc_id""",
    "sentence_score_text": f"""WITH {f.LEXICON_CTE},
        words AS (SELECT conv_id || ':' || turn AS id, unnest({f.runs('text')}) AS term
                  FROM conversations)
        SELECT id, CAST(sum(coalesce(weight, 0)) AS BIGINT) AS score
        FROM words LEFT JOIN lexicon ON term = word GROUP BY id""",
    "word_score_map": f"""{_LONG}, {f.LEXICON_CTE},
        pairs AS (SELECT DISTINCT doc_id, term FROM words)
        SELECT doc_id, term, CAST(coalesce(weight, 0) AS INTEGER) AS weight
        FROM pairs LEFT JOIN lexicon ON term = word""",
    "lexicon_classify": f"""{CLASSES}
        SELECT lang, classified, count(*) AS n FROM classes GROUP BY lang, classified""",
    "classify_documents": f"""{CLASSES},
        sizes AS (SELECT doc_id, count(DISTINCT term) AS n FROM words GROUP BY doc_id)
        SELECT c.doc_id, c.source, CAST(coalesce(n, 0) AS INTEGER) AS n_words, c.classified
        FROM classes c LEFT JOIN sizes s ON c.doc_id = s.doc_id""",
}
