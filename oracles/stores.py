"""SQL of what was written: reading it back must give the same rows."""

from __future__ import annotations

from oracles import corpus, evaluation, models

SQL = {
    "csv_round_trip": "SELECT doc_id, nullif(lang, '') AS lang, n_chars, coalesce(text, '') AS text FROM documents",
    "token_file": corpus.SQL["term_frequency"],
    "class_token_files": corpus.SQL["class_words"],
    "result_table": f"""SELECT r.*, run_id FROM ({evaluation.SQL["classification_report"]}) r,
        (SELECT unnest(['first', 'second']) AS run_id)""",
    "saved_model": models.SQL["gnb_predict"],
}
