"""SQL building blocks shared by the oracle modules."""

from __future__ import annotations

from opinion_spark.plans.relations import LEXICON, STOPWORDS

WS = r"[\t-\r\x1c-\x20]"
NOT_WS = r"[^\t-\r\x1c-\x20]"
UWS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_UWS = "[^" + UWS[1:]
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def rx(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, '{pattern}', '{by}', 'g')"


def trim_ws(value: str, ws: str = UWS) -> str:
    return rx(value, rf"^{ws}+|{ws}+\z", "")


def squeeze(value: str, ws: str = UWS) -> str:
    return trim_ws(rx(value, f"{ws}+", " "), ws)


def escapes(value: str) -> str:
    for literal in (r"\t", r"\n", r"\u"):
        value = f"replace({value}, '{literal}', ' ')"
    return rf"replace({value}, '\', '')"


def ascii_only(value: str) -> str:
    return rx(value, r"[^\x00-\x7F]", "?")


def no_schemes(value: str) -> str:
    return f"replace(replace({value}, 'http://', ' '), 'https://', ' ')"


def no_punct(value: str) -> str:
    return rx(value, r"[!-/:-@\[-`{-~]", "")


def clean(value: str) -> str:
    """The cleaning chain, step by step."""
    value = ascii_only(escapes(value))
    value = squeeze(rx(value, rf"([@#][A-Za-z0-9]+)|([A-Za-z0-9_]+://{NOT_WS}+)", " "), WS)
    value = no_punct(rx(no_schemes(value), "[0-9]+", ""))
    return squeeze(value, WS)


BLOB = "concat_ws(chr(10), " + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"


def words(cleaned: str) -> str:
    """Word and separator runs without those that contain a space."""
    runs = f"regexp_extract_all({cleaned}, '[A-Za-z]+|[^A-Za-z]+')"
    return f"list_filter({runs}, lambda t: NOT contains(t, ' '))"


def tokens(cleaned: str, stop: bool = False) -> str:
    rule = f" AND NOT contains({BLOB}, t)" if stop else ""
    kept = f"list_filter({words(cleaned)}, lambda t: length(t) >= 2{rule})"
    return f"list_transform({kept}, lambda t: lower(t))"


def runs(value: str) -> str:
    """Split at non-word runs, keeping them; '' at an end that is a separator."""
    return (
        f"list_concat(list_concat(CASE WHEN regexp_matches({value}, '^{NOT_WORD}') OR {value} = ''"
        f" THEN [''] ELSE [] END, regexp_extract_all({value}, '{WORD}+|{NOT_WORD}+')),"
        f" CASE WHEN regexp_matches({value}, '{NOT_WORD}\\z') THEN [''] ELSE [] END)"
    )


def breaks(value: str) -> str:
    return f"translate({value}, chr(13) || chr(10), '  ')"


def docs_cte(*keep: str, stop: bool = False, name: str = "docs", source: str = "documents") -> str:
    """``docs(*keep, tokens)``."""
    columns = "".join(f"{k}, " for k in keep)
    return (
        f"{name}_c AS (SELECT {columns}{clean('text')} AS c FROM {source}), "
        f"{name} AS (SELECT {columns}{tokens('c', stop)} AS tokens FROM {name}_c)"
    )


LEXICON_ROWS = ", ".join(f"('{w}', {v})" for w, v in LEXICON)
LEXICON_CTE = f"lexicon(word, weight) AS (VALUES {LEXICON_ROWS})"


def significant(value: str) -> str:
    return f"round({value} / pow(10.0, floor(log10(greatest(abs({value}), 1e-9)))), 6) + 0.0"


def six(value: str) -> str:
    return f"round({value}, 6) + 0.0"
