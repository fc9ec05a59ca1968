"""Cleaning and tokenising as native Column expressions.

Everything here is a narrow projection: no UDF, no shuffle. Character classes are
spelled out because ``\\w`` and ``\\s`` are ASCII-only in Java regular expressions
while the results to match follow Unicode rules.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinion_spark.functions.vector import let

# Unicode whitespace, word characters, the 32 ASCII punctuation marks.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"\p{L}\p{N}_"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_ASCII_SPACE = r"\t-\r\x1c-\x20"
# Digits, punctuation and everything outside ASCII, as ranges (a negated class is slow).
_DROPPED = r"!-@\[-`{-~\x{80}-\x{10FFFF}"



def _mention_or_link(word: str, space: str) -> str:
    # A link may only start at the first character of a word run, or right where the
    # previous match ended (\G). Any later start would have matched earlier, so the
    # result is that of plain \w+://\S+ but long unbroken runs stay linear.
    return rf"[@#][A-Za-z0-9]+|(?:(?<![{word}])|\G)[{word}]++://[^{space}]+"


def clean_escapes(text: Column) -> Column:
    """Literal ``\\t``, ``\\n`` and ``\\u`` become a space; other backslashes go away."""
    for escape in ("\\t", "\\n", "\\u"):
        text = F.replace(text, F.lit(escape), F.lit(" "))
    return F.replace(text, F.lit("\\"), F.lit(""))


def ascii_replace(text: Column) -> Column:
    """Every non-ASCII code point becomes one question mark."""
    return F.regexp_replace(text, r"[\x{80}-\x{10FFFF}]", "?")


def strip_mentions_urls(text: Column) -> Column:
    """Mentions, hashtags and links become a space, then whitespace is collapsed."""
    return trim_whitespace(
        collapse_whitespace(F.regexp_replace(text, _mention_or_link(WORD, SPACE), " "))
    )


def strip_url_schemes(text: Column) -> Column:
    """Left-over ``http://`` and ``https://`` become a space."""
    for scheme in ("http://", "https://"):
        text = F.replace(text, F.lit(scheme), F.lit(" "))
    return text


def remove_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}+", "")


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def trim_whitespace(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]+", " ")


def _has_any(text: Column, *parts: str) -> Column:
    found = [F.contains(text, F.lit(p)) for p in parts]
    return reduce(lambda a, b: a | b, found)


def clean_text(text: Column) -> Column:
    """The whole cleaning chain, in as few passes over the text as give the same result.

    * Non-ASCII characters are dropped together with punctuation and digits. Replacing
      them by ``?`` first makes no difference: in the mention and link patterns they act
      like ``?`` already, and ``?`` is punctuation.
    * Whitespace is collapsed once, at the end; no earlier step depends on its amount.
    * The costly steps run only on texts that contain one of their marks.
    """
    text = F.when(_has_any(text, "\\"), clean_escapes(text)).otherwise(text)
    text = let(text, _without_links)
    text = F.regexp_replace(text, f"[{_DROPPED}]+", "")
    # Blank runs other than a single space.
    blanks = rf"[\t-\r\x1c-\x1f][{_ASCII_SPACE}]*|\x20[{_ASCII_SPACE}]+"
    return F.trim(F.regexp_replace(text, blanks, " "))


def _without_links(text: Column) -> Column:
    pattern = _mention_or_link("A-Za-z0-9_", _ASCII_SPACE)
    stripped = strip_url_schemes(F.regexp_replace(text, pattern, " "))
    return F.when(_has_any(text, "@", "#", "://"), stripped).otherwise(text)


def _breaks_to_spaces(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def _runs(text: Column) -> Column:
    """Word runs and separator runs in order; an outer '' where a separator is at an end."""
    empty = _no_tokens()
    edge = F.array(F.lit(""))

    def parts(c: Column) -> Column:
        return F.concat(
            F.when(c.rlike(rf"^[^{WORD}]|^\z"), edge).otherwise(empty),
            F.regexp_extract_all(c, F.lit(f"[{WORD}]+|[^{WORD}]+"), F.lit(0)),
            F.when(c.rlike(rf"[^{WORD}]\z"), edge).otherwise(empty),
        )

    return let(text, parts)


def tokenize_words(text: Column) -> Column:
    """Words and the separators between them, trimmed and lower-cased."""
    return F.transform(_runs(_breaks_to_spaces(text)), lambda t: F.lower(trim_whitespace(t)))


def sentence_split(text: Column) -> Column:
    """Sentences: split at ``.``, ``?`` or ``!`` followed by a blank; trimmed, lower-cased."""
    parts = F.split(_breaks_to_spaces(text), r"[.?!][ \n]")
    return F.transform(parts, lambda t: F.lower(trim_whitespace(t)))


def split_words(text: Column) -> Column:
    """Words and separators, without the parts that contain a space."""
    return F.filter(_runs(text), lambda t: ~F.contains(t, F.lit(" ")))


def clean_words(cleaned: Column) -> Column:
    """``split_words`` for text that went through ``clean_text``.

    Such text consists of ASCII letters and single spaces, control characters being the
    only other separators; without these, splitting at the space is all there is to do.
    """

    def words(c: Column) -> Column:
        runs = F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
        exact = F.filter(runs, lambda t: ~F.contains(t, F.lit(" ")))
        simple = F.when(c == "", _no_tokens()).otherwise(F.split(c, " "))
        return F.when(c.rlike(r"[\x00-\x1f\x7f]"), exact).otherwise(simple)

    return let(cleaned, words)


def _no_tokens() -> Column:
    return F.array().cast("array<string>")


def drop_short(tokens: Column, at_least: int = 2) -> Column:
    """Drop empty tokens and tokens of fewer than ``at_least`` characters."""
    return F.filter(tokens, lambda t: F.char_length(t) >= at_least)


def is_stopword(token: Column, stopwords: Iterable[str], mode: str = "substring") -> Column:
    """Whether a token counts as a stop word.

    ``substring``: the token occurs anywhere in the stop-word text (case-sensitive).
    ``exact``: the token equals a stop word.
    """
    words = list(stopwords)
    if mode == "exact":
        return token.isin(sorted(set(words))) if words else F.lit(False)
    if mode == "substring":
        return F.contains(F.lit("\n".join(words)), token)
    raise ValueError(f"unknown stop-word mode: {mode!r}")


def drop_stopwords(tokens: Column, stopwords: Iterable[str], mode: str = "substring") -> Column:
    """Remove stop words from a token array, row by row (no shuffle).

    Substring tests search the stop-word text; exact tests are one probe of a literal set. For long exact lists
    use ``vocabulary.stopword_anti_join``.
    """
    words = list(stopwords)
    return F.filter(tokens, lambda t: ~is_stopword(t, words, mode))


def clean_tokens(
    text: Column, stopwords: Iterable[str] = (), mode: str = "substring", cleaned: bool = False
) -> Column:
    """Clean, split, drop short tokens and stop words, fold case."""
    text = text if cleaned else clean_text(text)
    words = list(stopwords)
    if not words:
        return drop_short(clean_words(F.lower(text)))
    kept = drop_stopwords(drop_short(clean_words(text)), words, mode)
    return F.transform(kept, lambda t: F.lower(t))


def clean_sentences(text: Column) -> Column:
    """Clean, then split into sentences."""
    return sentence_split(clean_text(text))


def word_count(text: Column) -> Column:
    """Number of parts when split at single spaces; 0 for missing text."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.split(text, " ")))


def characters(text: Column) -> Column:
    """The characters of a text, one array element per code point ('' for empty text)."""
    return F.split(text, "")
