"""Quality rules from distribution divergence, with built-in functions only.

Two histograms of a document are compared with those of its language by Jensen-Shannon distance (base 2, from 0 to
1): of character classes, and of common words. The language's histograms are counted over all documents that name the
language (NULL is a language of its own). A distance counts only above a minimum length, as a short text's
histogram is noise, and only against a language with enough words in all; what is not judged is kept.

A NULL text is empty, has no words and fails the base rule. Repeated rows count and are judged each. Columns with
other names pass through; ``add_verdict`` takes free names for what it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.vector import let
from opinion_spark.llm.store import landed

#: Character classes as patterns. Two more classes follow: blanks, and all other characters (small letters, mostly).
CLASSES = [r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]", r"[#*$%&|<>]"]
#: Common words of the languages, twelve each for English, German, French and Spanish.
COMMON_WORDS = sorted(
    set(
        """the of and a to in is that it for was with
        der die und in den von zu das mit sich auf ist
        de la le et les des en un du une est que
        de la que el en y los se del las un por""".split()
    )
)
#: A distance is too large above its limit, and also above its noise divided by the square root of the length, which
#: is how far a sound text of that length strays from its language by chance.
MAX_CLASS_DISTANCE, CLASS_NOISE = 0.18, 6.0
MAX_WORD_DISTANCE, WORD_NOISE = 0.20, 2.8
MIN_CHARS = 200
MIN_WORDS = 50
MIN_LANGUAGE_WORDS = 1_000

BLANKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def _count_of(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))


def class_counts(text: Column, words: Column) -> Column:
    """Characters per class of CLASSES, then blanks, then all others."""
    blanks = F.length(text) - F.length(F.array_join(words, ""))
    known = F.array(*[_count_of(text, p) for p in CLASSES], blanks)
    return let(known, lambda c: F.concat(c, F.array(F.length(text) - F.aggregate(c, F.lit(0), lambda a, x: a + x))))


def common_counts(text: Column) -> Column:
    """Occurrences of each common word (in lower case), the last element those of all other words."""
    every = words_of(F.lower(text))
    listed = F.array(*[F.lit(w) for w in COMMON_WORDS])

    def counted(all_words: Column) -> Column:
        return let(
            F.filter(all_words, lambda w: w.isin(COMMON_WORDS)),
            lambda found: F.concat(
                F.transform(listed, lambda w: F.size(found) - F.size(F.array_remove(found, w))),
                F.array(F.size(all_words) - F.size(found)),
            ),
        )

    return let(every, counted)


def js_distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; NULL if one is empty."""

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def of(pair: Column) -> Column:
        p, q = pair[0], pair[1]
        spread = F.zip_with(p, q, lambda x, y: (part(x, y) + part(y, x)) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(spread, F.lit(0.0), lambda a, x: a + x)))

    def shares(counts: Column) -> Column:
        return let(total(counts), lambda n: F.transform(counts, lambda x: x / n))

    usable = (total(left) > 0) & (total(right) > 0)
    return F.when(usable, let(F.array(shares(left), shares(right)), of))


def n_repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the text."""

    def hashed(w: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - 5), window)

    def exact(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.struct(F.array_join(F.slice(w, i + 1, 5), " ").alias("w"), i.alias("i"))
        )

        def repeated(s: Column) -> Column:
            at = lambda k: F.get(s, k)["w"]
            return F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), ((x["w"] == at(k - 1)) | (x["w"] == at(k + 1))).alias("twice"))),
                        lambda x: x["twice"],
                    ),
                    lambda x: x["i"],
                )
            )

        def covered(starts: Column) -> Column:
            gaps = F.transform(starts, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(starts, k + 1) - x, F.lit(5))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return let(let(F.sort_array(windows), repeated), covered)

    # Windows with distinct hashes are distinct; only texts with equal hashes are compared word by word.
    some = let(hashed(words), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 6, 0).when(some, exact(words)).otherwise(0)


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))
    )


def _counted(docs: DataFrame, text: str, lang: str, carry: tuple[str, ...]) -> DataFrame:
    """The one pass over the texts: counts of the base rules and both histograms per row."""
    return (
        docs.select(
            F.struct(*[F.col(c) for c in carry]).alias("_row"), F.col(lang).alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text")
        )
        .withColumn("_words", words_of(F.col("_text")))
        .select(
            "_row",
            "_lang",
            F.size("_words").cast("long").alias("n_words"),
            F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
            _count_of(F.col("_text"), r"[#*$%&|<>]").cast("long").alias("n_symbols"),
            n_dup_lines(F.col("_text")).cast("long").alias("n_dup_lines"),
            n_repeat_words(F.col("_words")).cast("long").alias("n_repeat_words"),
            F.length("_text").alias("_chars"),
            class_counts(F.col("_text"), F.col("_words")).alias("_classes"),
            common_counts(F.col("_text")).alias("_common"),
        )
    )


def language_references(counted: DataFrame) -> DataFrame:
    """A row per language: ``lang`` and the summed histograms ``classes`` and ``common``. Partial sums leave the map side, so a
    language that holds most rows is no hot key."""
    sizes = {"classes": len(CLASSES) + 2, "common": len(COMMON_WORDS) + 1}
    sums = counted.groupBy(F.col("_lang").alias("lang")).agg(
        *[F.sum(F.get(f"_{name}", F.lit(i))).alias(f"{name}{i}") for name, n in sizes.items() for i in range(n)]
    )
    return sums.select("lang", *[F.array(*[F.col(f"{name}{i}") for i in range(n)]).alias(name) for name, n in sizes.items()])


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with the base counts, both distances, ``base_failed`` and ``kept``.

    The counts are landed, as the references are sums of them; the references are landed too, so that Spark knows their
    size and broadcasts them only when they are small.
    """
    counted = landed(_counted(docs, text, lang, carry))
    references = landed(language_references(counted))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    enough = F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x) >= MIN_LANGUAGE_WORDS
    joined = counted.join(references, F.col("_lang").eqNullSafe(F.col("lang")), "left").select(
        "*",
        F.when(enough & (F.col("_chars") >= MIN_CHARS), js_distance(F.col("_classes"), F.col("classes"))).alias("class_distance"),
        F.when(enough & (F.col("n_words") >= MIN_WORDS), js_distance(F.col("_common"), F.col("common"))).alias("word_distance"),
        failed.alias("base_failed"),
    )
    most_class = F.greatest(F.lit(MAX_CLASS_DISTANCE), CLASS_NOISE / F.sqrt("_chars"))
    most_word = F.greatest(F.lit(MAX_WORD_DISTANCE), WORD_NOISE / F.sqrt("n_words"))
    fits = F.coalesce(F.col("class_distance") <= most_class, F.lit(True)) & F.coalesce(F.col("word_distance") <= most_word, F.lit(True))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed"]
    return joined.select("_row.*", *names, (~F.col("base_failed") & fits).alias("kept"))


def kept_documents(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    whole = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return judged(whole, carry=("doc",)).where("kept").select("doc.*")
