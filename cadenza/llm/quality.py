"""Quality rules: lines are cleaned first, then documents that lost too much text are rejected.

Every figure of a document is computed inside its row by array functions, so the plan is one scan without a shuffle.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bound, table, words

#: Fixed phrases of page furniture; a line of at most BOILERPLATE_WORDS words that has one of them is removed.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "read more",
    "sign in",
    "subscribe to our newsletter",
    "terms of use",
)
BOILERPLATE_WORDS = 12

#: A line of more than BOILERPLATE_WORDS words.
_LONG = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{BOILERPLATE_WORDS}}}[^\x20\x09-\x0D]"


def _count(text, pattern: str):
    """Characters of text in matches of pattern; runs of matches are taken out at once."""
    return F.length(text) - F.length(F.regexp_replace(text, f"(?:{pattern})+", ""))


def repeated_words(w) -> F.Column:
    """Number of places of the word array w that lie in a 3-word window found twice or more in w."""
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))
    def places(h):
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.transform(
            F.array(by_hash),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        F.transform(
                            s,
                            lambda x, i: F.when(
                                F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]), x["i"]
                            ),
                        ),
                        lambda p: p.isNotNull(),
                    ),
                    lambda p: F.coalesce(p, F.lit(0)),
                )
            ),
        )[0]
    def covered(p):
        return F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))),
            F.lit(0),
            lambda a, b: a + b,
        )
    counted = F.transform(
        F.array(windows),
        lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), F.transform(F.array(places(h)), covered)[0]
        ).otherwise(F.lit(0)),
    )[0]
    return F.when(n >= 3, counted).otherwise(F.lit(0)).cast("long")


def line_fails(line, max_symbols: float = 0.25, min_bars: int = 3, max_upper: float = 0.6) -> F.Column:
    """True where a line breaks a rule. A line without a word never fails.

    Punctuation: more than max_symbols characters of #*$%&<> a word, or runs of !! after every third word at least.
    Navigation: min_bars or more bars between its words, at least one for every three words.
    Shouting: over max_upper of its letters are capitals, in lines of three words or more.
    Boilerplate: a short line with one of the fixed phrases.
    """
    # Cheap questions come first: words are only counted in lines that they let through, all of which have some.
    n = F.size(words(line))
    bars = _count(line, r"[|>»·]")
    phrase = reduce(lambda a, b: a | b, [F.contains(F.lower(line), F.lit(x)) for x in BOILERPLATE])
    return (
        (line.rlike(r"[#*$%&<>]") & (_count(line, r"[#*$%&<>]") > max_symbols * n))
        | (F.contains(line, F.lit("!!")) & (_count(line, r"!!") * 3 >= 2 * n))
        | (line.rlike(r"[|>»·]") & (bars >= min_bars) & (bars * 3 >= n))
        | ((_count(line, r"\p{Lu}") > max_upper * _count(line, r"\p{L}")) & (n >= 3))
        | (~line.rlike(_LONG) & phrase)
    )


def quality_rules(
    docs: DataFrame, text: str = "text", max_lost: float = 0.5, min_words: int = 50, max_repeat: int = 50
) -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
    clean_text and kept added (columns of docs with these names are replaced).

    clean_text: the lines that pass line_fails(), joined. kept is false if base_failed (fewer than min_words words, or
    more than max_repeat % of them in repeated 3-word windows) or if over max_lost of the words were in removed lines.
    A null or empty text has no word: all figures are 0, base_failed is true. Repeated rows get equal figures; an
    empty table gives an empty one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    full = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("bad")))
    out = bound(docs, {"_w": words(t), "_full": full, "_judged": judged})
    good = F.transform(F.filter("_judged", lambda x: ~x["bad"]), lambda x: x["line"])
    bad = F.filter("_judged", lambda x: x["bad"])
    kept = bound(
        out,
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
            "n_symbols": _count(t, r"[#*$%&|<>]").cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_w")),
            "clean_text": F.array_join(good, "\n"),
            "lost_words": F.aggregate(bad, F.lit(0), lambda n, x: n + F.size(words(x["line"]))).cast("long"),
        },
    ).drop("_w", "_full", "_judged")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    passed = ~failed & (F.col("lost_words") <= max_lost * F.col("n_words"))
    return kept.withColumns({"base_failed": failed, "kept": passed})


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_words", "kept"
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Kept documents with their failing lines removed; n_chars follows the text."""
    names = docs.columns
    return (
        quality_rules(docs)
        .where("kept")
        .withColumn("text", F.col("clean_text"))
        .withColumn("n_chars", F.length("text").cast("long"))
        .select(*names)
    )
