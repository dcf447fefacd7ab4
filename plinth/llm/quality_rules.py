"""Line-first cleaning, without leaving the row.

Each line is judged by punctuation, navigation, boilerplate, symbol and shouting rules; failing lines go; a
document that loses too much of its text is rejected. The repetition counts of a document come from arrays in
its own row: window hashes are compared with their neighbours after a sort, which only documents with a
repeated window pay for. There is no shuffle, so no key can be hot.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import WHITE, count_chars, let, solid_chars, words

#: What stands at the end of a complete line, in Latin, Greek, Cyrillic and Hebrew, Arabic, Indic, East and
#: South-East Asian, Armenian, Ethiopic and Mongolian text; and what separates entries of a menu or table.
ENDINGS = ".!?…:;\"'”’»)]" + "›“‘;·׃" + "؟۔؛" + "।॥෴" + "。！？：；｡．」』】》〉）" + "။៕៖๏๚๛" + "։՞՜" + "።፧፨፤" + "᠃᠉"
SEPARATORS = "|»›·•"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "uses cookies", "enable javascript", "subscribe to our newsletter", "click here", "sign up for",
    "skip to content", "powered by wordpress",
)
#: Phrases of other languages go to ``clean_lines`` as its parameter. A boilerplate phrase condemns a line of at most so many characters; in longer prose it is a mention.
BOILERPLATE_CHARS = 200


def _judged(text: Column, phrases: tuple[str, ...]) -> Column:
    """The rules on a line without white space at its ends; what they count is counted once."""
    spaces, marks = count_chars(text, " \t"), count_chars(text, SEPARATORS + SYMBOLS + "!")

    def marked(c: Column) -> Column:
        navigation = (c["separators"] >= 3) & (c["separators"] * 4 >= c["spaces"])
        symbols = (c["symbols"] >= 3) & (c["symbols"] * 10 >= c["solid"])
        shouting = (c["bangs"] >= 3) & (c["bangs"] * 3 >= c["spaces"])
        return navigation | symbols | shouting

    counts = F.struct(spaces.alias("spaces"), count_chars(text, SEPARATORS).alias("separators"), count_chars(text, SYMBOLS).alias("symbols"), count_chars(text, "!").alias("bangs"), solid_chars(text).alias("solid"))
    unfinished = ~F.lit(ENDINGS).contains(F.right(text, F.lit(1))) & (spaces >= 7)
    named = F.when(F.length(text) > BOILERPLATE_CHARS, False).otherwise(let(F.lower(text), lambda low: reduce(or_, (low.contains(phrase) for phrase in phrases), F.lit(False))))
    # Few lines have three marks at all, so few are counted mark by mark.
    return F.when(text == "", False).when(unfinished, True).when(marks >= 3, let(counts, marked) | named).otherwise(named)


def line_fails(line: Column, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    """Whether a line with a word breaks a rule; lines without a word never do."""
    return let(F.btrim(line, F.lit(WHITE)), lambda text: _judged(text, phrases))


def repeated_words(tokens: Column, window: int = 8) -> Column:
    """Words inside windows that occur at least twice in the array, the first occurrence included.

    ``window`` is a power of two: window hashes are made by doubling, from two hashes half as wide.
    """

    def covered(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        twice = lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        places = F.array_sort(F.transform(let(by_hash, twice), lambda x: x["p"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, p: F.struct((acc["n"] + p + window - F.greatest(acc["end"], p)).alias("n"), (p + window).alias("end"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(F.aggregate(places, start, step, lambda acc: acc["n"]))

    def doubled(hashes: Column, width: int) -> Column:
        if width == window:
            return covered(hashes)
        n = F.size(hashes) - width
        wider = F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, width + 1, n), lambda a, b: F.xxhash64(a, b))
        return let(wider, lambda h: doubled(h, 2 * width))

    enough = lambda hashes: F.when(F.size(hashes) <= window, 0).otherwise(doubled(hashes, 1))
    return let(F.transform(tokens, lambda w: F.xxhash64(w)), enough).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    with_word = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    return let(with_word, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def clean_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_words: int = 20,
    most_repeated_pct: int = 30,
    most_lost_pct: int = 50,
    phrases: tuple[str, ...] = BOILERPLATE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: id, cleaned_text, the base counts, lost_chars, base_failed, kept and the ``carry`` columns.

    ``kept`` is false where base_failed (fewer than ``least_words`` words, or more than ``most_repeated_pct`` in a
    hundred words in repeated 8-word windows) or where failing lines hold more than ``most_lost_pct`` in a hundred
    of the characters outside white space. ``phrases``, in lower case, mark short lines as boilerplate. Null and empty
    texts have counts of 0 and fail; very long texts are judged whole, in their row; a null id passes through; repeated
    rows are judged alike; an empty table gives an empty result; other columns only pass if they are in ``carry``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("_pl_id"), text.alias("_pl_text"), F.struct(F.lit(0).alias("_pl_none"), *(F.col(c) for c in carry)).alias("_pl_carry"))
    body = F.col("_pl_text")
    counted = base.select(
        "_pl_id", "_pl_carry",
        let(words(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("again"))).alias("_pl_words"),
        solid_chars(body).alias("word_chars"),
        count_chars(body, SYMBOLS).alias("n_symbols"),
        duplicate_lines(body).alias("n_dup_lines"),
        F.array_join(F.filter(F.split(body, "\n"), lambda line: ~line_fails(line, phrases)), "\n").alias("cleaned_text"),
    )
    n, again = F.col("_pl_words.n"), F.col("_pl_words.again")
    lost = F.col("word_chars") - solid_chars(F.col("cleaned_text"))
    failed = (n < least_words) | (100 * again > most_repeated_pct * n)
    return counted.select(
        F.col("_pl_id").alias(id_col), "cleaned_text", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", again.alias("n_repeat_words"),
        lost.alias("lost_chars"), failed.alias("base_failed"), (~failed & (100 * lost <= most_lost_pct * F.col("word_chars"))).alias("kept"),
        *(F.col("_pl_carry")[c].alias(c) for c in carry),
    )
