"""Line-first cleaning in plain DataFrame expressions.

Every line is judged alone; lines that fail are removed; then a document goes that lost too much of its text or fails
the base rules. Nothing is exploded or shuffled: a row is one document throughout, at any length.

Defined results: null text has no words and no lines. Lines without a word count for nothing and stay. Repeated rows
and null ids are judged like others; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters between words, and the symbols that are counted.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Bits for the place of a word in its text, 33 million at most.
PLACE_BITS = 25
BETWEEN = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the loss a document may take."""

    #: Separators between menu entries, from which on a line is navigation.
    separators: int = 3
    #: Symbols, or words that end in ``!!``, per 100 words.
    symbols: int = 30
    shouts: int = 50
    #: A line of at least this many words must hold some punctuation.
    unpunctuated: int = 12
    #: Percent of the words that may go.
    loss: int = 40


#: What marks a line as boilerplate; lower-case, matched at the start of a word.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|licensed under|released under|terms of (use|service)|privacy policy|cookie policy|"
    r"accept cookies|click here|read more|sign up|log ?in|subscribe|share (this|on)|javascript)\b"
)
PUNCTUATION = r"[.,!?:;…]"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BETWEEN), lambda w: w != "")


def letters(text: Column) -> Column:
    """Code points of a text outside its separators."""
    return F.char_length(F.translate(text, SPACES, "")).cast("long")


def count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("long")


def with_repeats(docs: DataFrame, words: str, out: str) -> DataFrame:
    """Add how many words lie in a window of three words that the text holds at least twice.

    Every window becomes one number, hash bits above its place, and the numbers are sorted. Windows whose hash bits meet
    those of a neighbour are compared word by word with the neighbours next to them; the places of equal ones, in order,
    tell how many words they cover together. Each step is its own projection, so no array is built twice.
    """
    n, low = F.size(words), (1 << PLACE_BITS) - 1

    def number(w: Column, i: Column) -> Column:
        hashed = F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
        return hashed.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))

    numbers = F.transform(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), number)
    docs = docs.withColumn("_sorted", F.sort_array(numbers))

    def meets(x: Column, k: Column) -> Column:
        bits, none = F.shiftright(x, PLACE_BITS), F.lit(False)
        before, after = (F.shiftright(F.get("_sorted", k + d), PLACE_BITS) for d in (-1, 1))
        return F.coalesce(bits == before, none) | F.coalesce(bits == after, none)

    docs = docs.withColumn("_near", F.transform(F.filter("_sorted", meets), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
    docs = docs.drop("_sorted")

    def same(i: Column, j: Column) -> Column:
        parts = [F.get(words, i + d) == F.get(words, j + d) for d in range(3)]
        return F.coalesce(parts[0] & parts[1] & parts[2], F.lit(False))

    def repeated(i: Column, k: Column) -> Column:
        # Two steps each way, in case one window with other words but the same hash bits lies between.
        return same(i, F.get("_near", k - 1)) | same(i, F.get("_near", k + 1)) | same(i, F.get("_near", k - 2)) | same(i, F.get("_near", k + 2))

    docs = docs.withColumn("_places", F.sort_array(F.filter("_near", repeated))).drop("_near")
    fresh = F.transform("_places", lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get("_places", k - 1), F.lit(3))))
    return docs.withColumn(out, F.aggregate(fresh, F.lit(0).cast("long"), lambda a, x: a + x)).drop("_places")


def failing(x: Column, rules: Rules) -> Column:
    """Whether one line (struct of ``line`` and its words ``n``) breaks a rule on navigation, symbols, shouting,
    boilerplate or punctuation. A line without words breaks none."""
    line, n = x["line"], x["n"]
    shouts = F.regexp_count(line, F.lit(r"!!(?=[\x20\x09-\x0D]|$)"))
    return (n > 0) & (
        (count_of(line, "|»") >= rules.separators)
        | (100 * count_of(line, SYMBOLS) > rules.symbols * n)
        | (100 * shouts > rules.shouts * n)
        | line.rlike(BOILERPLATE)
        | ((n >= rules.unpunctuated) & ~line.rlike(PUNCTUATION))
    )


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Base figures, the cleaned text and the verdict for every document.

    Takes ``doc_id, text``; returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_words, cleaned_text, kept``.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("words", words_of(F.col("text")))
    docs = with_repeats(docs, "words", "n_repeat_words").withColumn("n_words", F.size("words").cast("long")).drop("words")
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    docs = docs.withColumn("lines", lines)
    full = F.filter("lines", lambda x: x["n"] > 0)
    docs = docs.withColumn("marked", F.transform("lines", lambda x: F.struct(x["line"], x["n"], failing(x, rules).alias("bad"))))
    lost = F.aggregate("marked", F.lit(0).cast("long"), lambda a, x: a + F.when(x["bad"], x["n"]).otherwise(0))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    docs = docs.withColumn("lost_words", lost).withColumn("base_failed", base)
    kept = ~F.col("base_failed") & (100 * F.col("lost_words") <= rules.loss * F.col("n_words"))
    good = F.transform(F.filter("marked", lambda x: ~x["bad"]), lambda x: x["line"])
    return docs.select(
        "doc_id", "n_words", letters(F.col("text")).alias("word_chars"), count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "base_failed", "lost_words", F.array_join(good, "\n").alias("cleaned_text"), kept.alias("kept"),
    )
