"""Segmentation and counts, row by row: no shuffle, and the same plan on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.lexicons import ALOUD_WPM, READING_WPM
from ..functions.sentences import sentences


#: Columns of a frame that ``prepared`` has segmented; operators that find them do not segment again.
WORDS, TOKENS, SENTENCES = "_words", "_tokens", "_sentences"
#: What Python tells from these arrays, in a frame that has them already: syllable totals, facts of the tokens, counted
#: tokens, nominalisations and hedges.
TOTALS, FACTS, COUNTED, NOMINALS, HEDGES = FOUND = ("_totals", "_facts", "_counted", "_nominals", "_hedges")


def base(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and text, null texts empty; and the arrays of a prepared frame, with what is found of them."""
    kinds = dict(df.dtypes)
    known = [WORDS, TOKENS, SENTENCES] if all(kinds.get(c) == "array<string>" for c in (WORDS, TOKENS, SENTENCES)) else []
    known += [c for c in FOUND if known and c in kinds]
    return df.select(F.col(id_col).alias("doc_id"), t.text_or_empty(F.col(text_col)).alias("text"), *known)


def words_of(df: DataFrame) -> Column:
    return F.col(WORDS) if WORDS in df.columns else t.words(F.col("text"))


def tokens_of(df: DataFrame) -> Column:
    return F.col(TOKENS) if TOKENS in df.columns else t.tokens(words_of(df))


def sentences_of(df: DataFrame) -> Column:
    return F.col(SENTENCES) if SENTENCES in df.columns else sentences(F.col("text"))


def prepared(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the arrays of words, tokens and sentences that several operators start from."""
    rows = base(df, id_col, text_col).select("doc_id", "text")
    rows = rows.withColumns({WORDS: t.words(F.col("text")), SENTENCES: sentences(F.col("text"))})
    return rows.withColumn(TOKENS, t.tokens(F.col(WORDS)))


def segment(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, paragraphs, sentences, words, types, word_count, numerals, sentence_count, letters, graphemes."""
    rows = base(df, id_col, text_col).withColumns({"paragraphs": t.paragraphs(F.col("text")), "sentences": sentences(F.col("text")), "words": t.words(F.col("text"))})
    return rows.withColumns({
        "types": t.types(F.col("words")), "word_count": F.size("words"), "numerals": F.size(t.numerals(F.col("words"))), "sentence_count": F.size("sentences"),
        "letters": t.letters(F.col("text")), "graphemes": t.graphemes(F.col("text")),
    })


def minutes(words: Column, per_minute: int) -> Column:
    return t.half_up(words / F.lit(per_minute), 1)


def counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per document."""
    rows = base(df, id_col, text_col)
    text = F.col("text")
    rows = rows.withColumns({"_w": words_of(rows), "characters": t.graphemes(text), "_t": F.array_distinct(tokens_of(rows))})
    return rows.select(
        "doc_id", "characters", (F.col("characters") - t.spaces(text)).alias("characters_no_spaces"), t.letters(text).alias("letters"), F.size("_w").alias("words"), F.size(t.numerals(F.col("_w"))).alias("numerals"),
        F.size(sentences_of(rows)).alias("sentences"), F.size(t.paragraphs(text)).alias("paragraphs"), F.size("_t").alias("types"), minutes(F.size("_w"), READING_WPM).alias("reading_minutes"), minutes(F.size("_w"), ALOUD_WPM).alias("aloud_minutes"),
    )


def sentence_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_idx (from 0), sentence."""
    rows = base(df, id_col, text_col)
    return rows.select("doc_id", F.posexplode(sentences_of(rows)).alias("sent_idx", "sentence"))


def word_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos (from 0), word."""
    rows = base(df, id_col, text_col)
    return rows.select("doc_id", F.posexplode(words_of(rows)).alias("pos", "word"))


def token_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, pos (from 0), token: the normal forms that are not empty."""
    rows = base(df, id_col, text_col)
    return rows.select("doc_id", F.posexplode(tokens_of(rows)).alias("pos", "token"))
