"""The full profile of each document: one row with a struct per section, in one pass and without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicons import DEMO_TERMS, MATTR_WINDOW
from ..operators import lexical as lex
from ..operators import readability as read
from ..operators import screening, segment, style
from ..storage import small_batches

KNOWN = (segment.WORDS, segment.TOKENS, segment.SENTENCES, *segment.FOUND)


#: Arrays that rows carry as one string: an array of short strings takes several times their bytes.  None has a blank.
PACKED = (segment.WORDS, segment.TOKENS)


def _apart(name: str) -> Column:
    """The array that the string ``name`` of a packed row was."""
    return F.when(F.length(name) > 0, F.split(name, " ")).otherwise(F.array().cast("array<string>"))


def _found(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` with all that Python tells from their arrays, and words and tokens as one string each.  Rows wait in memory,
    or on disk, while Python has some of them (what the sockets take, besides a batch), so it comes first, where a row holds
    the text and its words once, and batches are bounded in bytes."""
    words, tokens = _apart(segment.WORDS), _apart(segment.TOKENS)
    packed = rows.withColumns({c: F.array_join(c, " ") for c in PACKED})
    return small_batches(packed).withColumns({
        segment.TOTALS: read.totals_column(words), segment.FACTS: lex.facts_column(tokens, window=window), segment.COUNTED: lex.counted_column(tokens),
        segment.NOMINALS: style.counted_class(words, style.is_nominalisation), segment.HEDGES: style.counted_class(words, style.is_hedge),
    })


def _with(rows: DataFrame, name: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``f`` finds as a struct ``name``.  The row itself goes along as the id, which every
    operator that works row by row hands on as it is."""
    known = [_apart(c).alias(c) if c in PACKED else F.col(c) for c in KNOWN]
    found = f(rows.select(F.struct("*").alias("doc_id"), "text", *known))
    return found.select("doc_id.*", F.struct(*[F.col(c) for c in found.columns if c != "doc_id"]).alias(name))


def _readability(df: DataFrame) -> DataFrame:
    inputs = read.inputs(df)
    basis = inputs.withColumns(read.basis_columns())
    return basis.select("doc_id", read.metrics_column().alias("metrics"), F.struct(*[c for c in basis.columns if c != "doc_id"]).alias("basis"), read.consensus_column().alias("consensus"))


def _tokens(df: DataFrame, window: int) -> DataFrame:
    """Everything that is told from the tokens alone."""
    f = F.col(segment.FACTS)
    struct = lambda columns: F.struct(*[c.alias(n) for n, c in columns.items()])
    words = lex.ranked_column(F.col(segment.COUNTED)).alias("frequencies")
    lexical = F.struct(*[c.alias(n) for n, c in lex.diversity_columns(f).items()], struct(lex.mattr_columns(f, window)).alias("mattr"), struct(lex.mtld_columns(f)).alias("mtld"), words)
    return df.select("doc_id", lexical.alias("lexical"), F.when(f["tokens"] > 0, struct(lex.zipf_columns(f))).alias("zipf"), F.when(f["points"] > 0, struct(lex.heaps_columns(f))).alias("heaps"))


def profile(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, screening_terms: Sequence[str] = tuple(DEMO_TERMS), mattr_window: int = MATTR_WINDOW, screened: bool = True) -> DataFrame:
    """doc_id, empty, counts, readability, lexical (with frequencies), zipf, heaps, style (with top lists and examples) and,
    if ``screened``, screening.

    Each text is segmented once; every section is a projection of its row.
    """
    rows = _found(segment.prepared(df, id_col, text_col), mattr_window)
    sections: dict[str, Callable[[DataFrame], DataFrame]] = {
        "counts": segment.counts, "readability": _readability, "_tokens_only": lambda d: _tokens(d, mattr_window),
        "_classes": lambda d: style.word_class_counts(d).drop("words"), "_tops": style.top_lists, "_passive": style.passive, "_rhythm": style.rhythm,
    }
    if screened:
        sections["screening"] = lambda d: screening.modes_columns(d, screening_terms)
    for name, f in sections.items():
        rows = _with(rows, name, f)
    styles = F.struct("_classes.*", "_tops.*", F.col("_passive").alias("passive"), F.col("_rhythm").alias("rhythm"))
    empty = F.col("counts.words") == 0
    return rows.select("doc_id", empty.alias("empty"), "counts", "readability", "_tokens_only.lexical", "_tokens_only.zipf", "_tokens_only.heaps", styles.alias("style"), *["screening"] * screened)
