"""The named queries: each operator over the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions import lexicons as lx
from ..functions import text as t
from ..operators import citations, evaluation, screening, segment, style
from ..operators import lexical as lex
from ..operators import readability as read
from ..sources.report import report_text
from .oracle import METRIC_IDS, TERMS
from .profile import profile
from .source_queries import SOURCES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def longs(df: DataFrame) -> DataFrame:
    """Integers as longs, so that results have one integer type."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, IntegerType) else F.col(f.name) for f in df.schema.fields])


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of ``documents``, as they are."""
    return spread(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text, a blank line with a tab in it, and the text again: the tables themselves have no blank lines."""
    return docs(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n \t\n\n"), "text").alias("text"))


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A small file is one split; the tokenising stages want all cores.  Tables with enough splits stay as they are."""
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def query(name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: longs(f(spark, sf_dir))
        return f

    return add


def over_docs(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: longs(f(docs(spark, sf_dir)))


def present(df: DataFrame, where: Column, columns: dict[str, Column]) -> DataFrame:
    """doc_id and ``columns`` of the rows that ``where`` holds for.  A filter would be pushed below the projections and
    work out their expressions a second time; a generator is not."""
    return df.select("doc_id", F.inline(F.when(where, F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))))


def spiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with signs, look-alikes, full-width letters, combining marks and invisible characters put in."""
    text = t.text_or_empty(F.col("text"))
    for what, by in (("ti", "t1"), ("on", "о\u200bn"), ("as", "@$"), ("in", "ｉｎ"), ("er", "e\u0301r")):
        text = F.replace(text, F.lit(what), F.lit(by))
    return spread(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.alias("text")))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.text_or_empty(F.col("text")).alias("text")))


def register() -> None:
    # segmentation
    QUERIES["paragraphs"] = lambda spark, sf_dir: longs(twice(spark, sf_dir).select("doc_id", F.posexplode(t.paragraphs(t.text_or_empty(F.col("text")))).alias("para_idx", "paragraph")))
    over_docs("sentences", segment.sentence_table)
    QUERIES["sentences_of_paragraphs"] = lambda spark, sf_dir: longs(segment.sentence_table(twice(spark, sf_dir)))
    over_docs("words", segment.word_table)
    over_docs("numerals", lambda d: segment.word_table(d).filter(t.is_numeral(F.col("word"))))
    over_docs("normalize_word", segment.token_table)
    over_docs("types", lambda d: d.select("doc_id", F.posexplode(t.types(t.words(t.text_or_empty(F.col("text"))))).alias("type_idx", "token")))
    row = lambda f: lambda d: segment.base(d, "doc_id", "text").select("doc_id", *f(F.col("text")))
    over_docs("graphemes", row(lambda x: [t.graphemes(x).alias("graphemes")]))
    over_docs("letters", row(lambda x: [t.letters(x).alias("letters")]))
    over_docs("chars_alnum", row(lambda x: [t.alphanumerics(x).alias("chars_alnum")]))
    over_docs("chars_no_space", row(lambda x: [(t.graphemes(x) - t.spaces(x)).alias("chars_no_space")]))
    over_docs("reading_time", row(lambda x: [segment.minutes(F.size(t.words(x)), lx.READING_WPM).alias("reading_minutes"), segment.minutes(F.size(t.words(x)), lx.ALOUD_WPM).alias("aloud_minutes")]))
    over_docs("counts", segment.counts)
    over_docs("segment", lambda d: segment.segment(d).select("doc_id", F.col("word_count").alias("words"), "numerals", F.col("sentence_count").alias("sentences"), "letters", "graphemes", F.size("paragraphs").alias("paragraphs"), F.size("types").alias("types")))
    # syllables and readability
    over_docs("syllables", lambda d: read.word_facts(segment.word_table(d)).select("word", "syllables"))
    over_docs("complex_word", lambda d: read.word_facts(segment.word_table(d)).select("word", "complex"))
    for name in ("syllables_total", "polysyllables", "monosyllables", "complex_words"):
        over_docs(name, lambda d, n=name: read.inputs(d).select("doc_id", F.col("syllables" if n == "syllables_total" else n).alias(n)))
    for name, metric in METRIC_IDS.items():
        over_docs(name, lambda d, n=name, m=metric: present(read.inputs(d), read.usable(), {n: t.half_up(read.scores()[m], 1)}))
    over_docs("readability", read.long_scores)
    over_docs("readability_basis", read.basis)
    over_docs("readability_terms", read.terms_table)
    usable = lambda f: lambda d: present(read.inputs(d), read.usable(), f())
    over_docs("grade_text", usable(lambda: {"grade_text": read.grade_text(read.scores()["flesch-kincaid-grade"])}))
    over_docs("ease_text", usable(lambda: {"ease_text": read.ease_text(read.scores()["flesch-reading-ease"])}))
    over_docs("warnings", usable(lambda: {"numeral_warning": read.warning("gunning-fog"), "smog_warning": read.warning("smog"), "short_warning": read.warning("automated-readability-index")}))
    over_docs("grade_consensus", lambda d: read.inputs(d).select("doc_id", F.inline(F.array_compact(F.array(read.consensus_column())))))
    # diversity, frequencies, laws
    some = lambda *columns: lambda d: present(lex.diversity(d), F.col("tokens") > 0, {c: F.col(c) for c in columns})
    over_docs("lexical_profile", some("tokens", "types", "hapax", "dis_legomena", "ttr", "herdan_c", "hapax_ratio"))
    over_docs("ttr", some("ttr"))
    over_docs("herdan_c", some("herdan_c"))
    over_docs("hapax", some("hapax", "hapax_ratio"))
    over_docs("dis_legomena", some("dis_legomena"))
    over_docs("frequencies", lex.frequencies)
    over_docs("top_words", lex.top_words)
    over_docs("mattr", lex.mattr)
    over_docs("mattr_of_20", lambda d: lex.mattr(d, 20))
    over_docs("mtld", lambda d: lex.mtld(d).select("doc_id", t.half_up(F.col("forward"), 1).alias("forward"), t.half_up(F.col("backward"), 1).alias("backward"), "value", "note"))
    over_docs("mtld_at_half", lambda d: lex.mtld(d, 0.5).select("doc_id", "value", "note"))
    over_docs("zipf", lex.zipf_of_documents)
    over_docs("zipf_of_50_ranks", lambda d: lex.zipf_of_documents(d, max_rank=50, min_count=1))
    over_docs("zipf_of_any_series", lambda d: lex.zipf(lex.ranked_counts(d)))
    over_docs("zipf_points", lambda d: lex.zipf_points(d).select("doc_id", "rank", t.half_up(F.col("x"), 6).alias("x"), t.half_up(F.col("y"), 6).alias("y")))
    over_docs("heaps_curve", lex.heaps_curve)
    over_docs("heaps", lex.heaps)
    # style
    over_docs("passive_hits", style.passive_hits)
    over_docs("passive", lambda d: style.passive(d).select("doc_id", "sentences", "total", "share_of_sentences", F.size("examples").alias("examples")))
    over_docs("passive_examples", style.passive_examples)
    classes = lambda name: lambda d: style.word_class_counts(d).select("doc_id", name, f"{name}_percent")
    for name in ("nominalisations", "adverbs"):
        over_docs(name, classes(name))
    hedged = lambda f: lambda spark, sf_dir: longs(f(hedging(spark, sf_dir)))
    QUERIES["hedges"] = hedged(classes("hedges"))
    over_docs("top_nominalisations", lambda d: style.top_of_class(d, "nominalisations"))
    QUERIES["top_hedges"] = hedged(lambda d: style.top_of_class(d, "hedges"))
    over_docs("rhythm", lambda d: present(style.rhythm(d), F.col("count") > 0, {c: F.col(c) for c in ("count", "mean", "median", "sd", "min", "max", "longest_index", "longest_sentence", "note")}))
    over_docs("rhythm_histogram", style.rhythm_histogram)
    over_docs("style_profile", style_profile)


def hedging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with some of their frequent words made hedges: the invented prose has none."""
    text = F.col("text")
    for what, by in ((" the ", " very "), (" of ", " Perhaps "), (" de ", " quite ")):
        text = F.replace(text, F.lit(what), F.lit(by))
    return docs(spark, sf_dir).select("doc_id", text.alias("text"))


def style_profile(df: DataFrame) -> DataFrame:
    p = profile(df, screened=False)
    classes = [f"style.{k}{c}" for k in ("nominalisations", "hedges", "adverbs") for c in ("", "_percent")]
    rhythm = [F.col(f"style.rhythm.{c}").alias(n) for c, n in (("count", "worded_sentences"), ("mean", "mean"), ("median", "median"), ("sd", "sd"), ("min", "min"), ("max", "max"), ("longest_index", "longest_index"), ("longest_sentence", "longest_sentence"), ("note", "note"))]
    top = F.array_join(F.transform("style.top_nominalisations", lambda x: F.concat(x["word"], F.lit(":"), x["count"].cast("string"))), " ").alias("top_nominalisations")
    return p.select("doc_id", F.col("counts.words").alias("words"), *classes, *[f"style.passive.{c}" for c in ("sentences", "total", "share_of_sentences")], *rhythm, top)


def spiced_stage(name: str, f: Callable[[Column], Column]) -> None:
    QUERIES[name] = lambda spark, sf_dir: spiced(spark, sf_dir).select("doc_id", f(F.col("text")).alias("text"))


register()
spiced_stage("norm_invisible", screening.without_invisible)
spiced_stage("norm_nfkc", screening.nfkc)
spiced_stage("norm_confusables", screening.folded_confusables)
spiced_stage("norm_lower", F.lower)
spiced_stage("norm_leet", screening.undone_leet)
spiced_stage("norm_leet_inner", lambda c: screening.undone_leet(c, "inner"))
spiced_stage("norm_join_spaced", lambda c: screening.joined_letters(F.replace(c, F.lit("the"), F.lit("t h e"))))
spiced_stage("norm_collapse", lambda c: screening.collapsed(F.replace(c, F.lit("e"), F.lit("eee"))))
QUERIES["norm_diacritics"] = lambda spark, sf_dir: plain(spark, sf_dir).select("doc_id", screening.without_diacritics(F.lower("text")).alias("text"))


@query()
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fit = lex.linear_fit(rows, F.length("text"), F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))), ["source"])
    return fit.select("source", "n", t.half_up(F.col("slope"), 6).alias("slope"), t.half_up(F.col("intercept"), 3).alias("intercept"), t.half_up(F.col("r2"), 6).alias("r2"))


@query()
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.normalize(spiced(spark, sf_dir)).select("doc_id", "output", F.size(F.filter("steps", lambda s: s["changed"])).alias("changed_steps"))


@query()
def normalize_without_leet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.normalize(spiced(spark, sf_dir), leet=False, confusables=False, collapse=False).select("doc_id", "output")


@query()
def screen_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.count_matches(plain(spark, sf_dir), TERMS, "substring")


@query()
def screen_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.count_matches(plain(spark, sf_dir), TERMS, "word")


@query()
def screen_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.count_matches(spiced(spark, sf_dir), TERMS, "normalized")


@query()
def screen_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screen(plain(spark, sf_dir), TERMS, "substring")


@query()
def compare_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the examples as one text, a line for each."""
    rows = screening.compare_modes(spiced(spark, sf_dir), TERMS)
    return rows.withColumn("examples", F.array_join("examples", "\n"))


@query()
def compare_modes_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.modes_columns(spiced(spark, sf_dir), TERMS).select("doc_id", "summary")


@query()
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain(spark, sf_dir)
    return screening.highlight(rows, screening.screen(rows, TERMS, "word"))


@query()
def terms_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(spark, sf_dir).select("doc_id", screening.parsed_terms(F.col("text")).alias("l")).select("doc_id", F.size("l").alias("terms"), F.get("l", F.lit(0)).alias("first_term"))


@query()
def demo_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lx.DEMO_TERMS)), "idx long, term string")


@query()
def collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(x, w) for x, some in lx.COLLATERAL.items() for w in some], "term string, word string")
    return pairs.withColumn("contained", F.contains(F.lower("word"), F.col("term")))


@query()
def evasions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.evasions(demo_terms(spark, sf_dir))


@query()
def evasion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.evasion_report(demo_terms(spark, sf_dir))


@query()
def evasion_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.evasion_tally(evasion_report(spark, sf_dir))


# evaluation, citations, whole analyses


def vowel_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No gold data are at hand, so these queries show the operators at work with the vowel groups of the tables' words as
    gold; tests hold the operators against built gold."""
    words = segment.word_table(docs(spark, sf_dir)).select(F.lower("word").alias("word")).distinct()
    return words.select("word", F.array(F.greatest(F.lit(1), F.regexp_count("word", F.lit("[aeiouy]+")))).alias("counts"))


for _name, _f in (("syllable_eval", evaluation.syllable_eval), ("syllable_histogram", evaluation.syllable_histogram), ("worst_syllables", evaluation.worst_syllables)):
    QUERIES[_name] = lambda spark, sf_dir, f=_f: longs(f(vowel_groups(spark, sf_dir)))


@query()
def sentence_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With each document's lines as gold sentences: a demonstration, as above."""
    lines = F.filter(F.transform(F.split(t.text_or_empty(F.col("text")), "\n"), t.trimmed), lambda x: x != "")
    return evaluation.sentence_eval(docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), lines.alias("sentences")))


@query()
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six scores of every text against those of the same text in lower case."""
    d = docs(spark, sf_dir)
    ours = read.long_scores(d).withColumnRenamed("doc_id", "sample")
    theirs = read.long_scores(d.withColumn("text", F.lower("text"))).withColumnRenamed("doc_id", "sample")
    return evaluation.cross_check(ours, theirs)


@query()
def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.every_kth(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id"), "item_id", 7)


@query("citations")
def all_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citations(spark)


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("zipf1949",), ("sap2019",), ("nobody1900",)], "id string")


@query()
def format_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.format_citations(asked(spark))


@query()
def cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.cite(asked(spark))


@query()
def references_by_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.references_by_check(spark)


@query()
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.references(spark)


@query()
def analyze_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all sections of the profile, flat."""
    p = profile(docs(spark, sf_dir), screening_terms=TERMS)
    return p.select("doc_id", "empty", "counts.words", "counts.sentences", F.col("readability.metrics")[0]["value"].alias("reading_ease"), "readability.consensus.median", "lexical.ttr", F.col("lexical.mattr.value").alias("mattr"), F.col("lexical.mtld.value").alias("mtld"), "zipf.alpha", "heaps.beta", F.col("style.passive.total").alias("passives"), F.col("style.rhythm.sd").alias("rhythm_sd"), F.col("screening.word.total").alias("word_matches"))


@query("report_text")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_text(profile(docs(spark, sf_dir), screened=False))


for _name, _f in SOURCES.items():
    query(_name)(_f)
