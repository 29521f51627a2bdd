"""Text metrics over columns of documents, as Spark DataFrame operations."""

from importlib import import_module

#: Public names by module.  They are imported when asked for: Python workers import the package and need none of them.
_PUBLIC = {
    "functions.lexicons": "ABBREVIATIONS ALOUD_WPM BEFORE_NUMBER CAPITALIZED_ONLY COLLATERAL CONFUSABLES DATE_ABBREVIATIONS DATE_WORDS DEMO_TERMS HEDGES LEET LOWERCASE_ONLY MATTR_WINDOW MTLD_THRESHOLD READING_WPM SENTENCE_STARTERS SYLLABLE_EXCEPTIONS UNLISTED_LOOKALIKES",
    "functions.sentences": "sentences",
    "functions.syllables": "count_syllables is_complex syllables",
    "functions.text": "alphanumerics graphemes is_numeral letters normal_word numerals paragraphs spaces tokens types words",
    "operators.citations": "cite citations format_citations references references_by_check",
    "operators.evaluation": "cross_check every_kth sentence_eval syllable_errors syllable_eval syllable_histogram worst_syllables",
    "operators.lexical": "diversity facts frequencies heaps heaps_curve linear_fit mattr mtld ranked_counts top_words zipf zipf_of_documents zipf_points",
    "operators.readability": "COEFFICIENTS METRICS basis consensus inputs long_scores metrics terms_table",
    "operators.screening": "compare_modes count_matches evasion_report evasion_tally evasions highlight modes_columns normalize parsed_terms screen",
    "operators.segment": "counts segment sentence_table token_table word_table",
    "operators.style": "passive passive_examples passive_hits rhythm rhythm_histogram top_lists top_of_class word_class_counts",
    "plans.profile": "profile",
    "sources": "SAMPLES conllu_units documents_from_files documents_from_table samples syllable_dictionary",
    "sources.report": "report_text write_json write_text",
    "storage": "clear",
}
_MODULE_OF = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str) -> object:
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_MODULE_OF[name]}"), name)
