"""Readers of documents and gold data, and writers of reports."""

from .gold import conllu_units, syllable_dictionary
from .samples import SAMPLES, samples
from .text_files import documents_from_files, documents_from_table

__all__ = ["SAMPLES", "conllu_units", "documents_from_files", "documents_from_table", "samples", "syllable_dictionary"]
