"""Reports of a profile, as text or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def report_text(profile: DataFrame) -> DataFrame:
    """doc_id and report, a plain-text summary; null for a text without measurable words."""
    c, lines = F.col, []
    number = t.plain_number
    said = lambda *parts: lines.append(F.concat(*[F.coalesce(p, F.lit("-")) if not isinstance(p, str) else F.lit(p) for p in parts]))
    said("Text report")
    said(c("counts.words").cast("string"), " words, ", c("counts.sentences").cast("string"), " sentences, ", c("counts.paragraphs").cast("string"), " paragraphs")
    said("Readability")
    lines.append(F.array_join(F.transform(c("readability.metrics"), lambda m: F.concat(F.lit("  "), m["name"], F.lit(": "), number(m["value"]), F.lit("  ["), m["substituted"], F.lit("]"))), "\n"))
    said("Vocabulary")
    said("  distinct words: ", c("lexical.types").cast("string"))
    said("  TTR: ", number(c("lexical.ttr")), "   MATTR: ", number(c("lexical.mattr.value")), "   MTLD: ", number(c("lexical.mtld.value")))
    said("Style")
    said("  passive candidates: ", c("style.passive.sentences").cast("string"), " sentences")
    said("  nominalisations: ", number(c("style.nominalisations_percent")), "%")
    said("  sentence length: mean ", number(c("style.rhythm.mean")), ", sd ", number(c("style.rhythm.sd")), ", max ", c("style.rhythm.max").cast("string"))
    return profile.select("doc_id", F.when(F.size("readability.metrics") > 0, F.concat_ws("\n", *lines)).alias("report"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(reports: DataFrame, path: str) -> None:
    """One report per line group; ``reports`` has a column report."""
    reports.select("report").filter("report is not null").write.text(path, lineSep="\n\n")
