"""Where the formulas and figures come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, authors string, year int, title string, source string, locator string, url string, verified string"

# Bibliographic records.
CITATIONS = [
    ("flesch1948", "Flesch, R.", 1948, "A new readability yardstick", "Journal of Applied Psychology", "32(3), 221-233", None, "secondary"),
    ("kincaid1975", "Kincaid, J. P., Fishburne, R. P., Rogers, R. L., & Chissom, B. S.", 1975, "Derivation of new readability formulas (Automated Readability Index, Fog Count and Flesch Reading Ease Formula) for Navy enlisted personnel", "Naval Technical Training Command, Millington TN", "Research Branch Report 8-75", None, "secondary"),
    ("gunning1952", "Gunning, R.", 1952, "The Technique of Clear Writing", "McGraw-Hill", None, None, "secondary"),
    ("clauset2009", "Clauset, A., Shalizi, C. R., & Newman, M. E. J.", 2009, "Power-law distributions in empirical data", "SIAM Review", "51(4), 661-703", "https://doi.org/10.1137/070710111", "secondary"),
    ("mclaughlin1969", "McLaughlin, G. H.", 1969, "SMOG grading: A new readability formula", "Journal of Reading", "12(8), 639-646", None, "secondary"),
    ("coleman1975", "Coleman, M., & Liau, T. L.", 1975, "A computer readability formula designed for machine scoring", "Journal of Applied Psychology", "60(2), 283-284", None, "secondary"),
    ("senter1967", "Senter, R. J., & Smith, E. A.", 1967, "Automated Readability Index", "Aerospace Medical Research Laboratories, Wright-Patterson AFB", "AMRL-TR-66-220", "https://apps.dtic.mil/sti/citations/AD0667273", "secondary"),
    ("dubay2004", "DuBay, W. H.", 2004, "The Principles of Readability", "Impact Information", None, None, "secondary"),
    ("bailin2016", "Bailin, A., & Grafstein, A.", 2016, "Readability: Text and Context", "Palgrave Macmillan", None, None, "secondary"),
    ("covington2010", "Covington, M. A., & McFall, J. D.", 2010, "Cutting the Gordian knot: The moving-average type-token ratio (MATTR)", "Journal of Quantitative Linguistics", "17(2), 94-100", None, "secondary"),
    ("mccarthy2010", "McCarthy, P. M., & Jarvis, S.", 2010, "MTLD, vocd-D, and HD-D: A validation study of sophisticated approaches to lexical diversity assessment", "Behavior Research Methods", "42(2), 381-392", None, "secondary"),
    ("herdan1960", "Herdan, G.", 1960, "Type-Token Mathematics: A Textbook of Mathematical Linguistics", "Mouton", None, None, "secondary"),
    ("zipf1949", "Zipf, G. K.", 1949, "Human Behavior and the Principle of Least Effort", "Addison-Wesley", None, None, "secondary"),
    ("heaps1978", "Heaps, H. S.", 1978, "Information Retrieval: Computational and Theoretical Aspects", "Academic Press", None, None, "secondary"),
    ("piantadosi2014", "Piantadosi, S. T.", 2014, "Zipf's word frequency law in natural language: A critical review and future directions", "Psychonomic Bulletin & Review", "21(5), 1112-1130", "https://pmc.ncbi.nlm.nih.gov/articles/PMC4176592/", "secondary"),
    ("williams1981", "Williams, J. M.", 1981, "Style: Ten Lessons in Clarity and Grace", "Scott, Foresman", None, None, "secondary"),
    ("brysbaert2019", "Brysbaert, M.", 2019, "How many words do we read per minute? A review and meta-analysis of reading rate", "Journal of Memory and Language", "109, 104047", "https://biblio.ugent.be/publication/8647789", "secondary"),
    ("cmudict", "Carnegie Mellon University Speech Group", 2014, "The CMU Pronouncing Dictionary (cmudict 0.7b)", "Carnegie Mellon University", None, "https://github.com/cmusphinx/cmudict", "primary"),
    ("unicodeTr39", "Davis, M., & Suignard, M. (eds.)", 2023, "Unicode Technical Standard #39: Unicode Security Mechanisms", "The Unicode Consortium", None, "https://www.unicode.org/reports/tr39/", "primary"),
    ("unicodeTr15", "Davis, M., & Whistler, K. (eds.)", 2023, "Unicode Standard Annex #15: Unicode Normalization Forms", "The Unicode Consortium", None, "https://www.unicode.org/reports/tr15/", "primary"),
    ("hosseini2017", "Hosseini, H., Kannan, S., Zhang, B., & Poovendran, R.", 2017, "Deceiving Google's Perspective API built for detecting toxic comments", "arXiv preprint", "arXiv:1702.08138", "https://arxiv.org/abs/1702.08138", "primary"),
    ("sap2019", "Sap, M., Card, D., Gabriel, S., Choi, Y., & Smith, N. A.", 2019, "The risk of racial bias in hate speech detection", "Proceedings of ACL 2019", "1668-1678", "https://aclanthology.org/P19-1163/", "primary"),
    ("gorwa2020", "Gorwa, R., Binns, R., & Katzenbach, C.", 2020, "Algorithmic content moderation: Technical and political challenges in the automation of platform governance", "Big Data & Society", "7(1)", "https://journals.sagepub.com/doi/10.1177/2053951719897945", "primary"),
]


def citations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CITATIONS, SCHEMA)


def formatted() -> Column:
    """A record as one line."""
    head = F.concat(F.col("authors"), F.lit(" ("), F.col("year").cast("string"), F.lit("). "), F.col("title"), F.lit("."))
    return F.concat(F.concat_ws(", ", head, F.col("source"), F.col("locator")), F.lit("."))


def format_citations(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """id and reference for every row of ``ids``; an unknown id is its own reference."""
    known = F.broadcast(citations(ids.sparkSession).select(F.col("id").alias("_id"), formatted().alias("_line")))  # 23 rows
    return ids.join(known, F.col(id_col) == F.col("_id"), "left").select(F.col(id_col).alias("id"), F.coalesce("_line", F.col(id_col)).alias("reference"))


def cite(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """The known records among ``ids``."""
    return ids.select(F.col(id_col).alias("id")).join(F.broadcast(citations(ids.sparkSession)), "id")


def references(spark: SparkSession) -> DataFrame:
    """place, id, line, checked: all records by year and authors."""
    rows = citations(spark).withColumn("line", formatted())
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy("year", F.collate(F.col("authors"), "UNICODE"), "id"))  # 23 rows
    return rows.select(place.alias("place"), "id", "line", F.when(F.col("verified") == "primary", "source read").otherwise("cross-checked").alias("checked"))


def references_by_check(spark: SparkSession) -> DataFrame:
    """verified and how many records are so."""
    return citations(spark).groupBy("verified").agg(F.count("*").alias("records"))
