"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import pytest

from prosegauge.llm import ctw, gam, isomedia, kdshard, licences, lzprint, mixing, packing, simhash, toxicity
from prosegauge.llm.queries import tokenizer_path

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows=((1, 1, 0), (2, 1, 1), (3, 0, 0), (6, 0, 1), (None, 1, 1), (7, None, None), (9, 1, 0), (9, 0, 1))):
    return spark.createDataFrame(list(rows), LABELS)


OPERATORS = {
    "mix": lambda d, s: mixing.mix(d),
    "mixed_documents": lambda d, s: mixing.mixed_documents(d),
    "pack": lambda d, s: packing.pack(d, tokenizer_path()),
    "media": lambda d, s: isomedia.media_digest(isomedia.media_column(d)),
    "ctw": lambda d, s: ctw.score(d),
    "lz": lambda d, s: lzprint.compare_with_next(d),
    "lz_fingerprints": lambda d, s: lzprint.fingerprints(d),
    "simhash": lambda d, s: simhash.simhash_components(d),
    "near": lambda d, s: simhash.near_duplicates(d),
    "one_of_each": lambda d, s: simhash.one_of_each(d),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.fit(d, labels(s))),
    "toxicity_passing": lambda d, s: toxicity.passing(d, toxicity.fit(d, labels(s))),
    "licences": lambda d, s: licences.scan_licences(d),
    "shards": lambda d, s: kdshard.shard(d),
    "quality": lambda d, s: gam.score(d, gam.fit(d, labels(s))),
    "quality_passing": lambda d, s: gam.passing(d, gam.fit(d, labels(s))),
}
ONE_EACH = ["mix", "media", "ctw", "lz", "lz_fingerprints", "simhash", "near", "toxicity", "licences", "shards", "quality"]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, odd, name):
    rows = OPERATORS[name](odd, spark).collect()
    assert rows
    if name in ONE_EACH:
        assert len(rows) == odd.count()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](empty, spark).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_without_labels(spark, odd, name):
    none = spark.createDataFrame([], LABELS)
    module = {"toxicity": toxicity, "quality": gam}[name]
    scores = [r["score"] for r in module.score(odd, module.fit(odd, none)).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)


@pytest.mark.parametrize("name", ["mix", "media", "ctw", "lz_fingerprints", "simhash", "licences", "toxicity", "quality"])
def test_equal_rows_get_equal_values(spark, odd, name):
    rows = [r.asDict() for r in OPERATORS[name](odd, spark).collect() if r["doc_id"] in (1, 2)]
    skip = {"doc_id", "held_out", "taken", "copies", "slot", "source", "lang", "source_size", "target", "base_score", "score"} if name != "media" else {"doc_id"}
    assert {k: v for k, v in rows[0].items() if k not in skip} == {k: v for k, v in rows[1].items() if k not in skip}


def test_one_row(spark):
    one = spark.createDataFrame([(5, "only one text here", "en", "a")], "doc_id long, text string, lang string, source string")
    for name, f in OPERATORS.items():
        assert f(one, spark).count() >= 1 or name in ("quality_passing", "toxicity_passing"), name
