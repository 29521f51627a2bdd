"""Readability, lexical, style and screening operators on fixtures with known results."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from prosegauge.functions import lexicons as lx
from prosegauge.operators import citations, evaluation, screening, segment, style
from prosegauge.operators import lexical as lex
from prosegauge.operators import readability as read
from prosegauge.plans.profile import _apart, _found, profile
from prosegauge.sources import conllu_units, documents_from_files, samples, syllable_dictionary
from prosegauge.sources.report import report_text, write_json, write_text


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def by_id(df):
    return [r.asDict() for r in df.orderBy("doc_id").collect()]


def test_scores(spark):
    rows = {(r["doc_id"], r["metric"]): r["value"] for r in read.long_scores(docs(spark, "The committee approved the revised budget proposal yesterday.", "", None, "2026 4500 12.", "Hello.")).collect()}
    assert rows[0, "flesch-reading-ease"] == 18.9
    assert {i for i, _ in rows} == {0, 4} and all(v == v for v in rows.values())


def test_inputs(spark):
    a, b = by_id(read.inputs(docs(spark, "The cat sat on the mat. The dog ran fast.", "The cat sat on the mat 2026. The dog ran 12 fast.")))
    assert (a["words"], a["sentences"], a["syllables"]) == (10, 2, 10)
    assert (b["words"], b["numerals"], b["alphabetic_words"], b["syllables"]) == (12, 2, 10, 10)


def test_basis_without_words(spark):
    a, b = by_id(read.basis(docs(spark, " \n", "2026 4500 12.")))
    assert a["empty"] and not a["numerals_only"] and not b["empty"] and b["numerals_only"] and b["syllables_per_word"] is None


def test_metrics_say_how(spark):
    (row,) = read.metrics(docs(spark, "The committee approved the revised budget proposal yesterday.")).collect()
    ease = row["metrics"][0]
    assert ease["substituted"] == "206.835 − 1.015 × 8 − 84.6 × 2.125" and ease["terms"][1]["detail"] == "17 / 8"
    assert ease["warning"] and row["metrics"][3]["warning"].startswith("Defined for 30 sentences")


def test_word_order_does_not_matter(spark):
    text = "many different complicated words were written down by someone reasonable yesterday".split()
    mixed = random.Random(1).sample(text, len(text))
    a, b = [[r["value"] for r in read.long_scores(docs(spark, " ".join(x).capitalize() + ".")).orderBy("metric").collect()] for x in (text, mixed)]
    assert a == b


def test_mattr(spark):
    a, b, c = by_id(lex.mattr(docs(spark, "a b c a b b", "a b", ""), 3))
    assert (a["value"], a["windows"]) == (0.917, 4) and (b["value"], b["windows"], b["window"]) == (1.0, 1, 2) and (c["value"], c["windows"]) == (None, 0)


def test_mtld(spark):
    assert lex.mtld_pass(["a", "b", "c"]) is None and lex.mtld_pass([]) is None
    a, b = by_id(lex.mtld(docs(spark, "a b c", " ".join(["one two three one two"] * 30))))
    assert a["value"] is None and a["forward"] is None and b["value"] > 0


def test_diversity(spark):
    a, b, c, d = by_id(lex.diversity(docs(spark, "a b c", "a a b b", "", "a")))
    assert (a["ttr"], b["ttr"], c["ttr"]) == (1.0, 0.5, None) and c["tokens"] == 0 and d["herdan_c"] is None and b["dis_legomena"] == 2


def test_frequencies_in_order(spark):
    rows = lex.frequencies(docs(spark, "b a a c c")).orderBy("rank").collect()
    assert [(r["word"], r["count"]) for r in rows] == [("a", 2), ("c", 2), ("b", 1)]


def series(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values, 1)], "doc_id long, rank int, count double")


def test_zipf(spark):
    (r,) = lex.zipf(series(spark, [10000 / i for i in range(1, 201)])).collect()
    assert abs(r["alpha"] - 1) < 0.01 and r["r2"] > 0.999 and r["intercept"] == pytest.approx(4, abs=0.01)
    assert lex.zipf(series(spark, [10000 / i for i in range(1, 201)]), max_rank=20).first()["fitted"] == 20
    (r,) = lex.zipf(series(spark, [100 / i + 2 for i in range(1, 31)] + [1] * 170)).collect()
    assert (r["fitted"], r["fit_min_count"], r["fit_max_rank"]) == (30, 2, 30)
    (r,) = lex.zipf(series(spark, [3, 2, 2] + [1] * 57)).collect()
    assert (r["fitted"], r["fit_min_count"]) == (60, 1)
    assert lex.zipf(series(spark, [3, 1])).first()["alpha"] is None


def test_linear_fit(spark):
    df = spark.createDataFrame([(1, x, 3.0 * x + 7) for x in range(5)] + [(2, 1, 1.0), (3, 1, 2.0), (3, 1, 4.0), (4, 1, 5.0), (4, 2, 5.0)], "k int, x int, y double")
    rows = {r["k"]: (round(r["slope"], 9), round(r["intercept"], 9), round(r["r2"], 9)) for r in lex.linear_fit(df, F.col("x"), F.col("y"), ["k"]).collect()}
    assert rows == {1: (3, 7, 1), 2: (0, 0, 0), 3: (0, 3, 0), 4: (0, 5, 0)}


def test_heaps(spark):
    a, = lex.heaps(docs(spark, " ".join("one two three four five six seven eight nine ten".split() * 30), "a b c")).collect()
    assert a["doc_id"] == 0 and a["beta"] < 1
    assert lex.heaps_curve(docs(spark, "a b c")).count() == 0


def test_passives(spark):
    text = "The bill was passed by the senate. The window was broken. It was not clearly stated. The senate passed the bill. The results were mixed. The window got broken."
    hits = [(r["sent_idx"], r["auxiliary"], r["participle"]) for r in style.passive_hits(docs(spark, text)).orderBy("sent_idx").collect()]
    assert hits == [(0, "was", "passed"), (1, "was", "broken"), (2, "was", "stated"), (4, "were", "mixed")]
    a, b = by_id(style.passive(docs(spark, text, "")))
    assert (a["sentences"], a["total"], a["share_of_sentences"], len(a["examples"])) == (4, 4, 66.7, 4) and b["share_of_sentences"] == 0.0


def test_word_classes(spark):
    words = {r["word"] for r in style.top_of_class(docs(spark, "The implementation and investigation of nations; a question of the nation at the moment."), "nominalisations").collect()}
    assert words == {"implementation", "investigation", "nations"}
    assert by_id(style.word_class_counts(docs(spark, "This is very really quite obviously true.")))[0]["hedges"] == 4


def test_rhythm(spark):
    a, b, c = by_id(style.rhythm(docs(spark, "One two three. A b c d e f g h i j.", "", "! One two. Three four five.")))
    assert (a["min"], a["max"], a["count"]) == (3, 10, 2) and b["count"] == 0
    assert c["longest_index"] == 1 and c["longest_sentence"] == "One two."  # a wordless sentence shifts it
    same = by_id(style.rhythm(docs(spark, "One two three four. " * 6)))[0]
    assert same["sd"] == 0.0 and same["note"] == "uniform"


def test_deviations_have_the_last_place_of_the_sql(spark):
    lengths = [[11, 1, 1, 1, 1], [1, 11, 1, 6, 1], *[[random.Random(i).randint(1, 40) for _ in range(i % 30 + 1)] for i in range(200)]]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, l array<int>").withColumn("sd", style._deviation(F.col("l")))
    assert [r["sd"] for r in by_id(rows)] == [duckdb.execute("SELECT stddev_pop(x) FROM (SELECT unnest(?) AS x)", [x]).fetchone()[0] for x in lengths]
    text = " ".join(" ".join(["Word", *["word"] * (n - 1)]) + "." for n in lengths[0])
    assert by_id(style.rhythm(docs(spark, text)))[0]["note"] == "uniform"  # 4 less one bit


def counts(spark, text, terms, mode):
    return sum(r["matches"] for r in screening.count_matches(docs(spark, text), terms, mode).collect())


@pytest.mark.parametrize(
    ("text", "terms", "mode", "n"),
    [
        ("The class analysis document was assessed in Sussex.", lx.DEMO_TERMS, "word", 0), ("hell!", ["hell"], "word", 1), ("(hell)", ["hell"], "normalized", 1), ("hell+", ["hell"], "normalized", 1), ("what the hell!", ["hell"], "normalized", 1),
        ("a$$", ["ass"], "normalized", 1), ("@ss", ["ass"], "normalized", 1), ("$hot", ["shot"], "normalized", 1), ("sh!t", ["shit"], "normalized", 1), ("sh0t", ["shot"], "normalized", 1), ("hellll", ["hell"], "normalized", 1), ("asssss", ["ass"], "normalized", 1),
        ("shooot", ["shot"], "normalized", 1), ("as", ["ass"], "normalized", 0), ("a hello", ["hell"], "normalized", 0), ("a.b and axb", ["a.b"], "substring", 1), ("", ["a"], "word", 0), ("anything", ["", None, "any"], "substring", 1),
    ],
)
def test_matches(spark, text, terms, mode, n):
    assert counts(spark, text, terms, mode) == n
    assert screening.screen(docs(spark, text), terms, mode).count() == n


def test_places(spark):
    rows = screening.screen(docs(spark, "The class analysis of İstanbul's grass"), ["ass", "anal"], "substring").orderBy("index").collect()
    assert [(r["matched"], r["index"], r["whole_word"]) for r in rows][:2] == [("ass", 6, False), ("anal", 10, False)] and len(rows) == 3


def test_more_is_found_after_normalising(spark):
    texts = ["you are h e l l today", "hell no", "h3ll", "shot and ass", "class"]
    found = {(r["doc_id"], r["mode"]): r["total"] for r in screening.compare_modes(docs(spark, *texts)).collect()}
    assert all(found[i, "normalized"] >= found[i, "word"] and found[i, "substring"] >= found[i, "word"] for i in range(len(texts)))


@pytest.mark.parametrize(
    ("text", "whole", "screened"),
    [("you are h e l l today", "you are hell today", "you are hell today"), ("the h.e.l.l.", "the hell.", "the hell."), ("plan b or c will work.", "plan b or c will work.", "plan b or c will work."), ("hell!", "helli", "hell!"), ("hellll", "hel", "hellll"), ("асс", "acc", "acc"), ("h\u200be\u200bl\u200bl\u200bo", "hello", "hello"), ("h3ll0 w0rld", "hello world", "hello world"), ("heeeellllo", "helo", "heeeellllo")],
)
def test_normal_form(spark, text, whole, screened):
    assert screening.normalize(docs(spark, text)).first()["output"] == whole
    assert screening.normalize(docs(spark, text), symbols="inner", collapse=False).first()["output"] == screened


def test_evasions(spark):
    tally = {(r["family"], r["technique"]): (r["total"], r["word"], r["normalized"]) for r in screening.evasion_tally(screening.evasion_report(docs(spark))).collect()}
    assert tally["designed-for", None] == (40, 0, 40) and tally["independent", None] == (18, 0, 0)


def test_collateral_words_hold_their_terms():
    assert all(t in w.lower() for t, some in lx.COLLATERAL.items() for w in some)
    sizes = [len(set(x)) for x in (lx.ABBREVIATIONS, lx.SENTENCE_STARTERS, lx.SYLLABLE_EXCEPTIONS, lx.INTERVENING, lx.IRREGULAR_PARTICIPLES, lx.NOT_NOMINALISATIONS, lx.HEDGES, lx.CONFUSABLES, lx.LEET)]
    assert sizes == [26, 77, 83, 35, 87, 68, 36, 62, 18]


def test_highlight(spark):
    df = docs(spark, "a <hell> & shell", "none")
    rows = by_id(screening.highlight(df, screening.screen(df, ["hell"], "substring")))
    assert rows[0]["html"] == "a &lt;<mark>hell</mark>&gt; &amp; s<mark>hell</mark>" and rows[1]["html"] == "none"


def test_terms(spark):
    assert docs(spark, " a, b\tc,,d ").select(screening.parsed_terms(F.col("text")).alias("t")).first()["t"] == ["a", "b", "c", "d"]


def test_citations(spark):
    assert citations.citations(spark).count() == 23 and citations.citations(spark).filter("verified = 'primary'").count() == 6
    lines = {r["id"]: r["reference"] for r in citations.format_citations(spark.createDataFrame([("herdan1960",), ("none",)], "id string")).collect()}
    assert lines == {"herdan1960": "Herdan, G. (1960). Type-Token Mathematics: A Textbook of Mathematical Linguistics., Mouton.", "none": "none"}
    assert citations.references(spark).orderBy("place").first()["id"] == "flesch1948"
    assert citations.cite(spark.createDataFrame([("zipf1949",), ("none",)], "id string")).count() == 1


def test_evaluation(spark):
    gold = spark.createDataFrame([("table", [2]), ("people", [2, 3]), ("belle", [2])], "word string, counts array<int>")
    (r,) = evaluation.syllable_eval(gold).collect()
    assert (r["words"], r["exact_percent"], r["within_one_percent"], r["mean_signed"]) == (3, 66.67, 100.0, -0.3333)
    units = spark.createDataFrame([(1, ["One two.", "Three four."]), (2, ["he went", "Then he left."])], "unit_id int, sentences array<string>")
    (r,) = evaluation.sentence_eval(units).collect()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["recall"]) == (1, 0, 1, 100.0, 50.0)
    ours, theirs = (spark.createDataFrame([("a", "m", x), ("b", "m", x)], "sample string, metric string, value double") for x in (1.0, 1.5))
    assert evaluation.cross_check(ours, theirs).first()["mean_difference"] == 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One.\n\nTwo.")
    (tmp_path / "b.bin").write_text("no")
    (tmp_path / "c.md").write_text("Three.")
    rows = documents_from_files(spark, str(tmp_path)).collect()
    assert sorted(r["text"] for r in rows) == ["One.\n\nTwo.", "Three."]
    words = tmp_path / "dict"
    words.write_text(";;; note\nTABLE  T EY1 B AH0 L\nTABLE(2)  T EY1 B L # odd\n'S  Z\n")
    assert [(r["word"], r["counts"]) for r in syllable_dictionary(spark, str(words)).collect()] == [("table", [1, 2])]
    bank = tmp_path / "x.conllu"
    bank.write_text("# newdoc id = 1\n# text = One.\n1\tOne\n\n# text = Two.\n\n# newpar\n# text = Three.\n")
    assert sorted(tuple(r["sentences"]) for r in conllu_units(spark, str(bank)).collect()) == [("One.", "Two."), ("Three.",)]


def test_profile_and_report(spark, tmp_path):
    p = profile(samples(spark).unionByName(spark.createDataFrame([("empty", ""), ("null", None)], "doc_id string, text string"))).cache()
    rows = {r["doc_id"]: r for r in p.collect()}
    assert len(rows) == 6 and rows["empty"]["empty"] and rows["null"]["empty"] and not rows["empty"]["readability"]["metrics"]
    assert rows["official"]["style"]["passive"]["total"] >= 3 and rows["plain"]["screening"]["word"]["total"] == 0
    reports = report_text(p)
    texts = {r["doc_id"]: r["report"] for r in reports.collect()}
    assert "Flesch Reading Ease" in texts["plain"] and texts["empty"] is None
    write_json(p, str(tmp_path / "json"))
    write_text(reports, str(tmp_path / "text"))
    assert spark.read.json(str(tmp_path / "json")).count() == 6


def test_segments_do_not_depend_on_partitions(spark):
    df = samples(spark)
    assert by_id(segment.counts(df.repartition(1))) == by_id(segment.counts(df.repartition(3)))


def test_stream(spark, tmp_path):
    from prosegauge.streaming import read_documents, stream_counts

    samples(spark).write.parquet(str(tmp_path / "in"))
    rows = stream_counts(read_documents(spark, str(tmp_path / "in"), "doc_id string, text string"))
    q = rows.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 4


def test_public_names():
    import prosegauge

    assert all(callable(getattr(prosegauge, n)) or n.isupper() for n in prosegauge.__all__)
    with pytest.raises(AttributeError):
        prosegauge.nothing  # noqa: B018


def test_plain_syllables_are_those_of_the_columns(spark):
    """Both forms of the rules, over all words of a table and many made up of endings."""
    from prosegauge.functions import syllables as sy

    rng = random.Random(3)
    parts = ["tion", "ies", "ed", "es", "ing", "e", "ly", "ment", "ia", "ious", "eou", "y", "thm", "ism", "b", "le", "tt", "re", "ness", "a", "o", "ch", "sh", "xio", "gi", "ful", "s"]
    made = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(3000)} | set(lx.SYLLABLE_EXCEPTIONS) | {"É", "naïve", "123", "don't", "", "State-of-the-art", "İs"}
    rows = read.word_facts(spark.createDataFrame([(w,) for w in made], "word string")).collect()
    assert len(rows) == len(made)
    for r in rows:
        assert (r["syllables"], r["complex"]) == sy.word_facts(r["word"]), r["word"]
        assert r["syllables"] == sy.count_syllables(r["word"])


def test_long_and_odd_token_lists(spark):
    """Facts of a batch are those of single documents; nulls and empty texts have none."""
    texts = ["a b c a b b", "", None, "one", "the " * 3000, " ".join(f"w{i % 37}x" for i in range(900)), "!!!"]
    whole = by_id(lex.facts(docs(spark, *texts)))
    for i, x in enumerate(texts):
        (one,) = lex.facts(docs(spark, x)).collect()
        assert one["_f"] == whole[i]["_f"]
    assert whole[1]["_f"]["tokens"] == whole[2]["_f"]["tokens"] == whole[6]["_f"]["tokens"] == 0


def test_public_names():
    import prosegauge

    assert all(getattr(prosegauge, name) is not None for name in prosegauge.__all__)


def test_windowed_totals(spark, tmp_path):
    """A stream of texts summed by windows of event time."""
    from prosegauge.streaming import windowed_totals

    spark.createDataFrame([("2026-01-01 00:00:10", "One two. Three."), ("2026-01-01 00:00:50", "Four five six."), ("2026-01-01 00:02:00", "Seven.")], "at string, text string").selectExpr("timestamp(at) AS at", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, text string").parquet(str(tmp_path / "in"))
    out = windowed_totals(stream, "at", width="1 minute")
    q = out.writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    rows = sorted(r["words"] for r in spark.table("totals").collect())
    assert rows == [1, 6]


def test_profile_rows_wait_for_python_once_and_narrow(spark):
    """Rows that Python has a batch of are held, on disk if memory is short: they must not hold the text several times."""
    plan = profile(docs(spark, "One two three. Four."), screened=False)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("ArrowEvalPython")
    assert len(below) == 2 and "struct(doc_id" not in below[1].split("\n", 1)[1]
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(2 << 20)


def test_profile_carries_words_as_one_string(spark):
    """Rows that wait for Python hold no arrays of words, and the arrays come back as they were."""
    rows = segment.prepared(docs(spark, "Don\u2019t stop: 3.14 caf\u00e9s, state-of-the-art! " * 50, "", None, " \n ", "?!", "x"))
    found = _found(rows, 50)
    assert {c: kind for c, kind in found.dtypes if c in (segment.WORDS, segment.TOKENS)} == {segment.WORDS: "string", segment.TOKENS: "string"}
    again = {r["doc_id"]: (r["w"], r["t"]) for r in found.select("doc_id", _apart(segment.WORDS).alias("w"), _apart(segment.TOKENS).alias("t")).collect()}
    assert again == {r["doc_id"]: (r[segment.WORDS], r[segment.TOKENS]) for r in rows.collect()}
    assert again[1] == again[2] == ([], [])
