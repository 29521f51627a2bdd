"""Tokens, sentences and syllables on fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from prosegauge.functions import sentences as sent
from prosegauge.functions import syllables as syl
from prosegauge.functions import text as t

SENTENCES = [
    ("One. Two! Three?", 3), ("", 0), ("   ", 0), ("Version 1.2.3 shipped.", 1), ("Dr. Smith arrived late.", 1), ("Cats, dogs, etc. were present.", 1), ("J. R. R. Tolkien wrote it.", 1), ('He said "Stop!" Then he left.', 2),
    ('"Stop!" he said. Then he left.', 2), ("What?! Really.", 2), ("I said no. Then he left.", 2), ("See no. 5 for details.", 1), ("We met in Mar. Then we left.", 2), ("The meeting is on Dec. 25 at noon.", 1), ("Say hi to Al. Then go.", 2),
    ("The paper by Smith et al. Nature 2020 was cited.", 1), ("Get vitamin C. It helps.", 2), ("F. Scott Fitzgerald wrote it.", 1), ("I. M. Pei designed it.", 1), ("P.S. I miss you.", 2), ("Where did you go? home.", 2),
    # known to be wrong, and kept
    ("Meet me at 9 a.m. We can talk then.", 1), ("See Section A. Results follow.", 1), ("i went home. it was late.", 1), ("Ask Messrs. Smith and Jones.", 2),
    ("One\n\nTwo", 2), ("A Heading\n\nThis is a sentence. So is this.", 3), ("Acme Co. Ltd. grew.", 1), ("my co. It failed.", 2), ("Hi, Ed. Then go.", 2), ("the 2nd ed. Oxford printed it.", 1), ("It cost 5. The end.", 2),
]


def column(spark, values, body, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", body(F.col("v")).alias("r")).orderBy("i").collect()]


def test_sentences(spark):
    got = column(spark, [x for x, _ in SENTENCES], sent.sentences)
    assert [len(s) for s in got] == [n for _, n in SENTENCES], [(x, s) for (x, n), s in zip(SENTENCES, got, strict=True) if len(s) != n]
    for (x, _), s in zip(SENTENCES, got, strict=True):
        assert "".join("".join(s).split()) == "".join(x.split())


def test_words(spark):
    cases = {"don't": ["don't"], "state-of-the-art": ["state-of-the-art"], "hello—world": ["hello", "world"], "it’s": ["it’s"], "café naïve": ["café", "naïve"], "Привет мир": ["Привет", "мир"], "3.14 and 1,000": ["3.14", "and", "1,000"], "3rd": ["3", "rd"]}
    assert column(spark, list(cases), t.words) == list(cases.values())


def test_numerals(spark):
    cases = {"2026": True, "3.14": True, "1,000": True, "4,500.25": True, "٣": True, "mp3": False, "B2B": False, "abc": False, "": False, "3.": False, "-5": False, "1st": False}
    assert column(spark, list(cases), t.is_numeral) == list(cases.values())


def test_normal_words(spark):
    assert column(spark, ["It’s", "“Hello”", "..."], t.normal_word) == ["it's", "hello", ""]


def test_graphemes(spark):
    cases = {"\U0001f468\u200d\U0001f469\u200d\U0001f467": 1, "\r\n": 1, "a\r\nb": 3, "\U0001f1eb\U0001f1f7": 1, "\U0001f44d\U0001f3fd": 1, "é": 1, "\U0001d4b3x": 2, "plain": 5, "": 0}
    assert column(spark, list(cases), t.graphemes) == list(cases.values())


def test_paragraphs(spark):
    assert column(spark, ["One\n\nTwo", "One\nstill one", "a\n \t\n\nb\n", "", "a\r\n\r\nb"], lambda c: F.size(t.paragraphs(c))) == [2, 1, 2, 0, 1]


def test_rounding(spark):
    assert column(spark, [0.25, -0.25, 2.5, -0.0, 1.04], lambda c: t.half_up(c, 1), "double") == [0.3, -0.3, 2.5, 0.0, 1.0]


SYLLABLES = "make 1 table 2 belle 1 watches 2 abolishes 4 walked 1 wanted 2 lovely 2 absolutely 4 stadium 3 accordion 4 denied 2 nation 2 rhythm 2 algorithm 4 happy 2 people 2 123 0 yellow 2 the 1 gorgeous 2 Привет 0 café 1".split()


def test_syllables(spark):
    words, want = SYLLABLES[::2], [int(x) for x in SYLLABLES[1::2]]
    assert dict(zip(words, column(spark, words, syl.syllables), strict=True)) == dict(zip(words, want, strict=True))


@pytest.mark.parametrize(("words", "want"), [("following reviewing requested presented beginning accepted cat", False), ("committee implementation unexpected disappointed interesting necessitates beautiful", True)])
def test_complex_words(spark, words, want):
    assert set(column(spark, words.split(), syl.is_complex)) == {want}
