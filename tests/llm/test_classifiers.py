"""The two classifiers: scores against a plain reading of the frozen model, and accuracy on held-out labels."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prosegauge.llm import gam, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def toxic(tables):
    return toxicity.fit(*tables)


@pytest.fixture(scope="module")
def quality(tables):
    return gam.fit(*tables)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_toxicity(text, model):
    words = text.encode().split()
    words = [w.decode() for w in words]
    best = {}

    def match(word):
        if word not in best:
            found = []
            for i, term in enumerate(model.terms[: model.n_words]):
                if abs(len(term) - len(word)) <= 1 and (d := distance(word, term)) <= (len(term) >= 5):
                    found.append((d, i))
            found += [(0, i) for i, term in enumerate(model.terms) if i >= model.n_words and word.startswith(term[:-1])]
            best[word] = min(found) if found else None
        return best[word]

    plain = misspelt = quoted = stems = weight = 0
    for k, w in enumerate(words):
        hit = match(toxicity.folded(toxicity.bare(w))) if w else None
        if hit is None:
            continue
        d, i = hit
        near = words[max(0, k - 8) : k + 9]
        said = toxicity.quoted(near, k - max(0, k - 8))
        quoted += said
        stems += not said and i >= model.n_words
        misspelt += not said and i < model.n_words and d == 1
        plain += not said and i < model.n_words and d == 0
        weight += model.weights[i] * (0.5 if d else 1) * (0.25 if said else 1)
    share = math.sqrt((plain + misspelt + stems) / max(len(words), 1))
    x = [math.log1p(plain), math.log1p(misspelt), math.log1p(quoted), share, math.log1p(weight), math.log1p(stems)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.logit, strict=False)) + model.logit[-1])))


def test_toxicity_scores(tables, toxic):
    docs, labels = tables
    rows = docs.join(labels.filter("toxic = 1").select("doc_id"), "doc_id").filter("n_chars < 4000").orderBy("doc_id").limit(60).union(docs.filter("n_chars < 3000").orderBy("doc_id").limit(60)).collect()
    for r in rows:
        score, _ = toxic.score(pa.array([r["text"]]))
        assert score[0] == pytest.approx(plain_toxicity(r["text"], toxic), abs=1e-9), r["doc_id"]


def held_out_accuracy(docs, labels, scored, label):
    rows = scored.filter("held_out").join(labels.select("doc_id", label), "doc_id").filter(f"{label} is not null").toPandas()
    right = rows["predicted"] == rows[label]
    return {y: (len(g), g.mean()) for y, g in right.groupby(rows[label])}


def test_toxicity_on_held_out_labels(tables, toxic):
    docs, labels = tables
    found = held_out_accuracy(docs, labels, toxicity.score(docs, toxic), "toxic")
    assert found[0][0] > 1000 and found[0][1] >= 0.995 and found[1][0] > 100 and found[1][1] >= 0.8


def test_quality_on_held_out_labels(tables, quality):
    docs, labels = tables
    found = held_out_accuracy(docs, labels, gam.score(docs, quality), "quality")
    assert found[1][0] > 600 and found[1][1] >= 0.99 and found[0][0] > 100 and found[0][1] >= 0.9


def test_quality_scores_are_sums_of_table_entries(tables, quality):
    """Bins and tables read one by one, for single texts."""
    rows = tables[0].orderBy("doc_id").limit(150).collect()
    scored = {r["doc_id"]: r["score"] for r in gam.score(tables[0].orderBy("doc_id").limit(150), quality).collect()}
    for r in rows:
        x = gam.features(pa.array([r["text"]]))[0]
        bins = [sum(1 for c in cuts if c <= v) for cuts, v in zip(quality.cuts, x, strict=True)]
        z = quality.base + sum(t[b] for t, b in zip(quality.tables, bins, strict=True))
        z += sum(grid[quality.coarse[i][bins[i]], quality.coarse[j][bins[j]]] for (i, j), grid in quality.grids.items())
        assert scored[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-9)


TEXTS = ["", "Abc def!! 12%%% x.", "one two two two three. one two!", "line one\nline one\n\nline two", "a | b\nc d | e", "été été", "x" * 50]


def test_plain_features():
    """Those features that are easily said, by counting characters and words one by one."""
    at = {n: i for i, n in enumerate(gam.NAMES)}
    for t, x in zip(TEXTS, gam.features(pa.array(TEXTS)), strict=True):
        raw, words = t.encode(), t.encode().split()
        n = max(len(raw), 1)
        letters = sum(chr(b).isalpha() and b < 128 or b >= 128 for b in raw)
        lines = [s for s in raw.split(b"\n") if s.strip()]
        lower = [w.lower() for w in words]
        want = {
            "log_bytes": math.log1p(len(raw)), "letters": letters / n, "digits": sum(48 <= b < 58 for b in raw) / n, "spaces": sum(b in b" \t\r\v\f\n" for b in raw) / n, "bars": raw.count(b"|") / n,
            "upper": sum(65 <= b < 91 for b in raw) / max(letters, 1), "word_length": letters / max(len(words), 1), "sentence_length": len(words) / (sum(b in b".,;:?" for b in raw) + 1),
            "types": len(set(lower)) / math.sqrt(max(len(lower), 1)), "repeated_words": sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / max(len(words), 1),
            "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0, "top_word": max((lower.count(w) for w in set(lower)), default=0) / max(len(lower), 1),
        }
        for name, value in want.items():
            assert x[at[name]] == pytest.approx(value), (name, t)


def test_few_texts_suffice_however_many_there_are(spark):
    """A word in 1 % of the toxic texts and in no other is a term; words that fall on both as they are spread are not."""
    rng = np.random.default_rng(3)
    for n1, n0 in ((1000, 8000), (4000, 4000)):
        counts = [("rareslur", False, n1 // 100, 0), ("slur", False, n1 // 2, n0 // 2000)]
        for i in range(4000):
            n = int(rng.integers(1, 400))
            a = int(rng.binomial(n, n1 / (n1 + n0)))
            counts.append((f"word{i}", False, a, n - a))
        words, stems, weights = toxicity.learn_lexicon(spark.createDataFrame(counts, "word string, stem boolean, toxic long, clean long"), n1, n0, 100)
        assert sorted(words) == ["rareslur", "slur"] and not stems and (weights > 1).all()


def test_sampled_classes_keep_their_weight():
    """The mean score is the share of the class, whether or not the other class was sampled."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40_000, 1))
    y = (rng.uniform(size=40_000) < 1 / (1 + np.exp(4 - 2 * x[:, 0]))).astype(float)
    whole = toxicity.logistic(x, y, np.ones(len(y)))
    some = (y == 1) | (np.arange(len(y)) % 10 == 0)
    part = toxicity.logistic(x[some], y[some], np.where(y[some] == 1, 1.0, 10.0))
    assert np.allclose(whole, part, atol=0.25)
    p = lambda m: m.score(x).mean()
    assert p(gam.boost(x, y, rounds=20)) == pytest.approx(p(gam.boost(x[some], y[some], np.where(y[some] == 1, 1.0, 10.0), rounds=20)), abs=0.02)


def test_one_row_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {i % 7}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    rows = toxicity.sampled_texts(docs, labels, "toxic", held_out=F.lit(False), sample=10, text="text", doc_id="doc_id").collect()
    assert sorted((r["_y"], r["_w"], r["_text"]) for r in rows) == [(0, 1.0, "other"), (1, 1.0, "text 0")]


def test_split_of_labels(tables, toxic):
    ids = [r["doc_id"] for r in toxicity.score(tables[0].limit(300), toxic).filter("held_out").collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids) and re.fullmatch(r"\d+", str(ids[0]))
