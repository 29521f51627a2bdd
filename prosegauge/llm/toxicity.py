"""Toxicity scores from Levenshtein automata that are intersected with a lexicon trie.

The lexicon is learnt from labelled texts: words whose share among toxic texts is far above their share among others,
by a ratio and by a test of significance that allows for the number of words tested (false discovery rate); how many
toxic texts a term must be in does not depend on how many there are.
Where many words of one beginning are, the beginning itself is the term, and any ending matches; so inflected forms that
training has not seen are found.  ``terms`` bounds the automaton; were more terms found, those of the best evidence would
be taken.  The trie of the terms is intersected with the Levenshtein automaton of each term:
a state is a set of (trie node, edits so far), made deterministic once, so that any word is read in one pass, whatever
the number of terms.  Terms of ``fuzzy_from`` letters and more match with one edit, after look-alike signs (0 for o, $
for s, ...) are folded.  All distinct words of a slice of documents are read at once, one character a step.

Every match is weighed by its context window: matches between quotation marks, and those with a word of reporting
nearby, count as quoted.  A logistic model over the weighed matches gives the score; it is fitted on at most ``sample``
labelled texts of each class, chosen by a hash of the id, and where a class has more, its texts weigh as much as all of
them would: so scores mean the same at every size.

Labels, language, source and id are no inputs of a score.  A task needs the automaton (bounded by ``terms``) and one
slice of texts; there is no shuffle of texts.  Nulls and edge cases: a null text is an empty one and scores like any
text without matches; labels that are null are left out, of several for one id the largest counts; repeated rows are
scored each; without toxic training texts every score is 0.  An empty table gives an empty result.  Other columns do
not matter.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_slices, map_slices, save, small_batches, text_slices, texts_of

#: Bounds of the fit: labelled texts of each class, and terms of the lexicon (the size of the automaton).
SAMPLE, TERMS = 20_000, 2_000
#: A term occurs in this many toxic texts at least, and this often as likely as elsewhere.
LEAST_TEXTS, LEAST_RATIO = 3, 20.0
#: Share of terms found by chance that is allowed for.
DISCOVERY = 0.05
#: A beginning is a term if it has so many words in toxic texts and this many times the texts of any one of them.
STEM_WORDS, STEM_GAIN, STEM_LETTERS = 5, 1.5, range(3, 9)
#: Words either side that a match is judged by.
WINDOW = 8

LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
OPENING, CLOSING = "\"'“‘«„(", "\"'”’»“)"
REPORTING = {"said", "says", "called", "quoted", "quote", "wrote", "word", "term", "cited", "dit", "sagte", "dijo"}
EDGES = re.compile(r"^[^\w@$]+|[^\w@$]+$")
INSIDE = re.compile(r"[^\w]+")


def held_out_column(doc_id: Column, modulus: int = 3, remainder: int = 1) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % modulus == remainder


def bare(token: str) -> str:
    """The token in lower case without the signs around it."""
    return EDGES.sub("", token.lower())


def folded(word: str) -> str:
    """Look-alike signs inside a word as the letters they stand for; a word that is all digits stays."""
    if word.isalpha() or word.isdigit():
        return word
    return INSIDE.sub("", "".join(LOOKALIKES.get(c, c) for c in word))


@dataclass
class Automaton:
    """``step[state, letter]`` for letters 1.. of ``alphabet`` (0: any other); state 0 is dead, 1 the start.
    ``term[state]`` and ``edits[state]``: what a word that ends there matches best, or -1; ``stem[state]``: the same for
    a word that goes on."""

    alphabet: dict[str, int]
    step: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    stem: np.ndarray
    longest: int

    def read(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term (-1: none) and edits of each word."""
        term, edits = np.full(len(words), -1, np.int32), np.zeros(len(words), np.int32)
        some = np.array([i for i, w in enumerate(words) if w], np.int64)
        if not len(some):
            return term, edits
        points = np.array([words[i][: self.longest] for i in some.tolist()], f"U{self.longest}").view(np.uint32).reshape(len(some), -1)
        known = np.zeros(int(points.max()) + 1, np.int32)
        for c, k in self.alphabet.items():
            if ord(c) < len(known):
                known[ord(c)] = k
        letters = known[points]
        length = (points != 0).sum(1)
        state = np.ones(len(some), np.int32)
        for i in range(self.longest):
            on = np.flatnonzero((length > i) & (state > 0))
            state[on] = self.step[state[on], letters[on, i]]
        cut = np.array([len(words[i]) > self.longest for i in some.tolist()])
        term[some], edits[some] = np.where(cut, self.stem[state], self.term[state]), np.where(cut, 0, self.edits[state])
        return term, edits


def intersect(terms: Sequence[str], fuzzy_from: int = 5, stems: Sequence[str] = ()) -> Automaton:
    """The automaton of all words within the edits that each term allows (one from ``fuzzy_from`` letters on, else none),
    and of all words that begin with one of ``stems``, which are numbered after the terms."""
    allows = [int(len(x) >= fuzzy_from) for x in terms] + [0] * len(stems)
    terms, n_words = [*terms, *stems], len(terms)
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    reach = [0]  # the most edits that a term below the node allows
    for t, term in enumerate(terms):
        node, allowed = 0, allows[t]
        reach[0] = max(reach[0], allowed)
        for c in term:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(-1)
                reach.append(0)
            node = children[node][c]
            reach[node] = max(reach[node], allowed)
        if ends[node] < 0:
            ends[node] = t
    alphabet = {c: i for i, c in enumerate(sorted({c for t in terms for c in t}), 1)}

    def closed(found: dict[int, int]) -> frozenset[tuple[int, int]]:
        """With the nodes that a missing letter leads to."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            for child in children[node].values():
                if e < reach[child] and found.get(child, 9) > e + 1:
                    found[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(found.items())

    def after(state: frozenset[tuple[int, int]], c: str) -> frozenset[tuple[int, int]]:
        found: dict[int, int] = {}
        for node, e in state:
            steps = [(node, e + 1)] if e < reach[node] else []  # an extra letter
            if ends[node] >= n_words:
                steps.append((node, e))  # any ending
            for x, child in children[node].items():
                if x == c:
                    steps.append((child, e))
                elif e < reach[child]:
                    steps.append((child, e + 1))  # another letter
            for child, cost in steps:
                if found.get(child, 9) > cost:
                    found[child] = cost
        return closed(found)

    start = closed({0: 0})
    number = {frozenset(): 0, start: 1}
    rows: list[list[int]] = [[0] * (len(alphabet) + 1)]
    queue = [start]
    for state in queue:
        row = []
        for c in ["", *alphabet]:
            to = after(state, c)
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        rows.append(row)
    term, edits, stem = np.full(len(number), -1, np.int32), np.zeros(len(number), np.int32), np.full(len(number), -1, np.int32)
    for state, i in number.items():
        found = sorted((e, ends[n]) for n, e in state if ends[n] >= 0 and e <= allows[ends[n]])
        if found:
            edits[i], term[i] = found[0]
        stem[i] = next((t for _, t in found if t >= n_words), -1)
    return Automaton(alphabet, np.array(rows, np.int32), term, edits, stem, max(map(len, terms), default=0) + 1)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens, the index of every token, and the places where texts begin or end."""
    chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    coded = chunks.flatten().dictionary_encode()
    offsets = chunks.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def quoted(words: Sequence[str], at: int, window: int = WINDOW) -> bool:
    """Whether the word at ``at`` stands between quotation marks or near a word of reporting within the window."""
    left, right = words[max(0, at - window) : at + 1], words[at : at + window + 1]
    opened = any(w[:1] in OPENING for w in left if w) and not any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in left[:-1] if w)
    closed = any(w.rstrip(".,;:!?")[-1:] in CLOSING for w in right if w)
    return (opened and closed) or any(bare(w) in REPORTING for w in (*left[:-1], *right[1:]))


FEATURES = ("matches", "misspelt", "quoted", "share", "weight", "stems")


def features(texts: pa.Array, machine: Automaton, weights: np.ndarray, n_words: int) -> tuple[np.ndarray, list[list[tuple[int, int, int, bool]]]]:
    """(n, features) and each text's matches: word, term, edits, quoted."""
    known, index, ends = tokens(texts)
    words = [folded(bare(w)) for w in known.to_pylist()]
    term, edits = machine.read(words)
    at = np.flatnonzero(term[index] >= 0)
    doc = np.searchsorted(ends, at, "right") - 1
    out = np.zeros((len(texts), len(FEATURES)))
    found: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(len(texts))]
    for i, d in zip(at.tolist(), doc.tolist(), strict=True):
        a, b = max(int(ends[d]), i - WINDOW), min(int(ends[d + 1]), i + WINDOW + 1)
        near = known.take(pa.array(index[a:b])).to_pylist()
        said = quoted(near, i - a)
        t, e = int(term[index[i]]), int(edits[index[i]])
        found[d].append((i - int(ends[d]), t, e, said))
        weight = weights[t] * (0.5 if e else 1.0)
        out[d, 2 if said else 5 if t >= n_words else 1 if e else 0] += 1
        out[d, 4] += weight * (0.25 if said else 1.0)
    n = np.diff(ends)
    out[:, 3] = np.sqrt((out[:, 0] + out[:, 1] + out[:, 5]) / np.maximum(n, 1))
    out[:, [0, 1, 2, 4, 5]] = np.log1p(out[:, [0, 1, 2, 4, 5]])
    return out, found


def logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps with a ridge on the weights.  ``each``: what a row counts."""
    each = each / each.mean()
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (each * (p - y)) + ridge @ w
        w -= np.linalg.solve(a.T @ (a * (each * p * (1 - p))[:, None]) + ridge, g)
        if np.abs(g).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    terms: list[str]
    n_words: int
    weights: np.ndarray
    machine: Automaton
    logit: np.ndarray

    def score(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, int, bool]]]]:
        x, found = features(texts, self.machine, self.weights, self.n_words)
        return 1 / (1 + np.exp(-np.clip(x @ self.logit[:-1] + self.logit[-1], -30, 30))), found


def sample_ids(labels: DataFrame, label: str, *, held_out: Column, sample: int) -> DataFrame:
    """_i, _y and _w: ids and labels of at most ``sample`` documents of each class, those with the least hashes (a
    bounded table), and how many of its class each stands for."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy(F.col("doc_id").cast("long").alias("_i")).agg(F.max(label).cast("int").alias("_y"))
    counts = dict(map(tuple, known.filter("_y in (0, 1)").groupBy("_y").agg(F.count("*")).collect()))
    order = F.xxhash64(F.lit(3), F.col("_i"))
    chosen = [known.filter(F.col("_y") == y).orderBy(order, "_i").limit(sample).withColumn("_w", F.lit(max(1.0, counts.get(y, 0) / sample))) for y in (1, 0)]
    return chosen[0].union(chosen[1])


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, *, held_out: Column, sample: int, text: str, doc_id: str) -> DataFrame:
    """_y, _w and _text of the sample, one row an id: of several texts with one id the least."""
    ids = F.broadcast(sample_ids(labels, label, held_out=held_out, sample=sample))
    rows = docs.select(F.col(doc_id).cast("long").alias("_i"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(ids, "_i")
    return rows.groupBy("_i", "_y", "_w").agg(F.min("_text").alias("_text")).select("_y", "_w", "_text")


def word_counts(texts: DataFrame) -> DataFrame:
    """``texts`` (_y, _text) to word, stem, toxic, clean: texts of each label that hold the word, or a word with that
    beginning (stem); the null word counts all texts."""

    def counted(doc: np.ndarray, words: pa.Array, y: np.ndarray, stem: bool) -> pa.Table:
        t = pa.table({"doc": doc, "word": words}).group_by(["doc", "word"]).aggregate([])
        toxic = y[t["doc"].to_numpy()]
        t = pa.table({"word": t["word"], "toxic": pa.array(toxic, pa.int64()), "clean": pa.array(1 - toxic, pa.int64())}).filter(pc.not_equal(t["word"], ""))
        t = t.group_by("word").aggregate([("toxic", "sum"), ("clean", "sum")])
        return pa.table({"word": t["word"], "stem": pa.array(np.full(t.num_rows, stem)), "toxic": t["toxic_sum"], "clean": t["clean_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in itertools.chain.from_iterable(text_slices(x, 1) for x in batches if x.num_rows):
            y = b.column(0).to_numpy()
            known, index, ends = tokens(b.column(1))
            each = pa.array([folded(bare(w)) for w in known.to_pylist()], pa.string()).take(pa.array(index))
            doc = np.repeat(np.arange(b.num_rows), np.diff(ends))
            parts = [counted(doc, each, y, False)]
            length = pc.utf8_length(each).to_numpy()
            for k in STEM_LETTERS:
                long = length >= k
                parts.append(counted(doc[long], pc.utf8_slice_codeunits(each.filter(pa.array(long)), 0, k), y, True))
            parts.append(pa.table({"word": pa.nulls(1, pa.string()), "stem": pa.array([False]), "toxic": pa.array([int(y.sum())], pa.int64()), "clean": pa.array([int((1 - y).sum())], pa.int64())}))
            yield from pa.concat_tables(parts).combine_chunks().to_batches(max_chunksize=50_000)

    return small_batches(texts).select("_y", "_text").mapInArrow(run, "word string, stem boolean, toxic long, clean long").groupBy("word", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def least_evidence(rows: DataFrame, n_tests: int) -> float:
    """The least evidence (minus the log of a bound on the p-value) at which so many of ``rows`` have it that at most
    ``DISCOVERY`` of them are due to chance.  Read from a histogram, 16 cells to a unit."""
    cells = sorted(map(tuple, rows.groupBy(F.least(F.floor(F.col("evidence") * 16), F.lit(16_000)).alias("cell")).agg(F.count("*")).collect()), reverse=True)
    found, least = 0, float("inf")
    for cell, n in cells:
        found += n
        if n_tests * math.exp(-cell / 16) <= DISCOVERY * found:
            least = cell / 16
    return least


def learn_lexicon(counts: DataFrame, n1: int, n0: int, terms: int) -> tuple[list[str], list[str], np.ndarray]:
    """Words, stems and the weights of both, from ``word_counts`` of n1 toxic and n0 other texts.

    A word's evidence is Chernoff's bound for that many of its texts to be toxic, were it as likely in both classes.
    """
    a, b, share = F.col("toxic"), F.col("clean"), n1 / (n1 + n0)
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((a + b) * p))).otherwise(0.0)
    ratio = (a / n1) / ((b + 0.5) / n0)
    tested = counts.filter(F.col("word").isNotNull() & (F.length("word") >= 3) & (F.length("word") <= 40) & (a + b >= LEAST_TEXTS))
    tested = save(tested.select("word", "stem", "toxic", "clean", ratio.alias("ratio"), F.when(a > share * (a + b), part(a, share) + part(b, 1 - share)).otherwise(0.0).alias("evidence")), "tested")
    words = counts.filter(F.col("word").isNotNull() & ~F.col("stem") & (a > 0))
    begun = words.filter(F.length("word") >= STEM_LETTERS[0]).select("toxic", F.explode(F.transform(F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.length("word"), F.lit(STEM_LETTERS[-1]))), lambda k: F.substr(F.col("word"), F.lit(1), k))).alias("word"))
    spread = begun.groupBy("word").agg(F.count("*").alias("words"), F.max("toxic").alias("most"))
    least = {stem: least_evidence(tested.filter(F.col("stem") == stem), tested.filter(F.col("stem") == stem).count()) for stem in (False, True)}
    likely = tested.filter((a >= LEAST_TEXTS) & (F.col("ratio") >= LEAST_RATIO) & (F.col("evidence") >= F.when(F.col("stem"), least[True]).otherwise(least[False])))
    stems = likely.filter("stem").join(spread, "word").filter((F.col("words") >= STEM_WORDS) & (a >= STEM_GAIN * F.col("most")))
    chosen: dict[str, float] = {}
    for r in stems.orderBy(F.desc("evidence"), "word").limit(terms).select("word", "ratio").orderBy(F.length("word"), "word").collect():
        if not any(r["word"].startswith(x) for x in chosen):
            chosen[r["word"]] = r["ratio"]
    whole = likely.filter("not stem").orderBy(F.desc("evidence"), "word").limit(terms).collect()
    kept = {r["word"]: r["ratio"] for r in whole if not any(r["word"].startswith(x) for x in chosen)}
    ratios = np.array([*kept.values(), *chosen.values()], float)
    return list(kept), list(chosen), np.log(ratios) / np.log(LEAST_RATIO)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, terms: int = TERMS, fuzzy_from: int = 5) -> Model:
    """Lexicon and logistic model from the labels that are not held out."""
    rows = save(sampled_texts(docs, labels, label, held_out=held_out_column(F.col("doc_id")), sample=sample, text=text, doc_id=doc_id), "sample")
    counts = save(word_counts(rows.dropDuplicates(["_text"])), "words")
    whole = counts.filter("word is null").first()
    n1, n0 = (whole["toxic"], whole["clean"]) if whole else (0, 0)
    if not n1 or not n0:
        return Model([], 0, np.zeros(0), intersect([]), np.zeros(len(FEATURES) + 1) - np.eye(len(FEATURES) + 1)[-1] * 30)
    words, stems, weights = learn_lexicon(counts, n1, n0, terms)
    machine = intersect(words, fuzzy_from, stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in itertools.chain.from_iterable(text_slices(x, 2) for x in batches if x.num_rows):
            x, _ = features(b.column(2), machine, weights, len(words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "w", "x"])

    fitted = small_batches(rows).select("_y", "_w", "_text").mapInArrow(run, "y int, w double, x array<double>").toPandas()  # at most two samples of rows
    x, y, w = np.array(fitted["x"].tolist()).reshape(-1, len(FEATURES)), fitted["y"].to_numpy(float), fitted["w"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # the same fit in whatever order rows come
    return Model([*words, *(f"{x}-" for x in stems)], len(words), weights, machine, logistic(x[order], y[order], w[order]))


def score(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, and matches: word, term, edits and whether it is quoted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        value, found = held.value.score(texts_of(part.column(1)))
        terms = held.value.terms
        matches = [[{"word": w, "term": terms[t], "edits": e, "quoted": q} for w, t, e, q in m] for m in found]
        kind = pa.list_(pa.struct([("word", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(matches, kind)], names=["doc_id", "held_out", "score", "predicted", "matches"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), held_out_column(F.col(doc_id)).alias("_held"))
    return map_slices(rows, run, "doc_id long, held_out boolean, score double, predicted int, matches array<struct<word:long,term:string,edits:int,quoted:boolean>>")


def passing(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filter_slices(docs, text, lambda texts: held.value.score(texts)[0] < threshold)
