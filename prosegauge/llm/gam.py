"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text come from class counts over its bytes, and from how its words and lines repeat, for whole slices
of documents at once.  Each feature is cut
into at most ``BINS`` bins; cyclic boosting goes round the features and adds, for each, a shallow tree on the
gradient, so that a feature ends up with one lookup table over its bins.  The pairs whose coarse grids explain most of
what is left are boosted in the same way as two-dimensional tables.  A score is the sum of table entries: vectorised
additions by bin numbers, through a logistic function.

The model is fitted on at most ``sample`` labelled texts of each class, chosen by a hash of the id; where a class has
more, its texts weigh as much as all of them would, so scores mean the same at every size.  Labels, language,
source and id are no inputs of a score.  Scoring is one pass without a shuffle.  Nulls and edge cases: a null text is
an empty one, with all features 0; labels that are null are left out, of several for one id the largest counts;
repeated rows are scored each; with training texts of one class only, or none, every score is the class share (0.5
without any).  An empty table gives an empty result.  Other columns do not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_slices, joined_bytes, map_slices, small_batches, sums_between, text_slices, texts_of
from .toxicity import sampled_texts

SAMPLE, BINS, PAIR_BINS, PAIRS = 20_000, 32, 8, 6
ROUNDS, RATE, LEAVES, LEAST_LEAF = 120, 0.1, 4, 5

NAMES = ("log_bytes", "letters", "upper", "digits", "spaces", "lines", "stops", "bangs", "signs", "bars", "other", "non_ascii", "word_length", "sentence_length", "doubled", "after_sign", "capitals", "line_length", "types", "repeated_words", "top_word", "repeated_lines")


def held_out_column(doc_id: Column, modulus: int = 5, remainder: int = 0) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % modulus == remainder


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_LOWER, _UPPER, _DIGIT = _table("abcdefghijklmnopqrstuvwxyz"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_SPACE, _LINE, _STOP, _BANG = _table(" \t\r\v\f\n"), _table("\n"), _table(".,;:?"), _table("!")
_SIGN, _BAR, _OTHER = _table("#$%&*@^~"), _table("|"), _table("()[]{}<>/\\=+_`\"'-")
_HIGH = np.repeat(np.array([0, 1], np.uint8), 128)


def repetition(texts: pa.Array) -> list[np.ndarray]:
    """Distinct words over the root of all words, the share of words that repeat the one before, the share of the most
    frequent word, and the share of lines that occurred before."""

    def coded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the items that are not blank, the text of each, and how many each text has."""
        flat = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        some = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(flat)), 0).to_numpy(zero_copy_only=False)
        code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)[some].astype(np.int64)
        return code, row[some], np.bincount(row[some], minlength=len(lists))

    def groups(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and size of each group of equal items of a text."""
        pairs, n = np.unique(row << 32 | code, return_counts=True)
        return pairs >> 32, n

    texts = pa.array(texts, pa.large_string())
    code, row, words = coded(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    of, n = groups(code, row)
    most = np.zeros(len(texts))
    np.maximum.at(most, of, n)
    again = (code[1:] == code[:-1]) & (row[1:] == row[:-1])
    lines, at, many = coded(pc.split_pattern(texts, "\n"))
    kinds = np.bincount(groups(lines, at)[0], minlength=len(texts))
    some = np.maximum(words, 1)
    return [np.bincount(of, minlength=len(texts)) / np.sqrt(some), np.bincount(row[1:][again], minlength=len(texts)) / some, most / some, 1 - np.where(many > 0, kinds / np.maximum(many, 1), 1.0)]


def features(texts: pa.Array) -> np.ndarray:
    """(n, features); shares are of the text's bytes unless the name says otherwise."""
    data, ends = joined_bytes(texts)
    n = np.diff(ends).astype(float)
    count = lambda x: sums_between(x, ends).astype(float)
    of = lambda table: count(table[data])
    space, sign, upper = _SPACE[data], _SIGN[data] | _BANG[data], _UPPER[data]
    letter = _LOWER[data] | upper | _HIGH[data]
    before = np.concatenate([[1], space[:-1]]) if len(data) else space
    first = ends[:-1][np.diff(ends) > 0]
    if len(data):
        before[first] = 1
    words = count((1 - space) & before)
    capital = count(upper & before)
    doubled = np.concatenate([[0], (data[1:] == data[:-1]) & (space[1:] == 0)]).astype(np.uint8) if len(data) else space
    closing = np.concatenate([sign[:-1] & space[1:], [0]]).astype(np.uint8) if len(data) else space
    lines, stops, letters = of(_LINE), of(_STOP), count(letter)
    some = np.maximum(n, 1)
    columns = [
        np.log1p(n), letters / some, count(upper) / np.maximum(letters, 1), of(_DIGIT) / some, count(space) / some, lines / some, stops / some, of(_BANG) / some, of(_SIGN) / some, of(_BAR) / some, of(_OTHER) / some, of(_HIGH) / some,
        letters / np.maximum(words, 1), words / (stops + 1), count(doubled) / some, count(closing) / np.maximum(words, 1), capital / np.maximum(words, 1), n / (lines + 1), *repetition(texts),
    ]
    return np.column_stack(columns)


@dataclass
class Model:
    """Score = logistic(base + sum of tables[i][bin of feature i] + sum of grids[(i, j)][coarse bins of i and j])."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    grids: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        bins = self.bins(x)
        for b, t in zip(bins, self.tables, strict=True):
            out += t[b]
        for (i, j), t in self.grids.items():
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values per bin of a tree with at most ``leaves`` leaves: the best cut of the best leaf, again and again."""
    edges = [(0, len(g))]
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        if not len(cut):
            return 0.0, -1
        gl, hl, gr, hr = G[cut] - G[a], H[cut] - H[a], G[b] - G[cut], H[b] - H[cut]
        gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (G[b] - G[a]) ** 2 / (H[b] - H[a] + 1)
        gain = np.where((hl >= LEAST_LEAF * 0.05) & (hr >= LEAST_LEAF * 0.05), gain, 0)
        k = int(np.argmax(gain))
        return float(gain[k]), int(cut[k])

    while len(edges) < leaves:
        gain, cut, k = max((*best(a, b), k) for k, (a, b) in enumerate(edges))
        if gain <= 1e-9:
            break
        a, b = edges[k]
        edges[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in edges:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + 1)
    return out


def boost(x: np.ndarray, y: np.ndarray, each: np.ndarray | None = None, rounds: int = ROUNDS, pairs: int = PAIRS) -> Model:
    """Cyclic boosting of one table per feature, then of one grid for each of the best pairs.  ``each``: what a row counts."""
    each = np.ones(len(y)) if each is None else each / each.mean() if len(each) else each
    share = float(np.average(y, weights=each)) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model(float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)))
    k = x.shape[1]
    quantiles = np.arange(1, BINS) / BINS
    model = Model(np.log(share / (1 - share)), cuts=[np.unique(np.quantile(x[:, i], quantiles)) for i in range(k)])
    bins = model.bins(x)
    sizes = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in sizes]
    f = np.full(len(y), model.base)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) * min(share, 1 - share) * 2  # both classes count alike
    weight = weight**0.5 * each

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return weight * (y - p), weight * np.maximum(p * (1 - p), 1e-4)

    for _ in range(rounds):
        for i in range(k):
            g, h = gradient()
            step = RATE * shallow_tree(np.bincount(bins[i], g, sizes[i]), np.bincount(bins[i], h, sizes[i]))
            model.tables[i] += step
            f += step[bins[i]]
    model.coarse = [np.minimum(np.arange(s) * PAIR_BINS // max(s, 1), PAIR_BINS - 1) for s in sizes]
    coarse = [c[b] for c, b in zip(model.coarse, bins, strict=True)]
    cells = PAIR_BINS * PAIR_BINS
    g, h = gradient()

    def gain(i: int, j: int) -> float:
        at = coarse[i] * PAIR_BINS + coarse[j]
        return float((np.bincount(at, g, cells) ** 2 / (np.bincount(at, h, cells) + 1)).sum())

    chosen = sorted(itertools.combinations(range(k), 2), key=lambda p: (-gain(*p), p))[:pairs]
    model.grids = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for p in chosen}
    for _ in range(rounds // 2):
        for i, j in chosen:
            g, h = gradient()
            at = coarse[i] * PAIR_BINS + coarse[j]
            gs, hs = np.bincount(at, g, cells).reshape(PAIR_BINS, -1), np.bincount(at, h, cells).reshape(PAIR_BINS, -1)
            # a tree of depth two: cut one feature, then the other on either side
            rows = shallow_tree(gs.sum(1), hs.sum(1), 2)
            step = np.zeros_like(gs)
            for v in np.unique(rows):
                side = rows == v
                step[side] = shallow_tree(gs[side].sum(0), hs[side].sum(0), 2)
            model.grids[(i, j)] += RATE * step
            f += RATE * step[coarse[i], coarse[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model from the labels that are not held out."""
    rows = sampled_texts(docs, labels, label, held_out=held_out_column(F.col("doc_id")), sample=sample, text=text, doc_id=doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in itertools.chain.from_iterable(text_slices(x, 2) for x in batches if x.num_rows):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(features(b.column(2)).tolist(), pa.list_(pa.float64()))], names=["y", "w", "x"])

    found = small_batches(rows).mapInArrow(run, "y int, w double, x array<double>").toPandas()  # at most two samples of rows
    x, y, w = np.array(found["x"].tolist()).reshape(-1, len(NAMES)), found["y"].to_numpy(float), found["w"].to_numpy(float)
    order = np.lexsort((y, *x.T))  # the same fit in whatever order rows come
    return boost(x[order], y[order], w[order])


def score(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        value = held.value.score(features(texts_of(part.column(1))))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), held_out_column(F.col(doc_id)).alias("_held"))
    return map_slices(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def passing(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that the model rejects."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return filter_slices(docs, text, lambda texts: held.value.score(features(texts)) >= threshold)
