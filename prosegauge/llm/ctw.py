"""Language-model scores by context-tree weighting, with a word-count base.

A text is coded as its words, A-Z lower-cased, each with one space behind it, and an end: the tokens that the base
counts as well.  Bytes are coded as eight binary decisions.  Each decision has a tree over the preceding ``depth`` bytes; every node of
it holds a Krichevsky-Trofimov estimate, and the weights of context-tree weighting, worked out from the counts of all
training texts, mix the estimates of all depths.  The trained tree is frozen and gives each byte, and the end of the
text, a probability: a text's score is its log10, and code lengths per byte follow from it.

The tree holds every context of the training texts, none merged and none left out, so it grows with the corpus.  It
never stands in one place: a gram (a byte and the ``depth`` bytes before it) is a long whose leading bytes are its
nearest context, so the grams below one context of ``SPLIT`` bytes are one range, one task works out their subtree,
and only the weights of the topmost ``SPLIT`` bytes (at most 65,536 contexts) are put together on the driver.  A
second pass carries the mixture down and gives each gram that occurs in any text its probability.  The ``frequent``
grams and words, by their number in all texts, are broadcast (24 bytes a gram; words of up to 64 bytes); the rest,
which grow with the corpus, meet the documents' other grams and words in shuffled joins.  No key of those is hot: one
that occurs often is among the frequent ones.

Nulls and edge cases: a null text is an empty one and has the end token only; a null id counts as the text "" when it
is held out or not; repeated rows are scored each; without training texts every decision is 1/2 and base_score is
0.  An empty table gives an empty result.  Other columns do not matter.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, most_frequent, save, small_batches, sums_between, text_slices, texts_of

#: Never part of UTF-8: stands before the text's first byte and ends it.
EDGE = 255
DEPTH, FREQUENT_WORDS, FREQUENT_GRAMS = 6, 1 << 17, 1 << 21
#: Bytes of context below which one task works out a whole subtree.
SPLIT = 2
#: Rows of counts that a training task gathers before it passes them on, and grams whose subtrees it solves at once.
FLUSH, STEP = 3_000_000, 100_000
#: Ranges of grams that are merged one after the other.
RANGES = 16
#: Bytes of text whose grams are handled at once: each takes some ten longs.
SLICE = 1 << 19


def held_out_column(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % modulus == remainder


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def coded_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts, lower-cased and each followed by a space, and the places where texts begin or end."""
    data, ends = joined_bytes(pc.ascii_lower(texts))
    data = np.insert(data, ends[1:], 32)
    ends = ends + np.arange(len(ends))
    blank = _BLANK[data]
    before = np.concatenate([[True], blank[:-1]])
    before[ends[:-1]] = True
    keep = ~(blank & before)
    data = np.where(blank, np.uint8(32), data)[keep]
    return data, np.concatenate([[0], np.cumsum(keep)])[ends]


def grams_of(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram of each coded byte of the texts and of their ends, and the places where texts begin or end among them.

    Its lowest byte is the byte itself, the highest of the ``depth`` others (at most 6) the one that stands before it.
    """
    data, ends = coded_bytes(texts)
    n = len(ends) - 1
    # 8 edges before the first text, and between texts one for the end and ``depth`` for what comes before the next
    gaps = np.repeat(ends[1:], depth + 1)
    whole = np.concatenate([np.full(8, EDGE, np.uint8), np.insert(data, gaps, EDGE)])
    before = np.ndarray((len(whole) - 8,), "<u8", whole.tobytes(), 0, (1,))  # eight bytes, the last one highest
    grams = ((before >> np.uint64(64 - 8 * depth)) << np.uint64(8)) | whole[8:]
    own = np.ones(len(grams), bool)
    first = ends[1:] + (np.arange(n) + 1) * (depth + 1) - depth  # the first edge after each text's end
    own[(first[:, None] + np.arange(depth)).ravel()] = False
    return grams[own].view(np.int64), ends + np.arange(n + 1)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct-coded words of all texts (a dictionary array) and the places where texts begin or end among them."""
    chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = chunks.flatten()
    offsets = chunks.offsets.to_numpy().astype(np.int64)
    keep = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat.filter(pa.array(keep)).dictionary_encode(), kept[offsets - offsets[0]]


def count_words(rows: DataFrame) -> DataFrame:
    """``rows`` (held_out, _text) to word, n (in training texts) and m (in all); the null word counts the texts."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        t = pa.concat_tables(parts).group_by(["word"]).aggregate([("n", "sum"), ("m", "sum")])
        return pa.table({"word": t["word"], "n": t["n_sum"], "m": t["m_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        size = 0
        for part in itertools.chain.from_iterable(text_slices(b, 1, SLICE) for b in batches if b.num_rows):
            train = ~part.column(0).to_numpy(zero_copy_only=False)
            words, ends = words_of(pa.array(texts_of(part.column(1)), pa.large_string()))
            index = words.indices.to_numpy(zero_copy_only=False)
            n = np.bincount(index[np.repeat(train, np.diff(ends))], minlength=len(words.dictionary))
            m = np.bincount(index, minlength=len(words.dictionary))
            known = words.dictionary.cast(pa.string())
            parts.append(pa.table({"word": pa.concat_arrays([known, pa.nulls(1, pa.string())]), "n": pa.array(np.append(n, train.sum()), pa.int64()), "m": pa.array(np.append(m, len(train)), pa.int64())}))
            size += parts[-1].num_rows
            if size > FLUSH // 8:
                parts = [merged(parts)]
                size = parts[0].num_rows
                if size > FLUSH // 16:
                    yield from parts.pop().combine_chunks().to_batches(max_chunksize=50_000)
                    size = 0
        if parts:
            yield from merged(parts).combine_chunks().to_batches(max_chunksize=50_000)

    return small_batches(rows).select("held_out", "_text").mapInArrow(run, "word string, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


def merged_parts(parts: Sequence[tuple[np.ndarray, ...]], ranges: int = RANGES) -> Iterator[tuple[np.ndarray, ...]]:
    """The sums of ``parts`` (sorted keys and counts), in disjoint ranges of keys: what sorting takes besides the parts is
    that of one range."""
    if not parts:
        return
    keys = max((x[0] for x in parts), key=len)
    cuts = keys[np.arange(1, ranges) * len(keys) // ranges] if len(keys) else keys
    places = [np.concatenate([[0], np.searchsorted(x[0], cuts), [len(x[0])]]) for x in parts]
    for i in range(len(cuts) + 1):
        some = [[c[at[i] : at[i + 1]] for c in x] for x, at in zip(parts, places, strict=True)]
        out = _summed(*(np.concatenate(x) for x in zip(*some, strict=True)))
        if len(out[0]):
            yield out


def count_grams(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` (held_out, _text) to gram, n (in training texts) and m (in all texts)."""

    def batches_of(gram: np.ndarray, n: np.ndarray, m: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(gram), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000].astype(np.int64)) for x in (gram, n, m)], names=["gram", "n", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for part in itertools.chain.from_iterable(text_slices(b, 1, SLICE) for b in batches if b.num_rows):
            held = part.column(0).to_numpy(zero_copy_only=False)
            grams, ends = grams_of(pa.array(texts_of(part.column(1)), pa.large_string()), depth)
            out = np.repeat(held, np.diff(ends))
            for some, train in ((grams[~out], 1), (grams[out], 0)):
                found, m = np.unique(some, return_counts=True)
                parts.append((found, (m * train).astype(np.int32), m.astype(np.int32)))
            if sum(len(x[0]) for x in parts) > FLUSH:
                parts = list(merged_parts(parts))
                if sum(len(x[0]) for x in parts) > FLUSH * 3 // 4:
                    while parts:
                        yield from batches_of(*parts.pop())
        for part in merged_parts(parts):
            yield from batches_of(*part)

    return small_batches(rows).select("held_out", "_text").mapInArrow(run, "gram long, n long, m long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


# --- the tree ------------------------------------------------------------------------------------------------------


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5, by Stirling's series at x + 8."""
    y = x + 8
    low = x.copy()
    for i in range(1, 8):
        low *= x + i
    # the product of eight factors overflows from 10^38 on; counts are below 10^19
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(low)


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1.0) - math.log(math.pi)


@dataclass
class Decision:
    """One binary decision (its number of leading bits) at all contexts of one depth: the group of each row, the first
    row of each group, and the counts of 0 and 1."""

    group: np.ndarray
    first: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    below: np.ndarray | None = None  # sum of the children's log probabilities

    def block(self) -> np.ndarray:
        return kt_block(self.zeros, self.ones)


class Levels:
    """The contexts of depths ``top`` to ``depth`` above sorted, distinct grams (a context of ``depth`` bytes, nearest
    byte highest, and a symbol), with their eight decisions.

    ``rows[d]``: contexts of d bytes with a symbol each; ``up[d]``: the row at depth d of each row at d + 1.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> None:
        self.depth, self.top = depth, top
        self.rows: dict[int, np.ndarray] = {depth: grams}
        self.up: dict[int, np.ndarray] = {}
        counts = {depth: n.astype(np.float64)}
        for d in range(depth - 1, top - 1, -1):
            last = self.rows[d + 1]
            self.rows[d], self.up[d] = np.unique((last >> 16 << 8) | (last & 255), return_inverse=True)
            counts[d] = np.bincount(self.up[d], counts[d + 1], len(self.rows[d]))
        self.at: dict[int, list[Decision]] = {}
        for d, rows in self.rows.items():
            self.at[d] = []
            for bits in range(8):
                prefix = rows >> (8 - bits)
                new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
                first = np.flatnonzero(new)
                one = np.add.reduceat(counts[d] * ((rows >> (7 - bits)) & 1), first)
                self.at[d].append(Decision(np.cumsum(new) - 1, first, np.add.reduceat(counts[d], first) - one, one))

    def parent(self, d: int, bits: int) -> np.ndarray:
        """For each group of a decision at depth d: its group at depth d - 1."""
        return self.at[d - 1][bits].group[self.up[d - 1][self.at[d][bits].first]]

    def weigh(self, leaves: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Weighted log probabilities of the decisions at depth ``top``; ``leaves``: those at ``depth``, if not its blocks."""
        out = []
        for bits in range(8):
            value = leaves[bits] if leaves else self.at[self.depth][bits].block()
            for d in range(self.depth - 1, self.top - 1, -1):
                at = self.at[d][bits]
                at.below = np.bincount(self.parent(d + 1, bits), value, len(at.first))
                value = np.logaddexp(at.block(), at.below) - math.log(2)
            out.append(value)
        return out

    def mix(self, start: list[tuple[np.ndarray, ...]] | None, last: int) -> list[tuple[np.ndarray, ...]]:
        """The mixture of the decisions down to depth ``last``: the part that is settled, the weight that is left, and the
        probability of a 1 if it ends here.  ``start``: the same at the depth above ``top``, for the groups at ``top``."""
        out = []
        for bits in range(8):
            state = start[bits] if start else None
            for d in range(self.top, last + 1):
                at = self.at[d][bits]
                if d > self.top:
                    up = self.parent(d, bits)
                    state = tuple(x[up] for x in state)
                settled, left, ended = state if state else (np.zeros(len(at.first)), np.ones(len(at.first)), np.full(len(at.first), 0.5))
                seen = at.zeros + at.ones
                kt = (at.ones + 0.5) / (seen + 1)
                with np.errstate(over="ignore"):
                    stop = 1.0 if at.below is None else 1 / (1 + np.exp(at.below - at.block()))
                state = settled + left * stop * kt, left * (1 - stop), np.where(seen > 0, settled + left * kt, ended)
            out.append(state)
        return out

    def logs(self, ended: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each gram, from the probabilities of a 1 at ``depth``."""
        rows = self.rows[self.depth]
        out = np.zeros(len(rows))
        for bits in range(8):
            p = ended[bits][self.at[self.depth][bits].group]
            out += np.log10(np.where((rows >> (7 - bits)) & 1, p, 1 - p))
        return out

    def nodes(self, d: int) -> list[np.ndarray]:
        """A number for each group of each decision at depth d: its context, and the decision in heap order."""
        return [self.rows[d][at.first] >> 8 << 8 | (256 | self.rows[d][at.first] & 255) >> (8 - bits) for bits, at in enumerate(self.at[d])]


def whole_subtrees(batches: Iterator[pa.RecordBatch], shift: int, least: int = STEP) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by gram, ``least`` rows and more at once, cut where the context of ``gram >> shift`` ends."""
    kept: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        kept.append([c.to_numpy() for c in b.columns])
        size += b.num_rows
        if size >= least:
            columns = [np.concatenate(x) for x in zip(*kept, strict=True)]
            context = columns[0] >> shift
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield [x[:cut] for x in columns]
            kept, size = [[x[cut:] for x in columns]], size - cut
            least = max(least, 2 * size) if not cut else least
    if size:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def probabilities(grams: DataFrame, depth: int, split: int = SPLIT) -> DataFrame:
    """``grams`` (gram, n, m) to gram, m and log10: each gram's probability in the tree of all contexts of up to ``depth``
    bytes, mixed by the counts n."""
    split = min(split, depth)
    shift = 8 * (depth - split + 1)  # what is left of a gram is its nearest ``split`` bytes
    tasks = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grams.select("gram", "n", "m").repartition(tasks, F.shiftright("gram", shift)).sortWithinPartitions("gram")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n, _ in whole_subtrees(batches, shift):
            levels = Levels(gram, n, depth, split)
            value = np.concatenate(levels.weigh())
            ones = np.concatenate([at.ones for at in levels.at[split]])
            zeros = np.concatenate([at.zeros for at in levels.at[split]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(levels.nodes(split))), pa.array(value), pa.array(zeros), pa.array(ones)], names=["node", "value", "zeros", "ones"])

    top = dealt.mapInArrow(weigh, "node long, value double, zeros double, ones double").toArrow()  # at most 256^2 contexts
    node, value, zeros, ones = (top[c].to_numpy() for c in ("node", "value", "zeros", "ones"))
    order = np.argsort(node)
    node, value, zeros, ones = node[order], value[order], zeros[order], ones[order]
    state = _above(node, value, zeros, ones, split)
    known = grams.sparkSession.sparkContext.broadcast((node, state))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, state = known.value
        for gram, n, m in whole_subtrees(batches, shift):
            levels = Levels(gram, n, depth, split)
            levels.weigh()
            start = None
            if state:
                at = [np.searchsorted(nodes, x) for x in levels.nodes(split)]
                start = [tuple(x[i] for x in state) for i in at]
            logs = levels.logs([x[2] for x in levels.mix(start, depth)])
            for a in range(0, len(gram), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (gram, m, logs)], names=["gram", "m", "log10"])

    return dealt.mapInArrow(carry, "gram long, m long, log10 double")


def _above(node: np.ndarray, value: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: int) -> tuple[np.ndarray, ...] | None:
    """The mixture above depth ``split`` for each of its nodes (sorted), from their weighted values and counts."""
    if not split or not len(node):
        return None
    # the last decisions lead to symbols: their counts are those of the contexts' symbols
    last = (node & 128) > 0
    symbols = np.concatenate([(node[last] >> 8 << 8) | (node[last] & 127) << 1, (node[last] >> 8 << 8) | (node[last] & 127) << 1 | 1])
    # a symbol without counts may not occur at all; it does no harm, as its nodes stand above it in any case
    grams, counts = _summed(symbols, np.concatenate([zeros[last], ones[last]]))
    levels = Levels(grams, counts, split, 0)
    levels.weigh([value[np.searchsorted(node, x)] for x in levels.nodes(split)])
    found = levels.mix(None, split - 1)
    up = [levels.parent(split, bits) for bits in range(8)]
    numbers = np.concatenate(levels.nodes(split))
    order = np.argsort(numbers)
    return tuple(np.concatenate([x[i][u] for x, u in zip(found, up, strict=True)])[order] for i in range(3))


# --- scores --------------------------------------------------------------------------------------------------------


class Lookup:
    """log10 by gram, for a bounded number of grams: a hash table with open addresses."""

    def __init__(self, grams: np.ndarray, logs: np.ndarray) -> None:
        self.bits = max(4, (len(grams) * 4 // 3).bit_length())
        self.keys, self.logs = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(grams)), self._slot(grams)
        while len(left):
            free = self.keys[at] < 0
            some = left[free][::-1]
            self.keys[at[free][::-1]] = grams[some]  # of several for one slot one is in
            here = self.keys[at] == grams[left]
            self.logs[at[here]] = logs[left[here]]
            left, at = left[~here], (at[~here] + 1) & ((1 << self.bits) - 1)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each gram (0 if it is not here) and whether it is here."""
        at = self._slot(grams)
        found = self.keys[at]
        out, known = self.logs[at], found == grams
        left = np.flatnonzero(~known & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            found = self.keys[at]
            here = found == grams[left]
            out[left[here]], known[left[here]] = self.logs[at[here]], True
            more = ~here & (found >= 0)
            left, at = left[more], at[more]
        out[~known] = 0
        return out, known


def score(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", depth: int = DEPTH, frequent_words: int = FREQUENT_WORDS, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"), held_out_column(F.col(doc_id)).alias("held_out"))
    counts = save(count_words(rows), "words")
    words = counts.filter("word is not null")
    texts = counts.filter("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    total, kinds = n_words + texts, distinct + (texts > 0)
    grams = save(probabilities(save(count_grams(rows, depth), "grams"), depth), "tree")
    top = most_frequent(words.filter(F.octet_length("word") <= 64), frequent_words).select("word", "n").toArrow()
    often = most_frequent(grams, frequent_grams).select("gram", F.col("log10").cast("float").alias("log10")).toArrow()
    known = spark.sparkContext.broadcast((top["word"].combine_chunks().cast(pa.large_string()), np.append(top["n"].to_numpy(), 0), Lookup(often["gram"].to_numpy(), often["log10"].to_numpy())))
    del top, often

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times, lookup = known.value
        for part in itertools.chain.from_iterable(text_slices(b, 1, SLICE) for b in batches if b.num_rows):
            strings = pa.array(texts_of(part.column(1)), pa.large_string())
            codes, places = grams_of(strings, depth)
            value, here = lookup(codes)
            value = sums_between(value, places)
            away = np.concatenate([[0], np.cumsum(~here)])
            rare_grams = pa.ListArray.from_arrays(pa.array(away[places], pa.int32()), pa.array(codes[~here]))
            coded, ends = words_of(strings)
            where = pc.index_in(coded.dictionary, value_set=common).fill_null(len(common)).to_numpy()
            index = coded.indices.to_numpy(zero_copy_only=False)
            c = times[where][index]
            rare = (where == len(common))[index]
            logs = np.where(rare, 0.0, np.log10(c + 1.0))
            left = np.concatenate([[0], np.cumsum(rare)])
            rare_words = pa.ListArray.from_arrays(pa.array(left[ends], pa.int32()), coded.dictionary.cast(pa.string()).take(pa.array(index[rare])))
            out = [part.column(0), part.column(2), part.column(3), pa.array(np.diff(ends) + 1), pa.array(sums_between(c > 0, ends)), pa.array(sums_between(logs, ends)), pa.array(value), pa.array(np.diff(places) - 1), rare_words, rare_grams]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "row", "n_tokens", "n_common", "common_logs", "value", "n_bytes", "words", "grams"])

    numbered = rows.select("doc_id", "_text", "held_out", F.monotonically_increasing_id().alias("row"))  # fixed by the table written next
    schema = "doc_id long, held_out boolean, row long, n_tokens long, n_common long, common_logs double, value double, n_bytes long, words array<string>, grams array<long>"
    scored = save(small_batches(numbered).mapInArrow(run, schema), "scored")
    rare = scored.filter(F.size("words") > 0).select("row", F.explode("words").alias("word"))
    found = rare.join(words.select("word", "n"), "word").groupBy("row").agg(F.count_if(F.col("n") > 0).alias("n_rare"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("rare_logs"))
    rare = scored.filter(F.size("grams") > 0).select("row", F.explode("grams").alias("gram"))
    deep = rare.join(grams.select("gram", "log10"), "gram").groupBy("row").agg(F.sum("log10").alias("rare_value"))
    out = scored.drop("words", "grams").join(found, "row", "left").join(deep, "row", "left")
    end = math.log10(texts + 1)
    each = math.log10(total + kinds + 1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score_ = F.col("value") + zero("rare_value")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + zero("n_rare") + F.lit(int(texts > 0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("common_logs") + zero("rare_logs") + F.lit(end) - F.lit(each) * F.col("n_tokens")).alias("base_score"), score_.alias("score"), (-score_ * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
