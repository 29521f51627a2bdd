"""Lexical diversity, frequencies, and the laws of rank and growth.

What concerns one document alone is worked out from its own array of tokens, row by row and without a shuffle: one Arrow
function takes a batch of token lists, numbers their tokens, and finds all counts, windows, passes, ranks and curves by
sorting and summing over the whole batch.  A document is never spread over rows and never meets another, so this holds
on streams, and a very long document costs its own length.  The frames of ``linear_fit`` and ``zipf`` may be of any origin.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.lexicons import MATTR_WINDOW, MTLD_THRESHOLD
from .segment import base, tokens_of

#: Points of Heaps' curve at most or so, tokens below which there is none, and the first point that is fitted.
SAMPLES, CURVE_TOKENS, CURVE_FROM = 200, 20, 10


def counted_column(words: Column) -> Column:
    """An array of (word, count) for the distinct words of an array, in no particular order."""

    @F.arrow_udf("array<struct<word:string,count:long>>")
    def counted(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().dictionary_encode()
        code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        kinds = max(1, len(flat.dictionary))
        found, n = np.unique(doc * kinds + code, return_counts=True)
        offsets = np.searchsorted(found // kinds, np.arange(len(lists) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([flat.dictionary.take(pa.array(found % kinds)), pa.array(n, pa.int64())], names=["word", "count"]))

    return counted(words)


def ranked_column(counted: Column, k: int | None = None) -> Column:
    """An array of (word, count, rank), the first ``k``: most frequent first, ties in dictionary order (Unicode collation,
    then code points)."""
    order = F.array_sort(F.transform(counted, lambda x: F.struct((-x["count"]).alias("n"), F.collate(x["word"], "UNICODE").alias("c"), x["word"].alias("w"))))
    order = order if k is None else F.slice(order, 1, k)
    return F.transform(order, lambda x, i: F.struct(x["w"].alias("word"), (-x["n"]).alias("count"), (i + 1).alias("rank")))


def frequencies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """doc_id, word, count, rank of each type, the first ``k`` of each document."""
    rows = base(df, id_col, text_col)
    rows = rows.select("doc_id", counted_column(tokens_of(rows)).alias("_c"))
    return rows.select("doc_id", F.inline(ranked_column(F.col("_c"), k)))


def top_words(df: DataFrame, k: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return frequencies(df, id_col, text_col, k)


# --- facts of a batch of token lists -------------------------------------------------------------------------------


class Tokens:
    """A batch of token lists: the number of each token, its document, its place there, and what stands where."""

    def __init__(self, lists: pa.ListArray) -> None:
        flat = lists.flatten()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        self.ends = offsets - offsets[0]
        self.docs = len(lists)
        self.n = np.diff(self.ends)
        self.code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(self.docs), self.n)
        self.place = np.arange(len(self.code)) - self.ends[self.doc]
        order = np.argsort(self.doc * (int(self.code.max(initial=0)) + 1) + self.code, kind="stable")
        self.same = (self.code[order[1:]] == self.code[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])  # as the next one
        first = np.concatenate([[True], ~self.same])[: len(order)]
        self.first = np.zeros(len(order), bool)  # whether it is the first of its type in its document
        self.first[order] = first
        self.after = self.n[self.doc]  # the next place of its type, or the number of tokens
        self.after[order[:-1][self.same]] = self.place[order[1:][self.same]]
        starts = np.flatnonzero(first)
        self.type_doc = self.doc[order[starts]]
        self.type_count = np.diff(np.append(starts, len(order)))

    def per_doc(self, values: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, values, self.docs)


def _fits(doc: np.ndarray, x: np.ndarray, y: np.ndarray, docs: int) -> tuple[np.ndarray, ...]:
    """Least squares by document: points, slope, intercept, r2, with the conventions of ``linear_fit``."""
    total = lambda v: np.bincount(doc, v, docs)
    n = np.bincount(doc, minlength=docs)
    some = np.maximum(n, 1)
    mx, my = total(x) / some, total(y) / some
    dx, dy = x - mx[doc], y - my[doc]
    sxx, sxy, syy = total(dx * dx), total(dx * dy), total(dy * dy)
    wide, varied = (n >= 2) & (sxx > 0), syy > 1e-24
    slope = np.where(wide, sxy / np.where(sxx > 0, sxx, 1), 0.0)
    r2 = np.where(wide & varied, sxy**2 / np.where(wide & varied, sxx * syy, 1), 0.0)
    return n, slope, np.where(n >= 2, my - slope * mx, 0.0), r2


def mtld_pass(tokens: Sequence[object], threshold: float = MTLD_THRESHOLD) -> float | None:
    """Tokens per factor of one pass: a factor ends where its type-token ratio falls to the threshold; None without one."""
    factors, n, seen = 0.0, 0, set()
    for token in tokens:
        n += 1
        seen.add(token)
        if len(seen) / n <= threshold:
            factors, n, seen = factors + 1, 0, set()
    if n:
        factors += (1 - len(seen) / n) / (1 - threshold)
    return len(tokens) / factors if factors else None


def _curve(tokens: Tokens, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, tokens and distinct tokens so far of each point of Heaps' curves."""
    new = np.concatenate([[0], np.cumsum(tokens.first)])
    seen = new[1:] - new[tokens.ends[tokens.doc]]
    n, total = tokens.place + 1, tokens.n[tokens.doc]
    at = (total >= CURVE_TOKENS) & ((n % np.maximum(1, total // samples) == 0) | (n == total))
    return tokens.doc[at], n[at], seen[at]


def _ranked(tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, count and rank (from 1) of each type, the most frequent first."""
    order = np.lexsort((-tokens.type_count, tokens.type_doc))
    doc, count = tokens.type_doc[order], tokens.type_count[order]
    return doc, count, np.arange(len(doc)) - np.searchsorted(doc, doc) + 1


def _zipf(tokens: Tokens, max_rank: int, min_count: int, least: int) -> dict[str, np.ndarray]:
    doc, count, rank = _ranked(tokens)
    many = np.bincount(doc[count >= min_count], minlength=tokens.docs)
    cut = (many >= least) & (min_count > 1)
    used = ~cut[doc] | (count >= min_count)
    if max_rank > 0:
        used &= rank <= max_rank
    n, slope, intercept, r2 = _fits(doc[used], np.log10(rank[used]), np.log10(count[used]), tokens.docs)
    top = np.zeros(tokens.docs, np.int64)
    np.maximum.at(top, doc[used], rank[used])
    return {"fitted": n, "slope": slope, "intercept": intercept, "r2": r2, "fit_max_rank": top, "fit_min_count": np.where(cut, min_count, 1)}


FACTS = (
    "tokens long, types long, hapax long, dis_legomena long, window_sum long, forward double, backward double, fitted long, slope double, intercept double, r2 double, "
    "fit_max_rank long, fit_min_count long, points long, heaps_slope double, heaps_intercept double, heaps_r2 double"
)


def facts_column(tokens: Column, *, window: int = MATTR_WINDOW, threshold: float = MTLD_THRESHOLD, samples: int = SAMPLES, max_rank: int = 0, min_count: int = 2, least: int = 5) -> Column:
    """A struct of ``FACTS`` for an array of tokens."""

    @F.arrow_udf(FACTS)
    def facts(lists: pa.Array) -> pa.Array:
        tk = Tokens(lists)
        p, last = tk.place, tk.n[tk.doc] - 1
        share = np.maximum(0, np.minimum(np.minimum(p + window - 1, tk.after - 1), last) - np.maximum(p, window - 1) + 1)
        cuts = [tk.code[a:b].tolist() for a, b in zip(tk.ends[:-1].tolist(), tk.ends[1:].tolist(), strict=True)]
        types = np.bincount(tk.type_doc, minlength=tk.docs)
        times = lambda k: np.bincount(tk.type_doc[tk.type_count == k], minlength=tk.docs)
        law = _zipf(tk, max_rank, min_count, least)
        doc, n, v = _curve(tk, samples)
        far = n >= CURVE_FROM
        points, slope, intercept, r2 = _fits(doc[far], np.log10(n[far]), np.log10(v[far]), tk.docs)
        columns = [
            tk.n, types, times(1), times(2), tk.per_doc(share, tk.doc).astype(np.int64), [mtld_pass(x, threshold) for x in cuts], [mtld_pass(x[::-1], threshold) for x in cuts],
            *(law[c] for c in ("fitted", "slope", "intercept", "r2", "fit_max_rank", "fit_min_count")), points, slope, intercept, r2,
        ]
        fields = [f.strip().split() for f in FACTS.split(",")]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64() if kind == "long" else pa.float64()) for c, (_, kind) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])

    return facts(tokens)


def facts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """doc_id and ``_f``, the facts of its tokens."""
    rows = base(df, id_col, text_col)
    return rows.select("doc_id", facts_column(tokens_of(rows), **options).alias("_f"))


def diversity_columns(f: Column) -> dict[str, Column]:
    n, v = f["tokens"], f["types"]
    herdan = F.when((n >= 2) & (v >= 2), t.half_up(F.log(v.cast("double")) / F.log(n.cast("double")), 3))
    return {"tokens": n, "types": v, "hapax": f["hapax"], "dis_legomena": f["dis_legomena"], "ttr": t.half_up(t.ratio(v, n), 3), "herdan_c": herdan, "hapax_ratio": t.half_up(t.ratio(f["hapax"], v), 3)}


def mattr_columns(f: Column, window: int = MATTR_WINDOW) -> dict[str, Column]:
    n = f["tokens"]
    short = n <= window
    value = F.when(short, t.ratio(f["types"], n)).otherwise(t.ratio(f["window_sum"], F.lit(window) * (n - window + 1)))
    note = F.when(n == 0, "no words").when(short, "the plain ratio of a text no longer than the window")
    windows = F.when(n == 0, F.lit(0)).when(short, F.lit(1)).otherwise(n - window + 1).cast("long")
    return {"value": t.half_up(value, 3), "windows": windows, "window": F.when(short & (n > 0), n).otherwise(F.lit(window)).cast("long"), "note": note}


def mtld_columns(f: Column) -> dict[str, Column]:
    forward, backward, n = f["forward"], f["backward"], f["tokens"]
    both = forward.isNotNull() & backward.isNotNull()
    shown = lambda c: F.when(both, t.half_up(c, 1)).otherwise(c)
    note = F.when(n == 0, "no words").when(~both, "no factor was completed").when(n < 100, "unreliable under 100 words")
    return {"forward": shown(forward), "backward": shown(backward), "value": F.when(both, t.half_up((forward + backward) / 2, 1)), "note": note}


def zipf_columns(f: Column, least: int = 5) -> dict[str, Column]:
    enough = f["fitted"] >= least
    shown = lambda c, p: F.when(enough, t.half_up(c, p))
    return {"alpha": shown(-f["slope"], 3), "intercept": shown(f["intercept"], 4), "r2": shown(f["r2"], 3), "fitted": f["fitted"], "fit_max_rank": f["fit_max_rank"], "fit_min_count": f["fit_min_count"], "note": _zipf_note(enough, f["slope"], f["r2"])}


def heaps_columns(f: Column) -> dict[str, Column]:
    """beta, k and r2 of v = k * n^beta; null under five points."""
    enough, slope = f["points"] >= 5, f["heaps_slope"]
    shown = lambda c: F.when(enough, t.half_up(c, 3))
    note = F.when(~enough, "too few words").when(slope.between(0.35, 0.75), "usual for prose").otherwise("not usual for prose")
    return {"points": f["points"], "beta": shown(slope), "k": shown(F.pow(F.lit(10.0), f["heaps_intercept"])), "r2": shown(f["heaps_r2"]), "note": note}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def _where(rows: DataFrame, kept: Column, columns: dict[str, Column]) -> DataFrame:
    """doc_id and ``columns`` of the rows that ``kept`` holds for.  A filter would be pushed below the facts and have them
    worked out twice; a generator is not."""
    return rows.select("doc_id", F.inline(F.when(kept, F.array(F.struct(*_named(columns))))))


def diversity(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens, types, hapax, dis_legomena, ttr, herdan_c, hapax_ratio; ratios of empty texts are null."""
    return facts(df, id_col, text_col).select("doc_id", *_named(diversity_columns(F.col("_f"))))


def mattr(df: DataFrame, window: int = MATTR_WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, value, windows, window, note: the mean type-token ratio of all windows of so many tokens.

    A token counts in the windows in which it is the last of its type, so its type's next place settles how many there
    are.  A text no longer than the window has its plain ratio.
    """
    return facts(df, id_col, text_col, window=window).select("doc_id", *_named(mattr_columns(F.col("_f"), window)))


def mtld(df: DataFrame, threshold: float = MTLD_THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, forward, backward, value, note: rounded where both passes have a factor, else value is null and the other two
    are as they are."""
    return facts(df, id_col, text_col, threshold=threshold).select("doc_id", *_named(mtld_columns(F.col("_f"))))


def zipf_of_documents(df: DataFrame, max_rank: int = 0, min_count: int = 2, least: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``zipf`` for each document that has words."""
    f = F.col("_f")
    return _where(facts(df, id_col, text_col, max_rank=max_rank, min_count=min_count, least=least), f["tokens"] > 0, zipf_columns(f, least))


def _per_type(df: DataFrame, kind: str, made: object, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the rows that ``made`` (of ``Tokens`` to document and two numbers) gives for each document."""
    first, second = kind.split()

    @F.arrow_udf(f"array<struct<{first}:long,{second}:long>>")
    def lists(column: pa.Array) -> pa.Array:
        tk = Tokens(column)
        doc, x, y = made(tk)
        offsets = np.searchsorted(doc, np.arange(tk.docs + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=[first, second]))

    rows = base(df, id_col, text_col)
    return rows.select("doc_id", lists(tokens_of(rows)).alias("_l")).select("doc_id", F.inline("_l"))


def ranked_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, count, rank: as ``frequencies``, for those who need no words and so no order among ties."""
    return _per_type(df, "count rank", _ranked, id_col, text_col)


def heaps_curve(df: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, v: distinct tokens after n tokens, about ``samples`` times; texts under 20 tokens have no curve."""
    return _per_type(df, "n v", lambda tk: _curve(tk, samples), id_col, text_col)


def heaps(df: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, points, beta, k, r2, note of the fit over the curve from n = 10 on, for texts that have a curve."""
    f = F.col("_f")
    return _where(facts(df, id_col, text_col, samples=samples), f["points"] > 0, heaps_columns(f))


# --- frames of any origin ------------------------------------------------------------------------------------------


def linear_fit(df: DataFrame, x: Column, y: Column, keys: list[str]) -> DataFrame:
    """Least squares per key: n, slope, intercept, r2.  Fewer than two points give zeros, one x a slope of 0, one y an r2 of 0."""
    rows = df.select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y"))
    slope = F.coalesce(F.regr_slope("y", "x"), F.lit(0.0))
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), slope.alias("slope"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.coalesce(F.regr_r2("y", "x"), F.lit(0.0)).alias("_r2"), (F.min("y") == F.max("y")).alias("_flat"))
    enough = F.col("n") >= 2
    return sums.select(*keys, "n", F.when(enough, F.col("slope")).otherwise(0.0).alias("slope"), F.when(enough, F.col("_my") - F.col("slope") * F.col("_mx")).otherwise(0.0).alias("intercept"), F.when(enough & ~F.col("_flat"), F.col("_r2")).otherwise(0.0).alias("r2"))


def zipf_points(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rank, x, y: the logarithms of rank and count."""
    return ranked_counts(df, id_col, text_col).select("doc_id", "rank", F.log10("rank").alias("x"), F.log10("count").alias("y"))


def _zipf_note(enough: Column, slope: Column, r2: Column) -> Column:
    return F.when(~enough, "too few words").when(r2 < 0.7, "poor fit").when((slope > -0.7) | (slope < -1.5), "outside 0.7 to 1.5").otherwise("within 0.7 to 1.5")


def zipf(freq: DataFrame, max_rank: int = 0, min_count: int = 2, least: int = 5) -> DataFrame:
    """``freq`` (doc_id, count, rank) to alpha, intercept, r2, fitted, fit_max_rank, fit_min_count, note.

    The fit leaves out words that occur less than ``min_count`` times if ``least`` others are there, then all but the
    first ``max_rank``.  The frame may come from ``frequencies`` or hold any ranked series, also of fractions.
    """
    rows = freq.withColumn("_many", F.count_if(F.col("count") >= min_count).over(Window.partitionBy("doc_id")))
    cut = (F.col("_many") >= least) & F.lit(min_count > 1)
    used = rows.filter(~cut | (F.col("count") >= min_count)).withColumn("_min", F.when(cut, min_count).otherwise(1))
    if max_rank > 0:
        used = used.withColumn("_i", F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))).filter(F.col("_i") <= max_rank)
    facts = used.groupBy("doc_id").agg(F.max("rank").alias("fit_max_rank"), F.max("_min").alias("fit_min_count"))
    fit = linear_fit(used, F.log10("rank"), F.log10("count"), ["doc_id"]).withColumnRenamed("doc_id", "_id")
    enough = F.col("n") >= least
    shown = lambda c, p: F.when(enough, t.half_up(c, p))
    note = _zipf_note(enough, F.col("slope"), F.col("r2"))
    return facts.join(fit, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", shown(-F.col("slope"), 3).alias("alpha"), shown(F.col("intercept"), 4).alias("intercept"), shown(F.col("r2"), 3).alias("r2"), F.col("n").alias("fitted"), "fit_max_rank", "fit_min_count", note.alias("note"))
