"""Mixing sources to target weights by subset-sum budget fitting.

Every document's size is its exact number of words.  A source's target is its share of the whole budget, at most
``max_repeat`` times the source.  Whole passes over a source come first; for the words that remain, documents are
counted by exact size, most of the budget is taken in proportion to those counts, and a bounded-knapsack dynamic
program over sizes fits the rest.  Within the program's capacity (65,536 words after the proportional share) its sum is as
near as any choice of the documents that are left can come; over a larger rest single documents, the largest first, bring
it within the capacity, and the sum as a whole is near the budget (off by no more than a document) without a claim to be
the nearest.  Which documents of a size are taken is decided by a seeded hash of the document's id.

At scale: the largest frame that one task sees is a source's size histogram.  Sizes are distinct positive integers,
so a source of S words has at most sqrt(2 S) of them (5.5 million at 100 TB).  Ranks are taken in hash cells, so a
source or a size that holds a third of all documents is spread over 4096 cells.

Nulls and ties: a null source is a source of its own, ordered last; a null or blank text has size 0, target share 0
and takes 0 words; repeated rows each count and are told apart by rank, so of two equal rows either may be the one
that is taken, with the same rows as result.  An empty table gives an empty result.  Other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_index, null_key, ranked, row_columns, save, whole_row

#: Capacity of the dynamic program in words; what lies beyond is first taken greedily.
DP_CAPACITY = 1 << 16


def words_column(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def knapsack(sizes: Sequence[int], counts: Sequence[int], budget: int) -> tuple[list[int], int]:
    """How many of each size to take so that their sum is as near to ``budget`` as any is (the lesser of two as near);
    and that sum.

    Bounded knapsack: a sum notes the item that reached it first, with the fewest copies, so that a walk back from
    any sum uses each item within its count.  Sums beyond twice the budget are further off than nothing at all.
    """
    most = 2 * budget
    via = np.full(most + 1, -1, np.int32)
    reached = np.zeros(most + 1, bool)
    reached[0] = True
    items = sorted((i for i in range(len(sizes)) if 0 < sizes[i] <= most and counts[i] > 0), key=lambda i: -sizes[i])
    for i in items:
        if reached[budget]:
            break
        last, size = reached, sizes[i]
        for _ in range(min(counts[i], most // size)):
            new = np.zeros_like(reached)
            new[size:] = last[:-size]
            new &= ~reached
            if not new.any():
                break
            via[new] = i
            reached = reached | new
            last = new
    sums = np.flatnonzero(reached)
    best = int(sums[np.argmin(np.abs(sums - budget))])
    taken, at = [0] * len(sizes), best
    while at:
        taken[via[at]] += 1
        at -= sizes[via[at]]
    return taken, best


def fit_budget(sizes: Sequence[int], counts: Sequence[int], budget: int, capacity: int = DP_CAPACITY) -> list[int]:
    """How many documents of each size to take for ``budget`` words in all.

    Each size gives its share, rounded down.  Then, largest first, single documents come as long as the program's
    capacity is not reached, and the program fits what is left.
    """
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if total == 0 or budget <= 0:
        return [0] * len(sizes)
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    left = budget - sum(s * t for s, t in zip(sizes, taken, strict=True))
    down = sorted((i for i in range(len(sizes)) if sizes[i] > 0), key=lambda i: -sizes[i])
    for keep in (capacity // 2, 0):
        for i in down:
            if left <= capacity:
                break
            more = max(0, min(counts[i] - taken[i], (left - keep) // sizes[i]))
            taken[i] += more
            left -= more * sizes[i]
    if 0 < left:
        more, _ = knapsack(sizes, [c - t for c, t in zip(counts, taken, strict=True)], min(left, capacity))
        taken = [a + b for a, b in zip(taken, more, strict=True)]
    return taken


def _plan(max_repeat: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes, counts = pdf["_size"].tolist(), pdf["_n"].tolist()
        total, target = sum(s * c for s, c in zip(sizes, counts, strict=True)), float(pdf["target"].iloc[0])
        passes = min(max_repeat, int(target // total)) if total else 0
        extra = fit_budget(sizes, counts, round(target) - passes * total) if passes < max_repeat else [0] * len(sizes)
        return pd.DataFrame({"_source": pdf["_source"], "_size": sizes, "source_size": total, "target": target, "_passes": passes, "_extra": extra})

    return plan


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, max_repeat: int) -> DataFrame:
    """``totals`` (_source, _none, _words) with ``target``: ``share`` of all words by weight, each at most ``max_repeat``
    times its source, what lies above dealt again by weight until nothing does."""
    order = [F.col("_none"), F.col("_source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    rows = save(global_index(totals, order, "_i").withColumn("_w", weight).withColumn("_cap", F.lit(max_repeat) * F.col("_words")), "sources")
    words, weight_sum = rows.agg(F.coalesce(F.sum("_words"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0.0))).first()
    budget, rate, met = share * words, share * words / weight_sum if weight_sum else 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(rate) * F.col("_w")
        n, above, rest = rows.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0.0))).first()
        if n == met or not rest:
            break
        met, rate = n, (budget - above) / rest
    return rows.withColumn("target", F.least(F.col("_cap").cast("double"), F.lit(rate) * F.col("_w"))).select("_source", "target")


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken; columns of those names are replaced.

    ``copies`` (0 to ``max_repeat``) says how often the mix takes the document, ``taken`` how many words that are.
    """
    body, of = F.col(text), F.col(source)
    rows = docs.select(whole_row(docs), null_key(of).alias("_source"), of.isNull().alias("_none"), words_column(body).alias("_size"), F.xxhash64(F.lit(seed), F.col(doc_id), body).alias("_order"))
    narrow = save(rows.select("_source", "_none", "_size", F.col("_order").alias("_h")), "sizes")
    counts = narrow.groupBy("_source", "_none", "_size").agg(F.count("*").alias("_n"))
    totals = counts.groupBy("_source", "_none").agg(F.sum(F.col("_size") * F.col("_n")).alias("_words"))
    targets = source_targets(totals, weights, share, max_repeat)
    planned = counts.join(targets, "_source").select("_source", "_size", "_n", "target")
    plan = save(planned.groupBy("_source").applyInPandas(_plan(max_repeat), "_source string, _size long, source_size long, target double, _passes long, _extra long"), "plan")
    out = ranked(rows, ["_source", "_size"], F.col("_order"), [], "_rank", narrow).join(plan, ["_source", "_size"])
    copies = F.col("_passes") + (F.col("_rank") < F.col("_extra")).cast("long")
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    return out.select(*row_columns(kept), F.col("_size").alias("size"), "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("_size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id", **options: object) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    wrapped = docs.select(F.col(text).alias("text"), F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), whole_row(docs))
    out = mix(wrapped, **options).filter("copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*row_columns(docs.columns))
