"""The grouping genetic search."""

import collections
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prosegauge.llm import packing


def perfect(seed, bins=60, capacity=100):
    """Lengths cut from so many full bins."""
    rng, out = random.Random(seed), collections.Counter()
    for _ in range(bins):
        left = capacity
        while left:
            x = rng.randint(min(left, 10), min(left, 60))
            x = left if left - x < 10 else x
            out[x] += 1
            left -= x
    return dict(out)


def lengths_of(bins):
    out = collections.Counter()
    for p, m in bins.items():
        for x in p:
            out[x] += m
    return out


def count(bins):
    return sum(bins.values())


@pytest.mark.parametrize("seed", range(100, 110))
def test_search_beats_best_fit(seed):
    histogram = perfect(seed)
    plain = packing.best_fit(histogram, {}, 100)
    assert count(plain) > 60
    found = packing.evolve(histogram, [], 100, seed, 24, 400)
    assert count(found[0]) < count(plain)
    for p in found:
        assert lengths_of(p) == histogram and all(sum(x) <= 100 for x in p)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=2, max_size=12), st.integers(0, 1000))
@settings(max_examples=60, deadline=None)
def test_crossover_holds_each_piece_once(histogram, seed):
    rng = random.Random(seed)
    a, b = packing.best_fit(histogram, {}, 40), {}
    for length, n in histogram.items():
        b[(length,)] = n
    for x, y in ((a, b), (b, a), (a, a)):
        child = packing.crossover(x, y, histogram, 40, rng)
        assert lengths_of(child) == histogram and all(sum(p) <= 40 for p in child) and all(m > 0 for m in child.values())


def test_a_migrant_wins():
    histogram = perfect(7)
    best = next(p for s in range(20) for p in packing.evolve(histogram, [], 100, s, 24, 400)[:1] if count(p) == 60)
    assert packing.evolve(histogram, [best], 100, 1, 6, 0)[0] == best


def test_populations_hold_different_packings():
    found = packing.evolve(perfect(3), [], 100, 3, 12, 60)
    assert len(found) > 1 and all(a != b for i, a in enumerate(found) for b in found[:i])


def test_islands(spark):
    histogram = perfect(42)
    best = packing.pack_histogram(spark.range(1), histogram, 100, islands=2, epochs=2, population=8, generations=60, seed=5)
    assert lengths_of(best) == histogram and count(best) <= count(packing.best_fit(histogram, {}, 100))
    again = packing.pack_histogram(spark.range(1), histogram, 100, islands=2, epochs=2, population=8, generations=60, seed=5)
    assert best == again


def test_budget_bounds_the_search():
    """A histogram that cannot reach the bound ends by its budget."""
    rng = random.Random(1)
    histogram = {x: rng.randint(1, 40) for x in range(1025, 2000)}
    assert count(packing.evolve(histogram, [], 2048, 1, 24, 10**9, 20_000)[0]) == sum(histogram.values())
