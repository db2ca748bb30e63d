"""Ranking with ties through bit slices against plain sorting."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from quorant.llm import bitslices, registry

from tests.oracle import assert_same


def plain(rows, places):
    """Lines (group, pair, then) with their places, by sorting."""
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[0]].append(r)
    first, last = lambda v: (v is not None, v or 0), lambda v: (v is None, v or 0)
    for g, lines in groups.items():
        lines.sort(key=lambda r: ([first(v) for v in r[1]], [last(v) for v in r[2]]))
        pairs = [r[1] for r in lines]
        for i, (_, pair, then) in enumerate(lines):
            if (place := pairs.index(pair) + 1) <= places:
                out.append((*g, i + 1, place, *pair, *then, pairs.count(pair)))
    return sorted(out, key=repr)


def found(spark, rows, places, cell, block):
    names = ["g", "h", "p", "q", "t", "u"]
    df = spark.createDataFrame([(*a, *b, *c, "x") for a, b, c in rows], "g long, h long, p long, q long, t long, u long, tied string").repartition(3)
    pick = lambda some: {c: F.col(c) for c in some}
    got = bitslices.top_places(df, pick(names[:2]), pick(names[2:4]), pick(names[4:]), places, cell, block)
    assert got.columns == ["g", "h", "pos", "place", "p", "q", "t", "u", "tied"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize(("cell", "block", "places", "seed"), [(10**6, 16, 3, 1), (20, 16, 3, 2), (20, 7, 1, 3), (50, 1000, 10, 4)])
def test_places_of_skewed_groups(spark, cell, block, places, seed):
    """A group with a third of the lines, repeated lines, ties at the cutoff, nulls everywhere, negative and extreme keys."""
    at = random.Random(seed)
    one = lambda values: at.choice(values)
    rows = []
    for i in range(400):
        g = (7, 7) if i % 3 == 0 else (one([None, 1, 2, -1]), one([None, 0, 3]))
        pair = (one([None, -5, -4, 0, 2**63 - 1]), one([None, -(2**63) if seed == 4 else -3, 0, 1]))
        rows.append((g, pair, (one([None, -1, 5, 2**40]), one([None, 0, 1]))))
    rows += [((7, 7), (None, None), (1, 1))] * 90
    assert found(spark, rows, places, cell, block) == plain(rows, places)


def test_portions_of_copies(spark, monkeypatch):
    monkeypatch.setattr(bitslices, "COPIES", 4)
    rows = [((1, 1), (0, 0), (i // 30, 0)) for i in range(60)] + [((2, None), (1, 1), (1, 1))]
    assert found(spark, rows, 3, 10, 8) == plain(rows, 3)


def test_no_lines(spark):
    assert found(spark, [((1, 1), (1, 1), (1, 1))], 3, 10, 8) == [(1, 1, 1, 1, 1, 1, 1, 1, 1)]
    empty = spark.createDataFrame([], "g long, p long")
    assert bitslices.top_places(empty, {"g": F.col("g")}, {"p": F.col("p")}, {}, 3).count() == 0


@pytest.mark.parametrize("name", sorted(registry.SHOP_SQL))
def test_same_rows_as_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert_same(registry.SHOP_QUERIES[name](spark, sf), registry.SHOP_SQL[name], sf)
