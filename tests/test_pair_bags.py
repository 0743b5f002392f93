"""Bags of pairs against plain counts; blocks made small so that many of them meet."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import meeting
from tessera.operators import signals as sg


def test_bags_of_pairs_meet_in_blocks(spark):
    rnd = random.Random(2)
    bags = {d: Counter(f"i{int(rnd.random() ** 2 * 30)}" for _ in range(rnd.randrange(40))) for d in range(60)}
    pairs = {tuple(sorted(rnd.sample(range(62), 2))) for _ in range(400)}  # 60 and 61 have no bag
    b = spark.createDataFrame([(d, i, n) for d, bag in bags.items() for i, n in bag.items()], "doc_id long, item string, cnt long")
    p = spark.createDataFrame([(*x, "kept") for x in pairs], "doc_a long, doc_b long, note string")
    out = sg.bag_similarity(p, b, "sim", block_bytes=600, most=50)
    # before, a pair was joined to each item of its bags
    assert "CoGroup" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_a, r.doc_b): r.sim for r in out.collect() if r.note == "kept"}
    assert set(got) == pairs
    for (x, y), sim in got.items():
        x, y = bags.get(x, Counter()), bags.get(y, Counter())
        assert sim == (sum((x & y).values()) / sum((x | y).values()) if x or y else 0.0)


def test_a_row_goes_only_where_it_has_pairs(spark):
    """100 families of ten: a row a document and family, not one a document and block."""
    pairs = spark.createDataFrame([(10 * f + i, 10 * f + j) for f in range(100) for j in range(10) for i in range(j)],
                                  "doc_a long, doc_b long")
    rows = spark.range(1000).withColumnRenamed("id", "doc_id")
    cells, sent = meeting.meet_pairs(pairs, "doc_a", "doc_b", rows, "doc_id", F.lit(100), block_bytes=2000)
    assert cells.count() == pairs.count() and cells.filter("lo > hi").isEmpty()
    assert sent.count() == 1000 and cells.select("lo", "hi").distinct().count() > 30
    _, parts = meeting.meet_pairs(pairs, "doc_a", "doc_b", rows, "doc_id", F.lit(1000), block_bytes=2000)
    assert parts.groupBy("doc_id").count().filter("count > 10").isEmpty()  # large families are divided
