"""Families of near copies: components and link counts against all pairs, and rows that stay linear."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.operators import families
from tessera.operators import fingerprint as fpo

SCHEMA = "hash long, doc_id long, n_pos long, n_fp long, lang string"


def rows_of(docs):
    """docs: id -> (lang, {hash: count})"""
    return [(h, i, n, sum(bag.values()), lang) for i, (lang, bag) in docs.items() for h, n in bag.items()]


def brute(docs, t, scoped=True):
    ids = sorted(docs)
    links = {i: 0 for i in ids}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            (la, ba), (lb, bb) = docs[a], docs[b]
            if scoped and la != lb:
                continue
            both = ba.keys() & bb.keys()
            total = sum(ba.values()) + sum(bb.values())
            if (sum(ba[h] for h in both) + sum(bb[h] for h in both)) / total >= t:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (root(i), links[i]) for i in ids}


def random_docs(seed):
    rnd = random.Random(seed)
    docs = {}
    for i in range(120):
        lang = rnd.choice(["x", "y"])
        if docs and rnd.random() < 0.6:
            lang, bag = docs[rnd.choice(list(docs))]
            bag = dict(bag)
            for _ in range(rnd.randrange(6)):
                if rnd.random() < 0.5 and len(bag) > 1:
                    bag.pop(rnd.choice(list(bag)))
                else:
                    bag[rnd.randrange(400)] = rnd.randrange(1, 4)
        else:
            bag = {rnd.randrange(400): rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 25))}
        docs[i] = (lang, bag)
    return docs


@pytest.mark.parametrize("seed,t,block", [(1, 0.3, 256), (2, 0.5, 7), (3, 0.8, 1), (4, 0.5, 30)])
def test_components_and_links_equal_all_pairs(spark, seed, t, block):
    docs = random_docs(seed)
    df = spark.createDataFrame(rows_of(docs), SCHEMA)
    got = {r.doc_id: (r.cluster, r.links) for r in families.linked_documents(df, t, ("lang",), block=block).collect()}
    assert got == brute(docs, t)


def test_without_a_scope_and_empty(spark):
    docs = random_docs(9)
    df = spark.createDataFrame(rows_of(docs), SCHEMA).drop("lang")
    got = {r.doc_id: r.cluster for r in families.linked_documents(df, 0.4, count=False).collect()}
    assert got == {i: c for i, (c, _) in brute(docs, 0.4, scoped=False).items()}
    assert families.linked_documents(df.filter("false"), 0.4).count() == 0


def test_a_family_of_2000_near_copies_makes_few_rows(spark):
    """Each of 2000 texts differs from the base in its own way: 2 million linked pairs."""
    rnd = random.Random(5)
    base = list(range(60))
    docs = {i: ("x", dict.fromkeys([h for h in base if h not in rnd.sample(base, 4)] + [1000 + 3 * i, 1001 + 3 * i], 1))
            for i in range(2000)}
    df = spark.createDataFrame(rows_of(docs), SCHEMA).cache()
    classes = fpo.text_classes(df).filter("doc_id = class_id")
    reps = df.join(classes.select("doc_id", "class_size"), "doc_id")
    shared = fpo.shared_fingerprints(reps, 0.5)
    stars = families._star_pairs(shared, ())
    assert stars.count() < 3 * len(docs) + len(base) * len(base)
    links = families._verified(stars, shared, 0.5, ())
    labels = families._labels(classes.select("doc_id"), links)
    assert families._crossing_pairs(shared, labels, ()).count() == 0
    out = families.linked_documents(df, 0.5, count=True).agg(
        F.count("*").alias("n"), F.countDistinct("cluster").alias("c"), F.min("links").alias("lo")).first()
    assert out.n == 2000 and out.c == 1 and out.lo == 1999


def test_star_misses_are_found_between_components(spark):
    """Two texts that share a rare fingerprint with a hub they are unlike, and each other."""
    docs = {0: ("x", dict.fromkeys([1, *range(100, 130)], 1)), 1: ("x", dict.fromkeys([1, 2, 3, 4], 1)),
            2: ("x", dict.fromkeys([1, 2, 3, 5], 1)), 3: ("x", dict.fromkeys(range(100, 131), 1))}
    df = spark.createDataFrame(rows_of(docs), SCHEMA)
    got = {r.doc_id: (r.cluster, r.links) for r in families.linked_documents(df, 0.5).collect()}
    assert got == {0: (0, 1), 1: (1, 1), 2: (1, 1), 3: (0, 1)} == brute(docs, 0.5)


def test_families_that_share_a_passage_only_are_no_candidates(spark):
    # 12 families of three near copies; a passage of two fingerprints is in all of them
    rows = [(h, d, 1, 10) for f in range(12) for d in range(3 * f, 3 * f + 3)
            for h in [*range(100 * f + 1, 100 * f + 8), 5000, 5001, 10_000 + d]]
    dh = spark.createDataFrame(rows, "hash long, doc_id int, n_pos long, n_fp long")
    shared = fpo.shared_fingerprints(dh, 0.3)
    labels = dh.select("doc_id", (F.col("doc_id") - F.col("doc_id") % 3).alias("comp")).distinct()
    assert families._crossing_pairs(shared, labels, (), 0.3).count() == 0  # 2 of 10 are open: 630 pairs in the old prefixes
    some = {(r.doc_a, r.doc_b) for r in families._crossing_pairs(shared, labels, (), 0.2).collect()}
    assert len(some) == 36 * 35 // 2 - 36
    assert {r.links for r in families.linked_documents(dh, 0.3).collect()} == {2}
