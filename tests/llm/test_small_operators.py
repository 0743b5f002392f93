"""URL filter, quality rules and source mix on small fixtures."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from helpers import WORD, docs_frame
from tessera.llm.mix import mix
from tessera.llm.quality_rules import ablation, apply_policy, ledger
from tessera.llm.url_filter import VOCABULARY, checked_vocabulary, judge_urls, read_vocabulary, term_hits


def test_urls(spark):
    rows = [
        (1, "https://A.Example.ORG/en/12?q", "a.example.org", "/en/12", "example.org/en/1", "block"),
        (2, "http://x.org/es/", "x.org", "/es/", "org/", "allow"),
        (3, "http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
        (4, "http://example.com/de/adult", "example.com", "/de/adult", "com/de/", "block"),
        (5, "http://casino-x.example.com/fr/1", "casino-x.example.com", "/fr/1", "com/fr/", "allow"),
        (6, "http://casinos.example.net/", "casinos.example.net", "/", None, "allow"),
        (7, "http://a.net/casino.html", "a.net", "/casino.html", None, "block"),
        (8, "http://free.net/free/free", "free.net", "/free/free", None, "allow"),
        (9, "http://Free-bets.net", "free-bets.net", "", None, "block"),
        (10, "no scheme casino", "", "", None, "block"),
        (11, None, "", "", None, "allow"),
        (12, "x://org", "org", "", None, "allow"),
        (13, "x://org/#f", "org", "/", "org/", "allow"),
        (14, "", "", "", None, "allow"),
        (14, "http://y.net/" + "a" * 100_000 + "/xxx", "y.net", None, None, "block"),
    ]
    pages = spark.createDataFrame([(r[0], r[1], "clash", "z") for r in rows],
                                  "page_id long, url string, host string, extra string")
    got = sorted(((x.page_id, x.url or "", x.host, x.path, x.rule, x.verdict) for x in judge_urls(pages).collect()),
                 key=lambda x: (x[0], len(x[1])))
    want = [(r[0], r[1] or "", r[2], r[3] if r[3] is not None else "/" + "a" * 100_000 + "/xxx", r[4], r[5]) for r in rows]
    assert got == want
    assert judge_urls(pages.limit(0)).count() == 0 and judge_urls(pages).columns.count("host") == 1


def test_weights_of_a_vocabulary_table_decide(spark):
    """Terms and weights come from a table; distinct terms add up to the threshold, repeated ones count once."""
    table = spark.createDataFrame([("Red", 60), ("red", 30), ("blue", 40), ("green", 39), ("black", 100), ("", 100), (None, 100),
                                   ("void", None), ("-x-", 100), ("é", 50)], "term string, weight int")
    words = read_vocabulary(table)
    assert words == {"red": 60, "blue": 40, "green": 39, "black": 100, "-x-": 100, "é": 50}
    urls = ["r://red.blue", "r://RED/red/red", "r://red.green", "r://black", "r://blackred", "r://a-x-", "r://a/-x-/", None, "",
            "r://red\nblue", "r://é/blue", "r://é.red", "r://green.blue.é"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.n_strict, r.n_soft, r.weight, r.verdict)
           for r in judge_urls(pages, rules=(), vocabulary=words).collect()}
    assert [got[k] for k in range(len(urls))] == [
        (0, 2, 100, "block"), (0, 1, 60, "allow"), (0, 2, 99, "allow"), (1, 0, 100, "block"), (0, 0, 0, "allow"), (0, 0, 0, "allow"),
        (1, 0, 100, "block"), (0, 0, 0, "allow"), (0, 0, 0, "allow"), (0, 2, 100, "block"), (0, 2, 90, "allow"), (0, 2, 110, "block"),
        (0, 3, 129, "block")]
    assert {r.verdict for r in judge_urls(pages, rules=(), vocabulary={}).collect()} == {"allow"}
    assert judge_urls(pages, rules=(), vocabulary=words, threshold=130).filter("verdict = 'block'").count() == 0
    for bad in ([("a\nb", 1)], [("a", 0.5)]):
        with pytest.raises(ValueError):
            checked_vocabulary(bad)
    with pytest.raises(ValueError):
        read_vocabulary(table, max_terms=3)


def test_terms_found_together_are_those_of_each_url():
    """One scan of all URLs against a search term by term, boundaries, overlaps and neighbouring rows included."""
    import re

    import ahocorasick
    import numpy as np

    terms = list(VOCABULARY)
    auto = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        auto.add_word(t, k)
    auto.make_automaton()
    rng = random.Random(3)
    bits = [*terms, "-", ".", "/", "a", "7", "é", "\n", "\U0001f600", ""]
    urls = ["".join(rng.choices(bits, k=rng.randint(0, 8))) for _ in range(1500)]
    row, term = term_hits(urls, auto, np.array([len(t) for t in terms]))
    want = {(i, k) for i, u in enumerate(urls) for k, t in enumerate(terms)
            if re.search(rf"(?<![a-z0-9A-Z]){t}(?![a-z0-9A-Z])", u)}
    assert set(zip(row.tolist(), term.tolist())) == want and len(row) == len(want) > 300


def brute_rules(text):
    t = text or ""
    w = WORD.findall(t)
    seen, cover = {}, set()
    for s in range(len(w) - 4):
        seen.setdefault(tuple(w[s:s + 5]), []).append(s)
    for at in seen.values():
        if len(at) > 1:
            cover.update(p for s in at for p in range(s, s + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_rule_ledger(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e", "x " * 50, "# * $ a b c d e f g h i", "é\né\n\né z",
             "one two three four five six seven eight nine ten", "q" * 40_000 + " end", "w\x0bv\x0cu\r\n"]
    texts += [" ".join(r.choice("abcdé") for _ in range(r.randint(0, 400))) for _ in range(20)]
    rows = [*enumerate(texts), (3, "a"), (None, "null id")]
    led = ledger(docs_frame(spark, rows, extra=True))
    got = sorted((str(x.doc_id), x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)
                 for x in led.collect())
    assert got == sorted((str(i), *brute_rules(t)) for i, t in rows)
    for x in apply_policy(led, "base").collect():
        assert x.kept == (not (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words))
    bits = [x.fail_bits & 15 for x in led.collect()]
    for x in ablation(led, "v1").collect():
        bit = {"few_words": 1, "repeated_windows": 2, "symbols": 4, "duplicate_lines": 8}[x.rule]
        assert (x.n_failed, x.n_only_this_rule) == (sum(b & bit > 0 for b in bits), bits.count(bit))
    assert ledger(docs_frame(spark, rows).limit(0)).count() == 0


def fill(sizes, weights):
    """Water-filling with fractions: source -> target."""
    budget, capped = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        free = [s for s in sizes if s not in capped]
        if not free:
            return {s: Fraction(2 * sizes[s]) for s in sizes}
        level = (budget - sum(2 * sizes[s] for s in capped)) / sum(weights[s] for s in free)
        above = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not above:
            return {s: Fraction(2 * sizes[s]) if s in capped else weights[s] * level for s in sizes}
        capped |= above


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_exact_budgets(spark, seed):
    r = random.Random(seed)
    names = ["b", "a", "ü", "Z", "", None, "zero"]
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 40]) if s != "zero" else 0)) if i % 11 else None, s)
            for i in range(150) for s in [r.choice(names[:r.randint(2, 7)])]]
    rows += [(7, "w w w", "a"), (7, "w w w", "a"), (None, "w " * 9, "b")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, 1.0) for i, t, s in rows],
                                 "doc_id long, text string, lang string, source string, size int, target double") \
        .repartition(3)
    got = mix(docs).collect()
    again = mix(docs).collect()
    key = lambda x: tuple(str(v) for v in x)
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert all(x.target == pytest.approx(float(want[s])) and x.source_size == sizes[s] for x in own)
        assert abs(sum(x.taken for x in own) - want[s]) < 1.001
        assert all(0 <= x.taken <= 2 * x.size for x in own)
    assert mix(docs.limit(0)).count() == 0


def test_rule_ablation_of_odd_texts(spark, tmp_path):
    """Null, empty, repeated and symbol-only texts: the report from the written ledger equals a plain count."""
    from tessera.llm.q_rules import quality_rule_ablation
    from tessera.llm.quality_rules import BIT, POLICIES, ledger

    rows = [(1, None), (2, ""), (2, ""), (3, "a b c d e " * 6), (4, "# $ % & * a"), (5, "x" * 900), (6, "one two\none two\none two"),
            (None, " ".join(f"word{k}" for k in range(40)))]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fail_bits int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bits = [r.fail_bits for r in ledger(docs).collect()]
    got = {(r.policy, r.rule): (r.n_failed, r.n_only_this_rule, r.n_rejected) for r in quality_rule_ablation(spark, str(tmp_path)).collect()}
    want = {}
    for policy, rules in POLICIES.items():
        own = [b & sum(BIT[r] for r in rules) for b in bits]
        for r in rules:
            want[policy, r] = (sum(b & BIT[r] != 0 for b in own), sum(b == BIT[r] for b in own), sum(b != 0 for b in own))
    assert got == want and any(w[1] for w in want.values())
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert quality_rule_ablation(spark, f"{tmp_path}/none").count() == 0
