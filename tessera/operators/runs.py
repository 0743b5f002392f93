"""Run-based matching: run coverage, maximal runs, merging, statement bags,
line evidence (E9, E10, E12, E13, E14).

Inputs are *gram tables* (doc_id, pos, hash): one row per r-gram start
position (no winnowing). Seeds are found by an equi-join on the gram hash --
never by comparing all pairs -- and everything after the join is keyed by the
pair (and diagonal), so each group is bounded by the two sequence lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import kgram_hashes
from ..functions.text import statements
from ..session import cut_lineage
from .fingerprint import overlap_pairs, shared_fingerprints, text_classes


def grams_from_tokens(df: DataFrame, r: int, id_col: str = "doc_id", tokens_col: str = "tokens",
                      hash_fn: str = "xxhash64") -> DataFrame:
    """(doc_id, pos, hash) for every r-gram of a token array column."""
    h = df.select(F.col(id_col).alias("doc_id"), kgram_hashes(tokens_col, r, hash_fn).alias("_h"))
    return (h.select("doc_id", F.posexplode_outer("_h").alias("pos", "hash"))
            .filter(F.col("pos").isNotNull()))


def grams_from_rows(df: DataFrame, seq_col: str, order_cols: list[str], tok_col: str, r: int,
                    n_parts: int | None = None) -> DataFrame:
    """(doc_id, pos, hash, n) for r-grams of row sequences (e.g. events per user).

    Skew-free numbering: rows are range-partitioned on (sequence, order), so
    a sequence holding a third of all rows is split into contiguous chunks;
    each chunk numbers its rows with a window keyed by (chunk, sequence) and
    is materialised once (checkpoint: range bounds are sampled, so the chunk
    assignment must not be recomputed); a chunk's offset inside its sequence
    comes from a small table of per-(sequence, chunk) counts. Grams are assembled by sending every row to
    the r gram starts it belongs to and grouping on (sequence, start) -- a
    key with at most r rows, never a whole sequence. ``n`` = sequence length.
    """
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = (df.select(F.col(seq_col).alias("doc_id"), *order_cols, F.col(tok_col).alias("tok"))
         .repartitionByRange(n_parts, "doc_id", *order_cols)
         .withColumn("_chunk", F.spark_partition_id()))
    wl = Window.partitionBy("_chunk", "doc_id").orderBy(*order_cols)
    x = (x.withColumn("_rn", F.row_number().over(wl))
         .withColumn("_cnt", F.count(F.lit(1)).over(Window.partitionBy("_chunk", "doc_id"))))
    # Range bounds are sampled per execution: materialise the chunk assignment
    # once (reliable checkpoint) so numbering and offsets see the same chunks.
    x = cut_lineage(x.select("doc_id", "tok", "_chunk", "_rn", "_cnt"))
    counts = x.select("doc_id", "_chunk", "_cnt").distinct()
    wo = Window.partitionBy("doc_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("doc_id", "_chunk", F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy("doc_id")).alias("n"))
    x = x.join(offsets, ["doc_id", "_chunk"]).select("doc_id", (F.col("_off") + F.col("_rn") - 1).alias("pos"),
                                                      "tok", "n")
    slots = x.select("doc_id", "n", F.inline(F.array(*[F.struct((F.col("pos") - j).alias("start"), F.lit(j).alias("j"))
                                                        for j in range(r)])), "tok")
    slots = slots.filter(F.col("start") >= 0)
    g = slots.groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("j", "tok"))).alias("_g"),
                                             F.max("n").alias("n"))
    g = g.filter(F.size("_g") == r)
    return g.select("doc_id", F.col("start").cast("int").alias("pos"),
                    F.xxhash64(F.transform("_g", lambda e: e["tok"])).alias("hash"), "n")


def seeds(ga: DataFrame, gb: DataFrame | None = None, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(a, b, i, j): every pair of equal r-grams (i in a, j in b). With one
    table, unordered self pairs a < b.

    No gram is left out: the run length r is the selective part, so callers
    choose it long enough for their alphabet (an r-gram of a small alphabet is
    common by chance). The join on the gram is an equi-join that AQE can split.
    """
    left = ga.select("hash", F.col("doc_id").alias(a), F.col("pos").alias("i"))
    right = (gb if gb is not None else ga).select("hash", F.col("doc_id").alias(b), F.col("pos").alias("j"))
    s = left.join(right, "hash")
    if gb is None:
        s = s.filter(F.col(a) < F.col(b))
    return s.drop("hash")


def _union_length(df: DataFrame, keys: list[str], p: str, r: int) -> DataFrame:
    """Size of the union of intervals [p, p + r - 1] per key: each distinct
    start contributes min(r, next_start - start)."""
    d = df.select(*keys, p).distinct()
    w = Window.partitionBy(*keys).orderBy(p)
    nxt = F.lead(p, 1).over(w)
    d = d.withColumn("_c", F.when(nxt.isNull(), F.lit(r)).otherwise(F.least(F.lit(r), nxt - F.col(p))))
    return d.groupBy(*keys).agg(F.sum("_c").alias("covered"))


def run_coverage(seed: DataFrame, r: int, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Tokens of each side inside a common run of length >= r.

    Exact identity: a token is in a common run of length >= r iff it lies in
    some shared r-gram, so the covered count is the union of the r-gram
    intervals starting at the seed positions of that side.
    """
    ca = _union_length(seed, [a, b], "i", r).withColumnRenamed("covered", "covered_a")
    cb = _union_length(seed, [a, b], "j", r).withColumnRenamed("covered", "covered_b")
    return ca.join(cb, [a, b])


def maximal_runs(seed: DataFrame, r: int, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Maximal common contiguous runs (a, b, start_a, start_b, len).

    Seeds on one diagonal d = i - j with consecutive i belong to one run
    (gaps-and-islands: i - row_number is constant inside an island).
    """
    s = seed.withColumn("d", F.col("i") - F.col("j"))
    w = Window.partitionBy(a, b, "d").orderBy("i")
    s = s.withColumn("_isl", F.col("i") - F.row_number().over(w))
    g = s.groupBy(a, b, "d", "_isl").agg(F.min("i").alias("start_a"), F.max("i").alias("_last"))
    return g.select(a, b, "start_a", (F.col("start_a") - F.col("d")).alias("start_b"),
                    (F.col("_last") - F.col("start_a") + r).alias("len"))


def merge_matches(runs: DataFrame, max_gap: int, min_len: int = 1, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Merge neighbouring matches broken by small insertions.

    Matches shorter than ``min_len`` are ignored; the rest of a pair, ordered
    by (start_a, start_b), are chained while the next one starts 0..max_gap
    tokens after the previous one ends on *both* sides (lag + running sum of
    break flags = island id). Output: (a, b, start_a, end_a, start_b, end_b,
    n_runs, matched) with exclusive ends.
    """
    runs = runs.filter(F.col("len") >= min_len)
    w = Window.partitionBy(a, b).orderBy("start_a", "start_b")
    pa = F.lag(F.col("start_a") + F.col("len")).over(w)
    pb = F.lag(F.col("start_b") + F.col("len")).over(w)
    ga, gb = F.col("start_a") - pa, F.col("start_b") - pb
    brk = pa.isNull() | (ga < 0) | (ga > max_gap) | (gb < 0) | (gb > max_gap)
    x = runs.withColumn("_new", F.when(brk, 1).otherwise(0))
    x = x.withColumn("_grp", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    m = x.groupBy(a, b, "_grp").agg(
        F.min("start_a").alias("start_a"), F.max(F.col("start_a") + F.col("len")).alias("end_a"),
        F.min("start_b").alias("start_b"), F.max(F.col("start_b") + F.col("len")).alias("end_b"),
        F.count(F.lit(1)).alias("n_runs"), F.sum("len").alias("matched"))
    return m.drop("_grp")


def statement_bags(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, stmt, cnt, n_stmts): lower-cased statements counted per document."""
    s = df.select(F.col(id_col).alias("doc_id"), *keep, F.transform(statements(text_col), F.lower).alias("_s"))
    s = s.withColumn("n_stmts", F.size("_s").cast("long"))
    e = s.select("doc_id", *keep, "n_stmts", F.explode_outer("_s").alias("stmt")).filter(F.col("stmt").isNotNull())
    return e.groupBy("doc_id", *keep, "stmt").agg(F.count(F.lit(1)).alias("cnt"), F.max("n_stmts").alias("n_stmts"))


def _bag_masses(bags: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    return bags.select(F.xxhash64("stmt").alias("hash"), *scope, "doc_id", F.col("cnt").alias("n_pos"),
                       F.col("n_stmts").alias("n_fp"))


def bag_classes(bags: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *scope, class_id, class_size): the classes of equal bags whose representatives E13 pairs."""
    return text_classes(_bag_masses(bags, scope), scope)


def order_free_similarity(bags: DataFrame, scope: tuple[str, ...] = (), threshold: float = 0.3) -> DataFrame:
    """Bag-of-statements overlap, insensitive to statement order, for all
    pairs of distinct bags (class representatives within the scope) with
    similarity >= threshold. ``bag_classes`` has the documents of each class.

    overlap = sum over shared statements of min(cnt_a, cnt_b); similarity =
    overlap / max(n_a, n_b). At similarity t both sides share at least t of
    their statements, so candidates meet in both rare prefixes (frequencies
    counted within the scope), and the overlap counts every shared statement.
    Statements of one document alone are in no pair and are not joined.
    """
    dh = cut_lineage(_bag_masses(bags, scope))
    heads = text_classes(dh, scope).filter("doc_id = class_id").select("doc_id", *scope)
    reps = dh.join(heads, ["doc_id", *scope], "left_semi")
    shared = cut_lineage(shared_fingerprints(reps, threshold, scope))
    cand = overlap_pairs(shared, threshold, scope)
    side = (lambda d, x: shared.select("hash", *scope, F.col("doc_id").alias(d), F.col("n_pos").alias(f"c{x}"),
                                     F.col("n_fp").alias(f"n{x}")))
    j = cand.join(side("doc_a", "a"), [*scope, "doc_a"]).join(side("doc_b", "b"), [*scope, "doc_b", "hash"])
    g = j.groupBy(*scope, "doc_a", "doc_b").agg(F.sum(F.least("ca", "cb")).alias("overlap"),
                                                F.max("na").alias("n_a"), F.max("nb").alias("n_b"))
    return g.withColumn("similarity", F.col("overlap") / F.greatest("n_a", "n_b")) \
        .filter(F.col("similarity") >= threshold)


def word_lines(text: Column | str) -> Column:
    """array<int>: 1-based line of every word token (same order as word_tokens)."""
    from ..functions.text import word_tokens

    t = F.col(text) if isinstance(text, str) else text
    return F.flatten(F.transform(F.split(t, "\n"), lambda ln, i: F.transform(word_tokens(ln), lambda _: i + 1)))


def match_evidence(runs: DataFrame, lines: DataFrame, side: str = "b", doc: str = "doc_b") -> DataFrame:
    """Line range of each matched run on one side.

    ``lines`` = (doc_id, lines array<int>) where lines[p] is the line of token p.
    The run's first and last token positions index the array directly (a
    one-to-one join on the document), no token-level explode.
    """
    l = lines.select(F.col("doc_id").alias(doc), F.col("lines").alias("_ln"))
    j = runs.join(l, doc)
    start = F.col(f"start_{side}")
    return j.select(*[c for c in runs.columns],
                    F.element_at("_ln", start + 1).alias(f"line_start_{side}"),
                    F.element_at("_ln", start + F.col("len")).alias(f"line_end_{side}"))
