"""Structure- and graph-based similarity.

Trees are edge lists: (doc_id, node, parent, depth, label). Subtree and
neighbourhood labels are combined with commutative aggregates (count and
sums of hashes), so no node's children are ever collected into a list: a
node with a million children is one partial aggregation, not one row.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .fingerprint import overlap_pairs, shared_fingerprints, text_classes
from .tokens import token_neighbours

# HTML void elements (never have children) and the tag pattern.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
             "track", "wbr"]
TAG_RE = r"</?[A-Za-z][A-Za-z0-9]*[^>]*>"
RAW_TEXT_RE = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
ELEMENTS = 10_000  # of a result batch, from which on it is sent
P = 2147483647  # modulus for commutative hash sums (no overflow in ANSI mode)


# An opening tag of the key ends an open element of its list (HTML's
# optional end tags).
IMPLIED_END = {
    "p": ("p",), "div": ("p",), "ul": ("p",), "ol": ("p",), "table": ("p",), "h1": ("p",), "h2": ("p",),
    "h3": ("p",), "section": ("p",), "article": ("p",), "li": ("li", "p"), "dt": ("dt", "dd"), "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
# elements that an implied end does not reach through
BARRIER = ("table", "ul", "ol", "dl", "select", "td", "th", "div", "section", "article", "body", "html")


def element_tree(html: str | None) -> list[tuple[int, str, int, int | None]]:
    """(node, tag, depth, parent) of each element, in document order.

    Comments and script / style bodies are blanked first. A closing tag ends
    the nearest open element of its own name (and what is open inside it) and
    is ignored without one; open elements end with the text.
    """
    text = re.sub(RAW_TEXT_RE, r"<\1></\1>", re.sub(r"(?s)<!--.*?(-->|\Z)", "", html or ""))
    out: list[tuple[int, str, int, int | None]] = []
    stack: list[tuple[str, int]] = []
    for node, m in enumerate(re.finditer(TAG_RE, text)):
        raw = m.group()
        tag = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", raw).group(1).lower()
        if raw.startswith("</"):
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is not None:
                del stack[at:]
            continue
        ends = IMPLIED_END.get(tag, ())
        while ends and stack:
            at = next((k for k in range(len(stack) - 1, -1, -1)
                       if stack[k][0] in ends or stack[k][0] in BARRIER), None)
            if at is None or stack[at][0] not in ends:
                break
            del stack[at:]
        out.append((node, tag, len(stack), stack[-1][1] if stack else None))
        if not raw.endswith("/>") and tag not in VOID_TAGS:
            stack.append((tag, node))
    return out


def _tree_batches(batches):
    for b in batches:
        ids, pages = b.column(0), b.column(1)
        owner, flat = [], []
        for k in range(b.num_rows):  # a batch has thousands of pages: few trees are held at once
            tree = element_tree(pages[k].as_py())
            flat += tree
            owner += [k] * len(tree)
            if len(flat) >= ELEMENTS or k == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(owner, pa.int64())), pa.array([x[0] for x in flat], pa.int32()),
                     pa.array([x[2] for x in flat], pa.int64()), pa.array([x[3] for x in flat], pa.int32()),
                     pa.array([x[1] for x in flat], pa.string())], names=["doc_id", "node", "depth", "parent", "tag"])
                owner, flat = [], []


def nesting_tree(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """element tree of markup: (doc_id, node, depth, parent, tag).

    Matching open and close tags needs a stack, so a small parser runs over
    each page in Arrow batches; there is no shuffle.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_tree_batches, T.StructType([
        T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("node", T.IntegerType()),
        T.StructField("depth", T.LongType()), T.StructField("parent", T.IntegerType()),
        T.StructField("tag", T.StringType())]))


def element_digests(tree: list[tuple[int, str, int, int | None]]) -> list[tuple[int, int]]:
    """(hash, size) of each element's subtree, in one pass from the last element to the first.

    A child stands behind its parent in document order, so every child is done
    before its parent is. The hash is the one of ``subtree_hashes``.
    """
    kids = {node: [0, 0, 0, 0] for node, *_ in tree}  # count, sum, second sum, nodes
    out: list[tuple[int, int]] = []
    for node, tag, _, parent in reversed(tree):
        n, s1, s2, below = kids.pop(node)
        h = xxhash.xxh64_intdigest(tag.encode(), seed=42)
        for v in (n, s1, s2):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
        h -= (h >> 63) << 64  # signed, as Spark's
        out.append((h, below + 1))
        if parent is not None:
            up = kids[parent]
            up[0] += 1
            up[1] += h % P
            up[2] += (h % P * 31 + 7) % P
            up[3] += below + 1
    return out[::-1]


def hashed_trees(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """F1 and F2 together: (doc_id, node, tag, depth, hash, size) of each element of markup.

    The page is in one row and its tree is made in one task anyway, so subtrees
    are hashed there: one pass whatever the depth, without a shuffle or a job
    for each level. ``subtree_hashes`` gives the same rows for edge lists. Null
    or empty markup has no elements; repeated rows give repeated elements.
    """
    def parse(batches):
        for b in batches:
            ids, pages = b.column(0), b.column(1)
            for k in range(b.num_rows):  # a page at a time: its elements are all that is held
                tree = element_tree(pages[k].as_py())
                if not tree:
                    continue
                digests = element_digests(tree)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([k] * len(tree), pa.int64())), pa.array([x[0] for x in tree], pa.int32()),
                     pa.array([x[1] for x in tree], pa.string()), pa.array([x[2] for x in tree], pa.int64()),
                     pa.array([h for h, _ in digests], pa.int64()), pa.array([n for _, n in digests], pa.int64())],
                    names=["doc_id", "node", "tag", "depth", "hash", "size"])

    src = df.select(F.col(id_col).alias("doc_id"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(parse, T.StructType([
        T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("node", T.IntegerType()),
        T.StructField("tag", T.StringType()), T.StructField("depth", T.LongType()),
        T.StructField("hash", T.LongType()), T.StructField("size", T.LongType())]))


def subtree_hashes(tree: DataFrame) -> DataFrame:
    """bottom-up subtree hash and size per node of an edge list of any size
    (markup has ``hashed_trees``, which needs no job for each level).

    hash(node) = xxhash64(tag, n_children, sum and sum-of-squares (mod P) of
    the children's hashes): order-free, so reordered siblings still match.
    One aggregation per depth level, deepest first; the level table is
    checkpointed so lineage stays shallow.
    """
    tree = cut_lineage(tree.select("doc_id", "node", "tag", "depth", "parent"))  # read once per level
    depth = tree.agg(F.max("depth")).first()[0]
    if depth is None:
        return tree.select("doc_id", "node", "tag", "depth", F.lit(None).cast("long").alias("hash"),
                           F.lit(1).cast("long").alias("size")).limit(0)
    prev = None
    levels = []
    for d in range(depth, -1, -1):
        level = tree.filter(F.col("depth") == d).select("doc_id", "node", "tag", "depth", "parent")
        if prev is None:
            cur = level.select("*", F.lit(0).cast("long").alias("nc"), F.lit(0).cast("long").alias("s1"),
                               F.lit(0).cast("long").alias("s2"), F.lit(0).cast("long").alias("csize"))
        else:
            kids = (prev.groupBy("doc_id", F.col("parent").alias("node"))
                    .agg(F.count(F.lit(1)).alias("nc"), F.sum(F.pmod("hash", F.lit(P))).alias("s1"),
                         F.sum(F.pmod(F.pmod("hash", F.lit(P)) * 31 + 7, F.lit(P))).alias("s2"),
                         F.sum("size").alias("csize")))
            cur = level.join(kids, ["doc_id", "node"], "left").fillna(0, ["nc", "s1", "s2", "csize"])
        cur = cur.select("doc_id", "node", "tag", "depth", "parent",
                         F.xxhash64("tag", "nc", "s1", "s2").alias("hash"), (F.col("csize") + 1).alias("size"))
        prev = cut_lineage(cur)
        levels.append(prev)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def _subtree_masses(hashes: DataFrame) -> DataFrame:
    """Subtree counts as fingerprints: n_pos = count * size, n_fp = the document's total."""
    bag = hashes.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("cnt"), F.max("size").alias("size"))
    tot = bag.groupBy("doc_id").agg(F.sum(F.col("cnt") * F.col("size")).alias("n_fp"))
    return bag.join(tot, "doc_id").select("doc_id", "hash", (F.col("cnt") * F.col("size")).alias("n_pos"), "n_fp", "cnt",
                                          "size")


def tree_classes(hashes: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size): the classes of equal trees whose representatives F3 pairs."""
    return text_classes(_subtree_masses(hashes))


def tree_similarity(hashes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """overlap of subtree multisets weighted by subtree size, for all pairs
    of distinct trees (class representatives) with similarity >= threshold.
    ``tree_classes`` has the pages that a representative stands for.

    similarity = sum over shared hashes of min(cnt_a, cnt_b) * size, over the
    larger total size. At similarity t both sides share at least t of their
    mass, so every pair meets in both rare prefixes (``fingerprint.overlap_pairs``).
    """
    dh = cut_lineage(_subtree_masses(hashes))
    heads = text_classes(dh).filter("doc_id = class_id").select("doc_id")
    reps = dh.join(heads, "doc_id", "left_semi")
    shared = cut_lineage(shared_fingerprints(reps, threshold))
    pairs = overlap_pairs(shared, threshold)
    left = pairs.join(shared.select(F.col("doc_id").alias("doc_a"), "hash", F.col("cnt").alias("ca"), "size",
                                  F.col("n_fp").alias("ta")), "doc_a")
    both = left.join(shared.select(F.col("doc_id").alias("doc_b"), "hash", F.col("cnt").alias("cb"),
                                 F.col("n_fp").alias("tb")), ["doc_b", "hash"])
    out = both.groupBy("doc_a", "doc_b").agg(F.sum(F.least("ca", "cb") * F.col("size")).alias("shared"),
                                             F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    return out.withColumn("similarity", F.col("shared") / F.greatest("ta", "tb")).filter(F.col("similarity") >= threshold)


IDENT_RE = "^[A-Za-z_$][A-Za-z0-9_$]*$"


def flow_edges(tokens: DataFrame) -> DataFrame:
    """data-dependence edges on a token stream (doc_id, pos, token).

    A definition is an identifier directly followed by '=' (not '=='); every
    other occurrence of the identifier is a use. Each use links to the last
    definition of the same name before it (as-of lookup: ``last`` over a
    window per (doc, name) ordered by position).
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    following = F.col("next") if "next" in tokens.columns else F.lead("token").over(w)
    t = tokens.withColumn("_next", following)
    t = _last_definition(t.filter(F.col("token").rlike(IDENT_RE)).withColumn("is_def", F.col("_next") == "="))
    return t.filter(~F.col("is_def") & F.col("def_pos").isNotNull()).select(
        "doc_id", F.col("token").alias("var"), "def_pos", F.col("pos").alias("use_pos"))


def _last_definition(t: DataFrame) -> DataFrame:
    """``def_pos``: the last definition (``is_def``) of the same token before each token."""
    before = Window.partitionBy("doc_id", "token").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return t.withColumn("def_pos", F.last(F.when(F.col("is_def"), F.col("pos")), ignorenulls=True).over(before))


# Keywords whose header makes what follows conditional.
HEADER_WORDS = ("if", "while", "for", "switch", "catch")  # followed by a header in parentheses
BARE_WORDS = ("else", "do")


EDGE_TOKENS = ("(", ")", "{", "}", *BARE_WORDS)


def _shapes_control(token, prev):
    return token.isin(*EDGE_TOKENS) | F.coalesce(prev.isin(";", *EDGE_TOKENS), F.lit(False))


def control_edges(tokens: DataFrame) -> DataFrame:
    """control dependence (doc_id, var, def_pos, use_pos) on a token stream.

    A condition is ``if (..)``, ``while (..)``, ``for (..)``, ``switch (..)``,
    ``catch (..)``, ``else`` or ``do``; ``var`` and ``def_pos`` are its keyword and
    the keyword's position. It governs the block that follows it, or the one
    statement that follows without a brace. A statement starts after a brace, a
    ``;`` outside parentheses or such a condition, and depends on the condition
    directly before it, else on the innermost condition block around it.

    Nesting is found without recursion: brackets are paired by windows over
    (document, nesting depth), a running count of open condition blocks gives the
    depth of conditions, and the last block opened at a statement's depth is the
    one around it. Braces and parentheses without a partner open nothing.
    """
    t = _with_neighbours(tokens)
    found = _conditions(t.filter(_shapes_control(F.col("token"), F.col("prev"))))
    return found.filter(F.col("_by").isNotNull()).select(
        "doc_id", F.col("_by.word").alias("var"), F.col("_by.at").alias("def_pos"), F.col("pos").alias("use_pos"))


def _with_neighbours(tokens: DataFrame) -> DataFrame:
    """``prev`` and ``next`` of every token, where the table does not have them yet."""
    if {"prev", "next"} <= set(tokens.columns):
        return tokens
    doc = Window.partitionBy("doc_id").orderBy("pos")
    return tokens.select("doc_id", "pos", "token", F.lag("token").over(doc).alias("prev"), F.lead("token").over(doc).alias("next"))


def _conditions(t: DataFrame) -> DataFrame:
    """Adds ``_by`` = (word, at), the condition of each token that starts a statement. Positions count all tokens of
    a text; of the rows, those of ``_shapes_control`` decide, others do no harm."""
    doc = Window.partitionBy("doc_id").orderBy("pos")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    tok = F.col("token")
    steps = {kind: F.when(tok == a, 1).when(tok == b, -1).otherwise(0)
             for kind, (a, b) in {"round": ("(", ")"), "curly": ("{", "}")}.items()}
    t = t.withColumn("_prev", F.col("prev")).withColumn("_prev_pos", F.when(F.col("pos") > 0, F.col("pos") - 1))
    t = t.select("*", *[F.sum(v).over(upto).alias(f"_{k}") for k, v in steps.items()])
    # a bracket's level: the depth inside it, so that both brackets of a pair have the same one
    t = t.withColumn("_level", F.when(tok.isin("(", "{"), F.when(tok == "(", F.col("_round")).otherwise(F.col("_curly")))
                     .when(tok == ")", F.col("_round") + 1).when(tok == "}", F.col("_curly") + 1))
    t = t.withColumn("_kind", F.when(tok.isin("(", ")"), "round").when(tok.isin("{", "}"), "curly"))
    pair = Window.partitionBy("doc_id", "_kind", "_level").orderBy("pos")
    mate = F.lag(F.struct("token", "_prev", "_prev_pos")).over(pair)
    t = t.withColumn("_mate", F.when(tok == ")", mate)).withColumn("_closed", F.lead("token").over(pair) == "}")
    # the condition that ends right before a token: its keyword and where it stands
    header = F.when(F.col("_mate.token").eqNullSafe("(") & F.col("_mate._prev").isin(*HEADER_WORDS),
                    F.struct(F.col("_mate._prev").alias("word"), F.col("_mate._prev_pos").alias("at"))) \
        .when(tok.isin(*BARE_WORDS), F.struct(tok.alias("word"), F.col("pos").alias("at")))
    t = t.withColumn("_header", header)
    t = t.withColumn("_after", F.when(F.lag("pos").over(doc) == F.col("_prev_pos"), F.lag("_header").over(doc)))
    t = t.withColumn("_opens", (tok == "{") & F.col("_after").isNotNull() & F.coalesce("_closed", F.lit(False)))
    opened = F.lag(F.struct("token", "_opens")).over(pair)
    t = t.withColumn("_ends", F.coalesce((tok == "}") & (opened["token"] == "{") & opened["_opens"], F.lit(False)))
    t = t.withColumn("_conditions", F.sum(F.col("_opens").cast("int") - F.col("_ends").cast("int")).over(upto))
    around = Window.partitionBy("doc_id", "_conditions").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_around", F.when(F.col("_conditions") > 0, F.last(
        F.when(F.col("_opens"), F.col("_after")), ignorenulls=True).over(around)))
    starts = F.col("_after").isNotNull() | F.col("_prev").isin("{", "}") | ((F.col("_prev") == ";") & (F.col("_round") == 0))
    return t.withColumn("_by", F.when(starts & ~tok.isin("{", "}", ";", "(", ")"), F.coalesce("_after", "_around")))


def dependence_edges(tokens: DataFrame) -> DataFrame:
    """F4, both kinds: data edges (definition -> use) and control edges (condition -> statement).

    The rows of a text are shuffled once: all windows of both kinds are within a text.
    """
    ident = F.col("token").rlike(IDENT_RE)
    t = _with_neighbours(tokens).filter(ident | _shapes_control(F.col("token"), F.col("prev"))).repartition("doc_id")
    t = _conditions(_last_definition(t.withColumn("is_def", ident & (F.col("next") == "="))))
    is_use = ident & ~F.col("is_def") & F.col("def_pos").isNotNull()
    edges = F.array(F.when(is_use, F.struct(F.lit("data").alias("kind"), F.col("token").alias("var"), F.col("def_pos"))),
                    F.when(F.col("_by").isNotNull(), F.struct(F.lit("control").alias("kind"), F.col("_by.word").alias("var"),
                                                              F.col("_by.at").alias("def_pos"))))
    e = t.select("doc_id", F.col("pos").alias("use_pos"), F.explode(F.array_compact(edges)).alias("_e"))
    return e.select("doc_id", F.col("_e.var").alias("var"), F.col("_e.def_pos").alias("def_pos"), "use_pos",
                    F.col("_e.kind").alias("kind"))


def data_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens that ``flow_edges`` can use: occurrences of the names that a text defines."""
    return token_neighbours(df, lambda t, prev, nxt, names: F.array_contains(names, t) & t.rlike(IDENT_RE), id_col, text_col)


def dependence_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The tokens that ``dependence_edges`` can use, with their neighbours, chosen inside each row: tokens that
    no edge can touch are never shuffled."""
    return token_neighbours(
        df, lambda t, prev, nxt, names: (F.array_contains(names, t) & t.rlike(IDENT_RE)) | _shapes_control(t, prev),
        id_col, text_col)


def prescreen(pairs: DataFrame, stats: DataFrame, size_tol: float = 0.5, hist_tol: float = 0.5) -> DataFrame:
    """drop candidate pairs whose node counts differ by more than
    ``size_tol`` of the larger, or whose normalised tag histograms are more
    than ``hist_tol`` apart (half L1). stats = (doc_id, n_nodes, hist map<string,long>)."""
    sa = stats.select(F.col("doc_id").alias("doc_a"), F.col("n_nodes").alias("na"), F.col("hist").alias("ha"))
    sb = stats.select(F.col("doc_id").alias("doc_b"), F.col("n_nodes").alias("nb"), F.col("hist").alias("hb"))
    j = pairs.join(sa, "doc_a").join(sb, "doc_b")
    l1 = F.aggregate(F.map_values(F.map_zip_with("ha", "hb", lambda k, x, y: F.abs(
        F.coalesce(x, F.lit(0)) / F.col("na") - F.coalesce(y, F.lit(0)) / F.col("nb")))), F.lit(0.0), lambda s, v: s + v)
    j = j.withColumn("size_gap", F.abs(F.col("na") - F.col("nb")) / F.greatest("na", "nb")).withColumn("hist_dist", l1 / 2)
    return j.filter((F.col("size_gap") <= size_tol) & (F.col("hist_dist") <= hist_tol)).drop("ha", "hb")


def tree_stats(tree: DataFrame) -> DataFrame:
    """(doc_id, n_nodes, hist): node count and tag histogram per document
    (histogram keys bounded by the tag vocabulary)."""
    h = tree.groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("c"))
    return h.groupBy("doc_id").agg(F.sum("c").alias("n_nodes"), F.map_from_entries(F.collect_list(F.struct("tag", "c"))).alias("hist"))


def wl_labels(tree: DataFrame, rounds: int = 2) -> DataFrame:
    """Weisfeiler-Lehman relabelling over parent/child edges.

    Round r label = xxhash64(label_{r-1}, neighbour count, sums of the
    neighbours' labels mod P): a commutative neighbourhood digest, one edge
    join + aggregation per round, checkpointed. Returns (doc_id, node, round, label)
    for rounds 0..r. Both sides of the joins have a row a node: by the size of their
    compressed files Spark would gather millions of them in the driver for a broadcast.
    """
    edges = tree.filter(F.col("parent").isNotNull()).select("doc_id", F.col("node").alias("a"), F.col("parent").alias("b"))
    edges = cut_lineage(edges.unionByName(edges.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    lab = tree.select("doc_id", "node", F.xxhash64("tag").alias("label"))
    out = lab.withColumn("round", F.lit(0))
    for r in range(1, rounds + 1):
        nb = edges.join(lab.select("doc_id", F.col("node").alias("b"), F.col("label").alias("lb")).hint("merge"), ["doc_id", "b"])
        agg = nb.groupBy("doc_id", F.col("a").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.pmod("lb", F.lit(P))).alias("s1"),
            F.sum(F.pmod(F.pmod("lb", F.lit(P)) * 31 + 7, F.lit(P))).alias("s2"))
        lab = lab.join(agg.hint("merge"), ["doc_id", "node"], "left").fillna(0, ["n", "s1", "s2"]).select(
            "doc_id", "node", F.xxhash64("label", "n", "s1", "s2").alias("label"))
        lab = cut_lineage(lab)
        out = out.unionByName(lab.withColumn("round", F.lit(r)))
    return out


def label_bag_similarity(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """F6 score: weighted Jaccard of WL label bags for candidate pairs."""
    from .signals import bag_similarity

    bag = labels.groupBy("doc_id", F.concat_ws(":", "round", "label").alias("item")).agg(F.count(F.lit(1)).alias("cnt"))
    return bag_similarity(pairs.select("doc_a", "doc_b"), bag, "wl_similarity")
