"""Fill-in-middle, byte-level BPE and the source divergence audit against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import helpers
from tessera.llm import byte_bpe, divergence, fill_in_middle as fim
from tessera.llm.q_byte_bpe import op12, vocabulary_path

# ---------------------------------------------------------------- fill in the middle

FIM_ROWS = [(1, "one\ntwo\nthree\nfour\n"), (2, "no newline at the end\nlast"), (3, ""), (4, None), (5, "a <S> inside\nx\n"),
            (6, "\n\n\n\n"), (7, "é中😀\nß\n\nz"), (8, "x"), (8, "x"), (None, "p\nq\nr\n"), (9, "half <\nS> and <P\n>\n<"),
            (10, "".join(f"line {i}\n" for i in range(50_000)))]


def brute_fim(doc_id, text, seed=7, rate=100, share=50):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k:8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < share:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("rate,share", [(100, 50), (100, 0), (100, 100), (40, 50), (0, 50)])
def test_fim_against_plain_version(spark, rate, share):
    docs = helpers.docs_frame(spark, FIM_ROWS, extra=True)
    cut = fim.fill_in_middle(docs, rate=rate, spm_share=share)
    rows = [r.asDict() for r in cut.collect()]
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows)
    assert got == Counter(brute_fim(i, t, rate=rate, share=share) for i, t in FIM_ROWS)
    marks = "".join(fim.SENTINELS).encode()
    texts = {i: t for i, t in FIM_ROWS}
    for r in rows:
        assert r["output_sha256"] == helpers.sha(r["output"].encode())
        buffers = [(texts[r["doc_id"]] or "").encode(), marks]
        assert b"".join(buffers[p["buffer"]][p["start"]:p["start"] + p["length"]] for p in r["pieces"]) \
            == r["output"].encode()
    back = {(r["doc_id"], r["restored"], r["restored_sha256"])
            for r in fim.restore(cut, ["doc_id"]).collect()}
    assert back == {(i, t or "", helpers.sha((t or "").encode())) for i, t in FIM_ROWS}


def test_fim_own_sentinels_and_broken_outputs(spark):
    own = ("[pre]", "[suf]", "[mid]")
    docs = helpers.docs_frame(spark, FIM_ROWS)
    back = fim.restore(fim.fill_in_middle(docs, sentinels=own), ["doc_id"], sentinels=own).collect()
    assert {(r.doc_id, r.restored) for r in back} == {(i, t or "") for i, t in FIM_ROWS}
    for bad in (("<a>", "<a>", "<b>"), ("aba", "c", "d"), ("<a>", "<a><b>", "c"), ("", "a", "b"), ("a", "b")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=bad)
    broken = spark.createDataFrame([("psm", "<P>a<M>b"), ("spm", None), ("other", "x"), ("psm", "x<P>a<S>b<M>c"),
                                    (None, "x"), ("psm", "<P><S><M>")], "form string, output string")
    got = sorted((r.form or "", r.output or "", r.restored) for r in fim.restore(broken, ["form", "output"]).collect())
    assert got == [("", "x", None), ("other", "x", None), ("psm", "<P><S><M>", ""), ("psm", "<P>a<M>b", None),
                   ("psm", "x<P>a<S>b<M>c", None), ("spm", "", None)]


def test_fim_empty_table(spark):
    empty = helpers.docs_frame(spark, [(1, "x")]).filter("false")
    cut = fim.fill_in_middle(empty)
    assert cut.count() == 0 and fim.restore(cut, ["doc_id"]).count() == 0


# ---------------------------------------------------------------- byte-level BPE

@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.load_ranks(vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return byte_bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PIECES = ["'", "'", "s", "t", "r", "e", "v", "l", "m", "d", " ", " ", " ", "\n", "\t", " ", " ", "1", "٣", "é",
          "ß", "中", "😀", "!", "?", "a", "B", "́", "the", "ing", "\x00", "\x1c", "_"]


def random_texts(seed, n, longest=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randrange(longest))) for _ in range(n)]


def long_text():
    return "a" * 5000 + " " + "ab" * 3000 + "'" * 700 + "1" * 999 + " " * 1200 + "x" + "\n" * 300


def by_library(library, text):
    ids = library.encode_ordinary(text or "")
    raw = np.array(ids, "<u4").tobytes()
    return len(ids), helpers.sha(raw), helpers.sha(library.decode_bytes(ids))


def test_composition_is_associative():
    c = byte_bpe.COMPOSE
    n = np.arange(len(c))
    a, b, d = np.meshgrid(n, n, n, indexing="ij")
    assert (c[c[a, b], d] == c[a, c[b, d]]).all()
    f = np.random.default_rng(1).choice(byte_bpe.FUNCTION, 10_000)
    out, at = byte_bpe.scan(f), 0
    for k in range(len(f)):
        at = c[at, f[k]]
        assert out[k] == at


@pytest.mark.parametrize("segment", [8, 13, 100, 1 << 20])
def test_piece_starts_against_the_pattern(library, vocabulary, monkeypatch, segment):
    import public_tokenizers
    import regex

    monkeypatch.setattr(byte_bpe, "SEGMENT", segment)
    classes = byte_bpe._class_table(vocabulary.classes)
    texts = random_texts(segment, 800) + [long_text(), ""]
    raw = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [int(o) + len(t[:m.start()].encode()) for t, o in zip(texts, offs)
            for m in regex.finditer(public_tokenizers.PATTERN, t)]
    assert byte_bpe.piece_starts(buf, offs, classes).tolist() == want


def test_class_table_has_the_properties_of_known_characters(vocabulary):
    classes = byte_bpe._class_table(vocabulary.classes)
    for kind, chars in ((byte_bpe.LETTER, "aZéßж中ªʰ"), (byte_bpe.NUMBER, "0٣½Ⅷ"),
                        (byte_bpe.SPACE, " \t\n\r  　\x85"), (byte_bpe.OTHER, "!_́😀\x00\x1c​")):
        assert all(classes[ord(c)] == kind for c in chars)


def test_side_by_side_merges_equal_the_heap(ranks, vocabulary):
    rnd = random.Random(5)
    pieces = list({bytes(rnd.choice(b"abcdeiost \xc3\xa9\xe4\xb8") for _ in range(rnd.randrange(1, 90))) for _ in range(3000)})
    got = byte_bpe.merge_all(pieces, vocabulary)
    for p in pieces:
        ids = np.frombuffer(got[p], "<u4").tolist()
        assert ids == byte_bpe.merge(p, ranks) == plain_merge(p, ranks)


def plain_merge(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if r == 1 << 40:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_encode_and_decode_against_the_library(spark, vocabulary, library):
    rows = [(i, t) for i, t in enumerate(random_texts(3, 400))]
    rows += [(1000, None), (1001, ""), (1002, long_text()), (1003, "same"), (1003, "same"), (None, "null id"),
             (1004, "<|endoftext|>"), (1005, "'s'd'LL I'll we've 'tis  \n x")]
    tokens = byte_bpe.encode(helpers.docs_frame(spark, rows, extra=True), vocabulary)
    back = byte_bpe.decode(tokens, vocabulary, ["doc_id", "ids", "offsets"]).collect()
    got = Counter((r.doc_id, len(r.ids) // 4, helpers.sha(bytes(r.ids)), helpers.sha(bytes(r.decoded))) for r in back)
    assert got == Counter((i, *by_library(library, t)) for i, t in rows)
    for r in back:
        ids, offsets = np.frombuffer(bytes(r.ids), "<u4"), np.frombuffer(bytes(r.offsets), "<u4")
        assert offsets.tolist() == np.cumsum([0, *map(len, library.decode_tokens_bytes(ids.tolist()))])[:-1].tolist()


def test_decode_of_runs_and_of_broken_rows(spark, vocabulary, library):
    ids = np.array(library.encode_ordinary("a run of tokens out of a text"), "<u4")
    n = np.array([len(b) for b in library.decode_tokens_bytes(ids.tolist())])
    at = (np.cumsum(n) - n).astype("<u4")
    rows = [(1, ids[2:5].tobytes(), at[2:5].tobytes()), (2, ids.tobytes(), at[:-1].tobytes()),
            (3, np.array([60_000], "<u4").tobytes(), at[:1].tobytes()), (4, None, at.tobytes()), (5, b"", b""),
            (6, ids[[0, 2]].tobytes(), at[[0, 2]].tobytes())]
    df = spark.createDataFrame([(i, x and bytearray(x), y and bytearray(y)) if x is not None else (i, None, bytearray(y))
                                for i, x, y in rows], "k int, ids binary, offsets binary")
    got = {r.k: r.decoded and bytes(r.decoded) for r in byte_bpe.decode(df, vocabulary, ["k"]).collect()}
    assert got[1] == library.decode_bytes(ids[2:5].tolist())
    assert got[2] is got[3] is got[4] is got[6] is None and not got[5] and got[5] is not None


def test_bytes_that_are_not_utf8_and_an_empty_table(spark, vocabulary, library):
    task = byte_bpe._encoder(type("B", (), {"value": vocabulary}), "test")
    texts = [b"ab\xff\xfec d", b"\xc3", b"fine", "é".encode()]
    text = pa.Array.from_buffers(pa.string(), 4, pa.array(texts, pa.binary()).buffers())
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), text], names=["doc_id", "text"])
    got = [bytes(x) for b in task(iter([batch])) for x in b.column("ids").to_pylist()]
    assert got == [np.array(library.encode_ordinary(t.decode("utf-8", "replace")), "<u4").tobytes() for t in texts]
    empty = helpers.docs_frame(spark, [(1, "x")]).filter("false")
    assert byte_bpe.decode(byte_bpe.encode(empty, vocabulary), vocabulary, ["doc_id"]).count() == 0


def test_cache_stays_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 50)
    cache = byte_bpe._Cache(vocabulary)
    for t in random_texts(9, 40):
        pieces = [w.encode() for w in t.split()]
        assert cache.ids(pieces) == [byte_bpe.merge_all([p], vocabulary)[p] for p in pieces]
        assert len(cache.known) <= 50 + len(pieces)


def test_op12_equals_the_library_on_the_given_table(spark, sf_small, library):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op12(spark, sf_small).collect()}
    assert got == {d.doc_id: by_library(library, d.text) for d in docs}


# ---------------------------------------------------------------- source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_audit(rows, min_docs, top):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = [ascii_lower(t) for t in TERM.findall(text or "")]
        count[lang, source].update(terms)
        df[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def share(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * v) for t in kept}

        p, q = {s: share(count[lang, s]) for s in sources}, share(whole)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -x, k) for k, (x, item) in enumerate(found, 1)}
    return out


def audit_rows(seed, n=300, sources=9):
    rnd = random.Random(seed)
    common = [f"w{chr(97 + i)}" for i in range(26)] + ["Größe", "中文", "naïve", "Σ", "ﬂ"]
    rare = ["".join(rnd.choice("xyzÀé") for _ in range(6)) for _ in range(200)]
    rows = []
    for _ in range(n):
        k = 0 if rnd.random() < 0.33 else rnd.randrange(sources)
        words = [rnd.choice(common[k % 5:]) if rnd.random() < 0.7 else rnd.choice(rare) for _ in range(rnd.randrange(40))]
        rows.append((" ".join(words), rnd.choice(["en", "de", None]), f"s{k}" if k else None))
    rows += [("only few", "tiny", "a"), ("other", "tiny", "b"), (None, "tiny", "c"), ("", "en", "blank"), ("1 2 3", "lone", "x")]
    return rows + rows[:20]


@pytest.mark.parametrize("block,tile", [(4096, 32), (8, 2), (5, 3), (1, 1)])
def test_audit_against_plain_version(spark, block, tile):
    rows = audit_rows(block)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "text string, lang string, source string, rank int, term string").repartition(5)
    got = [tuple(r) for r in divergence.audit(df, 10, 4, block, tile).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_audit(rows, 10, 4)


def test_a_pair_has_the_same_first_side_in_every_block():
    made = []
    for order in (1, -1):  # rows of a task come in any order
        rows = [dict(lang="en", block=0, lo=0, hi=0, v=2, width=2, source=s, tile=0, total=3, at=[0, 1], n=n, terms=None)
                for s, n in (("a", [1, 2]), ("b", [2, 1]), ("é", [3, 0]))][::order]
        schema = pa.schema([(c, pa.string()) for c in ("lang", "source")] + [(c, pa.int64()) for c in (
            "block", "lo", "hi", "v", "width", "tile", "total")] + [(c, pa.list_(pa.int64())) for c in ("at", "n")]
            + [("terms", pa.list_(pa.string()))])
        out = divergence._task(10)(pa.Table.from_pylist(rows, schema)).to_pylist()
        made.append({(r["source"], r["item"], r["value"]) for r in out})
    assert made[0] == made[1] and {m[:2] for m in made[0]} == {("a", "b"), ("a", "é"), ("b", "é")}


def test_audit_of_an_empty_table_and_of_no_terms(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "en", "a"), ("", "en", "b")]
    got = {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_equal_subtrees_are_one_node_and_pairs_are_priced_once():
    rng = np.random.default_rng(3)
    counts = np.zeros((6, 1000), np.int64)
    counts[:, rng.choice(1000, 12, replace=False)] = rng.integers(1, 5, (6, 12))
    forest = divergence.Forest(counts)
    assert forest.size() < 6 * 12 * 10 + 40  # paths to the counts above 0; the rest is one node a level
    total = counts.sum(1)
    walk = divergence.Walk(forest, np.array([0, 1]), np.array([2, 3]), total, 1000)
    p = [divergence.shares(c, np.full(1000, t), 1000) for c, t in zip(counts, total)]
    want = [int(((p[a] - p[b]) ** 2 // (p[a] + p[b])).sum()) for a, b in ((0, 2), (1, 3))]
    assert walk.sums[-1].tolist() == want
    assert sum(map(len, walk.sums)) < 2 * 2000 / 4


def test_shares_of_huge_counts_are_exact():
    c = np.array([0, 5, 2**40], np.int64)
    t = np.full(3, 2**41, np.int64)
    want = [1 + 10**9 * (int(x) + 2) // (2**41 + 14) for x in c]
    assert divergence.shares(c, t, 7).tolist() == want
