"""Operator 12, byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised: a code point's class and its next two
neighbours give a symbol, a symbol is a function from state to state, and the
functions of a text are composed by a blocked scan. Composition is
associative and the functions that can arise are few (the automaton's
transition monoid), so a composition is one table look-up for a whole vector.
The state before each code point tells where the pieces of ``PATTERN`` start;
no regular expression runs over the text. Slices between starts go through a
bounded cache of merged pieces. Misses are merged side by side, a round
merging one pair of each (a table gives the rank of a pair of ids); a long
piece is merged with a heap and costs n log n. Byte offsets of the tokens are kept beside the ids, and
decoding puts every token's bytes at its offset. One pass each, no shuffle.

Ids and offsets are binary columns of little-endian unsigned 32-bit integers,
four bytes a token. Texts longer than ``SEGMENT`` bytes are scanned in
segments that hand on their state. Defined results: null and empty texts have
no tokens; bytes that are not UTF-8 count as U+FFFD; rows repeated with id and
text have equal results; an empty table gives an empty result. Only the id
and text columns are read, so other columns (clashing names included) don't
matter. Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

SEGMENT = 1 << 20   # bytes of one long text scanned at once
CACHE = 1 << 17     # merged pieces kept by a task
CACHED_LENGTH = 64  # longer pieces are merged one by one, each time
NONE = np.iinfo(np.int32).max
VOCABULARY_LIMIT = 64 << 20  # bytes of a rank file that may be sent to the tasks

# Classes of code points: other, letter, number, white space.
OTHER, LETTER, NUMBER, SPACE = range(4)
# What an apostrophe takes with it at the start of a piece.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")

# States: what the piece under way may take next. Symbols: see ``_symbols``.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_SPACE, ONE_LEFT, TWO_LEFT = STATES = range(8)
S_OTHER, S_LETTER, S_NUMBER, S_SPACE, S_BLANK, S_LAST_SPACE, S_SHORT, S_LONG = range(8)
FIRST = 8  # symbol + FIRST: the first code point of a text


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether the code point starts a piece."""
    if symbol >= FIRST:
        return _step(FREE, symbol - FIRST)[0], True
    if symbol == S_SPACE:                      # white space, more of it or the end of the text follows
        return IN_SPACE, state != IN_SPACE
    if symbol == S_BLANK:                      # a blank before something else joins what follows
        return AFTER_BLANK, True
    if symbol == S_LAST_SPACE:                 # other white space before something else stands alone
        return FREE, True
    if symbol == S_LETTER:
        if state in (ONE_LEFT, TWO_LEFT):
            return (FREE if state == ONE_LEFT else ONE_LEFT), False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    joins = state in (IN_OTHER, AFTER_BLANK)   # a joined apostrophe takes no letters with it
    if symbol == S_OTHER or joins:
        return IN_OTHER, not joins
    return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, function of each composition, next state by function and state)."""
    gens = [tuple(_step(s, x)[0] for s in STATES) for x in range(2 * FIRST)]
    known = {tuple(STATES): 0}
    todo = list(known)
    for f in todo:
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    table = np.array([[known[tuple(g[s] for s in f)] for g in todo] for f in todo])
    return np.array([known[g] for g in gens], np.uint8), table.astype(np.uint8), np.array(todo, np.uint8)


FUNCTION, COMPOSE, APPLY = _monoid()
STARTS = np.array([[_step(s, x)[1] for x in range(2 * FIRST)] for s in STATES])
_FLAT, _SIZE, _BLOCK = COMPOSE.ravel(), len(COMPOSE), 64


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive scan: composition of all functions up to each position."""
    n = len(functions)
    rows = -(-n // _BLOCK)
    if rows <= 1:
        out = functions.copy()
        for k in range(1, n):
            out[k] = COMPOSE[out[k - 1], out[k]]
        return out
    a = np.zeros(rows * _BLOCK, np.uint8)  # 0 is the identity
    a[:n] = functions
    a = np.ascontiguousarray(a.reshape(rows, _BLOCK).T)
    for k in range(1, _BLOCK):
        a[k] = _FLAT[a[k - 1] * np.intp(_SIZE) + a[k]]
    before = np.zeros(rows, np.uint8)
    before[1:] = scan(a[-1])[:-1]
    return _FLAT[before * np.intp(_SIZE) + a].T.ravel()[:n]


def class_ranges() -> np.ndarray:
    """Rows (first code point, class) of runs of one class, as the merging
    library sees letters, numbers and white space."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    cls = np.zeros(0x110000, np.uint8)
    for kind, prop in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        finder = tiktoken.Encoding("classes", pat_str=prop, mergeable_ranks={bytes([i]): i for i in range(256)},
                                   special_tokens={})
        raw = bytes(finder.encode_ordinary(everything))
        cls[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)] = kind
    edge = np.flatnonzero(np.diff(cls, prepend=255))
    return np.column_stack([edge, cls[edge]])


def _class_table(ranges: np.ndarray) -> np.ndarray:
    return np.repeat(ranges[:, 1].astype(np.uint8), np.diff(ranges[:, 0], append=0x110000))


def _symbols(points: np.ndarray, first: np.ndarray, last: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbol of each code point, from itself and the next two of its text."""
    cls = classes[points]
    after = np.append(cls[1:], SPACE)
    after[last] = SPACE
    symbol = cls.copy()
    closing = (cls == SPACE) & (after != SPACE)
    symbol[closing] = np.where(points[closing] == 0x20, S_BLANK, S_LAST_SPACE)
    at = np.flatnonzero(points == 0x27)
    if len(at):
        ends = np.append(last, np.ones(2, bool))
        padded = np.append(points, np.zeros(2, points.dtype))
        one, two = padded[at + 1] * ~ends[at], padded[at + 2] * ~(ends[at] | ends[at + 1])
        symbol[at[np.isin(one, [ord(c) for c in SHORT])]] = S_SHORT
        for x in LONG:
            symbol[at[(one == ord(x[0])) & (two == ord(x[1]))]] = S_LONG
    symbol[first] += FIRST
    return symbol


def piece_starts(buf: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte positions where a piece starts; every text that is not empty starts one."""
    found, state, pos, n = [], FREE, 0, len(buf)
    lead = (buf & 0xC0) != 0x80

    def back(p: int) -> int:
        while p < n and not lead[p]:
            p -= 1
        return p

    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    while pos < n:
        end = back(min(pos + SEGMENT, n))
        look = back(min(end + 8, n))  # at least two code points more, unless the text ends
        points = np.frombuffer(buf[pos:look].tobytes().decode().encode("utf-32-le"), np.uint32)
        at = pos + np.flatnonzero(lead[pos:look])
        last = edge[np.append(at[1:], look)]
        symbol = _symbols(points, edge[at], last, classes)
        m = int(np.searchsorted(at, end))
        at, symbol = at[:m], symbol[:m]
        states = APPLY[scan(FUNCTION[symbol]), state]
        before = np.append(np.uint8(state), states[:-1])
        found.append(at[STARTS[before, symbol]])
        state, pos = int(states[-1]), end
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file (token in base64, rank), of bounded size."""
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_LIMIT + 1)
    if len(raw) > VOCABULARY_LIMIT:
        raise ValueError(f"{path}: over {VOCABULARY_LIMIT} bytes")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError(f"{path}: a single byte has no rank")
    return ranks


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank (leftmost first) merges until none has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))    # end of the part that starts here, 0 once it is merged away
    prev = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            r = ranks.get(piece[i:end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


_RUN = 1 << 16   # pieces made into Python slices, or tokens placed, at once
_ROWS = 1 << 12  # pieces merged side by side


class Vocabulary:
    """Ranks as the tasks use them: bytes by id in one buffer, and the rank of
    every pair of tokens whose concatenation is a token. Made once on the
    driver; its size is that of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.ranks = ranks
        self.length = np.full(size, -1, np.int64)  # -1: an id without a token
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.data = np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8)
        n = np.maximum(self.length, 0)
        self.start = np.cumsum(n) - n
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.base = size + 1
        pairs = [((ranks[t[:k]] + 1) * self.base + ranks[t[k:]] + 1, r) for t, r in ranks.items()
                 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        table = np.array(sorted(pairs) or [(0, NONE)], np.int64)
        self.pair, self.pair_rank = table[:, 0].copy(), table[:, 1].astype(np.int32)
        self.classes = class_ranges()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair is no token (or a side is -1)."""
        key = (left.astype(np.int64) + 1) * self.base + right + 1
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NONE)


def _merge_rows(pieces: list[bytes], width: int, v: Vocabulary) -> list[bytes]:
    """Ids of pieces of at most ``width`` bytes, one row each: every round
    merges the leftmost pair of lowest rank in each row that still has one."""
    rows = len(pieces)
    n = np.array([len(p) for p in pieces])
    filled = np.arange(width) < n[:, None]
    token = np.full((rows, width + 1), -1, np.int32)  # the last column stands for no neighbour
    token[:, :width][filled] = v.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    rank = np.full((rows, width + 1), NONE, np.int32)
    rank[:, :width] = v.pair_ranks(token[:, :-1], token[:, 1:])
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (rows, 1))
    after[np.arange(rows), n - 1] = width
    before = np.tile(np.arange(-1, width, dtype=np.int32), (rows, 1))
    row = np.arange(rows)
    while True:
        j = rank[row].argmin(1)
        best = rank[row, j]
        more = best < NONE
        row, j, best = row[more], j[more], best[more]
        if not len(row):
            break
        gone = after[row, j]
        nxt, prev = after[row, gone], before[row, j]
        token[row, j], token[row, gone], rank[row, gone] = best, -1, NONE
        after[row, j], before[row, nxt] = nxt, j
        rank[row, j] = v.pair_ranks(best, token[row, nxt])
        rank[row, prev] = v.pair_ranks(token[row, prev], best)
    stays = token >= 0
    raw = token[stays].astype("<u4").tobytes()
    ends = (4 * np.cumsum(stays.sum(1))).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def merge_all(pieces: list[bytes], v: Vocabulary) -> dict[bytes, bytes]:
    """Ids of each piece as little-endian bytes."""
    out, rest = {}, []
    for p in pieces:
        r = v.ranks.get(p)
        if r is not None:
            out[p] = r.to_bytes(4, "little")
        elif len(p) > CACHED_LENGTH:
            out[p] = np.array(merge(p, v.ranks), "<u4").tobytes()
        else:
            rest.append(p)
    rest.sort(key=len)
    lo = 0
    while lo < len(rest):
        hi = min(lo + _ROWS, len(rest))
        while len(rest[hi - 1]) > len(rest[lo]) + 8:  # rows of one block have similar lengths
            hi = lo + (hi - lo + 1) // 2
        out.update(zip(rest[lo:hi], _merge_rows(rest[lo:hi], len(rest[hi - 1]), v)))
        lo = hi
    return out


class _Cache:
    """Piece -> ids, kept by a Python worker from task to task; bounded."""

    def __init__(self, v: Vocabulary):
        self.v, self.known, self.classes = v, {}, _class_table(v.classes)

    def ids(self, pieces: list[bytes]) -> list[bytes]:
        got = list(map(self.known.get, pieces))
        if None in got:
            new = merge_all(list({p for p, g in zip(pieces, got) if g is None}), self.v)
            got = [new[p] if g is None else g for p, g in zip(pieces, got)]
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
            self.known.update((p, i) for p, i in new.items() if len(p) <= CACHED_LENGTH)
        return got


_CACHES: dict[str, _Cache] = {}  # of the vocabulary in use


def _cache(key: str, vocabulary) -> _Cache:
    if key not in _CACHES:
        _CACHES.clear()
        _CACHES[key] = _Cache(vocabulary.value)
    return _CACHES[key]


def _valid(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with U+FFFD for bytes that are not UTF-8."""
    data = buf.tobytes()
    try:
        data.decode()
        if not len(buf) or ((buf[offs[(offs > 0) & (offs < len(buf))]] & 0xC0) != 0x80).all():
            return buf, offs
    except UnicodeDecodeError:
        pass
    texts = [data[s:e].decode("utf-8", "replace").encode() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])




def _encoder(vocabulary, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(key, vocabulary)
        for batch in batches:
            for lo, buf, offs in vec.text_arrays(batch.column(1)):
                buf, offs = _valid(buf, offs)
                starts = piece_starts(buf, offs, cache.classes)
                ends = np.append(starts[1:], len(buf))
                data, parts = buf.tobytes(), []
                for k in range(0, len(starts), _RUN):
                    spans = zip(starts[k:k + _RUN].tolist(), ends[k:k + _RUN].tolist())
                    parts.append(b"".join(cache.ids([data[s:e] for s, e in spans])))
                raw = b"".join(parts)
                length = cache.v.length[np.frombuffer(raw, "<u4")]
                at = np.cumsum(length) - length              # token starts in the chunk's bytes
                token = np.searchsorted(at, offs)            # first token of each text
                at -= np.repeat(offs[:-1], np.diff(token))
                cuts = pa.array(4 * token, pa.int32()).buffers()[1]
                made = [pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, cuts, pa.py_buffer(x)])
                        for x in (raw, at.astype("<u4").tobytes())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(offs) - 1), *made],
                                                 names=["doc_id", "ids", "offsets"])
    return run


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids, offsets (byte starts of the tokens in the UTF-8 text)."""
    task = _encoder(docs.sparkSession.sparkContext.broadcast(vocabulary), uuid.uuid4().hex)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(task, f"doc_id {kind}, ids binary, offsets binary")


def _placed(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> bytes | None:
    """Every token's bytes at its offset; None for an id without a token or offsets that leave gaps."""
    if not len(ids):
        return b""
    if len(offsets) != len(ids) or int(ids.max()) >= len(vocabulary.length):
        return None
    length = vocabulary.length[ids]
    at = offsets.astype(np.int64) - int(offsets[0])
    if length.min() < 0 or at[0] or not np.array_equal(at[1:], np.cumsum(length)[:-1]):
        return None
    out = np.empty(int(at[-1] + length[-1]), np.uint8)
    for k in range(0, len(ids), _RUN):
        i, a, n = ids[k:k + _RUN], at[k:k + _RUN], length[k:k + _RUN]
        out[vec.ranges(a, n)] = vocabulary.data[vec.ranges(vocabulary.start[i], n)]
    return out.tobytes()


def _decoder(shared, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            lo, rows = 0, batch.num_rows
            while lo < rows:
                made, size = [], 0
                while lo + len(made) < rows and size < vec.CHUNK:
                    ids, offsets = (batch.column(k)[lo + len(made)].as_buffer() for k in (0, 1))
                    text = None if ids is None or offsets is None else _placed(
                        vocabulary, np.frombuffer(ids, "<u4"), np.frombuffer(offsets, "<u4"))
                    made.append(text)
                    size += len(text or b"") + 1
                cols = [batch.column(2 + k).slice(lo, len(made)) for k in range(carried)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(made, pa.binary())],
                                                 names=[*batch.schema.names[2:], "decoded"])
                lo += len(made)
    return run


def decode(tokens: DataFrame, vocabulary: Vocabulary, carry: list[str], ids_col: str = "ids",
           offsets_col: str = "offsets") -> DataFrame:
    """The columns ``carry`` and decoded (bytes). A run of tokens cut out of
    both columns decodes to its own bytes. Null where a column is null, an id
    has no token or the offsets do not fit the tokens."""
    sc = tokens.sparkSession.sparkContext
    taken = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    df = tokens.select(F.col(ids_col).alias("__ids"), F.col(offsets_col).alias("__offsets"), *taken)
    schema = ", ".join([*(f"c{i} {tokens.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)),
                        "decoded binary"])
    return df.mapInArrow(_decoder(sc.broadcast(vocabulary), len(carry)), schema).toDF(*carry, "decoded")
