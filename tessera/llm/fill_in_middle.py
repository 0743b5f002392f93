"""Operator 11, fill-in-middle by piece tables.

A document is a row of descriptors (buffer, start, length) over two immutable
buffers: its text and the sentinels. Cutting splits a descriptor, an
arrangement permutes the row, the inverse permutation restores it, and hashes
run over the descriptors' slices; no text is copied before it is written out.
``restore`` finds the pieces of a written output as descriptors over that
output and applies the inverse permutation. One pass over the documents,
without a shuffle.

Cuts fall between lines, where sha256 of ``seed:id`` says, so every run gives
the same result. Defined results: null and empty texts, and texts that hold a
sentinel, stay ``plain`` (output = text, null piece lengths); an id that is
null counts as the text ``null``; rows repeated with id and text have equal
results; an empty table gives an empty result. Only the id and text columns
are read, so other columns (clashing names included) don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

SEED = 7
RATE, SPM_SHARE = 100, 50  # percent of documents that are cut, and of those in suffix-first order
SENTINELS = ("<P>", "<S>", "<M>")  # before the prefix, the suffix, the middle

TEXT, MARKS = 0, 1
# Columns of a cut document: prefix, middle, suffix (text order), then the three sentinels.
ORDER = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
_UNITS = 3


@dataclass
class PieceTable:
    """Descriptors of n documents, k a document: three (n, k) arrays."""

    buffer: np.ndarray
    start: np.ndarray
    length: np.ndarray

    @classmethod
    def whole(cls, start: np.ndarray, end: np.ndarray) -> PieceTable:
        """One descriptor a document, over the text buffer."""
        return cls(np.full((len(start), 1), TEXT), start[:, None].copy(), (end - start)[:, None])

    def _inserted(self, k: int, buffer, start, length) -> PieceTable:
        return PieceTable(np.insert(self.buffer, k, buffer, axis=1), np.insert(self.start, k, start, axis=1),
                          np.insert(self.length, k, length, axis=1))

    def cut(self, k: int, at: np.ndarray) -> PieceTable:
        """Descriptor k of every document split at the buffer position ``at``."""
        left = at - self.start[:, k]
        out = self._inserted(k + 1, self.buffer[:, k], at, self.length[:, k] - left)
        out.length[:, k] = left
        return out

    def with_marks(self, marks: list[bytes]) -> PieceTable:
        """The sentinels' descriptors behind the others."""
        out, at = self, 0
        for m in marks:
            out = out._inserted(out.buffer.shape[1], MARKS, at, len(m))
            at += len(m)
        return out

    def arranged(self, order) -> PieceTable:
        order = list(order)
        return PieceTable(self.buffer[:, order], self.start[:, order], self.length[:, order])

    def slices(self, buffers: list[memoryview]) -> Iterator[list[memoryview]]:
        """The slices of each document, in the order of its descriptors."""
        for bs, ss, ns in zip(self.buffer.tolist(), self.start.tolist(), self.length.tolist()):
            yield [buffers[b][s:s + n] for b, s, n in zip(bs, ss, ns)]


def inverse(form: str) -> np.ndarray:
    """The permutation that puts an arranged row back into text order."""
    return np.argsort(ORDER[form])


def _sha(slices) -> str:
    h = hashlib.sha256()
    for s in slices:
        h.update(s)
    return h.hexdigest()


def _draws(seed: int, keys: list[str | None]) -> np.ndarray:
    """Four 32-bit draws of each id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'null' if k is None else k}".encode()).digest()[:16] for k in keys)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def _line_cuts(buf: np.ndarray, offs: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines of each text and the byte positions after its two drawn lines."""
    ends = np.flatnonzero(buf == 10)
    first = np.searchsorted(ends, offs)
    full = first[1:] - first[:-1]
    last = buf[np.maximum(offs[1:] - 1, 0)] if len(buf) else np.zeros(len(full), np.uint8)
    n = full + ((offs[1:] > offs[:-1]) & (last != 10))
    ends = np.append(ends, 0)

    def after(unit):
        at = ends[np.clip(first[:-1] + unit - 1, 0, len(ends) - 1)] + 1
        return np.where(unit == 0, offs[:-1], np.where(unit > full, offs[1:], at))

    a, b = draws[:, 0] % (n + 1), draws[:, 1] % (n + 1)
    return n, after(np.minimum(a, b)), after(np.maximum(a, b))


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _cutter(seed: int, rate: int, spm_share: int, sentinels: tuple[str, ...]):
    marks = [s.encode() for s in sentinels]
    mark_view = memoryview(b"".join(marks))

    def chunk(keys, buf, offs):
        data = buf.tobytes()
        views = [memoryview(data), mark_view]
        draws = _draws(seed, keys)
        n, a, b = _line_cuts(buf, offs, draws)
        holds = np.array([any(data.find(m, s, e) >= 0 for m in marks)
                          for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())], bool)
        plain = (offs[1:] == offs[:-1]) | holds | (draws[:, 2] % 100 >= rate)
        form = np.where(plain, "plain", np.where(draws[:, 3] % 100 < spm_share, "spm", "psm"))
        chars = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])

        rows = len(keys)
        out, sha, pieces = [b""] * rows, [""] * rows, [[]] * rows
        for kind in ("plain", *ORDER):
            at = np.flatnonzero(form == kind)
            if not len(at):
                continue
            table = PieceTable.whole(offs[at], offs[at + 1])
            if kind != "plain":
                table = table.cut(0, b[at]).cut(0, a[at]).with_marks(marks).arranged(ORDER[kind])
            base = offs[at][:, None] * (table.buffer == TEXT)
            places = zip(table.buffer.tolist(), (table.start - base).tolist(), table.length.tolist())
            for i, parts, (bs, ss, ns) in zip(at.tolist(), table.slices(views), places):
                out[i], sha[i] = b"".join(parts), _sha(parts)
                pieces[i] = [{"buffer": x, "start": y, "length": z} for x, y, z in zip(bs, ss, ns)]
        return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
                pa.array(chars[a] - chars[offs[:-1]], mask=plain), pa.array(chars[b] - chars[a], mask=plain),
                pa.array(pieces, _PIECES), _strings(out), pa.array(sha, pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, buf, offs in vec.text_arrays(batch.column(2)):
                ids = batch.column(0).slice(lo, len(offs) - 1)
                keys = batch.column(1).slice(lo, len(offs) - 1).to_pylist()
                yield pa.RecordBatch.from_arrays([ids, *chunk(keys, buf, offs)], names=NAMES)
    return run


def _overlapping(sentinels) -> bool:
    """Some sentinel repeats, lies inside another or starts with another's end."""
    ends = {s[i:] for s in sentinels for i in range(1, len(s))}
    return len(set(sentinels)) < len(sentinels) or any(
        t.startswith(x) or x.startswith(t) for t in sentinels for x in ends) or any(
        s != t and s.startswith(t) for s in sentinels for t in sentinels)


_PIECES = pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))
_SCHEMA = ("n long, form string, prefix_chars long, middle_chars long, "
           "pieces array<struct<buffer:int,start:bigint,length:bigint>>, output string, output_sha256 string")
NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "pieces", "output", "output_sha256"]


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE,
                   sentinels: tuple[str, ...] = SENTINELS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n (lines), form (plain, psm, spm), prefix_chars and
    middle_chars (code points), pieces (the descriptors of the output: buffer 0
    is the text, 1 the sentinels; bytes), output, output_sha256.

    ``sentinels`` stand before the prefix, the suffix and the middle. None may
    begin inside another or inside itself, so that each is found again.
    """
    if len(sentinels) != _UNITS or not all(sentinels) or _overlapping(sentinels):
        raise ValueError("three different sentinels that do not overlap are needed")
    key = F.col(id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(key.alias("doc_id"), key.cast("string").alias("key"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(_cutter(seed, rate, spm_share, tuple(sentinels)), f"doc_id {kind}, {_SCHEMA}")


def _finder(sentinels: tuple[str, ...], carried: int):
    marks = [s.encode() for s in sentinels]

    def found(data: bytes, form: str, s: int, e: int):
        """Starts and lengths of sentinel, piece, sentinel, piece, sentinel, piece."""
        starts, lengths, at = [], [], s
        for k in [c - _UNITS for c in ORDER[form] if c >= _UNITS]:
            here = data.find(marks[k], at, e)
            if here < 0 or (not starts and here != s):
                return None
            if starts:
                lengths.append(here - starts[-1])
            starts += [here, here + len(marks[k])]
            lengths.append(len(marks[k]))
            at = here + len(marks[k])
        return starts, [*lengths, e - starts[-1]]

    def chunk(forms, known, buf, offs):
        data = buf.tobytes()
        text: list[bytes | None] = [None] * len(forms)
        sha: list[str | None] = [None] * len(forms)
        todo: dict[str, list] = {k: [] for k in ORDER}
        for i, (form, ok, s, e) in enumerate(zip(forms, known, offs[:-1].tolist(), offs[1:].tolist())):
            if ok and form == "plain":
                text[i], sha[i] = data[s:e], _sha([data[s:e]])
            elif ok and form in ORDER and (at := found(data, form, s, e)):
                todo[form].append((i, *at))
        for form, rows in todo.items():
            if not rows:
                continue
            start, length = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
            table = PieceTable(np.zeros_like(start), start, length).arranged(inverse(form)[:_UNITS])
            for (i, *_), parts in zip(rows, table.slices([memoryview(data)])):
                text[i], sha[i] = b"".join(parts), _sha(parts)
        return [pa.array(text, pa.binary()).view(pa.string()), pa.array(sha, pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, output = batch.column(0), batch.column(1)
            for lo, buf, offs in vec.text_arrays(output):
                n = len(offs) - 1
                cols = [batch.column(2 + k).slice(lo, n) for k in range(carried)]
                made = chunk(forms.slice(lo, n).to_pylist(), output.slice(lo, n).is_valid().to_pylist(), buf, offs)
                yield pa.RecordBatch.from_arrays([*cols, *made],
                                                 names=[*batch.schema.names[2:], "restored", "restored_sha256"])
    return run


def restore(cut: DataFrame, carry: list[str], sentinels: tuple[str, ...] = SENTINELS, form_col: str = "form",
            output_col: str = "output") -> DataFrame:
    """The columns ``carry``, restored (the text rebuilt from form and output
    alone) and restored_sha256; both null where the output is null or does not
    have its form."""
    taken = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    df = cut.select(F.col(form_col).alias("__form"), F.col(output_col).alias("__output"), *taken)
    schema = [f"c{i} {cut.schema[c].dataType.simpleString()}" for i, c in enumerate(carry)]
    out = df.mapInArrow(_finder(tuple(sentinels), len(carry)),
                        ", ".join([*schema, "restored string", "restored_sha256 string"]))
    return out.toDF(*carry, "restored", "restored_sha256")
