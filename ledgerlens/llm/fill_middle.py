"""Fill-in-the-middle: each text is cut twice and its middle moved to the end, behind marks, and can be restored from that.

Units are runs of ASCII letters and single other code points. Two digest-drawn cuts part a text's units into prefix, middle
and suffix; the form says in which order they follow: psm ``<P>``prefix``<S>``suffix``<M>``middle, spm
``<S>``suffix``<P>``prefix``<M>``middle, or plain (the text as it is: empty texts, texts that hold a mark, and a share drawn
by the digest).

Displacement scatter: the texts of a batch lie end to end in one array. A difference array gets, where a part begins, by how
much its place in the output differs from the part before it; its running sum is every byte's displacement, and one scatter
builds all outputs of the batch. Restoring finds the marks of each output and gathers the bytes back by the same means.

No shuffle. Edge cases: a null text counts as empty, a null id is drawn as an empty one; equal rows give equal results, and
rows of one id share their draw; a long text is worked on whole, by itself; an empty table gives an empty one; other columns
are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow
from .wordhash import text_chunks

#: Marks before prefix, suffix and middle, and the forms by number.
MARKS = (b"<P>", b"<S>", b"<M>")
FORMS = ("plain", "psm", "spm")
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin, and each text's first unit (one entry more than texts)."""
    begins = (data & 0xC0) != 0x80
    letter = _letter[data]
    begins[1:] &= ~(letter[1:] & letter[:-1])
    begins[offsets[offsets < len(data)]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def draws(ids: list, seed: str) -> np.ndarray:
    """(text, 4): unsigned 32-bit numbers from the digest of the seed and the id."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").astype(np.int64).reshape(-1, 4)


def find_mark(data: np.ndarray, mark: bytes) -> np.ndarray:
    if len(data) < len(mark):
        return np.zeros(0, np.int64)
    found = np.ones(len(data) - len(mark) + 1, bool)
    for k, byte in enumerate(mark):
        found &= data[k : len(data) - len(mark) + 1 + k] == byte
    return np.flatnonzero(found)


def displaced(size: int, starts: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The place of each of size bytes plus the shift of the part that it is in; parts begin at starts, in order; empty ones too."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, np.diff(shifts, prepend=0))
    return np.cumsum(steps[:size]) + np.arange(size)


def cut(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray, plain_from: int, spm_below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of units and form (a place in FORMS) of each text, and the bytes of its prefix and of its middle."""
    size = np.diff(offsets)
    starts, first = units(data, offsets)
    n = np.diff(first)
    two = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1) + first[:-1, None]
    # A cut after the last unit is the end of the text.
    at = np.where(two < first[1:, None], np.append(starts, len(data))[two], offsets[1:, None]) - offsets[:-1, None]
    marked = np.zeros(len(n), bool)
    for mark in MARKS:
        place = find_mark(data, mark)
        text = np.searchsorted(offsets, place, "right") - 1
        marked[text[place + len(mark) <= offsets[text + 1]]] = True
    plain = (size == 0) | marked | (drawn[:, 2] % 100 >= plain_from)
    form = np.where(plain, 0, np.where(drawn[:, 3] % 100 < spm_below, 2, 1))
    return n, form, np.where(plain, size, at[:, 0]), np.where(plain, 0, at[:, 1] - at[:, 0])


def transform(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, prefix: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All outputs end to end and their offsets."""
    size = np.diff(offsets)
    suffix = size - prefix - middle
    wide = len(MARKS[0])
    ends = np.cumsum(size + np.where(form > 0, 3 * wide, 0))
    begin = ends - size - np.where(form > 0, 3 * wide, 0)
    lead = np.where(form > 0, wide, 0)
    to_prefix = begin + lead + np.where(form == 2, suffix + wide, 0)
    to_suffix = begin + lead + np.where(form == 1, prefix + wide, 0)
    to_suffix = np.where(form == 0, begin + size, to_suffix)
    to_middle = np.where(form == 0, begin + size, ends - middle)
    starts = np.stack((offsets[:-1], offsets[:-1] + prefix, offsets[:-1] + prefix + middle), axis=1)
    shifts = np.stack((to_prefix, to_middle, to_suffix), axis=1) - starts
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[displaced(len(data), starts.ravel(), shifts.ravel())] = data
    cutup = form > 0
    for place, mark in zip((to_prefix, to_suffix, to_middle), MARKS, strict=True):
        for k, byte in enumerate(mark):
            out[place[cutup] - wide + k] = byte
    return out, np.concatenate(([0], ends))


def restored(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end and their offsets, from outputs and forms alone. No mark of an output is text: such texts are plain."""
    cutup = np.flatnonzero(form > 0)
    wide = len(MARKS[0])
    at = np.zeros((3, len(form)), np.int64)
    for k, mark in enumerate(MARKS):
        place = find_mark(data, mark)
        text = np.searchsorted(offsets, place, "right") - 1
        own = (form[text] > 0) & (place + wide <= offsets[text + 1])
        if not np.array_equal(text[own], cutup):
            raise ValueError("an output does not hold each mark once")
        at[k, cutup] = place[own]
    begin, end = offsets[:-1], offsets[1:]
    p, s, m = at
    plain = form == 0
    prefix_from, middle_from, suffix_from = np.where(plain, begin, p + wide), np.where(plain, end, m + wide), np.where(plain, end, s + wide)
    prefix = np.where(plain, end, np.where(form == 1, s, m)) - prefix_from
    suffix = np.where(plain, end, np.where(form == 1, m, p)) - suffix_from
    middle = end - middle_from
    size = prefix + middle + suffix
    ends = np.cumsum(size)
    starts = np.stack((ends - size, ends - size + prefix, ends - suffix), axis=1)
    shifts = np.stack((prefix_from, middle_from, suffix_from), axis=1) - starts
    total = int(ends[-1]) if len(ends) else 0
    return data[displaced(total, starts.ravel(), shifts.ravel())], np.concatenate(([0], ends))


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def fill_in_middle(documents: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars (code points, null if plain) and output of each document.

    A text stays plain where its third draw modulo 100 is plain_from or more; of the others those are spm whose fourth draw
    modulo 100 is below spm_below.
    """
    source = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(1)):
                ids = batch.column(0).slice(first, last - first)
                n, form, prefix, middle = cut(data, offsets, draws(ids.to_pylist(), seed), plain_from, spm_below)
                out, ends = transform(data, offsets, form, prefix, middle)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                begin, plain = offsets[:-1], form == 0
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n), pa.array([FORMS[k] for k in form.tolist()], pa.string()), pa.array(chars[begin + prefix] - chars[begin], mask=plain), pa.array(chars[begin + prefix + middle] - chars[begin + prefix], mask=plain), _strings(out, ends)],
                    [id_col, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return map_arrow(source, run, f"`{id_col}` long, {SCHEMA}")


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """outputs with the text of each, made from its output and form alone. A null output or form gives a null text; other columns stay."""
    if restored_col in outputs.columns:
        raise ValueError(f"there is a column {restored_col} already")
    columns = outputs.columns
    numbered = outputs.toDF(*[f"c{k}" for k in range(len(columns))])  # names may hold dots and quotes
    kinds = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(outputs.schema))
    at, kind, names = columns.index(output_col), columns.index(form_col), [*numbered.columns, "made"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_chunks(batch.column(at)):
                rows = batch.slice(first, last - first)
                forms = rows.column(kind).to_pylist()
                none = np.array([f is None for f in forms]) | rows.column(at).is_null().to_numpy(zero_copy_only=False)
                text, ends = restored(data, offsets, np.array([0 if x else FORMS.index(f) for f, x in zip(forms, none.tolist(), strict=True)], np.int64))
                made = _strings(text, ends)
                if none.any():
                    made = pa.array([None if x else v for x, v in zip(none.tolist(), made.to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, made], names)

    return map_arrow(numbered, run, f"{kinds}, made string").toDF(*columns, restored_col)
