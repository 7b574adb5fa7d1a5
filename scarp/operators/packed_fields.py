"""Whole lists packed into one text field, split into one value per row.

The scan works on the bytes of an Arrow string array at once: quote parity and
bracket depth are running sums, separators are a mask over both, and the values
come out as a list array whose child offsets follow from the masks. No value is
touched by itself in Python; a task holds one slice of one batch.

Notations understood, mixed freely within one column:

* separators ``,`` ``;`` ``|`` or, when the field has several lines or tabs,
  only line breaks and tabs (then nothing is quoted);
* double quotes around values, doubled inside (``"cap ""B"", long"``);
* JSON and Python lists, with backslash escapes and either quote;
* lists of pairs, as ``a|b; c|d``, ``[["a","b"],...]`` or ``[('a','b'),...]``.

A separator inside quotes, brackets or parentheses never separates, nor does a
comma or semicolon between two digits of a chemical name (``3,4-dichloro``).
Quotes or brackets that are not balanced in a field count as ordinary characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A field that holds only one of these words (any case) is missing.
MISSING = ("", "nan", "none", "null", "n/a", "na", "-", "--", "?", "[]", "()", "{}", '""', "''", "<na>", "nil", "missing", "not available")

TAB, LF, CR, SPACE, DQ, SQ, LPAR, RPAR, COMMA, SEMI, LBR, BSL, RBR, BAR = (ord(c) for c in "\t\n\r \"'(),;[\\]|")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Bytes of text taken at once; the masks need a few dozen bytes of memory for each.
SLICE_BYTES = 4 << 20


def _table(chars: list[int]) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[chars] = True
    return mask


_LINE = _table([TAB, LF, CR])
_QUOTE = _table([DQ, SQ])
_SEPARATORS = {
    "value": _table([SEMI, COMMA, BAR]),
    "pair": _table([SEMI, COMMA, TAB, LF, CR]),
    "index": _table([SEMI, COMMA, BAR, TAB, LF, CR, SPACE]),
}


def _walk_mixed(data: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Structural quotes of rows that use both kinds: the k-th quoted value of all rows at once."""
    structural = np.zeros(len(at), bool)
    nxt = np.full(len(at), -1)
    rows, chars = row[at], data[at]
    for kind in (DQ, SQ):
        own = np.flatnonzero(chars == kind)
        same = rows[own[:-1]] == rows[own[1:]]
        nxt[own[:-1][same]] = own[1:][same]
    current = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(at) else np.zeros(0, int)
    while len(current):
        close = nxt[current]
        current, close = current[close >= 0], close[close >= 0]
        structural[current] = structural[close] = True
        following = close + 1
        ok = following < len(at)
        ok[ok] = rows[following[ok]] == rows[close[ok]]
        current = following[ok]
    return structural


def split_array(column: pa.Array, kind: str = "value") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Split every field of a string array; gives (row, position from 1, value) for each value.

    ``kind`` is ``value`` (text), ``pair`` (two values joined by ``|``, blanks dropped)
    or ``index`` (numbers, which blanks may separate too).
    """
    n = len(column)
    column = pc.fill_null(column.cast(pa.string()), "")
    plain = pc.utf8_lower(pc.utf8_trim_whitespace(column))
    missing = pc.is_in(plain, value_set=pa.array(MISSING)).to_numpy(zero_copy_only=False)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    off = offsets - offsets[0]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    size = len(data)
    if size == 0 or missing.all():
        return none
    lens = np.diff(off)
    row = np.repeat(np.arange(n), lens)
    idx = np.arange(size)
    blank = _BLANK[data]
    solid = np.flatnonzero(~blank)
    solid_ = np.r_[solid, size]  # sentinel

    def after(pos: np.ndarray) -> np.ndarray:
        """First position at or after pos that is not blank."""
        return solid_[np.searchsorted(solid, pos)]

    first = after(off[:-1])
    active = ~missing & (first < off[1:])
    first = np.where(active, first, 0)
    last = np.where(active, solid_[np.maximum(np.searchsorted(solid, off[1:]) - 1, 0)], 0)
    second = after(first + 1)
    third = after(np.minimum(second + 1, size))
    char = np.r_[data, np.uint8(0)]
    end = off[1:]
    c2 = np.where(second < end, char[np.minimum(second, size)], 0)
    c3 = np.where(third < end, char[np.minimum(third, size)], 0)
    bracketed = active & (char[first] == LBR) & (char[last] == RBR) & (last > first)
    listed = bracketed & (_QUOTE[c2] | (c2 == LBR) | (c2 == LPAR) | (c2 == RBR) | (kind == "index"))
    both = (listed & (_QUOTE[c2] | (((c2 == LBR) | (c2 == LPAR)) & _QUOTE[c3]))) | (active & (char[first] == SQ) & (char[last] == SQ) & (last > first))
    nested = both & listed & ~_QUOTE[c2]

    # Quotes: escaped ones do not count; parity where one kind is used, a walk where both are.
    both_at = both[row]
    is_bs = data == BSL
    run = idx - np.maximum.accumulate(np.where(is_bs & np.r_[False, row[1:] == row[:-1]] | is_bs, -1, idx))
    start_of_row = off[:-1][row]
    run = np.where(is_bs, np.minimum(run, idx - start_of_row + 1), 0)
    escaped = np.r_[False, run[:-1] % 2 == 1] & (idx > start_of_row) & both_at
    dq = (data == DQ) & ~escaped
    sq = (data == SQ) & ~escaped & both_at
    n_dq, n_sq = np.bincount(row[dq], minlength=n), np.bincount(row[sq], minlength=n)
    mixed = (n_dq > 0) & (n_sq > 0)
    quote = dq | sq
    odd = ~mixed & ((n_dq + n_sq) % 2 == 1)
    quote &= ~(odd | mixed)[row]
    if mixed.any():
        at = np.flatnonzero((dq | sq) & mixed[row])
        quote[at] = _walk_mixed(data, row, at)
    nth = np.cumsum(quote)
    nth = nth - np.r_[0, nth][start_of_row]
    inside = nth % 2 == 1

    # Depth of brackets and parentheses outside quotes, ignored where not balanced.
    def depth(left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        step = np.where(inside | quote, 0, (data == left).astype(np.int32) - (data == right).astype(np.int32))
        total = np.cumsum(step)
        d = total - np.r_[0, total][start_of_row]
        filled = np.flatnonzero(lens > 0)
        low = np.zeros(n, np.int64)
        low[filled] = np.minimum.reduceat(d, off[filled])
        final = np.zeros(n, np.int64)
        final[filled] = d[off[filled + 1] - 1]
        ok = (low >= 0) & (final == 0)
        return np.where(ok[row], d, 0), ok

    brackets, bracket_ok = depth(LBR, RBR)
    parens, _ = depth(LPAR, RPAR)
    base = (listed & bracket_ok)[row].astype(np.int64)
    nested_at = nested[row]
    level = np.where(nested_at, brackets + parens, brackets + parens * (kind != "pair"))
    free = ~inside & ~quote & active[row] & (level == base)
    line = free & _LINE[data] & (idx > first[row]) & (idx < last[row])
    if kind == "value":
        lines = np.zeros(n, bool)
        lines[row[line]] = True
        locant = np.r_[False, _DIGIT[data[:-1]]] & np.r_[_DIGIT[data[1:]], False] & (data != BAR)
        sep = free & np.where(lines[row], _LINE[data], _SEPARATORS["value"][data] & ~locant)
    else:
        sep = free & _SEPARATORS[kind][data]
    join = np.zeros(size, bool)
    if kind == "pair":
        join = np.where(nested_at, ~inside & ~quote & (level == 2) & (data == COMMA), free & (data == BAR)) & active[row]
        count = np.cumsum(join)
        before = count - join
        opens = sep.copy()
        opens[off[:-1][lens > 0]] = True
        nth_join = count - np.maximum.accumulate(np.where(opens, before, 0))
        extra = join & (nth_join % 2 == 0)  # a|b|c|d: every second bar separates
        sep |= extra
        join &= ~extra

    # Segments between separators, cut down to what is written.
    rows = np.flatnonzero(active)
    cuts = np.flatnonzero(sep)
    starts = np.sort(np.r_[off[rows], cuts + 1], kind="stable")
    ends = np.sort(np.r_[cuts, off[rows + 1]], kind="stable")
    owner = np.repeat(rows, 1 + np.bincount(row[cuts], minlength=n)[rows])
    list_marks = np.zeros(size, bool)
    outer = np.flatnonzero(listed)
    list_marks[first[outer]] = list_marks[last[outer]] = True
    list_marks |= nested_at & ~inside & ~quote & _table([LBR, RBR, LPAR, RPAR])[data]

    def trim(s: np.ndarray, e: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept = np.flatnonzero(~skip)
        if not len(kept):
            return s, s
        lo = np.searchsorted(kept, s)
        hi = np.searchsorted(kept, e) - 1
        ok = lo <= hi
        return np.where(ok, kept[np.minimum(lo, len(kept) - 1)], s), np.where(ok, kept[np.maximum(hi, 0)] + 1, s)

    starts, ends = trim(starts, ends, (blank & ~inside) | list_marks)
    drop = list_marks.copy()
    drop |= is_bs & (run % 2 == 1) & both_at & inside & np.r_[_table([BSL, DQ, SQ, ord("/")])[data[1:]], False]
    if kind == "value":
        wrapped = (ends - starts >= 2) & quote[np.minimum(starts, size - 1)] & quote[np.maximum(ends - 1, 0)]
        starts, ends = starts + wrapped, ends - wrapped
        doubled = quote[:-1] & quote[1:] & (nth[:-1] % 2 == 0) & (row[:-1] == row[1:]) & ~both_at[:-1]
        drop[:-1] |= doubled
        starts, ends = trim(starts, ends, blank)
    else:
        drop |= quote | blank

    cover = np.zeros(size + 1, np.int32)
    full = ends > starts
    np.add.at(cover, starts[full], 1)
    np.add.at(cover, ends[full], -1)
    keep = (np.cumsum(cover[:-1]) > 0) & ~drop
    kept_before = np.r_[0, np.cumsum(keep)]
    width = np.where(full, kept_before[ends] - kept_before[starts], 0)
    real = width > 0
    out = np.where(join, np.uint8(BAR), data)[keep]
    child = np.r_[0, np.cumsum(width[real])].astype(np.int32)
    items = pa.StringArray.from_buffers(int(real.sum()), pa.py_buffer(child.tobytes()), pa.py_buffer(out.tobytes()))
    list_offsets = np.r_[0, np.cumsum(np.bincount(owner[real], minlength=n))].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(list_offsets), items)
    parent = pc.list_parent_indices(lists).to_numpy()
    position = np.arange(len(parent)) - list_offsets[parent] + 1
    return parent, position, pc.list_flatten(lists)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice has much more than SLICE_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, int)
    for start, stop in zip(edges, np.r_[edges[1:], len(part)]):
        yield batch.slice(start, stop - start)


def explode_packed(df: DataFrame, row_id: str, column: str, field_name: str, kind: str = "value") -> DataFrame:
    """One row per value of a packed column: (field_name, row_id, pos, item).

    Null, blank and missing fields and empty values give no rows; repeated values and
    repeated input rows each give their own. Other columns of ``df`` are not read.
    No shuffle: each task works through its own Arrow batches.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "item"):
                parent, pos, items = split_array(part.column("item"), kind)
                ids = part.column("row_id").take(pa.array(parent, pa.int64()))
                names = pa.array([field_name], pa.string()).take(pa.array(np.zeros(len(parent), np.int64)))
                yield pa.RecordBatch.from_arrays([names, ids, pa.array(pos, pa.int64()), items], ["field_name", "row_id", "pos", "item"])

    source = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(column).cast("string").alias("item")).where("item is not null")
    return source.mapInArrow(scan, "field_name string, row_id long, pos long, item string")
