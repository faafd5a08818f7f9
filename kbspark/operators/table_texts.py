"""Texts of table rows from cells in one shuffle: runs of cells are packed before it, and read in order behind it.

A packed run is the cells of one block of rows of a table that stand together: rows, columns and lengths as bytes, the
texts as they are. Behind the shuffle by file, runs come by file, table and block; a block is put in order, and what goes on into the
next one is kept: the table's header, the number of rows so far, and the last text, which rows without a first cell add to.
So neither a file nor a table has to fit a task, only a block of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1024
PACKED = "file string, table_no bigint, block bigint, rows binary, cols binary, sizes binary, texts binary"
TEXTS = "file string, row_id bigint, text string"


def _flat(a: pa.Array) -> tuple[np.ndarray, pa.Buffer]:
    """Places of a string or binary array's values in its bytes, and the bytes."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    return offsets, a.buffers()[2] or pa.py_buffer(b"")


def _slices(data: np.ndarray | pa.Buffer, edges: np.ndarray) -> pa.Array:
    """Binary values: the bytes between the edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)])


def _narrow(x: np.ndarray) -> np.ndarray:
    """Bytes if all values are such, else 64-bit words."""
    return x.astype(np.uint8 if x.min() >= 0 and x.max() < 256 else np.int64)


def _wide(a: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The numbers of all values of `_narrow`."""
    offsets, data = _flat(a)
    sizes = np.diff(offsets)
    if (sizes == counts).all():
        return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    return np.concatenate([np.frombuffer(x, np.uint8 if len(x) == n else np.int64).astype(np.int64) for x, n in zip(a.to_pylist(), counts, strict=True)])


def _starts(file: pa.Array, *keys: np.ndarray) -> np.ndarray:
    """Whether a row's file or keys differ from those of the row before; the first row's do."""
    new = np.ones(len(file), bool)
    if len(file) > 1:
        new[1:] = pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _order(*keys) -> pa.Array:
    named = {f"k{i}": k for i, k in enumerate(keys)}
    return pc.sort_indices(pa.table(named), sort_keys=[(k, "ascending") for k in named])


def _ints(a: pa.Array) -> np.ndarray:
    return a.cast(pa.int64()).to_numpy(zero_copy_only=False)


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of cells (file, table_no, row_no, col_no, text), none missing and no row below 0."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for again in (False, True):
            file, text = batch.column(0).cast(pa.string()), batch.column(4).cast(pa.string())
            table, row, col = (_ints(batch.column(i)) for i in (1, 2, 3))
            block = row // BLOCK
            starts = np.flatnonzero(_starts(file, table, block))
            if again or len(starts) * 4 < len(file):
                break
            batch = batch.take(_order(file, table, row, col))  # cells of a table stand apart
        edges = np.append(starts, len(file))
        offsets, data = _flat(text)
        cols, sizes = _narrow(col), _narrow(np.diff(offsets))
        columns = [file.take(pa.array(starts)), pa.array(table[starts]), pa.array(block[starts]), _slices((row % BLOCK).astype(np.uint16), edges * 2), _slices(cols, edges * cols.itemsize), _slices(sizes, edges * sizes.itemsize), _slices(data, offsets[edges])]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])


def _columns(runs: pa.Table) -> list:
    """File, table and block numbers, and the bytes, each in one piece."""
    one = [c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) for c in runs.columns]
    return [one[0], _ints(one[1]), _ints(one[2]), *one[3:]]


class _Reader:
    """What goes on from one batch of whole blocks to the next."""

    def __init__(self) -> None:
        self.file = self.table = None
        self.rows = 0  # of the file so far
        self.header = (np.zeros(0, np.int64), pa.array([], pa.string()))  # columns and texts of the table's
        self.last: tuple[str, int, list[str]] | None = None  # the last text, which may go on

    def ended(self) -> Iterator[pa.RecordBatch]:
        if self.last:
            file, row_id, parts = self.last
            yield _texts(pa.array([file], pa.string()), np.array([row_id]), pa.array(["".join(parts)], pa.string()))
            self.last = None

    def read(self, runs: pa.Table) -> Iterator[pa.RecordBatch]:
        """The texts that end in these runs, which are in order of file, table and block, all of a block."""
        file, table, block, at_rows, at_cols, at_sizes, at_texts = _columns(runs)
        row_offsets, row_data = _flat(at_rows)
        counts = np.diff(row_offsets) // 2
        run = np.repeat(np.arange(len(counts)), counts)
        row = np.frombuffer(row_data, np.uint16, row_offsets[-1] // 2)[row_offsets[0] // 2 :].astype(np.int64) + block[run] * BLOCK
        col, sizes = _wide(at_cols, counts), _wide(at_sizes, counts)
        text_offsets, data = _flat(at_texts)
        places = text_offsets[0] + np.append(0, np.cumsum(sizes))
        text = pa.Array.from_buffers(pa.string(), len(run), [None, pa.py_buffer(places.astype(np.int32)), data])

        goes_on_file = file[0].as_py() == self.file
        goes_on_table = goes_on_file and table[0] == self.table
        of_file, of_table = np.cumsum(_starts(file)) - 1, np.cumsum(_starts(file, table)) - 1
        tab = of_table[run]
        step = [np.diff(x) for x in (tab, row, col)]
        if not ((step[0] > 0) | (step[0] == 0) & ((step[1] > 0) | (step[1] == 0) & (step[2] > 0))).all():
            order = _order(tab, row, col, text)
            text, order = text.take(order), order.to_numpy()
            run, tab, row, col, sizes = (x[order] for x in (run, tab, row, col, sizes))

        head = np.flatnonzero(row == 0)
        head_tab, head_col, head_text = tab[head], col[head], text.take(pa.array(head))
        if goes_on_table:
            head_tab, head_col = np.append(np.zeros(len(self.header[0]), np.int64), head_tab), np.append(self.header[0], head_col)
            head_text = pa.concat_arrays([self.header[1], head_text])
        cells = np.flatnonzero(row > 0)
        run, tab, row, col, sizes, text = run[cells], tab[cells], row[cells], col[cells], sizes[cells], text.take(pa.array(cells))
        before = self.rows if goes_on_file else 0
        rows_of_last = before if of_file[-1] == 0 else 0
        if len(cells):
            first = np.append(True, (tab[1:] != tab[:-1]) | (row[1:] != row[:-1]))
            starts, of_row = np.flatnonzero(first), np.cumsum(first) - 1
            ends = np.append(starts[1:], len(cells)) - 1
            own = sizes[starts] > 0  # a row with a first cell; the others go on with the one before
            row_file = of_file[run[starts]]
            total = np.cumsum(own)
            files, firsts = np.unique(row_file, return_index=True)
            base = (total - own)[firsts][np.searchsorted(files, row_file)]
            row_id = total - base + np.where(row_file == 0, before, 0)

            # a line for each cell and header of its column
            body = np.flatnonzero((col > 0) & own[of_row])
            ranks, rank = np.unique(np.append(head_col, col[body]), return_inverse=True)
            head_key, key = head_tab * len(ranks) + rank[: len(head_col)], tab[body] * len(ranks) + rank[len(head_col) :]
            low, high = np.searchsorted(head_key, key, "left"), np.searchsorted(head_key, key, "right")
            found = high - low
            lines_of = np.maximum(found, 1)
            which = np.repeat(np.arange(len(body)), lines_of)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(lines_of) - lines_of, lines_of)
            header = head_text.take(pa.array(low[which] + nth, mask=found[which] == 0)).fill_null("")
            body = body[which]
            line, line_row = pc.binary_join_element_wise(header, text.take(pa.array(body)), ": "), of_row[body]
            if len(which) > len(found) or (len(body) > 1 and ((line_row[1:] == line_row[:-1]) & (col[body][1:] == col[body][:-1])).any()):
                line = line.take(_order(line_row, col[body], line))  # cells or headers of one place
            lines = np.bincount(line_row, minlength=len(starts))
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lines)), pa.int32()), line), "\n")

            out = np.flatnonzero(own)
            more, owner = np.flatnonzero(~own), np.cumsum(own)[~own] - 1
            here = row_id[more] > np.where(row_file[more] == 0, before, 0)
            if before and self.last:
                back = more[~here & (row_file[more] == 0)]
                self.last[2].extend(text.take(pa.array(ends[back])).to_pylist())
            if len(out):
                yield from self.ended()
                tails = np.bincount(owner[here], minlength=len(out))
                tail = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tails)), pa.int32()), text.take(pa.array(ends[more[here]]))), "")
                done = pc.binary_join_element_wise(whole.take(pa.array(out)), tail, "")
                names, ids = file.take(pa.array(run[starts[out]])), row_id[out]
                kept = np.flatnonzero(lines[out] > 0)  # a row of a first cell alone has no text
                if len(kept) and kept[-1] == len(out) - 1:
                    self.last = (names[-1].as_py(), int(ids[-1]), [done[-1].as_py()])
                    kept = kept[:-1]
                if len(kept):
                    yield _texts(names.take(pa.array(kept)), ids[kept], done.take(pa.array(kept)))
            if row_file[-1] == of_file[-1]:
                rows_of_last = int(row_id[-1])
        own_header = head_tab == of_table[-1]
        self.file, self.table, self.rows = file[-1].as_py(), table[-1], rows_of_last
        self.header = (head_col[own_header], head_text.filter(pa.array(own_header)))


def _texts(file: pa.Array, row_id: np.ndarray, text: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([file, pa.array(row_id, pa.int64()), text], names=["file", "row_id", "text"])


def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, row_id, text) of packed runs in order of file, table and block, all of a file."""
    reader, held = _Reader(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        # the last block may have more runs in the next batch
        runs = pa.Table.from_batches([batch]).cast(pa.schema([("file", pa.string()), ("table_no", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("rows", "cols", "sizes", "texts"))]))  # large types have other places
        runs = pa.concat_tables([held, runs]) if held is not None else runs
        file, table, block = _columns(runs)[:3]
        cut = int(np.flatnonzero(_starts(file, table, block))[-1])
        if cut:
            yield from reader.read(runs.slice(0, cut))
        held = runs.slice(cut)
    if held is not None:
        yield from reader.read(held)
    yield from reader.ended()
