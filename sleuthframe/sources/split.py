"""Reads one large document in parallel whose records aren't lines: JSON arrays, CSV with line ends in cells.

Spark's text source splits a file at a separator that is everywhere (``}`` for JSON, line feeds
for CSV), so what stands at the start of a split depends on all splits before it.  It is found
in two passes.  The first scans each split from every state that it may be entered with
(inside quotes or not) and gives a row: the state that it is left with, for each.  These rows are chained
by file, which tells the state that each split is really entered with.  The second pass cuts
each split into records by it; what hangs over its edges comes out as pieces, two a split at
most, which are put together by file.

Rows of a split keep their order in a task; no split is read whole into memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_QUOTE, _SLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("{"), ord("[")]] = 1
_DEPTH[[ord("}"), ord("]")]] = -1


def _splits(spark: SparkSession, path: str | Sequence[str], separator: str, where: Column | None, pattern: str = "*") -> DataFrame:
    """(file, block, value): the pieces between separators, in order in each task; block is where their split starts."""
    reader = spark.read.option("lineSep", separator).option("pathGlobFilter", pattern)
    rows = reader.text(path) if where is None else reader.option("recursiveFileLookup", True).text(path).filter(where)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, values) of each batch, cut where the split changes."""
    for batch in batches:
        if batch.num_rows:
            block = batch.column("block").to_numpy()
            name = batch.column("file").dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero((block[1:] != block[:-1]) | (name[1:] != name[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                yield batch.column("file")[lo].as_py(), int(block[lo]), batch.column("value").slice(lo, hi - lo)


def _bytes(values: pa.Array, separator: bytes) -> np.ndarray:
    """The pieces of text with their separators, as bytes."""
    joined = pc.binary_join_element_wise(pc.fill_null(values, ""), "", separator.decode())
    off = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset : joined.offset + len(joined) + 1]
    return np.frombuffer(joined.buffers()[2], np.uint8)[off[0] : off[-1]] if len(joined) else np.zeros(0, np.uint8)


# --- JSON -----------------------------------------------------------------------------


def _quotes(data: np.ndarray) -> np.ndarray:
    """Quotes before each byte and its own that aren't escaped, modulo 2."""
    at = np.flatnonzero(data == _QUOTE)
    slash = data == _SLASH
    if slash.any():
        # The run of backslashes before a quote: an odd number escapes it.
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        run = np.where(at > 0, at - 1 - np.where(at > 0, last[at - 1], -1), 0)
        at = at[run % 2 == 0]
    mark = np.zeros(len(data), np.int64)
    mark[at] = 1
    return np.cumsum(mark) & 1


@dataclass
class _State:
    """Where a split of JSON is entered: inside a string, depth, whether the root is an array; 0 before it."""

    string: int = 0
    depth: int = 0
    root: int = 0


def _root(data: np.ndarray) -> int:
    """1 for an array, 2 for anything else, 0 if only white space or a byte-order mark stands there."""
    text = data[:4096].tobytes().lstrip(b"\xef\xbb\xbf \t\r\n")
    return 0 if not text else 1 if text[:1] == b"[" else 2


def _json_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, flip, up0, up1, root): what a split does to the state, entered outside or inside a string."""
    rows: list[list] = []
    for file, block, values in _by_split(batches):
        if not rows or rows[-1][:2] != [file, block]:
            rows.append([file, block, 0, 0, 0, 0])
        row, data = rows[-1], _bytes(values, b"}")
        odd, step = _quotes(data), _DEPTH[data]
        outside, inside = int(step[odd == 0].sum()), int(step[odd == 1].sum())
        row[3], row[4] = (row[3] + outside, row[4] + inside) if row[2] == 0 else (row[3] + inside, row[4] + outside)
        row[2] ^= int(odd[-1]) if len(odd) else 0
        row[5] = row[5] or _root(data)
    names = ("file", "block", "flip", "up0", "up1", "root")
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.string(), *[pa.int64()] * 5), strict=True)], names=list(names))


def _json_entries(maps: list) -> dict[tuple[str, int], _State]:
    """The state that each split is entered with; none for documents that are no whole array."""
    out: dict[tuple[str, int], _State] = {}
    for file, rows in _chains(maps):
        state, own = _State(), {}
        for r in rows:
            state.root = state.root or r["root"]
            own[file, r["block"]] = _State(state.string, state.depth, state.root)
            state.depth += r["up1"] if state.string else r["up0"]
            state.string ^= r["flip"]
        # A separator that isn't in the file follows its last piece, so a closed root may stand at -1.
        if state.root == 1 and not state.string and state.depth <= 0:
            out |= own
    return out


def _chains(maps: list) -> Iterator[tuple[str, list]]:
    by: dict[str, list] = {}
    for r in maps:
        by.setdefault(r["file"], []).append(r)
    for file, rows in by.items():
        yield file, sorted(rows, key=lambda r: r["block"])


_PIECES = "file string, block long, n long, text string, open boolean, closed boolean"


def _json_items(entries: dict[tuple[str, int], _State]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cuts splits into the items of the root array: whole ones, and those open at their start or at the end of the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rest, n, whole, before = None, None, b"", 0, False, False

        def end() -> Iterator[pa.RecordBatch]:
            if state is not None and state.depth > 0 and (rest.strip() or not whole):
                yield _piece_rows(key, n, [rest], [not whole], [False])

        for file, block, values in _by_split(batches):
            if key != (file, block):
                yield from end()
                key, rest, n = (file, block), b"", 0
                found = entries.get(key)
                state = found and _State(found.string, found.depth, found.root)
                whole = before = state is not None and state.depth <= 0
            if state is None:
                continue
            data = _bytes(values, b"}")
            odd = _quotes(data) ^ state.string
            step = np.where(odd == 1, 0, _DEPTH[data])
            depth = state.depth + np.cumsum(step)
            # The root opens (to 1) and closes (to 0); commas at depth 1 part its items.
            cut = np.flatnonzero(((data == _COMMA) & (odd == 0) & (depth == 1)) | ((step == 1) & (depth == 1)) | ((step == -1) & (depth == 0)))
            state.string, state.depth = int(odd[-1]) if len(odd) else state.string, int(depth[-1]) if len(depth) else state.depth
            raw, at = data.tobytes(), 0
            texts = []
            for c in cut.tolist():
                texts.append((rest if not texts else b"") + raw[at:c])
                at = c + 1
            if texts:
                opens = [not whole, *[False] * (len(texts) - 1)]
                # Before the root opens stands nothing.
                first, before = int(before), False
                yield _piece_rows(key, n, texts[first:], opens[first:], [True] * (len(texts) - first))
                n, whole, rest = n + len(texts), True, b""
            rest += raw[at:]
        yield from end()

    return run


def _piece_rows(key: tuple[str, int], n: int, texts: list[bytes], opens: list[bool], closed: list[bool]) -> pa.RecordBatch:
    size = len(texts)
    columns = [pa.array([key[0]] * size, pa.string()), pa.array([key[1]] * size, pa.int64()), pa.array(range(n, n + size), pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string()), pa.array(opens, pa.bool_()), pa.array(closed, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, names=["file", "block", "n", "text", "open", "closed"])


def merged(edges: DataFrame, between: str = "") -> DataFrame:
    """(file, block, n, text): records over several splits from their pieces; at the place where they start."""

    def merge(table: pa.Table) -> pa.Table:
        out, parts = [], []
        for r in sorted(table.to_pylist(), key=lambda r: (r["block"], r["n"])):
            if not r["open"] and parts:
                out.append((*parts[0][:2], between.join(p[2] for p in parts)))
                parts = []
            parts.append((r["block"], r["n"], r["text"]))
            if r["closed"]:
                out.append((*parts[0][:2], between.join(p[2] for p in parts)))
                parts = []
        if parts:
            out.append((*parts[0][:2], between.join(p[2] for p in parts)))
        file = table.column("file")[0].as_py()
        return pa.table({"file": pa.array([file] * len(out), pa.string()), "block": pa.array([o[0] for o in out], pa.int64()), "n": pa.array([o[1] for o in out], pa.int64()), "text": pa.array([o[2] for o in out], pa.string())})

    return edges.groupBy("file").applyInArrow(merge, "file string, block long, n long, text string")


def _put_together(pieces: DataFrame, between: str = "") -> DataFrame:
    """(file, block, n, text): whole records, and those over several splits."""
    whole = pieces.filter("not open and closed").select("file", "block", "n", "text")
    return whole.unionByName(merged(pieces.filter("open or not closed"), between))


def json_items(spark: SparkSession, path: str | Sequence[str], where: Column | None = None) -> DataFrame:
    """(file, block, n, text): the items of documents whose root is a JSON array, in the order of (block, n); other documents give none.

    Items aren't parsed here, but a document whose quotes and brackets don't pair gives none.  A row a split goes to the driver, as many as it plans tasks for.
    """
    splits = _splits(spark, path, "}", where)
    maps = splits.mapInArrow(_json_maps, "file string, block long, flip long, up0 long, up1 long, root long").collect()
    pieces = splits.mapInArrow(_json_items(_json_entries(maps)), _PIECES)
    return _put_together(pieces).filter("trim(text) <> ''")


# --- CSV ------------------------------------------------------------------------------

_CLOSES = re.compile(r'(?:[^"]|"")*+"')


def line_state(line: str, separator: str, inside: bool) -> bool:
    """Whether a quoted cell is open after a line, entered ``inside`` one or not; a quote opens a cell only at its start."""
    at = 0
    while True:
        if inside:
            m = _CLOSES.match(line, at)
            if m is None:
                return True
            at = m.end()
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)
        inside = line.startswith('"', at)
        at += inside


def _rule(separator: str) -> tuple[str, Callable[[str, bool], bool]]:
    """The quote, and the state after a line."""
    # A line that is entered outside may start with a quoted cell.
    return '"', lambda line, inside: line_state(line[1:], separator, True) if not inside and line.startswith('"') else line_state(line, separator, inside)


def _line_states(values: pa.Array, separator: str) -> tuple[np.ndarray, np.ndarray]:
    return _states_after(values, *_rule(separator))


def _states_after(values: pa.Array, quote: str, after: Callable[[str, bool], bool]) -> tuple[np.ndarray, np.ndarray]:
    """The state after each line, entered outside and inside a quoted cell."""
    n = len(values)
    out = np.zeros((2, n), bool)
    out[1] = True
    at = np.flatnonzero(pc.match_substring(values, quote).to_numpy(zero_copy_only=False))
    lines = values.take(pa.array(at)).to_pylist()
    for k, entered in enumerate((False, True)):
        out[k, at] = [after(line, entered) for line in lines]
    return out[0], out[1]


STATE_MAPS = "file string, block long, out boolean, in boolean"


def state_maps(batches: Iterator[pa.RecordBatch], rule: Callable[[str], tuple[str, Callable[[str, bool], bool]]]) -> Iterator[pa.RecordBatch]:
    """``STATE_MAPS`` rows: the state that a split is left with, entered outside or inside a quoted cell; the rule of a file is its quote and the state after a line."""
    rows: list[list] = []
    for file, block, values in _by_split(batches):
        if not rows or rows[-1][:2] != [file, block]:
            rows.append([file, block, False, True])
        outside, inside = _states_after(values, *rule(file))
        for k in (2, 3):
            rows[-1][k] = _walk(outside, inside, rows[-1][k])[-1]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], names=["file", "block", "out", "in"])


def _walk(outside: np.ndarray, inside: np.ndarray, state: bool) -> np.ndarray:
    """States after each line.  Lines that leave both states alone need no step."""
    change = np.flatnonzero(outside | ~inside)
    out = np.empty(len(outside) + 1, bool)
    at = 0
    for i in change.tolist():
        out[at : i + 1] = state
        state = bool(inside[i] if state else outside[i])
        at = i + 1
    out[at:] = state
    return out


def _csv_records(separator: str, entries: dict[tuple[str, int], bool]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rest, n, opened = None, False, [], 0, False

        def end() -> Iterator[pa.RecordBatch]:
            if rest:
                yield _piece_rows(key, n, ["\n".join(rest).encode()], [opened], [False])

        for file, block, values in _by_split(batches):
            if key != (file, block):
                yield from end()
                key, rest, n, opened = (file, block), [], 0, entries[file, block]
                state = opened
            states = _walk(*_line_states(values, separator), state)
            state = bool(states[-1])
            last = np.flatnonzero(~states[1:])
            lines, at, texts = values.to_pylist(), 0, []
            for i in last.tolist():
                texts.append("\n".join([*rest, *lines[at : i + 1]]).encode())
                rest, at = [], i + 1
            if texts:
                yield _piece_rows(key, n, texts, [opened, *[False] * (len(texts) - 1)], [True] * len(texts))
                n, opened = n + len(texts), False
            rest = [*rest, *lines[at:]]
        yield from end()

    return run


def csv_records(spark: SparkSession, path: str | Sequence[str], separator: str, where: Column | None = None) -> DataFrame:
    """(file, block, n, text): records of CSV files whose quoted cells may hold line ends, in the order of (block, n)."""
    splits = _splits(spark, path, "\n", where)
    maps = splits.mapInArrow(lambda batches: state_maps(batches, lambda file: _rule(separator)), STATE_MAPS).collect()
    entries: dict[tuple[str, int], bool] = {}
    for file, rows in _chains(maps):
        state = False
        for r in rows:
            entries[file, r["block"]] = state
            state = r["in"] if state else r["out"]
    records = _put_together(splits.mapInArrow(_csv_records(separator, entries), _PIECES), "\n")
    return records.withColumn("text", F.regexp_replace("text", "\r$", "")).filter("text <> ''")
