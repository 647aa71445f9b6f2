"""CSV files of many shapes: each has its own dialect and header, sniffed from its start.

Files above ``WHOLE_BYTES`` are cut at their lines by Spark's text source.  As cells may hold line
ends, that takes three passes.  The first sniffs the start of each file.  The second scans each
split from both states that it may be entered with (inside a quoted cell or not); its rows, one a
split, are chained by file.  The third parses each split from its state; rows over its edges come
out as text, two a split at most, and are put together by file.  No file, and no split, is
whole in memory.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from . import split

#: Larger files are split.
WHOLE_BYTES = 4 << 20
_SAMPLE, _BATCH_ROWS = 8192, 2_000


@dataclass
class Shape:
    """Dialect and header of a file; no header is None."""

    delimiter: str
    quotechar: str
    doublequote: bool
    skipinitialspace: bool
    header: list[str] | None

    def __post_init__(self):
        quote, blank = re.escape(self.quotechar), " *" if self.skipinitialspace else ""
        self._closes = re.compile(f"(?:[^{quote}]|{quote}{quote})*+{quote}" if self.doublequote else f"[^{quote}]*+{quote}")
        self._first, self._opens = re.compile(blank + quote), re.compile(f"[{re.escape(self.delimiter)}\r]{blank}{quote}")
        find = lambda words: next((i for i, h in enumerate(self.header or []) if any(w in h.lower() for w in words)), None)
        self._time, self._level = (0, None) if self.header is None else (find(fixed.TIME_WORDS), find(fixed.SEVERITY_COLUMN_WORDS))

    @classmethod
    def of(cls, lines: Iterator[str]) -> Shape:
        """The shape of a file by its lines, of which no more are taken than it needs."""
        held, size = [], 0
        for line in lines:
            held.append(line)
            size += len(line)
            if size >= _SAMPLE:
                break
        sample = "".join(held)[:_SAMPLE]
        try:
            dialect = csv.Sniffer().sniff(sample, delimiters=",;\t|")
        except csv.Error:
            dialect = csv.excel
        try:
            headed = csv.Sniffer().has_header(sample)
        except csv.Error:
            headed = True
        shape = cls(dialect.delimiter, dialect.quotechar, dialect.doublequote, dialect.skipinitialspace, None)
        return cls(*shape.dialect, next(shape.reader(itertools.chain(held, lines)), [])) if headed else shape

    @property
    def dialect(self) -> tuple[str, str, bool, bool]:
        return self.delimiter, self.quotechar, self.doublequote, self.skipinitialspace

    def reader(self, lines: Iterator[str]) -> Iterator[list[str]]:
        return csv.reader(lines, delimiter=self.delimiter, quotechar=self.quotechar, doublequote=self.doublequote, skipinitialspace=self.skipinitialspace)

    def inside(self, line: str, entered: bool) -> bool:
        """Whether a quoted cell is open after a line, entered inside one or not; a quote opens a cell only at its start."""
        at = 0
        if not entered:
            start = self._first.match(line) or self._opens.search(line)
            if start is None:
                return False
            at = start.end()
        while (end := self._closes.match(line, at)) is not None:
            start = self._opens.search(line, end.end())
            if start is None:
                return False
            at = start.end()
        return True

    def event(self, row: list[str]) -> tuple[str, str, list[tuple[str, str]]]:
        """(ts_raw, level, data) of a row; ragged rows keep the cells that have a header, without one cells are col_0, col_1, ..."""
        cells = {f"col_{i}": v for i, v in enumerate(row)} if self.header is None else dict(zip(self.header, row))  # noqa: B905
        at = lambda i: row[i] if i is not None and i < len(row) else None
        return at(self._time) or "", at(self._level) or "info", list(cells.items())


EVENT = "source_file string, seq long, ts_raw string, level string, data map<string,string>"
_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()))


def event_batches(events: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of (source_file, seq, ts_raw, level, data)."""
    while part := list(itertools.islice(events, _BATCH_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), _KINDS, strict=True)], names=["source_file", "seq", "ts_raw", "level", "data"])


def whole_events(path: str, content: bytes) -> Iterator[tuple]:
    """The events of a file that is in memory."""
    lines = io.StringIO(content.decode("utf-8-sig", "replace"), newline="")
    shape = Shape.of(lines)
    lines.seek(0)
    for n, row in enumerate(itertools.islice(shape.reader(lines), int(shape.header is not None), None)):
        yield path, n, *shape.event(row)


# --- files that are split -------------------------------------------------------------


def _lines(parts: Iterator[tuple[str, int, pa.Array]]) -> Iterator[str]:
    """Lines with their ends, of which a lone carriage return is one too."""
    for _, _, values in parts:
        for value in values.to_pylist():
            if "\r" in value:
                yield from io.StringIO(value + "\n", newline="")
            else:
                yield value + "\n"


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(file, block, lines) of each split."""
    for (file, block), parts in itertools.groupby(split._by_split(batches), key=lambda p: p[:2]):
        yield file, block, _lines(parts)


_SHAPE = "file string, delimiter string, quotechar string, doublequote boolean, skipinitialspace boolean, header array<string>"


def _sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for file, _, lines in _splits(batches):
        shape = Shape.of(lines)
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((file, *shape.dialect, shape.header), kinds, strict=True)], names=["file", "delimiter", "quotechar", "doublequote", "skipinitialspace", "header"])


def _cut(lines: Iterator[str], shape: Shape, entered: bool, left: bool) -> Iterator[tuple[int, list[str] | None, tuple[str, bool, bool] | None]]:
    """(n, row, piece) of a split: rows, and (text, open, closed) of those that are open at its start or its end."""
    n = 0
    if entered:
        tail, size = [], 0
        for line in lines:
            tail.append(line)
            size = 0 if shape.quotechar in line else size + len(line)
            if size > csv.field_size_limit():  # as the reader itself has it for one cell
                raise csv.Error(f"field larger than field limit ({csv.field_size_limit()})")
            entered = shape.inside(line, entered)
            if not entered:
                break
        yield 0, None, ("".join(tail), True, not entered)
        n = 1
    if not left:
        for i, row in enumerate(shape.reader(lines), n):
            yield i, row, None
        return
    taken: list[str] = []
    last, text = None, ""
    for row in shape.reader(taken.append(line) or line for line in lines):
        if last is not None:
            yield n, last, None
            n += 1
        last, text = row, "".join(taken)
        taken.clear()
    if last is not None:
        yield n, None, (text, False, False)


def split_events(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """``EVENT`` rows of the files below a folder that are above ``WHOLE_BYTES`` and have a name of a pattern; None if there are none.

    seq grows with the place in the file but is not dense.  A row a file, its shape, and a row
    a split go to the driver.
    """
    # A pattern picks files in the listing alone; a condition on names would be looked at with each line.
    large = F.col("_metadata.file_size") > WHOLE_BYTES
    lines = split._splits(spark, path, "\n", large, pattern).withColumn("value", F.make_valid_utf8("value"))
    shapes = {r["file"]: Shape(*r[1:]) for r in lines.filter("block = 0").mapInArrow(_sniff, _SHAPE).collect()}
    if not shapes:
        return None
    # As in the listing of whole files; _metadata has them encoded.
    names = {file: unquote(file) for file in shapes}

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return split.state_maps(batches, lambda file: (shapes[file].quotechar, shapes[file].inside))

    entered, left = set(), set()
    for file, rows in split._chains(lines.mapInArrow(states, split.STATE_MAPS).collect()):
        state = False
        for r in rows:
            if state:
                entered.add((file, r["block"]))
            state = r["in"] if state else r["out"]
            if state:
                left.add((file, r["block"]))

    def event(file: str, block: int, n: int, row: list[str]) -> Iterator[tuple]:
        if shapes[file].header is None or block or n:
            yield names[file], block + n, *shapes[file].event(row)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = ((f, b, n, row) for f, b, text in _splits(batches) for n, row, _ in _cut(text, shapes[f], (f, b) in entered, (f, b) in left) if row is not None)
        yield from event_batches(e for c in cut for e in event(*c))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, b, text in _splits(batches):
            if (f, b) in entered or (f, b) in left:
                for n, _, piece in _cut(text, shapes[f], (f, b) in entered, (f, b) in left):
                    if piece is not None:
                        yield split._piece_rows((f, b), n, [piece[0].encode()], [piece[1]], [piece[2]])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        yield from event_batches(e for r in rows for row in shapes[r["file"]].reader(io.StringIO(r["text"], newline="")) for e in event(r["file"], r["block"], r["n"], row))

    out = lines.mapInArrow(whole, EVENT)
    if entered or left:
        out = out.unionByName(split.merged(lines.mapInArrow(edges, split._PIECES)).mapInArrow(joined, EVENT))
    return out
