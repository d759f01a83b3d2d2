"""CSV with quoted line breaks, read by many tasks a file.

A range begins either between records or inside a quoted cell. The first
scan follows both possibilities (they meet at the first line that tells them apart) and
leaves a row for the range: the state at its end, the number of records and the texts at its
borders, for each. Composed in file order these give every range's true
state; the second scan parses whole records with Python's ``csv``. Quotes count as ``csv`` counts
them: only at the begin of a cell, doubled inside. Every file has its own header.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.sources.ranges import LAST, by_range, joined_fragments, lines, numbered, stored

#: Border texts longer than this are read again when they turn out to be needed.
LONGEST = 1 << 16

# Cells that end on the line, and the rest of a quoted cell that began before it.
_CELLS = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,\r]*+|(?!")[^,\r]*+)[,\r])*+')
_QUOTED = re.compile(r'"(?:[^"]++|"")*+"')
_REST = re.compile(r'(?:[^"]++|"")*+"[^,\r]*+(?:[,\r]|$)')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind the line, given whether one was before it."""
    if '"' not in line:
        return inside
    at = 0
    if inside:
        rest = _REST.match(line)
        if rest is None:
            return True
        at = rest.end()
        if at == len(line):
            return False
    at = _CELLS.match(line, at).end()
    return line.startswith('"', at) and _QUOTED.match(line, at) is None


def records(text: str) -> list[list[str]]:
    """The records of a text that begins and ends between records; blank lines are none."""
    csv.field_size_limit(sys.maxsize)
    return [row for row in csv.reader(io.StringIO(text, newline="")) if row]


def _count(text: str) -> int:
    if "\r" in text[:-1]:
        return len(records(text))
    return int(text not in ("", "\r"))


class _Scan:
    """A range read as if it began inside a quoted cell, or as if not."""

    def __init__(self, inside: bool):
        self.inside, self.open = inside, inside
        self.pending: list[str] = []
        self.size = self.count = 0
        self.head: str | None = None
        self.closed = not inside  # whether a record has ended, or none was open
        self.first: list[str] | None = None

    def add(self, line: str) -> None:
        self.open = ends_inside(line, self.open)
        self.size += len(line)
        if self.size <= LONGEST or self.closed:
            self.pending.append(line)
        if self.open:
            return
        if not self.closed:
            self.head, self.closed = "\n".join(self.pending) if self.size <= LONGEST else None, True
        else:
            text = "\n".join(self.pending)
            self.count += _count(text)
            if self.first is None:
                self.first = next(iter(records(text)), None)
        self.pending, self.size = [], 0

    def tail(self) -> str | None:
        return "\n".join(self.pending) if self.closed and self.open and self.size <= LONGEST else None


RANGES = ("file string, block long, out_open boolean, out_tail string, out_n long, in_open boolean, in_head string, in_tail string, in_n long, "
          "in_closed boolean, header array<string>")


def _first_scan(df: DataFrame) -> DataFrame:
    """A row for each range, see RANGES."""
    def row(key, outer: _Scan, inner: _Scan, since: int | None) -> dict:
        same = since is not None
        return {"file": key[0], "block": key[1], "out_open": outer.open, "out_tail": outer.tail(), "out_n": outer.count,
                "in_open": outer.open if same else inner.open, "in_head": inner.head, "in_tail": outer.tail() if same else inner.tail(),
                "in_n": inner.count + (outer.count - since if same else 0), "in_closed": inner.closed, "header": outer.first}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, key, outer, inner, since = [], None, None, None, None
        for at, part, new in by_range(batches):
            if new:
                if key is not None:
                    rows.append(row(key, outer, inner, since))
                key, outer, inner, since = at, _Scan(False), _Scan(True), None
            for line in part:
                outer.add(line)
                if since is None:
                    inner.add(line)
                    if not inner.open and not outer.open:
                        since = outer.count
        if key is not None:
            rows.append(row(key, outer, inner, since))
            schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("out_open", pa.bool_()), ("out_tail", pa.string()), ("out_n", pa.int64()),
                                ("in_open", pa.bool_()), ("in_head", pa.string()), ("in_tail", pa.string()), ("in_n", pa.int64()), ("in_closed", pa.bool_()),
                                ("header", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return df.mapInArrow(run, RANGES)


def _states(ranges: DataFrame) -> DataFrame:
    """file, block, inside (whether it begins in a quoted cell), origin (the
    range where that record begins), last (whether a record begins here and ends beyond)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        inside, origin, out = False, -1, []
        for r in group.itertuples(index=False):
            ends = r.in_open if inside else r.out_open
            begins_last = bool(ends and (r.in_closed or not inside))
            out.append((r.file, r.block, inside, origin if inside else -1, begins_last))
            origin = r.block if begins_last else origin
            inside = bool(ends)
        return pd.DataFrame(out, columns=["file", "block", "inside", "origin", "last"])

    narrow = ranges.select("file", "block", "out_open", "in_open", "in_closed")
    return narrow.groupBy("file").applyInPandas(run, "file string, block long, inside boolean, origin long, last boolean")


def _second_scan(df: DataFrame, inside: dict[tuple[str, int], int], fragments: bool) -> DataFrame:
    """file, block, place, cells of the records that lie in one range; or, with
    ``fragments``, file, origin, block, text of what the ranges hold of the others."""
    shared = df.sparkSession.sparkContext.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        held: list[str] = []
        key, open_, head, place, found = None, False, False, 0, []

        def left() -> None:
            if fragments and held and key is not None:
                found.append((key[0], known[key] if head else key[1], key[1], "\n".join(held)))

        def flush() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string() if fragments else pa.list_(pa.string()))
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)],
                                               names=["file", "origin", "block", "text"] if fragments else ["file", "block", "place", "cells"])
            found.clear()
            return batch

        for at, part, new in by_range(batches):
            if new:
                left()
                key, held, place = at, [], 0
                open_ = head = at in known
            whole, begin = [], len(held)
            held += part
            done = 0  # lines of ``held`` that end between records
            for i in range(begin, len(held)):
                open_ = ends_inside(held[i], open_)
                if not open_:
                    if head:
                        head = False
                        if fragments:
                            found.append((key[0], known[key], key[1], "\n".join(held[done:i + 1])))
                    else:
                        whole += held[done:i + 1]
                    done = i + 1
            held = [] if head and not fragments else held[done:]
            if not fragments:
                for cells in records("\n".join(whole)):
                    found.append((*key, place, cells))
                    place += 1
            if found:
                yield flush()
        left()
        if found:
            yield flush()

    return df.mapInArrow(run, "file string, origin long, block long, text string" if fragments else "file string, block long, place long, cells array<string>")


class CsvFiles:
    """Header CSV files: the ranges' states, the headers, and their records."""

    def __init__(self, spark: SparkSession, path: str):
        self.lines = lines(spark, path)
        self.ranges = stored(_first_scan(self.lines), "csv-ranges")
        self.states = stored(_states(self.ranges), "csv-states")
        # Only ranges that begin inside a cell, and files whose header is not the usual one.
        self.inside = {(r.file, r.block): r.origin for r in self.states.where("inside").select("file", "block", "origin").collect()}
        self.joined = self._joined()
        self._read_headers()

    def _known(self) -> DataFrame:
        """The ranges with their true states."""
        return self.ranges.join(self.states.withColumnsRenamed({"file": "_f", "block": "_b"}), _same_range())

    def _joined(self) -> DataFrame:
        """file, block, place, cells of the records that cross borders."""
        known = self._known()
        heads = known.where("inside").select("file", "origin", "block", F.when(F.col("in_closed"), F.col("in_head")).alias("text"))
        tails = known.where("last").select("file", F.col("block").alias("origin"), F.col("block"), F.when(F.col("inside"), F.col("in_tail")).otherwise(F.col("out_tail")).alias("text"))
        parts = stored(heads.unionAll(tails), "csv-borders")
        if not parts.where("text is null").isEmpty():
            # A text too long for the first scan is part of a record after all.
            parts = stored(_second_scan(self.lines, self.inside, True), "csv-borders")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(f, b, LAST + i, cells) for f, b, text in zip(*(c.to_pylist() for c in batch.columns)) for i, cells in enumerate(records(text))]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
                columns = zip(*rows) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "block", "place", "cells"])

        return stored(joined_fragments(parts).select("file", "origin", "text").mapInArrow(run, "file string, block long, place long, cells array<string>"), "csv-joined")

    def _read_headers(self) -> None:
        """Each file's first record: its place and its cells. The first scan has
        it unless it crosses a border."""
        n = F.when(F.col("inside"), F.col("in_n")).otherwise(F.col("out_n"))
        more = self.joined.groupBy(F.col("file").alias("_f"), F.col("block").alias("_b")).agg(F.count("*").alias("more"), F.min_by("cells", "place").alias("cells"))
        counts = self._known().select("file", "block", n.alias("n"), F.when(~F.col("inside"), F.col("header")).alias("header"))
        counts = counts.join(more, _same_range(), "left").select("file", "block", "n", F.coalesce("more", F.lit(0)).alias("more"), "header", "cells")
        self.counts = stored(counts, "csv-counts")
        first = self.counts.where("n + more > 0").groupBy("file").agg(F.min_by(F.struct("block", "n", "header", "cells"), "block").alias("r"))
        heads = first.select("file", "r.block", F.when(F.col("r.n") > 0, 0).otherwise(F.lit(LAST)).alias("place"),
                             F.when(F.col("r.n") > 0, F.col("r.header")).otherwise(F.col("r.cells")).alias("header"))
        self.heads = stored(heads, "csv-headers")
        usual = self.heads.groupBy("header").count().orderBy(F.desc("count"), F.col("header")).first()
        self.usual, self.other, self.late = [], {}, {}
        if usual:
            self.usual = _names(usual.header)
            # Files with another header, or with the header at another place than the first.
            self.other = {r.file: _names(r.header) for r in self.heads.where(F.col("header") != F.lit(usual.header)).select("file", "header").collect()}
            self.late = {r.file: (r.block, r.place) for r in self.heads.where("block > 0 or place > 0").collect()}

    def rows(self, columns: list[str]) -> DataFrame:
        """file, block, place (without the header), the columns as texts c0, c1, ... (null
        where empty or missing), and _surplus: more cells than the header has names."""
        shared = self.lines.sparkSession.sparkContext.broadcast((self.usual, self.other, self.late))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            usual, other, late = shared.value
            for batch in batches:
                out = []
                for file, block, place, cells in zip(*(c.to_pylist() for c in batch.columns)):
                    head = late.get(file, (0, 0))
                    if (block, place) == head:
                        continue
                    names = other.get(file, usual)
                    at = dict(zip(names, cells))
                    # Behind a header the places of its range are one less.
                    out.append((file, block, place - (block == head[0] and (place < LAST) == (head[1] < LAST)),
                                *[at.get(c) or None for c in columns], len(cells) > len(names)))
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(columns), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)],
                                                 names=["file", "block", "place", *[f"c{i}" for i in range(len(columns))], "_surplus"])

        fields = "".join(f", c{i} string" for i in range(len(columns)))
        raw = _second_scan(self.lines, self.inside, False).unionAll(self.joined)
        return raw.mapInArrow(run, f"file string, block long, place long{fields}, _surplus boolean")

    def in_order(self, columns: list[str], start: int) -> DataFrame:
        """The rows with _at, their number in order of file and place."""
        heads = self.heads.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("place").alias("_p"))
        counts = self.counts.join(heads, _same_range(), "left")
        without = counts.select("file", "block", (F.col("n") - F.when(F.col("_p") == 0, 1).otherwise(0)).alias("n"),
                                (F.col("more") - F.when(F.col("_p") == LAST, 1).otherwise(0)).alias("more"))
        return numbered(self.rows(columns), without, start)


def _same_range():
    return (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b"))


def _names(header: list[str]) -> list[str]:
    return [h.removeprefix("\ufeff") if i == 0 else h for i, h in enumerate(header)]
