r"""Files holding JSON values one after the other: several on a line, or one over many
lines, with broken text in between.

Strings, numbers and words of JSON never reach over a line break, so each line is reduced
to its tokens by itself. Two neighbouring lines of one value go together: what follows the
last token of one must be allowed there. Where it is not, or where a line holds something
that is no token, the text is cut; no value reaches over a cut.

Each block of a file is read once, in order. Where nothing is open, a value is read by a
parser; else lines pass an automaton with a stack of open brackets, which finds the values
that begin and end with a line, the outermost of those that are whole. What it does not
find stays broken text, line by line: an object that is never closed does not take those
after it along, and lines that wait for the end of one are held in a file when they are
many. Only the lines before a block's first cut and those that are open at its end depend on
other blocks. They are few where values are small beside a block, and pass a second reader
in the order of the file.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raw import one_value, value_pieces

#: deeper values are not read by the parsers behind this
MAX_DEPTH = 500
#: characters of open values kept in memory, lines read at once, rows and characters of a batch, and over how many keys the values of a file spread
HELD_CHARS, LINES, BATCH_ROWS, BATCH_CHARS, SPREAD = 4 << 20, 1000, 10_000, 4 << 20, 1021
#: of a unit: one whole value; not the first on its line; no unit, but the token before the next one
WHOLE, INNER, CONTEXT = 1, 2, 4
# Control characters cannot stand outside of strings, so they are free as marks.
STRING, SCALAR, OTHER = "\x01", "\x02", "\x03"
_string = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_scalar = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+|true|false|null"
_STRING, _SCALAR, _SPACE = re.compile(_string), re.compile(_scalar), re.compile(r"[ \t\r\n]+")
_TOKEN, _ODD = re.compile(f"{_string}|{_scalar}|[{{}}\\[\\],:]"), re.compile(f"[^{{}}\\[\\],:{STRING}{SCALAR}]")

#: what may follow a token inside a value
FOLLOWS = {
    "{": STRING + "}", "[": STRING + SCALAR + "{[]", ",": STRING + SCALAR + "{[", ":": STRING + SCALAR + "{[",
    "}": ",]}", "]": ",]}", STRING: ",]}:", SCALAR: ",]}",
}


def tokens(line: str) -> str:
    """A line with each string and each scalar as one mark, without spaces; what is no
    token stays as it is."""
    marked = _STRING.sub(STRING, line.replace(STRING, OTHER).replace(SCALAR, OTHER))
    return _SPACE.sub("", _SCALAR.sub(SCALAR, marked))


def behind(line: str, left: int) -> str:
    """The end of a line from its last but `left` tokens on."""
    return line[[m.start() for m in _TOKEN.finditer(line)][-left] :] if left else ""


def units(spark: SparkSession, paths: str | list[str], glob: str) -> DataFrame:
    """path, block, text, whole (one value on a line), pieces (null but where a value ends on
    the line and other text follows): the lines of each block in order."""
    value = F.col("value")
    plain = F.is_valid_utf8(value) & ~F.contains(value, F.lit("\t")) & ~F.contains(value, F.lit("\r"))
    lines = spark.read.text(paths, pathGlobFilter=glob, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.trim(F.when(plain, value).otherwise(F.regexp_replace(value, "[\r\t]", " "))).alias("text"),
    ).where(F.col("text") != "")
    closed = F.col("text").startswith("{") & F.col("text").endswith("}")
    whole = lines.withColumn("whole", F.coalesce(F.when(closed, one_value("text").isNotNull()), F.lit(False)))
    cut = whole.withColumn("pieces", F.when(~F.col("whole") & F.contains("text", F.lit("}")), value_pieces(F.col("text"))))
    return cut.withColumn("pieces", F.when(F.size("pieces") > 1, F.transform("pieces", lambda x: F.trim(x))))


class Automaton:
    """Reads the units of a file and keeps the intervals of units that are whole values.

    A frame of the stack is an open bracket: its kind, what it waits for and the unit it
    begins, if it stands first in one. `found` holds whole values that lie in no other."""

    # what a frame waits for: a key or the end, a key, a colon, a value, a value or the end, a comma or the end
    KEY_OR_END, KEY, COLON, VALUE, VALUE_OR_END, COMMA = range(6)

    def __init__(self) -> None:
        self.stack: list[list] = []
        #: first unit, last unit, and how many tokens of the last stand behind the value
        self.found: list[tuple[int, int, int]] = []

    def done(self) -> list[tuple[int, int, int]]:
        """What has been found, once nothing can enclose it any more."""
        out, self.found, self.stack = self.found, [], []
        return out

    def _complete(self, start: int | None, end: int, left: int) -> None:
        if start is not None:
            while self.found and self.found[-1][0] >= start:
                self.found.pop()
            self.found.append((start, end, left))

    def _take(self, unit: int, token: str, place: int, left: int) -> bool:
        """Go on by one token of a unit, with `left` tokens behind it; False if it cannot
        stand here."""
        top = self.stack[-1] if self.stack else None
        if token in "{[":
            if top is None and place or top is not None and top[1] not in (self.VALUE, self.VALUE_OR_END) or len(self.stack) >= MAX_DEPTH:
                return False
            if top is not None:
                top[1] = self.COMMA
            self.stack.append([token, self.KEY_OR_END if token == "{" else self.VALUE_OR_END, None if place else unit])
            return True
        if top is None:
            return False
        kind, waits, start = top
        if token in "}]":
            if kind != ("{" if token == "}" else "[") or waits not in (self.COMMA, self.KEY_OR_END, self.VALUE_OR_END):
                return False
            self.stack.pop()
            self._complete(start, unit, left)
            return True
        if token == ",":
            top[1] = self.KEY if kind == "{" else self.VALUE
            return waits == self.COMMA
        if token == ":":
            top[1] = self.VALUE
            return waits == self.COLON
        if waits in (self.KEY, self.KEY_OR_END):
            top[1] = self.COLON
            return token == STRING
        top[1] = self.COMMA
        return waits in (self.VALUE, self.VALUE_OR_END)

    def _take_value(self, unit: int) -> bool:
        """Go on by a whole value."""
        if self.stack:
            if self.stack[-1][1] not in (self.VALUE, self.VALUE_OR_END):
                return False
            self.stack[-1][1] = self.COMMA
        self._complete(unit, unit, 0)
        return True

    def take(self, unit: int, text: str | None) -> bool:
        """Go on by a unit, of which `text` has the tokens (None: a whole value)."""
        return self._take_value(unit) if text is None else all(self._take(unit, t, i, len(text) - 1 - i) for i, t in enumerate(text))


class Held:
    """Units of values that are still open, in order; many of them wait in a file."""

    def __init__(self) -> None:
        self.units: list[tuple[int, int, str]] = []
        self.size, self.file = 0, None

    def __bool__(self) -> bool:
        return bool(self.units or self.file)

    def add(self, position: int, flags: int, text: str) -> None:
        self.units.append((position, flags, text))
        self.size += len(text)
        if self.size > HELD_CHARS:
            self.file = self.file or tempfile.TemporaryFile("w+", encoding="utf-8", newline="\n")
            self.file.writelines(f"{p} {f} {t}\n" for p, f, t in self.units)
            self.units, self.size = [], 0

    def take(self) -> Iterator[tuple[int, int, str]]:
        """All units, which are then no longer held."""
        units, file, self.units, self.size, self.file = self.units, self.file, [], 0, None
        if file:
            with file:
                file.seek(0)
                for line in file:
                    position, flags, text = line[:-1].split(" ", 2)
                    yield int(position), int(flags), text
        yield from units


class Reader:
    """Units of a text in order to rows (position, value): values, and lines of broken text."""

    def __init__(self) -> None:
        self.machine, self.held = Automaton(), Held()
        #: last token of the unit before, and of the one before what is held
        self.last = self.before = None
        #: a line with only a comma is broken text where it is cut on both sides, else it goes
        self.comma: int | None = None

    def follow(self, flags: int, first: str | None, last: str | None) -> Iterator[tuple[int, str]]:
        """Go on to a unit with these tokens at its ends, None if it holds something else."""
        cut = self.cut = flags & INNER or first is None or self.last is None or first not in FOLLOWS.get(self.last, "")
        if self.comma is not None:
            if cut:
                yield self.comma, ","
            self.comma = None
        if cut and self.machine.stack:
            yield from self.release()
        self.previous, self.last = self.last, last

    def unit(self, position: int, flags: int, text: str) -> Iterator[tuple[int, str]]:
        """Read a unit and give what is certain by now. A unit that cannot stand where it is
        ends all that is open and is tried by itself."""
        first, last, marks = ends_of(flags, text)
        yield from self.follow(flags, first, last)
        if first is None:
            yield position, text
            return
        while not self.machine.take(position, marks):
            clean = not self.held
            if clean and text == ",":
                self.machine.done()
                if self.cut:
                    self.comma, self.before = position, self.previous
                return
            if clean or self.machine.found and self.machine.found[-1][1] == position:
                self.held.add(position, flags, text)
                yield from self.release()
                return
            yield from self.release()
        if not self.held:
            self.before = self.previous
        self.held.add(position, flags, text)
        if not self.machine.stack:
            yield from self.release()

    def release(self) -> Iterator[tuple[int, str]]:
        """What is held, as values and lines of broken text."""
        spans, lines = iter(self.machine.done()), []
        span = next(spans, None)
        for position, _, text in self.held.take():
            if span is None or position < span[0]:
                if text != ",":
                    yield position, text
                continue
            lines.append(text)
            if position == span[1]:
                rest, value = behind(text, span[2]), "\n".join(lines)
                yield span[0], value[: len(value) - len(rest)].rstrip(" ")
                if rest.strip(" ") not in ("", ","):
                    yield span[0], rest
                span, lines = next(spans, None), []

    def finish(self) -> Iterator[tuple[int, str]]:
        """The text ends here, or is cut here for certain."""
        if self.comma is not None:
            yield self.comma, ","
        self.comma = self.last = None
        yield from self.release()


def ends_of(flags: int, text: str) -> tuple[str | None, str | None, str | None]:
    """First and last token of a unit, None if it holds something that is no token, and its
    tokens, None for a whole value."""
    if flags & WHOLE:
        return "{", "}", None
    marks = tokens(text)
    return (None, None, marks) if _ODD.search(marks) else (marks[0], marks[-1], marks)


class Block:
    """Lines of one block of a file to rows of `OPENED`: what is certain without the other
    blocks has no `place`, and the rest is in the order of `place`, those lines before the
    first cut and those that are open at the end."""

    def __init__(self, path: str, start: int) -> None:
        self.path, self.start, self.n = path, start, 0
        self.reader, self.head = Reader(), start > 0
        self.waiting: tuple[list[str], list[int]] = [], []

    def _sure(self, rows: Iterator[tuple[int, str]]) -> Iterator[tuple]:
        for position, text in rows:
            yield self.path, position % SPREAD, None, position, 0, text

    def _open(self, position: int, flags: int, text: str | None) -> tuple:
        return self.path, None, 2 * position + (1 if flags & CONTEXT else 0), position, flags, text

    def add(self, texts: list[str], flags: list[int], ended: bool = False) -> Iterator[tuple]:
        """The next units. A value that begins where nothing is open is read at once."""
        texts, flags = self.waiting[0] + texts, self.waiting[1] + flags
        self.waiting = [], []
        reader, first, i = self.reader, self.start + self.n, 0
        while self.head and i < len(texts):
            opens, ends, _ = ends_of(flags[i], texts[i])
            if self.n + i and (flags[i] & INNER or opens is None or reader.last is None or opens not in FOLLOWS.get(reader.last, "")):
                self.head = False
                break
            reader.last = ends
            yield self._open(first + i, flags[i], texts[i])
            i += 1
        joined, at = "", []
        while i < len(texts):
            if not reader.held and texts[i][0] in "{[" and not flags[i] & WHOLE:
                if not joined:
                    joined, at = "\n".join(texts), [0, *itertools.accumulate(len(t) + 1 for t in texts)]
                end = whole_until(joined, at[i])
                if end == len(joined) + 1 and not ended and end - at[i] < HELD_CHARS:
                    self.waiting = texts[i:], flags[i:]
                    break
                if 0 < end <= len(joined):
                    last = bisect.bisect_left(at, end, i) - 1
                    rest = joined[end : at[last + 1] - 1].strip(" ")
                    if rest in ("", ",") and not any(f & INNER for f in flags[i + 1 : last + 1]):
                        yield from self._sure(reader.follow(flags[i], texts[i][0], rest or joined[end - 1]))
                        yield self.path, (first + i) % SPREAD, None, first + i, 0, joined[at[i] : end]
                        i = last + 1
                        continue
            yield from self._sure(reader.unit(first + i, flags[i], texts[i]))
            i += 1
        self.n += i

    def end(self) -> Iterator[tuple]:
        """What the next block may go on with, behind the token it goes on from."""
        yield from self.add([], [], True)
        if self.head:
            return
        reader = self.reader
        rows = iter([(reader.comma, 0, ",")] if reader.comma is not None else reader.held.take())
        opened = next(rows, None)
        yield self._open(opened[0] - 1 if opened else self.start + self.n - 1, CONTEXT, reader.before if opened else reader.last)
        if opened:
            yield self._open(*opened)
            yield from itertools.starmap(self._open, rows)


def _no_constant(name: str):
    raise ValueError(name)


_scan_once = json.JSONDecoder(parse_constant=_no_constant).scan_once


def whole_until(text: str, start: int) -> int:
    """Where the value ends that begins at `start`; 0 if none is whole there, and a place
    behind the text if nothing but its end is in the way."""
    try:
        end = _scan_once(text, start)[1]
        return end if text.count("{", start, end) + text.count("[", start, end) <= MAX_DEPTH else 0
    except StopIteration as error:
        stopped = error.value
    except json.JSONDecodeError as error:
        stopped = error.pos
    except (ValueError, RecursionError):
        return 0
    return 0 if text[stopped:].strip() else len(text) + 1


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a text as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


OPENED = pa.schema([("path", pa.string()), ("spread", pa.int32()), ("place", pa.int64()), ("position", pa.int64()), ("flags", pa.int32()), ("text", pa.string())])
VALUES = pa.schema([("path", pa.string()), ("position", pa.int64()), ("value", pa.string())])


def _units(lines: pa.RecordBatch) -> tuple[list[str], list[int]]:
    """Texts and flags of the units on some lines."""
    column = lambda name: lines[name].to_numpy(zero_copy_only=False)
    texts, flags = column("text").tolist(), (column("whole") * WHOLE).tolist()
    pieces = lines["pieces"]
    for at in reversed(pieces.is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist()):
        cut = [(p, INNER if k else flags[at]) for k, p in enumerate(pieces[at].as_py()) if p]
        texts[at : at + 1], flags[at : at + 1] = [p for p, _ in cut], [f for _, f in cut]
    return texts, flags


def read_blocks(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`units` to rows of `OPENED`. The lines of a block come one after the other."""

    def found() -> Iterator[tuple]:
        block = None
        for frame in frames:
            at = 0
            while at < frame.num_rows:
                rows = frame.slice(at, LINES)
                key = rows["path"][0].as_py(), rows["block"][0].as_py()
                if (rows["path"][-1].as_py(), rows["block"][-1].as_py()) != key:
                    of = zip(rows["path"].to_pylist(), rows["block"].to_pylist(), strict=True)
                    rows = rows.slice(0, sum(1 for _ in itertools.takewhile(key.__eq__, of)))
                if block is None or (block.path, block.start) != key:
                    yield from block.end() if block else ()
                    block = Block(*key)
                yield from block.add(*_units(rows))
                at += rows.num_rows
        yield from block.end() if block else ()

    return batches(found(), OPENED)


def read_open(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `OPENED` in the order of `place` to values. Those of a file that are open go
    through one reader; the others pass."""

    readers: dict[str, Reader] = {}

    def rows(frame: pa.RecordBatch) -> Iterator[tuple]:
        for path, _, place, position, flags, text in zip(*(c.to_pylist() for c in frame.columns), strict=True):
            if place is None:
                yield path, position, text
                continue
            reader = readers.setdefault(path, Reader())
            found = reader.finish() if flags & CONTEXT else reader.unit(position, flags, text)
            yield from ((path, *row) for row in found)
            if flags & CONTEXT:
                reader.last = text

    for frame in frames:
        if frame["place"].null_count == frame.num_rows:
            yield pa.RecordBatch.from_arrays([frame["path"], frame["position"], frame["text"]], schema=VALUES)
        else:
            yield from batches(rows(frame), VALUES)
    yield from batches(((path, *row) for path, reader in readers.items() for row in reader.finish()), VALUES)


def scan_concatenated(spark: SparkSession, paths: str | list[str], glob: str = "*.{gz,json,jsonl,log}") -> DataFrame:
    """Rows (path, position, value): one JSON value, or one line (or what is left of it) of
    broken text, each, at the place where it begins. A value is found if it begins a line or
    follows a value on its line; what stands behind it up to the next break of the line and
    is more than a comma is a row of its own. Positions grow along the file: a block's first
    byte and the number of the unit in it, which is smaller than the block is long."""
    opened = units(spark, paths, glob).mapInArrow(read_blocks, "path string, spread int, place bigint, position bigint, flags int, text string")
    return opened.repartition("path", "spread").sortWithinPartitions("place").mapInArrow(read_open, "path string, position bigint, value string")
