"""Rows of XML files by element path, read in parallel.

Spark's text reader cuts files at ``>``, so a record is some character data and one tag,
and a large file is read by many tasks. What a task cannot know is where in the document
its part (a block of the file) begins: the open elements, and whether the part starts
inside a comment, a CDATA section, a declaration or a quoted attribute. So the files are
walked twice:

1. Every block is summarised for each state it may start in: the state it ends in, the
   elements it closes that were open before, and those it leaves open.
2. The summaries, one row per block, are chained in file order; every block then has its
   starting state and its stack of open elements.
3. Blocks are walked again from there. An element whose path ends with the row path
   begins a row. A row that reaches beyond its block leaves a piece in each block, and
   the pieces are put together by a group-by.

Names are compared without their namespace prefixes. Files are read as UTF-8."""

from __future__ import annotations

import json
import re
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT, COMMENT, CDATA, INSTRUCTION, DOCTYPE, DOUBLE, SINGLE = STATES = range(7)
_CLOSES = {COMMENT: "--", CDATA: "]]", INSTRUCTION: "?", DOCTYPE: "]"}
_NAME = re.compile(r"[^\s/]+")


def local_name(name: str) -> str:
    return name.rsplit(":", 1)[-1]


def _quote(tag: str, open_: str | None = None) -> str | None:
    """The quote that is still open after ``tag``."""
    for c in tag:
        if open_ is None:
            if c in "\"'":
                open_ = c
        elif c == open_:
            open_ = None
    return open_


def step(state: int, record: str):
    """(state after the record, what it does): None, ("open", name), ("close",) or
    ("empty", name); the record's ``>`` is not in it."""
    if state in _CLOSES:
        end = record.rstrip() if state == DOCTYPE else record
        return (TEXT if end.endswith(_CLOSES[state]) else state), None
    if state in (DOUBLE, SINGLE):
        left = _quote(record, '"' if state == DOUBLE else "'")
        if left:
            return (DOUBLE if left == '"' else SINGLE), None
        return TEXT, ("close",) if record.endswith("/") else None  # the element was opened with its name
    at = record.find("<")
    if at < 0:
        return TEXT, None  # a > in character data
    tag = record[at + 1:]
    if tag.startswith("!--"):
        return (TEXT if tag.endswith("--") and len(tag) >= 5 else COMMENT), None
    if tag.startswith("![CDATA["):
        return (TEXT if tag.endswith("]]") else CDATA), None
    if tag.startswith("?"):
        return (TEXT if tag.endswith("?") and len(tag) > 1 else INSTRUCTION), None
    if tag.startswith("!"):
        return (DOCTYPE if "[" in tag and "]" not in tag else TEXT), None
    if tag.startswith("/"):
        return TEXT, ("close",)
    found = _NAME.match(tag)
    if not found:
        return TEXT, None
    left = _quote(tag)
    if left:
        return (DOUBLE if left == '"' else SINGLE), ("open", found.group())
    return TEXT, ("empty" if tag.endswith("/") else "open", found.group())


class Machine:
    """The walk of a block from one starting state, without knowing the stack."""

    def __init__(self, state: int):
        self.state, self.closed, self.open = state, 0, []

    def apply(self, action) -> None:
        if action is None or action[0] == "empty":
            return
        if action[0] == "open":
            self.open.append(action[1])
        elif self.open:
            self.open.pop()
        else:
            self.closed += 1


def _blocks(batches):
    """Yield (file, start, records) with the records of each block in order."""
    now, records = None, None
    for batch in batches:
        for record, *at in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start"))):
            if at != now:
                if now is not None:
                    yield *now, records
                now, records = at, []
            records.append(record)
            if len(records) >= 4096:  # handed on in parts of bounded size
                yield *now, records
                records = []
    if now is not None:
        yield *now, records


def _summaries(batches):
    out, now, machines = [], None, []

    def done():
        for first, m in enumerate(machines):
            out.append((*now, first, m.state, m.closed, m.open))

    for file, start, records in _blocks(batches):
        if (file, start) != now:
            if now is not None:
                done()
            now, machines = (file, start), [Machine(s) for s in STATES]
        for record in records:
            steps = {s: step(s, record) for s in {m.state for m in machines}}
            for m in machines:
                m.state, action = steps[m.state]
                m.apply(action)
    if now is not None:
        done()
    columns = list(zip(*out)) or [[]] * 6
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                     names=["file", "start", "first", "last", "closed", "open"])


def chain(summaries: list) -> dict:
    """(file, start) -> (state, stack) at the start of every block; stack entries are
    (name, start of the block that opened it)."""
    by_block: dict = {}
    for file, start, first, last, closed, opened in summaries:
        by_block.setdefault((file, start), {})[first] = (last, closed, opened)
    out, now = {}, None
    for file, start in sorted(by_block):
        if file != now:
            now, state, stack = file, TEXT, []
        out[file, start] = (state, list(stack))
        last, closed, opened = by_block[file, start][state]
        stack = stack[:max(len(stack) - closed, 0)] + [(name, start) for name in opened]
        state = last
    return out


def _matches(names: list[str], path: list[str]) -> bool:
    if not path:
        return len(names) == 1
    return len(names) >= len(path) and [local_name(n) for n in names[-len(path):]] == path


def _rows(starts: dict, path: list[str]):
    """Whole rows (depth -1) and pieces of rows that cross a block's border."""

    def run(batches):
        out: list = []
        now, state, stack, live = None, TEXT, [], []

        def flush_open():
            for depth, origin, parts in live:
                out.append((now[0], origin, depth, now[1], "".join(parts)))

        def batch():
            columns = list(zip(*out)) or [[]] * 5
            out.clear()
            types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                              names=["file", "origin", "depth", "start", "xml"])

        for file, start, records in _blocks(batches):
            if (file, start) != now:
                if now is not None:
                    flush_open()
                now = (file, start)
                state, stack = starts[now]
                stack = list(stack)
                # rows open from earlier blocks: (depth, block that opened the row, text so far)
                live = [(d, stack[d][1], []) for d in range(len(stack)) if _matches([n for n, _ in stack[:d + 1]], path)]
            for record in records:
                inside = state == TEXT
                state, action = step(state, record)
                raw = record + ">"
                for _, _, parts in live:
                    parts.append(raw)
                if action is None:
                    continue
                if action[0] in ("open", "empty"):
                    stack.append((action[1], start))
                    if _matches([n for n, _ in stack], path):
                        live.append((len(stack) - 1, start, [raw[raw.index("<"):] if inside else raw]))
                if action[0] in ("close", "empty") and stack:
                    if live and live[-1][0] == len(stack) - 1:
                        depth, origin, parts = live.pop()
                        out.append((file, origin, -1 if origin == start else depth, start, "".join(parts)))
                    stack.pop()
            if len(out) >= 1024:
                yield batch()
        if now is not None:
            flush_open()
        yield batch()

    return run


_WHOLE = re.compile(r"-?(0|[1-9][0-9]{0,17})")
_REAL = re.compile(r"-?(0|[1-9][0-9]*)\.[0-9]+([eE][+-]?[0-9]+)?")


class _Literal(str):
    """Text that stands in JSON as it is."""


def _leaf(text: str):
    return _Literal(text) if _WHOLE.fullmatch(text) or _REAL.fullmatch(text) or text in ("true", "false") else text


def _json(value) -> str:
    if isinstance(value, _Literal):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_json, value)) + "]"
    return json.dumps(value)


def element_json(xml: str) -> str:
    """A row's element as JSON: attributes are ``@name``, text beside attributes or
    children is ``_text``, a repeated child is an array."""
    root: list = [{}]
    stack: list = []

    def start(name, attributes):
        stack.append((name, {f"@{k}": _leaf(v) for k, v in attributes.items()}, []))

    def end(name):
        _, fields, parts = stack.pop()
        text = "".join(parts).strip()
        value: object = fields
        if not fields:
            value = _leaf(text) if text else None
        elif text:
            fields["_text"] = _leaf(text)
        if not stack:
            root[0] = value if isinstance(value, dict) else {"_text": value}
            return
        parent = stack[-1][1]
        if name not in parent:
            parent[name] = value
        elif isinstance(parent[name], list):
            parent[name].append(value)
        else:
            parent[name] = [parent[name], value]

    parser = expat.ParserCreate()  # prefixes stay as they are: they may be bound further up
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: stack[-1][2].append(text) if stack else None
    parser.Parse(xml, True)
    return _json(root[0])


def _to_json(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([element_json(x) for x in batch.column("xml").to_pylist()], pa.string())], names=["value"])


def xml_rows(spark: SparkSession, path: str, row_path: str) -> DataFrame:
    """``value``: a JSON object per element whose path ends with ``row_path``."""
    wanted = [local_name(p) for p in re.split(r"[/.]", row_path) if p]
    records = spark.read.option("lineSep", ">").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    found = records.mapInArrow(_summaries, "file string, start long, first int, last int, closed long, open array<string>")
    starts = chain([tuple(r) for r in found.collect()])  # seven rows a block of a file
    pieces = records.mapInArrow(_rows(starts, wanted), "file string, origin long, depth int, start long, xml string")
    whole = pieces.where("depth < 0").select("xml")
    joined = pieces.where("depth >= 0").groupBy("file", "origin", "depth") \
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "xml"))), lambda p: p["xml"]), "").alias("xml")).select("xml")
    return whole.unionByName(joined).mapInArrow(_to_json, "value string")
