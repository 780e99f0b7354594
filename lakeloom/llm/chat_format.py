"""Formatting conversations by a compiled template, with a loss mask.

Conversations are shuffled by id and sorted by turn inside the partitions; a task
walks its partition and renders one conversation after the other as a stream, so
neither a conversation nor its output is held as a whole. The output is read back
by an independent reader, which finds turns and masked texts and undoes the
escapes; the digests come from what it read.

The template marks a turn as ``### role:``, a line end, the text and ``</turn>``. A
backslash goes before each backslash, ``### `` and ``</turn>`` inside texts, and in
roles also before ``:`` and line ends.

Defined results: null text and null role are empty; rows of equal turn come in the
order of role, then text; a null turn comes first; a null conv_id is a conversation
of its own; repeated rows are repeated turns; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat_template import compile_template, unescape
from .registry import query, table

TEMPLATE = """{% for m in turns %}{{ "### " }}{{ m.role|escape_role }}:
{% if m.role == "assistant" %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}{{ "</turn>" + "\\n" }}{% endfor %}"""

MARK, END = "### ", "</turn>\n"


class Reader:
    """Reads formatted text piece by piece: digests of the turns, of the masked
    text, and counts. Holds one turn at most."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest, self.masked = "", []

    def feed(self, text: str, masked: bool) -> None:
        self.chars += len(text)
        self.rest += text
        if masked:
            self.masked.append(text)
        elif text.endswith(END) or END in text:
            self._read()

    def _read(self) -> None:
        while (end := self._find_end()) is not None:
            role, body = self._split(self.rest[len(MARK):end])
            if not self.rest.startswith(MARK):
                raise ValueError("a turn does not begin with its mark")
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n_turns += 1
            self.rest = self.rest[end + len(END):]
        if self.masked:
            text = unescape("".join(self.masked))
            self.loss.update(text.encode())
            self.loss_chars += len(text)
            self.masked = []

    def _find_end(self):
        """Place of the first END that no escape covers."""
        at = self.rest.find(END)
        while at >= 0:
            back = at
            while back and self.rest[back - 1] == "\\":
                back -= 1
            if (at - back) % 2 == 0:
                return at
            at = self.rest.find(END, at + 1)
        return None

    @staticmethod
    def _split(turn: str):
        i = 0
        while turn[i] != ":":
            i += 2 if turn[i] == "\\" else 1
        return unescape(turn[:i]), unescape(turn[i + 2:])

    def digest(self):
        if self.rest:
            raise ValueError("text after the last turn")
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _rows(batches):
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text")))


def formatted(rows, render, emit_to):
    """Render the conversations of sorted (id, role, text) rows; ``emit_to(id)``
    gives each one's sink. Yields the ids as they end."""
    for conv, turns in groupby(rows, key=lambda r: r[0]):
        sink = emit_to(conv)
        render(({"role": role or "", "text": text or ""} for _, role, text in turns), sink.feed)
        yield conv, sink


class Collector:
    """Keeps a conversation's text and its masked spans (code points)."""

    def __init__(self):
        self.parts, self.spans, self.at = [], [], 0

    def feed(self, text, masked):
        if masked and text:
            if self.spans and self.spans[-1][1] == self.at:
                self.spans[-1][1] += len(text)
            else:
                self.spans.append([self.at, self.at + len(text)])
        self.parts.append(text)
        self.at += len(text)


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("id").sortWithinPartitions("id", F.col("turn").asc_nulls_first(), "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, loss_spans): the whole output of each conversation."""

    def run(batches):
        render = compile_template(template)
        for conv, sink in formatted(_rows(batches), render, lambda _: Collector()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array(["".join(sink.parts)]), pa.array([sink.spans], pa.list_(pa.list_(pa.int64())))],
                names=["conv_id", "formatted", "loss_spans"])

    return _sorted(conversations).mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<long>>")


def conversation_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """A row per conversation with what the reader found in its output."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        render = compile_template(template)
        out: list = []
        for conv, reader in formatted(_rows(batches), render, lambda _: Reader()):
            out.append((conv, *reader.digest()))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names)

    return _sorted(conversations).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Conversation -7: texts that hold the template's own control strings.
EXTRA_TEXT = r"\### Assistant: </turn> ok"

SQL = r"""
WITH c AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) AS text_chars,
         length(regexp_replace(role, '([\\:\n]|### |</turn>)', '\\\1', 'g')) AS role_chars FROM c)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(SUM(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op4_chat_format", SQL)
def op4_chat_format(spark, d):
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)],
                                  "conv_id long, turn long, role string, text string")
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_digests(given.unionByName(extra))
