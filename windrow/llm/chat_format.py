"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
What follows a conversation's last reply (or a conversation without one) comes as a row without a target, so that no
turn is lost.

Template of a turn: `<turn:ROLE` newline TEXT newline `</turn>` newline. In texts and roles a backslash is doubled and
`<turn` and `</turn` get a backslash in front, a role's newline becomes `\\n`; read_turns undoes it exactly.

Turns are sorted by turn number, then role, then text, so repeated turn numbers have one order; equal rows all stay.
Null texts and roles are empty. Rows with a null conv_id form one conversation. A conversation is formatted by one task
that holds one copy of it: its examples are prefixes of each other, written out batch by batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrow.llm.common import read, trimmed

TURN_END = "\n</turn>\n"
EXAMPLE_SCHEMA = "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long, last boolean"
_BATCH_CHARS = 4_000_000


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<turn", "\\<turn").replace("</turn", "\\</turn")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def turn_text(role: str, text: str) -> tuple[str, str]:
    """The two halves of a formatted turn: its head, and its escaped text."""
    return f"<turn:{escape(role).replace('\n', '\\n')}\n", escape(text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in a formatted text."""
    out = []
    for block in formatted.split(TURN_END)[:-1]:
        head, _, body = block.partition("\n")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head.removeprefix("<turn:"), flags=re.S)
        out.append((role, unescape(body)))
    return out


def expand_prefix_targets(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows to examples: text, and the code points [loss_start, loss_end) that train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        key: tuple | None = None
        parts: list[str] = []
        size = count = examples = 0
        tail: tuple | None = None  # the newest example, until it is known whether it is the last

        def add(row: tuple) -> None:
            nonlocal held
            rows.append(row)
            held += len(row[3])

        def flush() -> pa.RecordBatch:
            nonlocal rows, held
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            rows, held = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end", "last"])

        def end() -> None:
            if key is None:
                return
            whole = tail is not None and tail[2] == count
            if tail is not None:
                add((*tail, whole))
            if not whole:
                add((key[0], examples, count, "".join(parts), None, None, True))

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if key is None or key[0] != conv:
                    end()
                    key, parts, size, count, examples, tail = (conv,), [], 0, 0, 0, None
                head, body = turn_text(role or "", text or "")
                start = size + len(head)
                parts += [head, body, TURN_END]
                size, count = start + len(body) + len(TURN_END), count + 1
                if role == "assistant":
                    if tail is not None:
                        add((*tail, False))
                    parts = ["".join(parts)]
                    tail = (conv, examples, count, parts[0], start, start + len(body))
                    examples += 1
                if held > _BATCH_CHARS:
                    yield flush()
        end()
        if rows:
            yield flush()

    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(trimmed(run), EXAMPLE_SCHEMA)


def digest_examples(examples: DataFrame) -> DataFrame:
    """Reads examples back, in the order expand_prefix_targets emits them: what each conversation says, and what trains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, chars = hashlib.sha256(), 0
        for batch in batches:
            out = []
            for conv, text, start, stop, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss_start", "loss_end", "last"))):
                if start is not None:
                    reply = unescape(text[start:stop])
                    loss.update(reply.encode())
                    chars += len(reply)
                if last:
                    turns = read_turns(text)
                    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                    out.append((conv, len(turns), said.hexdigest(), chars, loss.hexdigest(), len(text)))
                    loss, chars = hashlib.sha256(), 0
            if out:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return examples.mapInArrow(trimmed(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return digest_examples(expand_prefix_targets(turns.unionByName(probe)))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shaped AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn')) AS n_text,
    length(replace(replace(replace(replace(role, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'), chr(10), '\n')) AS n_role
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + n_role + n_text) AS BIGINT) AS formatted_chars
FROM shaped GROUP BY conv_id
"""
