"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, turn, kind, role, text) of conversations. They are partitioned by conversation and sorted by turn
and sequence number; a fold over each message gives its final text:

  start       a new message of `role` begins with `text`; another start on the same turn is another message
  delta       `text` is appended to the message
  edit        the message's text so far becomes `text`
  regenerate  the message's text so far is thrown away, and `text` begins a new one
  delete      the message goes

A message is rendered as OPEN role NEWLINE text CLOSE NEWLINE. Control strings inside roles and texts are broken up by a backslash after
their first character, after backslashes have been doubled, so that no text can forge a mark and `unescape` gives back every text.
`read_back` parses the rendered rows again, and digests turns and the text under the loss mask: the assistants' texts, once, in order.

Both steps stream over sorted partitions: a task holds one message and one Arrow batch, however long a conversation is.

Defined results: null texts and roles are empty; events of other kinds, and those before any start of their turn, change nothing; a
null seq or turn sorts first; a null conv_id is a conversation of its own; ties of turn and seq are ordered by role and the SHA-256 of
the text; repeated starts are messages of their own; an empty log gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import require

OPEN, CLOSE = "<|turn|>", "<|end|>"
CONTROLS = (OPEN, CLOSE, "</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ASSISTANT = "assistant"
CHUNK = 400  # code points per delta, where whole texts are turned into a log

_MESSAGE = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("ordinal", pa.int64()), ("role", pa.string()),
                      ("text", pa.string()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_MESSAGE_SQL = ("conv_id long, turn long, ordinal long, role string, text string, rendered string, "
                "loss_start long, loss_end long")
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_BREAK = re.compile("|".join(re.escape(mark) for mark in sorted(CONTROLS, key=len, reverse=True)))
_JOIN = re.compile(r"\\(.)", re.DOTALL)
_PARSED = re.compile(re.escape(OPEN) + r"(.*?)\n(.*)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return _BREAK.sub(lambda found: found[0][0] + "\\" + found[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _JOIN.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As `escape`, and without line breaks, which end the role."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _JOIN.sub(lambda found: "\n" if found[1] == "n" else found[1], role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered message, and where its text begins and ends in it."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(rendered: str) -> tuple[str, str]:
    role, text = _PARSED.fullmatch(rendered).groups()
    return unescape_role(role), unescape(text)


def events_of(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A log of whole messages (conv_id, turn, role, text): a start per row, then deltas of `chunk` code points."""
    require(conversations, "conv_id", "turn", "role", "text")
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id())
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / chunk).cast("int")), lambda i: F.struct(
        F.when(i == 0, "start").otherwise("delta").alias("kind"), i.alias("step"),
        F.when(i == 0, "").otherwise(F.substr("text", (i - 1) * chunk + 1, F.lit(chunk))).alias("text")))
    # seq: rows of one turn follow each other by role and text; no two rows share a sequence number
    return rows.select("conv_id", "turn", "role", "tie", "row", F.explode(pieces).alias("piece")).select(
        "conv_id", "turn", F.struct("role", "tie", "row", "piece.step").alias("seq"), "piece.kind", "role", "piece.text")


def final_messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, ordinal, role, text, rendered, loss_start, loss_end): the folded and rendered messages of every conversation.
    The loss mask covers rendered[loss_start:loss_end]; it is empty but for assistants. `seq` may have any type that sorts."""
    require(events, "conv_id", "turn", "seq", "kind", "role", "text")

    def fold(batches):
        at, open_message, parts, ordinal = None, None, [], 0

        def close():
            conv_id, turn, number, role = open_message
            text = "".join(parts)
            rendered, begin, end = render(role, text)
            begin, end = (begin, end) if role == ASSISTANT else (0, 0)
            return conv_id, turn, number, role, text, rendered, begin, end

        for batch in batches:
            done = []
            for conv_id, turn, kind, role, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if at is None or at[0] != conv_id or at[1] != turn:
                    if open_message:
                        done.append(close())
                    ordinal = 0 if at is None or at[0] != conv_id else ordinal
                    at, open_message, parts = (conv_id, turn), None, []
                if kind == "start":
                    if open_message:
                        done.append(close())
                    open_message, parts, ordinal = (conv_id, turn, ordinal, role or ""), [text or ""], ordinal + 1
                elif open_message and kind == "delta":
                    parts.append(text or "")
                elif open_message and kind in ("edit", "regenerate"):
                    parts = [text or ""]
                elif open_message and kind == "delete":
                    open_message, parts = None, []
            if done:
                yield _rows(done, _MESSAGE)
        if open_message:
            yield _rows([close()], _MESSAGE)

    key = F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 62)))
    tie = F.sha2(F.coalesce("text", F.lit("")), 256)
    ordered = (events.repartition(key).sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("seq").asc_nulls_first(), "role", tie)
        .select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "kind", "role", "text"))
    return ordered.mapInArrow(fold, _MESSAGE_SQL)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], field.type) for k, field in enumerate(schema)], schema=schema)


def read_back(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the rendered rows."""

    def run(batches):
        at, turns, counts, loss, fresh = None, None, [0, 0, 0], None, True

        def finish():
            return at, counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2]

        for batch in batches:
            done = []
            for conv_id, rendered, begin, end in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if fresh or conv_id != at:
                    if not fresh:
                        done.append(finish())
                    at, turns, loss, counts, fresh = conv_id, hashlib.sha256(), hashlib.sha256(), [0, 0, 0], False
                role, text = parse(rendered)
                turns.update(f"{role}\n{text}\n".encode())
                masked = unescape(rendered[begin:end])
                loss.update(masked.encode())
                counts = [counts[0] + 1, counts[1] + len(masked), counts[2] + len(rendered)]
            if done:
                yield _rows(done, _DIGEST)
        if not fresh:
            yield _rows([finish()], _DIGEST)

    key = F.coalesce("conv_id", F.lit(-(1 << 62)))
    ordered = (messages.repartition(key).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "ordinal")
               .select("conv_id", "rendered", "loss_start", "loss_end"))
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
