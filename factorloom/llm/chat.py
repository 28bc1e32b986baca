"""Chat formatting on token level: segments encoded apart, reserved ids spliced in, masks from prefix sums."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factorloom.llm.text import ready_for_python
from factorloom.llm.tokens import encoder
from factorloom.session import settle

# The template's own marks, and control strings of common templates.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
CONTROLS = (
    TURN, BODY, END, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
#: Stands after the first character of a control string that a text holds; doubled where the text has it itself.
ESCAPE = "\\"
_control = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.DOTALL)


def escape(text: str) -> str:
    """The text with every control string in it broken; ``unescape`` gives it back."""
    return _control.sub(r"\1\\", text.replace(ESCAPE, ESCAPE * 2))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: DataFrame, tokenizer: str, learn: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, place, ids, start, loss_from, loss_to.

    A turn is TURN role BODY text END. Role and text are escaped and encoded each on its own, so
    no token spans a segment border, and the three marks are ids above the vocabulary that no
    text can encode to. ``start`` is the running sum of the conversation's ids before the turn.
    The loss covers ids ``loss_from`` to ``loss_to`` (places in the conversation, end exclusive):
    the text of turns whose role is ``learn``, an empty range for others.

    Turns follow by turn number (nulls first), then role, then a hash of the text, so ties and repeated
    rows have a defined order; null roles and texts are empty; rows with a null conversation id
    form one conversation. Columns other than conv_id, turn, role and text are not read, and
    an empty table gives an empty one. Encoding needs no grouping; numbering streams over a
    conversation sorted by Spark, so a very long one costs time in its task but no memory.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        turn_id, body_id, end_id = np.array([[coder.vocabulary], [coder.vocabulary + 1], [coder.vocabulary + 2]], np.uint32)
        for batch in batches:
            roles, texts = batch["role"].to_pylist(), batch["text"].to_pylist()
            coded = coder.encode_batch([escape(x) for x in roles + texts])
            heads, bodies = coded[: len(roles)], coded[len(roles) :]
            yield pa.record_batch({
                "conv_id": batch["conv_id"], "turn": batch["turn"], "role": batch["role"],
                "tie": batch["tie"],
                "ids": pa.array([np.concatenate([turn_id, h, body_id, b, end_id]).astype(np.int32) for h, b in zip(heads, bodies, strict=True)], pa.list_(pa.int32())),
                "head": pa.array([len(h) + 2 for h in heads], pa.int64()), "body": pa.array([len(b) for b in bodies], pa.int64())})

    ready_for_python(turns.sparkSession)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    plain = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role"), blank("text"))
    plain = plain.withColumn("tie", F.xxhash64("text"))
    coded = plain.mapInArrow(encoded, "conv_id long, turn long, role string, tie long, ids array<int>, head long, body long")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    size = F.size("ids").cast("long")
    placed = coded.withColumn("place", F.row_number().over(order) - 1)
    placed = placed.withColumn("start", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size)
    begin = F.col("start") + F.col("head")
    until = F.when(F.col("role") == learn, begin + F.col("body")).otherwise(begin)
    return placed.select("conv_id", "place", "ids", "start", begin.alias("loss_from"), until.alias("loss_to"))


def assemble(formatted: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, input_ids and loss_mask, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "ids", "loss_from", "loss_to")))
    mask = lambda t: F.transform(
        t["ids"], lambda _, i: ((t["start"] + i >= t["loss_from"]) & (t["start"] + i < t["loss_to"])).cast("int"))
    grouped = formatted.groupBy("conv_id").agg(parts.alias("p"))
    return grouped.select("conv_id", F.flatten(F.transform("p", lambda t: t["ids"])).alias("input_ids"), F.flatten(F.transform("p", mask)).alias("loss_mask"))


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Digests of every conversation, from the formatted ids alone.

    Turns are parsed at the reserved ids, decoded and unescaped. Rows stream through in
    conversation order; a hash is carried over, so a conversation of any length needs no memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        turn_id, body_id, end_id = coder.vocabulary, coder.vocabulary + 1, coder.vocabulary + 2
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        at, state = None, None

        def row() -> dict:
            return dict(zip(names, (at[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True))

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if at is None or at[0] != r["conv_id"]:
                    if at is not None:
                        done.append(row())
                    at, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.array(r["ids"], np.int64)
                cut = int(np.flatnonzero(ids == body_id)[0])
                assert ids[0] == turn_id and ids[-1] == end_id
                role, text = coder.decode(ids[1:cut]), coder.decode(ids[cut + 1 : -1])
                low, high = r["loss_from"] - r["start"], r["loss_to"] - r["start"]
                learned = unescape(coder.decode(ids[low:high])) if high > low else ""
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(TURN) + len(role) + len(BODY) + len(text) + len(END)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if at is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=schema)

    ready_for_python(formatted.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def written(formatted: DataFrame) -> DataFrame:
    """The formatted turns, written to the shared folder and read again."""
    return settle(formatted, "chat")
