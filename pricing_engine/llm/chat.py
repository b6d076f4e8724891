"""Chat formatting by prefix-target expansion: an example for every assistant turn.

An example is all turns up to one assistant turn, of which only that reply is under
the loss mask.  Turns are marked as ``<|im_start|>role\\ntext<|im_end|>\\n``; control
strings inside roles and texts are escaped with a backslash, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# fixed values: strings that chat templates in public use give a meaning
CONTROL = (
    START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|begin_of_text|>",
    "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>",
)
TARGET_ROLE = "assistant"

_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(\\?)", re.S)
_HEADER = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n", re.S)

EXAMPLE = (
    "conv_id long, example int, text string, loss_start long, loss_end long, trainable boolean"
)


def escape(text: str) -> str:
    """A backslash after the first character of every control string, and after every backslash."""
    return _ESCAPE.sub(lambda m: m.group() + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _role(role: str) -> str:
    # a line end would end the header
    return escape(role).replace("\n", "\\n")


def _unrole(role: str) -> str:
    return re.sub(r"\\(.?)", lambda m: {"\\": "\\", "n": "\n"}.get(m[1], m[1]), role, flags=re.S)


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text starts and ends."""
    head = f"{START}{_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) of a formatted text."""
    at = 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        end = formatted.index(END + "\n", head.end())
        yield _unrole(head[1]), unescape(formatted[head.end() : end])
        at = end + len(END) + 1


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def examples(turns: DataFrame) -> DataFrame:
    """Examples of ``turns`` (conv_id, turn, role, text), with columns as in ``EXAMPLE``.

    ``loss_start`` and ``loss_end`` bound, in code points of ``text``, the escaped
    reply to train on.  Turns that follow the last reply, or a conversation without
    any, make one example that is not trainable, so that no turn is lost.  Null roles
    and texts count as empty, a null turn comes first, turns of one number follow by
    role and text, a null conv_id is a conversation like others; no rows, no examples.

    Conversations are read from a sorted stream: a task holds the formatted text of
    the one it is in.  Examples of a conversation come out together and in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        conv: tuple | None = None
        prefix, pending, number = "", False, 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if conv != (conv_id,):
                    if conv is not None and pending:
                        out.append((conv[0], number, prefix, len(prefix), len(prefix), False))
                    conv, prefix, number = (conv_id,), "", 0
                piece, start, end = turn_text(role, text)
                base, prefix = len(prefix), prefix + piece
                pending = role != TARGET_ROLE
                if not pending:
                    out.append((conv_id, number, prefix, base + start, base + end, True))
                    number += 1
                    size += len(prefix)
                if size > 4_000_000:
                    yield _batch(out, EXAMPLE)
                    out, size = [], 0
        if conv is not None and pending:
            out.append((conv[0], number, prefix, len(prefix), len(prefix), False))
        if out:
            yield _batch(out, EXAMPLE)

    return _ordered(turns).mapInArrow(run, EXAMPLE)


DIGEST = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_examples long"
)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output of :func:`examples` holds, read back conversation by conversation.

    The turns are those of a conversation's last example, the loss text is that under
    the masks of all, unescaped; ``formatted_chars`` counts the examples' characters.
    Must directly follow :func:`examples`, whose order it relies on.
    """

    def done(state: list) -> tuple:
        conv_id, loss, loss_chars, chars, number, last = state
        digest, turns = hashlib.sha256(), 0
        for role, text in parse(last):
            digest.update(f"{role}\n{text}\n".encode())
            turns += 1
        return conv_id, turns, digest.hexdigest(), loss_chars, loss.hexdigest(), chars, number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for batch in batches:
            out = []
            for conv_id, number, text, start, end in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or number == 0:
                    if state is not None:
                        out.append(done(state))
                    state = [conv_id, hashlib.sha256(), 0, 0, 0, ""]
                reply = unescape(text[start:end])
                state[1].update(reply.encode())
                state[2] += len(reply)
                state[3] += len(text)
                state[4] += 1
                state[5] = text
            if out:
                yield _batch(out, DIGEST)
        if state is not None:
            yield _batch([done(state)], DIGEST)

    return formatted.mapInArrow(run, DIGEST)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields]
    )
