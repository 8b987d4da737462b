"""Chat formatting with a grammar round trip.

Grammar of a rendered turn (control strings are ``CONTROL`` below):

    turn := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

Texts and roles hold no control string, so the parser needs no look-ahead.  A text is rendered as it is first; the
parser reads it back, and if the recovered turns differ from the source, control strings (and what looks like an
escaped one) get a backslash after their first character, until both are identical.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import NULL_ID, chunks, id_out

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that models read as control tokens.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = {first: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) for first in "<["}
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_STUFF = re.compile("|".join(rf"{re.escape(f)}(?=\\*(?:{t}))" for f, t in _TAILS.items()))
_UNSTUFF = re.compile("|".join(rf"{re.escape(f)}\\(?=\\*(?:{t}))" for f, t in _TAILS.items()))
#: Rounds of escaping tried; one is enough by the grammar.
MOST = 3


class NotInGrammar(ValueError):
    pass


def stuff(text: str) -> str:
    return _STUFF.sub(lambda m: m[0] + "\\", text)


def unstuff(text: str) -> str:
    return _UNSTUFF.sub(lambda m: m[0][0], text)


def _role_out(role: str) -> str:
    return stuff(role.replace("%", "%25").replace("\n", "%0A"))


def _role_in(role: str) -> str:
    return unstuff(role).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """role, text, and the place of the rendered text (start, end) of every turn."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise NotInGrammar(at)
        line = rendered.find("\n", at)
        begin = at + len(START)
        stop = _CONTROL.search(rendered, begin)
        if line < 0 or stop is None or stop.start() < line or not rendered.startswith(END, stop.start()):
            raise NotInGrammar(at)
        turns.append((_role_in(rendered[begin:line]), unstuff(rendered[line + 1 : stop.start()]), line + 1, stop.start()))
        at = stop.end() + 1
    return turns


def render_turn(role: str, text: str) -> str:
    """The turn in the grammar, escaped only as far as the round trip needs."""
    shown = text
    for _ in range(MOST):
        out = f"{START}{_role_out(role)}\n{shown}{END}"
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except NotInGrammar:
            pass
        shown = stuff(shown)
    raise AssertionError("no escaped form reads back")


def _stream(batches, loss_role: str, with_text: bool):
    """A row for each conversation, from rows sorted by conversation and turn; one turn is held at a time."""
    now = None

    def row():
        conv, n, turns, chars, loss, formatted, parts, spans = now
        cols = {"conv_id": pa.array([conv], pa.int64()), "n_turns": pa.array([n], pa.int64()), "turns_sha256": pa.array([turns.hexdigest()]), "loss_chars": pa.array([chars], pa.int64())}
        cols |= {"loss_sha256": pa.array([loss.hexdigest()]), "formatted_chars": pa.array([formatted], pa.int64())}
        if with_text:
            cols |= {"formatted": pa.array(["".join(parts)]), "loss_spans": pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        return cols

    def table(rows):
        return pa.RecordBatch.from_pydict({k: pa.concat_arrays([r[k] for r in rows]) for k in rows[0]})

    for batch in chunks(batches):
        out = []
        for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(row())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, [], []]
            rendered = render_turn(role, text)
            (back_role, back_text, begin, end), *_ = parse(rendered)  # what counts is read back from the output
            now[1] += 1
            now[2].update(f"{back_role}\n{back_text}\n".encode())
            if back_role == loss_role:
                now[3] += len(back_text)
                now[4].update(back_text.encode())
            if with_text:
                now[6].append(rendered)
                if back_role == loss_role:
                    now[7].append((now[5] + begin, now[5] + end))
            now[5] += len(rendered)
        if out:
            yield table(out)
    if now is not None:
        yield table([row()])


def format_chats(turns: DataFrame, loss_role: str = "assistant", with_text: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars for every conversation; with
    ``with_text`` also formatted and loss_spans, the places of the loss mask in it.

    Turns follow ``turn``, ties by role, then text; nulls come first.  A null text or role is empty; a null conv_id is a
    conversation of its own; repeated rows are turns of their own.  A conversation is streamed: however long it is, one turn is
    in memory at a time (with ``with_text`` its output as well).
    """
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NULL_ID)).alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    fields += ", formatted string, loss_spans array<struct<start: long, end: long>>" * with_text
    out = rows.mapInArrow(lambda bs: _stream(bs, loss_role, with_text), fields)
    return out.select(id_out("conv_id"), *out.columns[1:])
