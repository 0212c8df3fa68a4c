"""Chat formatting (operator 8): a finite-state machine over roles and a declarative template.

Turns of a conversation, in order, drive a machine over roles that says whether the order is valid;
every turn emits segments (text, loss flag) by the template. Control strings inside roles and texts
are escaped reversibly, so segments read back to exactly the turns they came from.

Conversations are dealt by id and sorted within partitions, then streamed: one conversation, however
long, takes the memory of one turn. Edge cases: null role or text is empty; a null conversation id
is one conversation; turns of equal number go by role, then text; unknown roles are formatted and
make the order invalid; other columns are not read; no turns, no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches


@dataclass(frozen=True)
class Template:
    """Each turn is begin + role + middle + text + end; the texts of ``loss_roles`` are under the loss mask.

    ``moves``: of each state, the next by role; what isn't there is invalid. ``final``: states to end in."""

    begin: str = "<s>[INST] "
    middle: str = " [/INST]"
    end: str = "</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "told"), ("start", "user", "asked"), ("told", "user", "asked"), ("asked", "assistant", "answered"), ("answered", "user", "asked"),
    )
    final: tuple[str, ...] = ("answered",)

    def next(self, state: str, role: str) -> str:
        return {(a, r): b for a, r, b in self.moves}.get((state, role), "invalid")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls:
            text = text.replace(c, c[0] + "\\" + c[1:])
        return text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.begin + self.escape(role) + self.middle, False), (self.escape(text), role in self.loss_roles), (self.end, False)]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


_SEGMENT = "conv_id bigint, turn_no bigint, segment int, text string, loss boolean, valid boolean"


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments in order within a partition, all of a conversation in one. ``valid``: the order of turns so far,
    and on a conversation's last segment, of the whole of it (which must also end in a final state)."""
    small_batches(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv: object = run  # no conversation yet
        state, n = template.start, 0

        def close() -> None:
            if rows and state not in template.final:
                rows[-1] = (*rows[-1][:5], False)

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                role, text = role or "", text or ""
                if conv is run or c != conv:
                    close()
                    conv, state, n = c, template.start, 0
                state = template.next(state, role)
                rows += [(c, n, i, x, loss, state != "invalid") for i, (x, loss) in enumerate(template.segments(role, text))]
                n += 1
            # the last turn waits: it may end its conversation
            done, rows = rows[:-3], rows[-3:]
            yield _rows(done)
        close()
        yield _rows(rows)

    part = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return part.select("conv_id", "role", "text").mapInArrow(run, _SEGMENT)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "turn_no": pa.int64(), "segment": pa.int32(), "text": pa.string(), "loss": pa.bool_(), "valid": pa.bool_()}
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation, from the segments' texts and flags alone (``formatted`` as segments() left it).

    The formatted text is parsed at the control strings, role and text are unescaped, and what the flags
    put under the loss mask is unescaped and digested."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv: object = run
        held = turns = loss = None
        n = chars = loss_chars = 0
        valid = True

        def close() -> None:
            if conv is not run:
                if held:
                    raise ValueError("a formatted conversation ends inside a turn")
                out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))

        for batch in batches:
            for c, text, flag, ok in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "valid")), strict=True):
                if conv is run or c != conv:
                    close()
                    conv, held, turns, loss, n, chars, loss_chars, valid = c, "", hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
                chars += len(text)
                valid = valid and ok
                if flag:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                held += text
                while (end := held.find(template.end)) >= 0:
                    turn, held = held[:end], held[end + len(template.end) :]
                    role, found, body = turn.partition(template.middle)
                    if not found or not role.startswith(template.begin):
                        raise ValueError("a formatted turn lacks its marks")
                    turns.update(f"{unescape(role[len(template.begin):])}\n{unescape(body)}\n".encode())
                    n += 1
            yield _result(out)
            out = []
        close()
        yield _result(out)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")


def _result(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "valid": pa.bool_()}
    cols = list(zip(*out, strict=True)) if out else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))
