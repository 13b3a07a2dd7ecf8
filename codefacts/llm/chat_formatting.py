"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Turns arrive sorted by conversation and turn. The machine checks the order of the roles and emits, for each turn, three
segments: an opening mark with the role, the text, a closing mark. Only texts of the template's loss roles carry loss.
Control strings inside texts are escaped reversibly: each `<`, any backslashes and `|` get one more backslash, so that no
text can hold a mark, and reading takes that backslash away.

Cases: a null text is empty; a null role is an empty one; a null turn comes last; equal turns go by role and text;
repeated rows are repeated turns; null conversation ids are one conversation. A wrong order of roles doesn't drop a
conversation: its segments carry the first fault in `fault`. State is one turn, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: From each state (the last role; "" at the start) to the roles that may follow.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: f"<{m[1]}\\|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    """Roles stand on one line: their line breaks are written as two characters."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


SEGMENTS = "seg long, text string, loss boolean, fault string"


def format_conversations(turns: DataFrame, template: Template = Template(), partitions: int | None = None) -> DataFrame:
    """Segments (conv_id, seg, text, loss, fault) of each conversation, in order inside each partition.

    One shuffle by conversation and a sort in each partition; a conversation of any length streams through one task.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = t.repartition(partitions, "conv_id") if partitions else t.repartition("conv_id")
    given = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text").select("conv_id", "role", "text")
    kind = given.schema["conv_id"].dataType.simpleString()

    def run(batches):
        last, state, seg, fault, begun = None, "", 0, None, False
        for b in batches:
            rows: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not begun or conv != last:
                    last, state, seg, fault, begun = conv, "", 0, None, True
                if fault is None and role not in template.follows.get(state, ()):
                    fault = f"{role or 'no role'} after {state or 'start'}"
                state = role
                rows += (
                    (conv, seg, f"{template.start}{escape_role(role)}\n", False, fault),
                    (conv, seg + 1, escape(text), role in template.loss_roles, fault),
                    (conv, seg + 2, f"{template.end}\n", False, fault),
                )
                seg += 3
            yield table_of(rows, schema)

    out = f"conv_id {kind}, {SEGMENTS}"
    schema = arrow_schema(given.sparkSession, out)
    return given.mapInArrow(run, out)


def arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation, what its formatted stream says: turns and loss text, as digests.

    segments must come as format_conversations returns them: whole conversations in order inside a partition.
    """
    given = segments.select("conv_id", "text", "loss", "fault")
    out = f"conv_id {given.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fault string"
    schema = arrow_schema(given.sparkSession, out)
    turn = re.compile(re.escape(template.start) + r"([^\n]*)\n(.*?)" + re.escape(template.end) + r"\n", re.S)

    def run(batches):
        conv, begun, fault = None, False, None
        n = loss_chars = chars = 0
        turns = loss = None
        stream: list[str] = []

        def done():
            if stream:
                raise ValueError(f"conversation {conv}: text outside of turns")
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, fault

        for b in batches:
            rows = []
            for c, text, masked, bad in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not begun or c != conv:
                    if begun:
                        rows.append(done())
                    conv, begun, n, loss_chars, chars, turns, loss = c, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                fault = bad
                chars += len(text)
                if masked:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                stream.append(text)
                if text.endswith(f"{template.end}\n"):
                    m = turn.fullmatch("".join(stream))
                    if m:
                        n += 1
                        turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                        stream.clear()
            yield table_of(rows, schema)
        if begun:
            yield table_of([done()], schema)

    return given.mapInArrow(run, out)
