"""Chat formatting: a finite-state machine over roles checks the order of turns and emits segments with loss flags.

The template is declarative: the marks around a turn, and which roles' texts carry loss. Texts are escaped so that no
mark can arise inside one, and ``read_back`` undoes it. The rows of a conversation are sorted, then pass one by one: the
state is that of one conversation, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``start`` role ``after_role`` text ``end``; ``loss_roles`` are the roles whose text is learned.

    ``order`` is the machine: from a state (the role before, "" at the start) to the roles that may follow; a
    conversation may stop in a state of ``final``. Marks begin with ``<|``, which no escaped text holds.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    order: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )
    final: frozenset[str] = frozenset({"assistant"})


CHAT = Template()
BROKEN = "broken"


def escape(text: str) -> str:
    """``<|`` gets one backslash more than it had between its characters."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line without marks."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("|", "\\p")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), role)


def turn_segments(role: str, text: str, template: Template = CHAT) -> list[tuple[str, bool]]:
    """(segment, has loss) of one turn; joined they are the formatted turn."""
    head = template.start + escape_role(role) + template.after_role
    return [(head, False), (escape(text), role in template.loss_roles), (template.end, False)]


def read_back(formatted: str, template: Template = CHAT) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not (formatted.startswith(template.start) and formatted.endswith(template.end)):
        raise ValueError("not a formatted turn")
    role, text = formatted[len(template.start) : len(formatted) - len(template.end)].split(template.after_role, 1)
    return unescape_role(role), unescape(text)


_SEGMENTS = pa.schema(
    [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment_no", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("state", pa.string()), ("last", pa.bool_())]
)


def _emit(template: Template):
    """Sorted rows (conv_id, role, text) to segments. ``state`` is the machine's after the turn, or ``broken`` from the
    first turn on that may not follow; ``last`` marks the final segment of a conversation."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, turn, held = None, "", 0, None
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is not None:
                    out.append((*held, c != conv))
                if held is None or c != conv:
                    conv, state, turn = c, "", 0
                state = role if state != BROKEN and role in template.order.get(state, ()) else BROKEN
                for k, (piece, loss) in enumerate(turn_segments(role or "", text or "", template)):
                    if k:
                        out.append((*held, False))
                    held = (c, turn, k, piece, loss, state)
                turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(list(zip(*out)) or [[]] * len(_SEGMENTS), _SEGMENTS)], schema=_SEGMENTS)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((*held, True), _SEGMENTS)], schema=_SEGMENTS)

    return emit


def chat_segments(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHAT) -> DataFrame:
    """(conv_id, turn_no, segment_no, text, loss, state, last) of all conversations, in order within a partition.

    Turns go by ``turn_col``, nulls first; of equal ones by role and text, and repeated rows stay. Null texts and roles
    are empty; a null conversation id is a conversation of its own. A conversation is well formed if its last state is
    final. An empty table gives no rows, other columns are ignored.
    """
    rows = rows.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("t"), F.col(role_col).cast("string").alias("r"), F.col(text_col).cast("string").alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")
    return rows.mapInArrow(_emit(template), "conv_id long, turn_no long, segment_no int, text string, loss boolean, state string, last boolean")


def formatted_chats(segments: DataFrame) -> DataFrame:
    """One row a conversation with its whole text, for conversations that fit into a row."""
    turns = F.array_sort(F.collect_list(F.struct("turn_no", "segment_no", "text")))
    return segments.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda s: s["text"]), "").alias("formatted"))


_DIGEST = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("well_formed", pa.bool_())]
)


def _digest(template: Template):
    """Reads the segments back, a turn at a time: digests of the turns and of the text under the loss mask."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, learned, n, learned_chars, chars, parts = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts.append(row["text"])
                chars += len(row["text"])
                if row["loss"]:
                    text = unescape(row["text"])
                    learned_chars += len(text)
                    learned.update(text.encode("utf-8", "surrogatepass"))
                if row["segment_no"] == 2:
                    role, text = read_back("".join(parts), template)
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n, parts = n + 1, []
                if row["last"]:
                    out.append((row["conv_id"], n, turns.hexdigest(), learned_chars, learned.hexdigest(), chars, row["state"] in template.final))
                    turns, learned, n, learned_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(list(zip(*out)) or [[]] * len(_DIGEST), _DIGEST)], schema=_DIGEST)

    return digest


def chat_digests(segments: DataFrame, template: Template = CHAT) -> DataFrame:
    """What ``chat_segments`` holds of each conversation, read back from its segments in their order."""
    return segments.mapInArrow(
        _digest(template),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, well_formed boolean",
    )
