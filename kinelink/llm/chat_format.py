"""Operator 4: chat formatting by a finite-state machine over roles.

A declarative template names the marks, the roles and the transitions. Turns of a conversation pass
in order; the machine says which turns break the order, and every turn is emitted as segments with
a loss flag: opening mark, text, closing mark. What must be escaped and how the output is read back follow from the
template's marks: control strings inside texts and roles get backslashes, reversibly, so no text can open or close a
turn, and reading fails on anything that is not a turn. Rows are dealt by conversation and sorted,
and a conversation streams through its task turn by turn; nothing but running digests is held.

Nulls: a null text or role is empty, a null conversation id is a conversation, a null turn comes first.
Rows that tie on the turn are ordered by role and text; rows that repeat are turns of their own. Other
columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    open: str = "### {role}: "
    close: str = "</turn>\n"
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple = ("assistant",)
    start: str = "start"
    #: state after a turn by (state, role); what is missing breaks the order
    moves: dict = field(default_factory=lambda: {("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: tuple = ("answered",)


    def __post_init__(self):
        if self.open.count("{role}") != 1 or not self.close or not all(self.open.split("{role}")):
            raise ValueError("open holds {role} once, with marks before and after it, and close is not empty")


def _chars(text: str) -> str:
    return "".join(map(re.escape, text))


def _until(mark: str) -> str:
    """Pattern of escaped text up to an unescaped mark; it never goes back, so memory does not follow the length."""
    return rf"((?:[^\\{_chars(mark[0])}]++|\\.|{re.escape(mark[0])}(?!{re.escape(mark[1:])}))*+)" if len(mark) > 1 else rf"((?:[^\\{_chars(mark)}]++|\\.)*+)"


def _sign_by_sign(mark: str, closes: bool) -> bool:
    """Whether a mark is escaped by its signs: a run of one sign, and a closing mark whose end can begin it again behind a text."""
    return len(set(mark)) == 1 or closes and any(mark[:k] == mark[-k:] for k in range(1, len(mark)))


@cache
def _patterns(opening: str, close: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """(what to escape in texts, in roles, a turn) of a template's marks; a group `behind` is broken behind its sign, all else before each."""
    before, after = opening.split("{role}")
    mark, end = before.strip() or before, close.strip() or close
    rules = [r"\\", re.escape(end[0]) if _sign_by_sign(end, True) else None, f"{re.escape(mark[0])}{{{len(mark)},}}" if _sign_by_sign(mark, False) else None]
    broken = [f"{re.escape(m[0])}(?={re.escape(m[1:])})" for m, closes in ((mark, False), (end, True)) if not _sign_by_sign(m, closes)]
    text = "|".join([*filter(None, rules), *([f"(?P<behind>{'|'.join(broken)})"] if broken else [])])
    role = "|".join([text, *(re.escape(c) for c in dict.fromkeys(after.strip() or after)), "\n"])
    turn = re.escape(before) + _until(after) + re.escape(after) + _until(end) + re.escape(close)
    return re.compile(text), re.compile(role), re.compile(turn, re.S)


_ESCAPED = re.compile(r"\\(.)", re.S)


def _guard(m: re.Match) -> str:
    return m.group() + "\\" if m.groupdict().get("behind") else "".join("\\" + c for c in m.group())


def escape(text: str, template: Template = Template()) -> str:
    return _patterns(template.open, template.close)[0].sub(_guard, text)


def escape_role(role: str, template: Template = Template()) -> str:
    return _patterns(template.open, template.close)[1].sub(_guard, role)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segments(role: str, text: str, template: Template) -> list[tuple[str, bool]]:
    """(segment, loss flag) of one turn; a role that the template doesn't name stands for itself."""
    name = template.names.get(role)
    if name is None:
        name = escape_role(role, template)
        name = "\\" + name if name in template.names.values() else name
    return [("".join((name if part == "{role}" else part) for part in re.split(r"({role})", template.open)), False), (escape(text, template), role in template.loss), (template.close, False)]


def read_back(formatted: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string; an error if anything in it is not a turn."""
    roles, turn = {name: role for role, name in template.names.items()}, _patterns(template.open, template.close)[2]
    out, at = [], 0
    while at < len(formatted):
        m = turn.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at place {at} of the formatted text")
        out.append((roles[m[1]] if m[1] in roles else unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


@dataclass
class _Digest:
    conv: int | None
    state: str
    n: int = 0
    loss_chars: int = 0
    formatted: int = 0
    bad: int | None = None

    def __post_init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, template: Template) -> None:
        following = template.moves.get((self.state, role))
        if following is None and self.bad is None:
            self.bad = self.n
        self.state = following or self.state
        parts = segments(role, text, template)
        for segment, flag in parts:
            self.formatted += len(segment)
            if flag:
                plain = unescape(segment)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
        # turns are read one by one from the left, so reading a conversation is reading its turns
        for role_read, text_read in read_back("".join(s for s, _ in parts), template):
            self.turns.update(f"{role_read}\n{text_read}\n".encode())
            self.n += 1

    def row(self, template: Template) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted, self.bad is None and self.state in template.final, self.bad


_RESULT = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_bad_turn"]
_RESULT_TYPES = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_bad_turn long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()), ("first_bad_turn", pa.int64())])


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turn, part, segment, loss, ordered: the template's output in order within a conversation."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, n = object(), template.start, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, state, n = c, template.start, 0
                following = template.moves.get((state, role))
                out += [(c, n, k, s, flag, following is not None) for k, (s, flag) in enumerate(segments(role, text, template))]
                state, n = following or state, n + 1
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))], names=["conv_id", "turn", "part", "segment", "loss", "ordered"])

    return _sorted_turns(conversations).mapInArrow(emit, "conv_id long, turn long, part int, segment string, loss boolean, ordered boolean")


def format_digests(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from its formatted turns."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row(template))
                    now = _Digest(conv, template.start)
                now.add(role, text, template)
            yield pa.RecordBatch.from_pylist([dict(zip(_RESULT, r)) for r in out], schema=_ARROW)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(_RESULT, now.row(template)))], schema=_ARROW)

    return _sorted_turns(conversations).mapInArrow(digest, _RESULT_TYPES)
