"""Chat formatting by a finite-state machine over roles.

A declarative template gives, for each role, the marks before and after its text, whether the text
(with its closing mark left out) bears loss, and which roles may come next. Rows are grouped by
conversation and ordered by turn in Spark's shuffle and sort; a task then walks its rows in order
with the state of one turn only, so a conversation of any length takes constant memory. Each turn
makes segments: text and a loss flag. Control strings inside texts are broken by the escape
character after their first character, which is itself doubled, so formatting can be read back.

Null text and null role are empty strings; an unknown role is written into a generic mark; rows
with equal turn are ordered by role and text, null turns come first; a null conversation id is a
conversation of its own. Turns in an order that the machine does not know are formatted all the
same and the conversation is marked invalid.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """roles: name -> (opening mark, closing mark, loss on the text). follows: state -> roles that
    may come next; "" is the start, and a conversation may end after any role in `ends`."""

    roles: dict = field(default_factory=lambda: {
        "system": ("<s>[SYS]", "[/SYS]", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("[BOT]", "</s>", True),
    })
    other: tuple = ("[ROLE]", "[/NAME]", "[/ROLE]", False)
    follows: dict = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    ends: tuple = ("user", "assistant", "system")
    escape: str = "\\"

    def marks(self) -> list[str]:
        found = [m for a, b, _ in self.roles.values() for m in (a, b)] + list(self.other[:3])
        split = {s for m in found for s in re.findall(r"<[^<>]*>|\[[^\[\]]*\]", m)}
        return sorted(split, key=lambda m: (-len(m), m))

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, [self.escape, *self.marks()])))

    def quote(self, text: str, pattern: re.Pattern) -> str:
        e = self.escape
        return pattern.sub(lambda m: e + e if m[0] == e else m[0][0] + e + m[0][1:], text)

    def unquote(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + r"(.)", r"\1", text, flags=re.S) if self.escape in text else text


CHAT = Template()


def segments_of(turns: Iterable[tuple[str, str]], template: Template = CHAT) -> Iterator[tuple[str, bool]]:
    """(text, loss) for each segment of the turns (role, text)."""
    pattern = template.pattern()
    for role, text in turns:
        quoted = template.quote(text, pattern)
        if role in template.roles:
            before, after, loss = template.roles[role]
        else:
            a, b, after, loss = template.other
            before = a + template.quote(role, pattern) + b
        yield before, False
        if quoted:
            yield quoted, loss
        yield after, False


def follows(before: str, role: str, template: Template = CHAT) -> bool:
    return role in template.follows.get(before, ())


class Reader:
    """Reads formatted text back, fed in pieces that may be cut anywhere."""

    def __init__(self, template: Template = CHAT):
        self.t = template
        self.opens = {a: (r, b) for r, (a, b, _) in template.roles.items()}
        a, b, c, _ = template.other
        closes = {b for _, b in self.opens.values()} | {b, c}
        self.mark = re.compile("|".join(re.escape(m) for m in sorted({*self.opens, a, *closes}, key=len, reverse=True)))
        self.hold = max(len(m) for m in {*self.opens, a, *closes}) - 1
        self.rest, self.role, self.close, self.text = "", None, None, []

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """Turns (role, text) that end in what has been fed so far."""
        data, at = self.rest + piece, 0
        for m in self.mark.finditer(data):
            if self.role is None:
                if m[0] == self.t.other[0]:
                    self.role, self.close = "", self.t.other[1]
                else:
                    self.role, self.close = self.opens[m[0]]
            elif m[0] == self.close:
                self.text.append(data[at : m.start()])
                text = self.t.unquote("".join(self.text))
                self.text = []
                if self.close == self.t.other[1]:
                    self.role, self.close = text, self.t.other[2]
                else:
                    yield self.role, text
                    self.role = self.close = None
            else:
                raise ValueError(f"{m[0]} inside a turn of {self.role}")
            at = m.end()
        keep = len(data) if last else max(at, len(data) - self.hold)
        if self.role is not None:
            self.text.append(data[at:keep])
            self.rest = data[keep:]
        else:
            self.rest = data[at:]


FORMATTED = "conv_id long, n int, segment int, text string, loss boolean, valid boolean, first boolean, last boolean"


def _in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _turns(batches):
    for batch in batches:
        yield from zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True)


def format_conversations(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """One row per segment, in order within a task: conv_id, n (turn's place), segment (its place in
    the turn), text, loss, valid (the order of turns so far is one the machine accepts), and whether
    the segment is the first or last of its conversation."""

    def make(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int32()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_()), ("first", pa.bool_()), ("last", pa.bool_())])
        rows, room, now, before, n, ok = [], 0, object(), "", 0, True
        pending = None  # a turn is written once it is known whether another follows

        def write(turn, last):
            conv, k, role, text, valid = turn
            made = list(segments_of([(role, text)], template))
            return [(conv, k, i, s, loss, valid, k == 0 and i == 0, last and i == len(made) - 1) for i, (s, loss) in enumerate(made)]

        for conv, role, text in _turns(batches):
            if pending is None or conv != now:
                if pending is not None:
                    rows += write(pending, True)
                now, before, n, ok = conv, "", 0, True
            else:
                rows += write(pending, False)
            ok = ok and follows(before, role, template)
            pending, before, n = (conv, n, role, text, ok), role, n + 1
            room += len(text)
            if len(rows) >= 4096 or room > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)
                rows, room = [], 0
        if pending is not None:
            rows += write(pending, True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _in_order(conversations).mapInArrow(make, FORMATTED)


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Parses what format_conversations wrote, from its text and loss flags alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars, valid."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"

    def read(batches):
        out, reader = [], None
        for batch in batches:
            for conv, text, loss, valid, first, last in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "loss", "valid", "first", "last")), strict=True):
                if first:
                    reader, turns, masked, n, chars, size = Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                size += len(text)
                if loss:
                    plain = template.unquote(text)
                    chars += len(plain)
                    masked.update(plain.encode())
                for role, said in reader.feed(text, last):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                if last:
                    out.append((conv, n, turns.hexdigest(), chars, masked.hexdigest(), size, valid))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])
                out = []

    return formatted.mapInArrow(read, schema)
