"""Chat formatting by incremental black-box rendering.

The template is only called, never read: successive prefixes of a conversation are rendered, and what one more turn
adds to the output is that turn's span. Where the longer output doesn't begin with the shorter one the template has
rewritten history; the turn's span then begins at the first code point that changed, and the conversation is marked.
The text inside a span is found by rendering the prefix once more with a probe in place of the last text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
Reader = Callable[[str], list[Turn]]

# The marks of the template. None of them has "[" or "<" after its opening characters, so two marks
# never overlap.
CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<|role|>", "<|text|>", "<|end|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_FRAMES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
PROBE = "\ue000probe\ue001"
SEGMENT_TURNS = 64
LEARNT = "assistant"
# Rows and characters handed on at once.
BATCH_TURNS, BATCH_CHARS = 4_096, 4_000_000


def escape(text: str) -> str:
    """Double every backslash, then put one behind the first code point of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def stateless(template: Template) -> Template:
    """Declares that a template writes each turn without looking at the others, so a long conversation may be rendered in
    segments."""
    template.stateless = True
    return template


@stateless
def render(turns: list[Turn]) -> str:
    """The template of ``op9_chat_format``."""
    out = []
    for role, text in turns:
        head, tail = _FRAMES.get(role) or (f"<|role|>{escape(role)}<|text|>", "<|end|>")
        out.append(f"{head}{escape(text)}{tail}")
    return "".join(out)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of an output of ``render``, read back from its marks."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (head, tail) in _FRAMES.items():
            if formatted.startswith(head, at):
                start = at + len(head)
                break
        else:
            start, tail = formatted.index("<|text|>", at) + len("<|text|>"), "<|end|>"
            role = unescape(formatted[at + len("<|role|>"):start - len("<|text|>")])
        end = formatted.index(tail, start)
        turns.append((role, unescape(formatted[start:end])))
        at = end + len(tail)
    return turns


@dataclass
class Rendered:
    """An output, and for each turn its span and the span of its text (start, end in code points)."""

    text: str = ""
    turns: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    rewrites: list[int] = field(default_factory=list)


def _prefixes(turns: list[Turn], template: Template) -> Iterator[tuple[str, int, tuple[int, int], bool]]:
    """For each turn: the output up to it, where its span starts, the span of its text, whether history was rewritten."""
    before = ""
    for n, (role, _) in enumerate(turns, 1):
        now = template(turns[:n])
        kept = now.startswith(before)
        start = len(before) if kept else len(os.path.commonprefix([before, now]))
        probed = template([*turns[: n - 1], (role, PROBE)])
        head = probed.rfind(PROBE)
        tail = len(probed) - head - len(PROBE)
        yield now, start, (head, len(now) - tail) if head >= 0 else (start, start), not kept
        before = now


def render_incrementally(turns: list[Turn], template: Template) -> Rendered:
    """Spans of all turns of one conversation, and the numbers of the turns at which history was rewritten."""
    out = Rendered()
    for n, (now, start, text, rewrites) in enumerate(_prefixes(turns, template)):
        if rewrites:
            out.rewrites.append(n)
        out.turns.append((start, len(now)))
        out.texts.append(text)
        out.text = now
    return out


class _Conversation:
    """Renders one conversation, and gives a row per turn as soon as it can."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.chars, self.pending = conv_id, 0, 0, []

    def add(self, turn: Turn, template: Template) -> list[tuple]:
        self.pending.append(turn)
        if not getattr(template, "stateless", False) or len(self.pending) <= SEGMENT_TURNS:
            return []
        # the last turn stays as the context of the next segment
        rows = self._render(self.pending[:-1], template)
        self.pending = self.pending[-2:]
        return list(rows)

    def rest(self, template: Template) -> Iterator[tuple]:
        if self.pending[min(1, self.n_turns):]:
            yield from self._render(self.pending, template)

    def _render(self, turns: list[Turn], template: Template) -> Iterator[tuple]:
        known = min(1, self.n_turns)
        # places count from the conversation's begin
        shift = 0
        for n, (text, start, texts, rewrites) in enumerate(_prefixes(turns, template)):
            if n < known:
                shift = self.chars - len(text)
                continue
            if rewrites and getattr(template, "stateless", False):
                raise ValueError("a template declared stateless has rewritten history")
            self.chars = shift + len(text)
            role = turns[n][0]
            yield (
                self.conv_id, self.n_turns, role, text[start:], shift + start, self.chars, shift + texts[0], shift + texts[1],
                text[slice(*texts)], role == LEARNT, rewrites,
            )
            self.n_turns += 1


TURNS = (
    "conv_id long, place long, role string, formatted string, start long, end long, text_start long, text_end long, "
    "formatted_text string, loss boolean, rewrites boolean"
)
SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
    "rewritten_turns long"
)


def format_turns(conversations: DataFrame, template: Template = render) -> DataFrame:
    """One row per turn: what it adds to the formatted conversation, where, and whether it is learnt.

    ``place`` counts the turns of a conversation from 0. The span ``start, end``, the span of the text ``text_start, text_end``
    and what stands there (``formatted``, ``formatted_text``) belong to the output of the turns up to this one. That output is
    the one before it up to ``start``, then ``formatted``. ``loss`` is true for the texts of assistants. ``rewrites`` is true where
    the template changed what it had written before: the output before is then cut at ``start``, so of a turn's spans the
    last output keeps what lies before every later ``start``.

    Turns go by (turn, role, text), nulls first; a null role or text is empty, a null ``conv_id`` is a conversation of
    its own, repeated rows are repeated turns, other columns are ignored and an empty table gives no row. Rows arrive
    sorted, one turn after another, and leave in that order. With a template declared ``stateless`` a task holds
    ``SEGMENT_TURNS`` turns at most: a longer conversation is rendered in segments, each begun with the last turn of the segment
    before. Any other template sees every prefix of the whole conversation, which a task then holds, with work that grows
    with its square.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        now = None
        for batch in batches:
            for conv_id, role, text in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                key = None if pd.isna(conv_id) else int(conv_id)
                if now is None or now.conv_id != key:
                    if now is not None:
                        yield from now.rest(template)
                    now = _Conversation(key)
                yield from now.add((role, text), template)
        if now is not None:
            yield from now.rest(template)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, chars = [], 0
        for row in rows(batches):
            done.append(row)
            chars += len(row[3])
            if len(done) >= BATCH_TURNS or chars >= BATCH_CHARS:
                yield _frame(done, TURNS)
                done, chars = [], 0
        yield _frame(done, TURNS)

    return (
        turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInPandas(run, TURNS)
    )


class _Digest:
    """What is read back from one conversation's output, turn by turn if the template is stateless, else at its end."""

    def __init__(self, conv_id):
        self.conv_id, self.n_turns, self.loss_chars, self.chars, self.rewrites = conv_id, 0, 0, 0, 0
        self.turns, self.loss, self.unread = hashlib.sha256(), hashlib.sha256(), ""

    def add(self, turn, reader: Reader, read_text: Callable[[str], str], at_once: bool) -> None:
        self.chars, self.rewrites = int(turn.end), self.rewrites + bool(turn.rewrites)
        if turn.loss:
            learnt = read_text(turn.formatted_text)
            self.loss.update(learnt.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(learnt)
        if at_once:
            self._read(turn.formatted, reader)
        else:
            self.unread = self.unread[:turn.start] + turn.formatted

    def _read(self, formatted: str, reader: Reader) -> None:
        for role, text in reader(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1

    def row(self, reader: Reader) -> tuple:
        self._read(self.unread, reader)
        return (
            self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewrites,
        )


def format_conversations(
    conversations: DataFrame, template: Template = render, reader: Reader = read_turns,
    read_text: Callable[[str], str] = unescape,
) -> DataFrame:
    """One row per conversation with digests of what is read back from the rows of ``format_turns``.

    ``reader`` gives the turns of an output of the template, ``read_text`` the text of one formatted text; both belong to the
    template and are to be passed with it. Turns and characters are those of the last output, the learnt texts those that
    each turn's own output held, and ``rewritten_turns`` counts the turns at which history was rewritten.
    """
    at_once = getattr(template, "stateless", False)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            done = []
            for turn in batch.itertuples(index=False):
                key = None if pd.isna(turn.conv_id) else int(turn.conv_id)
                if now is None or now.conv_id != key:
                    if now is not None:
                        done.append(now.row(reader))
                    now = _Digest(key)
                now.add(turn, reader, read_text, at_once)
            yield _frame(done, SCHEMA)
        if now is not None:
            yield _frame([now.row(reader)], SCHEMA)

    # the turns of a conversation come from one task, in order
    return format_turns(conversations, template).mapInPandas(rows, SCHEMA)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})
