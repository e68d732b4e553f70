"""Chat formatting with a grammar round trip.

A formatted conversation is ``BEGIN`` and the pieces of its turns in order, nothing between. One
deterministic parser, ``parse_at``, reads turns from the joined text. ``format_turns`` renders
every turn with the template below and reparses it between two other turns; while what the parser
gives isn't those turns, it escapes what conflicts and parses again.

    user       [INST] text [/INST]
    assistant  <space>text</s>
    system     [SYS] text [/SYS]
    other      [ROLE name] text [/ROLE]

Grammar of a text inside a piece: a backslash stands for the character after it, and no
control string stands unescaped, nor one that begins in the text and ends in the template.
Escaping doubles backslashes and puts one before each control string, so it is reversible
whatever the text holds. Turns of any length are parsed in one pass; nothing is cut.

Defined results: null text and null role are empty; text that isn't UTF-8 is read
with U+FFFD for its bad bytes, which offsets count; rows with equal turn numbers are put in
order of role, then text; repeated rows are turns of their own; a null conv_id is a
conversation of its own; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN = "<s>"
CONTROL = ["[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE ", "[/ROLE]", "<s>", "</s>"]
_TOKEN = re.compile(r"\\(.)|(" + "|".join(re.escape(c) for c in CONTROL) + ")", re.S)
_ROLE = re.compile(r"\[ROLE ((?:\\.|[^\\\]])*)\] ", re.S)
_ENDS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>"), "system": ("[SYS] ", " [/SYS]")}
_BEFORE, _AFTER = "".join(_ENDS["user"]), "".join(_ENDS["assistant"])  # empty turns

PIECES = "conv_id long, turn long, role string, piece string, loss_from long, loss_to long"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def doubled(text: str) -> str:
    return text.replace("\\", "\\\\")


def shielded(text: str, tail: str) -> str:
    """The text with a backslash before each control string that begins in it, also one that only
    the tail completes."""
    mark = lambda m: "\\" + m[0] if m[2] and m.start() < len(text) else m[0]
    return _TOKEN.sub(mark, text + tail)[: -len(tail)]


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _ends(role: str) -> tuple[str, str]:
    """What stands before and after a text of this role."""
    return _ENDS.get(role) or (f"[ROLE {doubled(role).replace(']', chr(92) + ']')}] ", " [/ROLE]")


def parse_at(text: str, at: int = 0) -> tuple[str, str, int] | None:
    """Role and text of the turn whose piece begins at ``at``, and where the piece ends; None where
    no whole piece of the grammar begins there."""
    for role, (head, tail) in _ENDS.items():
        if text.startswith(head, at):
            break
    else:
        if not (m := _ROLE.match(text, at)):
            return None
        role, head, tail = unescape(m[1]), m[0], " [/ROLE]"
    at += len(head)
    out = []
    for m in _TOKEN.finditer(text, at):
        if m[1] is not None:
            out += [text[at : m.start()], m[1]]
            at = m.end()
            continue
        stop = m.end() - len(tail)
        if stop < at or not text.startswith(tail, stop):
            return None
        return role, "".join(out) + text[at:stop], m.end()
    return None


def parse_piece(piece: str) -> tuple[str, str] | None:
    """The turn that a piece stands for; None where the piece isn't one of the grammar, whole."""
    got = parse_at(piece)
    return got[:2] if got and got[2] == len(piece) else None


class Conversation:
    """Reads turns back from the characters of a formatted conversation, which may come in parts cut
    anywhere: turns begin and end where the grammar says. It holds one unfinished turn at most."""

    def __init__(self) -> None:
        self.rest, self.begun = "", False

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        text, at = self.rest + part, 0
        if not self.begun and len(text) >= len(BEGIN):
            if not text.startswith(BEGIN):
                raise ValueError("a conversation begins with " + BEGIN)
            self.begun, at = True, len(BEGIN)
        while self.begun and (got := parse_at(text, at)):
            yield got[:2]
            at = got[2]
        self.rest = text[at:]

    def close(self) -> None:
        if self.rest or not self.begun:
            raise ValueError(f"the conversation ends inside a turn: {self.rest[:80]!r}")


def round_trip(role: str, text: str) -> tuple[str, int, int]:
    """The piece of a turn and the range in it that the text takes.

    It is reparsed behind and before other turns, joined; as long as the parser doesn't give the
    three turns back, what conflicts is escaped: backslashes, then control strings.
    """
    head, tail = _ends(role)
    body = text
    for escaped in (lambda t: t, doubled, lambda t: shielded(t, tail)):
        body = escaped(body)
        piece = head + body + tail
        joined = Conversation()
        if [*joined.feed(BEGIN + _BEFORE + piece + _AFTER)] == [("user", ""), (role, text), ("assistant", "")]:
            joined.close()
            return piece, len(head), len(head) + len(body)
    raise ValueError(f"no form of this turn survives the round trip: {role!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: its piece of the formatted conversation, and where in the piece the
    loss mask is set (an assistant's text; an empty range for other roles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [round_trip(r or "", t or "") for r, t in zip(b.column("role").to_pylist(), b.column("text").to_pylist())]
            role = [r or "" for r in b.column("role").to_pylist()]
            loss = [(lo, hi) if r == "assistant" else (0, 0) for r, (_, lo, hi) in zip(role, rows)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array(role, pa.string()), pa.array([x[0] for x in rows], pa.string()), pa.array([x[0] for x in loss], pa.int64()), pa.array([x[1] for x in loss], pa.int64())],
                names=["conv_id", "turn", "role", "piece", "loss_from", "loss_to"],
            )

    cols = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.make_valid_utf8(F.col(c).cast("string")).alias(c) for c in ("role", "text")])
    return cols.mapInArrow(run, PIECES)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted text alone.

    Pieces come sorted by conversation and turn and are read as one text: where a turn begins and
    ends is up to the parser, not to the rows. Turns go through running hashes, so a conversation of
    any length needs no more memory than a batch and a turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id: object = run  # no conversation yet
        state: list = []
        reader = Conversation()

        def close() -> tuple:
            reader.close()
            n, turns, chars, loss, size = state
            return (open_id, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for b in batches:
            done = []
            for conv, piece, lo, hi in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to"))):
                if open_id is run or conv != open_id:
                    if open_id is not run:
                        done.append(close())
                    open_id, state, reader, part = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], Conversation(), BEGIN + piece
                else:
                    part = piece
                for role, text in reader.feed(part):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if hi > lo:
                    masked = unescape(piece[lo:hi])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
                state[4] += len(part)
            yield _digests(done)
        if open_id is not run:
            yield _digests([close()])

    names = ["conv_id", "turn", "role", "piece"]
    return pieces.repartition("conv_id").sortWithinPartitions(*names).select("conv_id", "piece", "loss_from", "loss_to").mapInArrow(run, READ_BACK)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in READ_BACK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
