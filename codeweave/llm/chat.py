r"""Chat formatting by columnar byte assembly, with a loss mask, and reading back.

The template marks turns with control strings: ``[INST] ... [/INST]`` (user), `` ... </s>`` after
``<s>`` (assistant), ``<<SYS>> ... <</SYS>>`` (system) and ``[ROLE name] ... [/ROLE]`` (any other role).
A control string inside a text gets a backslash after its first character, one more for each it has
there already; reading back takes one off, so every text survives byte by byte.

For each Arrow batch of turns in order, the lengths of headers, texts and footers and their cumulative
offsets are computed in numpy, and all bytes are copied by scatter indices into one preallocated
buffer, which becomes the Arrow column of formatted fragments. The loss mask is the byte range of each
assistant text.

Turns are dealt out by ranges of (conv_id, turn), so a conversation with a third of all rows spreads over
many tasks. A conversation wholly inside a task is finished there; of those cut by a task's edge, the
fragments are put together in order, streaming.

Defined cases: null texts are empty; null roles are the role ''; a null turn comes first, equal turns are
ordered by role and text; a null conv_id is one conversation; repeated rows are turns of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweave.llm.common import batch_of, begin, run_indices

_CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>|ROLE |/ROLE\])"
_UNDO = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>|</?SYS>>|ROLE |/ROLE\])")
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?) </s>|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n|\[ROLE (?P<name>(?:[^\]\\]|\\.)*)\](?P<other>.*?)\[/ROLE\]",
    re.DOTALL,
)


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, _CONTROL, r"\1\\\2\3")


def unescape(text: str) -> str:
    return _UNDO.sub(r"\1\2\3", text)


def header(role: str) -> tuple[bytes, bytes]:
    if role in MARKS:
        return tuple(m.encode() for m in MARKS[role])
    name = role.replace("\\", "\\\\").replace("]", "\\]")
    return f"[ROLE {name}]".encode(), b"[/ROLE]"


def assemble(roles: list[str], texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns in one buffer: its bytes, each turn's first byte (and the end), and first and last+1 byte of each text."""
    names = sorted(set(roles))
    code = np.fromiter(map({r: i for i, r in enumerate(names)}.__getitem__, roles), np.int64, len(roles))
    marks = [m for r in names for m in header(r)]
    mark_size = np.array([len(m) for m in marks], np.int64)
    mark_start = np.cumsum(mark_size) - mark_size
    marks_raw = np.frombuffer(b"".join(marks), np.uint8)
    escaped = escape(texts).cast(pa.large_string())
    bounds = np.frombuffer(escaped.buffers()[1], np.int64)[escaped.offset : escaped.offset + len(escaped) + 1]
    raw = np.frombuffer(escaped.buffers()[2] or b"", np.uint8)
    size = np.diff(bounds)
    head, foot = mark_size[2 * code], mark_size[2 * code + 1]
    turn = np.concatenate(([0], np.cumsum(head + size + foot)))
    text_start = turn[:-1] + head
    out = np.empty(int(turn[-1]), np.uint8)
    out[run_indices(turn[:-1], head)] = marks_raw[run_indices(mark_start[2 * code], head)]
    out[run_indices(text_start, size)] = raw[bounds[0] : bounds[-1]]
    out[run_indices(text_start + size, foot)] = marks_raw[run_indices(mark_start[2 * code + 1], foot)]
    return out, turn, text_start, text_start + size


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation or fragment."""
    turns = []
    for m in _TURN.finditer(formatted):
        role = m.lastgroup if m.lastgroup != "other" else re.sub(r"\\(.)", r"\1", m["name"], flags=re.DOTALL)
        turns.append((role, unescape(m[m.lastgroup])))
    return turns


FRAGMENT = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ]
)
FRAGMENT_DDL = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:long,length:long>>"


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted text of each conversation's turns in a batch; ``part`` orders the fragments of a conversation."""
    begin("chat")
    first = TaskContext.get().partitionId() << 40
    for number, b in enumerate(batches):
        if not b.num_rows:
            continue
        conv = b.column("conv_id")
        ids = conv.fill_null(0).to_numpy()
        null = conv.is_null().to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]))))
        ends = np.concatenate((begins[1:], [b.num_rows]))
        roles = [r or "" for r in b.column("role").to_pylist()]
        out, turn, start, end = assemble(roles, pc.fill_null(b.column("text"), ""))
        bounds = np.concatenate((turn[begins], turn[-1:])).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(bounds), pa.py_buffer(out)).cast(pa.string())
        loss = [
            [{"start": int(start[i] - turn[s]), "length": int(end[i] - start[i])} for i in range(s, e) if roles[i] == "assistant"]
            for s, e in zip(begins.tolist(), ends.tolist())
        ]
        yield batch_of(FRAGMENT, conv.take(pa.array(begins)), np.full(len(begins), first + number), ends - begins, text, loss)


def in_order(conversations: DataFrame) -> DataFrame:
    """The turns, dealt out by ranges of (conv_id, turn) and sorted."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    return turns.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted text and loss byte ranges; a conversation is its parts in order."""
    return in_order(conversations).mapInArrow(_fragments, FRAGMENT_DDL)


class Digest:
    """What is read back from a conversation's formatted fragments."""

    def __init__(self):
        self.turns = self.loss = self.chars = 0
        self.all, self.assistant = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in read_back(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        raw = formatted.encode()
        for span in loss:
            text = unescape(raw[span["start"] : span["start"] + span["length"]].decode())
            self.loss += len(text)
            self.assistant.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss, self.assistant.hexdigest(), self.chars


DIGESTS = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
DIGESTS_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_OPEN = pa.schema([*DIGESTS, ("part", pa.int64()), ("formatted", pa.string()), ("loss", FRAGMENT.field("loss").type)])
_OPEN_DDL = f"{DIGESTS_DDL}, part long, formatted string, loss array<struct<start:long,length:long>>"


def _fragment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss")))


def _digest_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversations that begin and end in this task; fragments of its first and last one."""
    rows: list[tuple] = []

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        if len(rows) > least:
            yield batch_of(_OPEN, *zip(*rows))
            rows.clear()

    current, digest, edge = None, None, True
    held: list[tuple] = []  # fragments of the conversation at hand, as long as it may be the last one

    def close(last: bool) -> None:
        if digest is None:
            return
        if edge or last:
            rows.extend((current, None, None, None, None, None, part, text, loss) for part, text, loss in held)
        else:
            rows.append((current, *digest.row(), 0, None, None))

    for conv, part, text, loss in _fragment_rows(_fragments(batches)):
        if digest is None or conv != current:
            if digest is not None:
                close(False)
                edge = False
            current, digest, held = conv, Digest(), []
        digest.add(text, loss)
        held.append((part, text, loss))
        if sum(len(h[1]) for h in held) > 32 << 20:  # a very long conversation goes out as fragments
            edge = True
            close(True)
            held = []
        yield from flush(2000)
    close(True)
    yield from flush(0)


def _digest_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and part: finished digests pass, fragments are streamed through one digest."""
    schema = pa.schema(DIGESTS)
    done: list[tuple] = []
    current, digest = None, None
    for b in batches:
        columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
        for row in zip(*columns):
            if row[1] is not None:
                done.append(row[:6])
                continue
            if digest is None or row[0] != current:
                if digest is not None:
                    done.append((current, *digest.row()))
                current, digest = row[0], Digest()
            digest.add(row[7], row[8])
        if done:
            yield batch_of(schema, *zip(*done))
            done = []
    if digest is not None:
        yield batch_of(schema, *zip((current, *digest.row())))


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation: turns, their digest, characters and digest under the loss mask, and formatted characters, read back from the output."""
    inside = in_order(conversations).mapInArrow(_digest_inside, _OPEN_DDL)
    dealt = inside.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_digest_edges, DIGESTS_DDL)
