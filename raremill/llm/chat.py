"""Chat formatting on token level (operator 10).

Each turn's role and text are escaped and encoded on their own, before the shuffle and in
parallel; reserved ids above the vocabulary mark the turns, so no text can imitate them. Loss
masks are prefix sums of +1 where an assistant text begins and -1 where it ends.

Escaping: a backslash is doubled, and one is put after the first character of each control
string, so the rendered form cannot be mistaken either; ``unescape`` gives the text back.

Turns are ordered by (turn, role, text). Null texts and roles are empty, null turns come
first, null conversations form one conversation. Extra columns are ignored. A conversation
longer than ``part_ids`` ids continues in further rows, so a task holds one part at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raremill.llm.bpe import Encoder, default_vocabulary, load
from raremill.llm.tasks import int_lists, map_rows

MARKS = ["<s>", "<|turn|>", "<|text|>", "<|end|>", "</s>"]
#: Control strings of common templates, escaped as well.
CONTROLS = [*MARKS, "[INST]", "[/INST]", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
_BOS, _TURN, _TEXT, _END, _EOS = range(len(MARKS))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

PART_SCHEMA = "conv_id long, part int, ids array<int>, loss array<tinyint>"
DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _encoded(turns: DataFrame, vocabulary: str | None, loss_role: str) -> DataFrame:
    def make():
        encoder = Encoder(vocabulary, special_as_text=True)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [*(batch.column(k) for k in range(4))]
            for k in (2, 3):
                flat, counts = encoder.encode([escape(t or "") for t in batch.column(k).to_pylist()])
                out.append(int_lists(flat, counts))
            out.append(pa.array([r == loss_role for r in batch.column(2).to_pylist()]))
            return pa.RecordBatch.from_arrays(
                out, ["conv_id", "turn", "role", "text", "role_ids", "text_ids", "learn"]
            )

        return step

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = (
        "conv_id long, turn long, role string, text string, "
        "role_ids array<int>, text_ids array<int>, learn boolean"
    )
    return map_rows(rows, make, schema)


def format_chats(
    turns: DataFrame,
    vocabulary: str | None = None,
    loss_role: str = "assistant",
    part_ids: int = 1 << 20,
) -> DataFrame:
    """Rows (conv_id, part, ids, loss) with the spliced ids and their loss mask."""
    path = vocabulary or default_vocabulary()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = load(path).get_vocab_size()
        conv, part, held, size, begun = None, 0, [], 0, False

        def flush() -> pa.RecordBatch:
            nonlocal held, size, part
            pieces = [ids for ids, _ in held]
            lengths = np.array([len(p) for p in pieces])
            step = np.zeros(lengths.sum() + 1, np.int8)
            ends = np.cumsum(lengths)
            learn = np.array([b for _, b in held], bool) & (lengths > 0)
            np.add.at(step, (ends - lengths)[learn], 1)
            np.add.at(step, ends[learn], -1)
            mask = np.cumsum(step[:-1], dtype=np.int8)
            flat = np.concatenate(pieces).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([conv], pa.int64()), pa.array([part], pa.int32()),
                    int_lists(flat, [len(flat)]), int_lists(mask, [len(mask)], pa.int8()),
                ],
                ["conv_id", "part", "ids", "loss"],
            )
            held, size, part = [], 0, part + 1
            return out

        def mark(which: int) -> tuple[list[int], bool]:
            return [base + which], False

        for batch in batches:
            ids, roles, texts, learns = (batch.column(k) for k in (0, 2, 3, 4))
            for k in range(batch.num_rows):
                if not begun or ids[k].as_py() != conv:
                    if begun:
                        held.append(mark(_EOS))
                        yield flush()
                    conv, part, begun = ids[k].as_py(), 0, True
                    held.append(mark(_BOS))
                text = texts[k].values.to_numpy()
                held += [
                    mark(_TURN), (roles[k].values.to_numpy(), False),
                    mark(_TEXT), (text, learns[k].as_py()), mark(_END),
                ]
                size += len(text)
                if size >= part_ids:
                    yield flush()
        if begun:
            held.append(mark(_EOS))
            yield flush()

    ordered = (
        _encoded(turns, path, loss_role)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "turn", "role_ids", "text_ids", "learn")
    )
    return ordered.mapInArrow(assemble, PART_SCHEMA)


def read_chats(parts: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Digests of stored chats: turns and loss text as decoded and unescaped from the ids."""
    path = vocabulary or default_vocabulary()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path, special_as_text=True)
        base = tokenizer.get_vocab_size()
        conv, state = None, None

        def result() -> pa.RecordBatch:
            turns, loss, n, chars, formatted = state
            row = [[conv], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [formatted]]
            return pa.RecordBatch.from_pydict(
                dict(zip(DIGEST_NAMES, row, strict=True)), schema=DIGEST_ARROW
            )

        for batch in batches:
            for k in range(batch.num_rows):
                if state is None or batch.column(0)[k].as_py() != conv:
                    if state is not None:
                        yield result()
                    conv, state = batch.column(0)[k].as_py(), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                ids, loss = (batch.column(c)[k].values.to_numpy() for c in (2, 3))
                at = np.flatnonzero(ids >= base)
                for a, b in zip(at, [*at[1:], len(ids)], strict=True):
                    which = int(ids[a]) - base
                    state[4] += len(MARKS[which])
                    if which not in (_TURN, _TEXT):
                        continue
                    body = tokenizer.decode(ids[a + 1 : b].tolist(), skip_special_tokens=False)
                    state[4] += len(body)
                    plain = unescape(body)
                    state[0].update(f"{plain}\n".encode())
                    if which == _TEXT:
                        state[2] += 1
                    if b > a + 1 and loss[a + 1]:
                        state[1].update(plain.encode())
                        state[3] += len(plain)
        if state is not None:
            yield result()

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(digest, DIGEST_SCHEMA)


DIGEST_NAMES = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
DIGEST_ARROW = pa.schema(
    [(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in DIGEST_SCHEMA.split(", ")]
)
