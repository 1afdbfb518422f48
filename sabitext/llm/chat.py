"""Chat formatting: conversations as token ids with a loss mask.

A conversation becomes BEGIN, then for each turn START role SEP content END.
Segments (role names, contents) are encoded separately, so no token crosses a
border; the marks are reserved ids above the vocabulary, spliced in between, and
no text can encode to them. Control strings in a content are escaped with a
backslash all the same, <|end|> as <\\|end|>, and one already escaped gets one
backslash more, so unescaped() gives the content back exactly.

The loss mask is 1 on the content and END of assistant turns: +1 where such a
stretch begins, -1 behind its end, and a running sum. The same sums of segment
lengths place every segment.

Contents are encoded where they are read; only packed ids are shuffled, by
conversation. Turns are ordered by turn, then role, then ids (ties); NULL turns
come last.

Rules. Rows with NULL conv_id belong to no conversation and are left out. NULL
and empty texts are turns without content. Known roles (any case) have ids of
their own; other roles are encoded as text, NULL and empty ones as nothing; only
assistant is trained on. Repeated rows are kept as turns. Texts of any length
are encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import TOKENIZER, encoder, free_id, ids_of

ROLES = ("system", "user", "assistant", "tool")
#: Reserved ids, counted from the first free one.
BEGIN, START, SEP, END = range(4)
_ROLE0 = 4
TRAINED = "assistant"
_CONTROL = re.compile(r"<(\\*)\|(begin|start|sep|end|" + "|".join(ROLES) + r"|im_start|im_end|endoftext)\|>", re.I)
_ESCAPED = re.compile(_CONTROL.pattern.replace(r"(\\*)", r"\\(\\*)"), re.I)


def escaped(text: str) -> str:
    """One backslash more in each control string."""
    return _CONTROL.sub(r"<\\\1|\2|>", text) if "|>" in text else text


def unescaped(text: str) -> str:
    """What escaped() was given."""
    return _ESCAPED.sub(r"<\1|\2|>", text)


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    base = free_id(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names: dict[str | None, np.ndarray] = {}
        for batch in batches:
            for a, b in C.slices(batch.column("text"), 4 * C.SLICE_BYTES):
                part = batch.slice(a, b - a)
                roles = part.column("role").to_pylist()
                for r in set(roles) - names.keys():
                    known = (r or "").lower()
                    names[r] = np.array([base + _ROLE0 + ROLES.index(known)] if known in ROLES else ids_of(enc, escaped(r or "")), np.uint32)
                body = [np.array(ids_of(enc, escaped(t)) if t else [], np.uint32) for t in part.column("text").to_pylist()]
                yield pa.record_batch([part.column("conv_id"), part.column("turn"), pa.array([(r or "").lower() for r in roles]), pa.array([names[r].tobytes() for r in roles], pa.binary()), pa.array([x.tobytes() for x in body], pa.binary())], ["conv_id", "turn", "role", "role_ids", "ids"])
                if len(names) > 10_000:
                    names.clear()

    return run


def assembled(roles: list[tuple[bool, np.ndarray]], contents: list[np.ndarray], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and loss mask of one conversation. roles: whether a turn is trained on, and its role's ids."""
    n_role = np.array([len(r) for _, r in roles], np.int64)
    n_body = np.array([len(c) for c in contents], np.int64)
    size = n_role + n_body + 3
    begin = 1 + np.cumsum(size) - size  # of each turn: START
    body = begin + n_role + 2
    end = body + n_body  # END
    ids = np.empty(1 + int(size.sum()), np.int32)
    ids[0], ids[begin], ids[body - 1], ids[end] = base + BEGIN, base + START, base + SEP, base + END
    step = np.zeros(len(ids) + 1, np.int32)
    for k, ((trained, role), content) in enumerate(zip(roles, contents)):
        ids[begin[k] + 1 : body[k] - 1] = role
        ids[body[k] : end[k]] = content
        if trained:
            step[body[k]] += 1
            step[end[k] + 1] -= 1
    return ids, np.cumsum(step[:-1]).astype(np.int8)


def _assemble(base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in C.Runs("conv_id", 500).of(batches):
            conv = table.column("conv_id").to_numpy()
            starts = C.row_starts(conv)
            role_body, role_at = C.flat(table.column("role_ids"))
            text_body, text_at = C.flat(table.column("ids"))
            trained = [r == TRAINED for r in table.column("role").to_pylist()]
            out = []
            for a, b in zip(starts, np.r_[starts[1:], len(conv)]):
                roles = [(trained[k], role_body[role_at[k] : role_at[k + 1]].view(np.uint32)) for k in range(a, b)]
                out.append(assembled(roles, [text_body[text_at[k] : text_at[k + 1]].view(np.uint32) for k in range(a, b)], base))
            at = pa.array(np.r_[0, np.cumsum([len(i) for i, _ in out])].astype(np.int32))
            ids, mask = (np.concatenate(x) for x in zip(*out))
            yield pa.record_batch(
                [
                    pa.array(conv[starts]),
                    pa.array(np.diff(np.r_[starts, len(conv)]).astype(np.int32)),
                    pa.array([len(i) for i, _ in out], pa.int32()),
                    pa.array([int(m.sum()) for _, m in out], pa.int32()),
                    pa.ListArray.from_arrays(at, pa.array(ids)),
                    pa.ListArray.from_arrays(at, pa.array(mask)),
                ],
                ["conv_id", "n_turns", "n_tokens", "n_targets", "input_ids", "loss_mask"],
            )

    return run


def formatted(conversations: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_targets, input_ids, loss_mask) of each conversation."""
    c = conversations
    rows = c.where(c["conv_id"].isNotNull()).select(c["conv_id"].cast("bigint").alias("conv_id"), c["turn"].cast("bigint").alias("turn"), c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"))
    encoded = rows.mapInArrow(_encode(path), "conv_id bigint, turn bigint, role string, role_ids binary, ids binary")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "ids")
    return ordered.select("conv_id", "role", "role_ids", "ids").mapInArrow(_assemble(free_id(path)), "conv_id bigint, n_turns int, n_tokens int, n_targets int, input_ids array<int>, loss_mask array<tinyint>")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
