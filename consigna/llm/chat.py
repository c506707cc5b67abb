"""Chat formatting by token-level assembly.

Role and text of a turn are encoded by themselves and joined by reserved ids, so no token spans a
border and the loss mask follows from the lengths alone. Control strings inside a text are escaped,
so the decoded output can be read without doubt too.

A turn becomes  START role MIDDLE text END.  Reserved ids follow the vocabulary's own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from consigna.llm.common import spread, staged
from consigna.llm.lengths import encoder

#: Control strings and their places after the last id of the vocabulary.
CONTROL = ["<|im_start|>", "<|im_sep|>", "<|im_end|>"]
START, MIDDLE, END = range(3)
BLOCK_TURNS = 256

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""'<|' becomes '<\|', '<\|' becomes '<\\|' and so on: no '<|' is left, and unescape undoes it."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def encode_turns(turns: DataFrame, ranks: bytes, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, ids, loss_from, loss_to (positions inside ids), order_key of each row.

    Null roles and texts are empty. Each row is encoded in full by itself, so a long conversation is
    spread over all tasks. order_key settles the order of rows with the same conversation and turn.
    """
    turns = spread(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"))
    vocab = turns.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        first = enc.n_vocab
        for b in batches:
            ids, lo, hi, key = [], [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                role, text = role or "", text or ""
                head = [first + START, *enc.encode_ordinary(escape(role)), first + MIDDLE]
                body = enc.encode_ordinary(escape(text))
                ids.append([*head, *body, first + END])
                lo.append(len(head))
                hi.append(len(head) + (len(body) if role == loss_role else 0))
                key.append(hashlib.sha256(f"{role}\n{text}".encode()).digest()[:16])
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array(ids, pa.list_(pa.int32())), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(key, pa.binary())],
                ["conv_id", "turn", "ids", "loss_from", "loss_to", "order_key"])

    return turns.mapInArrow(encode, "conv_id long, turn long, ids array<int>, loss_from int, loss_to int, order_key binary")


def format_conversations(turns: DataFrame, ranks: bytes, loss_role: str = "assistant") -> DataFrame:
    """The token stream of each conversation in pieces, one for each row of turns.

    conv_id, turn, order_key, ids, start (tokens of the conversation before this piece), loss_from and
    loss_to (the part of ids under the loss mask). Order: turn (null first), then order_key; equal rows
    all stay. Null ids are one conversation. Prefix sums run inside blocks of BLOCK_TURNS turn numbers
    and over one row per block, so a conversation may hold any share of the rows.
    """
    pieces = staged(encode_turns(turns, ranks, loss_role), "chat-pieces")  # texts are encoded once
    pieces = pieces.withColumns({"n": F.size("ids").cast("long"), "block": F.floor(F.col("turn") / BLOCK_TURNS)})
    before = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "order_key").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("conv_id", "block").agg(F.sum("n").alias("m"))
    ahead = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("ahead"))
    return (
        pieces.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block")))
        .select("conv_id", "turn", "order_key", "ids", (F.col("ahead") + F.col("inside")).alias("start"), "loss_from", "loss_to")
    )


def read_back(pieces: DataFrame, ranks: bytes) -> DataFrame:
    """conv_id, start, role, text, loss_text, formatted_chars, decoded from the ids of each piece."""
    vocab = pieces.sparkSession.sparkContext.broadcast(ranks)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab.value)
        first = enc.n_vocab
        plain = lambda ids: enc.decode_bytes(ids).decode()
        for b in batches:
            role, text, loss, chars = [], [], [], []
            for ids, lo, hi in zip(b.column("ids").to_pylist(), b.column("loss_from").to_pylist(), b.column("loss_to").to_pylist(), strict=True):
                mid = ids.index(first + MIDDLE)
                if ids[0] != first + START or ids[-1] != first + END:
                    raise ValueError("a piece is not one whole turn")
                head, body = plain(ids[1:mid]), plain(ids[mid + 1:-1])
                role.append(unescape(head))
                text.append(unescape(body))
                loss.append(unescape(plain(ids[lo:hi])))
                chars.append(len(head) + len(body) + sum(map(len, CONTROL)))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("start"), pa.array(role), pa.array(text), pa.array(loss), pa.array(chars, pa.int64())],
                ["conv_id", "start", "role", "text", "loss_text", "formatted_chars"])

    return pieces.select("conv_id", "start", "ids", "loss_from", "loss_to").mapInArrow(
        decode, "conv_id long, start long, role string, text string, loss_text string, formatted_chars long")


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of read-back turns: counts and hashes.

    Turns are sorted by conversation and start; the hashes are fed as rows stream by, so a task keeps
    no more than one batch of them whatever the length of a conversation.
    """
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "start")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        open_, at = False, None
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss_text", "formatted_chars")]
            for conv, role, text, loss, chars in zip(*cols, strict=True):
                if not open_ or conv != at:
                    if open_:
                        out.append((at, n, whole.hexdigest(), m, masked.hexdigest(), k))
                    open_, at, n, m, k = True, conv, 0, 0, 0
                    whole, masked = hashlib.sha256(), hashlib.sha256()
                n, m, k = n + 1, m + len(loss), k + chars
                whole.update(f"{role}\n{text}\n".encode())
                masked.update(loss.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if open_:
            last = (at, n, whole.hexdigest(), m, masked.hexdigest(), k)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types, strict=True)], names)

    return turns.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
