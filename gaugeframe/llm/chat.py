"""Chat formatting with offset-aligned loss masks.

A conversation is ``<s>`` and then, for each turn, ``[INST]role[/INST]text</s>``. Control strings inside roles and texts get
a backslash after their first character (one more if they have some), which reading takes away again. Control strings are
single tokens that never join their neighbours, so a long conversation gives the same ids whether it is encoded at once
or, as here, in runs of whole turns of about ``segment_chars`` characters: a conversation of any length passes through in
bounded memory. The loss mask marks the tokens whose offsets fall into an assistant's text, found by binary search of
the sorted turn spans in the sorted token offsets.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

BEGIN, END, HEAD, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = re.compile(r"(<|\[)(\\*)(s>|/s>|INST\]|/INST\]|\|endoftext\|>)")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(s>|/s>|INST\]|/INST\]|\|endoftext\|>)")
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def escape(text: str | None) -> str:
    return _CONTROL.sub(r"\1\2\\\3", text or "")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str | None, str | None]], first: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns and the spans of the assistant texts in it."""
    parts, spans, at = [BEGIN if first else ""], [], len(BEGIN) if first else 0
    for role, text in turns:
        head, body = f"{HEAD}{escape(role)}{TEXT}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


class Encoder:
    """A byte-level BPE tokenizer that knows the control strings and reports offsets of all characters."""

    def __init__(self, spec: str):
        from tokenizers import AddedToken, Tokenizer, processors

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.tokenizer.add_special_tokens([AddedToken(t, normalized=False, special=True) for t in (BEGIN, END, HEAD, TEXT)])

    def masked(self, texts: list[str], spans: list[list[tuple[int, int]]]):
        """Per text: ids, token starts, token ends and the mask, as arrays."""
        for code, own in zip(self.tokenizer.encode_batch(texts, add_special_tokens=False), spans):
            offsets = np.array(code.offsets, np.int64).reshape(-1, 2)
            start, end = offsets[:, 0], offsets[:, 1]
            mask = np.zeros(len(start), bool)
            if own:
                turn = np.array(own, np.int64)
                first = np.searchsorted(end, turn[:, 0], "right")  # first token that ends after the text's start
                last = np.searchsorted(start, turn[:, 1], "left")  # first that starts at or after its end
                for a, b in zip(first, last):
                    mask[a:b] = True
            yield np.array(code.ids, np.int32), start, end, mask


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    if hash(spec) not in _encoders:
        _encoders.clear()
        _encoders[hash(spec)] = Encoder(spec)
    return _encoders[hash(spec)]


FORMATTED = "segment int, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"


def _runs(batches, names):
    """Rows of a sorted partition as ``(key, first, [(role, text)])``, cut after ``names`` characters of a conversation."""
    key, held, size, number = None, [], 0, 0
    begun = False
    for batch in batches:
        for k, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and k != key:
                yield key, number, held
                held, size, number = [], 0, 0
            elif size >= names:
                yield key, number, held
                held, size, number = [], 0, number + 1
            key, begun = k, True
            held.append((role, text))
            size += len(role or "") + len(text or "")
    if begun:
        yield key, number, held


def format_conversations(turns: DataFrame, tokenizer_path: str, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", segment_chars: int = 200_000) -> DataFrame:
    """``(key, segment, formatted, ids, starts, ends, mask)``: a row per run of turns, nearly always one per conversation.

    Turns are ordered by ``turn``, then role and text; null turn numbers come first, equal ones are all kept, repeated rows
    too. Null roles and texts are empty. Rows with a null key are one conversation. ``starts`` and ``ends`` are characters
    of the row's ``formatted``, ``mask`` marks the tokens of assistant texts. Other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = turns.sparkSession.sparkContext.broadcast(file.read())
    rows = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"),
                        F.col(text).cast("string").alias("text"))
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")
    kind = pa.from_numpy_dtype
    names = pa.schema([("segment", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())),
                       ("ends", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])

    def work(batches):
        encode = encoder(spec.value).masked
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        key_kind = head.schema.field(0).type
        runs = _runs(itertools.chain([head], batches), segment_chars)
        while part := list(itertools.islice(runs, 64)):
            made = [render(held, number == 0) for _, number, held in part]
            coded = list(encode([m[0] for m in made], [m[1] for m in made]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, *_ in part], key_kind), pa.array([n for _, n, _ in part], pa.int32()), pa.array([m[0] for m in made]),
                 *[pa.array([c[x].astype(t) for c in coded], pa.list_(kind(t))) for x, t in ((0, np.int32), (1, np.int32), (2, np.int32))],
                 pa.array([c[3] for c in coded], pa.list_(pa.bool_()))], names=["key", *names.names])

    shape = f"key {turns.schema[key].dataType.simpleString()}, {FORMATTED}"
    return rows.mapInArrow(work, shape).withColumnRenamed("key", key)


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """The characters under the mask, run by run of marked tokens, unescaped."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return "".join(unescape(formatted[starts[a]: ends[b - 1]]) for a, b in zip(edge[::2], edge[1::2]))


def digest(formatted: DataFrame, key: str = "conv_id", in_order: bool = False) -> DataFrame:
    """``(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` per conversation, read back from the output.

    Segments of a conversation follow each other in one sorted partition and are folded one by one. ``in_order`` says that
    they do already, as in the plan of ``format_conversations`` itself; rows read from a table are dealt and sorted first.
    """
    rows = formatted.select(F.col(key).alias("key"), "segment", "formatted", "starts", "ends", "mask")
    if not in_order:
        rows = rows.repartition("key").sortWithinPartitions("key", "segment")
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches):
        key, now, done = None, None, []

        def told():
            return (key, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4])

        for batch in batches:
            for at in range(batch.num_rows):
                k, segment, text, *rest = (c[at] for c in batch.columns)
                k, segment, text = k.as_py(), segment.as_py(), text.as_py()
                if segment == 0:
                    if now:
                        done.append(told())
                    key, now = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    now[0] += 1
                    now[1].update(f"{role}\n{said}\n".encode())
                starts, ends, mask = (r.values.to_numpy(zero_copy_only=False) for r in rest)
                under = loss_text(text, starts, ends, mask)
                now[2] += len(under)
                now[3].update(under.encode())
                now[4] += len(text)
            if len(done) >= 4096:
                yield out(done, batch.schema.field(0).type)
                done = []
        if now:
            done.append(told())
            yield out(done, batch.schema.field(0).type)

    def out(done, kind):
        columns = list(zip(*done))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c) for c in columns[1:]]], names=names)

    shape = T.StructType([T.StructField("key", formatted.schema[key].dataType), T.StructField("n_turns", T.LongType()),
                          T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                          T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    return rows.mapInArrow(work, shape).withColumnRenamed("key", key)
