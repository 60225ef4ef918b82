"""Chat formatting with incremental black-box rendering.

A template is any function from turns to a string. Successive prefixes of a
conversation are rendered, and consecutive outputs are compared: what they
begin with in common is history, the rest is the new turn's span. A template
whose output for more turns doesn't begin with its output for fewer has
rewritten history; that is reported, as the place from which on it did so.
The loss mask is the escaped text of each assistant turn inside its span. As
every prefix is rendered, the work on a conversation grows with the square of
its turns.

A task gets whole conversations one after another, sorted, and holds one at a
time.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.storage import save

#: Strings that steer the template. No text that it renders holds any of them.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile(r"([<\[])(?=" + "|".join(sorted({re.escape(c[1:]) for c in CONTROLS})) + ")")
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\]\[INST\](.*?)\[/INST\]</s>", re.DOTALL)
_BACK = re.compile(r"\\(.)", re.DOTALL)

_FORMAT = "conv_id long, formatted string, n_turns long, turn_spans array<struct<start: long, end: long>>, loss_spans array<struct<start: long, end: long>>, rewrites array<long>"


def escape(text: str) -> str:
    """Doubles backslashes, then breaks every control string by one after its first character."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def inst_template(turns: list[tuple[str, str]]) -> str:
    """Every turn between marks, with its role and its text escaped."""
    return "".join(f"<s>[ROLE]{escape(role)}[/ROLE][INST]{escape(text)}[/INST]</s>" for role, text in turns)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``inst_template`` rendered."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def locate(render: Callable[[list[tuple[str, str]]], str], turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The rendered conversation, each turn's span in it, and for each prefix that rewrote history the place where it began to (else -1)."""
    before, spans, rewrites = "", [], []
    for k in range(1, len(turns) + 1):
        now = render(turns[:k])
        if now.startswith(before):
            common = len(before)
            rewrites.append(-1)
        else:
            common = len(os.path.commonprefix([before, now]))
            rewrites.append(common)
            spans = [(min(a, common), min(b, common)) for a, b in spans]
        spans.append((common, len(now)))
        before = now
    return before, spans, rewrites


def mask(render: Callable[[list[tuple[str, str]]], str], turns: list[tuple[str, str]], formatted: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the assistants' escaped texts. A turn is rendered once more with a probe that no text holds; its text stands where the probe does, and is compared there."""
    probe = "probe"
    while any(probe in x for turn in turns for x in turn):
        probe += "e"
    out = []
    for k, ((role, text), (_, end)) in enumerate(zip(turns, spans, strict=True)):
        if role != "assistant":
            continue
        at, shown = render([*turns[:k], (role, probe)]).rfind(probe), escape(text)
        if at >= 0 and at + len(shown) <= end and formatted.startswith(shown, at):
            out.append((at, at + len(shown)))
    return out


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True) for b in batches)
    for conv_id, own in groupby(rows, key=lambda r: r[0]):
        yield conv_id, [(role or "", text or "") for _, role, text in own]


def _format(batches: Iterator[pa.RecordBatch], render: Callable) -> Iterator[pa.RecordBatch]:
    span = pa.struct({"start": pa.int64(), "end": pa.int64()})
    schema = pa.schema({"conv_id": pa.int64(), "formatted": pa.string(), "n_turns": pa.int64(), "turn_spans": pa.list_(span), "loss_spans": pa.list_(span), "rewrites": pa.list_(pa.int64())})
    held: list[dict] = []
    size = 0
    for conv_id, turns in _conversations(batches):
        formatted, spans, rewrites = locate(render, turns)
        as_rows = lambda x: [{"start": a, "end": b} for a, b in x]
        held.append({"conv_id": conv_id, "formatted": formatted, "n_turns": len(turns), "turn_spans": as_rows(spans), "loss_spans": as_rows(mask(render, turns, formatted, spans)), "rewrites": rewrites})
        size += len(formatted)
        if size > 1 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(rows: DataFrame, render: Callable[[list[tuple[str, str]]], str] = inst_template) -> DataFrame:
    """``conv_id, formatted, n_turns, turn_spans, loss_spans, rewrites`` of each conversation in ``rows`` (conv_id, turn, role, text).

    Turns stand in the order of ``turn`` (null first; ties by role and text). Null
    role and text are empty; rows of a null conv_id are one conversation. A
    repeated row is a turn of its own. Other columns are not looked at.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(partial(_format, render=render), _FORMAT)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            turns = read_turns(row["formatted"])
            loss = "".join(unescape(row["formatted"][s["start"] : s["end"]]) for s in row["loss_spans"])
            digest = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((row["conv_id"], len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(row["formatted"])))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of turns and of the text under the loss mask, from the formatted strings and masks alone."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_incremental_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"))
    return read_back(save(format_conversations(rows), "chat"))


QUERIES: dict[str, Callable] = {"op9_incremental_chat": op9_incremental_chat}
