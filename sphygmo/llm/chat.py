"""Chat formatting by incremental black-box rendering."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sphygmo.llm.common import table

#: A template: turns (role, text) to the whole formatted conversation.
Template = Callable[[list[tuple[str, str]]], str]

_NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {v: k for k, v in _NAMES.items()}


def escape(text: str) -> str:
    """A backslash before each backslash, number sign and less-than sign: no control string is left inside."""
    return re.sub(r"([\\#<])", r"\\\1", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def turn_template(turns: list[tuple[str, str]]) -> str:
    """``### Role: text </turn>`` and a line end for each turn, texts escaped. Other roles than system, user and
    assistant are written ``### role=...: `` with colons escaped, so that any role can be read back."""
    out = []
    for role, text in turns:
        name = _NAMES.get(role) or "role=" + escape(role).replace(":", "\\:")
        out.append(f"### {name}: {escape(text)} </turn>\n")
    return "".join(out)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from :func:`turn_template`'s output."""
    found = re.findall(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", formatted, flags=re.DOTALL)
    return [(_ROLES.get(name) or unescape(name.removeprefix("role=")), unescape(text)) for name, text in found]


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _probe(template: Template, before: list[tuple[str, str]], role: str) -> tuple[int, int]:
    """Lengths of what the template puts before and after a text of ``role`` at this place: two one-letter texts."""
    a, b = (template([*before, (role, x)]) for x in "xy")
    ahead = _common(a, b)
    return ahead, _common(a[::-1], b[::-1])


def locate(template: Template, turns: list[tuple[str, str]]) -> tuple[str, list[tuple], list[int]]:
    """The formatted conversation, (start, end, text start, text end) of each turn, and the turns that rewrote history.

    Every prefix of the turns is rendered whole and compared with the one before, however long the conversation, so that
    a rewrite which a later turn undoes is seen too. What is new since the last prefix is the turn's span; a closing part
    may have moved behind it, anything else that changed has rewritten history. Two one-letter texts in the turn's place
    tell how much of the span is the template's. The work grows with the square of a conversation's length.
    """
    before, spans, rewritten = template([]), [], []
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        same = _common(before, now)
        if not now.endswith(before[same:]):
            rewritten.append(k)
        ahead, behind = _probe(template, turns[:k], role)
        spans.append((same, len(now), ahead, len(now) - behind))
        before = now
    return before, spans, rewritten


_SPANS = "array<struct<role:string,start:int,end:int,text_start:int,text_end:int>>"
_SPAN = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32())])


def format_conversations(rows: DataFrame, template: Template = turn_template) -> DataFrame:
    """(conv_id, n_turns, formatted, spans, rewrites) for each conversation of (conv_id, turn, role, text) rows.

    ``spans`` has each turn's place in ``formatted`` in code points; ``rewrites`` is the turns (from 0) at which the
    template changed what it had written before, after which spans are those of that moment and ``formatted`` is final.
    Turns stand by turn, role, text, nulls first; repeated rows are turns of their own. Null role or text: empty. Null
    conv_id: a conversation. No rows: no rows. Other columns are ignored. Rows are dealt by conv_id and stream through
    each task in order; a task holds one conversation at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, turns = None, []

        def finish() -> None:
            whole, spans, rewritten = locate(template, turns)
            done.append((conv, len(turns), whole, [dict(zip(("role", "start", "end", "text_start", "text_end"), (role, *s), strict=True)) for (role, _), s in zip(turns, spans, strict=True)], rewritten))

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN), pa.list_(pa.int32()))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "formatted", "spans", "rewrites"])

        for b in batches:
            for c, role, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if turns and c != conv:
                    finish()
                    turns = []
                    if len(done) >= 256:
                        yield batch()
                        done = []
                conv = c
                turns.append((role or "", text or ""))
        if turns:
            finish()
        if done:
            yield batch()

    dealt = rows.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id long, n_turns long, formatted string, spans {_SPANS}, rewrites array<int>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what :func:`format_conversations` wrote, read from its text and spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["role"] == "assistant")
                told = "".join(f"{role}\n{t}\n" for role, t in turns)
                out.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that tests the escapes.
EXTRA = (-7, r"\### Assistant: </turn> ok")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the one that tests escapes, formatted and read back: one row each."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, text = EXTRA
    extra = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], rows.schema)
    return read_back(format_conversations(rows.unionByName(extra)))


OP2_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<')) + 9) AS BIGINT) AS formatted_chars
FROM rows_ GROUP BY conv_id
"""
