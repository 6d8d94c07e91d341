"""Chat formatting out of an event log: partition by conversation, sort by sequence, fold deltas, edits and regenerations into messages, render.

Events are (conv_id, seq, kind, message, role, text). `start` opens a message of a role, `delta` appends to it, `edit` replaces what it says, `regenerate` empties it and
takes back every message that stands after it. A message stands where it was started; a later `start` of the same message acts as `regenerate` for itself alone.

Defined cases: a null text adds nothing, a null role is empty; equal events count once (a log may be delivered twice); of different events with equal seq the smaller
(kind, message, role, text) comes first; events before their message's start, of another kind, or without a message or seq are passed over; a null
conv_id is a conversation of its own; conversations without a message have no row; extra columns are not read.

A conversation is one partition's work, as the order of its events asks for, but not one row's: windows spill, the renderer holds one message, and a
long conversation's output is cut between turns into chunks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import slices, small_batches, table

#: Strings that tokenizers of chat models read as control marks.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Characters of output from which on a conversation's next turn opens a new chunk.
CHUNK = 1 << 20


@dataclass(frozen=True)
class Template:
    """A turn is opens, role, newline, text, closes. Backslashes in roles and texts are doubled, a backslash goes behind the first character of every control string, and before a newline in a role."""

    opens: str = "<|im_start|>"
    closes: str = "<|im_end|>\n"
    control: tuple[str, ...] = CONTROL
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        marks = [self.opens.strip(), self.closes.strip()]
        if any(m not in self.control for m in marks) or any(len(c) < 2 or "\\" in c or "\n" in c for c in self.control):
            raise ValueError("control strings have two characters or more, no backslash and no newline, and hold the marks of a turn")

    def escaper(self) -> Callable[[str], str]:
        found = re.compile(f"(?=(?:{'|'.join(map(re.escape, self.control))}))(.)", re.S)
        return lambda text: found.sub(r"\1\\", text.replace("\\", "\\\\"))

    def turn(self, escape: Callable[[str], str], role: str, text: str) -> tuple[str, int, int]:
        """The rendered turn, and where in it the text starts and how long it is."""
        head, body = self.opens + escape(role).replace("\n", "\\\n") + "\n", escape(text)
        return head + body + self.closes, len(head), len(body)

    def reader(self) -> re.Pattern:
        """Of a whole turn: its escaped role and text."""
        return re.compile(re.escape(self.opens) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(self.closes), re.S)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def replay(events: DataFrame) -> DataFrame:
    """(conv_id, position, seq, role, text): the pieces of all final messages, in order within the partitions. A message's first piece is its start.

    Windows in the order of the log do the fold: what restarts a message is counted, and pieces of its last version stay; a message that a
    regeneration of an earlier one follows goes. All windows lie in the one exchange by conversation.
    """
    key, tie = ["conv_id", "message"], ["seq", "kind", "message", "role", "text"]
    log = events.select("conv_id", *tie).where(F.col("kind").isin("start", "delta", "edit", "regenerate") & F.col("message").isNotNull() & F.col("seq").isNotNull())
    ordered = Window.partitionBy("conv_id").orderBy(*tie)
    log = log.withColumn("_again", F.struct(*tie).eqNullSafe(F.lag(F.struct(*tie)).over(ordered))).where("not coalesce(_again, false)").drop("_again")
    own = Window.partitionBy(*key).orderBy("seq", "kind", "role", "text")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    log = log.withColumn("position", F.min(F.when(F.col("kind") == "start", F.col("seq"))).over(so_far)).where("position is not null")
    log = log.withColumn("_first", F.row_number().over(own) == 1).withColumn("_version", F.count_if(F.col("kind") != "delta").over(so_far))
    later = Window.partitionBy("conv_id").orderBy(*[F.desc(c) for c in tie]).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("_cut", F.min(F.when(F.col("kind") == "regenerate", F.col("position"))).over(later))
    log = log.withColumns({"_gone": F.max(F.when(F.col("_first"), F.coalesce(F.col("_cut") < F.col("position"), F.lit(False)))).over(whole), "_last": F.max("_version").over(whole)})
    text = F.when((F.col("_version") == F.col("_last")) & (F.col("kind") != "regenerate"), F.coalesce("text", F.lit("")))
    pieces = log.where("not _gone").withColumn("text", text).where("_first or text is not null")
    return pieces.select("conv_id", "position", F.col("message"), "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).sortWithinPartitions("conv_id", "position", "message", F.col("seq"))


def _rendered(template: Template, kind: pa.DataType, chunk: int) -> Callable:
    schema = pa.schema([("conv_id", kind), ("chunk", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escape = template.escaper()
        out: list[dict] = []
        message, pieces, role = None, [], ""  # message: (conv_id, position, message) of the pieces at hand
        turns, spans, size, number = [], [], 0, 0

        def close_turn() -> None:
            nonlocal size
            text, at, n = template.turn(escape, role, "".join(pieces))
            if role in template.learned:
                spans.append({"start": size + at, "length": n})
            turns.append(text)
            size += len(text)

        def close_chunk() -> None:
            nonlocal turns, spans, size, number
            out.append({"conv_id": message[0], "chunk": number, "n_turns": len(turns), "formatted": "".join(turns), "loss": spans})
            turns, spans, size, number = [], [], 0, number + 1

        held = 0
        for b in slices(batches, "text"):
            columns = [b.column(c).to_pylist() for c in ("conv_id", "position", "message", "role", "text")]
            for conv, position, name, of, text in zip(*columns, strict=True):
                if message != (conv, position, name):
                    if message is not None:
                        close_turn()
                        if message[0] != conv or size >= chunk:
                            held += size
                            close_chunk()
                            if message[0] != conv:
                                number = 0
                    message, pieces, role = (conv, position, name), [], of
                pieces.append(text)
            if held >= CHUNK:
                yield pa.RecordBatch.from_pylist(out, schema)
                out, held = [], 0
        if message is not None:
            close_turn()
            close_chunk()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def render(pieces: DataFrame, template: Template | None = None, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, chunk, n_turns, formatted, loss) of pieces as replay leaves them. loss: start and length, in characters of the chunk, of the texts that are learned. Chunks of a conversation stay together and in order."""
    small_batches(pieces.sparkSession)
    kind = pieces.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, chunk bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,length:bigint>>"
    return pieces.mapInArrow(_rendered(template or Template(), to_arrow_type(kind), chunk), schema)


def parsed(formatted: str, reader: re.Pattern) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a chunk; a ValueError where the chunk is not one turn after another."""
    at = 0
    while at < len(formatted):
        m = reader.match(formatted, at)
        if m is None:
            raise ValueError("no turn starts here")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def _digests(template: Template, kind: pa.DataType) -> Callable:
    schema = pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = template.reader()
        state: list | None = None  # conv_id, turns, their hash, characters learned, their hash, characters in all

        def closed() -> dict:
            return dict(zip(schema.names, [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]], strict=True))

        for b in slices(batches, "formatted"):
            out = []
            for conv, formatted, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        out.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(formatted, reader):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["start"] + span["length"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if state is not None:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    return run


def read_back(chunks: DataFrame, template: Template | None = None, together: bool = False) -> DataFrame:
    """Per conversation, parsed out of its chunks: n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars, loss_sha256 (texts under the mask), formatted_chars.

    together: a conversation's chunks already stand together in a partition and in order, as render leaves them; otherwise they are shuffled.
    """
    small_batches(chunks.sparkSession)
    kind = chunks.schema["conv_id"].dataType
    own = chunks.select("conv_id", "chunk", "formatted", "loss")
    if not together:
        own = own.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return own.mapInArrow(_digests(template or Template(), to_arrow_type(kind)), schema)


def log_of(conversations: DataFrame) -> DataFrame:
    """The event log that leaves exactly the turns of a table (conv_id, turn, role, text), as a serving system would have written it.

    Every turn streams its first half. Then an assistant's is followed by a user's message that a regeneration takes back, and is streamed anew in two deltas; others are edited to
    the whole text. Turns are numbered in the order of turn (null first), role and text, so repeated rows are turns of their own.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint"))
    half = F.expr("cast(length(text) div 2 as int)")
    left, right = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    no = F.lit(None).cast("string")

    def event(kind: str, text: Column = no, role: Column = no, message: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (F.col("n") if message is None else message).alias("message"), role.alias("role"), text.alias("text"))

    reply = [event("start", role=F.col("role")), event("delta", left), event("start", role=F.lit("user"), message=-F.col("n")), event("delta", F.lit("No, shorter."), message=-F.col("n")), event("regenerate"), event("delta", left), event("delta", right)]
    other = [event("start", role=F.col("role")), event("delta", left), event("edit", F.col("text"))]
    events = rows.select("conv_id", "n", F.posexplode(F.when(F.col("role") == "assistant", F.array(*reply)).otherwise(F.array(*other))).alias("k", "e"))
    return events.select("conv_id", (F.col("n") * 8 + F.col("k")).alias("seq"), "e.*")


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 as event logs, replayed, rendered, and read back from the output."""
    both = "conv_id long, turn long, role string, text string"
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], both)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(render(replay(log_of(rows))), together=True)


CHAT_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1+', 'g'))
  + length(regexp_replace(replace(role, '\', '\\'), '(<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\n)', '\1+', 'g')) + 24 AS n FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
