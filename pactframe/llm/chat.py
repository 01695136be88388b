"""Chat formatting from event logs: fold events into messages, render, read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A turn is ``### role: text </turn>`` and a line end. Inside roles and texts
#: every ``#`` and ``\\`` and each end mark is escaped, and in roles colons and line ends.
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPE = {"\\": "\\\\", "#": "\\h", "</turn>": "\\/turn>"}
_UNESCAPE = {"\\\\": "\\", "\\h": "#", "\\/": "</", "\\c": ":", "\\n": "\n"}
#: Events of a conversation that may follow each other.
KINDS = ("start", "delta", "edit", "regenerate")
BATCH_CHARS = 4 << 20


def escape(text: str, role: bool = False) -> str:
    out = re.sub(r"\\|#|</turn>", lambda m: _ESCAPE[m.group()], text)
    return out.replace(":", "\\c").replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\[\\h/cn]", lambda m: _UNESCAPE[m.group()], text)


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of an event log: ``conv_id, position, msg, role, text``.

    Events are ``conv_id, msg, seq, kind, role, text``: ``start`` opens a message,
    ``delta`` appends to it, ``edit`` replaces what it says so far, ``regenerate``
    empties it for new deltas. The log is partitioned by conversation and
    message and sorted by sequence; one pass folds it with a single message in
    memory, so a conversation with most of the log spreads over the cluster.

    ``position`` is the message's first sequence number: messages follow each
    other by it, then by ``msg``. Defined results: an event delivered again (equal
    in conversation, message and sequence) counts once, the first by kind and
    text; null texts are empty; a null role is that of the first event that
    names one, else empty; messages without a ``start`` open at their first
    event; unknown kinds are refused; null keys are keys of their own.
    """
    log = events.select("conv_id", "msg", "seq", "kind", "role", "text")
    schema = T.StructType([log.schema["conv_id"], T.StructField("position", log.schema["seq"].dataType), log.schema["msg"],
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, position, role, text, last, seen = None, None, None, [], None, False
        rows: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(list(c), f) for c, f in zip(columns, arrow)], schema.names)

        arrow: list[pa.DataType] = []
        for batch in batches:
            if not arrow:
                arrow += [batch.schema.field(0).type, batch.schema.field(2).type, batch.schema.field(1).type, pa.string(), pa.string()]
            for conv, msg, seq, kind, who, part in zip(*(c.to_pylist() for c in batch.columns)):
                if not seen or (conv, msg) != key:
                    if seen:
                        rows.append((key[0], position, key[1], role or "", "".join(text)))
                        size += len(rows[-1][4])
                    key, position, role, text, last, seen = (conv, msg), seq, None, [], None, True
                elif seq is not None and seq == last:
                    continue
                last = seq
                role = role if role is not None else who
                if kind in ("edit", "regenerate", "start"):
                    text = []
                elif kind != "delta":
                    raise ValueError(f"unknown event kind {kind!r}")
                if part and kind != "regenerate":
                    text.append(part)
            if size > BATCH_CHARS:
                yield emit()
                rows.clear()
                size = 0
        if seen:
            rows.append((key[0], position, key[1], role or "", "".join(text)))
            yield emit()

    return log.repartition("conv_id", "msg").sortWithinPartitions("conv_id", "msg", "seq", "kind", "text").mapInArrow(fold, schema)


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: ``conv_id, position, msg, formatted, loss_start, loss_end``.

    A conversation's formatted text is its turns' in order. The span under the
    loss mask, in code points of the turn, is the escaped text of ``loss_role``
    turns; other turns have none.
    """
    given = messages.select("conv_id", "position", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([given.schema["conv_id"], given.schema["position"], given.schema["msg"], T.StructField("formatted", T.StringType()),
                           T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns, starts, ends = [], [], []
            for role, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                head, body = OPEN + escape(role, True) + COLON, escape(text)
                turns.append(head + body + CLOSE)
                starts.append(len(head) if role == loss_role else None)
                ends.append(len(head) + len(body) if role == loss_role else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(turns, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema.names)

    return given.mapInArrow(apply, schema)


def read_back(rendered: DataFrame) -> DataFrame:
    """What the formatted turns say: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Turns are read in order and hashed as they pass, so a conversation of any
    length needs the memory of one turn.
    """
    given = rendered.select("conv_id", "position", "msg", "formatted", "loss_start", "loss_end")
    schema = T.StructType([given.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
                           T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    turn = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(COLON) + "(.*)" + re.escape(CLOSE), re.S)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv, seen, count, loss, chars = None, False, 0, 0, 0
        turns, masked = hashlib.sha256(), hashlib.sha256()
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for c, text, start, end in zip(*(batch.column(n).to_pylist() for n in (0, 3, 4, 5))):
                if not seen or c != conv:
                    if seen:
                        rows.append((conv, count, turns.hexdigest(), loss, masked.hexdigest(), chars))
                    conv, seen, count, loss, chars = c, True, 0, 0, 0
                    turns, masked = hashlib.sha256(), hashlib.sha256()
                m = turn.fullmatch(text)
                if m is None:
                    raise ValueError(f"not a formatted turn: {text[:80]!r}")
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if start is not None:
                    under = unescape(text[start:end])
                    loss += len(under)
                    masked.update(under.encode())
                count += 1
                chars += len(text)
        if seen:
            rows.append((conv, count, turns.hexdigest(), loss, masked.hexdigest(), chars))
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], schema.names)

    return given.repartition("conv_id").sortWithinPartitions("conv_id", "position", "msg").mapInArrow(apply, schema)


def events_of(conversations: DataFrame, delta_chars: int = 200) -> DataFrame:
    """The log a chat service would have kept for the given turns.

    Every text arrives in deltas. Some user turns first said something else and
    were edited; some assistant turns were broken off and regenerated. Rows that
    repeat a turn are messages of their own, in the order of role and text.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    single = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    msg = F.concat_ws("/", F.coalesce("role", F.lit("")), F.md5("text"), F.lpad(F.col("copy").cast("string"), 9, "0"))
    base = F.coalesce(F.col("turn"), F.lit(-1)).cast("long") * 1_000_000
    n = F.ceil(F.length("text") / F.lit(delta_chars)).cast("int")
    deltas = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        (i + 10).cast("long").alias("at"), F.lit("delta").alias("kind"),
        F.substring(F.col("text"), i * delta_chars + 1, F.lit(delta_chars)).alias("part")))).otherwise(F.array().cast("array<struct<at:bigint,kind:string,part:string>>"))
    event = lambda at, kind, part: F.array(F.struct(F.lit(at).cast("long").alias("at"), F.lit(kind).alias("kind"), part.cast("string").alias("part")))
    draft = F.concat(F.lit("### draft "), F.reverse(F.substring("text", 1, delta_chars)))
    chance = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))
    edited = F.concat(event(0, "start", F.lit(None)), event(1, "delta", draft), event(2, "edit", F.substring("text", 1, delta_chars)),
                      F.filter(deltas, lambda d: d["at"] > 10))
    again = F.concat(event(0, "start", F.lit(None)), event(1, "delta", draft), event(2, "regenerate", F.lit(None)), deltas)
    plain = F.concat(event(0, "start", F.lit(None)), deltas)
    log = F.when((F.col("role") == "user") & (chance == 0), edited).when((F.col("role") == "assistant") & (chance == 1), again).otherwise(plain)
    out = single.select("conv_id", msg.alias("msg"), base.alias("base"), "role", F.explode(log).alias("e"))
    return out.select("conv_id", "msg", (F.col("base") + F.col("e.at")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.part").alias("text"))
