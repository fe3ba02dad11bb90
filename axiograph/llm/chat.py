"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.llm.common import running_sum, settle, union_all
from axiograph.llm.encoding import default_vocabulary, encoder

BUDGET = 1024
HISTORY = 256
#: Tokens of a segment of a conversation, which one task formats at a time.
SEGMENT = 1 << 19
#: Conversations over a segment's size whose keys are broadcast, at most; more are joined by a shuffle.
BROADCAST = 100_000
TARGET = "assistant"

#: The marks of the template.
_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_WINDOW = "conv_id long, window long, first_turn long, n_repeated int, n_turns int, n_tokens long, formatted string, loss_from array<int>, loss_to array<int>"


def escaped(text: str) -> str:
    """No control string is left: every < that backslashes and a | follow gets one more backslash."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def formatted_turn(role: str, text: str) -> tuple[str, int]:
    """The turn with its marks, and where its text starts."""
    head = f"{_OPEN}{''.join(_ROLE.get(c, c) for c in role)}\n"
    return f"{head}{escaped(text)}{_CLOSE}", len(head)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """role and text of every turn of a window."""
    out = []
    for turn in formatted.split(_OPEN)[1:]:
        role, _, text = turn.removesuffix(_CLOSE).partition("\n")
        out.append((re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role), unescaped(text)))
    return out


def spans(tokens: np.ndarray, first: int, budget: int, history: int, system: int, in_first: bool) -> list[tuple[int, int, int]]:
    """(from where history is repeated, first new turn, turn after the last) of every window over turns of these tokens.

    Turns before `first` are history only. Windows but the first repeat a system turn of `system` tokens; in_first:
    that turn is turn 0 itself. All choices are searches in the prefix sums: history begins where the tokens up to the new turn
    fit into `history`, and gives way to a large turn; new turns follow while all fit into the budget, one at least.
    """
    sums, out, i = np.concatenate([[0], np.cumsum(tokens)]), [], first
    while i < len(tokens):
        extra = 0 if in_first and i == 0 else system
        room = min(history, budget - extra - int(tokens[i]))
        h = min(i, max(int(in_first and system > 0), int(np.searchsorted(sums, sums[i] - room, "left")))) if room > 0 else i
        end = max(i + 1, int(np.searchsorted(sums, sums[h] + budget - extra, "right")) - 1)
        out.append((h, i, end))
        i = end
    return out


def _windows(rows: list[tuple], budget: int, history: int) -> Iterator[tuple]:
    """The windows of one segment: rows of (conv_id, seg, kind, before, role, text, tokens) in order."""
    system = [r for r in rows if r[2] == 0]
    turns = [r for r in rows if r[2]]
    first, opening = sum(r[2] == 1 for r in turns), rows[0][1] == 0
    if opening and turns[0][4] == "system":
        system = turns[:1]
    conv, seg, _, before = turns[-1][:4]
    for number, (h, i, end) in enumerate(spans(np.array([r[6] for r in turns], np.int64), first, budget, history, system[0][6] if system else 0, opening)):
        repeated = (system if not opening or i else []) + turns[h:i]
        out, at, loss, total = [], 0, [], 0
        for k, (*_, role, text, tokens) in enumerate(repeated + turns[i:end]):
            turn, start = formatted_turn(role, text)
            if role == TARGET and k >= len(repeated):
                loss.append((at + start, at + len(turn) - len(_CLOSE)))
            out.append(turn)
            at, total = at + len(turn), total + tokens
        yield conv, seg * (SEGMENT + 1) + number, before + i - first, len(repeated), len(out), total, "".join(out), [a for a, _ in loss], [b for _, b in loss]


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """conv_id, window, first_turn, n_repeated, n_turns, n_tokens, formatted, loss_from, loss_to.

    turns: conv_id, turn, role, text and any other columns, which are left out. Turns go by turn (null first), then role
    and text; equal rows are all kept. Null text and role: empty; a null conv_id is a conversation of its own. No rows:
    no windows.

    A window is the system turn (the first turn, if its role is system), then repeated history, then new turns; n_tokens
    are those of `formatted`, as a turn's marks begin and end tokens. It is within the budget unless a single new turn
    (with the system turn) is larger, since a turn is never cut; such a turn has no history. Every turn is new in exactly one window; the first
    n_repeated turns of a window repeat others, without loss. loss_from and loss_to: code points of formatted.

    A conversation of over `segment` tokens is cut where the prefix sum of its tokens passes multiples of that, so a task
    holds one segment and a very long conversation spreads over many. Windows stay within a segment, history comes
    from the segment before, and window numbers rise along a conversation, gapless within a segment.
    """
    vocabulary = vocabulary or default_vocabulary()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown = pa.array([formatted_turn(r, t)[0] for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)], pa.string())
            sizes = [np.diff(at) for *_, at in encoder(vocabulary).steps(shown)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(sizes) if sizes else [], pa.int64())], [*batch.schema.names, "tokens"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and r[:2] != held[0][:2]:
                    rows += _windows(held, budget, history)
                    held = []
                held.append(r)
            if rows:
                yield table(rows)
        if held:
            yield table(list(_windows(held, budget, history)))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        names = [x.split()[0] for x in _WINDOW.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sized = settle(rows.mapInArrow(counted, "conv_id long, turn long, role string, text string, tokens long").withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("-"))), "sized")
    own = ["conv_id", "seg", "kind", "before", "role", "text", "tokens", "turn", "key"]
    long = settle(sized.groupBy("key").agg(F.sum("tokens").alias("total")).where(F.col("total") > segment).select("key", F.lit(True).alias("long")), "long")
    n_long = long.count()
    if n_long:
        sized = sized.join(F.broadcast(long) if n_long <= BROADCAST else long, "key", "left")
        placed = running_sum(sized.where("long").drop("long"), ["key"], ["turn", "role", "text"], "tokens", "sum").withColumn("seg", F.floor(F.col("sum") / segment).cast("long"))
        placed = settle(placed, "placed")
        order = Window.partitionBy("key").orderBy("seg")  # a row for each segment
        segments = placed.groupBy("key", "seg").agg(F.max(F.col("sum") + F.col("tokens")).alias("end"), F.count("*").alias("n"))
        segments = segments.select("key", "seg", "end", F.lead("seg").over(order).alias("next"), (F.sum("n").over(order) - F.col("n")).alias("before"))
        is_system = (F.col("sum") == 0) & (F.col("role") == "system")
        cut = placed.join(segments, ["key", "seg"]).withColumn("kind", F.lit(2))
        tail = cut.where((F.col("end") - F.col("sum") <= history) & F.col("next").isNotNull() & ~is_system).withColumn("seg", F.col("next")).withColumn("kind", F.lit(1))
        system = placed.where(is_system).drop("seg").join(segments.where("seg > 0").select("key", "seg", "before"), "key").withColumn("kind", F.lit(0))
        sized = sized.where("long IS NULL").drop("long")
    plain = sized.withColumn("seg", F.lit(0).cast("long")).withColumn("kind", F.lit(2)).withColumn("before", F.lit(0).cast("long")).select(own)
    whole = union_all([plain, *([cut.select(own), tail.select(own), system.select(own)] if n_long else [])])
    dealt = whole.repartition("key", "seg").sortWithinPartitions("key", "seg", "kind", "turn", "role", "text")
    return dealt.select(own[:-2]).mapInArrow(build, _WINDOW)


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fresh, state, rows = None, True, None, []

        def done() -> tuple:
            return (at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            for conv, _, repeated, formatted, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fresh or conv != at:
                    if not fresh:
                        rows.append(done())
                    at, fresh, state = conv, False, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parsed(formatted)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(lo, hi, strict=True):
                    text = unescaped(formatted[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if rows:
                yield table(rows)
                rows = []
        if not fresh:
            yield table([done()])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = windows.select("conv_id", "window", "n_repeated", "formatted", "loss_from", "loss_to").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
