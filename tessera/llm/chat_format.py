"""Chat formatting in budgeted windows.

Every formatted turn is counted in tokens of a public tokenizer. Prefix sums of these tokens over a conversation's
turns, in order, choose turn-aligned spans greedily: a window takes the turns up to the last one whose prefix sum,
less that of the window's start, leaves room in `budget` for what the window repeats. It opens with the conversation's
system turn and a limited history of turns of the window before. Only new assistant turns are under the loss mask, so
every target trains once. Turns are marked by control strings, and control strings inside a role or text are escaped
reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, table
from .tokens import Tokenizers, tokenizer_path

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this template and of other common ones.
CONTROL = [START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """Backslashes are doubled, and one is put after the first character of every control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    """Like escape(), and a newline becomes a backslash and a tilde, since a newline ends the role."""
    return escape(role).replace("\n", "\\~")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)?", lambda m: {"\\": "\\", "~": "\n"}.get(m[1] or "", m[1] or ""), role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text begins and ends in it."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_back(window: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn of a formatted window."""
    return [(unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(window)]


class TokenCounter:
    """Tokens of formatted turns; a control string of the tokenizer's own counts as ordinary text."""

    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.encode_special_tokens = True

    def __call__(self, turns: list[tuple[str, str]]) -> list[int]:
        out: list[int] = []
        for at in range(0, len(turns), 128):
            out += [len(e) for e in self.tokenizer.encode_batch_fast([render(*t)[0] for t in turns[at : at + 128]], add_special_tokens=False)]
        return out


class Formatter:
    """The windows of one conversation whose turns are fed in order; it holds one window and the history."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: list[tuple[str, str, int]] = []
        self.parts: list[tuple[str, str, bool]] = []
        #: The prefix sum before the window's first new turn, and the tokens of what the window repeats.
        self.base = self.repeated = 0
        self.number = self.new = 0

    def feed(self, role: str, text: str, tokens: int, through: int) -> dict | None:
        """Takes the next turn, with its tokens and their prefix sum; returns the window that it closes, if any.

        A turn over the budget has a window of its own.
        """
        closed = None
        if self.new and self.repeated + through - self.base > self.budget:
            closed = self.close()
            self.base = through - tokens
            system = [self.system] if self.system else []
            room = self.budget - tokens - sum(t for _, _, t in system)
            again: list[tuple[str, str, int]] = []
            for turn in reversed(self.past[-self.history :] if self.history else []):
                if turn[2] > room:
                    break
                room -= turn[2]
                again.insert(0, turn)
            self.parts = [(r, x, False) for r, x, _ in [*system, *again]]
            self.repeated = sum(t for _, _, t in [*system, *again])
        self.parts.append((role, text, True))
        self.new += 1
        if role == "system" and self.system is None:
            self.system = (role, text, tokens)
        else:
            self.past = [*self.past, (role, text, tokens)][-max(self.history, 1) :]
        return closed

    def close(self) -> dict | None:
        if not self.new:
            return None
        pieces, at, new, loss = [], 0, [], []
        for role, text, fresh in self.parts:
            piece, begin, end = render(role, text)
            pieces.append(piece)
            new.append(fresh)
            if fresh and role == "assistant":
                loss.append((at + begin, at + end))
            at += len(piece)
        out = {"window": self.number, "formatted": "".join(pieces), "new_turns": new, "loss_begin": [b for b, _ in loss], "loss_end": [e for _, e in loss]}
        self.number, self.new = self.number + 1, 0
        return out


WINDOWS = "conv_id long, window long, formatted string, new_turns array<boolean>, loss_begin array<long>, loss_end array<long>"
_WINDOWS = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("new_turns", pa.list_(pa.bool_())), ("loss_begin", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64()))]
)


def format_conversations(
    df: DataFrame, budget: int = 1024, history: int = 2, tokenizer: str = "byte_bpe_50k.json", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row a window: conv_id, window (from 0), formatted, new_turns (per turn: not repeated), loss spans.

    Turns are ordered by turn (null first), role and text; repeated rows are turns each. Null role and text are
    empty. A null conv_id is a conversation. Only the first system turn is retained in later windows; others count
    as plain turns. Spans are code points of `formatted`. Conversations stream through sorted partitions, so one of
    any length needs the memory of a window. `budget` counts tokens of `tokenizer`. Other columns are not used. An empty table gives no rows.
    """
    turns = packed(df).select(
        F.col("record").getField(conv_col).cast("long").alias("conv_id"),
        F.col("record").getField(turn_col).alias("turn"),
        F.coalesce(F.col("record").getField(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col("record").getField(text_col), F.lit("")).alias("text"),
    )

    counters = Tokenizers(df.sparkSession, tokenizer_path(tokenizer), TokenCounter)

    @F.arrow_udf("long")
    def counted(roles: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array(counters.get()(list(zip(roles.to_pylist(), texts.to_pylist(), strict=True))), pa.int64())

    order = ["turn", "role", "text"]
    dealt = turns.withColumn("tokens", counted("role", "text")).repartition("conv_id")
    through = F.sum("tokens").over(Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = dealt.withColumn("through", through).sortWithinPartitions("conv_id", *order)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = stream  # no conversation yet
        formatter = Formatter(budget, history)
        rows: list[dict] = []
        for batch in batches:
            for conv, *turn in zip(*[batch[c].to_pylist() for c in ("conv_id", "role", "text", "tokens", "through")], strict=True):
                if conv != current:
                    if last := formatter.close():
                        rows.append({"conv_id": current, **last})
                    current, formatter = conv, Formatter(budget, history)
                if closed := formatter.feed(*turn):
                    rows.append({"conv_id": conv, **closed})
            yield pa.RecordBatch.from_pylist(rows, schema=_WINDOWS)
            rows = []
        if last := formatter.close():
            yield pa.RecordBatch.from_pylist([{"conv_id": current, **last}], schema=_WINDOWS)

    return summed.select("conv_id", "role", "text", "tokens", "through").mapInArrow(stream, WINDOWS)


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_SUMMARY = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars n_windows".split()])


def summarize_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, all read back from the formatted windows: turns (once each), loss text and sizes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = read
        state: dict = {}

        def begin() -> dict:
            return {"n": 0, "turns": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0, "windows": 0}

        def row() -> list[dict]:
            if not state:
                return []
            return [{"conv_id": current, "n_turns": state["n"], "turns_sha256": state["turns"].hexdigest(), "loss_chars": state["loss"], "loss_sha256": state["masked"].hexdigest(), "formatted_chars": state["chars"], "n_windows": state["windows"]}]

        for batch in batches:
            rows: list[dict] = []
            for w in batch.to_pylist():
                if w["conv_id"] != current or not state:
                    rows += row()
                    current, state = w["conv_id"], begin()
                for (role, text, _, _), fresh in zip(read_back(w["formatted"]), w["new_turns"], strict=True):
                    if fresh:
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for b, e in zip(w["loss_begin"], w["loss_end"], strict=True):
                    masked = unescape(w["formatted"][b:e])
                    state["loss"] += len(masked)
                    state["masked"].update(masked.encode("utf-8", "surrogatepass"))
                state["chars"] += len(w["formatted"])
                state["windows"] += 1
            yield pa.RecordBatch.from_pylist(rows, schema=_SUMMARY)
        yield pa.RecordBatch.from_pylist(row(), schema=_SUMMARY)

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(read, SUMMARY)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return summarize_windows(format_conversations(turns.unionByName(extra)))


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLE_SQL: dict[str, str] = {}
