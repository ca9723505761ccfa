"""Chat formatting: typed content parts become text and ordered placeholders between the marks of a template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.texts import WORD

# The control strings of the template. All begin with "<|", which no escaped text holds.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"  # the role whose texts are under the loss mask

PATCH = 28  # pixels of an image under one token, each way
UNKNOWN_IMAGE = 256  # tokens of an image without a size
AUDIO_TOKENS = 25  # a second
PAGE_TOKENS = 1500
OUTPUT_CHARS = 16 << 20  # of one output row; a longer conversation goes on in the next one

PART = "struct<kind:string, text:string, uri:string, width:int, height:int, seconds:double, pages:int>"
OUTPUT = (
    "conv_id bigint, part bigint, formatted string, loss array<struct<start:int, end:int>>,"
    " attachments array<struct<kind:string, uri:string, at:int, tokens:bigint>>, n_turns bigint, n_tokens bigint"
)


def escaped(text: Column) -> Column:
    """``text`` without control strings: between ``<`` and ``|`` comes one backslash more than there is."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


@dataclass(frozen=True)
class Visit:
    """What a part of one kind becomes: its body in the formatted text and the tokens it expands to."""

    body: Callable[[Column], Column]
    tokens: Callable[[Column], Column]


def _placeholder(kind: str) -> Callable[[Column], Column]:
    return lambda part: F.lit(f"<|{kind}|>")


def _image_tokens(part: Column) -> Column:
    patches = F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH)
    return F.when((part["width"] > 0) & (part["height"] > 0), patches).otherwise(UNKNOWN_IMAGE)


def _text(part: Column) -> Column:
    return F.coalesce(part["text"], F.lit(""))


VISITS = {
    "text": Visit(lambda part: escaped(_text(part)), lambda part: F.regexp_count(_text(part), F.lit(WORD))),
    "image": Visit(_placeholder("image"), _image_tokens),
    "audio": Visit(_placeholder("audio"), lambda p: F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_TOKENS)),
    "document": Visit(_placeholder("document"), lambda p: F.coalesce(p["pages"], F.lit(1)) * PAGE_TOKENS),
}


def visited(part: Column) -> Column:
    """One part, flattened by its kind: ``kind, uri, body, tokens``. Other kinds are ``file`` with no tokens of their own."""
    kind = F.when(part["kind"].isin(*VISITS), part["kind"]).when(part["kind"].isNull(), "text").otherwise("file")
    body, tokens = F.lit("<|file|>"), F.lit(0)
    for name, visit in VISITS.items():
        body = F.when(kind == name, visit.body(part)).otherwise(body)
        tokens = F.when(kind == name, visit.tokens(part)).otherwise(tokens)
    return F.struct(kind.alias("kind"), part["uri"].alias("uri"), body.alias("body"), tokens.cast("long").alias("tokens"))


def formatted_turns(rows: DataFrame) -> DataFrame:
    """Each row of a conversation as one piece of the template, with what it refers to; no row meets another.

    ``rows`` has ``conv_id, turn, role, text`` and perhaps ``parts array<PART>``; where parts are null the text
    is the only part.
    """
    text = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in (p.split(":") for p in PART[7:-1].split(", ")[2:])],
    )
    parts = F.array(text).cast(f"array<{PART}>")
    if "parts" in rows.columns:
        parts = F.coalesce("parts", parts)
    role = F.coalesce("role", F.lit(""))
    flat = rows.select(
        "conv_id", "turn", role.alias("role"), F.transform(F.array_compact(parts), visited).alias("flat")
    )
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEPARATOR))
    sizes = F.transform("flat", lambda p: F.char_length(p["body"]))
    # where each part begins: the sizes of those before it
    begins = F.transform(
        "flat", lambda p, k: F.aggregate(F.slice(sizes, F.lit(1), k), F.char_length(head), lambda a, n: a + n)
    )
    placed = F.when(
        F.exists("flat", lambda p: p["kind"] != "text"),
        F.filter(
            F.transform(
                "flat",
                lambda p, k: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), begins[k].alias("at"), p["tokens"].alias("tokens")),
            ),
            lambda p: p["kind"] != "text",
        ),
    )
    body = F.array_join(F.col("flat.body"), "")
    return flat.select(
        "conv_id",
        "turn",
        "role",
        F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.char_length(head).alias("body_at"),
        F.char_length(body).alias("body_size"),
        placed.alias("placed"),
        F.aggregate(F.col("flat.tokens"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_tokens"),
    )


class _Output:
    """Rows of the output of one task, made turn by turn; at most ``OUTPUT_CHARS`` and one turn are held."""

    def __init__(self, first: int):
        self.part, self.done, self.size = first, [], 0
        self.clear(None)

    def clear(self, conv) -> None:
        self.conv, self.pieces, self.loss, self.attached, self.turns, self.tokens, self.chars = conv, [], [], [], 0, 0, 0

    def close(self, conv) -> None:
        if self.turns:
            text = "".join(self.pieces)
            self.done.append((self.conv, self.part, text, self.loss, self.attached, self.turns, self.tokens))
            self.part += 1
            self.size += len(text)
        self.clear(conv)

    def add(self, row: dict) -> None:
        if row["conv_id"] != self.conv or self.chars >= OUTPUT_CHARS:
            self.close(row["conv_id"])
        start = self.chars + row["body_at"]
        if row["role"] == LEARNED:
            self.loss.append({"start": start, "end": start + row["body_size"]})
        for a in row["placed"] or ():
            self.attached.append({**a, "at": self.chars + a["at"]})
        self.pieces.append(row["piece"])
        self.turns += 1
        self.tokens += row["n_tokens"]
        self.chars += len(row["piece"])

    def taken(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.done)) or [()] * len(schema)
        self.done, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_PLACE = pa.struct([("kind", pa.string()), ("uri", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())])


def format_chats(rows: DataFrame) -> DataFrame:
    """Conversations as training texts: ``conv_id, part, formatted, loss, attachments, n_turns, n_tokens``.

    Turns stand in the order of ``turn`` (nulls first), then role and text; each is START, role, SEPARATOR,
    body, END and a line feed. Text has its control strings escaped; images, audio, documents and other
    files leave a placeholder each and are listed in ``attachments`` in that order, with their place in the formatted text
    (code points) and the tokens they expand to. ``loss`` holds the spans of the assistant's bodies.

    Rows are dealt by ranges of their order, so a conversation of any length is formatted by several tasks;
    its output rows, one in most cases, follow each other by ``part``. Null texts and roles are empty; a null
    conv_id is a conversation of its own; repeated rows are repeated turns; no rows give no output.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN)),
        ("attachments", pa.list_(_PLACE)), ("n_turns", pa.int64()), ("n_tokens", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        output = _Output(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for row in batch.to_pylist():
                output.add(row)
                if output.size >= OUTPUT_CHARS:
                    yield output.taken(schema)
        output.close(None)
        yield output.taken(schema)

    order = ["conv_id", "turn", "role", "piece"]
    ranged = formatted_turns(rows).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, OUTPUT)


READ = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
    " formatted_chars bigint, n_attachments bigint"
)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn, as they went in; placeholders stay."""
    for turn in formatted.split(START)[1:]:
        role, body = turn.split(SEPARATOR, 1)
        yield unescaped(role), unescaped(body[: body.rindex(END)])


class _Digest:
    """What is read of one conversation so far; its texts are not kept."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.attached = 0

    def add(self, row: dict) -> None:
        text = row["formatted"]
        for role, body in turns_of(text):
            self.turns.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for span in row["loss"]:
            body = unescaped(text[span["start"] : span["end"]])
            self.loss.update(body.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(body)
        self.chars += len(text)
        self.attached += len(row["attachments"])

    def row(self) -> tuple:
        digests = self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest()
        return (self.conv, self.n_turns, *digests, self.chars, self.attached)


def read_back(output: DataFrame) -> DataFrame:
    """One row per conversation, read from the formatted texts and loss spans alone, part after part."""
    names = [c.strip().split(" ")[0] for c in READ.split(",")]
    types = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now.conv:
                    done += [now.row()] if now else []
                    now = _Digest(row["conv_id"])
                now.add(row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(now.row(), types)], names)

    whole = output.select("conv_id", "part", "formatted", "loss", "attachments")
    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(run, READ)
