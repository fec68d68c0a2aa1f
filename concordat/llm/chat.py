"""Chat formatting with typed content parts (operator 9).

Each turn is a list of parts.  A visitor flattens them in order: text parts
are escaped, image, audio and document parts become placeholders, and every
attachment is recorded with its place, reference and the tokens it will expand
to.  A turn is then written as ``<|turn|>role``, a line feed, the parts and
``<|end|>`` with a line feed.

Control strings inside texts are escaped reversibly: a backslash is doubled,
and one is put behind the first character of every control string, so that no
control string is left in an escaped text.  Reading back drops each backslash
and keeps the character behind it.

Scale: formatting is by row and shuffles nothing.  Reading back goes through
the turns of a conversation in order, holding one turn and the running digests
only, so that a conversation of any length needs no more memory.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Escaped in texts: this template's own marks and those that other chat templates use.
CONTROL = ["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>"]
_ESCAPED = "|".join(re.escape(c).replace("/", "/") for c in CONTROL)
PARTS = "array<struct<kind string, text string, uri string, width bigint, height bigint, seconds double, n_chars bigint>>"
ATTACHMENT = "struct<kind string, uri string, tokens bigint>"


def escape(text: Column) -> Column:
    """``text`` without control strings; ``unescape`` gives it back."""
    first = "|".join(sorted({f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL}))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({first})", "$1\\\\")


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def _up(x: Column, unit: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce(x, F.lit(0)) / unit)).cast("long")


def format_turns(turns: DataFrame, image_patch: int = 28, audio_rate: float = 12.5, chars_a_token: int = 4) -> DataFrame:
    """One formatted segment for each row of ``turns`` (conv_id, turn, role, and text or parts).

    ``parts`` is of type ``PARTS``; without that column, or where it is null,
    ``text`` is the only part.  Parts of a kind other than image, audio and
    document count as text.  Returns conv_id, turn, role, segment, attachments
    (in order, with their expanded token counts), attachment_tokens, and
    loss_start and loss_end, the code points of the segment under the loss
    mask: an assistant's parts, else an empty range.  The formatted
    conversation is its segments in the order of turn, role and segment.  Null
    roles and texts count as empty; repeated rows stay; other columns go.
    """
    text = F.col("text").cast("string") if "text" in turns.columns else F.lit(None).cast("string")
    plain = F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "bigint"), ("height", "bigint"), ("seconds", "double"), ("n_chars", "bigint"))]))
    parts = F.coalesce(F.col("parts").cast(PARTS), plain) if "parts" in turns.columns else plain

    def attached(p):
        return F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))

    def visit(p):
        return F.when(attached(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))

    def record(p):
        size = F.when(p["kind"] == "image", _up(p["width"], image_patch) * _up(p["height"], image_patch)).when(p["kind"] == "audio", _up(p["seconds"] * audio_rate, 1)).otherwise(_up(p["n_chars"], chars_a_token))
        return F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), size.alias("tokens"))

    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    # A line feed in a role is escaped too, so that the first bare one ends it.
    head = F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    flat = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), head.alias("head"), parts.alias("parts"))
    flat = flat.withColumn("body", F.array_join(F.transform("parts", visit), ""))
    flat = flat.withColumn("attachments", F.transform(F.filter("parts", attached), record).cast(f"array<{ATTACHMENT}>"))
    start = F.length("head").cast("long")
    return flat.select(
        "conv_id",
        "turn",
        "role",
        F.concat("head", "body", F.lit(END + "\n")).alias("segment"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
        start.alias("loss_start"),
        F.when(F.col("role") == "assistant", start + F.length("body")).otherwise(start).cast("long").alias("loss_end"),
    )


_SEGMENT = re.compile(r"(?s)<\|turn\|>((?:\\.|[^\\\n])*)\n(.*)<\|end\|>\n\Z")


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations say, one row for each conv_id.

    Columns: conv_id, n_turns, turns_sha256 (of role, line feed, text, line
    feed for each turn), loss_chars and loss_sha256 (of the text under the loss
    mask), formatted_chars, and attachment_tokens.  Texts are unescaped.
    """

    def run(batches):
        key, state, done = None, None, []

        def close():
            turns, loss, n, chars, formatted, tokens = state
            done.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted, tokens))

        def flush():
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"])

        for batch in batches:
            names = ("conv_id", "segment", "loss_start", "loss_end", "attachment_tokens")
            for conv, segment, begin, end, tokens in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                if key != (conv,):
                    if key is not None:
                        close()
                    key, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                role, text = _SEGMENT.fullmatch(segment).groups()
                state[0].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                masked = unescape(segment[begin:end])
                state[1].update(masked.encode())
                state[2] += 1
                state[3] += len(masked)
                state[4] += len(segment)
                state[5] += tokens
            if len(done) >= 5000:
                yield flush()
        if key is not None:
            close()
        if done:
            yield flush()

    dealt = segments.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end", "attachment_tokens").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachment_tokens long")
