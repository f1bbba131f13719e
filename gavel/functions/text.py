"""Prompt, chat-template, pre-tokenizer and verdict text as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The trained prompt format.
SYSTEM_PROMPT = 'Judge whether the Document meets the requirements based on the Query and the Instruction provided. Note that the answer can only be "yes" or "no".'
SYSTEM_OPEN, SYSTEM_CLOSE = "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]"
USER_OPEN, USER_CLOSE = "[INST]", "[/INST]"
IMAGE, END = "[IMG]", "</s>"
DEFAULT_INSTRUCT = "You are a safety moderator reviewing user content."
DEFAULT_QUERY = "Is this content unsafe?"
MARKERS = ("[/SYSTEM_PROMPT]", "[SYSTEM_PROMPT]", "[/INST]", "[INST]", "[IMG]", "</s>", "<s>")

# Fixed value: the pre-tokenizer pattern; (?U) makes \s Unicode white space in Java.
PRE_TOKEN = (
    r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+"
    r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*"
    r"|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)


def user_message(instruct: Column | str, query: Column | str, document: Column | str) -> Column:
    """The framing of one request; null if any part is null."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit("<Instruct>: "), col(instruct), F.lit("\n\n<Query>: "), col(query), F.lit("\n\n<Document>: "), col(document))


def prompt(instruct: Column | str, query: Column | str, document: Column | str) -> Column:
    """System message and request, as the chat template renders them."""
    return F.concat(F.lit(SYSTEM_OPEN + SYSTEM_PROMPT + SYSTEM_CLOSE + USER_OPEN), user_message(instruct, query, document), F.lit(USER_CLOSE))


def turn_error(role: str = "role", text: str = "text") -> Column:
    """Why a turn can't be rendered, or null."""
    return F.when((F.col(role) == "assistant") & (F.coalesce(text, F.lit("")) == ""), "empty assistant").when(~F.coalesce(F.col(role).isin("system", "user", "assistant"), F.lit(False)), F.concat(F.lit("unknown role: "), F.coalesce(role, F.lit("null"))))


def turn_text(role: str = "role", text: str = "text", images: Column | None = None) -> Column:
    """One rendered turn: no separators, one marker for each image of a user turn."""
    own = F.coalesce(F.col(text), F.lit(""))
    count = F.coalesce(images, F.lit(0)) if images is not None else F.lit(0)
    return (
        F.when(F.col(role) == "system", F.concat(F.lit(SYSTEM_OPEN), own, F.lit(SYSTEM_CLOSE)))
        .when(F.col(role) == "user", F.concat(F.lit(USER_OPEN), F.repeat(F.lit(IMAGE), count.cast("int")), own, F.lit(USER_CLOSE)))
        .when(F.col(role) == "assistant", F.concat(own, F.lit(END)))
    )


def render_conversations(turns: DataFrame, strict: bool = False, images: Column | None = None) -> DataFrame:
    """(conv_id, prompt, error): turns in order; a conversation with an error has no prompt, or fails in strict mode."""
    rows = turns.select("conv_id", "turn", turn_text(images=images).alias("s"), turn_error().alias("e"))
    by_turn = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c])
    out = rows.groupBy("conv_id").agg(F.array_join(by_turn("s"), "").alias("prompt"), F.min_by("e", F.when(F.col("e").isNotNull(), F.col("turn"))).alias("error"))
    if strict:
        return out.select("conv_id", F.when(F.col("error").isNotNull(), F.raise_error("error").cast("string")).otherwise(F.col("prompt")).alias("prompt"))
    return out.select("conv_id", F.when(F.col("error").isNull(), F.col("prompt")).alias("prompt"), "error")


def marker_pattern(markers=MARKERS) -> str:
    """Longest first, then in text order, so that ties are defined."""
    return "|".join(re.escape(m) for m in sorted(markers, key=lambda m: (-len(m), m)))


def split_markers(text: Column | str, markers=MARKERS) -> Column:
    """The text in parts: control markers, wherever they stand, and what is between them."""
    col = F.col(text) if isinstance(text, str) else text
    # a marker, or all up to the next one; possessive, so that long texts need no stack
    parts = F.regexp_extract_all(col, F.lit(f"(?s)(?:{marker_pattern(markers)})|(?:(?!{marker_pattern(markers)}).)++"), F.lit(0))
    return F.when(col == "", F.array().cast("array<string>")).when(has_marker(col, markers), parts).otherwise(F.array(col))


def has_marker(text: Column | str, markers=MARKERS) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return col.rlike(marker_pattern(markers))


def pre_tokens(text: Column | str) -> Column:
    """The pieces that are merged on their own; together they are the text again."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRE_TOKEN), F.lit(0))


def normal_piece(piece: Column | str) -> Column:
    """A vocabulary piece as a verdict form: trim white space, then quotes and stops, then lower."""
    col = F.col(piece) if isinstance(piece, str) else piece
    return F.lower(F.regexp_replace(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), r"^[\"'.]+|[\"'.]+$", ""))


def is_unsafe(score: Column | str, threshold: float = 0.5) -> Column:
    """Strictly above the threshold."""
    return (F.col(score) if isinstance(score, str) else score) > F.lit(threshold)


def verdict_text(score: str, yes: str, no: str) -> Column:
    """A verdict as text: the score with six decimals, the logits with four."""
    return F.format_string("%s score=%.6f (yes=%.4f no=%.4f)", F.when(is_unsafe(score), "UNSAFE").otherwise("safe"), score, yes, no)


def verdict_json(score: str, yes: str, no: str, prompt_tokens: Column, prefilled_tokens: Column, load_ms: Column, inference_ms: Column) -> Column:
    """A verdict as JSON with its eight keys; numbers as plain decimals."""
    shown = lambda c: F.col(c).cast("decimal(18,4)")
    fields = {"score": shown(score), "unsafe_verdict": is_unsafe(score), "yes_logit": shown(yes), "no_logit": shown(no), "prompt_tokens": prompt_tokens, "prefilled_tokens": prefilled_tokens, "load_ms": load_ms, "inference_ms": inference_ms}
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def human_bytes(n: Column | str) -> Column:
    """1024 steps up to GiB, one decimal above bytes."""
    x = (F.col(n) if isinstance(n, str) else n).cast("double")
    step = lambda k, unit: F.format_string(f"%.1f {unit}", x / F.lit(1024.0**k))
    return F.when(x < 1024, F.format_string("%.0f B", x)).when(x < 1024**2, step(1, "KiB")).when(x < 1024**3, step(2, "MiB")).otherwise(step(3, "GiB"))
