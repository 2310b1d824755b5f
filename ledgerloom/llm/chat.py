"""Chat formatting, on DataFrame functions alone: conversations of typed content parts as one text each.

A turn's content is a list of parts: text, image, audio, document. One visitor for each type
says what a part becomes: texts are escaped, all others become the placeholder of their type
with a reference to what is attached and the number of tokens that the placeholder will
be expanded to. The template marks where turns begin and end::

    <s>[SYS]be brief[/SYS][INST]what is this? [IMG][/INST]a cat</s>

Roles that the template does not know are written out: ``[ROLE]tool[TEXT]42[/ROLE]``. A control
string inside a text gets a backslash after its bracket, and one that has backslashes
there gets one more, so that ``[INST]`` is never a text's and unescaping takes one away.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's marks.
START = "<s>"
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("[SYS]", "[/SYS]")}
ROLE, TEXT, ROLE_END = "[ROLE]", "[TEXT]", "[/ROLE]"
PLACEHOLDERS = {"image": "[IMG]", "audio": "[AUDIO]", "document": "[DOC]"}
CONTROL = r"([<\[])(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|(?:TEXT|IMG|AUDIO|DOC)\])"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?(?:INST|SYS|ROLE)\]|(?:TEXT|IMG|AUDIO|DOC)\])"
TURN_END = r"\[/(?:INST|SYS|ROLE)\]|</s>"
PLACE = r"\[(?:IMG|AUDIO|DOC)\]"
#: The role whose texts are learnt from.
LEARNT = "assistant"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for: patches of an image, a rate of an audio, pages of a document."""

    patch: int = 28
    audio_rate: float = 12.5
    page: int = 768


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def text_parts(text: Column) -> Column:
    """One text part; null is the empty text."""
    whole = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(F.struct(*[whole.get(name, F.lit(None)).alias(name) for name in ("type", "text", "ref", "width", "height", "seconds", "pages")])).cast(PARTS)


def visitors(expansion: Expansion) -> dict[str, Callable[[Column], Column]]:
    """For each type of attachment, the tokens of a part; unknown sizes count as one patch, no time or one page."""
    patches = lambda n: F.ceil(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) / expansion.patch)
    return {
        "image": lambda p: patches(p["width"]) * patches(p["height"]),
        "audio": lambda p: F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * expansion.audio_rate),
        "document": lambda p: F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * expansion.page,
    }


def flattened(parts: Column, expansion: Expansion = Expansion()) -> tuple[Column, Column]:
    """Content and attachments of a turn's parts, both in the order of the parts.

    Texts that follow one another are one text, so that no control string can arise
    where two meet; parts of no known type count as text, null parts and texts as empty.
    """
    kept = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    attached = lambda p: F.coalesce(p["type"].isin(*PLACEHOLDERS), F.lit(False))
    by_type = lambda p, said: F.coalesce(*[F.when(p["type"] == name, what) for name, what in said.items()])
    places = F.filter(F.transform(kept, lambda p, i: F.when(attached(p), i)), lambda i: i.isNotNull())

    def stretch(j: Column) -> Column:
        """The texts between two attachments, and the placeholder that ends them."""
        low, high = F.coalesce(F.get(places, j - 1) + 1, F.lit(0)), F.coalesce(F.get(places, j), F.size(kept))
        text = F.array_join(F.transform(F.slice(kept, low + 1, high - low), lambda p: F.coalesce(p["text"], F.lit(""))), "")
        end = F.get(kept, high)
        return F.concat(escape(text), F.coalesce(by_type(end, {name: F.lit(mark) for name, mark in PLACEHOLDERS.items()}), F.lit("")))

    content = F.array_join(F.transform(F.sequence(F.lit(0), F.size(places)), stretch), "")
    rules = visitors(expansion)
    files = F.transform(F.filter(kept, attached), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), by_type(p, {name: rule(p) for name, rule in rules.items()}).cast("long").alias("tokens")))
    return content, files


def format_conversations(turns: DataFrame, expansion: Expansion = Expansion()) -> DataFrame:
    """One row per ``conv_id``: ``formatted``, ``loss_mask``, ``attachments`` and ``media_tokens``.

    ``turns`` has ``conv_id, turn, role`` and ``parts`` (or ``text``, which is one part); other
    columns are not looked at. Turns are put in order by ``turn``, null first, equal ones by what they
    say; rows that repeat stay. A null role is the empty one, a null text the empty text, null
    ``conv_id`` a conversation of its own; an empty table gives an empty result. The
    mask has a pair of lengths for each turn, code points to skip and then to learn, and what is
    left of the turn is not learnt. The i-th attachment belongs to the i-th placeholder.

    One shuffle, by conversation. A conversation is one row, as its text is one sample; all
    expressions over it are linear in its length.
    """
    parts = F.col("parts") if "parts" in turns.columns else text_parts(F.col("text"))
    content, files = flattened(parts, expansion)
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), files.alias("files"))
    other = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT))
    opened, closed = other, F.lit(ROLE_END)
    for role, (before, after) in TURNS.items():
        opened, closed = F.when(F.col("role") == role, before).otherwise(opened), F.when(F.col("role") == role, after).otherwise(closed)
    segment, learnt = F.concat(opened, "content", closed), F.col("role") == LEARNT
    skipped = F.when(learnt, F.length(opened)).otherwise(F.length(segment))
    rows = said.select("conv_id", F.struct("turn", segment.alias("segment"), skipped.alias("skip"), F.when(learnt, F.length("content")).otherwise(0).alias("learn"), "files").alias("x"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    files = F.flatten(F.transform("x", lambda t: t["files"]))
    return whole.select(
        "conv_id",
        F.concat(F.lit(START), F.array_join(F.transform("x", lambda t: t["segment"]), "")).alias("formatted"),
        F.transform("x", lambda t, i: F.struct((t["skip"] + F.when(i == 0, len(START)).otherwise(0)).alias("skip"), t["learn"].alias("learn"))).alias("loss_mask"),
        files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda s, f: s + f["tokens"]).alias("media_tokens"),
    )


def _segments(formatted: Column) -> Column:
    """The turns of a formatted text, without their end marks."""
    pieces = F.split(formatted, TURN_END, -1)
    return F.slice(pieces, 1, F.size(pieces) - 1)


def _plain(content: Column) -> Column:
    """The text of a content, without placeholders."""
    return F.array_join(F.transform(F.split(content, PLACE, -1), unescape), "")


def read_turns(formatted: Column) -> Column:
    """``role, text, attached`` (a number) of each turn, from the formatted text alone."""

    def turn(s: Column) -> Column:
        role, content = unescape(F.split(F.substr(s, F.lit(len(ROLE) + 1)), r"\[TEXT\]", 2)[0]), F.element_at(F.split(s, r"\[TEXT\]", 2), -1)
        known = F.lit(False)
        for name, (mark, _) in reversed(TURNS.items()):
            if mark:
                role, content = F.when(F.startswith(s, F.lit(mark)), F.lit(name)).otherwise(role), F.when(F.startswith(s, F.lit(mark)), F.substr(s, F.lit(len(mark) + 1))).otherwise(content)
                known |= F.startswith(s, F.lit(mark))
        known |= F.startswith(s, F.lit(ROLE))
        role, content = F.when(known, role).otherwise(F.lit("assistant")), F.when(known, content).otherwise(s)
        return F.struct(role.alias("role"), _plain(content).alias("text"), F.regexp_count(content, F.lit(PLACE)).alias("attached"))

    without_start = F.transform(_segments(formatted), lambda s, i: F.when(i == 0, F.substr(s, F.lit(len(START) + 1))).otherwise(s))
    return F.transform(without_start, turn)


def learnt_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped."""
    under = F.zip_with(_segments(formatted), loss_mask, lambda s, m: _plain(F.substr(s, m["skip"] + 1, m["learn"])))
    return F.array_join(under, "")


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted table says, read back from it: counts and digests of its turns and of what is learnt."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), learnt_text(F.col("formatted"), F.col("loss_mask")).alias("learnt"), "media_tokens")
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "media_tokens",
    )
