"""String expressions shared by rendering, prompts and answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseweave.fixed import RENDER_CLIP, RENDER_KEYS

# All characters Unicode calls white space, plus the four ASCII separators.
WHITESPACE = "".join(map(chr, [
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

# fixed values: what stands for nothing
NO_DETAILS, NO_TEXT = "no details", "(no text)"


def base_case(case_id: Column) -> Column:
    """Part of an occurrence id shared by all occurrences of one case."""
    return F.split_part(case_id, F.lit("__"), F.lit(1))


def span_index(stable_id: Column) -> Column:
    """Trailing ``__s<n>`` of an id, 0 when there is none."""
    # the leading zero makes "no digits" a number: a failing cast is caught, but slow
    digits = F.concat(F.lit("0"), F.regexp_extract(stable_id, r"__s(\d+)$", 1))
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def strip(text: Column) -> Column:
    """Trim every kind of whitespace; plain ``trim`` takes spaces only."""
    return F.trim(text, F.lit(WHITESPACE))


def clip(text: Column, limit: int) -> Column:
    # every operand is always evaluated, so the text is computed once per row
    return F.concat(
        F.left(text, F.lit(limit)), F.repeat(F.lit("…"), (F.length(text) > limit).cast("int"))
    )


def present(props: Column, key: str) -> Column:
    """A property, NULL when it is missing or empty."""
    return F.nullif(F.try_element_at(props, F.lit(key)), F.lit(""))


def listed_props(value: Callable[[str], Column]) -> Column:
    """Rendered properties in their fixed order, empty when there are none; *value* gives one by its key."""
    parts = []
    for key in RENDER_KEYS:
        shown = clip(value(key), RENDER_CLIP)
        if key == "name":
            parts.append(shown)
        elif key == "text":
            parts.append(F.concat(F.lit('"'), shown, F.lit('"')))
        else:
            parts.append(F.concat(F.lit(f"{key}="), shown))
    return F.concat_ws(" | ", *parts)


def format_props(props: Column) -> Column:
    """Rendered properties in their fixed order, ``no details`` when there are none."""
    listed = listed_props(lambda key: present(props, key))
    return F.coalesce(F.nullif(listed, F.lit("")), F.lit(NO_DETAILS))


def stripped_text(value: Callable[[str], Column]) -> Column:
    """``text``, else ``name``, else nothing, without white space around."""
    return strip(F.coalesce(value("text"), value("name"), F.lit("")))


def quoted_text(props: Column) -> Column:
    """Quoted ``text``, else ``name``, else a placeholder."""
    text = stripped_text(lambda key: present(props, key))
    shown = F.coalesce(F.nullif(clip(text, RENDER_CLIP), F.lit("")), F.lit(NO_TEXT))
    return F.concat(F.lit('"'), shown, F.lit('"'))


def evidence_place(is_anchor: Column, span: Column) -> Column:
    """What follows the text of an evidence node."""
    origin = F.when(is_anchor, ", this email").otherwise(", other")
    position = F.when(span > 0, F.concat(F.lit(", span="), span)).otherwise("")
    return F.concat(origin, position)


def evidence_details(props: Column, is_anchor: Column, span: Column) -> Column:
    return F.concat(quoted_text(props), evidence_place(is_anchor, span))


def objects_list(pipe_objects: Column) -> Column:
    """``a| b ||c`` becomes ``a, b, c``."""
    parts = F.transform(F.split(F.coalesce(pipe_objects, F.lit("")), r"\|"), strip)
    return F.array_join(F.filter(parts, lambda x: x != ""), ", ")


def strip_timeline_header(timeline: Column) -> Column:
    """Drop the generator's instruction lines and the blank lines at both ends."""
    # every line boundary of Unicode text
    lines = F.split(timeline, r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")
    kept = F.filter(
        lines,
        lambda x: ~F.contains(x, F.lit("use BOTH sides"))
        & ~F.startswith(x, F.lit("OBSERVED CASE TIMELINE")),
    )
    return strip(F.array_join(kept, "\n"))


def timeline_text(timeline: Column, use_timeline: bool, who: Column) -> Column:
    """Timeline shown in a prompt: empty when withheld, an error when it is missing."""
    if not use_timeline:
        return F.lit("")
    missing = F.raise_error(
        F.concat(F.lit("record "), F.coalesce(who, F.lit("?")), F.lit(" is missing observed_timeline"))
    ).cast("string")
    return F.when(timeline.isNull(), missing).otherwise(strip_timeline_header(timeline))
