"""Tidy titles and descriptions (K7) and what that changes (K8): one ordered table of edits over two text columns.

An edit names the column it rewrites, the rows it is for, and the new text as a native expression of the row's texts as they
are by then: one projection an edit, no shuffle."""
from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Action verbs a clean title starts with, in this order.
ACTION_VERBS = (
    "Add", "Fix", "Remove", "Update", "Implement", "Refactor", "Create",
    "Delete", "Move", "Rename", "Extract", "Merge", "Split", "Optimize",
    "Improve", "Enable", "Disable", "Configure", "Set up", "Clean up",
    "Migrate", "Convert", "Replace", "Integrate", "Support", "Handle",
    "Validate", "Test", "Document", "Deploy", "Build", "Install", "Show",
    "Hide", "Display", "Prevent", "Allow", "Ensure", "Make", "Use",
    "Change", "Modify", "Adjust", "Apply", "Load", "Save", "Export",
    "Import", "Fetch", "Send", "Parse", "Format", "Render", "Generate",
)
# Keyword -> suggested verb; the first keyword found (in this order) wins.
VERB_SUGGESTIONS = (
    ("bug", "Fix"), ("error", "Fix"), ("broken", "Fix"), ("crash", "Fix"), ("issue", "Fix"),
    ("problem", "Fix"), ("wrong", "Fix"), ("new", "Add"), ("feature", "Add"), ("missing", "Add"),
    ("need", "Add"), ("want", "Add"), ("get rid", "Remove"), ("delete", "Remove"),
    ("superfluous", "Remove"), ("unnecessary", "Remove"), ("redundant", "Remove"), ("unused", "Remove"),
    ("change", "Update"), ("modify", "Update"), ("edit", "Update"), ("clean", "Refactor"),
    ("cleanup", "Refactor"), ("restructure", "Refactor"), ("reorganize", "Refactor"), ("slow", "Optimize"),
    ("performance", "Optimize"), ("fast", "Optimize"), ("speed", "Optimize"),
)
DEFAULT_VERB = "Implement"
# Fixed value: lead-in words removed before a verb is put in front.
LEAD_INS = r"(?i)^(the|a|an|we need to|we should|should|need to|must)\s+"

# Spacing rules of the clean-up (pattern, replacement), applied in this order.
SPACING = ((" +", " "), (r" ([.,!?;:])", "$1"), (r"([.,!?;:])([A-Za-z])", "$1 $2"), (r"(?U)^\s+|\s+$", ""))

class Edit(NamedTuple):
    target: str
    rows: Column | None      # all rows where it is None
    text: Column


def _now(name: str) -> Column:
    return F.col(f"__{name}")


def _first_letter(case: Callable, text: Column) -> Column:
    return F.concat(case(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)))


def _swap(target: str, pattern: str, replacement: str, rows: Column | None = None) -> Edit:
    return Edit(target, rows, F.regexp_replace(_now(target), pattern, replacement))


def _begins_with_verb() -> Column:
    """A bare prefix, whatever its case."""
    title, found = F.lower(_now("title")), F.lit(False)
    for verb in ACTION_VERBS:
        found = found | title.startswith(verb.lower())
    return found


def _fitting_verb() -> Column:
    words = F.lower(F.concat_ws(" ", _now("title"), _now("given")))
    return F.coalesce(*[F.when(words.contains(keyword), verb) for keyword, verb in VERB_SUGGESTIONS], F.lit(DEFAULT_VERB))


def edits() -> list[Edit]:
    """The edits in order. ``given`` is the description as it came; ``has_verb`` and ``verb`` are what the spaced title says."""
    verbless = ~_now("has_verb")
    return [
        *[_swap(target, *rule) for target in ("title", "description") for rule in SPACING],
        Edit("has_verb", None, _begins_with_verb()),
        Edit("verb", None, _fitting_verb()),
        _swap("title", LEAD_INS, "", verbless),
        Edit("title", verbless, F.rtrim(F.concat(_now("verb"), F.lit(" "), _first_letter(F.lower, _now("title"))))),
        Edit("title", None, _first_letter(F.upper, _now("title"))),
        _swap("title", r"\.+$", ""),
        Edit("description", None, _first_letter(F.upper, _now("description"))),
        Edit("description", _now("description").rlike(r"[^.!?]\z"), F.concat(_now("description"), F.lit("."))),
    ]


def _edited(df: DataFrame, title: str, description: str) -> DataFrame:
    empty = F.lit("")
    out = df.withColumns({"__title": F.coalesce(F.col(title), empty), "__description": F.coalesce(F.col(description), empty),
                          "__given": F.coalesce(F.col(description), empty)})
    for edit in edits():
        new = edit.text if edit.rows is None else F.when(edit.rows, edit.text).otherwise(_now(edit.target))
        out = out.withColumn(f"__{edit.target}", new)
    return out


def tidy(df: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """K7: both columns tidied, all others as they are. Nulls count as empty texts; an empty description stays empty."""
    new = {title: _now("title"), description: _now("description")}
    return _edited(df, title, description).select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])


def changes(df: DataFrame, id_col: str = "id", title: str = "title", description: str = "description") -> DataFrame:
    """K8: (id, field, before, after) of every text that ``tidy`` changes."""
    both = F.array(*[F.struct(F.lit(field).alias("field"), F.col(c).alias("before"), _now(field).alias("after"))
                     for field, c in (("title", title), ("description", description))])
    return _edited(df, title, description).select(id_col, F.inline(both)).where(~F.equal_null("before", "after"))
