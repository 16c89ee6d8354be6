"""Classification by ordered rules, folded into one conditional expression.

A rule is a label and a regular expression. Single labels take the first rule
that matches; type labels take all. The path decides where it can, and the
names of the files inside are asked only for what the path leaves open: the
faction first, over path, then names, and any faction decides the category.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import GENERIC, HAYSTACK_CAP, IGNORED_DIRS, IGNORED_PREFIXES
from .scalars import backslashed, last, segments, stem, ws_trim

Pairs = list[tuple[str, str]]


@dataclass
class Rules:
    categories: Pairs = field(default_factory=list)
    factions: Pairs = field(default_factory=list)
    types: Pairs = field(default_factory=list)
    sources: Pairs = field(default_factory=list)
    war_pattern: str = ""
    war_category: str = "Wargaming"
    default_category: str = "Uncategorised"
    match_filenames: bool = True
    generic: tuple[str, ...] = GENERIC
    ignored_dirs: tuple[str, ...] = IGNORED_DIRS
    ignored_prefixes: tuple[str, ...] = IGNORED_PREFIXES
    style: dict = field(default_factory=dict)


def load_rules(spark: SparkSession, shipped: str | None, local: str | None = None) -> Rules:
    """Rules from a JSON text, overlaid by a local one key by key; a broken text
    gives a warning and counts as empty."""
    merged: dict = {}
    for text in (shipped, local):
        if not text:
            continue
        try:
            part = json.loads(text)
            merged |= part if isinstance(part, dict) else {}
        except ValueError as error:
            warnings.warn(f"rules ignored: {error}", stacklevel=2)

    def pairs(key: str) -> Pairs:
        part = merged.get(key)
        found = [(k, v) for k, v in part.items() if not k.startswith("_") and isinstance(v, str)] if isinstance(part, dict) else []
        return [(k, v) for k, v in found if valid(spark, v)]

    def names(key: str, default: tuple[str, ...], clean=lambda x: x) -> tuple[str, ...]:
        """A list takes the place of the default, an empty one too; anything else doesn't."""
        part = merged.get(key)
        return tuple(clean(x) for x in part if isinstance(x, str)) if isinstance(part, list) else default

    style = merged.get("thumbnail_style")
    war = merged.get("wargaming_keywords") or ""
    generic = tuple(g.strip().lower() for g in merged.get("generic_folder_names") or [] if isinstance(g, str))
    return Rules(
        pairs("categories"), pairs("factions"), pairs("types"), pairs("sources"), war if war and valid(spark, war) else "",
        merged.get("wargaming_category", "Wargaming"), merged.get("default_category", "Uncategorised"), bool(merged.get("match_filenames", True)), generic or GENERIC,
        names("ignore_folders", IGNORED_DIRS, lambda x: x.strip().lower()), names("ignore_file_prefixes", IGNORED_PREFIXES), style if isinstance(style, dict) else {},
    )


def valid(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine's own regular expressions take ``pattern``; empty ones never match."""
    if not pattern:
        return False
    try:
        spark._jvm.java.util.regex.Pattern.compile(f"(?iu){pattern}")
    except Exception as error:  # the JVM's syntax error, whatever wraps it
        warnings.warn(f"pattern ignored: {pattern[:40]} ({type(error).__name__})", stacklevel=2)
        return False
    return True


def hit(hay: Column, pattern: str) -> Column:
    return hay.rlike(f"(?iu){pattern}")


def first_match(pairs: Pairs, hay: Column) -> Column:
    """The label of the first rule that matches, else null."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(hit(hay, p), F.lit(label)) for label, p in pairs])


def all_matches(pairs: Pairs, hay: Column) -> Column:
    """The labels of all rules that match, in the order of the rules."""
    if not pairs:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(hit(hay, p), F.lit(label)) for label, p in pairs]))


def haystack(files: Column | str, cap: int = HAYSTACK_CAP) -> Column:
    """Distinct lower-case stems joined by spaces, up to and with the stem at
    which the length reaches ``cap``, one more for each stem."""
    files = F.col(files) if isinstance(files, str) else files
    stems = F.filter(F.array_distinct(F.transform(files, lambda f: ws_trim(F.lower(stem(f))))), lambda s: s != "")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("s"))
    grown = F.aggregate(stems, start, lambda a, s: F.when(a["n"] >= cap, a).otherwise(F.struct((a["n"] + F.length(s) + 1).alias("n"), F.concat(a["s"], F.array(s)).alias("s"))))
    return F.coalesce(F.array_join(grown["s"], " "), F.lit(""))


def classified(rules: Rules, path: Column | str, name: Column | str, files: Column | str | None) -> dict[str, Column]:
    """category, faction and labels (faction and type tags) as columns."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    own = F.lower(F.concat(col(path), F.lit(" "), col(name)))
    inner = haystack(files) if files is not None and rules.match_filenames else F.lit("")
    asked = inner != ""
    fallback = lambda pairs: F.when(asked, first_match(pairs, inner))
    faction = F.coalesce(first_match(rules.factions, own), fallback(rules.factions))
    war = faction.isNotNull()
    if rules.war_pattern:
        war = war | hit(own, rules.war_pattern) | (asked & hit(inner, rules.war_pattern))
    category = F.when(war, F.lit(rules.war_category)).otherwise(F.coalesce(first_match(rules.categories, own), fallback(rules.categories)))
    types = all_matches(rules.types, own)
    types = F.when(F.size(types) > 0, types).when(asked, all_matches(rules.types, inner)).otherwise(types)
    return {
        "category": F.coalesce(F.nullif(category, F.lit("")), F.lit(rules.default_category)),
        "faction": faction,
        "labels": F.concat(F.array_compact(F.array(F.concat(F.lit("faction:"), faction))), F.transform(types, lambda t: F.concat(F.lit("type:"), t))),
    }


def source_label(rules: Rules, path: Column | str, root: Column | None = None) -> Column:
    """Where an item came from: a rule's label, the name of the longest root
    around it (``root``), the last segment but one, or the only one."""
    col = F.col(path) if isinstance(path, str) else path
    parts = segments(col)
    named = last(segments(root)) if root is not None else F.lit(None).cast("string")
    return F.coalesce(first_match(rules.sources, col), named, last(parts, 2), last(parts), F.lit("unknown"))


def item_tags(labels: Column, formats: Column, source: Column, packed: Column) -> Column:
    return F.concat(
        labels, F.transform(F.coalesce(formats, F.array().cast("array<string>")), lambda f: F.concat(F.lit("format:"), f)),
        F.array(F.concat(F.lit("source:"), source), F.concat(F.lit("packed:"), packed.cast("string"))),
    )


__all__ = ["Rules", "all_matches", "backslashed", "classified", "first_match", "haystack", "hit", "item_tags", "load_rules", "source_label", "valid"]
