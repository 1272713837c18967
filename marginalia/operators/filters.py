"""Structured filters as predicates over chunks that carry their source and collection."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import metadata as md
from ..functions import text as tx

COLLECTION_TYPES = ("system", "project", "code")


@dataclass(frozen=True)
class Filters:
    collection: str = ""
    source_type: str = ""
    path: str = ""
    date_from: str = ""
    date_to: str = ""
    sender: str = ""
    author: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    top_k: int = 0

    def any(self) -> bool:
        """Whether rows are filtered; top_k doesn't count."""
        return bool(self.collection or self.source_type or self.path or self.date_from or self.date_to or self.sender or self.author or self.metadata)

    def predicate(self) -> Column | None:
        parts = []
        if self.collection:
            parts.append(in_collection(self.collection))
        if self.source_type:
            parts.append(F.col("source_type") == self.source_type)
        if self.path:
            parts.append(tx.contains_lower("source_path", self.path))
        if self.sender:
            parts.append(F.contains(F.lower(F.coalesce(md.field("metadata", "sender"), F.lit(""))), F.lit(self.sender.lower())))
        if self.author:
            parts.append(by_author(self.author))
        if self.date_from or self.date_to:
            parts.append(in_days(self.date_from, self.date_to))
        parts += [has_value(k, v) for k, v in self.metadata.items()]
        return conjunction(parts)


def conjunction(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, parts) if parts else None


def in_collection(value: str) -> Column:
    """The name of a type stands for all collections of the type."""
    return F.col("collection_type") == value if value in COLLECTION_TYPES else F.col("collection") == value


def by_author(author: str) -> Column:
    own = md.field("metadata", "authors")
    names = F.when(F.startswith(own, F.lit("[")), F.from_json(own, "array<string>"))
    return F.coalesce(F.exists(names, lambda a: F.contains(F.lower(a), F.lit(author.lower()))), F.lit(False))


def in_days(date_from: str, date_to: str) -> Column:
    """Days compare as strings; a chunk without a date passes."""
    own = tx.day(md.own_date("metadata"))
    parts = [own >= date_from[:10]] if date_from else []
    parts += [own <= date_to[:10]] if date_to else []
    return own.isNull() | conjunction(parts)


def has_value(key: str, value: str) -> Column:
    """A string or any string of an array contains the value, whatever the case; anything else equals it as text."""
    own = md.field("metadata", key)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("metadata"), f"$['{key}']", "variant"))
    inside = F.contains(F.lower(own), F.lit(value.lower()))
    elements = F.exists(F.coalesce(F.from_json(own, "array<string>"), F.array().cast("array<string>")), lambda x: F.contains(F.lower(x), F.lit(value.lower())))
    test = F.when(kind == "STRING", inside).when(F.startswith(own, F.lit("[")), elements).otherwise(own == value)
    return F.coalesce(test, F.lit(False))


def not_blacklisted(subject: Column, prefixes: list[str]) -> Column:
    """No prefix leads the subject."""
    return ~reduce(lambda a, b: a | b, [F.startswith(subject, F.lit(p)) for p in prefixes], F.lit(False))


def enabled(name: Column, disabled: list[str]) -> Column:
    return ~name.isin(disabled) if disabled else F.lit(True)
