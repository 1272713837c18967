"""Functions over the JSON object of a chunk. An empty string is no metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OTHER_DATES = ("date", "author_date")


def field(metadata: Column | str, key: str) -> Column:
    return F.get_json_object(metadata, f"$['{key}']")


def keys(metadata: Column | str) -> Column:
    return F.coalesce(F.json_object_keys(metadata), F.array().cast("array<string>"))


def values(metadata: Column | str, key: str) -> Column:
    """Elements of an array, or the one scalar, as strings; missing gives none."""
    own = field(metadata, key)
    return F.when(own.isNull(), F.array().cast("array<string>")).when(F.startswith(own, F.lit("[")), F.coalesce(F.from_json(own, "array<string>"), F.array(own))).otherwise(F.array(own))


def own_date(metadata: Column | str) -> Column:
    """``date``, else ``author_date``; empty counts as missing."""
    return F.coalesce(*[F.nullif(field(metadata, k), F.lit("")) for k in OTHER_DATES])


def merged(item: dict | None, chunk: dict | None) -> dict:
    """Metadata of an item with that of a chunk on top."""
    return {**(item or {}), **(chunk or {})}


def repo_count(description: Column) -> Column:
    """Distinct repositories of a watermark map; null if it isn't one."""
    held = F.from_json(description, "map<string,string>")
    return F.when(F.startswith(description, F.lit("{")), F.size(F.array_distinct(F.transform(F.map_keys(held), lambda k: F.regexp_replace(k, ":history$", "")))))


def described(description: Column) -> Column:
    """What a collection's description says to a reader: a count of repositories, or the text."""
    n = repo_count(description)
    return F.when(n.isNotNull(), F.concat(n.cast("string"), F.when(n == 1, F.lit(" repository")).otherwise(F.lit(" repositories")))).otherwise(description)


def watermarks(description: Column) -> Column:
    """MAP of repository to commit; the older form ``git:path:sha`` is read too."""
    old = F.regexp_extract(description, r"^git:(.+):([0-9a-f]+)$", 1)
    return F.when(F.startswith(description, F.lit("{")), F.from_json(description, "map<string,string>")).when(
        old != "", F.create_map(old, F.regexp_extract(description, r"^git:(.+):([0-9a-f]+)$", 2))
    )


def source_uri(path: Column, source_type: Column, metadata: Column, vaults: dict[str, str] | None = None) -> Column:
    """Where a source opens: its own url; nothing for commits and catalogs; the vault's, the editor's, or the file's."""
    rules = F.when(F.coalesce(field(metadata, "url"), F.lit("")) != "", field(metadata, "url"))
    none = F.lit(None).cast("string")
    rules = rules.when((source_type == "commit") | F.startswith(path, F.lit("git://")) | F.startswith(path, F.lit("calibre://")), none)
    for root, name in (vaults or {}).items():
        inside = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.char_length(path))
        rules = rules.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.concat(F.lit("obsidian://open?vault="), F.url_encode(F.lit(name)), F.lit("&file="), F.url_encode(inside)))
    line = F.coalesce(field(metadata, "start_line"), F.lit("1"))
    rules = rules.when(source_type == "code", F.concat(F.lit("vscode://file"), path, F.lit(":"), line))
    return rules.otherwise(F.concat(F.lit("file://"), path))
