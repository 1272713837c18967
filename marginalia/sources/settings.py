"""Settings in a JSON file: absent keys keep their defaults, unknown ones are kept on saving."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace

RESERVED = ("obsidian", "calibre")


@dataclass(frozen=True)
class Search:
    top_k: int = 10
    rrf_k: int = 60
    vector_weight: float = 0.7
    fts_weight: float = 0.3


@dataclass(frozen=True)
class Settings:
    """A snapshot; a change makes another one."""

    embedding_batch_size: int = 32
    chunk_size: int = 500
    chunk_overlap: int = 50
    vaults: tuple[str, ...] = ()
    vault_exclude: tuple[str, ...] = ()
    project_exclude: tuple[str, ...] = ("node_modules",)
    repository_exclude: tuple[str, ...] = ()
    catalogs: tuple[str, ...] = ()
    repositories: dict[str, list[str]] = field(default_factory=dict)
    projects: dict[str, list[str]] = field(default_factory=dict)
    disabled_collections: tuple[str, ...] = ()
    git_history_months: int = 6
    subject_blacklist: tuple[str, ...] = ()
    allow_write: bool = False
    ocr_languages: tuple[str, ...] = ("eng",)
    search: Search = Search()

    def name_conflicts(self) -> dict[str, list[str]]:
        """Names that repositories, projects or reserved collections claim more than once."""
        kinds: dict[str, set[str]] = {}
        for kind, names in (("repositories", self.repositories), ("projects", self.projects)):
            for name in names:
                kinds.setdefault(name, set()).update({kind, "system collections"} if name in RESERVED else {kind})
        return {name: sorted(k) for name, k in sorted(kinds.items()) if len(k) > 1}

    def with_path(self, kind: str, path: str, name: str = "") -> Settings:
        """Adds a vault, a catalog, or a path of a project or repository, once."""
        if kind in ("vault", "catalog"):
            key = f"{kind}s"
            held = getattr(self, key)
            return self if path in held else replace(self, **{key: (*held, path)})
        key = {"project": "projects", "repo": "repositories"}[kind]
        held = getattr(self, key)
        own = held.get(name, [])
        return replace(self, **{key: {**held, name: own if path in own else [*own, path]}})

    def without_path(self, kind: str, path: str, name: str = "") -> Settings:
        if kind in ("vault", "catalog"):
            key = f"{kind}s"
            return replace(self, **{key: tuple(p for p in getattr(self, key) if p != path)})
        key = {"project": "projects", "repo": "repositories"}[kind]
        held = getattr(self, key)
        return replace(self, **{key: {**held, name: [p for p in held.get(name, []) if p != path]}})

    def with_enabled(self, name: str, on: bool) -> Settings:
        rest = tuple(n for n in self.disabled_collections if n != name)
        return replace(self, disabled_collections=rest if on else (*rest, name))


def languages(names: list[str]) -> tuple[str, ...]:
    """Lower case, trimmed, each once; English if none is left."""
    return tuple(dict.fromkeys(n.strip().lower() for n in names if n.strip())) or ("eng",)


def load(path: str) -> Settings:
    """A file that is missing or isn't JSON gives the defaults."""
    try:
        with open(os.path.expanduser(path), encoding="utf-8") as file:
            held = json.load(file)
    except (OSError, ValueError):
        return Settings()
    if not isinstance(held, dict):
        return Settings()
    own = {}
    for f in fields(Settings):
        value = held.get(f.name)
        if value is None:
            continue
        if f.name == "search":
            value = Search(**{k: v for k, v in value.items() if k in Search.__dataclass_fields__})
        elif f.name == "ocr_languages":
            value = languages(value)
        elif isinstance(value, list):
            value = tuple(os.path.expanduser(x) if f.name in ("vaults", "catalogs") else x for x in value)
        elif isinstance(value, dict):
            value = {k: [os.path.expanduser(p) for p in v or []] for k, v in value.items()}
        own[f.name] = value
    return Settings(**own)


def save(settings: Settings, path: str) -> None:
    """Keys of the file that aren't settings stay."""
    held = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
    whole = {**held, **asdict(settings)}
    with open(f"{path}.new", "w", encoding="utf-8") as file:
        json.dump(whole, file, indent=2, ensure_ascii=False)
    os.replace(f"{path}.new", path)
