"""A collection's root, settings, domains and templates: a few rows, read on the driver."""

from __future__ import annotations

import copy
import json
import math
import os
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from marginalia.functions import frontmatter
from marginalia.functions.scalar import IGNORED_FOLDERS, MANIFEST
from marginalia.operators.search import LAYER, STATUS, TRUST

SETTINGS, ROOT_VARIABLE, MARKERS = "marginalia.json", "MARGINALIA_ROOT", ("marginalia.json", "wiki")
RESERVED = ("raw", "log")
#: The suffixes of raw files that are read as text, and how a file is known to be unchanged.
TEXT_SUFFIXES = (".md", ".markdown", ".txt", ".rst", ".csv")
INTEGRITY = ("stat", "hash")
DEFAULTS: dict[str, Any] = {"vault_name": "vault", "raw_text_extensions": list(TEXT_SUFFIXES), "integrity": "stat", "ranking": {"trust": TRUST, "status": STATUS, "domain": LAYER}, "identities": {}, "log_rotate_bytes": 262_144}


class SettingsError(ValueError):
    pass


def find_root(start: str | None = None) -> Path | None:
    """The root that is named, else the one in the environment (which must be one), else the nearest folder upwards that has a marker."""
    if start is None and (named := os.environ.get(ROOT_VARIABLE)):
        root = Path(named)
        if not any((root / m).exists() for m in MARKERS):
            raise SettingsError(f"{ROOT_VARIABLE} names '{named}', which is no collection")
        return root
    here = Path(start or ".").resolve()
    return next((p for p in (here, *here.parents) if any((p / m).exists() for m in MARKERS)), None)


def _like(value: Any, default: Any) -> bool:
    if isinstance(default, bool) or isinstance(value, bool):
        return isinstance(value, bool) and isinstance(default, bool)
    return isinstance(value, (int, float)) if isinstance(default, float) else isinstance(value, type(default))


def settings(text: str | None) -> dict[str, Any]:
    """The defaults with a JSON object's values over them, its tables merged; keys that aren't known stay."""
    found = copy.deepcopy(DEFAULTS)
    try:
        given = json.loads((text or "{}").removeprefix("\ufeff"))
    except ValueError as e:
        raise SettingsError(f"settings aren't JSON: {e}") from e
    if not isinstance(given, dict):
        raise SettingsError("settings are no object")

    def merge(into: dict, over: dict, path: str, closed: bool) -> None:
        for key, value in over.items():
            if closed and key in into and not _like(value, into[key]):
                raise SettingsError(f"'{path}{key}' must be like {json.dumps(into[key])[:40]}")
            if isinstance(value, dict) and isinstance(into.get(key), dict):
                merge(into[key], value, f"{path}{key}.", path == "" and key == "ranking")
            else:
                into[key] = value

    merge(found, given, "", True)
    rules = [
        (found["integrity"] in INTEGRITY, "integrity"),
        (isinstance(found["log_rotate_bytes"], int) and found["log_rotate_bytes"] > 0, "log_rotate_bytes"),
        (all(isinstance(x, str) for x in found["raw_text_extensions"]), "raw_text_extensions"),
        *((isinstance(v, list) and all(isinstance(x, str) for x in v), f"identities.{k}") for k, v in found["identities"].items()),
        *((not isinstance(v, bool) and isinstance(v, (int, float)) and math.isfinite(v), f"ranking.{t}.{k}") for t in ("trust", "status", "domain") for k, v in found["ranking"][t].items()),
    ]
    for fine, key in rules:
        if not fine:
            raise SettingsError(f"'{key}' has no value that can be used")
    return found


def load_settings(root: str | Path) -> dict[str, Any]:
    file = Path(root) / SETTINGS
    return settings(file.read_text("utf-8") if file.exists() else None)


@dataclass
class Domain:
    name: str
    description: str
    allowed_types: list[str] | None = None
    require_sources: bool = False
    directives: str = ""
    manifest_path: str | None = None
    manifest_error: str | None = None
    extra: dict[str, Any] = field(default_factory=dict)


def domain(name: str, manifest: str | None = None) -> Domain:
    """A domain as its manifest says; one that can't be followed leaves the domain open and says why."""
    found = Domain(name, f"{name.capitalize()} domain", manifest_path=f"{name}/{MANIFEST}" if manifest is not None else None)
    if manifest is None:
        return found
    try:
        header, body = frontmatter.split(manifest)
        said = frontmatter.parse(header or "")
    except frontmatter.HeaderError as e:
        found.directives, found.manifest_error = manifest.strip(), f"its header can't be read: {e.reason}"
        return found
    faults = []
    types, required = said.get("allowed_types"), said.get("require_sources", False)
    if types is not None and not (isinstance(types, list) and all(isinstance(t, str) for t in types)):
        faults, types = ["allowed_types is no list of strings"], None
    if not isinstance(required, bool):
        faults, required = [*faults, "require_sources is neither true nor false"], False
    if said.get("domain", name) != name:
        faults.append(f"domain '{said['domain']}' isn't the folder '{name}'")
    found.description = str(said.get("description") or found.description)
    found.allowed_types, found.require_sources, found.directives, found.manifest_error = types, required, body.strip(), "; ".join(faults) or None
    return found


def excluded(folder: str) -> bool:
    return folder.startswith(".") or folder in IGNORED_FOLDERS


def discover(root: str | Path, templates: str | None = None) -> list[Domain]:
    """The wiki, and every folder at the top that holds neither raw files, nor logs, nor templates."""
    top = Path(root)
    names = {p.name for p in top.iterdir() if p.is_dir() and not excluded(p.name) and p.name not in RESERVED and p.name != (templates or "").strip("/")} if top.exists() else set()
    files = {n: top / n / MANIFEST for n in sorted({"wiki"} | names)}
    return [domain(n, f.read_text("utf-8", "replace") if f.exists() else None) for n, f in files.items()]


def domain_table(spark: SparkSession, domains: list[Domain]) -> DataFrame:
    """layer, description, allowed, require_sources, manifest_path, manifest_error: a row for each folder at the top."""
    rows = [(d.name, d.description, d.allowed_types, d.require_sources, d.manifest_path, d.manifest_error) for d in domains]
    return spark.createDataFrame(rows, "layer string, description string, allowed array<string>, require_sources boolean, manifest_path string, manifest_error string")


def template(root: str | Path, folder: str, name: str) -> str:
    """A template's body; its name stays within the folder."""
    file = name.replace("\\", "/").strip("/")
    parts = (file if file.endswith(".md") else f"{file}.md").split("/")
    if not file or name[:1] in ("/", "\\") or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"'{name}' names no template")
    text = Path(root, folder, *parts).read_text("utf-8")
    return frontmatter.parsed(text)["body"]
