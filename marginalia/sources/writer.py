"""Writes to a collection: single files, atomically, under a lock, each with a line in the ledger.

These act on a few files at a time and run on the driver; the tables follow by
the next change detection.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from marginalia.functions import frontmatter, markdown
from marginalia.functions.scalar import ACTOR, STATUSES
from marginalia.sources import vault

#: Seconds that a lock is waited for, and after which it is stale; fields that only the engine writes.
LOCK_WAIT, LOCK_STALE = 60.0, 60.0
OWNED = ("verified", "generated")
TEXT_FIELDS = ("title", "description", "type", "status")


class Refused(PermissionError):
    pass


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def file_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def body_hash(body: str) -> str:
    """The same as the column function: line ends made one kind, lines stripped at their ends, blank edge lines dropped."""
    lines = [x.rstrip() for x in body.replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "sha256:" + hashlib.sha256("\n".join(lines).encode()).hexdigest()


def inside(root: Path, rel: str) -> Path:
    """The file of a path that lies in the collection, also where its folders are links."""
    path = root / rel
    if not path.resolve().is_relative_to(root.resolve()):
        raise Refused(f"'{rel}' lies outside the collection")
    return path


def write(path: Path, data: str | bytes, expected: str | None = None) -> None:
    """Replaces a file at once, if it still has the expected hash; who may read and write it stays."""
    path.parent.mkdir(parents=True, exist_ok=True)
    if expected is not None and (file_hash(path.read_bytes()) if path.exists() else "") != expected:
        raise FileExistsError(f"{path.name} changed meanwhile")
    handle, temporary = tempfile.mkstemp(dir=path.parent, prefix=".write-")
    try:
        with os.fdopen(handle, "wb") as f:
            mask = os.umask(0)
            os.umask(mask)
            os.fchmod(f.fileno(), path.stat().st_mode & 0o7777 if path.exists() else 0o666 & ~mask)
            f.write(data if isinstance(data, bytes) else data.encode())
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(temporary)
        raise


@contextlib.contextmanager
def _guard(path: Path) -> Iterator[None]:
    """Who takes a lock file away does so alone."""
    with open(path.with_name(".lock-guard"), "a") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def _is_stale(path: Path, stale: float) -> bool:
    with contextlib.suppress(FileNotFoundError, ValueError):
        holder, age = int((path.read_text() or "0").split()[0]), time.time() - path.stat().st_mtime
        return age > stale or bool(holder and not os.path.exists(f"/proc/{holder}") and os.path.isdir("/proc"))
    return False


@contextlib.contextmanager
def lock(root: Path, wait: float = LOCK_WAIT, stale: float = LOCK_STALE) -> Iterator[None]:
    """Holds the collection's lock file; one whose holder is gone, or that is too old, is broken.

    A lock is judged again before it is taken away, and its holder takes away no other's.
    """
    path, until, own = root / "log" / ".lock", time.monotonic() + wait, f"{os.getpid()} {uuid.uuid4().hex}"
    path.parent.mkdir(parents=True, exist_ok=True)
    while True:
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o666)
            break
        except FileExistsError:
            if _is_stale(path, stale):
                with _guard(path):
                    if _is_stale(path, stale):
                        path.unlink()
                continue
            if time.monotonic() > until:
                raise TimeoutError("another process holds the lock") from None
            time.sleep(0.02)
    try:
        os.write(handle, own.encode())
        os.close(handle)
        yield
    finally:
        with _guard(path), contextlib.suppress(FileNotFoundError):
            if path.read_text() == own:
                path.unlink()


def record(root: Path, actor: str, what: str, limit: int = vault.DEFAULTS["log_rotate_bytes"]) -> None:
    """Adds a line to the ledger; a full one, or one of an earlier year, is put aside first."""
    if not re.fullmatch(ACTOR.replace(r"\z", r"\Z"), actor):
        raise ValueError(f"'{actor}' is no actor")
    file = root / "log" / "ledger.md"
    file.parent.mkdir(parents=True, exist_ok=True)
    if file.exists():
        year = datetime.fromtimestamp(file.stat().st_mtime, timezone.utc).year
        if file.stat().st_size >= limit or year < datetime.now(timezone.utc).year:
            n = 1
            while (aside := file.with_name(f"ledger-{year}-{n}.md")).exists():
                n += 1
            file.rename(aside)
    with file.open("a", encoding="utf-8") as f:
        f.write(f"- {now()} {actor} {' '.join(what.split())}\n")


def _stem(title: str) -> str:
    """As `file_stem` does for a column."""
    kept = re.sub(r"[^\w\s-]", "", title).strip().lower()
    return re.sub(r"[-\s_]+", "-", kept).strip("-") or "untitled"


def _joined(header: dict[str, Any], body: str) -> str:
    return f"---\n{frontmatter.serialize(header)}---\n{body}"


def read(root: Path, cid: str) -> tuple[dict[str, Any], str, str]:
    """(header, body, hash of the file)."""
    data = inside(root, f"{cid}.md").read_bytes()
    try:
        header, body = frontmatter.split(data.decode())
    except UnicodeDecodeError as e:  # to write it again would change bytes that nobody edits
        raise Refused(f"'{cid}' isn't UTF-8") from e
    return frontmatter.parse(header or ""), body, file_hash(data)


def listed(root: Path, templates: str = "") -> list[str]:
    """The cids of all notes, by a walk."""
    from marginalia.sources.files import walk

    return [p.removesuffix(".md") for d in vault.discover(root, templates) if (root / d.name).is_dir() for p in walk(str(root), d.name, ".md", (templates,) if templates else ())]


def _checked(patch: dict[str, Any]) -> None:
    for key, value in patch.items():
        if key in OWNED:
            raise Refused(f"'{key}' is written by the engine alone")
        if key == "cid":
            raise ValueError("a note's name is its path")
        if key in TEXT_FIELDS and value is not None and not (isinstance(value, str) and value.strip()):
            raise ValueError(f"'{key}' must be text")
        if key == "status" and value is not None and value not in STATUSES:
            raise ValueError(f"'{value}' is no status")
        if key == "aliases" and not (isinstance(value, list) and all(isinstance(a, str) and a.strip() and not re.search(r"[\n\r\t]", a) for a in value)):
            raise ValueError("aliases are texts of one line")


#: Fixed value: signs that a link's target can't hold.
NAMELESS = re.compile(r"[\[\]|#^`<>\n]")


def place(root: Path, title: str, domain: str = "wiki", path: str | None = None, templates: str = "") -> str:
    """Where a new note goes: its domain and a name from its title, or the path, in which a last slash names a folder."""
    spelled = (path or "").replace("\\", "/").strip() or f"{domain or 'wiki'}/"
    if spelled.startswith("/"):
        raise ValueError("a path is relative to the collection")
    if spelled.endswith("/"):
        spelled += _stem(title)
    rel = spelled if spelled.endswith(".md") else f"{spelled}.md"
    parts = rel.split("/")
    rel = rel if len(parts) > 1 else f"{domain or 'wiki'}/{rel}"
    parts = rel.split("/")
    if any(p in ("", ".", "..") for p in parts) or any(vault.excluded(p) for p in parts[:-1]) or parts[0] in vault.RESERVED or parts[-1].startswith(".") or parts[-1] == vault.MANIFEST or (templates and rel.startswith(templates.strip("/") + "/")):
        raise ValueError(f"no note can be at '{rel}'")
    if parts[0] == "wiki" and len(parts) > 2:
        raise ValueError("the wiki is flat")
    if NAMELESS.search(rel) or any(p != p.strip() for p in parts):
        raise ValueError(f"links couldn't name '{rel}'")
    if "raw" in parts[1:]:
        raise ValueError(f"links to '{rel}' would read as citations of raw files")
    return rel


def scaffold(root: Path, title: str, type: str, description: str, actor: str, domain: str = "wiki", path: str | None = None, body: str = "", takes_over: Callable[[str], list[str]] | None = None, templates: str = "", **fields: Any) -> str:
    """Writes a new note and returns its cid.

    Refused where a note is already, where another differs in case alone, where
    the domain's manifest is broken or doesn't allow the type, and where links
    would come to mean the new note (takes_over: cid to those links).
    """
    _checked({"title": title, "type": type, "description": description, **fields})
    with lock(root):
        rel = place(root, title, domain, path, templates)
        cid = rel.removesuffix(".md")
        home = next((d for d in vault.discover(root, templates) if d.name == rel.split("/")[0]), None)
        if home and home.manifest_error:
            raise ValueError(f"the manifest of '{home.name}' is broken: {home.manifest_error}")
        if home and home.allowed_types is not None and type not in home.allowed_types:
            raise ValueError(f"'{home.name}' allows {', '.join(home.allowed_types)}")
        twin = next((c for c in listed(root, templates) if c.casefold() == cid.casefold()), None)
        if twin or (root / rel).exists():
            raise FileExistsError(f"there is a note at '{twin or cid}'")
        if takes_over and (bent := takes_over(cid)):
            raise Refused(f"links would change their meaning: {', '.join(bent)}")
        header = {"type": type, "title": title, "description": description, "status": fields.pop("status", "draft"), **fields, "generated": {"by": actor, "at": now()}}
        write(inside(root, rel), _joined(header, body or f"# {title}\n"), "")
        record(root, actor, f"scaffold {cid}")
    return cid


def update(root: Path, cid: str, actor: str, patch: dict[str, Any] | None = None, sections: dict[str, str] | None = None, replace: list[tuple[str, str]] | None = None, expected: str | None = None) -> str:
    """Patches header fields (null removes one), then sections, then exact texts that stand once; returns the new file's hash.

    What changes nothing is an error, and so is a file that changed since `expected`.
    """
    _checked({k: v for k, v in (patch or {}).items() if v is not None or k in OWNED})
    with lock(root):
        header, body, had = read(root, cid)
        if expected is not None and expected != had:
            raise FileExistsError(f"'{cid}' changed meanwhile")
        new = {k: v for k, v in (header | (patch or {})).items() if v is not None}
        text = body
        for heading, content in (sections or {}).items():
            text = markdown.with_section(text, heading, content)
        for old, fresh in replace or []:
            if not old or text.count(old) != 1:
                raise ValueError(f"the text to replace stands {text.count(old) if old else 0} times")
            text = text.replace(old, fresh)
        if new == header and text == body:
            raise ValueError("nothing would change")
        write(root / f"{cid}.md", _joined(new, text), had)
        record(root, actor, f"update {cid}")
        return file_hash((root / f"{cid}.md").read_bytes())


def verify(root: Path, cid: str, actor: str, method: str = "manual-review") -> bool:
    """Adds an attestation of the body as it is; False where the actor has attested it already.

    A machine may not attest what the text marks as unattested, nor claim a check
    against sources that the note doesn't have.
    """
    if not re.fullmatch(ACTOR.replace(r"\z", r"\Z"), actor):
        raise ValueError(f"'{actor}' is no actor")
    with lock(root):
        header, body, had = read(root, cid)
        if not actor.startswith("human:"):
            if marked := markdown.supplements(body):
                raise Refused(f"the text marks lines {', '.join(map(str, marked))} as unattested")
            if method == "source-crosscheck" and not header.get("sources"):
                raise Refused("the note has no sources to check against")
        entries = header.get("verified") if isinstance(header.get("verified"), list) else []
        bound = body_hash(body)
        if any(isinstance(e, dict) and e.get("by") == actor and e.get("of") == bound for e in entries):
            return False
        header["verified"] = [*entries, {"by": actor, "at": now(), "method": method, "of": bound}]
        write(root / f"{cid}.md", _joined(header, body), had)
        record(root, actor, f"verify {cid}")
        return True


def rewritten(text: str, names: dict[str, str]) -> str:
    """The text with link targets put in place of others, wherever a link of any kind names one of them as it is written."""
    header, body = frontmatter.split(text)
    offset = len(text) - len(body) if header is not None else 0
    out, at = [], 0
    for link in sorted(markdown.links(text[offset:], paths=True), key=lambda x: x.start):
        a, b = offset + link.start, offset + link.end
        if link.target in names and a >= at:
            out += [text[at:a], names[link.target]]
            at = b
    return "".join([*out, text[at:]])


def token(plan: list[dict[str, Any]]) -> str:
    """A fingerprint of a plan, so that what is applied is what was shown."""
    return hashlib.sha256(json.dumps(sorted(plan, key=lambda r: json.dumps(r, sort_keys=True)), sort_keys=True).encode()).hexdigest()


def apply_move(root: Path, moves: dict[str, str], edits: dict[str, dict[str, str]], actor: str, shown: str | None = None) -> str:
    """Moves notes (cid to new cid) and rewrites links (cid: written target to new target); all of it or nothing.

    `edits` come from the plan of a move.  shown: the token of the plan that was agreed to.
    """
    plan = [{"move": m} for m in moves.items()] + [{"edit": cid, "names": names} for cid, names in edits.items()]
    found = token(plan)
    if shown is not None and shown != found:
        raise Refused("the plan isn't the one that was shown")
    with lock(root):
        taken = [c for c in moves.values() if (root / f"{c}.md").exists() and c not in moves]
        if taken or len(set(moves.values())) < len(moves):
            raise FileExistsError(f"moves would meet: {', '.join(taken) or 'one place for several notes'}")
        touched = sorted({*moves, *edits})
        before = {c: inside(root, f"{c}.md").read_bytes() for c in touched}
        # bytes that aren't UTF-8 pass through as they are
        after = {moves.get(c, c): rewritten(before[c].decode("utf-8", "surrogateescape"), edits.get(c, {})).encode("utf-8", "surrogateescape") for c in touched}
        modes = {moves.get(c, c): (root / f"{c}.md").stat().st_mode & 0o7777 for c in touched}
        done: list[Path] = []
        try:
            for cid, data in after.items():
                done.append(inside(root, f"{cid}.md"))
                write(done[-1], data)
                done[-1].chmod(modes[cid])
            for cid in moves:
                if cid not in after:
                    (root / f"{cid}.md").unlink()
        except BaseException:
            for path in done:
                if path.relative_to(root).as_posix().removesuffix(".md") not in before:
                    path.unlink(missing_ok=True)
            for cid, data in before.items():
                write(root / f"{cid}.md", data)
            raise
        record(root, actor, "move " + ", ".join(f"{a} to {b}" for a, b in moves.items()))
    return found
