"""The registry of indexed repositories: a small JSON file in the user's home."""

from __future__ import annotations

import json
import os
import subprocess
import tempfile
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path


class RegistryError(Exception):
    pass


@dataclass
class Entry:
    name: str
    path: str
    db_path: str
    indexed_at: str
    indexed_commit: str = ""


def default_path() -> Path:
    home = os.environ.get("HOME")
    if not home:
        raise RegistryError("HOME is not set")
    return Path(home) / ".wovengraph" / "registry.json"


def git_head(path: str) -> str | None:
    """The commit checked out at a path; None where git can't tell."""
    try:
        got = subprocess.run(["git", "-C", path, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return got.stdout.strip() or None if got.returncode == 0 else None


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


@dataclass
class Registry:
    entries: list[Entry] = field(default_factory=list)

    @staticmethod
    def load(path: Path | None = None) -> Registry:
        """The registry at a path; empty if there is no file."""
        path = path or default_path()
        if not path.exists():
            return Registry()
        return Registry([Entry(**e) for e in json.loads(path.read_text())["repos"]])

    def save(self, path: Path | None = None) -> None:
        """Write the whole file anew and put it in place in one step."""
        path = path or default_path()
        path.parent.mkdir(parents=True, exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=path.parent)
        with os.fdopen(handle, "w") as f:
            json.dump({"repos": [asdict(e) for e in self.entries]}, f, indent=2)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)

    def register(self, entry: Entry, force: bool = False) -> None:
        """Add a repository.  The same path again refreshes it if the name is the same, or under
        its old name with `force`; another path may not take a name in use."""
        for k, old in enumerate(self.entries):
            if old.path == entry.path:
                if entry.name != old.name and not force:
                    raise RegistryError(f"{entry.path} is registered as {old.name}")
                self.entries[k] = Entry(old.name, entry.path, entry.db_path, entry.indexed_at, entry.indexed_commit)
                return
        if any(old.name == entry.name for old in self.entries):
            raise RegistryError(f"the name {entry.name} is taken")
        self.entries.append(entry)

    def by_name(self, name: str) -> Entry | None:
        return next((e for e in self.entries if e.name == name), None)

    def by_path(self, path: str) -> Entry | None:
        return next((e for e in self.entries if e.path == path), None)


def is_stale(entry: Entry) -> bool:
    """Whether the repository has moved on since it was indexed; unknown counts as no."""
    head = git_head(entry.path)
    return bool(entry.indexed_commit and head and head != entry.indexed_commit)
