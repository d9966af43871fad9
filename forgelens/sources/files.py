"""Small files on the driver: keys, the map from pseudonyms to people, and how far an extraction has come."""

from __future__ import annotations

import datetime as dt
import json
import os
import secrets
from pathlib import Path


def new_key() -> str:
    """32 random bytes as hex digits."""
    return secrets.token_bytes(32).hex()


def key_of(digits: str) -> bytes:
    return bytes.fromhex(digits)


def _read(path: Path) -> dict | None:
    """The object in a file; None if there is no file, or it can't be read."""
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def _replace(path: Path, body: dict, mode: int = 0o644) -> None:
    """Whole or not at all: readers never see half a file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(path.name + ".new")
    with os.fdopen(os.open(beside, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, mode), "w", encoding="utf-8") as f:
        json.dump(body, f, indent=1, ensure_ascii=False)
    os.replace(beside, path)


class IdentityFile:
    """hash -> name, e-mail and, once merged, the hash that took its place; readable by its owner only."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def load(self) -> dict[str, dict[str, str]]:
        return _read(self.path) or {}

    def add(self, people: dict[str, tuple[str | None, str | None]]) -> None:
        """Entries of newly seen people replace older ones of the same hash."""
        _replace(self.path, self.load() | {h: {"name": name, "email": email} for h, (name, email) in people.items()}, 0o600)

    def merged(self, merges: dict[str, str], canonical: dict[str, tuple[str | None, str | None]]) -> None:
        """Notes old hashes as merged into new ones, of which canonical says who they are."""
        known = self.load() | {h: {"name": name, "email": email} for h, (name, email) in canonical.items()}
        for old, new in merges.items():
            if old in known:
                known[old] = known[old] | {"merged_into": new}
        _replace(self.path, known, 0o600)


class Progress:
    """The phase that each repository has reached, one file each."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _path(self, repo: str) -> Path:
        return self.folder / (repo.replace("/", "_") + ".json")

    def load(self, repo: str) -> dict | None:
        return _read(self._path(repo))

    def save(self, repo: str, **state: object) -> None:
        _replace(self._path(repo), {"timestamp": dt.datetime.now(dt.UTC).isoformat()} | state)

    def open_runs(self) -> tuple[str, ...]:
        """Names of runs that some repository hasn't finished."""
        found = (_read(p) or {} for p in sorted(self.folder.glob("*.json")))
        return tuple(dict.fromkeys(x["run"] for x in found if x.get("run")))

    def clear(self, repo: str) -> None:
        self._path(repo).unlink(missing_ok=True)

    def exists(self, repo: str) -> bool:
        return self._path(repo).is_file()
