"""Settings from a .env file."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path


def flag(text: str) -> bool:
    return text.strip().lower() in {"1", "true", "yes", "on"}


def listed(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


def mapped(text: str) -> dict[str, str]:
    """a:b,c:d"""
    pairs = (x.partition(":") for x in listed(text))
    return {k.strip(): v.strip() for k, sep, v in pairs if sep and k.strip()}


@dataclass(frozen=True)
class Config:
    provider: str = "github"
    base_url: str = ""
    repos: tuple[str, ...] = ()
    warehouse: str = "warehouse"
    excluded: tuple[str, ...] = ()
    bot_names: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    anonymize: bool = True
    scoring: bool = False
    key: str = ""
    token_env: str = ""
    readonly: bool = False

    def problems(self) -> list[str]:
        found = []
        if self.provider not in ("github", "gitlab"):
            found.append(f"provider is {self.provider!r}; it is github or gitlab")
        if not self.repos:
            found.append("no repositories are named")
        if self.provider == "gitlab" and not self.base_url:
            found.append("gitlab needs a base URL")
        return found

    def with_alias(self, alias: str, canonical: str) -> Config:
        """Lower-case; a name isn't its own alias."""
        alias, canonical = alias.strip().lower(), canonical.strip().lower()
        return self if not alias or alias == canonical else Config(**self.__dict__ | {"aliases": self.aliases | {alias: canonical}})


_READERS = {"repos": listed, "excluded": listed, "bot_names": listed, "aliases": mapped, "anonymize": flag, "scoring": flag, "readonly": flag}


def update(path: str, name: str, value: str) -> None:
    """Sets one value in the file; all other lines stay."""
    file, line = Path(path), f"{name.upper()}={value}"
    lines = file.read_text(encoding="utf-8").splitlines() if file.is_file() else []
    at = [i for i, x in enumerate(lines) if x.partition("=")[0].strip().upper() == name.upper() and not x.startswith("#")]
    lines = [x for i, x in enumerate(lines) if i not in at[1:]]
    if at:
        lines[at[0]] = line
    else:
        lines.append(line)
    file.write_text("\n".join(lines) + "\n", encoding="utf-8")


def add_merges(path: str, canonical: str, aliases: list[str]) -> Config:
    """Notes aliases of an address in the file."""
    found = load(path)
    for alias in aliases:
        found = found.with_alias(alias, canonical)
    update(path, "aliases", ",".join(f"{a}:{c}" for a, c in found.aliases.items()))
    return found


def load(path: str) -> Config:
    """Keys are the fields' names in capitals; a relative warehouse is below the file's folder."""
    values: dict[str, object] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, sep, value = line.strip().partition("=")
        name = key.strip().lower()
        if sep and not key.startswith("#") and name in Config.__dataclass_fields__:
            values[name] = _READERS.get(name, str)(value.strip().strip("\"'"))
    root = str(values.get("warehouse", Config.warehouse))
    if "://" not in root and not root.startswith("/"):
        values["warehouse"] = str(Path(path).resolve().parent / root)
    return Config(**values)
