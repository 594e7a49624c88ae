"""A synchronisation: which table, key, columns, zone and mode."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

FULL, FULL_CDC, INCREMENTAL = "FULL", "FULL_CDC", "INCREMENTAL"


def resolve_columns(available: list[str], requested: list[str], keys: list[str] = []) -> list[str]:
    """Requested columns by their real names: case-insensitive, without repeats, in the order asked; none asked means all.

    Unknown columns are an error, and so is a selection that leaves out a key column.
    """
    real = {c.lower(): c for c in available}
    wanted = list(dict.fromkeys(r.strip().lower() for r in requested if r and r.strip()))
    if unknown := [w for w in wanted if w not in real]:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    chosen = [real[w] for w in wanted] or list(available)
    if missing := [k for k in keys if k.lower() not in {c.lower() for c in chosen}]:
        raise ValueError(f"key columns must be selected: {', '.join(missing)}")
    return chosen


def resolve_key(candidates: list[list[str]], requested: list[str] | None = None) -> list[str]:
    """The first candidate, or the one that equals the request in order, ignoring case; no match is an error."""
    if not candidates:
        return [] if not requested else _no_key(requested)
    if not requested:
        return candidates[0]
    asked = [r.strip().lower() for r in requested]
    return next((c for c in candidates if [x.lower() for x in c] == asked), None) or _no_key(requested)


def _no_key(requested: list[str]):
    raise ValueError(f"not a key of the table: {', '.join(requested)}")


@dataclass(frozen=True)
class SyncSpec:
    """What a task does. Its fingerprint changes when the meaning of saved positions does; the output format isn't part of it."""

    source_database: str
    source_table: str
    key: list[str]
    columns: list[str]
    mode: str = FULL_CDC
    zone: str = "Asia/Shanghai"
    options: dict = field(default_factory=dict)
    output_format: str = "ENVELOPE"

    def fingerprint(self) -> str:
        said = {k: v for k, v in asdict(self).items() if k != "output_format"}
        return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()

    def checkpoint_path(self, root: str) -> str:
        """A stream's checkpoint: a changed meaning starts anew instead of going on from positions that no longer fit."""
        return f"{root.rstrip('/')}/{self.source_database}.{self.source_table}/{self.fingerprint()[:16]}"
