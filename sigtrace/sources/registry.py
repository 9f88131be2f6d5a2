"""Loading versioned registries (profiles, policies, code names) with digests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class LoadedRegistry:
    """``entries`` in the order of their ids, the SHA-256 of each file, and one digest of it all."""

    entries: list[dict]
    files: dict[str, str]
    digest: str


def canonical_digest(value) -> str:
    """SHA-256 of a value as compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def load_registry(root: str, names: list[str], ident: str, same: tuple[str, ...] = (), digests: dict[str, str] | None = None, inline: list[dict] = ()) -> LoadedRegistry:
    """The entries of the JSON files ``names`` below ``root`` (an object or a list of objects each) and ``inline`` ones.

    Raises ValueError if a name leads out of ``root`` or over a link, a file is
    not what ``digests`` says, an ``ident`` is missing or there twice, or the
    entries differ in a field of ``same``. For small files on the driver.
    """
    base = Path(root).resolve()
    entries, files = [dict(e) for e in inline], {}
    for name in names:
        path = base / name
        if Path(name).is_absolute() or any(p.is_symlink() for p in [path, *path.parents] if base in p.parents or p == path) or base not in path.resolve().parents:
            raise ValueError(f"{name} is not a plain file below the registry")
        body = path.read_bytes()
        files[name] = hashlib.sha256(body).hexdigest()
        if digests is not None and digests.get(name) != files[name]:
            raise ValueError(f"{name} is not the file that was named")
        value = json.loads(body)
        entries += value if isinstance(value, list) else [value]
    ids = [e.get(ident) for e in entries]
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError(f"{ident} missing or repeated")
    for field in same:
        if len({json.dumps(e.get(field), sort_keys=True) for e in entries}) > 1:
            raise ValueError(f"entries differ in {field}")
    entries.sort(key=lambda e: str(e[ident]))
    return LoadedRegistry(entries, files, canonical_digest(entries))
