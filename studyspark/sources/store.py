"""JSON files that are either whole or an error, and never half written."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from pathlib import Path

MOST_BYTES = 16 << 20


def write_atomically(path: str | os.PathLike, content: bytes) -> None:
    """Beside the target, flushed to disk, then renamed over it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def read_json(path: str | os.PathLike, default: object) -> object:
    """The file's value; ``default`` only if there is no file. What is broken, too large or not a regular file raises."""
    p = Path(path)
    if p.is_symlink() or (p.exists() and not p.is_file()):
        raise ValueError(f"{p} is not a regular file")
    if not p.exists():
        return default
    if p.stat().st_size > MOST_BYTES:
        raise ValueError(f"{p} is larger than {MOST_BYTES} bytes")
    try:
        return json.loads(p.read_text(encoding="utf-8"))
    except ValueError as e:
        raise ValueError(f"{p} is not valid JSON: {e}") from e


def write_json(path: str | os.PathLike, value: object, backup: bool = True) -> None:
    """Writes whole; the file before is kept as ``.bak``."""
    p = Path(path)
    raw = json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False).encode()
    if len(raw) > MOST_BYTES:
        raise ValueError("the value is too large")
    if backup and p.is_file():
        shutil.copy2(p, p.with_name(p.name + ".bak"))
    write_atomically(p, raw)


def items(value: object) -> list[dict]:
    """Items of a list, of ``{"words": [...]}``, or of an object's values; anything else raises."""
    if isinstance(value, dict):
        value = value["words"] if isinstance(value.get("words"), list) else list(value.values())
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        raise ValueError("items must be objects")
    return value


def file_hash(path: str | os.PathLike) -> str:
    """SHA-256 of a file, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()
