"""Objects behind links that expire, and bundles of source files.

A manifest maps keys to links for reading and writing. Signatures in links are never shown; a link past its time and a
manifest that can't be used are errors of their own, with exit codes of their own; an object without a link isn't there yet.
"""

from __future__ import annotations

import os
import tarfile
from collections.abc import Callable, Iterable, Mapping
from datetime import UTC, datetime
from pathlib import Path
from typing import Any


class Expired(RuntimeError):
    """A link is past its time."""

    exit_code = 75  # fixed value


class Unusable(RuntimeError):
    """A manifest, or a bundle, that can't be used."""

    exit_code = 76  # fixed value


def shown(link: str) -> str:
    """A link without its query, where signatures are."""
    place, mark, _ = link.partition("?")
    return place + ("?..." if mark else "")


class Links:
    """get and put: what fetches and what sends bytes; each gives (status, body)."""

    def __init__(self, manifest: Any, get: Callable[[str], tuple[int, bytes]], put: Callable[[str, bytes], tuple[int, bytes]], now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        entries = manifest.get("entries") if isinstance(manifest, Mapping) else None
        if not isinstance(entries, Mapping):
            raise Unusable("a manifest without entries")
        self.entries, self._get, self._put, self._now = entries, get, put, now

    def __repr__(self) -> str:
        return f"Links({len(self.entries)} keys)"

    def exists(self, key: str) -> bool:
        return bool((self.entries.get(key) or {}).get("get_url"))

    def link(self, key: str, way: str) -> str:
        entry = self.entries.get(key)
        if not entry or not entry.get(f"{way}_url"):
            raise Unusable(f"no link to {way} {key!r}")
        until = entry.get("expires_at")
        if until and datetime.fromisoformat(until.replace("Z", "+00:00")) <= self._now():
            raise Expired(f"the link of {key!r} was good until {until}")
        return entry[f"{way}_url"]

    @staticmethod
    def _checked(status: int, body: bytes, link: str) -> bytes:
        if status == 403:
            raise Expired(f"refused: {shown(link)}")
        if status >= 300:
            raise Unusable(f"status {status}: {shown(link)}")
        return body

    def read(self, key: str) -> bytes | None:
        """The object, or None if there is none yet."""
        if not self.exists(key):
            return None
        link = self.link(key, "get")
        return self._checked(*self._get(link), link)

    def write(self, key: str, value: bytes) -> None:
        link = self.link(key, "put")
        self._checked(*self._put(link, value), link)

    def write_folder(self, key: str, folder: str) -> list[str]:
        """All files of a folder that the manifest has keys for; the keys."""
        sent = []
        for path in sorted(p for p in Path(folder).rglob("*") if p.is_file()):
            name = f"{key}/{path.relative_to(folder).as_posix()}"
            if (self.entries.get(name) or {}).get("put_url"):
                self.write(name, path.read_bytes())
                sent.append(name)
        return sent


def bundle(path: str, root: str, folders: Iterable[str]) -> list[str]:
    """A compressed archive of folders below a root, without caches; the names in it."""
    names = []
    with tarfile.open(path, "w:gz") as out:
        for folder in folders:
            for f in sorted((Path(root) / folder).rglob("*")):
                if f.is_file() and "__pycache__" not in f.parts:
                    names.append(f.relative_to(root).as_posix())
                    out.add(f, arcname=names[-1])
    return names


def unpack(path: str, folder: str) -> list[str]:
    """The archive's files, below a folder; Unusable, and nothing written, if one would land outside or is no plain file or folder."""
    top = os.path.realpath(folder)
    with tarfile.open(path) as archive:
        members = archive.getmembers()
        for m in members:
            at = os.path.realpath(os.path.join(top, m.name))
            if os.path.commonpath([top, at]) != top or not (m.isfile() or m.isdir()):
                raise Unusable(f"{m.name!r} doesn't belong in a bundle")
        archive.extractall(top, members, filter="data")
    return [m.name for m in members if m.isfile()]
