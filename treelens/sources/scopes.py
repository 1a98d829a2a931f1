"""Saved scopes: validation, storage as JSON, relocation."""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import asdict, dataclass, replace

from ..errors import InvalidQuery
from ..lang.parser import parse


@dataclass(frozen=True)
class Scope:
    name: str = ""
    folders: tuple[str, ...] = ()
    expression: str = ""
    is_pinned: bool = False
    id: str = ""

    @property
    def unrestricted(self) -> bool:
        return not self.folders and not self.expression.strip()

    @property
    def recent_order(self) -> bool:
        """Without terms and extension filters an empty search lists by id within equal times."""
        terms = [t for g in parse(self.expression) for t in g]
        return all((t.filter() or ("", ""))[0] not in ("", "ext", "type") or t.folder() for t in terms)

    def validated(self) -> Scope:
        from datetime import datetime, timezone

        from ..lang.filters import analyse

        name = self.name.strip()
        if not name or name.lower() == "all":
            raise InvalidQuery("A scope needs a name other than All.")
        if any(not f.startswith("/") for f in self.folders):
            raise InvalidQuery("Scope folders need absolute paths.")
        analyse(parse(self.expression), datetime.now(timezone.utc))
        folders = tuple(sorted({posixpath.normpath(f) for f in self.folders}))
        return replace(self, name=name, folders=folders, expression=self.expression.strip(), id=self.id or str(uuid.uuid4()))


class ScopeStore:
    """Scopes by id, names unique whatever their case; the text form is a JSON array."""

    def __init__(self, text: str = "[]"):
        self._scopes: dict[str, Scope] = {}
        for item in json.loads(text):
            try:
                self.save(Scope(**(item | {"folders": tuple(item.get("folders", ()))})))
            except (InvalidQuery, TypeError):
                continue  # what is invalid or a duplicate is dropped on loading

    def save(self, scope: Scope) -> Scope:
        scope = scope.validated()
        if any(s.name.lower() == scope.name.lower() and s.id != scope.id for s in self._scopes.values()):
            raise InvalidQuery(f"There is a scope named {scope.name} already.")
        self._scopes[scope.id] = scope
        return scope

    def delete(self, scope_id: str) -> None:
        self._scopes.pop(scope_id, None)

    def listed(self) -> list[Scope]:
        return sorted(self._scopes.values(), key=lambda s: (not s.is_pinned, s.name.lower(), s.name))

    def text(self) -> str:
        return json.dumps([asdict(s) for s in self.listed()])

    def relocate(self, moves: dict[str, str]) -> None:
        """Folders below a moved path follow it; the longest moved path wins."""
        for scope in list(self._scopes.values()):
            self._scopes[scope.id] = replace(scope, folders=tuple(sorted({relocated(f, moves) for f in scope.folders})))


def relocated(path: str, moves: dict[str, str]) -> str:
    for old in sorted(moves, key=len, reverse=True):
        if path == old or path.startswith(old.rstrip("/") + "/"):
            return moves[old] + path[len(old) :]
    return path


class History:
    """Newest first, without repeats, at most ``limit``; walking it keeps the draft."""

    def __init__(self, items: list[str] | None = None, limit: int = 50):
        self.limit, self.items, self._at, self._draft = limit, [], -1, ""
        for item in reversed(items or []):
            self.add(item)

    def add(self, text: str) -> None:
        text = text.strip()
        if text:
            self.items = [text, *(x for x in self.items if x != text)][: self.limit]
        self._at = -1

    def older(self, draft: str) -> str:
        if self._at < 0:
            self._draft = draft
        self._at = min(self._at + 1, len(self.items) - 1)
        return self.items[self._at] if self._at >= 0 else draft

    def newer(self) -> str:
        self._at = max(-1, self._at - 1)
        return self.items[self._at] if self._at >= 0 else self._draft
