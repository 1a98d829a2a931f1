"""Query text to alternatives of terms (white space: and, |: or)."""

from __future__ import annotations

import re
from dataclasses import dataclass

FILTER_KEYS = frozenset("ext type file folder size dm datemodified parent in infolder".split())


@dataclass(frozen=True)
class Term:
    text: str
    negated: bool = False
    quoted: bool = False

    @property
    def has_slash(self) -> bool:
        return "/" in self.text

    @property
    def is_prefix(self) -> bool:
        return len(self.text) > 1 and self.text.endswith("/")

    @property
    def wild(self) -> bool:
        return "*" in self.text or "?" in self.text

    def filter(self) -> tuple[str, str] | None:
        """(key, value) of an unquoted filter term."""
        key, colon, value = self.text.partition(":")
        return (key.lower(), value) if colon and not self.quoted and key.lower() in FILTER_KEYS else None

    def folder(self) -> str | None:
        """The folder that an absolute term with a final slash names."""
        plain = self.is_prefix and self.text.startswith("/") and not self.wild and not self.quoted and "//" not in self.text
        if plain and not {".", ".."}.intersection(self.text.split("/")):
            return self.text.rstrip("/")
        return None


# An atom: an optional single "!", then quoted stretches and other characters.
# Quotes may open anywhere in it; one that never closes runs to the end.
_ATOM = re.compile(r'(?:"[^"]*(?:"|\Z)|[^\s|"])+')


def parse(text: str) -> list[list[Term]]:
    """Always at least one alternative; an empty one matches everything."""
    groups: list[list[Term]] = [[]]
    at = 0
    while at < len(text):
        if text[at] == "|":
            groups.append([])
            at += 1
        elif atom := _ATOM.match(text, at):
            at = atom.end()
            raw = atom.group()
            negated = raw[0] == "!" and len(raw.replace('"', "")) > 1
            body = raw[1:] if negated else raw
            plain = body.replace('"', "")
            if plain:
                groups[-1].append(Term(plain, negated, body.startswith('"')))
        else:
            at += 1
    return groups


def prefix_phrases(text: str) -> str:
    """A full-text expression: each word as a quoted prefix phrase, all required."""
    return " ".join('"' + word.replace('"', '""') + '"*' for word in text.split())
