"""A small scanner shared by the model, filter and rule languages."""

from __future__ import annotations

import re


class SyntaxProblem(ValueError):
    """What was expected, and the text at which it was missing."""


class Scanner:
    def __init__(self, text: str, comments: str | None = r"//[^\n]*|#(?!\[)[^\n]*"):
        self.text, self.at = text, 0
        self._skip = re.compile(rf"(?:\s+{'|' + comments if comments else ''})*")

    def skip(self) -> None:
        self.at = self._skip.match(self.text, self.at).end()

    def done(self) -> bool:
        self.skip()
        return self.at >= len(self.text)

    def peek(self, pattern: str) -> re.Match | None:
        self.skip()
        return re.compile(pattern).match(self.text, self.at)

    def take(self, pattern: str) -> re.Match | None:
        found = self.peek(pattern)
        if found:
            self.at = found.end()
        return found

    def need(self, pattern: str, what: str | None = None) -> re.Match:
        found = self.take(pattern)
        if not found:
            raise SyntaxProblem(f"expected {what or pattern!r} at: {self.text[self.at : self.at + 40]!r}")
        return found

    def quoted(self) -> str | None:
        found = self.take(r'"((?:[^"\\]|\\.)*)"|\'((?:[^\'\\]|\\.)*)\'')
        return None if found is None else unescape(found[1] if found[1] is not None else found[2])


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text)


def glob_pattern(glob: str) -> str:
    """An anchored regular expression for ``*`` and ``?``, for Python and Java alike."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"
