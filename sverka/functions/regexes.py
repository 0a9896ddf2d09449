"""Patterns in a neutral form, rendered for Spark (Java) and for the SQL oracle (RE2).

White space and word boundaries differ between engines: the specification's white space
holds no-break and other Unicode spaces, its word characters are ASCII. {ws}, {nws} and
{b} in a pattern stand for a white space class, its contents and a word boundary.
"""

from __future__ import annotations

_SPACES = r"\s\x0B{a0}{1680}{2000}-{200a}{2028}{2029}{202f}{205f}{3000}{feff}"
_CODES = ["a0", "1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000", "feff"]
_JAVA_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _fill(pattern: str, code, boundary: str) -> str:
    inner = _SPACES
    for c in _CODES:
        inner = inner.replace("{" + c + "}", code(c))
    return pattern.replace("{ws}", f"[{inner}]").replace("{nws}", inner).replace("{b}", boundary)


def java(pattern: str) -> str:
    """The pattern for Spark; case-insensitive parts need lower-case input."""
    return _fill(pattern, lambda c: rf"\u{int(c, 16):04X}", _JAVA_B)


def re2(pattern: str) -> str:
    """The pattern for DuckDB."""
    return _fill(pattern, lambda c: rf"\x{{{c}}}", r"\b")


def quoted(text: str) -> str:
    """An SQL string literal."""
    return "'" + text.replace("'", "''") + "'"
