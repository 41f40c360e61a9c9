"""Formula text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime

from lattiq.errors import UnsupportedCalc

_TOKEN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<field>\[(?:[^\]]|\]\])*\])
      | (?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")
      | (?P<date>\#[^#\n]*\#)
      | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<word>[A-Za-z_][A-Za-z_0-9]*)
      | (?P<op>==|<>|!=|<=|>=|[-+*/%^=<>(),.:{}])""",
    re.X | re.S,
)
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@dataclass(frozen=True)
class Token:
    kind: str
    value: object
    at: int


def date_literal(text: str) -> date | datetime:
    """``2024-01-31``, ``2024-01-31 10:20:30`` or ``January 31, 2024``; whatever else is ambiguous."""
    text = text.strip()
    if re.fullmatch(r"\d{4}-\d{1,2}-\d{1,2}", text):
        parts = [*map(int, text.split("-"))]
    elif m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})[ T](\d{1,2}):(\d{2})(?::(\d{2}))?", text):
        parts = [int(x or 0) for x in m.groups()]
    elif (m := re.fullmatch(r"([A-Za-z]+) (\d{1,2}), (\d{4})", text)) and m[1].lower() in _MONTHS:
        parts = [int(m[3]), _MONTHS.index(m[1].lower()) + 1, int(m[2])]
    else:
        raise UnsupportedCalc(f"ambiguous date literal #{text}#", "syntax")
    try:
        return date(*parts) if len(parts) == 3 else datetime(*parts)
    except ValueError as e:
        raise UnsupportedCalc(f"#{text}# is no date", "syntax") from e


def tokens(formula: str) -> list[Token]:
    out, at = [], 0
    while at < len(formula):
        m = _TOKEN.match(formula, at)
        if m is None:
            raise UnsupportedCalc(f"unexpected {formula[at]!r} at {at}", "syntax")
        kind, raw = m.lastgroup, m[0]
        if kind == "field":
            out.append(Token(kind, raw[1:-1].replace("]]", "]"), at))
        elif kind == "text":
            if "\\" in raw:  # escapes differ between dialects
                raise UnsupportedCalc("a backslash in a text literal", "syntax")
            out.append(Token(kind, raw[1:-1].replace(raw[0] * 2, raw[0]), at))
        elif kind == "date":
            out.append(Token(kind, date_literal(raw[1:-1]), at))
        elif kind == "number":
            out.append(Token(kind, int(raw) if raw.isdigit() else float(raw), at))
        elif kind == "word":
            out.append(Token(kind, raw.upper(), at))
        elif kind == "op":
            out.append(Token(kind, {"==": "=", "!=": "<>"}.get(raw, raw), at))
        at = m.end()
    return out
