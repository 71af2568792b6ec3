"""Translated expressions: Spark SQL text that remembers what the dialect knew about it."""

from __future__ import annotations

from collections.abc import Callable


class Expr(str):
    """Spark SQL; ``type`` is the dialect's type where it is known, ``part`` what a bare word, interval or literal was."""

    type: str | None
    part: object

    def __new__(cls, text: str, type: str | None = None, part: object = None):
        self = super().__new__(cls, text)
        self.type, self.part = type, part
        return self


def quote(text: str) -> str:
    """A Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{escaped}'"


#: name -> (rule, result type); a rule gets the arguments and returns Spark SQL.
RULES: dict[str, tuple[Callable[..., str], str | None]] = {}


def rule(*names: str, type: str | None = None):
    """Decorator: translate calls of these names."""

    def keep(f: Callable[..., str]):
        for n in names:
            RULES[n.upper()] = (f, type)
        return f

    return keep


def same(names: str, type: str | None = None, spark: str | None = None) -> None:
    """Functions that Spark has with the same meaning, under the same or one other name."""
    for n in names.split():
        RULES[n.upper()] = ((lambda *a, _n=(spark or n.lower()): f"{_n}({', '.join(a)})"), type)


def template(name: str, text: str, type: str | None = None) -> None:
    """``{0}``, ``{1}``... stand for the arguments."""
    RULES[name.upper()] = ((lambda *a, _t=text: _t.format(*a)), type)


def literal(e: str) -> object:
    """The value of a literal argument; None if it isn't one."""
    return e.part[1] if isinstance(e, Expr) and isinstance(e.part, tuple) and e.part[0] == "literal" else None


def word(e: str) -> str:
    """A bare word such as a date part, in upper case."""
    if isinstance(e, Expr) and isinstance(e.part, tuple) and e.part[0] == "word":
        return e.part[1].upper()
    return str(e).upper()
