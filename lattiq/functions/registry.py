"""What a function of the formula language takes, gives and builds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from lattiq.errors import UnsupportedCalc
from lattiq.plans.nodes import BOOL, INT, NULL, NUMBERS, TEXT, TIMES, Lit, Node

#: Codes of parameters: number, text, time, boolean, anything, and literals: date part, whole number, number, text.
KINDS = {"n": NUMBERS, "t": (TEXT,), "d": TIMES, "b": (BOOL,), "a": None}
LITERALS = {"p": TEXT, "i": INT, "k": None, "s": TEXT}
PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "weekday", "iso-year", "iso-week", "iso-weekday", "dayofyear")


@dataclass(frozen=True)
class Function:
    """``params`` has a code for each argument; the last ``optional`` may be left out."""

    name: str
    params: str
    result: str | Callable[..., str]
    build: Callable
    optional: int = 0
    parts: tuple[str, ...] = ()
    extension: bool = False

    def result_of(self, args: tuple[Node, ...], dtypes: list[str]) -> str:
        """The result's type; refuses what the parameters don't allow."""
        if not len(self.params) - self.optional <= len(args) <= len(self.params):
            raise UnsupportedCalc(f"{self.name} does not take {len(args)} arguments", "function")
        for code, node, dtype in zip(self.params, args, dtypes):
            if code in LITERALS:
                if not isinstance(node, Lit) or LITERALS[code] not in (None, node.dtype) or code == "k" and node.dtype not in NUMBERS:
                    raise UnsupportedCalc(f"{self.name} needs a literal", "function")
                if code == "p" and node.value.lower() not in self.parts:
                    raise UnsupportedCalc(f"{self.name} has no part {node.value!r}", "function")
            elif (kinds := KINDS[code]) and dtype != NULL and dtype not in kinds:
                raise UnsupportedCalc(f"{self.name} does not take {dtype}", "type")
        return self.result if isinstance(self.result, str) else self.result(*dtypes)

    def column(self, args: tuple[Node, ...], columns: list):
        given = [a.value.lower() if code == "p" else a.value if code in LITERALS else c for code, a, c in zip(self.params, args, columns)]
        return self.build(*given)
