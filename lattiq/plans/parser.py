"""Tokens to a tree, by precedence climbing."""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from lattiq.errors import UnsupportedCalc
from lattiq.plans.lexer import Token, tokens
from lattiq.plans.nodes import BOOL, DATE, DATETIME, INT, NULL, REAL, TEXT, Binary, Call, Case, Field, In, Lit, Lod, Node, Param, Unary

#: Binding powers of binary operators; NOT stands between AND and comparison, a sign binds tighter than ^.
_POWER = {"OR": 1, "AND": 2, "=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "IN": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "^": 7}
_NOT = 3
_KEYWORDS = frozenset("IF THEN ELSEIF ELSE END CASE WHEN AND OR NOT IN".split())


class _Parser:
    def __init__(self, formula: str):
        self.all, self.i = tokens(formula), 0

    def peek(self) -> Token | None:
        return self.all[self.i] if self.i < len(self.all) else None

    def sees(self, *values: str) -> bool:
        t = self.peek()
        return t is not None and t.kind in ("op", "word") and t.value in values

    def next(self) -> Token:
        t = self.peek()
        if t is None:
            raise UnsupportedCalc("the formula ends too early", "syntax")
        self.i += 1
        return t

    def accept(self, value: str) -> bool:
        if self.sees(value):
            self.i += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            t = self.peek()
            raise UnsupportedCalc(f"expected {value}, found {t.value if t else 'the end'}", "syntax")

    def expression(self, least: int = 0) -> Node:
        if self.sees("NOT") and least <= _NOT:
            self.next()
            left: Node = Unary("NOT", self.expression(_NOT))
        else:
            left = self.unary()
        while (t := self.peek()) is not None and t.kind in ("op", "word") and (power := _POWER.get(t.value, -1)) >= max(least, 1):
            op = self.next().value
            if op == "IN":
                left = In(left, self.listed())
                continue
            left = Binary(op, left, self.expression(power if op == "^" else power + 1))
        return left

    def unary(self) -> Node:
        if self.accept("-"):
            x = self.unary()
            return Lit(-x.value, x.dtype) if isinstance(x, Lit) and x.dtype in (INT, REAL) else Unary("-", x)
        if self.accept("+"):
            return self.unary()
        return self.primary()

    def listed(self) -> tuple[Node, ...]:
        self.expect("(")
        items = [self.expression()]
        while self.accept(","):
            items.append(self.expression())
        self.expect(")")
        return tuple(items)

    def primary(self) -> Node:
        t = self.next()
        if t.kind == "number":
            return Lit(t.value, INT if isinstance(t.value, int) else REAL)
        if t.kind == "text":
            return Lit(t.value, TEXT)
        if t.kind == "date":
            return Lit(t.value, DATETIME if isinstance(t.value, datetime) else DATE)
        if t.kind == "field":
            if not self.accept("."):
                return Field(t.value)
            name = self.next()
            if name.kind != "field":
                raise UnsupportedCalc("a qualified name needs a second part", "syntax")
            return Param(name.value) if t.value == "Parameters" else Field(name.value, t.value)
        if t.value == "(":
            x = self.expression()
            self.expect(")")
            return x
        if t.value == "{":
            return self.lod()
        if t.kind == "word":
            return self.word(t.value)
        raise UnsupportedCalc(f"unexpected {t.value}", "syntax")

    def word(self, w: str) -> Node:
        if w == "IF":
            return self.branches(None)
        if w == "CASE":
            return self.branches(None if self.sees("WHEN") else self.expression(), "WHEN")
        if w in ("TRUE", "FALSE"):
            return Lit(w == "TRUE", BOOL)
        if w == "NULL":
            return Lit(None, NULL)
        if w in _KEYWORDS or not self.accept("("):
            raise UnsupportedCalc(f"unexpected {w}", "syntax")
        args = []
        if not self.accept(")"):
            args.append(self.expression())
            while self.accept(","):
                args.append(self.expression())
            self.expect(")")
        return Call(w, tuple(args))

    def branches(self, subject: Node | None, word: str = "ELSEIF") -> Node:
        whens = []
        first = True
        while first and word == "ELSEIF" or self.accept(word):
            first = False
            test = self.expression()
            self.expect("THEN")
            whens.append((test if subject is None else Binary("=", subject, test), self.expression()))
        if not whens:
            raise UnsupportedCalc("CASE without WHEN", "syntax")
        default = self.expression() if self.accept("ELSE") else None
        self.expect("END")
        return Case(tuple(whens), default)

    def lod(self) -> Node:
        kind, dims = "FIXED", []
        if self.sees("FIXED", "INCLUDE", "EXCLUDE"):
            kind = self.next().value
            while not self.accept(":"):
                dims.append(self.expression())
                if not self.sees(":"):
                    self.expect(",")
            if kind != "FIXED" and not dims:
                raise UnsupportedCalc(f"{kind} without dimensions", "lod")
        body = self.expression()
        self.expect("}")
        return Lod(kind, tuple(dims), body)


@lru_cache(maxsize=4096)
def parse(formula: str) -> Node:
    p = _Parser(formula)
    tree = p.expression()
    if (t := p.peek()) is not None:
        raise UnsupportedCalc(f"unexpected {t.value} after the formula", "syntax")
    return tree
