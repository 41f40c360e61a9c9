"""The one way in which a calculation is refused."""

from __future__ import annotations

#: Why a calculation can be refused, for coverage reports.
CATEGORIES = ("syntax", "field", "type", "function", "grain", "lod", "table calc", "cross table", "cycle", "parameter", "filter", "source")


class UnsupportedCalc(ValueError):
    """A calculation or query that can't be computed exactly; never a wrong value instead."""

    def __init__(self, reason: str, category: str = "syntax"):
        if category not in CATEGORIES:
            raise AssertionError(category)
        super().__init__(f"{category}: {reason}")
        self.reason, self.category = reason, category
