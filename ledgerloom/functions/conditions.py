"""Step conditions, compiled to columns and evaluated in Python, with the same meaning.

A condition names a parameter key, an operator and a value. Logic is two-valued: except for
``Exists`` and ``NotExists`` every operator is false on a key that is missing or null.
Numbers are plain decimal floats, truth values the words true and false; neither is ever
read as the other, and NaN compares false with everything.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("Exists", "NotExists", "IsTrue", "IsFalse", "Equals", "NotEquals", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Contains")
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|Infinity|NaN)\s*$"


@dataclass(frozen=True)
class Condition:
    key: str
    operator: str
    value: str | None = None

    def problems(self) -> list[str]:
        """What is wrong with its shape."""
        found = [] if self.key and self.key.strip() else ["key is empty"]
        if self.operator not in OPERATORS:
            return [*found, f"unknown operator {self.operator}"]
        if self.operator in OPERATORS[:4]:
            return found
        if self.value is None:
            return [*found, f"{self.operator} needs a value"]
        if "Than" in self.operator and _number(self.value) is None:
            found.append(f"{self.operator} needs a number")
        return found


def literal(value: object) -> str:
    """The text form of a value in a condition."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return repr(value) if isinstance(value, float) else str(value)


def _number(text: str) -> float | None:
    return float(text.strip()) if re.match(NUMBER, text) else None


def _truth(text: str) -> bool | None:
    return {"true": True, "false": False}.get(text.strip().lower())


def number(text: Column) -> Column:
    """The number in a text, else null; casts alone would take ``5d`` for one."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def truth(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word == "true", True).when(word == "false", False)


def compile_condition(condition: Condition, value: Column, present: Column) -> Column:
    """The condition as a boolean column that is never null; ``value`` is the text of the key's value."""
    op, other = condition.operator, condition.value
    if op == "Exists":
        return F.coalesce(present, F.lit(False))
    if op == "NotExists":
        return ~F.coalesce(present, F.lit(False))
    x = F.when(present, value)
    if op in ("IsTrue", "IsFalse"):
        found = truth(x) == F.lit(op == "IsTrue")
    elif other is None or op not in OPERATORS:
        found = F.lit(False)
    elif op in ("Equals", "NotEquals"):
        n, b = _number(other), _truth(other)
        same = x == F.lit(other)
        if b is not None:
            same = F.coalesce(truth(x) == F.lit(b), same)
        if n is not None:
            equal = (number(x) == F.lit(n)) & ~F.isnan(number(x)) if not math.isnan(n) else F.when(number(x).isNotNull(), F.lit(False))
            same = F.coalesce(equal, same)
        found = same if op == "Equals" else ~same
    elif op == "Contains":
        found = F.contains(x, F.lit(other))
    else:
        n = _number(other)
        if n is None or math.isnan(n):
            return F.lit(False)
        y = F.when(~F.isnan(number(x)), number(x))
        found = {"GreaterThan": y > n, "GreaterThanOrEqual": y >= n, "LessThan": y < n, "LessThanOrEqual": y <= n}[op]
    return F.coalesce(found, F.lit(False))


def evaluate(condition: Condition, params: dict[str, object]) -> bool:
    """The same in Python, for the control plane; values are None or of a plain type."""
    op, other = condition.operator, condition.value
    if op in ("Exists", "NotExists"):
        return (condition.key in params) == (op == "Exists")
    value = params.get(condition.key)
    if value is None or op not in OPERATORS:
        return False
    text = literal(value)
    if op in ("IsTrue", "IsFalse"):
        return not isinstance(value, (int, float)) and _truth(text) is (op == "IsTrue") if not isinstance(value, bool) else value is (op == "IsTrue")
    if other is None:
        return False
    x = None if isinstance(value, bool) else _number(text)
    y = _number(other)
    if op in ("Equals", "NotEquals"):
        if x is not None and y is not None:
            same = x == y
        elif _truth(text) is not None and _truth(other) is not None:
            same = _truth(text) == _truth(other)
        else:
            same = text == other
        return same if op == "Equals" else not same
    if op == "Contains":
        return other in text
    if x is None or y is None:
        return False
    return {"GreaterThan": x > y, "GreaterThanOrEqual": x >= y, "LessThan": x < y, "LessThanOrEqual": x <= y}[op]
