"""Selections and conditions of rules as Spark columns.  Every leaf is true or false, never null."""

from __future__ import annotations

import ast
import fnmatch
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import resolve
from .net import is_public

_MODIFIERS = {"contains", "startswith", "endswith", "re", "gt", "gte", "lt", "lte", "is_public", "in_list"}


class RuleError(ValueError):
    """A rule that can't be compiled."""


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs, F.lit(False))


def _all(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs, F.lit(True))


def _number(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text).try_cast("double")


def _equals(c: Column, want: Any) -> Column:
    text = c.cast("string")
    if want is None:
        return F.coalesce(text, F.lit("")) == ""
    if isinstance(want, bool):
        # a text is true unless empty, a number unless zero; which of them a field is, its column tells
        kind = F.typeof(c)
        false = F.when(kind == "string", text == "").when(kind == "boolean", text == "false").otherwise(_number(c) == 0)
        return _sure(~false == F.lit(want))
    if isinstance(want, int | float):
        return _sure(_number(c) == float(want))
    low = str(want).lower()
    if "*" in low or "?" in low:
        pattern = fnmatch.translate(low)
        inner = re.sub(r"^\(\?s:(.*)\)(?:\\Z|\\z)$", r"\1", pattern, flags=re.S)
        return _sure(F.lower(text).rlike(f"(?s)^(?:{inner})\\z"))
    return _sure(F.lower(text) == low)


def leaf_key(name: str, want: Any) -> str:
    """By which a leaf's column of marks is found."""
    return json.dumps([name, want], default=str)


def leaf(name: str, want: Any, lists: dict[str, list[str]] | None = None, columns: list[str] | None = None, extended: bool = False, marks: dict[str, str] | None = None) -> Column:
    """``field|modifier|all``: want.  ``marks`` names columns that hold what a leaf is, by its key."""
    if marks and (mark := marks.get(leaf_key(name, want))):
        return F.col(mark)
    field, *mods = name.split("|")
    every = "all" in mods
    mods = [m for m in mods if m != "all"]
    c = resolve(field, columns, extended)
    wants = want if isinstance(want, list) else [want]
    if not mods:
        return _any([_equals(c, w) for w in wants])
    mod = mods[0]
    if mod not in _MODIFIERS:
        raise RuleError(f"unknown modifier {mod}")
    fold = _all if every else _any
    text = c.cast("string")
    if mod == "is_public":
        return is_public(F.coalesce(text, F.lit(""))) == F.lit(bool(want))
    if mod == "in_list":
        some = [(lists or {}).get(w, []) for w in wants]
        if not all(isinstance(v, list | tuple | set) for v in some):
            raise RuleError(f"{name}: a list that is a table needs marks")
        known = sorted({str(v).lower() for vs in some for v in vs})
        return F.lower(F.coalesce(text, F.lit(""))).isin(known) if known else F.lit(False)
    if mod in ("gt", "gte", "lt", "lte"):
        if isinstance(want, list):
            return F.lit(False)
        n = _number(c)
        return _sure({"gt": n > float(want), "gte": n >= float(want), "lt": n < float(want), "lte": n <= float(want)}[mod])
    if mod == "re":
        return fold([_sure(text.rlike(f"(?iud){w}")) for w in wants])
    low = F.lower(text)
    return fold([_sure(getattr(low, mod)(str(w).lower())) for w in wants])


def selection(sel: Any, lists: dict[str, list[str]] | None = None, columns: list[str] | None = None, extended: bool = False, marks: dict[str, str] | None = None) -> Column:
    """A mapping holds if all its fields do (an empty one always), a list of mappings if one does (an empty one never)."""
    if isinstance(sel, list):
        return _any([selection(s, lists, columns, extended, marks) for s in sel])
    if not isinstance(sel, dict):
        raise RuleError(f"not a selection: {sel!r}")
    return _all([leaf(k, v, lists, columns, extended, marks) for k, v in sel.items()])


@dataclass(frozen=True)
class Logic:
    """How a condition's parts are put together: as columns, or as texts of another language."""

    any: Callable[[list], Any]
    all: Callable[[list], Any]
    no: Callable[[Any], Any]


COLUMNS = Logic(_any, _all, lambda c: ~c)


def condition(text: Any, found: dict[str, Any], logic: Logic = COLUMNS) -> Any:
    """``and``, ``or``, ``not``, brackets, names, ``1 of`` and ``all of`` a pattern or ``them``; ``found`` has what each selection's name stands for.

    After names and ``of`` phrases have become plain names the text is an expression that Python itself reads.
    """
    if not isinstance(text, str):
        raise RuleError("a condition must be a text")
    names: list[Any] = []

    def put(c: Any) -> str:
        names.append(c)
        return f" s{len(names) - 1} "

    def phrase(m: re.Match) -> str:
        pattern = m[2]
        chosen = [c for n, c in found.items() if pattern.lower() == "them" or fnmatch.fnmatchcase(n, pattern)]
        if not chosen:
            raise RuleError(f"no selection is named like {pattern}")
        return put((logic.any if m[1] == "1" else logic.all)(chosen))

    def word(m: re.Match) -> str:
        if m[0].lower() in ("and", "or", "not"):
            return f" {m[0].lower()} "
        if m[0] not in found:
            raise RuleError(f"unknown selection {m[0]}")
        return put(found[m[0]])

    parts = re.split(r"(\b(?:1|all)\s+of\s+[^\s()]+)", text, flags=re.I)
    code = "".join(phrase(re.match(r"(1|all)\s+of\s+(\S+)", p.lower() if p.lower().endswith("them") else p, re.I)) if i % 2 else re.sub(r"[^\s()]+", word, p) for i, p in enumerate(parts))
    try:
        tree = ast.parse(code.strip(), mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"condition {text!r}: {e.msg}") from None

    def fold(node: ast.expr) -> Any:
        if isinstance(node, ast.Name):
            return names[int(node.id[1:])]
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return logic.no(fold(node.operand))
        if isinstance(node, ast.BoolOp):
            return (logic.all if isinstance(node.op, ast.And) else logic.any)([fold(v) for v in node.values])
        raise RuleError(f"condition {text!r} isn't one of selections")

    return fold(tree)
