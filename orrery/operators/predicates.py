"""Attribute predicates as Columns.

A row passes only where its attribute is there and of the value's kind: null doesn't pass, and numbers
never equal strings. ``negate`` passes exactly the rows that its predicate doesn't, null ones too.

A predicate is called with a DataFrame. Those made here also tell from a summary of some rows (see
``summaries``) how many of them pass, at least and at most; a caller's own function of a DataFrame is
a predicate too, of which nothing is known in advance.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Predicate = Callable[[DataFrame], Column]
Bounds = tuple[Column, Column]

_KINDS = {bool: {"boolean"}, int: {"tinyint", "smallint", "int", "bigint"}, float: {"float", "double"}, str: {"string"}}


class Summary(Protocol):
    """What is known of some rows: how many there are, and of a field the number of rows that have
    it, its least and largest value, and how often each value occurs (null where that isn't known)."""

    rows: Column
    dtypes: dict[str, str]

    def knows(self, field: str) -> bool: ...
    def present(self, field: str) -> Column: ...
    def low(self, field: str) -> Column: ...
    def high(self, field: str) -> Column: ...
    def count(self, field: str, test: Callable[[Column], Column]) -> Column: ...
    def may_hold(self, field: str, value: object) -> Column: ...


@dataclass(frozen=True)
class Rule:
    passes: Predicate
    known: Callable[[Summary], Bounds]

    def __call__(self, df: DataFrame) -> Column:
        return self.passes(df)


def bounds(predicate: Predicate, summary: Summary) -> Bounds:
    """How many of the summarised rows pass, at least and at most."""
    return predicate.known(summary) if isinstance(predicate, Rule) else (_LONG(0), summary.rows)


_LONG = lambda n: F.lit(n).cast("long")


def _same_kind(dtypes: dict[str, str], field: str, value: object) -> bool:
    return dtypes.get(field) in _KINDS.get(type(value), set())


def _test(c: Column, op: str, value: object) -> Column:
    test = {"eq": c == value, "lt": c < value, "le": c <= value, "gt": c > value, "ge": c >= value}[op]
    # Spark has NaN equal to itself and above all numbers; here it is unordered
    return F.coalesce(test & ~F.isnan(c) if isinstance(value, float) else test, F.lit(False))


def compare(field: str, op: str, value: object) -> Predicate:
    """``op`` is one of eq, lt, le, gt, ge. Another kind of value, or no such field, is false."""

    def passes(df: DataFrame) -> Column:
        return _test(F.col(field), op, value) if _same_kind(dict(df.dtypes), field, value) else F.lit(False)

    def known(s: Summary) -> Bounds:
        if not _same_kind(s.dtypes, field, value):
            return _LONG(0), _LONG(0)
        if not s.knows(field):
            return _LONG(0), s.rows
        low, high, present = s.low(field), s.high(field), s.present(field)
        exact = s.count(field, lambda c: _test(c, op, value))
        # of the ends alone: none pass, all do, or it isn't known; a largest value of NaN tells nothing
        some = {"eq": (low <= value) & (high >= value) & s.may_hold(field, value), "lt": low < value, "le": low <= value, "gt": high > value, "ge": high >= value}[op]
        every_ = {"eq": (low == value) & (high == value), "lt": high < value, "le": high <= value, "gt": low > value, "ge": low >= value}[op]
        every_ = every_ & ~F.isnan(high) if isinstance(value, float) else every_
        return F.coalesce(exact, F.when(every_, present), _LONG(0)), F.coalesce(exact, F.when(some, present), _LONG(0))

    return Rule(passes, known)


def equals(field: str, value: object) -> Predicate:
    return compare(field, "eq", value)


def between(field: str, low: object = None, high: object = None) -> Predicate:
    """Both ends inclusive and optional; without either, the field is there."""
    tests = [compare(field, "ge", low)] * (low is not None) + [compare(field, "le", high)] * (high is not None)

    def passes(df: DataFrame) -> Column:
        return every(*tests)(df) & F.col(field).isNotNull() if field in df.columns else F.lit(False)

    def known(s: Summary) -> Bounds:
        if field not in s.dtypes:
            return _LONG(0), _LONG(0)
        if not tests:
            return (s.present(field), s.present(field)) if s.knows(field) else (_LONG(0), s.rows)
        if len(tests) == 2 and all(_same_kind(s.dtypes, field, v) for v in (low, high)):
            exact = s.count(field, lambda c: _test(c, "ge", low) & _test(c, "le", high))
            least, most = every(*tests).known(s)
            # rows below and rows above, of those that have the field
            ends = [t.known(s) for t in tests]
            least = F.greatest(least, ends[0][0] + ends[1][0] - s.present(field))
            return F.coalesce(exact, least), F.coalesce(exact, most)
        return every(*tests).known(s)

    return Rule(passes, known)


def within(field: str, values: list) -> Predicate:
    """One of the values."""
    tests = [equals(field, v) for v in dict.fromkeys(values)]  # no row passes two of them

    def known(s: Summary) -> Bounds:
        each = [t.known(s) for t in tests] or [(_LONG(0), _LONG(0))]
        return reduce(lambda a, b: a + b, [b[0] for b in each]), F.least(s.rows, reduce(lambda a, b: a + b, [b[1] for b in each]))

    return Rule(some(*tests).passes, known)


def every(*predicates: Predicate) -> Predicate:
    """All of them; true where there are none."""

    def known(s: Summary) -> Bounds:
        each = [bounds(p, s) for p in predicates]
        least = reduce(lambda a, b: a + b, [b[0] for b in each], _LONG(0)) - s.rows * (len(each) - 1)
        return F.greatest(_LONG(0), least), reduce(F.least, [b[1] for b in each], s.rows)

    return Rule(lambda df: reduce(lambda a, b: a & b, [p(df) for p in predicates], F.lit(True)), known)


def some(*predicates: Predicate) -> Predicate:
    """Any of them; false where there are none."""

    def known(s: Summary) -> Bounds:
        each = [bounds(p, s) for p in predicates]
        most = reduce(lambda a, b: a + b, [b[1] for b in each], _LONG(0))
        return reduce(F.greatest, [b[0] for b in each], _LONG(0)), F.least(s.rows, most)

    return Rule(lambda df: reduce(lambda a, b: a | b, [p(df) for p in predicates], F.lit(False)), known)


def has_label(field: str, label: str) -> Predicate:
    """The label is among the row's labels."""

    def known(s: Summary) -> Bounds:
        if s.dtypes.get(field) != "array<string>" or not s.knows(field):
            return _LONG(0), s.rows
        exact = s.count(field, lambda c: c == label)
        return F.coalesce(exact, _LONG(0)), F.coalesce(exact, F.when(s.may_hold(field, label), s.present(field)), _LONG(0))

    return Rule(lambda df: F.coalesce(F.array_contains(field, label), F.lit(False)), known)


def negate(predicate: Predicate) -> Predicate:
    """The rows that the predicate doesn't pass, those without the attribute among them."""

    def known(s: Summary) -> Bounds:
        least, most = bounds(predicate, s)
        return s.rows - most, s.rows - least

    return Rule(lambda df: ~predicate(df), known)


def selectivity(df: DataFrame, predicate: Predicate) -> DataFrame:
    """Rows, rows that pass, and their share."""
    hit = predicate(df)
    n, m = F.count("*"), F.count(F.when(hit, 1))
    return df.agg(n.alias("n_rows"), m.alias("n_matches"), F.coalesce(m / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("selectivity"))
