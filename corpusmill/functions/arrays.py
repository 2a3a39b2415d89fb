"""Array expressions that stay linear: binding a value once, running totals and maxima, first occurrences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256


def higher(name: str, *args: Column | str) -> Column:
    """A function of arrays whose lambdas are given in SQL: parsed in one call, where a Python lambda makes several for each
    of its nodes, which adds up to seconds in large plans."""
    return F.call_function(name, *(F.expr(a) if isinstance(a, str) else a for a in args))


def let(value: Column, use: Callable[[Column], Column] | str) -> Column:
    """``use`` of a value that is computed once, however often ``use``, a function or a lambda in SQL, names it."""
    one = F.array(value)
    return F.get(higher("transform", one, use) if isinstance(use, str) else F.transform(one, use), F.lit(0))


def running(values: Column | str, combine: str, zero: str) -> Column | str:
    """Inclusive running values over an array of integers; ``combine`` is SQL for the value after those in ``grown``, at
    ``x``. Of an array given in SQL the running values are SQL too.

    An accumulator that grows by one element a step is copied each time, so the array is taken in chunks: only a chunk's
    own accumulator grows by elements, the outer one grows by chunks.
    """
    step = f"array_append(grown, {combine})"
    grown = f"aggregate(chunk, array(acc.reached), (grown, x) -> {step})"
    extend = f"transform(array({grown}), g -> named_struct('reached', element_at(g, -1), 'parts', array_append(acc.parts, slice(g, 2, size(chunk)))))[0]"
    chunks = f"transform(sequence(0, greatest(0, cast(floor((size(xs) - 1) / {CHUNK}) AS int))), i -> slice(xs, i * {CHUNK} + 1, {CHUNK}))"
    start = f"named_struct('reached', {zero}, 'parts', cast(array() AS array<array<int>>))"
    use = f"xs -> aggregate({chunks}, {start}, (acc, chunk) -> {extend}, acc -> flatten(acc.parts))"
    return f"transform(array({values}), {use})[0]" if isinstance(values, str) else let(values, use)


def running_totals(values: Column | str) -> Column | str:
    return running(values, "element_at(grown, -1) + x", "0")


def running_maxima(values: Column) -> Column:
    return running(values, "greatest(element_at(grown, -1), x)", "cast(-2147483648 AS int)")


def first_flags(keys: Column) -> Column:
    """For each element, whether it is the first of its value; by sorting, not by comparing all pairs."""
    ranked = higher("array_sort", higher("transform", keys, "(k, i) -> named_struct('k', k, 'i', i)"))
    marked = let(ranked, "r -> transform(r, (x, n) -> named_struct('i', x.i, 'fresh', n = 0 OR NOT (x.k <=> get(r, n - 1).k)))")
    return higher("transform", F.array_sort(marked), "x -> x.fresh")
