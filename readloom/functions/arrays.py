"""SQL over arrays of one row whose work grows in proportion to their length."""

from __future__ import annotations

#: Items of a block of a running sum.
BLOCK = 64


def bound(values: dict[str, str], body: str, v: str) -> str:
    """SQL: body, which names the values as fields of v. They are worked out once for a row; as plain columns the optimizer would move them
    into lambdas that use them, which would work them out for each item."""
    return f"transform(array(struct({', '.join(f'{x} AS {n}' for n, x in values.items())})), {v} -> {body})[0]"


def _sum(items: str, first: str, n: str) -> str:
    return f"aggregate(slice({items}, {first} + 1, {n}), 0, (x, y) -> x + y)"


def sums_before(items: str) -> str:
    """SQL: for each number of an array the sum of those before it, by blocks and blocks of blocks; an array of one block is summed at once."""
    blocks = lambda a: f"transform(sequence(0, (size({a}) - 1) DIV {BLOCK}), j -> {_sum(a, f'j * {BLOCK}', str(BLOCK))})"
    upto = f"{_sum('s2.wide', '0', f'j DIV {BLOCK}')} + {_sum('s2.sums', f'j DIV {BLOCK} * {BLOCK}', f'j % {BLOCK}')}"
    each = f"transform(s3.items, (item, i) -> s3.before[i DIV {BLOCK}] + {_sum('s3.items', f'i DIV {BLOCK} * {BLOCK}', f'i % {BLOCK}')})"
    ready = bound({"items": "s2.items", "before": f"transform(s2.sums, (unused, j) -> {upto})"}, each, "s3")
    wide = bound({"items": "s1.items", "sums": "s1.sums", "wide": blocks("s1.sums")}, ready, "s2")
    many = bound({"items": "s0.items", "sums": blocks("s0.items")}, wide, "s1")
    few = f"transform(s0.items, (item, i) -> {_sum('s0.items', '0', 'i')})"
    return bound({"items": items}, f"CASE WHEN size(s0.items) <= {BLOCK} THEN {few} ELSE {many} END", "s0")
