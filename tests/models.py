"""Plain forms that take one thing after the other."""

from __future__ import annotations


def find_subsets(items: list[tuple[str, int]], target: int, tolerance: int, most: int, solutions: int = 2) -> list[tuple[list[str], int]]:
    """Sets of at most `most` items that sum to target within tolerance, as (sorted ids, total), by a search that goes deep first.

    Larger values are tried first, of equal ones the smaller id. A set that fits is not extended.
    """
    order = sorted(items, key=lambda x: (-x[1], x[0]))
    found: list[tuple[list[str], int]] = []

    def search(at: int, total: int, chosen: list[str]) -> None:
        if len(found) == solutions or total > target + tolerance:
            return
        if chosen and total >= target - tolerance:
            found.append((sorted(chosen), total))
        elif len(chosen) < most:
            for i in range(at, len(order)):
                search(i + 1, total + order[i][1], [*chosen, order[i][0]])

    search(0, 0, [])
    return found
