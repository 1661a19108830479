"""Fitting the stop lists of a route's trips into one order.

Per-route helper of ``operators.routes``: it sees only the distinct stop lists of one route and
direction, already counted by Spark.
"""

from __future__ import annotations

from bisect import bisect_left


def fit_patterns(patterns: list[list[str]]) -> tuple[list[str], list[list[int]]]:
    """``patterns``: distinct stop lists, most important first. Returns the merged order and, for
    each list, the place of each of its stops in it. A stop visited twice has two places.

    Each place is a token that keeps its identity while others are slotted in around it, so places
    are only numbered once, at the end."""
    names: list[str] = []  # token -> stop
    order: list[int] = []
    paths: list[list[int]] = []

    def token(stop: str) -> int:
        names.append(stop)
        return len(names) - 1

    for pattern in patterns:
        spots: dict[str, list[int]] = {}
        for position, t in enumerate(order):
            spots.setdefault(names[t], []).append(position)
        shared: list[int | None] = []
        reached = 0
        for stop in pattern:
            here = spots.get(stop, [])
            k = bisect_left(here, reached)
            if k == len(here):
                shared.append(None)
            else:
                shared.append(order[here[k]])
                reached = here[k] + 1
        path = [token(stop) if t is None else t for stop, t in zip(pattern, shared)]
        known = [t for t in shared if t is not None]
        if not known:
            order = order + path
        else:
            following: dict[int | None, list[int]] = {}
            anchor = None
            for t, was_shared in zip(path, shared):
                if was_shared is None:
                    following.setdefault(anchor, []).append(t)
                else:
                    anchor = t
            rebuilt: list[int] = []
            for t in order:
                if t == known[0]:
                    rebuilt += following.get(None, [])
                rebuilt.append(t)
                rebuilt += following.get(t, [])
            order = rebuilt
        paths.append(path)
    place = {t: i for i, t in enumerate(order)}
    return [names[t] for t in order], [[place[t] for t in path] for path in paths]


def by_importance(patterns: list[tuple[list[str], int]]) -> list[int]:
    """Indexes of (stops, trips) pairs: the longest list first, the others by trips using them."""
    by_length = sorted(
        range(len(patterns)), key=lambda i: (-len(patterns[i][0]), -patterns[i][1], patterns[i][0])
    )
    others = sorted(
        by_length[1:], key=lambda i: (-patterns[i][1], -len(patterns[i][0]), patterns[i][0])
    )
    return by_length[:1] + others
