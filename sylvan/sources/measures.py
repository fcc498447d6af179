"""Sums over subtrees that are known as soon as a tree is made, from its encoded rows.

The same measures as operators.metrics has on occurrences: with nodes in pre-order a sum over
a subtree is a difference of two running sums, here within the list of one tree's rows.
"""

from __future__ import annotations

from itertools import accumulate

#: Node types of comments: fixed values.
COMMENTS = frozenset(["comment", "line_comment", "block_comment"])


def _breaks(rows: list[list]) -> list[int]:
    return [r[8].count("\n") if r[4] == 1 and r[8] else 0 for r in rows]


def _loc(rows: list[list]) -> list[int]:
    """White-space nodes with a line break, but for comments, the sibling right after one, and all below them."""
    out, until, after = [], 0, set()
    for r in rows:
        comment, key = r[7] in COMMENTS, r[1]
        muted = comment or key in after
        if comment:
            after.add(key)
        elif key in after:
            after.discard(key)
        out.append(int(r[7] == "spaces" and "\n" in (r[8] or "") and not muted and until <= r[0]))
        if muted:
            until = max(until, r[0] + r[4])
    return out


#: What each node itself adds to a sum, by name: rows of OCC -> values.
OWN = {
    "size_no_spaces": lambda rows: [int(r[7] != "spaces") for r in rows],
    "spaces": lambda rows: [int(r[7] == "spaces") for r in rows],
    "bytes_len": lambda rows: [len(r[8].encode()) if r[4] == 1 and r[8] else 0 for r in rows],
    "line_count": _breaks,
    "loc": _loc,
}


def measure(rows: list[list], sums: tuple[str, ...], before: tuple[str, ...], keep) -> list[list]:
    """Rows that keep holds for (all, if None), each with its sums and with what lies before it in pre-order."""
    chosen = rows if keep is None else [r for r in rows if keep(r)]
    if not sums and not before:
        return chosen
    run = {name: [0, *accumulate(OWN[name](rows))] for name in {*sums, *before}}
    return [[*r, *(run[n][r[0] + r[4]] - run[n][r[0]] for n in sums), *(run[n][r[0]] for n in before)] for r in chosen]
