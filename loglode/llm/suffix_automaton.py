"""Cheapest repair of role sequences: a suffix-shared automaton of signatures, solved from the end.

A signature has one symbol a row: the role's initial `s`, `u`, `a`, or `o` for any other role, as a capital where the
text is cut off, and `-` for a row that has to go. Every distinct suffix is one node; two signatures that end alike share
the nodes of that end. A node holds, for each grammar state, the cost from there to the end and the first edit of the best
way, which with the node and state behind it is the best audit suffix; it is found once, from the node behind.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Grammar (s?(ua)+)? : nothing yet, behind s, behind u, behind a.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
#: The state behind an own row of the role the grammar asks for next.
NEXT = (USER, USER, ASSISTANT, USER)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
GONE = "-"

#: Of each state: cost to the end, first edit (none at the end), state behind that edit.
Node = tuple[tuple[int, str, int], ...]


def _with_inserts(base: list[tuple[int, str, int] | None]) -> Node:
    """Each state's best of its own edits and of an insert before them; equal costs by the smaller letter."""
    costs = [b[0] if b else None for b in base]
    cheapest = list(costs)
    for _ in range(3):  # an insert leads from state to state; two lead back
        for s in range(4):
            on = cheapest[NEXT[s]]
            if on is not None and (cheapest[s] is None or on + INSERT < cheapest[s]):
                cheapest[s] = on + INSERT
    out = []
    for s in range(4):
        inserted = (cheapest[NEXT[s]] + INSERT, "I", NEXT[s])
        out.append(min(b for b in (base[s], inserted) if b))
    return tuple(out)


END: Node = _with_inserts([(0, "", START), None, None, (0, "", ASSISTANT)])


def node(symbol: str, behind: Node) -> Node:
    """The node of a suffix from the one of the suffix behind its first symbol."""
    initial, cut = symbol.lower(), CUT_OFF if symbol.isupper() else 0
    base = []
    for s in range(4):
        ways = [(behind[s][0] + DELETE, "D", s)]
        if symbol != GONE:
            ways.append((behind[NEXT[s]][0] + REROLE + cut, "R", NEXT[s]))
            if s in AFTER[initial]:
                on = AFTER[initial][s]
                ways.append((behind[on][0] + cut, "K", on))
        base.append(min(ways))
    return _with_inserts(base)


def solve(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of each; signatures sorted from their ends keep only the nodes of one path in memory.

    In another order the results are the same, but fewer nodes are shared.
    """
    path, ends = [END], ""
    for signature in signatures:
        shared = _common_end(signature, ends)
        del path[shared + 1 :]
        for symbol in reversed(signature[: len(signature) - shared]):
            path.append(node(symbol, path[-1]))
        ends = signature
        yield signature, path[-1][START][0], audit(path)


def _common_end(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[len(a) - n :] == b[len(b) - n :]:
        return n
    low, high = 0, n  # the ends agree for `low` symbols, not for `high`
    while high - low > 1:
        mid = (low + high) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid
    return low


def audit(path: list[Node]) -> str:
    """The edits along a path, from its last node to the end."""
    out, state = [], START
    for at in range(len(path) - 1, -1, -1):
        while True:
            _, letter, state_on = path[at][state]
            out.append(letter)
            state = state_on
            if letter != "I":
                break
    return "".join(out)
