"""Boolean trigram queries that a regular expression implies.

A query is a list of clauses, each a set of trigrams: a text that matches holds all trigrams of one
clause at least. ``None`` says that nothing is implied, so every text must be scanned. Trigrams are in
lower case and meant for lower-cased texts, which keeps them right for either case.
"""

from __future__ import annotations

import re
from itertools import product

try:  # the parser's name since Python 3.11
    from re import _parser as parser
except ImportError:  # pragma: no cover
    import sre_parse as parser

#: Strings that one position may stand for, and clauses that a query may have, before it is given up.
MAX_STRINGS = 64


def _exact(items) -> set[str] | None:
    """All strings that these items match, if they are few; else None."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            here = {chr(arg)}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            here = {chr(c) for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
        elif name == "SUBPATTERN":
            here = _exact(arg[-1])
        elif name == "ATOMIC_GROUP":
            here = _exact(arg)
        elif name == "BRANCH":
            each = [_exact(x) for x in arg[1]]
            here = None if None in each else set().union(*each)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 4:
            one = _exact(arg[2])
            here = None if one is None or len(one) > 4 else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
        elif name == "AT":
            here = {""}
        else:
            here = None
        if here is None:
            return None
        out = {a + b.lower() for a in out for b in here}
        if len(out) > MAX_STRINGS:
            return None
    return out


def _of_strings(strings: set[str]) -> list[frozenset] | None:
    if any(len(s) < 3 for s in strings):
        return None
    return sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}, key=sorted)


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    out = {x | y for x in a for y in b}
    if len(out) > MAX_STRINGS:
        return min(a, b, key=len)
    return [x for x in sorted(out, key=sorted) if not any(y < x for y in out)]


def _query(items):
    """Runs of items with few strings each give a condition; other items end a run and may add their own."""
    query, run = None, []

    def end():
        nonlocal query, run
        if run and (strings := _exact(run)) is not None:
            query = _both(query, _of_strings(strings))
        run = []

    for item in items:
        op, arg = str(item[0]), item[1]
        if _exact([*run, item]) is not None:
            run.append(item)
            continue
        end()
        if _exact([item]) is not None:
            run.append(item)
        elif op == "SUBPATTERN":
            query = _both(query, _query(arg[-1]))
        elif op == "BRANCH":
            each = [_query(x) for x in arg[1]]
            query = _both(query, None if None in each else sorted({c for q in each for c in q}, key=sorted))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            query = _both(query, _query(arg[2]))
    end()
    return query


def trigram_query(pattern: str) -> list[frozenset] | None:
    return _query(list(parser.parse(pattern)))


if __name__ == "__main__":  # a look at what a pattern implies
    import sys

    re.compile(sys.argv[1])
    print(trigram_query(sys.argv[1]))
