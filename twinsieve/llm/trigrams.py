"""Which trigrams a text must have for a regular expression to match in it.

`clauses(pattern)` gives alternatives: a match needs every trigram of at least one of
them. None says that nothing can be told, so that the rule has to scan every text.
Trigrams are in lower case, for an index over lower-cased text.

The pattern is read by Python's own parser. Runs of parts with few known strings are
multiplied out; anything else ends the run and demands nothing.
"""

from re import _constants as C
from re import _parser

MOST_STRINGS = 64

Clauses = frozenset[frozenset[str]]
ANYTHING: Clauses = frozenset([frozenset()])


def _lean(clauses) -> Clauses:
    """Without alternatives that ask for more than another one does."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _lean({x | y for x in a for y in b})


def _of_strings(strings: set[str]) -> Clauses:
    return _lean({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _characters(items) -> set[str] | None:
    found = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < MOST_STRINGS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _walk(parts) -> tuple[set[str] | None, Clauses]:
    """All strings the parts can match, if few; and what a match demands."""
    demands, run = ANYTHING, {""}
    whole = True
    for op, value in parts:
        strings, inner = None, ANYTHING
        if op is C.LITERAL:
            strings = {chr(value).lower()}
        elif op is C.IN:
            strings = _characters(value)
        elif op is C.SUBPATTERN:
            strings, inner = _walk(value[-1])
        elif op is C.BRANCH:
            branches = [_walk(branch) for branch in value[1]]
            if all(s is not None for s, _ in branches):
                strings = set().union(*(s for s, _ in branches))
            inner = _lean(set().union(*(d for _, d in branches)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, body = value
            strings, inner = _walk(body)
            if strings is not None and most == 1:
                strings = strings | {""} if least == 0 else strings
            elif strings is not None and least == most and len(strings) == 1:
                strings = {next(iter(strings)) * least}
            elif least and strings is not None:
                # At least so many of them, and then perhaps more.
                run = {a + b for a in run for b in strings} if len(run) * len(strings) <= MOST_STRINGS else {""}
                strings = None
            else:
                strings = None
            inner = inner if least else ANYTHING
        elif op is C.AT:
            strings = {""}
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            demands, run, whole = _both(_both(demands, _of_strings(run)), inner), strings or {""}, False
    return (run if whole else None), _both(demands, _of_strings(run))


def clauses(pattern: str) -> list[list[str]] | None:
    found = _walk(_parser.parse(pattern))[1]
    if any(not c for c in found):
        return None
    return sorted(sorted(c) for c in found)
