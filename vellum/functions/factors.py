"""Literal factors of patterns: strings of which every match holds at least one.

Patterns are searched without regard to case.  A factor is made of ASCII
characters and of characters without case, so ``fold`` of a text holds the
factor wherever the pattern's literal may match.
"""

from __future__ import annotations

import re
from re import _constants as K
from re import _parser

#: Alternatives that one factor set may have, and the shortest factor that is worth a look-up.
MOST_ALTERNATIVES, SHORTEST = 32, 2

# The characters outside ASCII that match an ASCII letter when case is ignored
# and that ``str.lower`` does not turn into it.
ODD_CASES = {0x130: "i", 0x131: "i", 0x17F: "s"}


def fold(text: str) -> str:
    """The form of a text in which factors are looked for."""
    return text.translate(ODD_CASES).lower()


def _plain(code: int) -> str | None:
    """A literal as it stands in a folded text, or None if it has other forms."""
    c = chr(code)
    if c.isascii():
        return c.lower()
    return c if c.lower() == c == c.upper() and code not in ODD_CASES else None


def _class(items) -> set[str] | None:
    """The members of a small class of plain characters."""
    out = set()
    for op, value in items:
        if op is not K.LITERAL or (c := _plain(value)) is None:
            return None
        out.add(c)
    return out if len(out) <= 4 else None


def _better(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    """The set whose shortest member is longer; the smaller set of equals."""
    score = lambda s: (-1, 0) if not s else (min(map(len, s)), -len(s))
    return max(a, b, key=score) or None


def _of_sequence(items) -> set[str] | None:
    best, run = None, {""}
    for op, value in items:
        step = None
        if op is K.LITERAL:
            c = _plain(value)
            step = {c} if c is not None else None
        elif op is K.IN:
            step = _class(value)
        elif op is K.AT:
            step = {""}
        elif op is K.SUBPATTERN:
            best = _better(best, _of_sequence(value[-1]))
        elif op is K.BRANCH:
            best = _better(best, _of_branches(value[1]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            best = _better(best, _of_sequence(value[2]))
        elif op is K.ATOMIC_GROUP:
            best = _better(best, _of_sequence(value))
        elif op in (K.ASSERT, K.ASSERT_NOT):
            step = {""}  # takes no characters
        longer = {a + b for a in run for b in step} if step else None
        if longer and len(longer) <= MOST_ALTERNATIVES:
            run = longer
        else:
            best, run = _better(best, run), {""} if not step else step
    return _better(best, run)


def _of_branches(branches) -> set[str] | None:
    out: set[str] = set()
    for b in branches:
        own = _of_sequence(b)
        if not own or min(map(len, own)) < SHORTEST:
            return None
        out |= own
    return out if len(out) <= MOST_ALTERNATIVES else None


def factors(pattern: str) -> list[str]:
    """Strings of which every match of ``pattern`` holds one, in its folded text; none if there are no such.

    A scoped flag that changes how literals match gives none."""
    if re.search(r"\(\?[a-zA-Z]*[a-zA-Z-]+[:)]", pattern.replace("(?P", "")):
        return []
    found = _of_sequence(_parser.parse(pattern, re.IGNORECASE | re.DOTALL))
    return sorted(found) if found and min(map(len, found)) >= SHORTEST else []


# ------------------------------------------------------------- all factor sets of a pattern
#: The folded form in which ``needs`` are looked for has every ASCII digit as "0".
DIGITS = "0123456789"
#: Factor sets that are worth asking for, what is a large one, and the longest factor.
MOST_SETS, LARGE, LONGEST = 2, 6, 24


def fold_digits(text: str) -> str:
    """The form of a text in which ``needs`` are looked for."""
    return fold(text).translate(str.maketrans(DIGITS, "0" * 10))


def _plain0(code: int) -> str | None:
    c = _plain(code)
    return "0" if c is not None and c in DIGITS else c


def _class0(items) -> set[str] | None:
    out = set()
    for op, value in items:
        if op is K.RANGE and ord("0") <= value[0] and value[1] <= ord("9"):
            out.add("0")
        elif op is K.LITERAL and (c := _plain0(value)) is not None:
            out.add(c)
        else:
            return None
    return out if len(out) <= MOST_ALTERNATIVES else None


def _product(a: set[str], b: set[str]) -> set[str] | None:
    out = {x + y for x in a for y in b} if len(a) * len(b) <= MOST_ALTERNATIVES ** 2 else None
    return out if out and len(out) <= MOST_ALTERNATIVES and max(map(len, out)) <= LONGEST else None


def _exact(items) -> set[str] | None:
    """All that a sequence can match, if that is a few short strings."""
    out: set[str] | None = {""}
    for op, value in items:
        if op is K.LITERAL:
            c = _plain0(value)
            step = {c} if c is not None else None
        elif op is K.IN:
            step = _class0(value)
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            step = {""}
        elif op is K.SUBPATTERN:
            step = _exact(value[-1])
        elif op is K.BRANCH:
            each = [_exact(b) for b in value[1]]
            step = None if any(e is None for e in each) else set().union(*each)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and value[0] == value[1] <= LONGEST:
            one, step = _exact(value[2]), {""}
            for _ in range(int(value[0])):
                step = _product(step, one) if one and step else None
        else:
            step = None
        out = _product(out, step) if step else None
        if out is None:
            return None
    return out


def _sets(items) -> list[set[str]]:
    """Sets of strings: every match of a sequence holds a member of each."""
    found, run = [], {""}

    def close(start):
        nonlocal run
        found.append(run)
        run = start

    for op, value in items:
        step = _exact([(op, value)])
        if step and (longer := _product(run, step)):
            run = longer
            continue
        if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and value[0] >= 1:
            one, copies = _exact(value[2]), {""}
            if not one:
                found.extend(_sets(value[2]))
                close({""})
                continue
            for _ in range(int(min(value[0], LONGEST))):
                if (more := _product(copies, one)) is None:
                    break
                copies = more
            run = _product(run, copies) or run
            close(copies)  # the last of the copies are beside what follows
            continue
        if op is K.SUBPATTERN:
            found.extend(_sets(value[-1]))
        elif op is K.ATOMIC_GROUP:
            found.extend(_sets(value))
        elif op is K.BRANCH:
            best = [max(_sets(b), key=_worth, default=None) for b in value[1]]
            if all(best) and all(map(_usable, best)):
                found.append(set().union(*best))
        close(step if step else {""})
    found.append(run)
    return [least for s in found if (least := _least(s)) and _usable(least)]


def _least(strings: set[str]) -> set[str]:
    """Without strings that hold another."""
    return {s for s in strings if not any(o != s and o in s for o in strings)}


def _usable(strings: set[str]) -> bool:
    return bool(strings) and "" not in strings and len(strings) <= MOST_ALTERNATIVES


def _worth(strings: set[str]) -> tuple:
    return (len(strings) <= LARGE, min(map(len, strings)), -len(strings))


def needs(pattern: str) -> list[list[str]]:
    """Sets of strings, the most telling first: every match of ``pattern`` holds, in its ``fold_digits``,
    a string of each.  Empty if there are none, or if a scoped flag changes how literals match."""
    if re.search(r"\(\?[a-zA-Z]*[a-zA-Z-]+[:)]", pattern.replace("(?P", "")):
        return []
    out: list[list[str]] = []
    for s in sorted(_sets(_parser.parse(pattern, re.IGNORECASE | re.DOTALL)), key=_worth, reverse=True):
        if not any(all(any(f in g for f in s) for g in known) for known in out):  # else it follows from one
            out.append(sorted(s))
    return out[:MOST_SETS]
