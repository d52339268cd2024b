"""Rule compiler: one regex dialect in, two engines out.

Patterns in packs are written in Python ``re`` syntax (the dialect rule authors
know).  Spark evaluates ``rlike``/``regexp_*`` with ``java.util.regex`` and the
DuckDB oracle uses RE2, and the three disagree on Unicode classes, word
boundaries and case folding.  ``to_java`` rewrites a pattern so that Java gives
Python's answer; ``to_re2`` does the same for RE2 where RE2 can express it.

Only the constructs that differ are rewritten; everything else is copied.
"""

from __future__ import annotations

import re

# Python's \w / \d / \s for str patterns, spelled as explicit Unicode classes.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE_JAVA = r"\s\x{1c}-\x{1f}\x{85}\p{Z}"
SPACE_RE2 = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"

_QUANT = re.compile(r"\{(\d*)(,?)(\d*)\}")

# Flag sets used by callers.  ``i`` = IGNORECASE, ``s`` = DOTALL.
SEARCH_FLAGS = "is"


def _class_escape(ch: str, space: str) -> str | None:
    return {"d": DIGIT, "w": WORD, "s": space}.get(ch)


def _is_word_literal(pattern: str, k: int) -> bool:
    """pattern[k] is an unescaped ASCII word character outside a class."""
    if k < 0 or k >= len(pattern):
        return False
    ch = pattern[k]
    if not (ch.isascii() and (ch.isalnum() or ch == "_")):
        return False
    b = 0
    j = k - 1
    while j >= 0 and pattern[j] == "\\":
        b += 1
        j -= 1
    return b % 2 == 0


def _split_top(body: str) -> list[str]:
    parts, depth, cur, i = [], 0, [], 0
    while i < len(body):
        ch = body[i]
        if ch == "\\":
            cur.append(body[i:i + 2])
            i += 2
            continue
        if ch == "[":
            j = body.find("]", i + 2)
            j = len(body) - 1 if j < 0 else j
            cur.append(body[i:j + 1])
            i = j + 1
            continue
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append("".join(cur))
            cur = []
            i += 1
            continue
        cur.append(ch)
        i += 1
    parts.append("".join(cur))
    return parts


def _group_at(pattern: str, start: int) -> tuple[str, int] | None:
    """Body and end index of the group opening at ``start`` (plain or ``(?:``)."""
    depth, i = 0, start
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 2
            continue
        if ch == "[":
            j = pattern.find("]", i + 2)
            if j < 0:
                return None
            i = j + 1
            continue
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
            if depth == 0:
                body = pattern[start + 1:i]
                if body.startswith("?:"):
                    body = body[2:]
                elif body.startswith("?"):
                    return None
                return body, i
        i += 1
    return None


def _starts_word(pattern: str, j: int) -> bool:
    if _is_word_literal(pattern, j):
        return j + 1 >= len(pattern) or pattern[j + 1] not in "?*{"
    if j < len(pattern) and pattern[j] == "(":
        g = _group_at(pattern, j)
        if g is None:
            return False
        body, end = g
        if end + 1 < len(pattern) and pattern[end + 1] in "?*{":
            return False
        return all(alt and _starts_word(alt, 0) for alt in _split_top(body))
    return False


def _ends_word(pattern: str, j: int) -> bool:
    """The regex text ending at index j (inclusive) always ends with a word character."""
    if _is_word_literal(pattern, j):
        return True
    if j >= 0 and pattern[j] == ")":
        depth, i = 0, j
        while i >= 0:
            if pattern[i] == ")" and (i == 0 or pattern[i - 1] != "\\"):
                depth += 1
            elif pattern[i] == "(" and (i == 0 or pattern[i - 1] != "\\"):
                depth -= 1
                if depth == 0:
                    break
            i -= 1
        if i < 0:
            return False
        g = _group_at(pattern, i)
        if g is None or g[1] != j:
            return False
        return all(alt and _ends_word(alt, len(alt) - 1) for alt in _split_top(g[0]))
    return False


def _translate(pattern: str, engine: str) -> str:
    space = SPACE_JAVA if engine == "java" else SPACE_RE2
    out: list[str] = []
    i, n = 0, len(pattern)

    def prev_opens() -> bool:
        # True when the next token starts an alternative (used for RE2 \b).
        tail = "".join(out[-3:])
        return not out or tail.endswith(("(", "|", "(?:", "^"))

    gap = re.compile(r"\\b\.\{0,(\d+)\}\\b")

    while i < n:
        c = pattern[i]
        if c == "\\" and i + 1 < n:
            e = pattern[i + 1]
            i += 2
            if e in "dws":
                out.append("[" + _class_escape(e, space) + "]")
            elif e in "DWS":
                out.append("[^" + _class_escape(e.lower(), space) + "]")
            elif e in "bB":
                if engine == "java":
                    w = f"[{WORD}]"
                    if e == "b" and _starts_word(pattern, i) and not _ends_word(pattern, i - 3):
                        out.append(f"(?<!{w})")
                    elif e == "b" and _ends_word(pattern, i - 3) and not _starts_word(pattern, i):
                        out.append(f"(?!{w})")
                    elif e == "b":
                        out.append(f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")
                    else:
                        out.append(f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))")
                else:
                    if e == "B":
                        raise ValueError("\\B has no RE2 equivalent")
                    m = gap.match(pattern, i - 2)
                    if m and not prev_opens():
                        # word\b.{0,N}\bword: the gap starts and ends with a non-word
                        # character (one character may serve both boundaries).
                        k = int(m.group(1))
                        nw = f"[^{WORD}]"
                        out.append(f"(?:{nw}|{nw}.{{0,{max(k - 2, 0)}}}{nw})" if k >= 1 else "(?!)")
                        i = m.end()
                        continue
                    if prev_opens():
                        out.append(f"(?:^|[^{WORD}])")
                    else:
                        out.append(f"(?:$|[^{WORD}])")
            elif e == "Z":
                out.append(r"\z")
            else:
                out.append("\\" + e)
            continue
        if c == "[":
            j = i + 1
            body: list[str] = []
            negate = False
            if j < n and pattern[j] == "^":
                negate = True
                j += 1
            first = True
            while j < n and (pattern[j] != "]" or first):
                ch = pattern[j]
                first = False
                if ch == "\\" and j + 1 < n:
                    e = pattern[j + 1]
                    j += 2
                    if e in "dws":
                        body.append(_class_escape(e, space))
                    elif e in "DWS":
                        if engine != "java":
                            raise ValueError("negated class escape inside [] has no RE2 form")
                        body.append("[^" + _class_escape(e.lower(), space) + "]")
                    else:
                        body.append("\\" + e)
                    continue
                if ch in "[&" or (ch == "]"):
                    body.append("\\" + ch)
                else:
                    body.append(ch)
                j += 1
            out.append("[" + ("^" if negate else "") + "".join(body) + "]")
            i = j + 1
            continue
        if c == "{":
            m = _QUANT.match(pattern, i)
            if m and (m.group(1) or m.group(3)) and (m.group(1) or m.group(2)):
                lo, comma, hi = m.groups()
                out.append("{" + (lo or "0") + comma + hi + "}")
                i = m.end()
            else:
                out.append(r"\{")
                i += 1
            continue
        if c == "}":
            out.append(r"\}")
            i += 1
            continue
        if c == "(" and pattern.startswith("(?P<", i):
            out.append("(?<" if engine == "java" else "(?P<")
            i += 4
            continue
        if c == "(" and pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            if engine != "java":
                raise ValueError("backreferences have no RE2 form")
            out.append(r"\k<" + pattern[i + 4 : end] + ">")
            i = end + 1
            continue
        if c == "(" and engine != "java" and (pattern.startswith("(?=", i) or pattern.startswith("(?!", i)
                                             or pattern.startswith("(?<=", i) or pattern.startswith("(?<!", i)):
            raise ValueError(f"lookaround has no RE2 form: {pattern!r}")
        if c == "$" and engine != "java":
            # Python's non-multiline $ also matches before one final newline.
            out.append(r"(?:\n?\z)")
            i += 1
            continue
        out.append(c)
        i += 1
    return "".join(out)


def to_java(pattern: str, flags: str = SEARCH_FLAGS) -> str:
    """Python-dialect pattern -> java.util.regex pattern with Python semantics.

    ``flags``: ``i`` ignore case (Unicode folding), ``s`` dot matches newline.
    UNIX_LINES (``d``) makes ``$`` and ``.`` treat only ``\\n`` as a line end,
    as Python does.
    """
    prefix = "(?d" + ("iu" if "i" in flags else "") + ("s" if "s" in flags else "") + ")"
    return prefix + _translate(pattern, "java")


def to_re2(pattern: str, flags: str = SEARCH_FLAGS) -> str:
    """Python-dialect pattern -> RE2 (DuckDB) pattern, for the SQL oracle."""
    fl = ("i" if "i" in flags else "") + ("s" if "s" in flags else "")
    return ("(?" + fl + ")" if fl else "") + _translate(pattern, "re2")


def alternation(patterns: list[str]) -> str:
    """OR of several patterns as one regex, each kept in its own group."""
    return "|".join(f"(?:{p})" for p in patterns)


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal (both dialects)."""
    return "'" + s.replace("'", "''") + "'"
