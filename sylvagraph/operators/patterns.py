"""Whether a search pattern may be run: star height on the pattern's own tree.

A pattern is refused if a repetition stands within another one, if it has too many repetitions, or if it can't be read. Every quantifier counts, ``?`` and ``{n}`` too.
"""

from __future__ import annotations

import re

#: Fixed value: repetitions that a pattern may have.
MOST_REPETITIONS = 25
_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})\??")
_GROUP = re.compile(r"\((?:\?(?::|=|!|<=|<!|<[A-Za-z_]\w*>))?")
_ESCAPE = re.compile(r"\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|c[A-Za-z]|k<\w+>|.)", re.S)


def _class_end(pattern: str, at: int) -> int:
    """Where the character class that begins at ``at`` ends."""
    at += 1
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 1
        elif pattern[at] == "]":
            return at + 1
        at += 1
    raise ValueError("a character class without an end")


def star_height(pattern: str) -> tuple[int, int]:
    """How deep repetitions stand within each other, and how many there are. Raises ValueError for what isn't a pattern."""
    # A level for each open group: the height of what has been read in it so far.
    heights, repetitions, at = [0], 0, 0
    while at < len(pattern):
        sign, height = pattern[at], 0
        if sign == "(":
            heights.append(0)
            at = _GROUP.match(pattern, at).end()
            if pattern[at - 1 : at + 1] == "(?":
                raise ValueError("an unknown kind of group")
            if _QUANTIFIER.match(pattern, at):
                raise ValueError("nothing to repeat")
            continue
        if sign == "|":
            at += 1
            if _QUANTIFIER.match(pattern, at):
                raise ValueError("nothing to repeat")
            continue
        if sign == ")":
            if len(heights) == 1:
                raise ValueError("a group that wasn't opened")
            height, at = heights.pop(), at + 1
        elif sign == "[":
            at = _class_end(pattern, at)
        elif sign == "\\":
            found = _ESCAPE.match(pattern, at)
            if not found:
                raise ValueError("an escape without a character")
            at = found.end()
        elif _QUANTIFIER.match(pattern, at):
            raise ValueError("nothing to repeat")
        else:
            at += 1
        repeated = _QUANTIFIER.match(pattern, at)
        if repeated:
            height, repetitions, at = height + 1, repetitions + 1, repeated.end()
        heights[-1] = max(heights[-1], height)
    if len(heights) > 1:
        raise ValueError("a group without an end")
    return heights[0], repetitions


def is_safe(pattern: str) -> bool:
    try:
        height, repetitions = star_height(pattern)
    except ValueError:
        return False
    return height <= 1 and repetitions <= MOST_REPETITIONS
