"""Tokens of JavaScript and TypeScript, and masks of other brace languages: one state machine each over a text.

Strings, templates with code inside, comments, regular expressions and markup (JSX) are told apart by what stands before them, so a quote in a comment, a brace in a string
or a slash after a value mislead nothing that follows.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  #: name, number, string, template, regex, markup or sign
    text: str
    start: int
    end: int
    first: bool  #: whether it is the first of its line


_NAME = re.compile(r"[#@]?[A-Za-z_$\u0080-\U0010FFFF][\w$\u0080-\U0010FFFF]*")
_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)n?")
_SIGN = re.compile(r"=>|\?\.(?!\d)|\.\.\.|===|!==|==|!=|\*\*=?|&&=?|\|\|=?|\?\?=?|<=|\+\+|--|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#\\]")
_TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
#: After these a value begins, as it does after signs.
BEFORE_VALUES = {"return", "typeof", "instanceof", "in", "of", "new", "delete", "void", "throw", "case", "do", "else", "yield", "await", "default", "extends", "export", "as", "satisfies", "keyof"}
_HEADS = {"if", "while", "for", "with"}


def _string_end(text: str, at: int) -> int:
    quote, at = text[at], at + 1
    while at < len(text) and text[at] != quote and text[at] != "\n":
        at += 2 if text[at] == "\\" else 1
    return min(at + 1, len(text))


def _regex_end(text: str, at: int) -> int:
    """Where the regular expression that begins at ``at`` ends; ``at`` if there is none in the line."""
    k, in_class = at + 1, False
    while k < len(text) and text[k] != "\n":
        if text[k] == "\\":
            k += 1
        elif text[k] == "[":
            in_class = True
        elif text[k] == "]":
            in_class = False
        elif text[k] == "/" and not in_class:
            k += 1
            while k < len(text) and text[k].isalpha():
                k += 1
            return k
        k += 1
    return at


def tokens(text: str, markup: bool = False) -> list[Token]:
    """The tokens of a script; comments are left out. With ``markup``, elements (JSX) stand where values may."""
    out: list[Token] = []
    # What is open: "{" code in braces (with whether it stands for a value), "${" code in a template, "(" with whether a statement's head, "[",
    # "<" a tag (with whether it closes an element), "<>" an element's children, "{}" code in markup.
    open_: list[tuple[str, bool]] = []
    at, first, size = 0, True, len(text)

    def add(kind: str, end: int) -> None:
        nonlocal at, first
        out.append(Token(kind, text[at:end], at, end, first))
        at, first = end, False

    def template() -> None:
        """From ``at`` to the next code or the end of the template."""
        nonlocal at
        begin = at
        at += 1
        while at < size:
            if text[at] == "\\":
                at += 2
                continue
            if text[at] == "`":
                end = at + 1
                break
            if text.startswith("${", at):
                open_.append(("${", False))
                end = at + 2
                break
            at += 1
        else:
            end = size
        at = begin
        add("template", end)

    def value_next() -> bool:
        """Whether a value begins here, so a slash is no division and a less-than sign may open an element."""
        if not out:
            return True
        last = out[-1]
        if last.kind == "name":
            return last.text in BEFORE_VALUES
        if last.kind == "template":
            return last.text.endswith("${")
        if last.kind != "sign":
            return False
        return closed_value[-1] if last.text in ")}" and closed_value else last.text not in ("]", ")", "}", "++", "--")

    closed_value: list[bool] = []  # whether a value may begin after the bracket that was closed last

    while at < size:
        mode = open_[-1][0] if open_ else ""
        c = text[at]
        if mode == "<>":  # children: text up to a tag or code
            if c == "<":
                add("sign", at + 1)
                closing = at < size and text[at] == "/"
                if closing:
                    add("sign", at + 1)
                    open_.pop()
                open_.append(("<", closing))
            elif c == "{":
                add("sign", at + 1)
                open_.append(("{}", True))
            else:
                end = min((k for k in (text.find("<", at), text.find("{", at)) if k >= 0), default=size)
                add("markup", end)
            continue
        if c == "\n":
            first, at = True, at + 1
            continue
        if c.isspace() or c == "﻿":
            at += 1
            continue
        if c == "/" and text.startswith("//", at):
            end = text.find("\n", at)
            at = size if end < 0 else end
            continue
        if c == "/" and text.startswith("/*", at):
            end = text.find("*/", at + 2)
            stop = size if end < 0 else end + 2
            first = first or "\n" in text[at:stop]
            at = stop
            continue
        if mode == "<":  # inside a tag
            if c in "\"'":
                end = text.find(c, at + 1)
                add("string", size if end < 0 else end + 1)
            elif c == "{":
                add("sign", at + 1)
                open_.append(("{}", True))
            elif c == "/" and text.startswith("/>", at):
                add("sign", at + 2)
                open_.pop()
                closed_value.append(False)
            elif c == ">":
                closing = open_.pop()[1]
                add("sign", at + 1)
                if closing:
                    closed_value.append(False)
                else:
                    open_.append(("<>", False))
            else:
                found = _TAG.match(text, at)
                add("markup", found.end() if found else at + 1)
            continue
        if c in "\"'":
            add("string", _string_end(text, at))
            continue
        if c == "`":
            template()
            continue
        name = _NAME.match(text, at) if c != "@" else None
        if name:
            add("name", name.end())
            continue
        if c.isdigit() or (c == "." and at + 1 < size and text[at + 1].isdigit()):
            add("number", _NUMBER.match(text, at).end())
            continue
        if c == "/" and value_next():
            end = _regex_end(text, at)
            if end > at:
                add("regex", end)
                continue
        if c == "<" and markup and value_next() and at + 1 < size and (text[at + 1] == ">" or _TAG.match(text, at + 1)):
            ahead = _TAG.match(text, at + 1)
            # A comma or "extends" after the name makes it a list of types.
            if not ahead or not re.match(r"\s*(?:,|extends\b)", text[ahead.end() : ahead.end() + 40]):
                add("sign", at + 1)
                open_.append(("<", False))
                continue
        if c == "}" and mode == "${":
            open_.pop()
            template()
            continue
        if c == "{":
            last = out[-1] if out else None
            value = last is not None and (last.text in BEFORE_VALUES - {"do", "else", "default"} if last.kind == "name" else last.kind == "sign" and last.text not in ("{", "}", ")", ";", "=>", "]", ">"))
            open_.append(("{", value))
        elif c == "(":
            open_.append(("(", bool(out) and out[-1].text in _HEADS))
        elif c == "[":
            open_.append(("[", False))
        elif c in ")]}" and open_:
            kind, flag = open_.pop()
            # After a head a statement begins, after a block too; after an object or a call nothing but an operator can follow.
            closed_value.append(flag if kind == "(" else not flag if kind == "{" else False)
        sign = _SIGN.match(text, at)
        add("sign", sign.end() if sign else at + 1)
    return out


def matches(found: list[Token]) -> dict[int, int]:
    """The place of each bracket's partner, both ways. Code in templates is in brackets too."""
    out, open_ = {}, []
    for i, t in enumerate(found):
        if t.kind == "template":
            if t.text.startswith("}") and open_:
                j = open_.pop()
                out[i], out[j] = j, i
            if t.text.endswith("${"):
                open_.append(i)
        elif t.kind == "sign":
            if t.text in "([{":
                open_.append(i)
            elif t.text in (")", "]", "}") and open_:
                j = open_.pop()
                out[i], out[j] = j, i
    return out


#: Comments and strings of brace languages: what begins a comment of one line, and which quotes may span lines.
STYLES = {"ruby": ("#", ""), "bash": ("#", ""), "php": ("//", ""), "go": ("//", "`"), "rust": ("//", '"'), "zig": ("//", "")}
_CHAR = re.compile(r"'(?:\\(?:u\{[0-9A-Fa-f]+\}|.[0-9A-Fa-f]{0,8})|[^'\\\n])'")


def masked(text: str, language: str) -> tuple[str, str]:
    """The text without its comments, and without the insides of its strings too; both as long as the text, so places agree."""
    line, across = STYLES.get(language, ("//", ""))
    code, plain, at, size = [], [], 0, len(text)
    blank = lambda part: re.sub(r"[^\n]", " ", part)
    while at < size:
        c = text[at]
        if text.startswith(line, at) or (language == "php" and c == "#"):
            end = text.find("\n", at)
            end = size if end < 0 else end
        elif line == "//" and text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = size if end < 0 else end + 2
        else:
            end = at
        if end > at:
            code.append(blank(text[at:end]))
            plain.append(code[-1])
            at = end
            continue
        if c in "\"'`" and not (c == "`" and language != "go"):
            if c == "'" and language in ("rust", "cpp", "java", "c_sharp", "go", "zig", "kotlin", "swift"):
                found = _CHAR.match(text, at)
                end = found.end() if found else at + 1  # a lifetime, or a digit's separator
            else:
                end = at + 1
                while end < size and text[end] != c and (text[end] != "\n" or c in across):
                    end += 2 if text[end] == "\\" and c != "`" else 1
                end = min(end + 1, size)
            code.append(text[at:end])
            plain.append(c + blank(text[at + 1 : end - 1]) + c if end - at > 1 else c)
            at = end
            continue
        code.append(c)
        plain.append(c)
        at += 1
    return "".join(code), "".join(plain)
