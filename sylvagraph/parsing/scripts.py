"""Facts of JavaScript and TypeScript from their tokens: what a walk over the declarations, members and calls of a file finds, in its order.

Ranges of tokens are read by what they are: statements and expressions, a class's body, the members of an object, interface or type.
"""

from __future__ import annotations

from sylvagraph.parsing.lexer import BEFORE_VALUES, Token, matches, tokens

_NO_CALLS = {
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "yield", "with", "in", "of", "new", "delete", "void", "throw", "case", "else", "do", "super", "import",
    "as", "satisfies", "is", "keyof", "infer", "asserts", "extends", "implements", "instanceof", "export", "default", "class", "this",
}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "override", "get", "set", "abstract", "declare", "accessor"}
_GOES_ON = {"=", ":", "=>", ",", "(", "[", "{", "?", ".", "?.", "+", "-", "*", "/", "%", "&", "|", "&&", "||", "??", "<", "===", "!==", "==", "!=", "<=", "!", "~", "...", "+=", "-=", "*=", "/=", "^", "**", "||=", "&&=", "??="}
_GOES_BACK = _GOES_ON - {"(", "[", "{", "!", "~", "..."} | {")", "]", "}", ">"}
_END = Token("sign", "", 0, 0, True)


class Walk:
    def __init__(self, text: str, markup: bool):
        self.text, self.toks = text, tokens(text, markup)
        self.match = matches(self.toks)
        self.imports: list[tuple[str, list[str]]] = []
        self.entities: list[tuple[str, str]] = []
        self.exports: list[tuple[str, str | None, bool]] = []
        self.variables: list[str] = []
        self.calls: list[str] = []
        self.statements(0, len(self.toks))

    # Small helpers over places of tokens.
    def at(self, i: int) -> Token:
        return self.toks[i] if 0 <= i < len(self.toks) else _END

    def sign(self, i: int, text: str) -> bool:
        t = self.at(i)
        return t.kind == "sign" and t.text == text

    def word(self, i: int, *texts: str) -> bool:
        t = self.at(i)
        return t.kind == "name" and (not texts or t.text in texts)

    def partner(self, i: int, stop: int) -> int:
        return min(self.match.get(i, stop), stop)

    def source(self, a: int, b: int) -> str:
        """The text of tokens a to b, b included."""
        return self.text[self.at(a).start : self.at(b).end]

    def string(self, i: int) -> str | None:
        t = self.at(i)
        return t.text[1:-1] if t.kind == "string" else None

    def angle_end(self, i: int, stop: int) -> int:
        """The place behind the types in angle brackets that begin at ``i``; ``i`` if there are none."""
        deep, k = 0, i
        while k < stop:
            t = self.at(k)
            if t.kind == "sign":
                if t.text == "<":
                    deep += 1
                elif t.text == ">":
                    deep -= 1
                    if not deep:
                        return k + 1
                elif t.text in "({[":
                    k = self.partner(k, stop)
                elif t.text not in (",", ".", "|", "&", "=>", "?", ":", "=", "...", ")", "-"):
                    return i
            k += 1
        return i

    def ends_here(self, i: int, in_type: bool = False) -> bool:
        """Whether a line that begins with ``i`` begins something new. In a type, ``void`` and the like are names."""
        t, last = self.at(i), self.at(i - 1)
        if not t.first:
            return False
        goes_on = (last.kind == "sign" and last.text in _GOES_ON) or (last.kind == "name" and last.text in (("typeof", "keyof", "extends", "is") if in_type else BEFORE_VALUES))
        return not goes_on and not (t.kind == "sign" and t.text in _GOES_BACK) and not (t.kind == "name" and t.text in ("instanceof", "in", "as", "satisfies", "extends", "implements"))

    def begins_statement(self, i: int) -> bool:
        last = self.at(i - 1)
        if i == 0 or (last.kind == "sign" and last.text in (";", "{", "}")) or (last.kind == "template" and last.text.endswith("${")):
            return last.kind != "template"
        if last.kind == "sign" and last.text == ")":
            return self.word(self.match.get(i - 1, i) - 1, "if", "while", "for", "with") or self.at(i).first
        return self.word(i - 1, "else", "do") or self.ends_here(i)

    def arrow_after(self, i: int, stop: int) -> bool:
        """Whether the parameters that begin at ``i`` belong to an arrow function."""
        if self.sign(i, "<"):
            i = self.angle_end(i, stop)
        if self.word(i) and self.sign(i + 1, "=>"):
            return True
        if not self.sign(i, "("):
            return False
        k = self.partner(i, stop) + 1
        if self.sign(k, ":"):  # the type of the result
            k += 1
            while k < stop and not self.sign(k, "=>"):
                t = self.at(k)
                if t.kind == "sign" and t.text in "({[":
                    k = self.partner(k, stop)
                    if self.sign(k + 1, "=>") and t.text == "(":  # a function's type as the result
                        k += 1
                elif t.kind == "sign" and (t.text in (";", ",", "=", ")", "}", "?")):
                    return False
                k += 1
        return self.sign(k, "=>")

    def add_export(self, exported: bool, default: bool, name: str) -> None:
        if exported:
            self.exports.append((name, name, default))
            if default:
                self.exports.append(("default", name, True))

    def named(self, a: int, b: int) -> list[tuple[str, str]]:
        """(name, alias) of a list in braces."""
        found, part = [], []
        for i in range(a + 1, b + 1):
            if i == b or self.sign(i, ","):
                if part and part[0] == "type" and len(part) > 1 and part[1] != "as":
                    part = part[1:]
                if part:
                    found.append((part[0], part[-1]))
                part = []
            else:
                part.append(self.string(i) or self.at(i).text)
        return found

    # Statements and expressions.
    def statements(self, i: int, stop: int) -> None:
        exported = default = in_case = False
        while i < stop:
            t = self.at(i)
            if t.kind == "sign":
                if t.text == "{":
                    end = self.partner(i, stop)
                    if self.is_block(i, in_case):
                        self.statements(i + 1, end)
                    else:
                        self.members(i + 1, end, "object")
                    i = end + 1
                    exported = default = in_case = False
                    continue
                if t.text == "]" and self.sign(i + 1, "(") and i in self.match:
                    a = self.match[i]
                    if self.is_value(a - 1) and a + 1 < i:
                        self.calls.append(self.source(a + 1, i - 1))
                if t.text == ":" and in_case:
                    in_case = False
                if t.text == ";":
                    exported = default = False
                i += 1
                continue
            if t.kind != "name" or self.sign(i - 1, ".") or self.sign(i - 1, "?."):
                if t.kind == "name":
                    self.call(i, stop)
                i += 1
                continue
            word, begins = t.text, exported or self.begins_statement(i) or self.word(i - 1, "declare", "abstract", "async", "default", "export")
            if word == "import":
                i = self.import_(i, stop, begins)
            elif word == "export" and begins:
                i, exported, default = self.export(i, stop)
            elif word == "case" or (word == "default" and self.sign(i + 1, ":")):
                in_case, i = True, i + 1
            elif word == "function":
                k = i + 1 + self.sign(i + 1, "*")
                if self.word(k):
                    if begins:
                        self.entities.append(("function", self.at(k).text))
                        self.add_export(exported, default, self.at(k).text)
                    k += 1
                i, exported, default = k, False, False
            elif word == "class":
                k = i + 1
                if self.word(k) and not self.word(k, "extends", "implements"):
                    if begins:
                        self.entities.append(("class", self.at(k).text))
                        self.add_export(exported, default, self.at(k).text)
                    k += 1
                i, exported, default = self.body(k, stop, "class"), False, False
            elif word == "interface" and begins and self.word(i + 1):
                self.entities.append(("class", self.at(i + 1).text))
                self.add_export(exported, default, self.at(i + 1).text)
                i, exported, default = self.body(i + 2, stop, "type"), False, False
            elif word == "enum" and self.word(i + 1) and self.sign(i + 2, "{"):
                self.entities.append(("class", self.at(i + 1).text))
                self.add_export(exported, default, self.at(i + 1).text)
                end = self.partner(i + 2, stop)
                self.members(i + 3, end, "enum")
                i, exported, default = end + 1, False, False
            elif word == "type" and begins and self.word(i + 1) and (self.sign(i + 2, "=") or self.sign(i + 2, "<")):
                self.entities.append(("class", self.at(i + 1).text))
                self.add_export(exported, default, self.at(i + 1).text)
                i, exported, default = i + 2, False, False
            elif word in ("const", "let", "var") and not self.word(i + 1, "enum") and (self.word(i + 1) or self.sign(i + 1, "{") or self.sign(i + 1, "[")):
                i = self.declarations(i + 1, stop, exported)
                exported = default = False
            elif word == "catch" and self.sign(i + 1, "("):
                end = self.partner(i + 1, stop)
                k = next((k for k in range(i + 2, end) if self.sign(k, ":")), end)
                if k > i + 2:
                    self.variables.append(self.source(i + 2, k - 1))
                i = end + 1
            else:
                self.call(i, stop)
                i += 1

    def is_value(self, i: int) -> bool:
        t = self.at(i)
        return (t.kind == "name" and t.text not in BEFORE_VALUES) or t.kind in ("string", "template", "regex") or (t.kind == "sign" and t.text in (")", "]", "}", "?.", "!"))

    def is_block(self, i: int, in_case: bool) -> bool:
        last = self.at(i - 1)
        if i == 0:
            return True
        if last.kind == "name":
            return last.text in ("else", "do", "try", "finally") or last.text not in BEFORE_VALUES
        if last.kind == "sign":
            if last.text == ":":
                return self.after_case(i - 1)
            return last.text in (";", "{", "}", ")", "=>", "]", ">", "/>")
        return last.kind in ("string", "number", "markup") or (last.kind == "template" and not last.text.endswith("${"))

    def after_case(self, i: int) -> bool:
        """Whether the colon at ``i`` ends a case of a switch, or a label."""
        k = i - 1
        while k >= 0:
            t = self.at(k)
            if t.kind == "sign" and t.text in (")", "]", "}") and k in self.match:
                k = self.match[k]
            elif t.kind == "sign" and t.text in (";", "{", "(", "[", ",", "?", "="):
                return False
            elif t.kind == "name" and t.text in ("case", "default"):
                return True
            k -= 1
        return False

    def call(self, i: int, stop: int) -> None:
        """The call of the name at ``i``, if it is one."""
        name = self.at(i).text
        k = i + 1 + self.sign(i + 1, "?.")
        if self.sign(k, "<"):
            end = self.angle_end(k, stop)
            k = end if end > k and self.sign(end, "(") else k
        member = self.sign(i - 1, ".") or self.sign(i - 1, "?.")
        if not self.sign(k, "(") or (name in _NO_CALLS and not member) or (name == "async" and not member and self.arrow_after(i + 1, stop)):
            return
        first = i - 1
        while (self.sign(first, ".") or self.sign(first, "?.")) and self.word(first - 1):
            first -= 2
        if self.word(first, "new"):
            return
        self.calls.append(name)
        only = self.string(k + 1)
        if name == "require" and not member and only is not None and self.sign(k + 2, ")"):
            self.imports.append((only, []))

    def import_(self, i: int, stop: int, begins: bool) -> int:
        if self.sign(i + 1, "("):
            only = self.string(i + 2)
            if only is not None and (self.sign(i + 3, ")") or (self.sign(i + 3, ",") and self.sign(i + 4, ")"))):
                last = self.at(i - 1)
                of_type = self.word(i - 1, "typeof", "as", "extends", "keyof", "implements") or (last.kind == "sign" and last.text in ("<", "|", "&")) or (last.text == ":" and not self.in_choice(i - 1)) or self.in_alias(i)
                self.imports.append((only, ["type" if of_type else "*"]))
            return i + 2
        if not begins or self.sign(i + 1, "."):
            return i + 1
        if self.string(i + 1) is not None:
            self.imports.append((self.string(i + 1), []))
            return i + 2
        k, names = i + 1, []
        if self.word(k, "type") and not self.sign(k + 1, ",") and not (self.word(k + 1, "from") and self.string(k + 2) is not None):
            k += 1
        if self.word(k):
            names.append("default")
            local = self.at(k).text
            if self.sign(k + 1, "="):
                if self.word(k + 2, "require") and self.sign(k + 3, "(") and self.string(k + 4) is not None:
                    self.imports.append((self.string(k + 4), [local]))
                    return k + 6
                return k + 2
            self.variables.append(local)
            k += 1 + self.sign(k + 1, ",")
        if self.sign(k, "*"):
            names.append("*")
            k += 3
        elif self.sign(k, "{"):
            end = self.partner(k, stop)
            names += [name for name, _ in self.named(k, end)]
            k = end + 1
        if self.word(k, "from") and self.string(k + 1) is not None:
            self.imports.append((self.string(k + 1), names))
            k += 2
            if self.word(k, "with", "assert") and self.sign(k + 1, "{"):
                k = self.partner(k + 1, stop) + 1
        return max(k, i + 1)

    def in_choice(self, i: int) -> bool:
        """Whether the colon at ``i`` belongs to a question mark before it."""
        k = i - 1
        while k >= 0:
            t = self.at(k)
            if t.kind == "sign" and t.text in (")", "]", "}") and k in self.match:
                k = self.match[k]
            elif t.kind == "sign" and t.text == "?":
                return not self.sign(k + 1, ":")
            elif t.kind == "sign" and t.text in (";", "{", "(", "[", ",", "=>"):
                return False
            k -= 1
        return False

    def in_alias(self, i: int) -> bool:
        """Whether ``i`` stands in what a type alias stands for."""
        k = i - 1
        while k >= 0 and not self.sign(k, ";") and not self.sign(k, "{") and not self.sign(k, "}"):
            if self.word(k, "type") and self.word(k + 1) and self.begins_statement(k - self.word(k - 1, "export", "declare")):
                return True
            k -= 1
        return False

    def export(self, i: int, stop: int) -> tuple[int, bool, bool]:
        """The place to go on from, and whether a declaration follows that is exported, by default."""
        k = i + 1
        if self.word(k, "type") and (self.sign(k + 1, "{") or self.sign(k + 1, "*")):
            k += 1
        if self.sign(k, "*"):
            k += 1 + 2 * self.word(k + 1, "as")
            if self.word(k, "from") and self.string(k + 1) is not None:
                self.imports.append((self.string(k + 1), ["*"]))
                k += 2
            return k, False, False
        if self.sign(k, "{"):
            end = self.partner(k, stop)
            found = self.named(k, end)
            self.exports += [(alias, name, False) for name, alias in found]
            k = end + 1
            if self.word(k, "from") and self.string(k + 1) is not None:
                self.imports.append((self.string(k + 1), [name for name, _ in found]))
                k += 2
            return k, False, False
        if self.word(k, "as") and self.word(k + 1, "namespace"):
            return k + 3, False, False
        if self.word(k, "default") or self.sign(k, "="):
            then = k + 1
            declares = self.word(then, "function", "class", "interface") or (self.word(then, "async") and self.word(then + 1, "function")) or (self.word(then, "abstract") and self.word(then + 1, "class"))
            if declares and not self.sign(k, "="):
                return then + self.word(then, "async", "abstract"), True, True
            alone = self.word(then) and (then + 1 >= stop or self.sign(then + 1, ";") or self.sign(then + 1, "}") or self.ends_here(then + 1))
            self.exports.append(("default", self.at(then).text if alone else None, True))
            return then, False, False
        if self.word(k, "import"):
            return k, False, False
        while self.word(k, "declare", "abstract", "async") or (self.word(k, "const") and self.word(k + 1, "enum")):
            k += 1
        return k, True, False

    def declarations(self, i: int, stop: int, exported: bool) -> int:
        """The variables of a declaration from its first name on; returns the place behind its last one's value."""
        while i < stop:
            name = None
            if self.sign(i, "{") or self.sign(i, "["):
                end = self.partner(i, stop)
                self.variables.append(self.source(i, end))
                if self.sign(i, "{"):
                    self.members(i + 1, end, "object")
                else:
                    self.statements(i + 1, end)
                i = end + 1
            else:
                name = self.at(i).text
                self.variables.append(name)
                i += 1
            i += self.sign(i, "!")
            if self.sign(i, ":"):
                end = self.type_end(i + 1, stop)
                self.statements(i + 1, end)
                i = end
            if self.word(i, "of", "in"):
                return i
            value = i
            if self.sign(i, "="):
                j = i + 1 + self.word(i + 1, "async")
                if name and (self.word(j, "function") or self.arrow_after(j, stop) or self.arrow_after(i + 1, stop)):
                    self.entities.append(("function", name))
                if name and exported:
                    self.exports.append((name, name, False))
                value, i = i + 1, self.value_end(i + 1, stop)
                self.statements(value, i)
            elif name and exported:
                self.exports.append((name, name, False))
            if not self.sign(i, ","):
                return i
            i += 1
        return i

    def type_end(self, i: int, stop: int) -> int:
        deep, begin = 0, i
        while i < stop:
            t = self.at(i)
            if t.kind == "sign":
                if t.text in "({[":
                    i = self.partner(i, stop)
                elif t.text == "<":
                    deep += 1
                elif t.text == ">":
                    deep -= 1
                elif t.text in (")", "}", "]", ";") or (t.text in ("=", ",") and deep <= 0):
                    return i
            elif t.kind == "name" and t.text in ("of", "in") and deep <= 0:
                return i
            if i >= begin and deep <= 0 and i + 1 < stop and self.ends_here(i + 1, True):
                return i + 1
            i += 1
        return stop

    def value_end(self, i: int, stop: int) -> int:
        begin = i
        while i < stop:
            t = self.at(i)
            if t.kind == "sign":
                if t.text in "({[":
                    i = self.partner(i, stop)
                elif t.text == "<":
                    end = self.angle_end(i, stop)
                    i = end - 1 if end > i and self.sign(end, "(") else i
                elif t.text in (",", ";", ")", "}", "]"):
                    return i
            elif t.kind == "template" and t.text.endswith("${"):
                i = self.partner(i, stop)
                continue
            if i >= begin and i + 1 < stop and self.ends_here(i + 1):
                return i + 1
            i += 1
        return stop

    # Bodies.
    def body(self, i: int, stop: int, kind: str) -> int:
        """From a class's or interface's name to the end of its body; what it extends may hold calls."""
        begin = i
        while i < stop and not self.sign(i, "{"):
            if self.sign(i, "<"):
                i = max(self.angle_end(i, stop), i + 1)
            elif self.sign(i, "("):
                i = self.partner(i, stop) + 1
            else:
                i += 1
        for k in range(begin, i):
            if self.at(k).kind == "name" and kind == "class":
                self.call(k, i)
        end = self.partner(i, stop)
        self.members(i + 1, end, kind)
        return end + 1

    def members(self, i: int, stop: int, kind: str) -> None:
        """The members of a class, an object, a type or an enum."""
        while i < stop:
            if self.sign(i, ",") or self.sign(i, ";"):
                i += 1
                continue
            if self.sign(i, "@"):  # a decorator
                i += 1
                while self.word(i) and self.sign(i + 1, "."):
                    i += 2
                if self.word(i):
                    self.call(i, stop)
                i += 1
                if self.sign(i, "("):
                    end = self.partner(i, stop)
                    self.statements(i + 1, end)
                    i = end + 1
                continue
            if self.sign(i, "..."):
                end = self.value_end(i + 1, stop)
                self.statements(i + 1, end)
                i = end
                continue
            while (self.word(i, *_MODIFIERS) and self.names_follow(i + 1)) or self.sign(i, "*") or ((self.sign(i, "-") or self.sign(i, "+")) and kind == "type"):
                i += 1
            if self.word(i, "static") and self.sign(i + 1, "{"):
                end = self.partner(i + 1, stop)
                self.statements(i + 2, end)
                i = end + 1
                continue
            t, name, index = self.at(i), None, False
            if t.kind in ("name", "number"):
                name = t.text
                i += 1
            elif t.kind == "string":
                name = t.text[1:-1]
                i += 1
            elif self.sign(i, "["):
                end = self.partner(i, stop)
                index = any(self.sign(k, ":") or self.word(k, "in") for k in range(i + 1, end))
                name = self.source(i, end)
                if not index:
                    self.statements(i + 1, end)
                i = end + 1
            marked = self.sign(i, "?") or self.sign(i, "!")
            i += marked
            call = self.angle_end(i, stop) if self.sign(i, "<") else i
            if self.sign(call, "(") and name is not None or self.sign(i, "(") and name is None and kind == "type":
                if name is not None and (kind, name) not in (("class", "constructor"), ("type", "new")):
                    self.entities.append(("function", name))
                end = self.partner(call, stop)
                self.statements(call + 1, end)
                i = end + 1
                if self.sign(i, ":"):
                    k = self.result_end(i + 1, stop)
                    self.statements(i + 1, k)
                    i = k
                if self.sign(i, "{"):
                    end = self.partner(i, stop)
                    self.statements(i + 1, end)
                    i = end + 1
                continue
            if kind == "class" and name is not None and not index:
                self.variables.append(name)
            if name is None and not self.sign(i, ":") and not self.sign(i, "="):
                self.statements(i, i + 1)
                i += 1
                continue
            # A property: its type and its value.
            begin = i
            if self.sign(i, ":") and kind != "object":
                end = self.type_end(i + 1, stop)
                self.statements(i + 1, end)
                i = end
            if self.sign(i, "=") or self.sign(i, ":"):
                end = self.value_end(i + 1, stop)
                # The members of an object's type end at semicolons; of an object's value there are none.
                self.statements(i + 1, end)
                i = end
            i = max(i, begin)

    def names_follow(self, i: int) -> bool:
        t = self.at(i)
        return t.kind in ("name", "string", "number") or (t.kind == "sign" and t.text in ("[", "*"))

    def result_end(self, i: int, stop: int) -> int:
        """Where the type of a method's result ends: at its body, or with the member."""
        begin = i
        while i < stop:
            t = self.at(i)
            if t.kind == "sign":
                if t.text == "{" and i > begin and not (self.at(i - 1).kind == "sign" and self.at(i - 1).text in ("|", "&", ":", "=>", "<", ",")) and not self.word(i - 1, "is", "keyof", "extends"):
                    return i
                if t.text in "({[":
                    i = self.partner(i, stop)
                elif t.text in (";", ",", "}"):
                    return i
                elif t.text == "<":
                    i = max(self.angle_end(i, stop) - 1, i)
            if i + 1 < stop and self.ends_here(i + 1, True):
                return i + 1
            i += 1
        return stop
