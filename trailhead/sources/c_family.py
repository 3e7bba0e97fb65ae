"""Functions of C and C++ sources: a scanner of declarations over tokens.

It knows what ends a declarator (qualifiers, trailing return types, constraints, constructor initialisers with either kind
of brackets), which braces open a scope, a body or a value, and template argument lists, so that constructors, operators,
templates, test macros and functions in classes are found and values are not.  Macros are not expanded; both branches of
a conditional are read.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|^[ \t]*\#(?:[^\n\\]|\\.)*)"""
    r"""|(?P<string>(?:u8|[uUL])?R"(?P<tag>[^()\\\s]{0,16})\(.*?\)(?P=tag)"|(?:u8|[uUL])?"(?:\\.|[^"\\\n])*")"""
    r"""|(?P<char>(?:u8|[uUL])?'(?:\\.|[^'\\\n])+')"""
    r"""|(?P<number>\.?\d(?:[eEpP][+-]|'(?=\w)|[\w.])*)"""
    r"""|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<mark><=>|->\*|<<=|>>=|\.\.\.|::|->|\+\+|--|<<|[<>=!&|+\-*/%^]=|&&|\|\||.)""",
    re.S | re.M | re.X,
)
_KEYWORDS = set(
    "if else for while do switch case default break continue return goto try catch throw new delete const static auto void int char bool float "
    "double long short unsigned signed struct class union enum template typename nullptr true false this sizeof namespace operator using typedef "
    "public private protected virtual override final inline constexpr consteval constinit explicit friend mutable volatile extern noexcept decltype "
    "alignof alignas static_assert requires concept co_await co_return co_yield typeid and or not".split()
)
_TYPES = set("const static auto void int char bool float double long short unsigned signed typename struct class union enum constexpr volatile wchar_t".split())
_NO_NAME = _KEYWORDS - {"this"} | {"__attribute__", "__declspec", "defined", "_Static_assert"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Source:
    def __init__(self, source: bytes):
        self.kind, self.text, self.at, self.end = [], [], [], []
        for m in _TOKEN.finditer(source.decode("latin-1")):  # one character a byte
            if m.lastgroup != "skip":
                kind = "string" if m["string"] is not None else m.lastgroup
                self.kind.append(kind)
                self.text.append(m[0] if kind in ("name", "mark") else "")
                self.at.append(m.start())
                self.end.append(m.end())
        self.pair = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """Brackets by place, both ways; a closing one that fits none is left out, an open one ends at the last token."""
        pair, held = {}, []
        for i, t in enumerate(self.text):
            if t in _OPEN:
                held.append(i)
            elif t in _CLOSE:
                while held and _OPEN[self.text[held[-1]]] != t and t == "}":
                    held.pop()  # a broken bracket inside braces
                if held and _OPEN[self.text[held[-1]]] == t:
                    pair[held[-1]] = i
                    pair[i] = held.pop()
        return pair

    def angle(self, i: int) -> int:
        """The end of template arguments that begin at ``i``, or -1 if that is no such list."""
        depth = 0
        while i < len(self.text):
            t = self.text[i]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if not depth:
                    return i
            elif t in ("(", "["):
                i = self.pair.get(i, len(self.text))
            elif t in (";", "{", "}", "&&", "||", ")", "]"):
                return -1
            i += 1
        return -1

    def functions(self):
        """(start, end, name, body) by token."""
        i, n = 0, len(self.text)
        while i < n:
            i = yield from self._declaration(i)

    def _declaration(self, i: int):
        """One declaration from token ``i``; returns the place after it, or inside of it where it opens a scope."""
        start, params, name, scope, enum = i, None, "", False, False
        while i < len(self.text):
            t, kind = self.text[i], self.kind[i]
            if t == ";" or t == "}":
                return i + 1
            if t == "template" and i + 1 < len(self.text) and self.text[i + 1] == "<":
                end = self.angle(i + 1)
                i = end + 1 if end > 0 else i + 2
                start = i if params is None else start
            elif t in ("namespace", "class", "struct", "union") and params is None:
                scope, i = True, i + 1
            elif t == "enum":
                enum, i = True, i + 1
            elif t == "extern" and i + 1 < len(self.text) and self.kind[i + 1] == "string":
                scope, i = True, i + 2
            elif t == "operator" and params is None:
                j = i + 1
                if self.text[j : j + 2] == ["(", ")"]:
                    j += 2
                while j < len(self.text) and self.text[j] not in ("(", ";", "{"):
                    j += 1
                name = "operator" + "".join(self.text[i + 1 : j])
                if j < len(self.text) and self.text[j] == "(" and j in self.pair:
                    params = j
                    j = self.pair[j] + 1
                i = j
            elif t == "(":
                if i not in self.pair:
                    return i + 1
                if params is None and i > start and (found := self._named(i - 1, start)):
                    name, params = found, i
                i = self.pair[i] + 1
            elif t == "[":
                i = self.pair.get(i, i) + 1
            elif t == "<" and i > start and self.kind[i - 1] == "name" and (end := self.angle(i)) > 0:
                i = end + 1
            elif t == "=":
                return self._statement(i)
            elif t == ":" and params is None and not scope:
                if i > start and self.text[i - 1] in ("public", "private", "protected") or kind == "mark" and i == start + 1 and not enum:
                    start = i + 1  # an access specifier or a label
                i += 1
            elif t == ":" and params is not None:
                i = self._initialisers(i + 1)
            elif t == "{":
                if i not in self.pair:
                    return i + 1
                if params is not None and not enum:
                    yield start, self.pair[i], self._macro(name, params, start), i
                    return self.pair[i] + 1
                if scope and not enum:
                    return i + 1
                i = self.pair[i] + 1
            else:
                i += 1
        return i

    def _named(self, j: int, start: int) -> str:
        """The function name that ends at token ``j``, before its parameters."""
        if self.text[j] == ">":
            depth = 0
            while j > start:
                depth += (self.text[j] == ">") - (self.text[j] == "<")
                j -= 1
                if not depth:
                    break
        if self.kind[j] != "name" or self.text[j] in _NO_NAME:
            return ""
        return ("~" if j > start and self.text[j - 1] == "~" else "") + self.text[j]

    def _macro(self, name: str, params: int, start: int) -> str:
        """Test macros: an all-capitals name without a type before it stands for what its arguments name."""
        inside = self.text[params + 1 : self.pair[params]]
        if name.isupper() and params == start + 1 and inside and all(self.kind[params + 1 + k] == "name" or x == "," for k, x in enumerate(inside)):
            return ".".join(x for x in inside if x != ",")
        return name

    def _initialisers(self, i: int) -> int:
        """Past the constructor's initialisers, at its body."""
        while i < len(self.text):
            while i < len(self.text) and self.text[i] not in ("(", "{", ";", "}"):
                end = self.angle(i) if self.text[i] == "<" else -1
                i = end + 1 if end > 0 else i + 1
            if i >= len(self.text) or self.text[i] in (";", "}"):
                return i
            i = self.pair.get(i, i) + 1
            if i < len(self.text) and self.text[i] == "...":
                i += 1
            if i >= len(self.text) or self.text[i] != ",":
                return i
            i += 1
        return i

    def _statement(self, i: int) -> int:
        """Past the next semicolon outside brackets."""
        while i < len(self.text) and self.text[i] != ";":
            if self.text[i] == "}":
                return i
            i = self.pair.get(i, i) + 1 if self.text[i] in _OPEN else i + 1
        return i + 1

    def calls(self, a: int, b: int) -> list[str]:
        """The first name of each callee between two tokens: a receiver, or what a qualified name ends in."""
        out = []
        for i in range(a, b):
            if self.text[i] == "(" and (name := self._callee(i, a)):
                out.append(name)
        return out

    def _callee(self, i: int, a: int) -> str:
        j, first = i - 1, ""
        while j >= a:
            t = self.text[j]
            if t in (")", "]") and j in self.pair:
                open_ = self.pair[j]
                before = self.text[open_ - 1] if open_ > a else ""
                called = open_ > a and (self.kind[open_ - 1] == "name" and before not in _KEYWORDS or before in (")", "]", ">"))
                if not called:
                    if t == "]" or j != i - 1:  # a lambda's captures, or brackets of their own
                        return first
                    inner = [x for x, k in zip(self.text[open_ + 1 : j], self.kind[open_ + 1 : j]) if k == "name" and x not in _KEYWORDS]
                    return inner[0] if len(inner) == 1 and j - open_ <= 3 else ""
                j = open_ - 1
                continue
            if t == ">":
                depth, k = 0, j
                while k > a:
                    depth += (self.text[k] == ">") - (self.text[k] == "<")
                    if not depth:
                        break
                    k -= 1
                if k <= a or self.kind[k - 1] != "name" or self.angle(k) != j:
                    return first
                j = k - 1
                continue
            if self.kind[j] != "name" or t in _KEYWORDS and t != "this":
                return first
            if t != "this":
                first = t
            before = self.text[j - 1] if j > a else ""
            if before in (".", "->") and j - 2 >= a:
                j -= 2
                continue
            if before == "::":
                j -= 2
                while j >= a and (self.kind[j] == "name" or self.text[j] == "::"):
                    if self.kind[j] == "name" and self.text[j - 1] != "::":
                        j -= 1
                        break
                    j -= 1
                before = self.text[j] if j >= a else ""
            if before in ("new", "~") or before in _TYPES:
                return ""
            if j - 1 >= a and self.kind[j - 1] == "name" and before not in _KEYWORDS and j - 1 >= a and before == self.text[j - 1]:
                return ""  # a variable with arguments
            return first
        return first

    def kinds(self, a: int, b: int) -> list[str]:
        """What a fingerprint is made of: marks, keywords and kinds of literals, no names."""
        named = {"string": "string_literal", "char": "char_literal", "number": "number_literal"}
        return [named.get(k, t) for k, t in zip(self.kind[a:b], self.text[a:b]) if k != "name" or t in _KEYWORDS]


def functions(source: bytes) -> list[tuple[int, int, str, list[str], list[str]]]:
    """(byte_start, byte_end, name, callees, kinds) of the functions; what lies inside of one belongs to it."""
    s = _Source(source)
    return [(s.at[a], s.end[b], name, s.calls(body, b), s.kinds(a, b + 1)) for a, b, name, body in s.functions()]
