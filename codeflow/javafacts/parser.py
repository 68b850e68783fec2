"""Declarations, calls and their inferred types from the tokens of one Java file.

The parser is tolerant: what it does not understand is skipped up to the next ';' or '}' and reported once; everything
else of the file is still extracted. Bodies are not parsed into a tree. Calls are found by their shape (a name before an
opening parenthesis), the receiver by walking back over the primary expression before the dot.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote

from .lexer import Positions, Token, tokens

# Words of the Java language.
MODIFIERS = frozenset("public protected private abstract static final strictfp default synchronized native transient volatile sealed non-sealed".split())
PRIMITIVES = frozenset("boolean byte char short int long float double void".split())
_NO_TYPE = frozenset("return throw new else case break continue assert package import if while do switch try catch finally instanceof this super goto yield".split())
_NO_CALL = frozenset("if for while switch catch synchronized try return throw assert do else case super this".split())
_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def _enc(x: str) -> str:
    return quote(x, safe="-_.!~*'()")


def symbol_id(application: str, uri: str, signature: str) -> str:
    return ":".join(["codeflow:symbol", _enc(application), _enc(uri), _enc(signature)])


@dataclass
class Type:
    """A declared type while its members are read."""

    id: str
    name: str
    qualified: str
    kind: str
    fields: dict[str, dict] = field(default_factory=dict)
    superclass: str | None = None
    record: list = field(default_factory=list)


class FileParser:
    def __init__(self, application: str, uri: str, relative: str, source: str):
        self.application, self.uri, self.relative, self.source = application, uri, relative, source
        self.t, self.pos = tokens(source), Positions(source)
        self.pair: dict[int, int] = {}
        self.namespace: str | None = None
        self.imports: list[dict] = []
        self.symbols: list[dict] = []
        self.invocations: list[dict] = []
        self.diagnostics: list[dict] = []
        self.bodies: list[tuple[int, int, dict, Type]] = []  # tokens to search for calls, and their owner
        self._match()

    # ------------------------------------------------------------ tokens

    def _match(self) -> None:
        stack: list[int] = []
        for i, x in enumerate(self.t):
            if x.kind != "op":
                continue
            if x.text in _OPEN:
                stack.append(i)
            elif x.text in _CLOSE:
                k = len(stack) - 1
                while k >= 0 and self.t[stack[k]].text != _CLOSE[x.text]:
                    k -= 1
                if k < 0:
                    self.fault(i, i, "unexpected " + x.text)
                    continue
                for j in stack[k + 1 :]:
                    self.fault(j, j, "unclosed " + self.t[j].text)
                self.pair[stack[k]], self.pair[i] = i, stack[k]
                del stack[k:]
        for j in stack:
            self.fault(j, j, "unclosed " + self.t[j].text)

    def fault(self, a: int, b: int, what: str) -> None:
        if self.t:
            b = min(b, len(self.t) - 1)
            self.diagnostics.append({"code": "java.syntaxError", "severity": "warning", "message": f"Java syntax: {what}", "loc": self.loc(a, b)})

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word"

    def raw(self, a: int, b: int) -> str:
        """Source of the tokens from a up to b (exclusive)."""
        return self.source[self.t[a].start : self.t[b - 1].end] if b > a else ""

    def loc(self, a: int, b: int) -> dict:
        return self.pos.span(self.uri, self.t[a].start, self.t[min(b, len(self.t) - 1)].end)

    def close(self, i: int, limit: int) -> int:
        """The token after the bracket that opens at i."""
        return min(self.pair.get(i, limit - 1) + 1, limit)

    def angle(self, i: int) -> int | None:
        """The token after type arguments that open at i, or None."""
        depth, j = 0, i
        while j < len(self.t):
            x = self.text(j)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x == "@" or self.word(j) or x in (",", ".", "?", "&", "[", "]"):
                pass
            else:
                return None
            j += 1
        return None

    def skip_annotations(self, i: int) -> int:
        while self.text(i) == "@" and self.word(i + 1) and self.text(i + 1) != "interface":
            i += 2
            while self.text(i) == "." and self.word(i + 1):
                i += 2
            if self.text(i) == "(":
                i = self.close(i, len(self.t))
        return i

    def type_at(self, i: int) -> tuple[str, int] | None:
        """A type that begins at i: its text without white space and annotations, and the token after it."""
        i = self.skip_annotations(i)
        if not self.word(i) or self.text(i) in _NO_TYPE or self.text(i) in MODIFIERS:
            return None
        parts = []
        while True:
            if not self.word(i):
                return None
            parts.append(self.text(i))
            i += 1
            if self.text(i) == "<":
                j = self.angle(i)
                if j is None:
                    return None
                parts.append(re.sub(r"\s+", "", self.raw(i, j)))
                i = j
            if self.text(i) == "." and self.word(i + 1):
                parts.append(".")
                i += 1
                continue
            break
        i = self.skip_annotations(i)
        while self.text(i) == "[" and self.text(i + 1) == "]":
            parts.append("[]")
            i += 2
        if self.text(i) == "...":
            parts.append("...")
            i += 1
        return "".join(parts), i

    # ------------------------------------------------------------ symbols

    def add(self, kind: str, owner: str | None, name: str, qualified: str, signature: str, a: int, b: int, **more) -> dict:
        s = {
            "id": symbol_id(self.application, self.relative, signature), "kind": kind, "owner_symbol_id": owner, "symbol": {"name": name, "qualified_name": qualified, "signature": signature},
            "declared_type": None, "modifiers": [], "loc": self.loc(a, b), "annotations": [], "declaration_kind": None, "super_types": [], "method_behavior": None, "param_index": None,
            "implicit": None, "generated_by": None,
        }
        s.update(more)
        self.symbols.append(s)
        return s

    def modifiers(self, i: int) -> tuple[list[str], list[dict], int]:
        """Modifiers and annotations from i on."""
        mods, notes = [], []
        while i < len(self.t):
            if self.text(i) == "@" and self.word(i + 1) and self.text(i + 1) != "interface":
                j = i + 2
                while self.text(j) == "." and self.word(j + 1):
                    j += 2
                name, arguments = self.raw(i + 1, j).replace(" ", ""), []
                if self.text(j) == "(":
                    end = self.close(j, len(self.t))
                    for a, b in self.split(j + 1, end - 1):
                        named = b - a > 2 and self.word(a) and self.text(a + 1) == "="
                        arguments.append({"name": self.text(a) if named else None, "expression": self.raw(a + 2 if named else a, b), "loc": self.loc(a, b - 1)})
                    j = end
                notes.append({"name": name, "arguments": arguments, "loc": self.loc(i, j - 1)})
                i = j
            elif self.text(i) in MODIFIERS and not (self.text(i) == "default" and self.text(i + 1) in (":", "->")):
                mods.append(self.text(i))
                i += 1
            elif self.text(i) == "non" and self.text(i + 1) == "-" and self.text(i + 2) == "sealed":
                mods.append("non-sealed")
                i += 3
            else:
                break
        return mods, notes, i

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Ranges between the commas of a list; brackets and type arguments hide theirs."""
        out, start, i = [], a, a
        while i < b:
            x = self.text(i)
            if x in _OPEN:
                i = self.close(i, b)
                continue
            if x == "<" and i > a and self.word(i - 1):
                j = self.angle(i)
                if j is not None and j <= b and (self.text(j) in ("(", ")", ",", ">", "[", "{", ".", "::", "") or self.word(j) and self.text(i - 1)[:1].isupper()):
                    i = j
                    continue
            if x == ",":
                out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return out

    # ------------------------------------------------------------ declarations

    def parse(self) -> dict:
        i, n = 0, len(self.t)
        while i < n:
            begin = i
            _, _, j = self.modifiers(i)
            if self.text(j) == "package":
                k = j + 1
                while k < n and self.text(k) != ";":
                    k += 1
                self.namespace = re.sub(r"\s", "", self.raw(j + 1, k))
                i = k + 1
            elif self.text(j) == "import":
                k = j + 1
                while k < n and self.text(k) != ";":
                    k += 1
                static = self.text(j + 1) == "static"
                name = re.sub(r"\s", "", self.raw(j + 1 + static, k))
                if name:
                    self.imports.append({"qualified_name": name.removesuffix(".*"), "is_static": static, "is_wildcard": name.endswith(".*"), "loc": self.loc(j, min(k, n - 1))})
                i = k + 1
            else:
                i = self.declaration(i, n, None)
                if i <= begin:
                    i = begin + 1
        for a, b, owner, type_ in self.bodies:
            self.calls(a, b, owner, type_)
        order = lambda s: (s["loc"]["start"]["line"], s["loc"]["start"]["column"])
        self.symbols.sort(key=lambda s: (*order(s), s["id"]))
        self.invocations.sort(key=lambda s: (*order(s), s["expression"]))
        return {"namespace_name": self.namespace, "imports": self.imports, "symbols": self.symbols, "invocations": self.invocations, "diagnostics": self.diagnostics}

    def declaration(self, i: int, limit: int, owner: Type | None) -> int:
        """One declaration from i on; the token after it."""
        begin = i
        mods, notes, i = self.modifiers(i)
        if i >= limit:
            return limit
        x = self.text(i)
        if x == "@" and self.text(i + 1) == "interface":
            return self.type_declaration(begin, i + 1, limit, "annotation", owner, mods, notes)
        if x in _KINDS and self.word(i + 1) and (x != "record" or self.text(i + 2) in ("(", "<")):
            return self.type_declaration(begin, i, limit, _KINDS[x], owner, mods, notes)
        if x == ";":
            return i + 1
        if x == "{":
            end = self.close(i, limit)
            if owner:
                self.bodies.append((i + 1, end - 1, self.type_symbol(owner), owner))
            return end
        if owner is None:
            return self.recover(begin, limit)
        if x == "<":
            i = self.angle(i) or i + 1
        if self.word(i) and self.text(i) == owner.name and self.text(i + 1) == "(":
            return self.callable(begin, i, i + 1, limit, owner, mods, notes, None)
        if owner.kind == "record" and self.text(i) == owner.name and self.text(i + 1) == "{":
            end = self.close(i + 1, limit)
            self.bodies.append((i + 2, end - 1, self.type_symbol(owner), owner))
            return end
        typed = self.type_at(i)
        if typed and self.word(typed[1]):
            name = typed[1]
            if self.text(name + 1) == "(":
                return self.callable(begin, name, name + 1, limit, owner, mods, notes, typed[0])
            if self.text(name + 1) in ("=", ";", ",", "["):
                return self.fields(begin, name, limit, owner, mods, notes, typed[0])
        return self.recover(begin, limit)

    def recover(self, i: int, limit: int) -> int:
        """Report once, go on after the next ';' or block."""
        begin = i
        while i < limit and self.text(i) not in (";", "{", "}"):
            i = self.close(i, limit) if self.text(i) in ("(", "[") else i + 1
        end = self.close(i, limit) if self.text(i) == "{" else i + 1
        self.fault(begin, min(max(begin, end - 1), limit - 1), "declaration not understood")
        return end

    def type_symbol(self, owner: Type) -> dict:
        return next(s for s in self.symbols if s["id"] == owner.id)

    def type_declaration(self, begin: int, i: int, limit: int, kind: str, owner: Type | None, mods: list, notes: list) -> int:
        name = self.text(i + 1)
        qualified = f"{owner.qualified}.{name}" if owner else f"{self.namespace}.{name}" if self.namespace else name
        j = i + 2
        if self.text(j) == "<":
            j = self.angle(j) or j + 1
        components: list[tuple[int, int]] = []
        if kind == "record" and self.text(j) == "(":
            end = self.close(j, limit)
            components = self.split(j + 1, end - 1)
            j = end
        supers, superclass = [], None
        while j < limit and self.text(j) != "{":
            word = self.text(j)
            j += 1
            if word in ("extends", "implements", "permits"):
                while typed := self.type_at(j):
                    if word != "permits":
                        supers.append(typed[0])
                    if word == "extends" and kind == "class":
                        superclass = typed[0]
                    j = typed[1]
                    if self.text(j) != ",":
                        break
                    j += 1
        end = self.close(j, limit) if j < limit else limit
        s = self.add("type", owner.id if owner else None, name, qualified, f"type:{qualified}", begin, end - 1, modifiers=mods, annotations=notes, declaration_kind=kind, super_types=supers)
        own = Type(s["id"], name, qualified, kind, superclass=superclass, record=components)
        k = j + 1
        if kind == "enum":
            k = self.enum_constants(k, end - 1, own)
        before = len(self.symbols)
        while k < end - 1:
            k = max(self.declaration(k, end - 1, own), k + 1)
        mine = [x for x in self.symbols[before:] if x["owner_symbol_id"] == own.id]
        if kind == "class" and not any(x["kind"] == "constructor" for x in mine):
            self.add("constructor", own.id, name, f"{qualified}#<init>", f"{qualified}#constructor()", begin, end - 1, declared_type=qualified, implicit=True, method_behavior="trivialConstructor")
        self.behaviours(own)
        return end

    def enum_constants(self, i: int, limit: int, own: Type) -> int:
        while i < limit and self.text(i) != ";":
            while i < limit and self.text(i) not in (",", ";"):
                if self.text(i) == "{":
                    end = self.close(i, limit)
                    self.bodies.append((i + 1, end - 1, self.type_symbol(own), own))
                    i = end
                elif self.text(i) in _OPEN:
                    end = self.close(i, limit)
                    self.bodies.append((i + 1, end - 1, self.type_symbol(own), own))
                    i = end
                else:
                    i += 1
            if self.text(i) == ",":
                i += 1
        return i + 1

    def fields(self, begin: int, name: int, limit: int, owner: Type, mods: list, notes: list, type_: str) -> int:
        i = name
        stop = i
        while stop < limit and self.text(stop) != ";":
            stop = self.close(stop, limit) if self.text(stop) in _OPEN else stop + 1
        for a, b in self.split(i, stop):
            if not self.word(a):
                continue
            dims = 0
            while self.text(a + 1 + 2 * dims) == "[" and self.text(a + 2 + 2 * dims) == "]":
                dims += 1
            own = type_ + "[]" * dims
            n = self.text(a)
            s = self.add("field", owner.id, n, f"{owner.qualified}#{n}", f"{owner.qualified}#field:{n}:{own}", a if a != name else begin, b - 1, declared_type=own, modifiers=mods, annotations=notes)
            owner.fields[n] = s
            if b > a + 1:
                self.bodies.append((a + 1 + 2 * dims, b, self.type_symbol(owner), owner))
        return stop + 1

    def parameters(self, a: int, b: int) -> list[tuple[str, str, int, int, list, list]]:
        out = []
        for x, y in self.split(a, b):
            mods, notes, i = self.modifiers(x)
            typed = self.type_at(i)
            if not typed or not self.word(typed[1]) or self.text(typed[1]) == "this":
                continue
            dims = "[]" * sum(self.text(k) == "[" for k in range(typed[1] + 1, y))
            out.append((self.text(typed[1]), typed[0] + dims, x, y - 1, mods, notes))
        return out

    def callable(self, begin: int, name: int, paren: int, limit: int, owner: Type, mods: list, notes: list, returns: str | None) -> int:
        after = self.close(paren, limit)
        given = self.parameters(paren + 1, after - 1)
        i = after
        while self.text(i) == "[" and self.text(i + 1) == "]":
            returns, i = (returns or "") + "[]", i + 2
        while i < limit and self.text(i) not in ("{", ";"):
            i = self.close(i, limit) if self.text(i) == "(" else i + 1
        body = (i + 1, self.close(i, limit) - 1) if self.text(i) == "{" else None
        end = self.close(i, limit) if body else min(i + 1, limit)
        types, n = ",".join(p[1] for p in given), self.text(name)
        if returns is None:
            s = self.add("constructor", owner.id, n, f"{owner.qualified}#<init>", f"{owner.qualified}#constructor({types})", begin, end - 1, declared_type=owner.qualified, modifiers=mods, annotations=notes)
        else:
            s = self.add("method", owner.id, n, f"{owner.qualified}#{n}", f"{owner.qualified}#method:{n}({types}):{returns}", begin, end - 1, declared_type=returns, modifiers=mods, annotations=notes)
        for k, (p, type_, a, b, pm, pn) in enumerate(given):
            self.add("parameter", s["id"], p, f"{s['symbol']['qualified_name']}.{p}", f"{s['symbol']['signature']}#parameter:{k}:{p}:{type_}", a, b, declared_type=type_, modifiers=pm, annotations=pn, param_index=k)
        s["_given"], s["_body"] = [(p[0], p[1]) for p in given], body
        if body:
            self.bodies.append((*body, s, owner))
        return end

    # ------------------------------------------------------------ accessors and plain constructors

    def statements(self, a: int, b: int) -> list[tuple[int, int]]:
        out, start, i = [], a, a
        while i < b:
            x = self.text(i)
            i = self.close(i, b) if x in _OPEN else i + 1
            if x == ";" or x == "{":
                out.append((start, i - (x == ";")))
                start = i
        return out + ([(start, b)] if start < b else [])

    def field_named(self, a: int, b: int, names, hidden: str | None = None) -> str | None:
        if b - a == 1 and self.text(a) in names and self.text(a) != hidden:
            return self.text(a)
        if b - a == 3 and self.text(a) == "this" and self.text(a + 1) == "." and self.text(a + 2) in names:
            return self.text(a + 2)
        return None

    def assigns(self, a: int, b: int, names, parameter: str) -> bool:
        return b - a >= 3 and self.text(b - 2) == "=" and self.text(b - 1) == parameter and self.field_named(a, b - 2, names, parameter) is not None

    def behaviours(self, owner: Type) -> None:
        """Accessors, fluent setters, and constructors that only assign their parameters."""
        names = owner.fields
        for s in self.symbols:
            body = s.get("_body")
            if s["owner_symbol_id"] != owner.id or body is None:
                continue
            given, inside = s["_given"], self.statements(*body)
            if s["kind"] == "constructor":
                if all(any(self.assigns(a, b, names, p) for p, _ in given) for a, b in inside):
                    s["method_behavior"] = "trivialConstructor"
            elif not given and len(inside) == 1:
                a, b = inside[0]
                if self.text(a) == "return" and self.field_named(a + 1, b, names):
                    s["method_behavior"] = "trivialGetter"
            elif len(given) == 1 and inside and self.assigns(*inside[0], names, given[0][0]):
                if len(inside) == 1:
                    s["method_behavior"] = "trivialSetter"
                elif len(inside) == 2 and self.raw(*inside[1]).split() == ["return", "this"]:
                    s["method_behavior"] = "trivialFluentSetter"

    # ------------------------------------------------------------ bodies

    def locals(self, a: int, b: int) -> list[tuple[int, set[str], str]]:
        """Declarations of a body: (first token, names, type)."""
        out = []
        for i in range(a, b):
            before = self.text(i - 1)
            opens = before in ("{", "}", ";", ":", "->") or i == a
            in_head = before == "(" and self.text(i - 2) in ("for", "try", "catch")
            if not (opens or in_head):
                continue
            _, _, j = self.modifiers(i)
            typed = self.type_at(j)
            if not typed:
                continue
            type_, k = typed
            if in_head and self.text(i - 2) == "catch":
                while self.text(k) == "|" and (more := self.type_at(k + 1)):
                    type_, k = f"{type_}|{more[0]}", more[1]
                if self.word(k):
                    out.append((i, {self.text(k)}, type_))
            elif self.word(k) and self.text(k + 1) in ("=", ";", ",", ":", ")", "["):
                stop = k
                while stop < b and self.text(stop) not in (";", ":", ")"):
                    stop = self.close(stop, b) if self.text(stop) in _OPEN else stop + 1
                names = {self.text(x) for x, _ in self.split(k, stop) if self.word(x)} if self.text(k + 1) != ":" else {self.text(k)}
                out.append((i, names, type_))
        return out

    def primary_start(self, i: int, low: int) -> int:
        """The first token of the primary expression that ends at token i."""
        while i >= low:
            x = self.text(i)
            if x in (")", "]"):
                i = self.pair.get(i, low)
                if self.text(i) == "(":
                    p = i - 1
                    if self.text(p) == ">":  # new Type<...>(...)
                        depth = 0
                        while p >= low:
                            depth += (self.text(p) == ">") - (self.text(p) == "<")
                            p -= 1
                            if not depth:
                                break
                    if self.word(p) and self.text(p) not in _NO_CALL or self.text(p) in ("super", "this"):
                        i = p
                    else:
                        return i
                else:
                    i -= 1
                    continue
            elif x == "}" and i in self.pair:  # an anonymous class
                i = self.pair[i] - 1
                continue
            # token i is a name or a literal; names in a type after new belong to it
            j = i
            while self.text(j - 1) == "." and self.word(j - 2) and j - 2 >= low:
                j -= 2
            if self.text(j - 1) == "new":
                return j - 1 if self.text(j - 2) != "." else self.primary_start(j - 3, low)
            if self.text(i - 1) == "." and i - 2 >= low:
                i -= 2
                if self.text(i) == ">":
                    depth = 0
                    while i >= low:
                        depth += (self.text(i) == ">") - (self.text(i) == "<")
                        i -= 1
                        if not depth:
                            break
                    if self.text(i) == ".":
                        i -= 1
                continue
            return i
        return low

    def calls(self, a: int, b: int, owner: dict, type_: Type) -> None:
        declared = self.locals(a, b) if owner["kind"] != "type" else []
        i = a
        while i < b:
            x = self.text(i)
            if x == "new":
                i = self.new(i, b, owner, type_, declared)
                continue
            if x == "super" and self.text(i + 1) == "(" and self.text(i - 1) != ".":
                end = self.close(i + 1, b)
                stop = end + (self.text(end) == ";")
                self.call("constructor", i, stop, type_.superclass or "Object", None, i + 2, end - 1, owner, type_, declared)
            elif self.word(i) and x not in _NO_CALL and x not in ("new",) and self.text(i + 1) == "(" and self.text(i - 1) != "@" and not self.named_type(i, a) and not self.declares(i, b):
                end, start, receiver = self.close(i + 1, b), i, None
                k = i - 1
                if self.text(k) == ">" and k > a:  # explicit type arguments
                    depth = 0
                    while k > a:
                        depth += (self.text(k) == ">") - (self.text(k) == "<")
                        k -= 1
                        if not depth:
                            break
                if self.text(k) == "." and k > a:
                    start = self.primary_start(k - 1, a)
                    receiver = (start, k)
                self.call("method", start, end, x, receiver, i + 2, end - 1, owner, type_, declared)
            i += 1

    def named_type(self, i: int, low: int) -> bool:
        """Whether the name at i is the type of a creation."""
        while self.text(i - 1) == "." and self.word(i - 2) and i - 2 >= low:
            i -= 2
        return self.text(i - 1) == "new"

    def declares(self, i: int, b: int) -> bool:
        """Whether the name at i is that of a method of an anonymous class."""
        before = self.text(i - 1)
        if self.word(i - 1):
            return before not in _NO_TYPE
        return before in (">", "]") and self.text(self.close(i + 1, b)) in ("{", "throws")

    def new(self, i: int, b: int, owner: dict, type_: Type, declared: list) -> int:
        j = self.skip_annotations(i + 1)
        start, parts = j, []
        while self.word(j):
            parts.append(self.text(j))
            j += 1
            if self.text(j) == "<":
                k = self.angle(j)
                if k is None:
                    break
                parts.append(re.sub(r"\s+", "", self.raw(j, k)))
                j = k
            if self.text(j) == "." and self.word(j + 1):
                parts.append(".")
                j += 1
            else:
                break
        if self.text(j) != "(" or j == start:
            return i + 1
        end = self.close(j, b)
        stop = self.close(end, b) if self.text(end) == "{" else end
        begin = i
        if self.text(i - 1) == ".":  # outer.new Inner()
            begin = self.primary_start(i - 2, 0)
        self.call("constructor", begin, stop, "".join(parts), None, j + 1, end - 1, owner, type_, declared)
        return j  # arguments and an anonymous body hold further calls

    def call(self, kind: str, start: int, stop: int, name: str, receiver: tuple[int, int] | None, a: int, b: int, owner: dict, type_: Type, declared: list) -> None:
        arguments = self.split(a, b)
        path, root = [], receiver
        if receiver:
            x, y = receiver
            while y - x >= 3 and self.word(y - 1) and self.text(y - 2) == "." and self.text(y - 1) not in ("this", "super", "class"):
                path.insert(0, self.text(y - 1))
                y -= 2
            root = (x, y)
        inferred = None
        if receiver:
            inferred = self.infer(*root, owner, type_, declared) or self.infer(*receiver, owner, type_, declared)
        self.invocations.append({
            "enclosing_symbol_id": owner["id"], "kind": kind, "expression": self.raw(start, stop), "member_name": name,
            "receiver_expression": self.raw(*receiver) if receiver else None, "receiver_type": inferred, "receiver_member_path": path or None,
            "receiver_root_expression": self.raw(*root) if path else None, "argument_count": len(arguments), "argument_expressions": [self.raw(*x) for x in arguments],
            "argument_types": [self.infer(*x, owner, type_, declared) for x in arguments], "loc": self.loc(start, stop - 1),
        })

    def infer(self, a: int, b: int, owner: dict, type_: Type, declared: list) -> str | None:
        """The type that an expression shows by itself."""
        if b <= a:
            return None
        first = self.t[a]
        if b - a == 1:
            if first.kind == "string":
                return "String"
            if first.kind == "char":
                return "char"
            if first.kind == "number":
                x, hexadecimal = first.text, first.text[:2].lower() == "0x"
                if x[-1] in "lL":
                    return "long"
                if "." in x or not hexadecimal and re.search(r"[eEfFdD]", x) or hexadecimal and "p" in x.lower():
                    return "float" if x[-1] in "fF" and not (hexadecimal and "p" not in x.lower()) else "double"
                return "int"
            if first.text in ("true", "false"):
                return "boolean"
            if first.text == "null":
                return "null"
            return self.variable(first.text, a, owner, type_, declared) if first.kind == "word" and first.text not in ("this", "super") else None
        if first.text == "(":
            end = self.close(a, b)
            if end == b:
                return self.infer(a + 1, b - 1, owner, type_, declared)
            typed = self.type_at(a + 1)
            if typed and typed[1] == end - 1:
                follows = self.t[end]
                if typed[0] in PRIMITIVES or follows.kind in ("word", "string", "char", "number") or follows.text in ("(", "!", "~"):
                    return typed[0] if self.single(end, b) else None
            return None
        if first.text in ("-", "+", "!", "~") and self.single(a + 1, b):
            return self.infer(a + 1, b, owner, type_, declared)
        if first.text == "new":
            typed = self.type_at(a + 1)
            j = a + 1
            parts = []
            while typed and self.word(j):
                parts.append(self.text(j))
                j += 1
                if self.text(j) == "<" and (k := self.angle(j)):
                    parts.append(re.sub(r"\s+", "", self.raw(j, k)))
                    j = k
                if self.text(j) != "." or not self.word(j + 1):
                    break
                parts.append(".")
                j += 1
            if self.text(j) in ("(", "["):
                while j < b and self.text(j) in ("(", "[", "{"):
                    j = self.close(j, b)
                return "".join(parts) if j == b else None
            return None
        if self.word(b - 1) and self.text(b - 2) == "." and self.primary_start(b - 1, a) == a and self.text(b - 1) not in ("class", "this", "super"):
            return self.variable(self.text(b - 1), a, owner, type_, declared)
        return None

    def single(self, a: int, b: int) -> bool:
        """Whether the range is one operand without binary operators."""
        while a < b and self.text(a) in ("-", "+", "!", "~"):
            a += 1
        return a < b and self.primary_start(b - 1, a) == a

    def variable(self, name: str, at: int, owner: dict, type_: Type, declared: list) -> str | None:
        """The last local declared before the use, else the parameter, else the field of the own class."""
        for start, names, local in reversed(declared):
            if start < at and name in names:
                return local
        for p, t in owner.get("_given", ()):
            if p == name:
                return t
        found = type_.fields.get(name)
        return found["declared_type"] if found else None
