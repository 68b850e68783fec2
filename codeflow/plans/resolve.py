"""Call resolution inside an application.

Calls are dealt into groups, and each group resolves its calls in one grouped map. In an application of at most
WHOLE_SYMBOLS symbols every group gets all of them. In a larger one a group begins with the files of its calls; where a
lookup needs types that the group does not have, it asks for them by name, and is run again with their files, until no
lookup asks. So neither the calls nor the symbols in a task grow with an application.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..javafacts import extract as X
from ..sources.snapshots import cut

#: Calls that one group should hold.
GROUP_CALLS = 20_000
#: Symbols of an application up to which each group gets all of them.
WHOLE_SYMBOLS = 30_000
#: Calls that one group of a larger application should hold.
ASKING_CALLS = 4_000

# Types of java.lang.
JAVA_LANG = frozenset(
    """AbstractMethodError Appendable ArithmeticException ArrayIndexOutOfBoundsException ArrayStoreException AssertionError AutoCloseable Boolean BootstrapMethodError Byte
    CharSequence Character Class ClassCastException ClassCircularityError ClassFormatError ClassLoader ClassNotFoundException ClassValue CloneNotSupportedException Cloneable
    Comparable Compiler Deprecated Double Enum EnumConstantNotPresentException Error Exception ExceptionInInitializerError Float FunctionalInterface IllegalAccessError
    IllegalAccessException IllegalArgumentException IllegalCallerException IllegalMonitorStateException IllegalStateException IllegalThreadStateException
    IncompatibleClassChangeError IndexOutOfBoundsException InheritableThreadLocal InstantiationError InstantiationException Integer InternalError InterruptedException IO Iterable
    LayerInstantiationException LinkageError Long MatchException Math Module ModuleLayer NegativeArraySizeException NoClassDefFoundError NoSuchFieldError NoSuchFieldException
    NoSuchMethodError NoSuchMethodException NullPointerException Number NumberFormatException Object OutOfMemoryError Override Package Process ProcessBuilder ProcessHandle
    Readable Record ReflectiveOperationException Runnable Runtime RuntimeException RuntimePermission SafeVarargs ScopedValue SecurityException SecurityManager Short StableValue
    StackOverflowError StackTraceElement StackWalker StrictMath String StringBuffer StringBuilder StringIndexOutOfBoundsException SuppressWarnings System Thread ThreadDeath
    ThreadGroup ThreadLocal Throwable TypeNotPresentException UnknownError UnsatisfiedLinkError UnsupportedClassVersionError UnsupportedOperationException VerifyError
    VirtualMachineError Void WrongThreadException""".split()
)
#: Primitive types in widening order, their boxes, and library supertypes in order of preference.
WIDENING = ["byte", "short", "int", "long", "float", "double"]
BOXES = {"boolean": "Boolean", "byte": "Byte", "char": "Character", "double": "Double", "float": "Float", "int": "Integer", "long": "Long", "short": "Short"}
_NUMBER, _VALUE = ["Number", "Serializable", "Comparable", "Object"], ["Serializable", "Comparable", "Object"]
SUPERTYPES = {"String": ["CharSequence", *_VALUE], "Boolean": _VALUE, "Character": _VALUE} | dict.fromkeys(["Byte", "Short", "Integer", "Long", "Float", "Double"], _NUMBER)
# Annotations of the web framework.
_S, _W = "org.springframework.stereotype.", "org.springframework.web.bind.annotation."
ROLES = {
    _W + "RestController": "controller", _S + "Controller": "controller", _S + "Service": "service", _S + "Component": "component", _S + "Repository": "repository",
    "jakarta.persistence.Entity": "entity", "javax.persistence.Entity": "entity", "org.springframework.cloud.openfeign.FeignClient": "httpClient",
}
QUALIFIER = "org.springframework.beans.factory.annotation.Qualifier"
#: Annotations that a wildcard import can stand for.
SUPPORTED = frozenset(ROLES) | {QUALIFIER, _W + "RequestMapping", _W + "ResponseBody", "jakarta.persistence.Table", "javax.persistence.Table", "org.springframework.boot.autoconfigure.SpringBootApplication", "org.springframework.context.annotation.ComponentScan"} | {f"{_W}{m}Mapping" for m in ("Get", "Post", "Put", "Delete", "Patch")}


def bare(name: str) -> str:
    """F13."""
    while "<" in name:
        shorter = re.sub(r"<[^<>]*>", "", name)
        if shorter == name:
            break
        name = shorter
    return re.sub(r"\.\.\.$", "", name.replace("[]", "").strip()).strip()


def erased(name: str) -> str:
    """F14."""
    while (shorter := re.sub(r"<[^<>]*>", "", name)) != name:
        name = shorter
    return re.sub(r"^\?\s*(?:extends|super)\s*", "", re.sub(r"\.\.\.$", "[]", name.strip())).rsplit(".", 1)[-1]


def annotation_name(written: str, imports: list[dict], namespace: str | None) -> str:
    """The full name of an annotation as written in a file."""
    if "." in written:
        return written
    for i in imports:
        if not i["is_static"] and not i["is_wildcard"] and i["qualified_name"].rsplit(".", 1)[-1] == written:
            return i["qualified_name"]
    for i in imports:
        if i["is_wildcard"] and not i["is_static"] and f"{i['qualified_name']}.{written}" in SUPPORTED:
            return f"{i['qualified_name']}.{written}"
    return f"{namespace}.{written}" if namespace else written


def literal(expression: str) -> str | None:
    m = re.fullmatch(r'\s*"((?:\\.|[^"\\])*)"\s*', expression)
    return re.sub(r"\\(.)", r"\1", m[1]) if m else None


class Application:
    """The symbol tables of one application."""

    def __init__(self, symbols: list[dict], imports: list[dict]):
        self.by_id = {s["id"]: s for s in symbols}  # the last one counts
        self.imports: dict[str, list[dict]] = defaultdict(list)
        for i in sorted(imports, key=lambda i: i["ord"]):
            self.imports[i["uri"]].append(i)
        self.types = [s for s in symbols if s["kind"] == "type"]
        self.by_name, self.by_qualified = defaultdict(list), defaultdict(list)
        for t in self.types:
            self.by_name[t["symbol"]["name"]].append(t)
            self.by_qualified[t["symbol"]["qualified_name"]].append(t)
        self.parameters, self.members, self.fields, self.variables = defaultdict(list), defaultdict(list), defaultdict(list), {}
        for s in symbols:
            if s["kind"] == "parameter":
                self.parameters[s["owner_symbol_id"]].append(s)
            if s["kind"] in ("parameter", "field"):
                self.variables[s["owner_symbol_id"], s["symbol"]["name"]] = s
            if s["kind"] == "field":
                self.fields[s["owner_symbol_id"], s["symbol"]["name"]].append(s)
        for p in self.parameters.values():
            p.sort(key=lambda s: s["param_index"])
        for s in symbols:
            if s["kind"] in ("method", "constructor"):
                name = s["symbol"]["name"] if s["kind"] == "method" else "<init>"
                self.members[s["owner_symbol_id"], name, len(self.parameters[s["id"]])].append(s)
        self._parents: dict[str, list[dict]] = {}

    # ------------------------------------------------------------ types

    def owner_type(self, s: dict | None) -> dict | None:
        while s is not None and s["kind"] != "type":
            s = self.by_id.get(s["owner_symbol_id"])
        return s

    def explicit_import(self, name: str, at: dict) -> str | None:
        return next((i["qualified_name"] for i in self.imports[at["uri"]] if not i["is_static"] and not i["is_wildcard"] and i["qualified_name"].rsplit(".", 1)[-1] == name), None)

    def types_named(self, written: str, at: dict) -> list[dict]:
        """Types that a name can mean at a symbol; the first tier that answers decides."""
        name = bare(written)
        if "." in name:
            found = self.by_qualified.get(name)
            return found or (self.by_qualified.get(f"{at['namespace_name']}.{name}", []) if at["namespace_name"] else [])
        outer = self.owner_type(at)
        while outer is not None:
            if found := self.by_qualified.get(f"{outer['symbol']['qualified_name']}.{name}"):
                return found
            outer = self.owner_type(self.by_id.get(outer["owner_symbol_id"]))
        if imported := self.explicit_import(name, at):
            return self.by_qualified.get(imported, [])  # an import decides, even if nothing is indexed under it
        if at["namespace_name"] and (found := self.by_qualified.get(f"{at['namespace_name']}.{name}")):
            return found
        return self.types_called(name)

    def types_called(self, name: str) -> list[dict]:
        return self.by_name.get(name, [])

    def full_name(self, written: str, at: dict) -> str:
        """J2."""
        name = bare(written)
        return name if "." in name else self.explicit_import(name, at) or name

    def parents(self, t: dict) -> list[dict]:
        if t["id"] not in self._parents:
            self._parents[t["id"]] = [p for name in t["super_types"] or () for p in self.types_named(name, t) if p["id"] != t["id"]]
        return self._parents[t["id"]]

    def upwards(self, t: dict):
        """The type and its ancestors in depth-first order, each once."""
        seen, stack = set(), [t]
        while stack:
            x = stack.pop()
            if x["id"] not in seen:
                seen.add(x["id"])
                yield x
                stack += reversed(self.parents(x))

    @cached_property
    def implementations(self) -> dict[str, list[dict]]:
        """Concrete classes below each type."""
        out = defaultdict(list)
        for t in self.types:
            if t["declaration_kind"] == "class" and "abstract" not in (t["modifiers"] or ()):
                for a in self.upwards(t):
                    if a["id"] != t["id"]:
                        out[a["id"]].append(t)
        return out

    def below(self, t: dict) -> list[dict]:
        return self.implementations.get(t["id"], [])

    # ------------------------------------------------------------ members

    def caller(self, id_: str) -> dict:
        return self.by_id[id_]

    def open(self, t: dict) -> None:
        """Called before the members of a type are looked at."""

    def fields_named(self, types: list[dict], name: str) -> list[dict]:
        """On every branch upwards the nearest declaration."""
        out: dict[str, dict] = {}
        stack, seen = list(reversed(types)), set()
        while stack:
            t = stack.pop()
            if t["id"] in seen:
                continue
            seen.add(t["id"])
            self.open(t)
            if own := self.fields.get((t["id"], name)):
                out.update((f["id"], f) for f in own)
            else:
                stack += reversed(self.parents(t))
        return list(out.values())

    def methods_named(self, types: list[dict], name: str, arity: int) -> list[dict]:
        """Of each root the nearest method for every list of parameter types."""
        out: dict[str, dict] = {}
        for root in types:
            hidden = set()
            for t in self.upwards(root):
                self.open(t)
                for m in self.members.get((t["id"], name, arity), ()):
                    key = tuple(erased(p["declared_type"] or "") for p in self.parameters[m["id"]])
                    if key not in hidden:
                        hidden.add(key)
                        out[m["id"]] = m
        return list(out.values())

    # ------------------------------------------------------------ overloads

    def distance(self, argument: str, wanted: str, at: dict, seen: set[str] | None = None) -> int | None:
        """Steps upwards from the types that a name means at a symbol to one of that simple name, as they are first met
        depth first. A declared supertype counts by its name, indexed or not; it is looked up where it is declared."""
        seen = set() if seen is None else seen
        for t in self.types_named(argument, at):
            if t["id"] in seen:
                continue
            if t["symbol"]["qualified_name"].rsplit(".", 1)[-1] == wanted:
                return 0
            seen.add(t["id"])
            for above in t["super_types"] or ():
                steps = 0 if erased(above) == wanted else self.distance(above, wanted, t, seen)
                if steps is not None:
                    return steps + 1
        return None

    @staticmethod
    def primitive(a: str, w: str) -> int | None:
        """Identity, widening by its steps, boxing."""
        if a == w:
            return 0
        wider = WIDENING[2:] if a == "char" else WIDENING[WIDENING.index(a) + 1 :] if a in WIDENING else []
        return wider.index(w) + 1 if w in wider else 10 if BOXES[a] == w else None

    def conversion(self, argument: str | None, wanted: str, at: dict) -> int | None:
        """The cost of passing an argument to a parameter of the callable ``at``, None if it cannot be passed."""
        if argument is None:
            return 0
        a, w = erased(argument), erased(wanted)
        if a == "null":
            return None if w in BOXES else 30 if w == "Object" else 20
        if a == w:
            return 0
        if a in BOXES:
            return self.primitive(a, w)
        opened = next((p for p, b in BOXES.items() if b == a), None)
        if opened and w in BOXES:
            cost = self.primitive(opened, w)
            return None if cost is None else cost + 10
        if w in (above := SUPERTYPES.get(a, [])):
            return above.index(w) + 1
        if w == "Object":
            return 30
        steps = self.distance(argument, w, at)
        return None if steps is None else steps + 1

    def overloads(self, found: list[dict], arguments: list[str | None]) -> list[dict]:
        """The cheapest ones, all of them on a tie; all if none fits."""
        if len(found) < 2:
            return found
        scored = []
        for m in found:
            parameters = self.parameters[m["id"]]
            costs = [self.conversion(a, p["declared_type"], m) for a, p in zip(arguments, parameters) if p["declared_type"] is not None]
            if len(parameters) == len(arguments) and None not in costs:
                scored.append((sum(costs), m))
        least = min((c for c, _ in scored), default=None)
        return [m for c, m in scored if c == least] if scored else found

    # ------------------------------------------------------------ injection

    def role(self, t: dict) -> str:
        names = (annotation_name(a["name"], self.imports[t["uri"]], t["namespace_name"]) for a in t["annotations"] or ())
        return next((ROLES[n] for n in names if n in ROLES), "helper")

    def bean_names(self, t: dict) -> set[str]:
        name = t["symbol"]["name"]
        out = {name if len(name) > 1 and name[:2] == name[:2].upper() else name[:1].lower() + name[1:]}
        for a in t["annotations"] or ():
            if (full := annotation_name(a["name"], self.imports[t["uri"]], t["namespace_name"])) == QUALIFIER or full in ROLES:
                out |= {v for x in a["arguments"] if x["name"] in (None, "value") and (v := literal(x["expression"])) is not None}
        return out

    def injected(self, variable: dict, types: list[dict]) -> tuple[list[dict], str | None]:
        """The class that an injected interface stands for."""
        if len(types) != 1 or types[0]["declaration_kind"] != "interface":
            return types, None
        below = self.below(types[0])
        note = next((a for a in variable["annotations"] or () if annotation_name(a["name"], self.imports[variable["uri"]], variable["namespace_name"]) == QUALIFIER), None)
        if note:
            value = next((v for x in note["arguments"] if x["name"] in (None, "value") and (v := literal(x["expression"])) is not None), None)
            match = [t for t in below if value is not None and value in self.bean_names(t)]
            return (match, "@Qualifier implementation") if len(match) == 1 else (types, "interface fallback after unresolved @Qualifier")
        return (below, "single interface implementation") if len(below) == 1 else (types, "interface fallback without a unique implementation")


class Missing(Exception):
    """A lookup needs types that the group does not have."""


def last(name: str) -> str:
    return name.rsplit(".", 1)[-1]


class Slice(Application):
    """The symbols that a group of calls has. Names whose types it has are ``known``: q:full name, n:simple name, and
    s:simple name of a supertype. A lookup of another name adds it to ``missing`` and is given up."""

    def __init__(self, symbols: list[dict], imports: list[dict], known: set[str]):
        super().__init__(symbols, imports)
        self.known, self.missing = known, set()
        self._below: dict[str, list[dict]] = {}

    def ask(self, *keys: str) -> bool:
        new = [k for k in keys if k not in self.known]
        self.missing.update(new)
        return bool(new)

    def need(self, *keys: str) -> None:
        if self.ask(*keys):
            raise Missing

    def types_named(self, written: str, at: dict) -> list[dict]:
        name, inside = bare(written), at["namespace_name"]
        if "." in name:
            keys = [name, f"{inside}.{name}"] if inside else [name]
        else:
            keys, outer = [], self.owner_type(at)
            while outer is not None:
                keys.append(f"{outer['symbol']['qualified_name']}.{name}")
                outer = self.owner_type(self.by_id.get(outer["owner_symbol_id"]))
            if imported := self.explicit_import(name, at):
                keys.append(imported)
            elif inside:
                keys.append(f"{inside}.{name}")
        self.need(*(f"q:{k}" for k in keys))
        return super().types_named(written, at)

    def types_called(self, name: str) -> list[dict]:
        self.need(f"n:{name}")
        return super().types_called(name)

    def whole(self, t: dict) -> bool:
        """Whether all files that declare the type are there with its members; else they are asked for."""
        return f"n:{t['symbol']['name']}" in self.known or not self.ask(f"q:{t['symbol']['qualified_name']}")

    def open(self, t: dict) -> None:
        if not self.whole(t):
            raise Missing

    def caller(self, id_: str) -> dict:
        own = self.owner_type(self.by_id[id_])
        if own is not None:
            self.whole(own)  # the lookups go on: they show what else to ask for
        return self.by_id[id_]

    def parents(self, t: dict) -> list[dict]:
        if t["id"] not in self._parents:
            gaps = False
            for name in t["super_types"] or ():
                try:
                    self.types_named(name, t)
                except Missing:
                    gaps = True
            if gaps:
                raise Missing
        return super().parents(t)

    @cached_property
    def heirs(self) -> dict[str, list[tuple[dict, str]]]:
        out = defaultdict(list)
        for t in self.types:
            for name in t["super_types"] or ():
                out[last(bare(name))].append((t, name))
        return out

    def below(self, t: dict) -> list[dict]:
        """X10 for one type, downwards over the types that name it."""
        if t["id"] not in self._below:
            seen, stack, gaps = {t["id"]}, [t], False
            while stack:
                x = stack.pop()
                for name in {x["symbol"]["name"], last(x["symbol"]["qualified_name"])}:
                    gaps |= self.ask(f"s:{name}")
                    for heir, written in self.heirs.get(name, ()):
                        try:
                            if heir["id"] not in seen and any(p["id"] == x["id"] for p in self.types_named(written, heir)):
                                seen.add(heir["id"])
                                stack.append(heir)
                        except Missing:
                            gaps = True
            if gaps:
                raise Missing
            self._below[t["id"]] = [h for h in self.types if h["id"] in seen and h["id"] != t["id"] and h["declaration_kind"] == "class" and "abstract" not in (h["modifiers"] or ())]
        return self._below[t["id"]]


def _at(p: dict) -> tuple[int, int]:
    return p["line"], p["column"]


class Resolver:
    """Calls of one group against the tables of their application."""

    def __init__(self, app: Application, calls: list[dict]):
        self.app, self.of = app, defaultdict(list)
        for c in sorted(calls, key=lambda c: (c["uri"], c["ord"])):
            self.of[c["enclosing_symbol_id"]].append(c)
        self.done: dict[int, dict] = {}

    def nested(self, expression: str, call: dict) -> dict | None:
        """The only target of the call that this expression is, if it lies inside of ``call``."""
        start, end = _at(call["loc"]["start"]), _at(call["loc"]["end"])
        for c in self.of[call["enclosing_symbol_id"]]:
            if c is not call and c["expression"] == expression and _at(c["loc"]["start"]) >= start and _at(c["loc"]["end"]) <= end:
                if c["kind"] != "method" or (_at(c["loc"]["start"]), _at(c["loc"]["end"])) == (start, end):
                    return None
                found = self.resolve(c)["targets"]
                return found[0] if len(found) == 1 and found[0]["declared_type"] is not None else None
        return None

    def resolve(self, call: dict) -> dict:
        key = id(call)
        if key not in self.done:
            self.done[key] = self._resolve(call)
        return self.done[key]

    def _resolve(self, call: dict) -> dict:
        app, source = self.app, self.app.caller(call["enclosing_symbol_id"])
        arguments = []
        for shown, expression in zip(call["argument_types"], call["argument_expressions"], strict=True):
            inner = self.nested(expression, call) if shown is None else None
            arguments.append(shown or (inner["declared_type"] if inner else None))
        if call["kind"] == "constructor":
            types = app.types_named(call["member_name"], source)
            for t in types:
                app.open(t)
            found = app.overloads([c for t in types for c in app.members.get((t["id"], "<init>", call["argument_count"]), ())], arguments)
            return self.result(found, "exact", "constructor type, arity, and argument types", None if types else app.full_name(call["member_name"], source))
        own = app.owner_type(source)
        if own is None:
            return self.result([], "unresolved", "invocation has no enclosing type", None)
        types, confidence, reason, fallback = self.receiver(call, source, own)
        every = app.methods_named(types, call["member_name"], call["argument_count"])
        found = app.overloads(every, arguments)
        if len(found) < len(every):
            reason += "; overload selected by argument types"
        return self.result(found, confidence, reason, None if found else fallback)

    @staticmethod
    def result(targets: list[dict], confidence: str, reason: str, fallback: str | None) -> dict:
        if fallback and fallback.split(".", 1)[0] in JAVA_LANG:
            fallback = f"java.lang.{fallback}"
        return {"targets": targets, "confidence": "ambiguous" if len(targets) > 1 else confidence if targets else "unresolved", "reason": reason, "fallback": fallback}

    def receiver(self, call: dict, source: dict, own: dict) -> tuple[list[dict], str, str, str | None]:
        """(types, confidence, reason, owner to fall back on)."""
        app, written = self.app, call["receiver_expression"]
        name = re.sub(r"^this\.", "", written) if written else None
        if name is None or name == "this":
            return [own], "exact", "same type method and arity", self.static_owner(call["member_name"], source)
        if not re.fullmatch(r"[A-Za-z_$][\w$]*", name):
            return self.expression(call, source)
        variable = app.variables.get((source["id"], name))
        if variable is None:
            fields = app.fields_named([own], name)
            variable = fields[0] if len(fields) == 1 else None
        if variable is not None and variable["declared_type"] is not None:
            declared = app.types_named(variable["declared_type"], source)
            types, why = app.injected(variable, declared)
            reason = f"{variable['kind']} declared type" + (f"; {why}" if why else "")
            return types, "inferred", reason, None if declared else app.full_name(variable["declared_type"], source)
        for type_, confidence, reason in ((call["receiver_type"], "inferred", "receiver inferred type"), (name if name[0] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else None, "exact", "static receiver type and arity")):
            if type_ is not None:
                types = app.types_named(type_, source)
                return types, confidence, reason, None if types else app.full_name(type_, source)
        return [], "unresolved", "receiver declaration was not found", None

    def expression(self, call: dict, source: dict) -> tuple[list[dict], str, str, str | None]:
        app, inner = self.app, self.nested(call["receiver_root_expression"] or call["receiver_expression"], call)
        type_, at = (inner["declared_type"], inner) if inner else (call["receiver_type"], source)
        unknown = [], "unresolved", "receiver expression type is unknown", None
        if type_ is None:
            return unknown
        types = app.types_named(type_, at)
        for member in call["receiver_member_path"] or ():
            fields = app.fields_named(types, member)
            if len(fields) != 1 or fields[0]["declared_type"] is None:
                return unknown
            type_, at = fields[0]["declared_type"], fields[0]
            types = app.types_named(type_, at)
        reason = ("nested invocation return type" if inner else "receiver inferred type") + ("; member declared type" if call["receiver_member_path"] else "")
        return types, "inferred", reason, None if types else app.full_name(type_, at)

    def static_owner(self, member: str, source: dict) -> str | None:
        static = [i for i in self.app.imports[source["uri"]] if i["is_static"]]
        exact = [i["qualified_name"] for i in static if not i["is_wildcard"] and i["qualified_name"].endswith(f".{member}")]
        wild = [i["qualified_name"] for i in static if i["is_wildcard"]]
        return exact[0][: -len(member) - 1] if len(exact) == 1 else wild[0] if len(wild) == 1 else None


RESOLVED = f"application_id string, uri string, ord int, source_id string, target_id string, confidence string, reason string, candidates int, fallback_owner string, kind string, member_name string, argument_types array<string>, loc {X.LOC}"


#: What lookups need of a symbol.
NEEDED = ["uri", "namespace_name", "ord", "id", "kind", "owner_symbol_id", "symbol", "declared_type", "modifiers", "annotations", "declaration_kind", "super_types", "param_index"]


def resolve_calls(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """A row for each call and candidate (one with a null target where there is none). With ``files`` (application_id, uri)
    only their calls are resolved; symbol tables go out for the applications that have such calls."""
    sizes = facts.groupBy("application_id").agg(F.sum(F.size("symbols")).alias("n"))
    large = cut(sizes.filter(F.col("n") > WHOLE_SYMBOLS).select("application_id"))
    if large.isEmpty():
        return resolve_whole(facts, files)
    rest, big = facts.join(large, "application_id", "left_anti"), facts.join(large, "application_id", "left_semi")
    return resolve_whole(rest, files).unionByName(resolve_asking(big, files)[0])


def _note(a):
    return F.struct(a["name"].alias("name"), F.transform(a["arguments"], lambda x: F.struct(x["name"].alias("name"), x["expression"].alias("expression"))).alias("arguments"))


def _rows(resolver: Resolver, calls: list[dict]) -> list[dict]:
    out = []
    for c in calls:
        r = resolver.resolve(c)
        for t in r["targets"] or [None]:
            out.append({"application_id": c["app"], "uri": c["uri"], "ord": c["ord"], "source_id": c["enclosing_symbol_id"], "target_id": t and t["id"], "confidence": r["confidence"], "reason": r["reason"], "candidates": len(r["targets"]), "fallback_owner": r["fallback"], "kind": c["kind"], "member_name": c["member_name"], "argument_types": c["argument_types"], "loc": c["loc"]})
    return out


def _invocations(facts: DataFrame, files: DataFrame | None) -> DataFrame:
    return X.invocations(facts if files is None else facts.join(files, ["application_id", "uri"], "left_semi"))


def _groups(calls: DataFrame, most: int) -> DataFrame:
    return calls.groupBy("application_id").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / most)).cast("int").alias("groups"))


def resolve_whole(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Calls by the whole symbol tables of their application."""
    symbols = X.symbols(facts)
    imports = X.imports(facts)
    calls = _invocations(facts, files)
    n = _groups(calls, GROUP_CALLS)
    dealt = calls.join(n, "application_id").withColumn("g", F.pmod(F.xxhash64("enclosing_symbol_id"), F.col("groups")).cast("int")).drop("groups").withColumnRenamed("application_id", "app").withColumnRenamed("g", "group")
    everywhere = lambda df: df.join(n, "application_id").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    used = symbols.withColumn("annotations", F.transform("annotations", _note)).select("application_id", F.struct(*NEEDED).alias("s"))  # no places: lookups don't need them
    named = imports.select("application_id", F.struct("uri", "ord", "qualified_name", "is_static", "is_wildcard").alias("i"))
    tables = everywhere(used.unionByName(named, allowMissingColumns=True))

    arrow = to_arrow_schema(StructType.fromDDL(RESOLVED))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.select(["s", "i"]).to_pylist()
        symbols_ = sorted((r["s"] for r in rows if r["s"]), key=lambda s: (s["uri"], s["ord"]))
        app = Application(symbols_, [r["i"] for r in rows if r["i"]])
        own = [c for c in right.to_pylist() if c["enclosing_symbol_id"] in app.by_id]
        return pa.Table.from_pylist(_rows(Resolver(app, own), own), schema=arrow)

    return tables.groupBy("application_id", "g").cogroup(dealt.groupBy("app", "group")).applyInArrow(run, RESOLVED)


def _names(files: DataFrame) -> DataFrame:
    """(application_id, key, uri): the files of the types that a name of ``Slice`` stands for."""
    types = F.transform(F.filter("symbols", lambda s: s["kind"] == "type"), lambda s: F.struct(s["symbol"]["name"].alias("name"), s["symbol"]["qualified_name"].alias("full"), s["super_types"].alias("above")))
    schema = pa.schema([("application_id", pa.string()), ("key", pa.string()), ("uri", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                keys = {k for t in r["types"] for k in (f"q:{t['full']}", f"n:{t['name']}", *(f"s:{last(bare(a))}" for a in t["above"] or ()))}
                out += ((r["application_id"], k, r["uri"]) for k in sorted(keys))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)] or [pa.array([], pa.string())] * 3, schema=schema)

    return files.select("application_id", "uri", types.alias("types")).mapInArrow(run, "application_id string, key string, uri string")


def resolve_asking(facts: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls as ``resolve_whole`` gives them, the files (application_id, g, uri, full) that each group had in the end):
    calls by the symbols that their group asks for, in rounds. Of a file found by a supertype's name a group gets the types
    only, until it looks at members."""
    symbols_ = F.transform("symbols", lambda s: F.struct(*(s[c].alias(c) for c in NEEDED if c not in ("uri", "namespace_name", "ord", "annotations")), F.transform(s["annotations"], _note).alias("annotations")))
    imports_ = F.transform("imports", lambda i: F.struct(*(i[c].alias(c) for c in ("qualified_name", "is_static", "is_wildcard"))))
    lean = cut(facts.select("application_id", "uri", "namespace_name", symbols_.alias("symbols"), imports_.alias("imports")))
    names, calls = cut(_names(lean)), _invocations(facts, files)
    dealt = calls.join(_groups(calls, ASKING_CALLS), "application_id").withColumn("group", F.pmod(F.xxhash64("uri"), F.col("groups")).cast("int")).drop("groups")
    dealt = cut(dealt.withColumnRenamed("application_id", "app"))
    at = ["application_id", "g"]
    had = cut(dealt.select(F.col("app").alias("application_id"), F.col("group").alias("g"), "uri", F.lit(True).alias("full")).distinct())
    schema = f"{RESOLVED}, g int, key string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found, imports, known = [], [], set()
        for r in left.select(["uri", "namespace_name", "symbols", "imports", "key"]).to_pylist():
            if r["key"] is not None:
                known.add(r["key"])
                continue
            found += ({"uri": r["uri"], "namespace_name": r["namespace_name"], "ord": i, **s} for i, s in enumerate(r["symbols"]))
            imports += ({"uri": r["uri"], "ord": i, **x} for i, x in enumerate(r["imports"]))
        app = Slice(sorted(found, key=lambda s: (s["uri"], s["ord"])), imports, known)
        own = [c for c in right.to_pylist() if c["enclosing_symbol_id"] in app.by_id]
        resolver = Resolver(app, own)
        for c in own:
            try:
                resolver.resolve(c)
            except Missing:
                pass
        asked = [{"application_id": own[0]["app"], "g": own[0]["group"], "key": k} for k in sorted(app.missing)]
        return pa.Table.from_pylist(asked or _rows(resolver, own), schema=arrow)

    known, open_, done = None, None, []
    while True:
        tables = had.join(lean, ["application_id", "uri"]).withColumn("symbols", F.when(F.col("full"), F.col("symbols")).otherwise(F.filter("symbols", lambda s: s["kind"] == "type"))).drop("full")
        tables = tables.withColumn("key", F.lit(None).cast("string")) if known is None else tables.unionByName(known, allowMissingColumns=True)
        asking = dealt
        if open_ is not None:
            tables, asking = tables.join(open_, at, "left_semi"), dealt.join(open_.toDF("app", "group"), ["app", "group"], "left_semi")
        out = cut(tables.groupBy(*at).cogroup(asking.groupBy("app", "group")).applyInArrow(run, schema))
        done.append(out.filter("key is null").drop("g", "key"))
        new = out.filter("key is not null").select(*at, "key")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, done), had
        known = new if known is None else known.unionByName(new)
        open_ = new.select(*at).distinct()
        more = new.join(names, ["application_id", "key"]).select(*at, "uri", (~F.startswith("key", F.lit("s:"))).alias("full"))
        had = cut(had.unionByName(more).groupBy(*at, "uri").agg(F.max("full").alias("full")))
