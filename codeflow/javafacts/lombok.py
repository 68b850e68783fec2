"""Members that Lombok annotations generate, unless a callable of the same name and arity exists."""

from __future__ import annotations

import re

from .parser import FileParser

# Lombok annotations that generate members.
SLF4J, GENERATED_BY = "lombok.extern.slf4j.Slf4j", "lombok"
_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _known(parser: FileParser, note: dict, name: str) -> bool:
    """The full name, or the simple name with an import of it or, if no class is imported by that name, of all above."""
    full, written = SLF4J if name == "Slf4j" else f"lombok.{name}", note["name"]
    if written != name:
        return written == full
    plain = [i["qualified_name"] for i in parser.imports if not i["is_static"] and not i["is_wildcard"] and i["qualified_name"].rsplit(".", 1)[-1] == name and "." in i["qualified_name"]]
    if plain:
        return full in plain
    return any(i["is_wildcard"] and not i["is_static"] and full.startswith(f"{i['qualified_name']}.") for i in parser.imports)


def _annotation(parser: FileParser, symbol: dict, names) -> dict | None:
    return next((n for n in symbol["annotations"] for name in names if _known(parser, n, name)), None)


def _off(note: dict) -> bool:
    return any(re.search(r"(?:^|\.)NONE$", re.sub(r"\s", "", a["expression"])) for a in note["arguments"])


def generate(parser: FileParser) -> None:
    symbols = list(parser.symbols)
    count: dict[str, int] = {}
    for s in symbols:
        if s["kind"] == "parameter":
            count[s["owner_symbol_id"]] = count.get(s["owner_symbol_id"], 0) + 1
    taken = {(s["owner_symbol_id"], s["kind"], s["symbol"]["name"], count.get(s["id"], 0)) for s in symbols if s["kind"] in ("method", "constructor") and not s["implicit"]}

    def add(type_: dict, kind: str, name: str, given: list[dict], returns: str | None, at: dict, behaviour: str, modifiers: tuple[str, ...] = ("public",)) -> None:
        """A callable whose parameters are the given fields."""
        key = (type_["id"], kind, name, len(given))
        if key in taken:
            return
        taken.add(key)
        q, types = type_["symbol"]["qualified_name"], ",".join(f["declared_type"] for f in given)
        if kind == "constructor":  # it replaces the implicit one
            parser.symbols[:] = [s for s in parser.symbols if not (s["implicit"] and s["generated_by"] is None and s["owner_symbol_id"] == type_["id"])]
        signature = f"{q}#constructor({types})" if kind == "constructor" else f"{q}#method:{name}({types}):{returns}"
        s = parser.add(kind, type_["id"], name, f"{q}#{'<init>' if kind == 'constructor' else name}", signature, 0, 0, declared_type=q if kind == "constructor" else returns, modifiers=list(modifiers), generated_by=GENERATED_BY, implicit=True, method_behavior=behaviour)
        s["loc"] = at
        for k, f in enumerate(given):
            p, t = f["symbol"]["name"], f["declared_type"]
            x = parser.add("parameter", s["id"], p, f"{s['symbol']['qualified_name']}.{p}", f"{signature}#parameter:{k}:{p}:{t}", 0, 0, declared_type=t, param_index=k, generated_by=GENERATED_BY, implicit=True)
            x["loc"] = f["loc"]

    def wanted(f: dict, type_: dict, accessor: str, bundles: tuple[str, ...]) -> bool:
        """Whether a field gets an accessor: its own annotation decides, else, for instance fields, those of its type."""
        if note := _annotation(parser, f, [accessor]):
            return not _off(note)
        above = _annotation(parser, type_, [accessor])
        return "static" not in f["modifiers"] and bool((above and not _off(above)) or _annotation(parser, type_, bundles))

    for type_ in [s for s in symbols if s["kind"] == "type"]:
        q, name, at = type_["symbol"]["qualified_name"], type_["symbol"]["name"], type_["loc"]
        fields = [s for s in symbols if s["kind"] == "field" and s["owner_symbol_id"] == type_["id"]]
        own = [f for f in fields if "static" not in f["modifiers"]]
        typed = [f for f in own if f["declared_type"] is not None]
        none, all_, builder = (_annotation(parser, type_, [x]) for x in ("NoArgsConstructor", "AllArgsConstructor", "Builder"))
        explicit = any(s["kind"] == "constructor" and s["owner_symbol_id"] == type_["id"] and not s["implicit"] for s in symbols)
        if none:
            add(type_, "constructor", name, [], None, none["loc"], "trivialConstructor")
        if all_ or (builder and not none and not explicit):  # a builder needs one; it is not public
            add(type_, "constructor", name, typed, None, (all_ or builder)["loc"], "trivialConstructor", ("public",) if all_ else ())
        if (note := _annotation(parser, type_, ["Slf4j"])) and not any(f["symbol"]["name"] == "log" for f in fields):
            x = parser.add("field", type_["id"], "log", f"{q}#log", f"{q}#field:log:org.slf4j.Logger", 0, 0, declared_type="org.slf4j.Logger", modifiers=["private", "static", "final"], generated_by=GENERATED_BY, implicit=True)
            x["loc"] = note["loc"]
        if builder:
            label = f"{name}Builder"
            b = next((s for s in symbols if s["kind"] == "type" and s["owner_symbol_id"] == type_["id"] and s["symbol"]["name"] == label), None)
            if b is None:
                b = parser.add("type", type_["id"], label, f"{q}.{label}", f"type:{q}.{label}", 0, 0, modifiers=["public", "static"], declaration_kind="class", generated_by=GENERATED_BY, implicit=True)
                b["loc"] = at
            made = b["symbol"]["qualified_name"]
            add(type_, "method", "builder", [], made, builder["loc"], "trivialBuilder", ("public", "static"))
            for f in typed:
                add(b, "method", f["symbol"]["name"], [f], made, f["loc"], "trivialBuilder")
            add(b, "method", "build", [], q, builder["loc"], "trivialBuilder")
        value = _annotation(parser, type_, ["Value"])
        for f in fields:
            title, kind = f["symbol"]["name"], f["declared_type"]
            stem = title[2:] if kind == "boolean" and title[:2] == "is" and title[2:3] in _UPPER else title
            title = stem[:1].upper() + stem[1:]
            if kind is None:
                continue
            if wanted(f, type_, "Getter", ("Data", "Value")):
                add(type_, "method", ("is" if kind == "boolean" else "get") + title, [], kind, f["loc"], "trivialGetter")
            if "final" not in f["modifiers"] and not value and wanted(f, type_, "Setter", ("Data",)):
                add(type_, "method", "set" + title, [f], "void", f["loc"], "trivialSetter")
