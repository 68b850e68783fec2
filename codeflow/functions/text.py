"""Scalar functions of code analysis as Spark columns; all but ``nfc`` stay in the JVM.

"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Annotation members of the web framework's mapping annotations.
HTTP_METHODS = ["DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT", "TRACE"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_version(text: Column | str) -> Column:
    """'sha256:' and the hexadecimal SHA-256 of the UTF-8 text."""
    return F.concat(F.lit("sha256:"), F.sha2(_c(text), 256))


def request_fingerprint(**fields: Column) -> Column:
    """JSON of the request's fields in the given order."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "false"})


def normalize_relative_uri(uri: Column | str) -> Column:
    """forward slashes, no empty or '.' segments, '..' folded where there is something to fold."""
    parts = F.split(F.replace(_c(uri), F.lit("\\"), F.lit("/")), "/")
    parts = F.filter(parts, lambda p: (p != "") & (p != "."))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    fold = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (last(a) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def encode_component(text: Column | str) -> Column:
    """percent-encoding that leaves letters, digits and - _ . ! ~ * ' ( ) as they are."""
    out = F.url_encode(_c(text))
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def decode_component(text: Column | str) -> Column:
    """The inverse of F4: a plus sign stays one."""
    return F.url_decode(F.replace(_c(text), F.lit("+"), F.lit("%2B")))


@F.pandas_udf(StringType())
def _nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc(text: Column | str) -> Column:
    """Unicode NFC."""
    return _nfc(_c(text))


def stable_id(scheme: str, *parts: Column) -> Column:
    """Transparent id: the scheme and the encoded parts."""
    return F.concat_ws(":", F.lit(scheme), *(encode_component(p) for p in parts))


def directory_uri(uri: Column | str) -> Column:
    """with exactly one slash at the end."""
    return F.concat(F.regexp_replace(_c(uri), "/+$", ""), F.lit("/"))


def without_query(uri: Column | str) -> Column:
    """without query and fragment."""
    return F.regexp_replace(_c(uri), "[?#].*$", "")


def relative_uri_within(root: Column | str, uri: Column | str) -> Column:
    """the normalised, decoded path of ``uri`` below ``root``, or null."""
    base = directory_uri(root)
    return F.when(F.startswith(_c(uri), base), normalize_relative_uri(decode_component(F.substring(without_query(uri), F.length(base) + 1, F.length(_c(uri))))))


def join_http_path(prefix: Column | str, suffix: Column | str) -> Column:
    """F8: both without one slash at each end, joined, with a leading slash."""
    trim = lambda x: F.regexp_replace(F.regexp_replace(_c(x), "^/", ""), "/$", "")
    part = lambda x: F.when(trim(x) != "", trim(x))
    return F.concat(F.lit("/"), F.concat_ws("/", part(prefix), part(suffix)))


def unique_sorted(values: Column | str) -> Column:
    """distinct values in binary order."""
    return F.array_sort(F.array_distinct(_c(values)))


_LITERAL = r'"((?:\\.|[^"\\])*)"'


def string_literals(expression: Column | str) -> Column:
    """the contents of the string literals of an expression, unescaped; those that do not parse are left out."""
    raw = F.regexp_extract_all(_c(expression), F.lit(_LITERAL), F.lit(1))
    read = F.transform(raw, lambda s: F.get_json_object(F.concat(F.lit('{"v":"'), s, F.lit('"}')), "$.v"))
    return F.filter(read, lambda s: s.isNotNull())


def named_argument_literals(arguments: Column | str, names: list[str | None]) -> Column:
    """the literals of those arguments (structs of name and expression) that have one of the names (None: no name)."""
    plain = [n for n in names if n is not None]
    has = lambda a: a["name"].isin(plain) | (a["name"].isNull() if None in names else F.lit(False))
    return F.flatten(F.transform(F.filter(_c(arguments), lambda a: F.coalesce(has(a), F.lit(False))), lambda a: string_literals(a["expression"])))


def request_methods(expression: Column | str) -> Column:
    """known HTTP methods written as RequestMethod.X."""
    return F.array_intersect(F.regexp_extract_all(_c(expression), F.lit(r"RequestMethod\.(\w+)"), F.lit(1)), F.array(*map(F.lit, HTTP_METHODS)))


def without_generics(text: Column | str, depth: int = 6) -> Column:
    """Type text without its type arguments, up to the given nesting."""
    out = _c(text)
    for _ in range(depth):
        out = F.regexp_replace(out, "<[^<>]*>", "")
    return out


def plain_type_name(text: Column | str) -> Column:
    """without generics, array brackets, a trailing ellipsis and outer blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_generics(text), r"\[\]", ""), r"\.\.\.\s*$", ""))


def erased_type(text: Column | str) -> Column:
    """the simple name as overloads compare it: without generics and wildcard prefix, '...' as an array."""
    bare = F.regexp_replace(F.trim(without_generics(text)), r"\.\.\.$", "[]")
    bare = F.regexp_replace(bare, r"^\?\s*(?:extends|super)\s+", "")
    return F.element_at(F.split(bare, r"\."), -1)


def qualify_known(name: Column | str, known: list[str], namespace: str = "java.lang") -> Column:
    """names whose first segment is one of ``known`` get the implicit namespace."""
    return F.when(F.substring_index(_c(name), ".", 1).isin(known), F.concat(F.lit(namespace + "."), _c(name))).otherwise(_c(name))


def default_bean_name(name: Column | str) -> Column:
    """F16: lower first letter, unless the first two characters equal their upper case."""
    head = F.substring(_c(name), 1, 2)
    keep = (F.length(_c(name)) > 1) & (head == F.upper(head))
    return F.when(keep, _c(name)).otherwise(F.concat(F.lower(F.substring(_c(name), 1, 1)), F.substring(_c(name), 2, 1 << 20)))


def accessor_stem(name: Column | str, primitive_boolean: Column) -> Column:
    """a primitive boolean field isX has the stem X."""
    return F.when(primitive_boolean & F.rlike(_c(name), F.lit("^is[A-Z]")), F.substring(_c(name), 3, 1 << 20)).otherwise(_c(name))


def capitalized(name: Column | str) -> Column:
    return F.concat(F.upper(F.substring(_c(name), 1, 1)), F.substring(_c(name), 2, 1 << 20))


def append_url_path(url: Column | str, path: Column | str) -> Column:
    """the URL without a slash at its end, and the path with one before it (an empty path adds nothing)."""
    base, p = F.regexp_replace(_c(url), "/$", ""), _c(path)
    return F.when(F.coalesce(p, F.lit("")) == "", base).when(F.startswith(p, F.lit("/")), F.concat(base, p)).otherwise(F.concat(base, F.lit("/"), p))


def owner_name(qualified: Column | str) -> Column:
    """what stands before '#'."""
    return F.substring_index(_c(qualified), "#", 1)


def simple_name(qualified: Column | str) -> Column:
    """the last segment after '.' or '$'."""
    return F.element_at(F.split(_c(qualified), "[.$]"), -1)


def without_space(text: Column | str) -> Column:
    """F20."""
    return F.regexp_replace(_c(text), r"\s+", "")


def or_unknown(text: Column | str) -> Column:
    """'unknown' for null or empty."""
    return F.coalesce(F.nullif(_c(text), F.lit("")), F.lit("unknown"))


def display_path(path: Column | str) -> Column:
    """'/' for the empty path."""
    return F.when(_c(path) == "", F.lit("/")).otherwise(_c(path))


def endpoint_label(methods: Column | str, paths: Column | str) -> Column:
    """'GET|HEAD /a, /b'; 'ANY' and '/' where there is none."""
    m, p = _c(methods), F.transform(_c(paths), display_path)
    return F.concat(F.when(F.size(m) == 0, F.lit("ANY")).otherwise(F.array_join(m, "|")), F.lit(" "), F.when(F.size(p) == 0, F.lit("/")).otherwise(F.array_join(p, ", ")))


def location_label(path: Column | str, line: Column | str, column: Column | str) -> Column:
    """zero-based position as path:line:column counted from 1."""
    return F.concat_ws(":", _c(path), _c(line) + 1, _c(column) + 1)


def without_comments(text: Column | str) -> Column:
    """build scripts without block and line comments (a URL's slashes stay)."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"(?s)/\*.*?\*/", ""), r"(?m)(^|[^:])//.*$", "$1")


def quoted_values(text: Column | str) -> Column:
    """contents of single or double quotes."""
    return F.regexp_extract_all(_c(text), F.lit(r"""['"]([^'"]+)['"]"""), F.lit(1))


def project_directory(path: Column | str) -> Column:
    """a project path ':a:b' as the directory a/b."""
    return F.regexp_replace(F.regexp_replace(_c(path), "^:", ""), ":", "/")
