"""Facts of a files DataFrame in one pass without a shuffle."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import content_version
from .lombok import generate
from .parser import FileParser

POSITION = "struct<line:int,column:int>"
LOC = f"struct<uri:string,start:{POSITION},end:{POSITION}>"
ANNOTATION = f"struct<name:string,arguments:array<struct<name:string,expression:string,loc:{LOC}>>,loc:{LOC}>"
IMPORT = f"struct<qualified_name:string,is_static:boolean,is_wildcard:boolean,loc:{LOC}>"
SYMBOL = f"""struct<id:string,kind:string,owner_symbol_id:string,symbol:struct<name:string,qualified_name:string,signature:string>,declared_type:string,modifiers:array<string>,loc:{LOC},
annotations:array<{ANNOTATION}>,declaration_kind:string,super_types:array<string>,method_behavior:string,param_index:int,implicit:boolean,generated_by:string>""".replace("\n", "")
INVOCATION = f"""struct<enclosing_symbol_id:string,kind:string,expression:string,member_name:string,receiver_expression:string,receiver_type:string,receiver_member_path:array<string>,
receiver_root_expression:string,argument_count:int,argument_expressions:array<string>,argument_types:array<string>,loc:{LOC}>""".replace("\n", "")
DIAGNOSTIC = f"struct<code:string,severity:string,message:string,loc:{LOC}>"
FACTS = f"application_id string, uri string, relative_uri string, content_version string, namespace_name string, imports array<{IMPORT}>, symbols array<{SYMBOL}>, invocations array<{INVOCATION}>, diagnostics array<{DIAGNOSTIC}>"

#: Files of one Arrow batch on the way back.
BATCH = 64


def facts_of(application: str, uri: str, relative: str, source: str) -> dict:
    """Facts of one file, however deep its expressions are nested; a file that breaks the parser gives one diagnostic and no
    facts."""
    limit = sys.getrecursionlimit()
    try:
        parser = FileParser(application, uri, relative, source)
        try:
            out = parser.parse()
        except RecursionError:  # frames of Python functions are on the heap: as many as the source can nest
            sys.setrecursionlimit(limit + 20 * len(source))
            parser = FileParser(application, uri, relative, source)
            out = parser.parse()
        generate(parser)
        out["symbols"] = sorted(parser.symbols, key=lambda s: (s["loc"]["start"]["line"], s["loc"]["start"]["column"], s["id"]))
        for s in out["symbols"]:
            s.pop("_given", None)
            s.pop("_body", None)
        return out
    except (RecursionError, IndexError, KeyError, ValueError) as e:
        zero = {"line": 0, "column": 0}
        fault = {"code": "java.parseFailed", "severity": "error", "message": f"{relative}: {type(e).__name__}", "loc": {"uri": uri, "start": zero, "end": zero}}
        return {"namespace_name": None, "imports": [], "symbols": [], "invocations": [], "diagnostics": [fault]}
    finally:
        sys.setrecursionlimit(limit)


def extract(files: DataFrame) -> DataFrame:
    """file_facts of files (application_id, uri, relative_uri, content)."""
    schema = StructType.fromDDL(FACTS)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                rows = [
                    {"application_id": r["application_id"], "uri": r["uri"], "relative_uri": r["relative_uri"], "content_version": r["content_version"], **facts_of(r["application_id"] or "", r["uri"], r["relative_uri"], r["content"] or "")}
                    for r in batch.slice(a, BATCH).to_pylist()
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("application_id", "uri", "relative_uri", content_version("content").alias("content_version"), "content").mapInArrow(run, schema)


def symbols(facts: DataFrame) -> DataFrame:
    """A row for each symbol."""
    return facts.select("application_id", "uri", "relative_uri", "namespace_name", F.posexplode("symbols").alias("ord", "s")).select("application_id", "uri", "relative_uri", "namespace_name", "ord", "s.*")


def invocations(facts: DataFrame) -> DataFrame:
    return facts.select("application_id", "uri", F.posexplode("invocations").alias("ord", "s")).select("application_id", "uri", "ord", "s.*")


def imports(facts: DataFrame) -> DataFrame:
    return facts.select("application_id", "uri", F.posexplode("imports").alias("ord", "s")).select("application_id", "uri", "ord", "s.*")


def diagnostics(facts: DataFrame) -> DataFrame:
    return facts.select("application_id", F.explode("diagnostics").alias("d")).select("application_id", "d.*")


def shape() -> Column:
    """A digest of what other files can see of a file: namespace, imports and symbols without their places. While the shapes
    of an application's files stay as they are, calls in the other files keep their targets."""
    imports_ = F.transform("imports", lambda i: F.struct(i["qualified_name"], i["is_static"], i["is_wildcard"]))
    note = lambda a: F.struct(a["name"], F.transform(a["arguments"], lambda x: F.struct(x["name"], x["expression"])))
    plain = ("id", "kind", "owner_symbol_id", "symbol", "declared_type", "modifiers", "declaration_kind", "super_types", "param_index")
    symbols_ = F.transform("symbols", lambda s: F.struct(*(s[c].alias(c) for c in plain), F.transform(s["annotations"], note).alias("notes")))
    return F.sha2(F.to_json(F.struct("namespace_name", imports_.alias("imports"), symbols_.alias("symbols"))), 256)
