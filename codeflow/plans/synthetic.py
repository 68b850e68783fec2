"""Synthetic workspaces for benchmarks and checks: a chain of services that call each other, and classes made of table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "file:///bench"
_DIR = f"{ROOT}/src/main/java/com/acme"


def chain(spark: SparkSession, n: int, fan: int = 1) -> DataFrame:
    """files (uri, content): an application, a controller and n - 2 services; ``fan``: how many next services each calls.
    The files are made on the executors."""
    app = ("package com.acme;\nimport org.springframework.boot.autoconfigure.SpringBootApplication;\n@SpringBootApplication\npublic class App {}\n")
    web = "package com.acme;\nimport org.springframework.web.bind.annotation.*;\n@RestController\npublic class Web {\n  private final Service0 next;\n  public Web(Service0 next) { this.next = next; }\n  @GetMapping(\"/run\")\n  public void run() { next.call0(); }\n}\n"
    last = n - 3
    i = F.col("id")
    fields, calls = F.lit(""), F.lit("")
    for k in range(1, fan + 1):
        has = i + k <= last
        name = (i + k).cast("string")
        fields = F.concat(fields, F.when(has, F.concat(F.lit("  private Service"), name, F.lit(f" next{k};\n"))).otherwise(""))
        calls = F.concat(calls, F.when(has, F.concat(F.lit(f" next{k}.call"), name, F.lit("();"))).otherwise(""))
    s = i.cast("string")
    text = F.concat(F.lit("package com.acme;\nimport org.springframework.stereotype.Service;\n@Service\npublic class Service"), s, F.lit(" {\n"), fields, F.lit("  public void call"), s, F.lit("() {"), calls, F.lit(" }\n}\n"))
    services = spark.range(0, max(0, n - 2)).select(F.concat(F.lit(f"{_DIR}/Service"), s, F.lit(".java")).alias("uri"), text.alias("content"))
    fixed = spark.createDataFrame([(f"{ROOT}/pom.xml", "<project/>"), (f"{_DIR}/App.java", app), (f"{_DIR}/Web.java", web)], "uri string, content string")
    return fixed.union(services)


_TABLE_APP = "package com.acme;\nimport org.springframework.boot.autoconfigure.SpringBootApplication;\n@SpringBootApplication\npublic class App {}\n"
_REGION = "package com.acme;\npublic interface Region%d {\n  String label(int n);\n}\n"
_DTO = "package com.acme;\nimport lombok.*;\n@Data\n@Builder\npublic class Dto%d {\n  private int id;\n  private final boolean isOpen = true;\n}\n"
_NATION = """package com.acme;
import org.springframework.stereotype.Service;
@Service
public class Nation%d extends Missing implements Region%d {
  public String label(int n) { return "x" + n; }
  public void note(String text) { }
  public void note(Object any) { }
}
"""
_SUPPLIER = """package com.acme;
import org.springframework.web.bind.annotation.*;
@RestController
@RequestMapping("/s%d")
public class Supplier%d {
  private final Nation%d nation;
  private Region%d region;
  @GetMapping("/show")
  public String show(int k) { return nation.label(k); }
  @PostMapping({"/b", "/a"})
  public void save(String text) {
    nation.note(text);
    nation.note(region.label(2));
    show(1);
    Other.go();
    new Nation%d();
  }
}
"""


def of_tables(nation: DataFrame, region: DataFrame, supplier: DataFrame) -> DataFrame:
    """files (uri, content): an interface and a data class for each region, a service for each nation, a controller for each
    supplier."""
    spark = nation.sparkSession
    made = lambda df, name, text, *keys: df.select(F.format_string(f"{_DIR}/{name}%d.java", F.col(keys[0])).alias("uri"), F.format_string(text, *map(F.col, keys)).alias("content"))
    places = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # as many nations as there are
    out = spark.createDataFrame([(f"{ROOT}/pom.xml", "<project/>"), (f"{_DIR}/App.java", _TABLE_APP)], "uri string, content string")
    for more in (
        made(region, "Region", _REGION, "r_regionkey"), made(region, "Dto", _DTO, "r_regionkey"), made(nation, "Nation", _NATION, "n_nationkey", "n_regionkey"),
        made(places, "Supplier", _SUPPLIER, "s_suppkey", "s_suppkey", "n_nationkey", "n_regionkey", "n_nationkey"),
    ):
        out = out.union(more)
    return out
