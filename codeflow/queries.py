"""One query for each operator over the driver's tables, with the DuckDB SQL that must give the same rows.

``TG`` is a graph over the tables: nodes R region, N nation, C customer, S supplier, O order, P part; edges R-N, N-C,
N-S, S-N (a cycle), C-O, and O-P with a confidence from the return flag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph as G
from .operators import incremental as I
from .operators import lookup as L
from .operators import project as P
from .operators import validate as V

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _long(c: str, name: str | None = None):
    return F.col(c).cast("long").alias(name or c)


# ---------------------------------------------------------------- scalar functions


@query("SELECT doc_id, 'sha256:' || sha256(text) AS version FROM documents")
def content_version(t):
    return t.documents.select("doc_id", T.content_version("text").alias("version"))


@query("SELECT page_id, 'src/' || rtrim(regexp_replace(regexp_replace(url, '^https?://', ''), '/+', '/', 'g'), '/') AS path FROM pages")
def normalize_relative_uri(t):
    odd = F.concat(F.lit("src\\./x//../"), F.regexp_replace("url", "^https?://", ""))
    return t.pages.select("page_id", T.normalize_relative_uri(odd).alias("path"))


@query("SELECT page_id, replace(replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~') AS encoded FROM pages")
def encode_component(t):
    return t.pages.select("page_id", T.encode_component("url").alias("encoded"))


@query("SELECT page_id, CASE WHEN starts_with(url, root || '/') THEN url_decode(rtrim(regexp_replace(regexp_replace(substr(url, length(root) + 2), '[?#].*$', ''), '/+', '/', 'g'), '/')) END AS path FROM (SELECT *, regexp_extract(url, '^https?://[^/]+') AS root FROM pages)")
def relative_uri_within(t):
    root = F.regexp_extract("url", "^https?://[^/]+", 0)
    return t.pages.select("page_id", T.relative_uri_within(root, "url").alias("path"))


@query("SELECT n_nationkey, '/' || r_name || '/' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_http_path(t):
    j = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", T.join_http_path(F.concat(F.lit("/"), "r_name", F.lit("/")), F.concat(F.lit("/"), "n_name")).alias("path"))


@query("SELECT p_brand, string_agg(p_type, ',' ORDER BY p_type) AS types FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand")
def unique_sorted(t):
    return t.part.groupBy("p_brand").agg(F.array_join(T.unique_sorted(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT p_partkey, p_name || '|' || p_brand AS literals FROM part")
def literal_extract(t):
    expression = F.concat(F.lit('names = {"'), "p_name", F.lit('", "'), "p_brand", F.lit('"}'))
    return t.part.select("p_partkey", F.array_join(T.string_literals(expression), "|").alias("literals"))


@query("""SELECT page_id, CAST(len(h) AS BIGINT) AS n, array_to_string(h, ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""")
def attribute_values(t):
    h = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return t.pages.select("page_id", F.size(h).cast("long").alias("n"), F.array_join(h, " ").alias("links"))


@query("SELECT event_id, '/' || event_type AS literals, json_extract_string(props, '$.k') AS k FROM events")
def named_argument(t):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    arguments = F.array(F.struct(F.lit("path").alias("name"), q(F.concat(F.lit("/"), "event_type")).alias("expression")), F.struct(F.lit("method").alias("name"), q(F.lit("x")).alias("expression")))
    return t.events.select("event_id", F.array_join(T.named_argument_literals(arguments, ["path", "value", None]), ",").alias("literals"), F.get_json_object("props", "$.k").alias("k"))


@query("SELECT p_partkey, p_type AS plain, replace(p_type, ' ', '_') || '[]' AS erased FROM part")
def plain_type_name(t):
    plain = T.plain_type_name(F.concat("p_type", F.lit("<List<"), "p_brand", F.lit(">>[]...")))
    erased = T.erased_type(F.concat(F.lit("? extends a.b."), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("<X, Y<Z>>...")))
    return t.part.select("p_partkey", plain.alias("plain"), erased.alias("erased"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS owner, CASE WHEN c_custkey % 2 = 0 THEN 'java.lang.String.x' ELSE 'Foo.x' END AS qualified, CASE WHEN c_custkey % 3 = 0 THEN 'URLReader' ELSE 'customer' END AS bean FROM customer")
def owner_names(t):
    name = F.when(F.col("c_custkey") % 2 == 0, "String.x").otherwise("Foo.x")
    bean = F.when(F.col("c_custkey") % 3 == 0, "URLReader").otherwise("Customer")
    return t.customer.select("c_custkey", T.owner_name("c_name").alias("owner"), T.qualify_known(name, ["String", "Object"]).alias("qualified"), T.default_bean_name(bean).alias("bean"))


@query("SELECT n_nationkey, 'GET|HEAD /' || n_name || ', /' AS label, n_name || ':' || CAST(n_nationkey + 1 AS VARCHAR) || ':1' AS place FROM nation")
def endpoint_labels(t):
    return t.nation.select("n_nationkey", T.endpoint_label(F.array(F.lit("GET"), F.lit("HEAD")), F.array(F.concat(F.lit("/"), "n_name"), F.lit(""))).alias("label"), T.location_label("n_name", "n_nationkey", F.lit(0)).alias("place"))


@query("SELECT doc_id FROM documents WHERE contains(text, 'tion')")
def candidate_prefilter(t):
    return t.documents.filter(F.contains("text", F.lit("tion"))).select("doc_id")


# ---------------------------------------------------------------- discovery and lookups


@query("SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]+$', '') AS module FROM pages")
def module_from_marker(t):
    return t.pages.select(F.regexp_replace(T.without_query("url"), "/[^/]+$", "").alias("module")).distinct()


_MODULES = "SELECT DISTINCT array_to_string(string_split(regexp_replace(url, '[?#].*$', ''), '/')[1:CASE WHEN page_id % 2 = 0 THEN 4 ELSE 3 END], '/') AS module FROM pages"


@query(f"WITH m AS ({_MODULES}), i AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages) SELECT page_id, u, arg_max(module, length(module)) AS module FROM i JOIN m ON u = module OR starts_with(u, module || '/') GROUP BY page_id, u")
def nearest_module(t):
    clean = t.pages.select("page_id", T.without_query("url").alias("u"))
    segments = F.split("u", "/")
    modules = clean.select(F.array_join(F.slice(segments, F.lit(1), F.when(F.col("page_id") % 2 == 0, 4).otherwise(3)), "/").alias("module")).distinct()
    return L.longest_prefix(clean, "u", modules, "module").select("page_id", "u", "module")


@query("SELECT k, name, priority FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY priority, name) AS n FROM (SELECT CAST(s_nationkey AS BIGINT) AS k, s_name AS name, CAST(1 AS BIGINT) AS priority FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT c_nationkey, c_name, 2 FROM customer)) WHERE n = 1")
def merge_priority(t):
    a = t.supplier.filter("s_acctbal > 5000").select(_long("s_nationkey", "k"), F.col("s_name").alias("name"), F.lit(1).cast("long").alias("priority"))
    b = t.customer.select(_long("c_nationkey", "k"), F.col("c_name").alias("name"), F.lit(2).cast("long").alias("priority"))
    return L.ranked_first(L.union_all([a, b]), ["k"], ["priority", "name"])


@query("SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' OR starts_with(r_name, 'E')")
def scope_filter(t):
    namespaces = F.array(F.lit("ASIA"), F.lit("E"))
    inside = F.exists(namespaces, lambda n: (n == "") | (F.col("r_name") == n) | F.startswith("r_name", n))
    return t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).filter(inside).select("n_nationkey", "n_name")


@query("SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id")
def multi_map(t):
    g = L.grouped_values(t.conversations, ["conv_id"], ["turn", "role"])
    return g.select("conv_id", F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["turn"], i["role"])), ",").alias("turns"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_write_wins(t):
    return L.last_write_wins(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_type, arg_min(event_id, event_id) AS first FROM events GROUP BY user_id, event_type")
def first_match(t):
    return L.first_match(t.events, ["user_id", "event_type"], "event_id", "event_id")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderpriority) = 1")
def unique_guard(t):
    return L.exactly_one(t.orders, ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_custkey", "o_orderpriority")


def _type_edges(t) -> DataFrame:
    words = F.split("p_type", " ")
    heads = t.part.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.struct(F.array_join(F.slice(words, F.lit(1), n), " ").alias("node"), F.array_join(F.slice(words, F.lit(1), n - 1), " ").alias("ancestor")))).alias("h")).select("h.*").filter("ancestor != ''")
    nations = t.nation.select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("R"), "n_regionkey").alias("ancestor"))
    world = t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("node"), F.lit("world").alias("ancestor"))
    return L.union_all([heads, nations, world]).distinct()


_CLOSURE = """WITH RECURSIVE h AS (SELECT DISTINCT p_type, unnest(range(2, len(string_split(p_type, ' ')) + 1)) AS k FROM part),
e AS (SELECT DISTINCT array_to_string(string_split(p_type, ' ')[1:k], ' ') AS node, array_to_string(string_split(p_type, ' ')[1:k - 1], ' ') AS ancestor FROM h
UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION SELECT 'R' || r_regionkey, 'world' FROM region),
c AS (SELECT node, ancestor FROM e UNION SELECT c.node, e.ancestor FROM c JOIN e ON c.ancestor = e.node)"""


@query(_CLOSURE + " SELECT node, ancestor FROM c")
def ancestor_closure(t):
    return L.closure(_type_edges(t), "node", "ancestor").select("node", "ancestor")


@query(_CLOSURE + " SELECT DISTINCT ancestor, s_suppkey FROM c JOIN supplier ON node = 'N' || s_nationkey")
def implementations(t):
    c = L.closure(_type_edges(t), "node", "ancestor")
    return c.join(t.supplier.select("s_suppkey", F.concat(F.lit("N"), "s_nationkey").alias("node")), "node").select("ancestor", "s_suppkey").distinct()


@query("WITH f AS (SELECT user_id, arg_min(event_type, event_id) AS kind FROM events GROUP BY user_id) SELECT user_id, coalesce(CASE kind WHEN 'purchase' THEN 'buyer' WHEN 'click' THEN 'visitor' END, 'helper') AS role FROM f")
def role_first(t):
    roles = t.spark.createDataFrame([("purchase", "buyer"), ("click", "visitor")], "kind string, role string")
    f = L.first_match(t.events, ["user_id"], "event_type", "event_id", "kind")
    return f.join(F.broadcast(roles), "kind", "left").select("user_id", F.coalesce("role", F.lit("helper")).alias("role"))


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN (l_partkey + l_suppkey) % 7 = 0 THEN 1 WHEN l_partkey % 5 = 0 AND p_partkey IS NOT NULL THEN 2 ELSE 3 END AS BIGINT) AS tier FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE (l_partkey + l_suppkey) % 7 = 0 OR l_partkey % 5 = 0 AND p_partkey IS NOT NULL OR l_suppkey % 3 = 0 AND s_suppkey IS NOT NULL")
def tiered_lookup(t):
    probe = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    exact = probe.filter((F.col("l_partkey") + F.col("l_suppkey")) % 7 == 0).select("l_partkey", "l_suppkey").distinct()
    parts = t.part.filter("p_partkey % 5 = 0").select(F.col("p_partkey").alias("l_partkey"))
    suppliers = t.supplier.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("l_suppkey"))
    found = L.tiered_lookup(probe, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [exact, parts, suppliers], [["l_partkey", "l_suppkey"], ["l_partkey"], ["l_suppkey"]])
    return found.select("l_orderkey", "l_linenumber", _long("tier"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 4 = 0 THEN p_name ELSE s_name END AS name, CAST(CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 2 END AS BIGINT) AS tier FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 8 <> 0")
def import_blocks(t):
    probe = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    blocker = t.part.filter("p_partkey % 4 = 0").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_partkey") % 8 != 0, F.col("p_name")).alias("name"))
    fallback = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"))
    found = L.blocking_lookup(probe, ["l_orderkey", "l_linenumber"], blocker, ["l_partkey"], "name", fallback, ["l_suppkey"])
    return found.select("l_orderkey", "l_linenumber", "name", _long("tier"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS declared FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def override_hiding(t):
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    own = c.filter("c_mktsegment = 'BUILDING'").select("c_custkey", F.array(F.lit(0)).alias("path"), F.col("c_name").alias("declared"))
    nation = c.filter("n_nationkey % 2 = 0").select("c_custkey", F.array(F.lit(0), F.lit(1)).alias("path"), F.col("n_name").alias("declared"))
    region = c.select("c_custkey", F.array(F.lit(0), F.lit(1), F.lit(0)).alias("path"), F.col("r_name").alias("declared"))
    return L.nearest_along(L.union_all([own, nation, region]), ["c_custkey"], "path").select("c_custkey", "declared")


@query("SELECT n_nationkey, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) THEN 'nation' ELSE 'region' END AS level, CAST(CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) THEN (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0) ELSE (SELECT count(*) FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey AND s_acctbal < 0) END AS BIGINT) AS n FROM nation n WHERE EXISTS (SELECT 1 FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey WHERE m.n_regionkey = n.n_regionkey AND s_acctbal < 0)")
def nearest_field(t):
    poor = t.supplier.filter("s_acctbal < 0").join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "n_regionkey")
    own = t.nation.select("n_nationkey").join(poor.select("n_nationkey", "s_suppkey"), "n_nationkey").withColumns({"tier": F.lit(1), "level": F.lit("nation")})
    up = t.nation.select("n_nationkey", "n_regionkey").join(poor.select("n_regionkey", "s_suppkey"), "n_regionkey").drop("n_regionkey").withColumns({"tier": F.lit(2), "level": F.lit("region")})
    return L.first_tier(L.union_all([own, up]), ["n_nationkey"]).groupBy("n_nationkey", "level").agg(F.count(F.lit(1)).alias("n"))


_RANGES = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS s, CAST(l_linenumber + floor(l_quantity / 10) AS BIGINT) AS e FROM lineitem"


@query(f"WITH r AS ({_RANGES}) SELECT o.l_orderkey, o.s AS outer_start, o.e AS outer_end, i.s AS inner_start, i.e AS inner_end FROM r o JOIN r i ON o.l_orderkey = i.l_orderkey AND i.s >= o.s AND i.e <= o.e AND NOT (i.s = o.s AND i.e = o.e)")
def interval_containment(t):
    r = t.lineitem.select("l_orderkey", _long("l_linenumber", "s"), (F.col("l_linenumber") + F.floor(F.col("l_quantity") / 10)).cast("long").alias("e"))
    return L.contained_calls(r, r, ["l_orderkey"], "s", "e")


@query("SELECT event_id, user_id, click_id FROM (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events) WHERE event_type = 'purchase'")
def asof_local(t):
    e = L.latest_before(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "event_id", "click_id")
    return e.filter("event_type = 'purchase'").select("event_id", "user_id", "click_id")


@query("SELECT n_nationkey, CASE WHEN count(s_suppkey) = 1 THEN min(s_name) ELSE n_name END AS chosen, CASE WHEN count(s_suppkey) = 1 THEN 'single implementation' WHEN count(s_suppkey) = 0 THEN 'no implementation' ELSE 'several implementations' END AS reason FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 7000 GROUP BY n_nationkey, n_name")
def implementation_select(t):
    s = t.supplier.filter("s_acctbal > 7000")
    j = t.nation.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return L.unique_or_default(j, ["n_nationkey", "n_name"], "s_name", F.col("n_name"), "chosen").select("n_nationkey", "chosen", "reason")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25) AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0)")
def semi_restrict(t):
    kept = L.semi_restrict(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), t.part.filter("p_size > 25"), ["l_partkey"], "p_partkey")
    return L.semi_restrict(kept, t.supplier.filter("s_acctbal > 0"), ["l_suppkey"], "s_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def dangling(t):
    return L.dangling(t.orders.select("o_orderkey"), "o_orderkey", t.lineitem, "l_orderkey")


@query("WITH s(seg, w) AS (VALUES ('BUILDING', 1), ('MACHINERY', 3), ('FURNITURE', 5), ('HOUSEHOLD', 5)), c AS (SELECT o_orderkey, seg, CASE WHEN w = 5 AND ascii(o_orderpriority) = 49 THEN NULL ELSE abs(ascii(o_orderpriority) - 48 - w) END AS score FROM orders, s), b AS (SELECT *, min(score) OVER (PARTITION BY o_orderkey) AS best FROM c) SELECT o_orderkey, seg, CAST(score AS BIGINT) AS score FROM b WHERE best IS NULL OR score = best")
def overload_best(t):
    s = t.spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 3), ("FURNITURE", 5), ("HOUSEHOLD", 5)], "seg string, w int")
    candidates = F.array(*(F.struct(F.lit(r["seg"]).alias("seg"), F.lit(r["w"]).alias("w")) for r in s.collect()))
    c = t.orders.select("o_orderkey", "o_orderpriority", F.explode(candidates).alias("c")).select("o_orderkey", "o_orderpriority", "c.*")
    score = F.when(~((F.col("w") == 5) & (F.ascii("o_orderpriority") == 49)), F.abs(F.ascii("o_orderpriority") - 48 - F.col("w")))
    return L.best_scores(c.withColumn("score", score.cast("long")), ["o_orderkey"], "score").select("o_orderkey", "seg", "score")


@query("SELECT o_orderkey, count(l_linenumber) AS candidates, CASE WHEN count(l_linenumber) > 1 THEN 'ambiguous' WHEN count(l_linenumber) = 1 THEN CASE WHEN o_orderstatus = 'F' THEN 'exact' ELSE 'inferred' END ELSE 'unresolved' END AS confidence FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus")
def confidence_class(t):
    g = t.orders.join(t.lineitem.select("l_orderkey", "l_linenumber"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_linenumber").alias("candidates"))
    return g.select("o_orderkey", "candidates", L.confidence_class(F.col("candidates"), F.when(F.col("o_orderstatus") == "F", "exact").otherwise("inferred")).alias("confidence"))


# ---------------------------------------------------------------- graph construction


@query("SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS n, string_agg(l_orderkey || ':' || l_linenumber, ' ' ORDER BY l_orderkey, l_linenumber) AS evidence FROM lineitem GROUP BY ALL")
def edge_aggregate(t):
    e = G.aggregate_edges(t.lineitem, ["l_suppkey", "l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber"])
    return e.select("l_suppkey", "l_partkey", "l_returnflag", F.col("occurrence_count").alias("n"), F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["l_orderkey"], x["l_linenumber"])), " ").alias("evidence"))


@query("SELECT DISTINCT source || '.' || lang AS owner, CASE WHEN source IN ('src0', 'src1') THEN 'external' WHEN lang = 'en' THEN 'ambiguous' ELSE 'unresolved' END AS role FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def fallback_nodes(t):
    missing = L.dangling(t.documents.select("doc_id", "source", "lang"), "doc_id", t.labels, "doc_id")
    role = F.when(F.col("source").isin("src0", "src1"), "external").when(F.col("lang") == "en", "ambiguous").otherwise("unresolved")
    return missing.select(F.concat_ws(".", "source", "lang").alias("owner"), role.alias("role")).distinct()


@query("SELECT p_partkey FROM part WHERE NOT (p_brand = 'Brand#11' OR starts_with(p_type, 'PROMO') OR starts_with(p_type, 'SMALL PLATED'))")
def package_exclusion(t):
    out = (F.col("p_brand") == "Brand#11") | F.startswith("p_type", F.lit("PROMO")) | F.startswith("p_type", F.lit("SMALL PLATED"))
    return t.part.filter(~out).select("p_partkey")


@query("SELECT r_regionkey, string_agg(r_name || '.' || n_name, ',' ORDER BY n_name) AS tables FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def table_product(t):
    g = t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    product = F.flatten(F.transform(F.array("r_name"), lambda s: F.transform("names", lambda n: F.concat_ws(".", s, n))))
    return g.select("r_regionkey", F.array_join(product, ",").alias("tables"))


@query("SELECT '/' || r_name || '/' || n_name AS path, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS methods FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def mapping_combine(t):
    j = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(T.join_http_path("r_name", "n_name").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("methods"))


# ---------------------------------------------------------------- aggregations


@query("SELECT f AS filter_id, count(*) AS n FROM (SELECT unnest([c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'trivial' END]) AS f FROM customer) WHERE f IS NOT NULL GROUP BY f")
def filter_counts(t):
    ids = F.array_compact(F.array("c_mktsegment", F.when(F.col("c_acctbal") < 0, "trivial")))
    return P.filter_counts(t.customer.select(ids.alias("filter_ids")), "filter_ids")


@query("SELECT n_nationkey, string_agg(c_custkey, ',' ORDER BY c_custkey) AS members, bool_or(c_custkey = 1) AS is_root FROM nation JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey")
def group_members(t):
    rows = t.nation.join(t.customer.filter("c_acctbal > 9000"), F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("root", F.col("c_custkey") == 1)
    g = P.group_members(rows, ["n_nationkey"], "c_custkey", [], root="root")
    return g.select("n_nationkey", F.array_join(F.transform("members", lambda m: m["c_custkey"].cast("string")), ",").alias("members"), "is_root")


@query("SELECT r_regionkey, r_name, count(n_nationkey) AS controllers, CAST(coalesce(sum(n), 0) AS BIGINT) AS endpoints FROM region LEFT JOIN (SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY ALL) ON n_regionkey = r_regionkey GROUP BY ALL")
def catalog_rollup(t):
    e = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).filter("n_regionkey != 2")
    e = e.select(F.col("n_regionkey").alias("app_id"), F.col("n_nationkey").alias("controller_id"), F.col("c_name").alias("label"))
    a = t.region.select(F.col("r_regionkey").alias("app_id"), F.col("r_name").alias("app_name"))
    c = P.catalog(a, t.nation.select(F.col("n_nationkey").alias("controller_id"), F.col("n_name").alias("controller_name")), e)
    return c.select(F.col("app_id").alias("r_regionkey"), F.col("app_name").alias("r_name"), F.size("controllers").cast("long").alias("controllers"), _long("endpoint_count", "endpoints"))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def p95_nearest_rank(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_extendedprice)").alias("p95"))


# ---------------------------------------------------------------- the table graph

_TG = """nodes AS (SELECT 'R' || r_regionkey AS id, 'region' AS role FROM region UNION ALL SELECT 'N' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'C' || c_custkey, 'customer' FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'O' || o_orderkey, 'order' FROM orders UNION ALL SELECT 'P' || p_partkey, 'part' FROM part),
edges AS (SELECT 'R' || n_regionkey AS source, 'N' || n_nationkey AS target, 'exact' AS confidence FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'exact' FROM customer
UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, 'exact' FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'exact' FROM supplier
UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'exact' FROM orders
UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'P' || l_partkey, CASE l_returnflag WHEN 'A' THEN 'exact' WHEN 'N' THEN 'inferred' ELSE 'ambiguous' END FROM lineitem)"""


def _id(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def table_graph(t) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, role; edges: source, target, confidence)."""
    spec = [("R", "r_regionkey", "region", t.region), ("N", "n_nationkey", "nation", t.nation), ("C", "c_custkey", "customer", t.customer), ("S", "s_suppkey", "supplier", t.supplier), ("O", "o_orderkey", "order", t.orders), ("P", "p_partkey", "part", t.part)]
    nodes = L.union_all([df.select(_id(x, c).alias("id"), F.lit(role).alias("role")) for x, c, role, df in spec])
    edge = lambda df, a, ac, b, bc: df.select(_id(a, ac).alias("source"), _id(b, bc).alias("target"), F.lit("exact").alias("confidence"))
    flag = F.when(F.col("l_returnflag") == "A", "exact").when(F.col("l_returnflag") == "N", "inferred").otherwise("ambiguous")
    uses = t.lineitem.select(_id("O", "l_orderkey").alias("source"), _id("P", "l_partkey").alias("target"), flag.alias("confidence")).distinct()
    edges = [edge(t.nation, "R", "n_regionkey", "N", "n_nationkey"), edge(t.customer, "N", "c_nationkey", "C", "c_custkey"), edge(t.supplier, "N", "s_nationkey", "S", "s_suppkey"), edge(t.supplier, "S", "s_suppkey", "N", "s_nationkey"), edge(t.orders, "C", "o_custkey", "O", "o_orderkey"), uses]
    return nodes, L.union_all(edges)


def _roots(t, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "id string")


_REACH = "WITH RECURSIVE {tg}, reached AS (SELECT id FROM nodes WHERE id = 'R0' UNION SELECT e.target FROM reached r JOIN edges e ON e.source = r.id JOIN nodes n ON n.id = e.target WHERE {where})"


@query("WITH " + _TG + " SELECT role, count(*) AS n FROM nodes GROUP BY role")
def role_histogram(t):
    return P.histogram(table_graph(t)[0], "role")


@query(_REACH.format(tg=_TG, where="true") + " SELECT id FROM reached")
def reachable(t):
    return G.reachable(*table_graph(t), _roots(t, "R0")).select("id")


@query(_REACH.format(tg=_TG, where="n.role IN ('nation', 'supplier', 'order')") + " SELECT id FROM reached")
def reachable_role_pruned(t):
    return G.reachable(*table_graph(t), _roots(t, "R0"), node_allowed=F.col("role").isin("nation", "supplier", "order")).select("id")


@query(_REACH.format(tg=_TG, where="e.confidence IN ('exact', 'inferred')") + " SELECT id FROM reached")
def reachable_confidence(t):
    return G.reachable(*table_graph(t), _roots(t, "R0"), edge_allowed=F.col("confidence").isin("exact", "inferred")).select("id")


@query(_REACH.format(tg=_TG, where="true") + " SELECT id FROM reached")
def reachable_levels(t):
    """The same set by the distributed traversal."""
    return G.reachable(*table_graph(t), _roots(t, "R0"), strategy="distributed").select("id")


@query(_REACH.format(tg=_TG, where="e.confidence = 'exact'") + " SELECT source, target, confidence FROM edges WHERE confidence = 'exact' AND source IN (SELECT id FROM reached) AND target IN (SELECT id FROM reached)")
def induced_edges(t):
    nodes, edges = table_graph(t)
    exact = F.col("confidence") == "exact"
    return G.induced(edges, G.reachable(nodes, edges, _roots(t, "R0"), edge_allowed=exact), exact).select("source", "target", "confidence")


@query("WITH RECURSIVE " + _TG + ", reached AS (SELECT id, 0 AS depth FROM nodes WHERE id = 'R0' UNION SELECT e.target, r.depth + 1 FROM reached r JOIN edges e ON e.source = r.id WHERE r.depth < 6) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM reached GROUP BY id")
def bfs_depth(t):
    return G.reachable(*table_graph(t), _roots(t, "R0")).select("id", _long("depth"))


@query("WITH RECURSIVE " + _TG + ", reached AS (SELECT id, 0 AS depth FROM nodes WHERE id = 'R1' UNION SELECT e.target, r.depth + 1 FROM reached r JOIN edges e ON e.source = r.id WHERE r.depth < 6), d AS (SELECT id, min(depth) AS depth FROM reached GROUP BY id) SELECT n.id, n.role, CAST(row_number() OVER (PARTITION BY role ORDER BY depth NULLS LAST, n.id) AS BIGINT) AS place FROM nodes n LEFT JOIN d USING (id) WHERE role IN ('region', 'nation', 'supplier')")
def method_order(t):
    nodes, edges = table_graph(t)
    depth = G.reachable(nodes, edges, _roots(t, "R1"))
    rows = nodes.filter("role in ('region', 'nation', 'supplier')").join(depth, "id", "left")
    return P.method_order(rows, ["role"], ["depth", "id"]).select("id", "role", _long("place"))


@query("WITH RECURSIVE " + _TG + ", down AS (SELECT 'N3' AS id UNION SELECT e.target FROM down d JOIN edges e ON e.source = d.id), up AS (SELECT 'N3' AS id UNION SELECT e.source FROM up u JOIN edges e ON e.target = u.id) SELECT id FROM down UNION SELECT id FROM up")
def focus(t):
    return G.focus(*table_graph(t), _roots(t, "N3"))


@query("WITH RECURSIVE " + _TG + ", app AS (SELECT id FROM nodes WHERE NOT (role = 'nation' AND id NOT IN (SELECT 'N' || n_nationkey FROM nation WHERE n_regionkey = 1))), reached AS (SELECT id FROM nodes WHERE id = 'R1' UNION SELECT e.target FROM reached r JOIN edges e ON e.source = r.id JOIN app ON app.id = e.target) SELECT id FROM reached")
def endpoint_scope(t):
    nodes, edges = table_graph(t)
    own = t.nation.filter("n_regionkey = 1").select(_id("N", "n_nationkey").alias("id"))
    scoped = L.union_all([nodes.filter("role != 'nation'"), nodes.filter("role = 'nation'").join(own, "id", "left_semi")])
    return G.reachable(scoped, edges, _roots(t, "R1")).select("id")


_VISIBLE = "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey IN (0, 1, 3) AND c_mktsegment <> 'BUILDING' AND c_acctbal >= 0"


@query(_VISIBLE)
def visibility(t):
    groups = t.nation.select("n_nationkey", F.array(F.concat(F.lit("region"), "n_regionkey")).alias("filter_ids"))
    methods = t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.array_compact(F.array("c_mktsegment", F.when(F.col("c_acctbal") < 0, "trivial"))).alias("filter_ids"))
    regions = [f"region{i}" for i in range(5)]
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "trivial"]
    _, shown = P.visible(groups, methods, "n_nationkey", regions, segments, ["region0", "region1", "region3", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"])
    return shown.select("n_nationkey", "c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e')")
def search(t):
    return P.search(t.part, "p_name", "  E ").select("p_partkey", "p_name")


@query("SELECT n_nationkey, NOT (n_regionkey = 2) AS dimmed, CAST(n_regionkey % 10 AS BIGINT) AS colour FROM nation")
def decoration(t):
    d = P.dimmed(t.nation, t.nation.filter("n_regionkey = 2"), "n_nationkey")
    return d.select("n_nationkey", "dimmed", P.colour_index(F.array(F.lit("other"), F.concat(F.lit("r"), "n_regionkey")), [f"r{i}" for i in range(5)]).cast("long").alias("colour"))


@query("WITH p AS (SELECT user_id, event_id AS i, value AS x, CAST(event_id % 7 AS DOUBLE) AS y FROM events), s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY user_id ORDER BY i)), l AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0) AS len FROM s), d AS (SELECT *, sum(len) OVER (PARTITION BY user_id ORDER BY i) AS done, sum(len) OVER (PARTITION BY user_id) AS total FROM l), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM d WHERE px IS NOT NULL AND done >= total / 2) SELECT user_id, round(px + (x - px) * CASE WHEN len > 0 THEN 1 - (done - total / 2) / len ELSE 0 END, 4) AS mid_x FROM h WHERE n = 1")
def polyline_midpoint(t):
    p = t.events.select("user_id", F.col("event_id").alias("i"), F.col("value").alias("x"), (F.col("event_id") % 7).cast("double").alias("y"))
    return P.polyline_midpoint(p, "user_id", "i", "x", "y").select("user_id", F.round("mid_x", 4).alias("mid_x"))


# ---------------------------------------------------------------- validation


@query("SELECT event_id, copy FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY copy) AS n FROM (SELECT event_id, CAST(0 AS BIGINT) AS copy FROM events UNION ALL SELECT event_id, 1 FROM events WHERE event_id % 50 = 0)) WHERE n > 1")
def validate_duplicates(t):
    e = t.events.select("event_id", F.lit(0).cast("long").alias("copy"))
    return V.repeated(e.union(t.events.filter("event_id % 50 = 0").select("event_id", F.lit(1).cast("long"))), "event_id", "copy")


@query("WITH g AS (SELECT l_suppkey, l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_partkey, l_returnflag, l_partkey % 97 = 0 AS bad_count, CASE WHEN l_returnflag = 'R' THEN n < 2 ELSE n <> 1 END AS bad_candidates FROM g WHERE l_partkey % 97 = 0 OR CASE WHEN l_returnflag = 'R' THEN n < 2 ELSE n <> 1 END")
def validate_counts(t):
    e = G.aggregate_edges(t.lineitem, ["l_suppkey", "l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber"])
    e = e.withColumn("occurrence_count", F.col("occurrence_count") + F.when(F.col("l_partkey") % 97 == 0, 1).otherwise(0))
    confidence = F.when(F.col("l_returnflag") == "R", "ambiguous").when(F.col("l_returnflag") == "A", "exact").otherwise("inferred")
    e = e.withColumns({"bad_count": V.count_mismatch("occurrence_count", "evidence"), "bad_candidates": V.candidate_mismatch(confidence, F.size("evidence"))})
    return e.filter("bad_count or bad_candidates").select("l_suppkey", "l_partkey", "l_returnflag", "bad_count", "bad_candidates")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < l_linenumber * 3 OR l_returnflag = 'R' AND l_linenumber = 1")
def validate_order(t):
    position = lambda a, b: F.struct(a.cast("int").alias("line"), b.cast("int").alias("column"))
    loc = F.struct(F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "").otherwise("u").alias("uri"), position(F.col("l_linenumber") * 3, F.lit(0)).alias("start"), position(F.floor("l_quantity"), F.lit(0)).alias("end"))
    return t.lineitem.withColumn("loc", loc).filter(V.invalid_range("loc")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5 WHERE (l_returnflag = 'R') IS DISTINCT FROM (p_brand = 'Brand#11')")
def validate_unresolved(t):
    ends = t.part.filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_brand") == "Brand#11").alias("unresolved"))
    j = t.lineitem.join(ends, "l_partkey", "left")
    return j.filter(~(F.col("l_returnflag") == "R").eqNullSafe(F.col("unresolved"))).select("l_orderkey", "l_linenumber")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS opened, CAST(len(regexp_extract_all(html, '</p>')) AS BIGINT) AS closed FROM pages WHERE len(regexp_extract_all(html, '<p>')) <> len(regexp_extract_all(html, '</p>'))")
def text_diagnostics(t):
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<p>")).cast("long").alias("opened"), F.regexp_count("html", F.lit("</p>")).cast("long").alias("closed")).filter("opened != closed")


# ---------------------------------------------------------------- incremental operators


def _versions(t) -> tuple[DataFrame, DataFrame]:
    before = t.documents.filter("doc_id % 10 != 0").select("doc_id", T.content_version("text").alias("version"))
    now = t.documents.filter("doc_id % 7 != 0").select("doc_id", T.content_version(F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("version"))
    return before, now


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'delete' WHEN doc_id % 10 = 0 OR doc_id % 11 = 0 THEN 'index' ELSE 'reuse' END AS action FROM documents WHERE doc_id % 10 <> 0 OR doc_id % 7 <> 0")
def incremental_plan(t):
    return I.plan(*_versions(t), "doc_id", "version")


@query("SELECT doc_id, 'reuse' AS action FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 UNION ALL SELECT doc_id, 'index' FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 10 = 0 OR doc_id % 11 = 0)")
def fact_reuse(t):
    kept, new = I.split_reuse(*_versions(t), ["doc_id", "version"])
    return kept.select("doc_id", F.lit("reuse").alias("action")).union(new.select("doc_id", F.lit("index").alias("action")))


@query("SELECT user_id, count(*) AS n, CAST(min(event_id) AS BIGINT) AS least FROM (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 24 HOUR AS apart FROM events)) GROUP BY user_id, burst")
def debounce_sessions(t):
    marked = t.events.groupBy("user_id", F.session_window("ts", "24 hours")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"))
    return marked.select("user_id", "n", "least")


@query("SELECT user_id, count(*) AS bursts, CAST(max(n) AS BIGINT) AS longest FROM (SELECT user_id, burst, count(*) AS n FROM (SELECT *, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 48 HOUR AS apart FROM events)) GROUP BY user_id, burst) GROUP BY user_id")
def debounce(t):
    return I.debounce(t.events, ["user_id"], "ts", 48 * 3600).groupBy("user_id").agg(F.count(F.lit(1)).alias("bursts"), F.max("n").alias("longest"))


@query("SELECT user_id, event_type = 'error' AS deleted FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def change_set(t):
    return I.change_set(t.events.withColumn("deleted", F.col("event_type") == "error"), "user_id", ["ts", "event_id"], "deleted")


@query("SELECT doc_id FROM documents WHERE (doc_id % 10 <> 0 AND doc_id % 3 <> 0) OR doc_id % 21 = 0")
def updated_keys(t):
    d = t.documents.select("doc_id")
    return I.updated_keys(d.filter("doc_id % 10 != 0"), d.filter("doc_id % 3 = 0"), d.filter("doc_id % 21 = 0"), "doc_id")


@query("SELECT DISTINCT event_type, user_id, floor(value) AS v FROM events")
def diagnostic_dedupe(t):
    d = t.events.select("event_type", "user_id", F.floor("value").cast("double").alias("v"))
    return I.merge_diagnostics(d, d.limit(0), ["event_type", "user_id", "v"])


# ---------------------------------------------------------------- Java sources made of table rows


def _java(t):
    from .plans import synthetic, workspace
    from .plans.discovery import Request

    return workspace.analyze(synthetic.of_tables(t.nation, t.region, t.supplier), Request(synthetic.ROOT))


_P = "'com.acme."
_N, _S, _R, _D = f"{_P}Nation' || n_nationkey", f"{_P}Supplier' || s_suppkey", f"{_P}Region' || r_regionkey", f"{_P}Dto' || r_regionkey"
_PLACED = "supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey"


def _listed(source: str, rows: list[tuple], names: list[str]) -> str:
    """SQL of a table of so many rows for each row of the source."""
    return " UNION ALL ".join("SELECT " + ", ".join(f"{v} AS {n}" for v, n in zip(row, names, strict=True)) + f" FROM {source}" for row in rows)


def _members(source: str, q: str, rows: list[tuple[str, str, str, str]]) -> str:
    return _listed(source, [(f"{q} || '{sign}'" if sign else f"'type:' || {q}", f"'{kind}'", type_, f"'{by}'" if by else "NULL") for sign, kind, type_, by in rows], ["signature", "kind", "declared_type", "generated_by"])


@query(" UNION ALL ".join([
    _members("(SELECT 1)", f"{_P}App'", [("", "type", "NULL", ""), ("#constructor()", "constructor", f"{_P}App'", "")]),
    _members("region", _R, [("", "type", "NULL", ""), ("#method:label(int):String", "method", "'String'", "")]),
    _members("region", _D, [
        ("", "type", "NULL", ""), ("#constructor(int,boolean)", "constructor", _D, "lombok"), ("#method:getId():int", "method", "'int'", "lombok"), ("#method:setId(int):void", "method", "'void'", "lombok"),
        ("#method:isOpen():boolean", "method", "'boolean'", "lombok"),
    ]),
    f"SELECT {_D} || '#method:builder():' || {_D} || '.Dto' || r_regionkey || 'Builder', 'method', {_D} || '.Dto' || r_regionkey || 'Builder', 'lombok' FROM region",
    f"SELECT 'type:' || {_D} || '.Dto' || r_regionkey || 'Builder', 'type', NULL, 'lombok' FROM region",
    " UNION ALL ".join(f"SELECT {_D} || '.Dto' || r_regionkey || 'Builder#method:{n}({x}):' || {_D} || '.Dto' || r_regionkey || 'Builder', 'method', {_D} || '.Dto' || r_regionkey || 'Builder', 'lombok' FROM region" for n, x in (("id", "int"), ("isOpen", "boolean"))),
    f"SELECT {_D} || '.Dto' || r_regionkey || 'Builder#method:build():' || {_D}, 'method', {_D}, 'lombok' FROM region",
    _members("nation", _N, [
        ("", "type", "NULL", ""), ("#constructor()", "constructor", _N, ""), ("#method:label(int):String", "method", "'String'", ""), ("#method:note(String):void", "method", "'void'", ""), ("#method:note(Object):void", "method", "'void'", ""),
    ]),
    _members("supplier", _S, [("", "type", "NULL", ""), ("#constructor()", "constructor", _S, ""), ("#method:show(int):String", "method", "'String'", ""), ("#method:save(String):void", "method", "'void'", "")]),
]))
def java_symbols(t):
    """Types, methods and constructors, declared, implicit and generated."""
    from .javafacts import extract as X

    s = X.symbols(_java(t).facts).filter("kind in ('type', 'method', 'constructor')")
    return s.select(F.col("symbol.signature").alias("signature"), "kind", "declared_type", "generated_by")


@query(
    f"SELECT {_S} AS controller, 'show' AS handler, 'GET' AS methods, '/s' || s_suppkey || '/show' AS paths FROM supplier"
    f" UNION ALL SELECT {_S}, 'save', 'POST', '/s' || s_suppkey || '/a,/s' || s_suppkey || '/b' FROM supplier"
)
def java_endpoints(t):
    """Endpoints with the paths of class and method combined."""
    a = _java(t)
    name = a.index.nodes.select(F.col("id").alias("handler_symbol_id"), F.substring_index("symbol.qualified_name", "#", 1).alias("controller"), F.col("symbol.name").alias("handler"))
    e = a.index.endpoints.select("handler_symbol_id", F.array_join("http_methods", "|").alias("methods"), F.array_join("paths", ",").alias("paths"))
    return e.join(name, "handler_symbol_id").drop("handler_symbol_id")


#: What each supplier calls: (caller, callee, confidence, calls). A field's type is inferred, a call of the own type and of a
#: constructor exact; the argument of note() is the String that the nested call returns; Other is not indexed.
_CALLS = [
    (f"{_S} || '#method:show(int):String'", f"{_N} || '#method:label(int):String'", "'inferred'", "1"), (f"{_S} || '#method:save(String):void'", f"{_N} || '#method:note(String):void'", "'inferred'", "2"),
    (f"{_S} || '#method:save(String):void'", f"{_R} || '#method:label(int):String'", "'inferred'", "1"), (f"{_S} || '#method:save(String):void'", f"{_S} || '#method:show(int):String'", "'exact'", "1"),
    (f"{_S} || '#method:save(String):void'", "'Other#method:go():'", "'inferred'", "1"), (f"{_S} || '#method:save(String):void'", f"{_N} || '#constructor()'", "'exact'", "1"),
]


@query(_listed(_PLACED, [(a, b, c, f"CAST({n} AS BIGINT)") for a, b, c, n in _CALLS], ["caller", "callee", "confidence", "occurrence_count"]))
def java_call_edges(t):
    """Calls resolved over fields, interfaces, nested calls, overloads, own methods, constructors and unknown types."""
    index = _java(t).index
    name = index.nodes.select("id", F.col("symbol.signature").alias("name"))
    e = index.edges.join(name.withColumnsRenamed({"id": "source", "name": "caller"}), "source").join(name.withColumnsRenamed({"id": "target", "name": "callee"}), "target")
    return e.select("caller", "callee", "confidence", _long("occurrence_count"))


@query(
    "WITH n AS (SELECT count(*) AS n FROM nation), r AS (SELECT count(*) AS n FROM region), s AS (SELECT count(*) AS n FROM supplier) SELECT role, kind, trivial, CAST(n AS BIGINT) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{role}' AS role, '{kind}' AS kind, {trivial} AS trivial, {n} AS n" for role, kind, trivial, n in [
        ("helper", "type", "false", "1 + 3 * (SELECT n FROM r)"), ("helper", "constructor", "true", "1 + (SELECT n FROM r)"), ("helper", "method", "false", "(SELECT n FROM r)"), ("helper", "method", "true", "7 * (SELECT n FROM r)"),
        ("service", "type", "false", "(SELECT n FROM n)"), ("service", "constructor", "true", "(SELECT n FROM n)"), ("service", "method", "false", "3 * (SELECT n FROM n)"),
        ("controller", "type", "false", "(SELECT n FROM s)"), ("controller", "constructor", "true", "(SELECT n FROM s)"), ("controller", "method", "false", "2 * (SELECT n FROM s)"),
        ("ambiguous", "type", "false", "1"), ("ambiguous", "method", "false", "1"),
    ]) + ")"
)
def java_nodes(t):
    """Nodes by role, kind and signal, stand-ins included."""
    n = _java(t).index.nodes
    return n.groupBy("role", F.col("metadata.symbol_kind").alias("kind"), F.array_contains("filter_ids", "trivial").alias("trivial")).agg(F.count(F.lit(1)).alias("n"))


_FIRST = f"(SELECT * FROM {_PLACED} ORDER BY s_suppkey LIMIT 1)"


@query(_listed(_FIRST, [
    (f"{_S} || '#method:save(String):void'", "CAST(0 AS BIGINT)"), (f"{_N} || '#method:note(String):void'", "CAST(1 AS BIGINT)"), (f"{_R} || '#method:label(int):String'", "CAST(1 AS BIGINT)"), (f"{_S} || '#method:show(int):String'", "CAST(1 AS BIGINT)"),
    ("'Other#method:go():'", "CAST(1 AS BIGINT)"), (f"{_N} || '#constructor()'", "CAST(1 AS BIGINT)"), (f"{_N} || '#method:label(int):String'", "CAST(2 AS BIGINT)"),
], ["name", "depth"]))
def java_endpoint_graph(t):
    """Nodes below one endpoint (save of the first supplier), with their depth."""
    from .plans import workspace

    index = _java(t).index
    first = t.supplier.agg(F.min("s_suppkey")).first()[0]
    at = index.nodes.filter(F.col("symbol.qualified_name") == f"com.acme.Supplier{first}#save").select(F.col("id").alias("handler_symbol_id"))
    nodes, _ = workspace.endpoint_graph(index, index.endpoints.join(at, "handler_symbol_id").first()["id"])
    return nodes.select(F.col("symbol.signature").alias("name"), _long("depth"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reached from one region over the table graph, with their depth."""
    t = Tables(spark, sf_dir)
    nodes, edges = table_graph(t)
    return nodes.join(G.reachable(nodes, edges, _roots(t, "R0")), "id").select("id", "role", _long("depth"))
