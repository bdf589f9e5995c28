"""Queries over the provided tables, most of them asked in SPARQL, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import labels as L
from quadrille.functions import terms as Q
from quadrille.operators import search as S
from quadrille.operators.filters import Criteria, QuadFilter, filter_quads, match
from quadrille.operators.store import Context, Patch, QuadStore, apply_patch, cancel
from quadrille.shared import cut, fresh_path
from quadrille.sources import rdf
from quadrille.sources.tables import write_quads
from quadrille.sources.virtual import StoredGraph, TableMap, VirtualGraph
from quadrille.sparql.engine import SparqlEngine
from quadrille.streaming.ingest import ingest, read_stream

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id"}
LINKS = {"nation": {"n_regionkey": "region"}, "customer": {"c_nationkey": "nation"}, "supplier": {"s_nationkey": "nation"}, "orders": {"o_custkey": "customer"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "events": {"user_id": "user"}}
PREFIXES = f"PREFIX c: <urn:col:> PREFIX k: <urn:class:> PREFIX xsd: <{Q.XSD}> "
QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_map(spark: SparkSession, sf_dir: str, name: str, graph: str | None = None) -> TableMap:
    """A table's mapping. lineitem has no key; a hash of the whole row names its rows."""
    t = table(spark, sf_dir, name)
    key = KEYS.get(name) or F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in t.columns]))
    columns = [c for c in t.columns if c != KEYS.get(name) and c != graph]
    return TableMap(name, t, key, columns, LINKS.get(name, {}), {"text": "lang"} if name == "documents" else {}, graph)


def graph(spark: SparkSession, sf_dir: str, *names: str, by: dict[str, str] | None = None) -> VirtualGraph:
    return VirtualGraph([table_map(spark, sf_dir, n, (by or {}).get(n)) for n in names])


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def sparql(name: str, tables: str, text: str, sql: str, numbers: tuple[str, ...] = (), integers: tuple[str, ...] = (), by: dict[str, str] | None = None) -> None:
    """Register a SELECT over tables; numbers come as doubles, integers as bigint."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = SparqlEngine(spark, graph(spark, sf_dir, *tables.split(), by=by)).query(PREFIXES + text)
        df = r.values(numbers, integers)
        return df.withColumns({c: F.col(c).cast("bigint") for c in integers}) if integers else df


# Basic graph patterns
sparql(
    "bgp_multi_hop", "customer nation region",
    "SELECT ?customer ?nation ?region { ?x c:c_name ?customer ; c:c_nationkey ?n . ?n c:n_name ?nation ; c:n_regionkey ?r . ?r c:r_name ?region }",
    "SELECT c_name AS customer, n_name AS nation, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
sparql(
    "optional_left_join", "nation supplier",
    "SELECT ?nation ?supplier { ?n c:n_name ?nation OPTIONAL { ?s c:s_nationkey ?n ; c:s_name ?supplier ; c:s_acctbal ?b FILTER(?b > 5000) } }",
    "SELECT n_name AS nation, s_name AS supplier FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000",
)
sparql("union_bag", "customer supplier", "SELECT ?nation { { ?x c:c_nationkey ?nation } UNION { ?x c:s_nationkey ?nation } }", "SELECT 'urn:nation:' || c_nationkey AS nation FROM customer UNION ALL SELECT 'urn:nation:' || s_nationkey FROM supplier")
sparql(
    "minus", "customer orders",
    "SELECT ?name { ?x c:c_name ?name MINUS { ?o c:o_custkey ?x ; c:o_orderpriority '1-URGENT' ; c:o_orderstatus 'F' } }",
    "SELECT c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')",
)
sparql("not_exists", "customer orders", "SELECT ?name { ?x c:c_name ?name FILTER NOT EXISTS { ?o c:o_custkey ?x ; c:o_orderstatus 'F' } }", "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
sparql(
    "exists", "customer orders",
    "SELECT ?name { ?x c:c_name ?name ; c:c_acctbal ?b FILTER EXISTS { ?o c:o_custkey ?x ; c:o_totalprice ?t FILTER(?t > 30 * ?b) } }",
    "SELECT c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 30 * c_acctbal)",
)
sparql(
    "exists_in_expression", "customer orders",
    "SELECT ?name { ?x c:c_name ?name ; c:c_acctbal ?b FILTER(?b > 9000 || EXISTS { ?o c:o_custkey ?x ; c:o_orderstatus 'P' }) }",
    "SELECT c_name AS name FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
sparql("filter_contains_lcase", "documents", "SELECT ?d { ?d c:text ?t FILTER(CONTAINS(LCASE(?t), 'license')) }", "SELECT 'urn:documents:' || doc_id AS d FROM documents WHERE contains(lower(text), 'license')")
sparql("lang_filter", "documents", "SELECT ?d ?lang { ?d c:text ?t BIND(LANG(?t) AS ?lang) FILTER(LANGMATCHES(LANG(?t), 'es') || LANG(?t) = 'fr') }", "SELECT 'urn:documents:' || doc_id AS d, lang FROM documents WHERE lang IN ('es', 'fr')")
sparql("graph_named", "documents", "SELECT ?d ?n { GRAPH <urn:graph:src3> { ?d c:n_chars ?n } }", "SELECT 'urn:documents:' || doc_id AS d, n_chars AS n FROM documents WHERE source = 'src3'", integers=("n",), by={"documents": "source"})
sparql("graph_variable_count", "documents", "SELECT ?g (COUNT(*) AS ?n) { GRAPH ?g { ?d c:n_chars ?x } } GROUP BY ?g", "SELECT 'urn:graph:' || source AS g, count(*) AS n FROM documents GROUP BY source", integers=("n",), by={"documents": "source"})
sparql(
    "cross_graph_join", "documents",
    "SELECT ?a ?b { GRAPH <urn:graph:src1> { ?a c:n_chars ?n } GRAPH <urn:graph:src2> { ?b c:n_chars ?n } }",
    "SELECT 'urn:documents:' || a.doc_id AS a, 'urn:documents:' || b.doc_id AS b FROM documents a JOIN documents b USING (n_chars) WHERE a.source = 'src1' AND b.source = 'src2'",
    by={"documents": "source"},
)
# Aggregates and modifiers
sparql("group_count", "customer", "SELECT ?segment (COUNT(?x) AS ?n) { ?x c:c_mktsegment ?segment } GROUP BY ?segment", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1", integers=("n",))
sparql(
    "group_sum_avg_having", "lineitem",
    "SELECT ?flag ?status (SUM(?q) AS ?quantity) (COUNT(*) AS ?n) (MIN(?d) AS ?low) (MAX(?d) AS ?high) { ?l c:l_returnflag ?flag ; c:l_linestatus ?status ; c:l_quantity ?q ; c:l_discount ?d ; c:l_shipdate ?s FILTER(?s <= '1998-09-02T00:00:00'^^xsd:dateTime) } GROUP BY ?flag ?status HAVING(COUNT(*) > 10 && AVG(?q) > 1)",
    "SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS quantity, count(*) AS n, min(l_discount) AS low, max(l_discount) AS high FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 HAVING count(*) > 10 AND avg(l_quantity) > 1",
    numbers=("quantity", "low", "high"), integers=("n",),
)
sparql("count_distinct", "orders", "SELECT (COUNT(DISTINCT ?c) AS ?customers) (COUNT(*) AS ?n) (SAMPLE(?st) AS ?any) { ?o c:o_custkey ?c ; c:o_orderstatus ?st }", "SELECT count(DISTINCT o_custkey) AS customers, count(*) AS n, min(o_orderstatus) AS any FROM orders", integers=("customers", "n"))
sparql("group_concat", "nation region", "SELECT ?region (GROUP_CONCAT(?n; SEPARATOR='|') AS ?nations) { ?x c:n_regionkey ?r ; c:n_name ?n . ?r c:r_name ?region } GROUP BY ?region", "SELECT r_name AS region, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
sparql("distinct", "part", "SELECT DISTINCT ?brand ?type { ?p c:p_brand ?brand ; c:p_type ?type }", "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
sparql("order_limit_offset", "customer", "SELECT ?name ?b { ?x c:c_name ?name ; c:c_acctbal ?b } ORDER BY DESC(?b) ?name LIMIT 20 OFFSET 5", "SELECT c_name AS name, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c_name LIMIT 20 OFFSET 5", numbers=("b",))
sparql("values_join", "customer nation", "SELECT ?name ?n { VALUES (?n ?want) { ('NATION_1' 'a') ('NATION_7' UNDEF) ('NATION_12' 'b') } ?x c:n_name ?n . ?y c:c_nationkey ?x ; c:c_name ?name }", "SELECT c_name AS name, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_7', 'NATION_12')")
sparql(
    "subselect_topk_join", "customer orders",
    "SELECT ?name ?o { { SELECT ?x ?b { ?x c:c_acctbal ?b } ORDER BY DESC(?b) ?x LIMIT 50 } ?x c:c_name ?name . ?o c:o_custkey ?x }",
    "SELECT c_name AS name, 'urn:orders:' || o_orderkey AS o FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, 'urn:customer:' || c_custkey LIMIT 50) JOIN orders ON o_custkey = c_custkey",
)
# Expressions
sparql(
    "string_functions", "part",
    "SELECT ?p (UCASE(SUBSTR(?n, 1, 4)) AS ?a) (STRLEN(?n) AS ?b) (CONCAT(STRBEFORE(?t, ' '), '/', STRAFTER(?t, ' ')) AS ?c) (REPLACE(?brand, '[0-9]', '#') AS ?d) (ENCODE_FOR_URI(?t) AS ?e) (MD5(?n) AS ?f) { ?p c:p_name ?n ; c:p_type ?t ; c:p_brand ?brand FILTER(REGEX(?t, '^[a-m]', 'i') && STRSTARTS(?brand, 'B')) }",
    "SELECT 'urn:part:' || p_partkey AS p, upper(substr(p_name, 1, 4)) AS a, length(p_name) AS b, CASE WHEN contains(p_type, ' ') THEN split_part(p_type, ' ', 1) ELSE '' END || '/' || CASE WHEN contains(p_type, ' ') THEN substr(p_type, position(' ' IN p_type) + 1) ELSE '' END AS c, regexp_replace(p_brand, '[0-9]', '#', 'g') AS d, replace(p_type, ' ', '%20') AS e, md5(p_name) AS f FROM part WHERE regexp_matches(p_type, '^[a-m]', 'i') AND starts_with(p_brand, 'B')",
    integers=("b",),
)
sparql(
    "numeric_functions", "part",
    "SELECT ?p (?r * 2 + ?s AS ?a) (FLOOR(?r) AS ?b) (CEIL(?r) AS ?c) (ROUND(-?r / 3) AS ?d) (IF(?s > 25, 'big', 'small') AS ?e) (ABS(?s - 25) AS ?f) { ?p c:p_retailprice ?r ; c:p_size ?s }",
    "SELECT 'urn:part:' || p_partkey AS p, p_retailprice * 2 + p_size AS a, floor(p_retailprice) AS b, ceil(p_retailprice) AS c, floor(-p_retailprice / 3 + 0.5) AS d, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS e, abs(p_size - 25)::BIGINT AS f FROM part",
    numbers=("a", "b", "c", "d"), integers=("f",),
)
sparql(
    "date_functions", "orders",
    "SELECT ?y ?m (COUNT(*) AS ?n) { ?o c:o_orderdate ?d BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) } GROUP BY ?y ?m",
    "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    integers=("y", "m", "n"),
)
sparql(
    "bind_coalesce_in", "customer nation",
    "SELECT ?name ?label { ?x c:c_name ?name ; c:c_mktsegment ?s OPTIONAL { ?x c:c_acctbal ?b FILTER(?b < 0) } BIND(COALESCE(STR(?b > -500), 'none') AS ?label) FILTER(?s IN ('BUILDING', 'MACHINERY')) }",
    "SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN (c_acctbal > -500)::VARCHAR ELSE 'none' END AS label FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
sparql("time_fractions", "events", "SELECT (COUNT(DISTINCT ?t) AS ?n) (MIN(?t) AS ?first) { ?e c:ts ?t }", "SELECT count(DISTINCT ts) AS n, replace(min(ts)::VARCHAR, ' ', 'T') AS first FROM events", integers=("n",))
sparql(
    "exact_integers", "events",
    "SELECT ?type (SUM(9007199254740993 + ?u) AS ?total) (COUNT(*) AS ?n) { ?e c:event_type ?type ; c:value ?v BIND(xsd:integer(FLOOR(?v)) AS ?u) FILTER(9007199254740993 + ?u > 9007199254740993) } GROUP BY ?type",
    "SELECT event_type AS type, sum(9007199254740993 + floor(value)::HUGEINT)::VARCHAR AS total, count(*) AS n FROM events WHERE floor(value) > 0 GROUP BY 1",
    integers=("n",),
)
sparql(
    "exact_decimals", "part",
    "SELECT ?brand (SUM(xsd:decimal(?r)) AS ?total) (MAX(xsd:decimal(?r) * 0.1) AS ?most) { ?p c:p_brand ?brand ; c:p_retailprice ?r } GROUP BY ?brand",
    "SELECT p_brand AS brand, rtrim(rtrim(sum(p_retailprice::DECIMAL(18, 6))::VARCHAR, '0'), '.') AS total, rtrim(rtrim(max(p_retailprice::DECIMAL(18, 6) * 0.1::DECIMAL(2, 1))::VARCHAR, '0'), '.') AS most FROM part GROUP BY 1",
)
sparql(
    "hash_functions", "nation",
    "SELECT ?n (SHA1(?n) AS ?a) (SHA256(?n) AS ?b) (STRLANG(?n, 'en') AS ?c) (DATATYPE(STRDT(?n, c:t)) AS ?d) (isIRI(?x) AS ?e) (isLITERAL(?n) AS ?f) (isNUMERIC(?n) AS ?g) (LANG(STRLANG(?n, 'fr')) AS ?h) (SAMETERM(?n, STR(?n)) AS ?i) { ?x c:n_name ?n }",
    "SELECT n_name AS n, sha1(n_name) AS a, sha256(n_name) AS b, n_name AS c, 'urn:col:t' AS d, 'true' AS e, 'true' AS f, 'false' AS g, 'fr' AS h, 'true' AS i FROM nation",
)


@query("decimal_columns", "SELECT p_brand AS brand, rtrim(rtrim(sum(p_retailprice::DECIMAL(20, 2))::VARCHAR, '0'), '.') AS total, rtrim(rtrim(max(p_retailprice::DECIMAL(20, 2))::VARCHAR, '0'), '.') AS most, count(DISTINCT p_retailprice::DECIMAL(20, 2)) AS n FROM part GROUP BY 1")
def decimal_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a decimal column as a graph."""
    t = table(spark, sf_dir, "part").withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(20,2)"))
    g = VirtualGraph([TableMap("part", t, "p_partkey", ["p_brand", "p_retailprice"])])
    r = SparqlEngine(spark, g).query(PREFIXES + "SELECT ?brand (SUM(?r) AS ?total) (MAX(?r) AS ?most) (COUNT(DISTINCT ?r) AS ?n) { ?p c:p_brand ?brand ; c:p_retailprice ?r } GROUP BY ?brand")
    return r.values(exact=("n",)).withColumn("n", F.col("n").cast("bigint"))


@query("zoned_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate + to_minutes((o_orderkey % 7) * 30), o_orderkey) AS place FROM orders QUALIFY place <= 40")
def zoned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 earliest of times written in different zones, in order."""
    west = F.pmod("o_orderkey", F.lit(7)) * 30
    zone = F.format_string("-%02d:%02d", F.floor(west / 60), F.pmod(west, F.lit(60)))
    t = table(spark, sf_dir, "orders")
    quads = Q.conform(t.select(F.concat(F.lit("urn:o:"), F.format_string("%012d", "o_orderkey")).alias("s"), F.lit("urn:at").alias("p"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("o"), F.lit(Q.XSD + "dateTime").alias("o_datatype")))
    r = SparqlEngine(spark, StoredGraph(quads)).query("SELECT ?s { ?s <urn:at> ?t } ORDER BY ?t ?s LIMIT 40").values()
    rows = [(int(x.s[6:]), i + 1) for i, x in enumerate(r.collect())]
    return spark.createDataFrame(rows, "o_orderkey bigint, place bigint")


# Paths
sparql("path_sequence_alternative", "customer nation region supplier", "SELECT ?r (COUNT(*) AS ?n) { ?x (c:c_nationkey|c:s_nationkey)/c:n_regionkey/c:r_name ?r } GROUP BY ?r", "SELECT r_name AS r, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", integers=("n",))
sparql("path_inverse_negated", "nation region", "SELECT ?r ?x { ?r ^c:n_regionkey ?n . ?n !(c:n_regionkey|a) ?x }", "SELECT 'urn:region:' || n_regionkey AS r, n_name AS x FROM nation")


@query(
    "path_transitive",
    "WITH RECURSIVE e AS (SELECT conv_id, turn AS a, turn + 1 AS b FROM conversations WHERE (conv_id, turn + 1) IN (SELECT conv_id, turn FROM conversations)), p AS (SELECT conv_id, a, b FROM e UNION SELECT p.conv_id, p.a, e.b FROM p JOIN e ON p.conv_id = e.conv_id AND p.b = e.a) SELECT conv_id || '/' || a AS x, conv_id || '/' || b AS y FROM p",
)
def path_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that come later in a conversation, by one or more steps from a turn to the next."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    nxt = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"])
    at = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") + n).cast("string"))
    quads = Q.conform(nxt.select(at(0).alias("s"), F.lit("urn:next").alias("p"), at(1).alias("o"), F.lit(Q.IRI).alias("o_kind")))
    return SparqlEngine(spark, StoredGraph(quads)).query("SELECT ?x ?y { ?x <urn:next>+ ?y }").values()


_STEPS = "WITH RECURSIVE e AS (SELECT conv_id, turn AS a, turn + 1 AS b FROM (SELECT DISTINCT conv_id, turn FROM conversations) WHERE (conv_id, turn + 1) IN (SELECT conv_id, turn FROM conversations)), p AS (SELECT conv_id, a, b FROM e UNION SELECT p.conv_id, p.a, e.b FROM p JOIN e ON p.conv_id = e.conv_id AND p.b = e.a), n AS (SELECT conv_id, a FROM e UNION SELECT conv_id, b FROM e)"


def _turns(spark: SparkSession, sf_dir: str) -> StoredGraph:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    nxt = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"])
    at = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit("/"), (F.col("turn") + n).cast("string"))
    return StoredGraph(Q.conform(nxt.select(at(0).alias("s"), F.lit("urn:next").alias("p"), at(1).alias("o"), F.lit(Q.IRI).alias("o_kind"))))


@query("path_zero_or_more", f"{_STEPS} SELECT conv_id || '/' || a AS x, conv_id || '/' || b AS y FROM p UNION SELECT conv_id || '/' || a, conv_id || '/' || a FROM n")
def path_zero_or_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SparqlEngine(spark, _turns(spark, sf_dir)).query("SELECT ?x ?y { ?x <urn:next>* ?y }").values()


@query("path_optional_step", f"{_STEPS} SELECT conv_id || '/' || a AS x, conv_id || '/' || b AS y FROM e UNION SELECT conv_id || '/' || a, conv_id || '/' || a FROM n")
def path_optional_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SparqlEngine(spark, _turns(spark, sf_dir)).query("SELECT ?x ?y { ?x <urn:next>? ?y }").values()


@query("path_from_one_end", f"{_STEPS} SELECT conv_id || '/' || b AS y FROM p WHERE conv_id = (SELECT min(conv_id) FROM e) AND a = (SELECT min(a) FROM e WHERE conv_id = (SELECT min(conv_id) FROM e))")
def path_from_one_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later turns of the first conversation; the rounds go out from its first turn alone."""
    quads = _turns(spark, sf_dir).quads().withColumns({c: F.concat(F.lit("urn:t:"), c) for c in ("s", "o")})
    place = F.struct(*[F.split_part(F.substring("s", 7, 99), F.lit("/"), F.lit(i)).cast("bigint") for i in (1, 2)])
    first = quads.select(F.min_by("s", place).alias("s")).first().s
    return SparqlEngine(spark, StoredGraph(quads)).query(f"SELECT ?y {{ <{first}> <urn:next>+ ?y }}").values().select(F.replace("y", F.lit("urn:t:")).alias("y"))


sparql("from_default", "documents", "SELECT ?d ?n FROM <urn:graph:src1> FROM <urn:graph:src2> { ?d c:n_chars ?n }", "SELECT 'urn:documents:' || doc_id AS d, n_chars AS n FROM documents WHERE source IN ('src1', 'src2')", integers=("n",), by={"documents": "source"})
sparql("from_named", "documents", "SELECT ?g (COUNT(*) AS ?n) FROM NAMED <urn:graph:src1> FROM NAMED <urn:graph:src4> { GRAPH ?g { ?d c:n_chars ?x } } GROUP BY ?g", "SELECT 'urn:graph:' || source AS g, count(*) AS n FROM documents WHERE source IN ('src1', 'src4') GROUP BY 1", integers=("n",), by={"documents": "source"})


@query("ask", "SELECT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3') AS answer")
def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = SparqlEngine(spark, graph(spark, sf_dir, "customer", "nation")).query(PREFIXES + "ASK { ?x c:c_nationkey ?n . ?n c:n_name 'NATION_3' }")
    return spark.createDataFrame([(r.boolean,)], "answer boolean")


@query("construct", "SELECT DISTINCT 'urn:region:' || n_regionkey AS s, 'urn:serves' AS p, c_mktsegment AS o FROM customer JOIN nation ON c_nationkey = n_nationkey")
def construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = SparqlEngine(spark, graph(spark, sf_dir, "customer", "nation")).query(PREFIXES + "CONSTRUCT { ?r <urn:serves> ?seg } { ?x c:c_nationkey ?n ; c:c_mktsegment ?seg . ?n c:n_regionkey ?r }")
    return r.quads.select("s", "p", "o")


@query("describe", f"SELECT 'urn:nation:' || n_nationkey AS s, 'urn:col:n_name' AS p, n_name AS o FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:col:n_regionkey', 'urn:region:2' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'urn:nation:' || n_nationkey, '{Q.RDF}type', 'urn:class:nation' FROM nation WHERE n_regionkey = 2")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SparqlEngine(spark, graph(spark, sf_dir, "nation")).query(PREFIXES + "DESCRIBE ?n { ?n c:n_regionkey <urn:region:2> }").quads.select("s", "p", "o")


def _nation_store(spark: SparkSession, sf_dir: str) -> QuadStore:
    store = QuadStore(spark)
    store.write(graph(spark, sf_dir, "nation", "region").quads())
    return store


_NATION_QUADS = f"""q AS (SELECT 'urn:nation:' || n_nationkey AS s, 'urn:col:n_name' AS p, n_name AS o FROM nation UNION ALL SELECT 'urn:nation:' || n_nationkey, 'urn:col:n_regionkey', 'urn:region:' || n_regionkey FROM nation
UNION ALL SELECT 'urn:nation:' || n_nationkey, '{Q.RDF}type', 'urn:class:nation' FROM nation UNION ALL SELECT 'urn:region:' || r_regionkey, 'urn:col:r_name', r_name FROM region
UNION ALL SELECT 'urn:region:' || r_regionkey, '{Q.RDF}type', 'urn:class:region' FROM region)"""


@query(
    "update_delete_insert",
    f"WITH {_NATION_QUADS} SELECT s, p, o, '' AS g FROM q WHERE NOT (p = 'urn:col:n_regionkey' AND o = 'urn:region:1') AND NOT (s = 'urn:region:4') UNION ALL SELECT s, 'urn:moved', 'urn:region:9', '' FROM q WHERE p = 'urn:col:n_regionkey' AND o = 'urn:region:1' UNION ALL SELECT s, p, o, 'urn:copy' FROM (SELECT s, p, o FROM q WHERE NOT (p = 'urn:col:n_regionkey' AND o = 'urn:region:1') AND NOT (s = 'urn:region:4') UNION ALL SELECT s, 'urn:moved', 'urn:region:9' FROM q WHERE p = 'urn:col:n_regionkey' AND o = 'urn:region:1')",
)
def update_delete_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _nation_store(spark, sf_dir)
    SparqlEngine(spark, store=store).execute(PREFIXES + "DELETE { ?n c:n_regionkey ?r } INSERT { ?n <urn:moved> <urn:region:9> } WHERE { ?n c:n_regionkey ?r FILTER(?r = <urn:region:1>) } ; DELETE WHERE { <urn:region:4> ?p ?o } ; COPY DEFAULT TO <urn:copy>")
    return store.quads().select("s", "p", "o", "g")


# Terms and filters
@query("quad_filter_include_exclude", "SELECT 'urn:customer:' || c_custkey AS s, 'urn:col:c_name' AS p, c_name AS o FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'urn:customer:' || c_custkey, 'urn:col:c_mktsegment', c_mktsegment FROM customer WHERE c_custkey <> 7")
def quad_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = QuadFilter(Criteria(predicates=["urn:col:c_name", "urn:col:c_mktsegment", "urn:col:c_acctbal"]), Criteria(subjects=["urn:customer:7"], predicates=["urn:col:c_acctbal"]))
    return filter_quads(graph(spark, sf_dir, "customer").quads(), f).select("s", "p", "o")


@query("match_pattern", "SELECT 'urn:orders:' || o_orderkey AS s FROM orders WHERE o_orderstatus = 'F'")
def match_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(graph(spark, sf_dir, "orders").scan("urn:col:o_orderstatus"), p="urn:col:o_orderstatus", o=Q.literal("F"), g="").select("s")


_LINE = "'<urn:nation:' || n_nationkey || '> <urn:col:n_name> \"' || n_name || '\" .' || chr(10)"


@query("hash_quad", f"SELECT 'urn:nation:' || n_nationkey AS s, 'q2.' || rtrim(translate(to_base64(unhex(sha256({_LINE}))), '+/', '-_'), '=') AS id FROM nation")
def hash_quad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.hash_quads(graph(spark, sf_dir, "nation").scan("urn:col:n_name")).select("s", F.col("quad_id").alias("id"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"


@query("canonical_nquads", f"SELECT '<urn:documents:' || doc_id || '> <urn:col:text> \"' || {_ESCAPED} || '\"@' || lang || ' .' || chr(10) AS line FROM documents")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "documents").scan("urn:col:text").select(Q.canonical_nquads().alias("line"))


@query("textual_literal_filter", "SELECT 'c_mktsegment' AS p, count(*) AS n FROM customer UNION ALL SELECT 'c_name', count(*) FROM customer")
def textual_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "customer").quads().where(Q.textual()).groupBy(F.substring_index("p", ":", -1).alias("p")).agg(F.count("*").alias("n"))


# Search
@query(
    "search_scan",
    "SELECT 'q2.' || rtrim(translate(to_base64(unhex(sha256('<urn:documents:' || doc_id || '> <urn:col:text> \"' || " + _ESCAPED + " || '\" .' || chr(10)))), '+/', '-_'), '=') AS id, 'urn:documents:' || doc_id AS subject, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'mit license')",
)
def search_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.search_scan(graph(spark, sf_dir, "documents").scan("urn:col:text"), "MIT License").select("id", "subject", "score")


@query("search_then_query", "SELECT DISTINCT 'urn:documents:' || doc_id AS d, lang FROM documents WHERE contains(lower(text), 'license')")
def search_then_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a search joined with a pattern around their subjects, in one plan."""
    g = graph(spark, sf_dir, "documents")
    hits = S.search_scan(g.scan("urn:col:text"), "license").select(F.col("subject").alias("d")).distinct()
    around = SparqlEngine(spark, g).query(PREFIXES + "SELECT ?d ?lang { ?d c:lang ?lang }").values()
    return hits.join(around, "d")


@query("chunk_fixed", "SELECT doc_id, (i / 1000)::INTEGER AS position, substr(text, i + 1, 1000) AS value FROM (SELECT doc_id, text, unnest(range(0, length(text), 1000)) AS i FROM documents)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.chunk_quads(graph(spark, sf_dir, "documents").scan("urn:col:text"), S.fixed(1000))
    return c.select(F.substring_index("subject", ":", -1).cast("bigint").alias("doc_id"), "position", "value")


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.chunk_quads(graph(spark, sf_dir, "documents").scan("urn:col:text"), S.recursive(1000, 100)).select("subject", "position", "value")


@query("index_text", "SELECT 'urn:supplier:' || s_suppkey AS subject, 'urn:supplier:' || s_suppkey || ' urn:col:s name ' || s_name AS fts_value FROM supplier")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.index_text(S.chunk_quads(graph(spark, sf_dir, "supplier").scan("urn:col:s_name"))).select("subject", "fts_value")


@query("local_label", "SELECT event_id, lower(trim(regexp_replace(regexp_replace(event_type, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[_-]+', ' ', 'g'))) AS phrase FROM events")
def local_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", L.predicate_phrase(F.concat(F.lit("http://e.org/v#"), "event_type")).alias("phrase"))


@query("labels_per_subject", "SELECT 'urn:nation:' || n_nationkey AS s, n_name AS labels FROM nation")
def labels_per_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.labels_per_subject(graph(spark, sf_dir, "nation").quads(), ["urn:col:n_name"]).select("s", F.array_join("labels", "|").alias("labels"))


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = docs.select(F.col("doc_id").alias("quad_id"), F.lit(0).alias("position"), F.lit("").alias("subject"), F.lit("").alias("predicate"), F.lit("").alias("graph"), F.lit("").alias("value"), S.words(F.col("text")).alias("terms"))
    # The index is a table that queries read; its terms are split once.
    return S.bm25(cut(index), "released under license")


_BM25 = """t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 0) AS terms FROM documents),
s AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM t), h AS (SELECT doc_id, len(terms) AS n, w, len(list_filter(terms, lambda x: x = w)) AS tf FROM t, (VALUES ('released'), ('under'), ('license')) v(w) WHERE list_contains(terms, w)),
d AS (SELECT w, count(*) AS df FROM h GROUP BY w), b AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM h JOIN d USING (w), s GROUP BY doc_id)"""


@query("bm25_topk", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select(F.col("quad_id").alias("doc_id"), "bm25").orderBy(F.desc(F.round("bm25", 9)), "doc_id").limit(20).select("doc_id", F.round("bm25", 6).alias("score"))


SQL["bm25_topk"] = SQL["bm25_topk"].replace("ORDER BY b.score DESC", "ORDER BY round(b.score, 9) DESC")


@query("bm25_postings", f"WITH {_BM25} SELECT doc_id, round(score, 6) AS score FROM b")
def bm25_from_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of a keyword query, from an inverted index written in two parts."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("quad_id"), F.lit(0).alias("position"), S.words(F.col("text")).alias("terms"))
    folders = [fresh_path(spark, "postings") for _ in range(2)]
    for i, f in enumerate(folders):
        S.write_postings(docs.where(F.pmod(F.xxhash64("quad_id"), F.lit(2)) == i), f)
    return S.bm25_postings(spark, folders, "released under license").select(F.col("quad_id").cast("bigint").alias("doc_id"), F.round("bm25", 6).alias("score"))


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


_COSINE = "e AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings)"


@query("vector_topk_cosine", f"WITH {_COSINE} SELECT vec_id, round(c, 6) AS score FROM e ORDER BY c DESC, vec_id LIMIT 15")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vector_topk(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 15).select("vec_id", F.round("score", 6).alias("score"))


@query(
    "rrf_fusion",
    f"WITH {_BM25}, {_COSINE}, a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS r FROM b), v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(c, 9) DESC, vec_id) AS r FROM e) SELECT id, round(sum(1 / (60 + r)) * 61 / 2, 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM v) GROUP BY id",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of a keyword list and of a vector list fused. The tables share no ids; equal numbers stand in for them."""
    a = _bm25(spark, sf_dir).select(F.col("quad_id").alias("id"), F.round("bm25", 9).alias("score"))
    probe = F.array(*[F.lit(float(x)) for x in _probe(spark, sf_dir)])
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(S.cosine(F.col("embedding"), probe), 9).alias("score"))
    return S.rrf([a, v], ["id"]).select("id", F.round("score", 6).alias("score"))


@query("hybrid_search")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword and vector search over an index of the documents, fused."""
    index = S.kept(S.build_index(graph(spark, sf_dir, "documents").scan("urn:col:text")).drop("terms"))
    return S.search_index(index, "released under the license", "hybrid", S.HashedEmbedding(64), top_k=10)


# Stores
@query("import_merge_dedup", "SELECT 'urn:nation:' || n_nationkey AS s, n_name AS o FROM nation")
def import_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = graph(spark, sf_dir, "nation").scan("urn:col:n_name")
    store = QuadStore(spark)
    store.import_({"kind": "dataset", "dataset": q})
    store.import_({"kind": "dataset", "dataset": q.unionByName(q)})
    return store.quads().select("s", "o")


@query("replace", "SELECT 'urn:region:' || r_regionkey AS s, r_name AS o FROM region")
def replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "nation", "region")
    return apply_patch(g.scan("urn:col:n_name"), Patch(g.scan("urn:col:r_name"), None), Context("replace")).select("s", "o")


@query("transaction_cancel", "SELECT o_custkey AS c, count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def transaction_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders")
    quads = lambda d: Q.conform(d.select(F.concat(F.lit("urn:c:"), F.col("o_custkey").cast("string")).alias("s"), F.lit("urn:p").alias("p"), F.lit("x").alias("o")))
    p = cancel(quads(t.where("o_orderstatus <> 'P'")), quads(t.where("o_orderstatus = 'F'")))
    return p.insertions.groupBy(F.substring_index("s", ":", -1).cast("bigint").alias("c")).agg(F.count("*").alias("n"))


@query("transaction_commit", "SELECT 'urn:nation:' || n_nationkey AS s FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT 'urn:nation:new'")
def transaction_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "nation")
    store = QuadStore(spark)
    store.write(g.scan("urn:col:n_regionkey"))
    tx = store.transaction().remove_matches(o=Q.iri("urn:region:0")).add(Q.Quad(Q.iri("urn:nation:new"), Q.iri("urn:col:n_regionkey"), Q.iri("urn:region:1")))
    tx.commit()
    return store.quads().select("s")


@query("delete_graph", "SELECT 'urn:documents:' || doc_id AS s FROM documents WHERE source <> 'src1'")
def delete_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = QuadStore(spark, orderings=("pso", "gpso"))
    store.write(graph(spark, sf_dir, "documents", by={"documents": "source"}).scan("urn:col:n_chars"))
    store.transaction().delete_graph("urn:graph:src1").commit()
    return store.quads().select("s")


@query("commit_small", "SELECT 'urn:customer:' || c_custkey AS s, CASE c_mktsegment WHEN 'BUILDING' THEN 'NEW' ELSE c_mktsegment END AS o FROM customer UNION ALL SELECT 'urn:customer:' || c_custkey, 'ALSO' FROM customer WHERE c_mktsegment = 'MACHINERY'")
def commit_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits of some quads over a larger base, which they don't rewrite."""
    q = graph(spark, sf_dir, "customer").scan("urn:col:c_mktsegment")
    store = QuadStore(spark)
    store.write(q)
    of = lambda segment: q.where(F.col("o") == segment)
    store.apply(Patch(of("BUILDING").withColumn("o", F.lit("NEW")), of("BUILDING")))
    store.apply(Patch(of("MACHINERY").withColumn("o", F.lit("ALSO")).unionByName(of("FURNITURE")), None))
    return store.quads().select("s", "o")


@query("stream_import", "SELECT 'urn:events:' || event_id AS s, event_type AS o FROM events")
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads written as files, read as a stream and merged into a store batch by batch."""
    at = fresh_path(spark, "incoming")
    rdf.write_lines(graph(spark, sf_dir, "events").scan("urn:col:event_type"), at)
    store = QuadStore(spark)
    ingest(read_stream(spark, at), store, fresh_path(spark, "offsets")).awaitTermination()
    return store.quads().select("s", "o")


@query("tables_roundtrip", "SELECT 'urn:part:' || p_partkey AS s, p_name AS o FROM part UNION ALL SELECT 'urn:part:' || p_partkey, p_size::VARCHAR FROM part")
def tables_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads written as JSON and as CSV, imported as tables and merged."""
    g = graph(spark, sf_dir, "part")
    store = QuadStore(spark)
    for format, p in (("json", "urn:col:p_name"), ("csv", "urn:col:p_size"), ("csv", "urn:col:p_name")):
        at = fresh_path(spark, format)
        write_quads(g.scan(p), format, at)
        store.import_({"kind": "table", "format": format, "path": at})
    return store.quads().select("s", "o")


@query("export_roundtrip_count", "SELECT 2 * count(*) AS n, count(*) AS subjects FROM (SELECT n_nationkey FROM nation UNION ALL SELECT r_regionkey FROM region)")
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions, two quads each, to text and back."""
    g = graph(spark, sf_dir, "nation", "region")
    q = g.quads().where(F.col("p").isin(Q.RDF + "type", "urn:col:n_name", "urn:col:r_name"))
    back = rdf.read_text(spark, rdf.serialize(q, "text/turtle"))
    return back.agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query("graph_sizes", "SELECT 'urn:graph:' || source AS g, 4 * count(*) AS n FROM documents GROUP BY source")
def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, "documents", by={"documents": "source"}).quads().groupBy("g").agg(F.count("*").alias("n"))
