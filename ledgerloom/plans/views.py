"""Domain views of the driver's tables: pages with nodes and edges, a graph, versions, chunks, references; and the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def confidence(discount: Column) -> Column:
    return F.round(1 - 5 * discount, 3)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order, a document per customer: the parties, the contract and its lines as nodes and edges."""
    line = F.struct(*LINE)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    none = F.create_map().cast("map<string,string>")
    node = lambda n, t, p=none: F.struct(n.alias("name"), t.alias("type"), p.alias("properties"))
    contract = tag("O", "o_orderkey")
    of_line = lambda x: node(F.concat(F.lit("D"), x["l_partkey"].cast("string")), F.when(x["l_discount"] > 0, F.lit("Deliverable")), F.create_map(F.lit("quantity"), x["l_quantity"].cast("int").cast("string"), F.lit("note"), F.lit("")))
    of_edge = lambda x: F.struct(
        contract.alias("source"), F.when(x["l_returnflag"] == "R", "HAS_DELIVERABLE").when(x["l_returnflag"] == "A", "COVERS SITE").alias("relation"),
        F.when(x["l_tax"] > 0, F.concat(F.lit("D"), x["l_partkey"].cast("string"))).alias("target"), F.create_map(F.lit("confidence"), confidence(x["l_discount"]).cast("string")).alias("properties"),
    )
    head = F.array(node(tag("P", "o_custkey"), F.lit("Party")), node(contract, F.lit("Contract"), F.create_map(F.lit("status"), F.col("o_orderstatus"))))
    return o.select(
        tag("C", "o_custkey").alias("doc"), F.col("o_orderkey").cast("int").alias("page"), F.lit("").alias("raw_text"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"),
        F.concat(head, F.transform("lines", of_line)).alias("nodes"), F.transform("lines", of_edge).alias("edges"),
        F.array(F.struct(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("reason"))).alias("suggested_new_types"),
    )


#: The same pages, flat: p_nodes(doc, page, pos, name, type, seq) with missing types, p_edges(doc, page, pos, source, relation, target, confidence, seq) with missing parts.
PAGES_SQL = """lines as materialized (select 'C' || o_custkey as doc, o_orderkey::integer as page, 'O' || o_orderkey as contract, o_orderstatus, l.*,
        row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as i
    from orders join lineitem l on l_orderkey = o_orderkey),
p_nodes0 as (select 'C' || o_custkey as doc, o_orderkey::integer as page, 0 as pos, 'P' || o_custkey as name, 'Party' as type from orders
    union all select 'C' || o_custkey, o_orderkey::integer, 1, 'O' || o_orderkey, 'Contract' from orders
    union all select doc, page, i + 2, 'D' || l_partkey, case when l_discount > 0 then 'Deliverable' end from lines),
p_nodes as materialized (select *, row_number() over (order by doc, page, pos) as seq from p_nodes0),
p_edges as materialized (select doc, page, i as pos, contract as source, case l_returnflag when 'R' then 'HAS_DELIVERABLE' when 'A' then 'COVERS SITE' end as relation,
        case when l_tax > 0 then 'D' || l_partkey end as target, round(1 - 5 * l_discount, 3) as confidence, row_number() over (order by doc, page, i) as seq from lines)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over orders, lines, customers, suppliers and places. Parts are used by edges but not declared; closed contracts are declared twice."""
    t = lambda n: table(spark, sf_dir, n)
    place = lambda base, key: (F.lit(base).cast("long") + F.col(key)).alias("seq")
    node = lambda df, name, kind, base, key: df.select(name.alias("name"), F.lit(kind).alias("type"), place(base, key))
    orders, lines, customers = t("orders"), t("lineitem"), t("customer")
    nodes = (
        node(customers, tag("P", "c_custkey"), "Party", 10**12, "c_custkey")
        .unionByName(node(orders, tag("O", "o_orderkey"), "Contract", 2 * 10**12, "o_orderkey"))
        .unionByName(node(t("supplier"), tag("S", "s_suppkey"), "OrgUnit", 4 * 10**12, "s_suppkey"))
        .unionByName(node(t("nation"), F.col("n_name"), "Site", 5 * 10**12, "n_nationkey"))
        .unionByName(node(t("region"), F.concat(F.lit("R "), "r_name"), "Site", 6 * 10**12, "r_regionkey"))
        .unionByName(node(orders.filter("o_orderstatus = 'F'"), tag("O", "o_orderkey"), "ContractRecord", 7 * 10**12, "o_orderkey"))
    )
    edge = lambda df, s, r, g, seq, c=F.lit(None).cast("double"): df.select(s.alias("source"), F.lit(r).alias("relation"), g.alias("target"), seq.alias("seq"), c.alias("confidence"))
    by_line = lambda base: F.lit(base).cast("long") + F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    located = customers.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    regions = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    far = 10**15
    edges = (
        edge(orders, tag("P", "o_custkey"), "PARTY_TO", tag("O", "o_orderkey"), F.lit(far).cast("long") + F.col("o_orderkey"))
        .unionByName(edge(lines, tag("O", "l_orderkey"), "HAS_DELIVERABLE", tag("D", "l_partkey"), by_line(2 * far), confidence(F.col("l_discount"))))
        .unionByName(edge(lines, tag("O", "l_orderkey"), "FULFILLED_BY", tag("S", "l_suppkey"), by_line(3 * far), confidence(F.col("l_discount"))))
        .unionByName(edge(located, tag("P", "c_custkey"), "LOCATED_IN", F.col("n_name"), F.lit(4 * far).cast("long") + F.col("c_custkey")))
        .unionByName(edge(regions, F.col("n_name"), "LOCATED_IN", F.concat(F.lit("R "), "r_name"), F.lit(5 * far).cast("long") + F.col("n_nationkey")))
    )
    return nodes, edges


GRAPH_SQL = """g_nodes as (select 'P' || c_custkey as name, 'Party' as type, 1000000000000 + c_custkey as seq from customer
    union all select 'O' || o_orderkey, 'Contract', 2000000000000 + o_orderkey from orders
    union all select 'S' || s_suppkey, 'OrgUnit', 4000000000000 + s_suppkey from supplier
    union all select n_name, 'Site', 5000000000000 + n_nationkey from nation
    union all select 'R ' || r_name, 'Site', 6000000000000 + r_regionkey from region
    union all select 'O' || o_orderkey, 'ContractRecord', 7000000000000 + o_orderkey from orders where o_orderstatus = 'F'),
g_edges as (select 'P' || o_custkey as source, 'PARTY_TO' as relation, 'O' || o_orderkey as target, 1000000000000000 + o_orderkey as seq, null::double as confidence from orders
    union all select 'O' || l_orderkey, 'HAS_DELIVERABLE', 'D' || l_partkey, 2000000000000000 + l_orderkey * 1000 + l_linenumber, round(1 - 5 * l_discount, 3) from lineitem
    union all select 'O' || l_orderkey, 'FULFILLED_BY', 'S' || l_suppkey, 3000000000000000 + l_orderkey * 1000 + l_linenumber, round(1 - 5 * l_discount, 3) from lineitem
    union all select 'P' || c_custkey, 'LOCATED_IN', n_name, 4000000000000000 + c_custkey, null from customer join nation on c_nationkey = n_nationkey
    union all select n_name, 'LOCATED_IN', 'R ' || r_name, 5000000000000000 + n_nationkey, null from nation join region on n_regionkey = r_regionkey),
g_ends as (select source as name, seq from g_edges union all select target, seq from g_edges),
g_types as (select name, arg_max(type, seq) as type, min(seq) as seq from g_nodes group by 1),
g_vertices as (select coalesce(t.name, e.name) as name, coalesce(type, 'Unknown') as type, coalesce(degree, 0)::bigint as degree, least(t.seq, e.seq) as seq
    from g_types t full join (select name, count(*) as degree, min(seq) as seq from g_ends group by 1) e on t.name = e.name)"""


def heavy_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of orders and parts that a line of at least 49 pieces links: a graph of many components."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49")
    edges = lines.select(tag("O", "l_orderkey").alias("source"), tag("D", "l_partkey").alias("target"))
    names = table(spark, sf_dir, "orders").select(tag("O", "o_orderkey").alias("name")).unionByName(table(spark, sf_dir, "part").select(tag("D", "p_partkey").alias("name")))
    return names, edges


HEAVY_SQL = """h_names as (select 'O' || o_orderkey as name from orders union all select 'D' || p_partkey from part),
h_edges as (select distinct 'O' || l_orderkey as a, 'D' || l_partkey as b from lineitem where l_quantity >= 49),
h_both as (select a, b from h_edges union all select b, a from h_edges),
h_reach(root, name) as (select name, name from h_names union select r.root, e.b from h_reach r join h_both e on e.a = r.name),
h_components as (select name, min(root) as component from h_reach group by 1)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract_id, revision, freeze_ts, order_key): a customer's orders in time are the revisions of its contract."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("contract_id"), F.row_number().over(w).alias("revision"), F.col("o_orderdate").alias("freeze_ts"), F.col("o_orderkey").alias("order_key"))


VERSIONS_SQL = "versions as (select o_custkey as contract_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::integer as revision, o_orderdate as freeze_ts, o_orderkey as order_key from orders)"


def lines_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, line) of documents' non-empty lines."""
    from ledgerloom.operators.chunks import lines

    return lines(table(spark, sf_dir, "documents"), "doc_id", "text")


LINES_SQL = r"""doc_lines as (select doc_id, pos, line from (select doc_id, (unnest(range(len(s))))::integer as pos, unnest(s) as line from (select doc_id, string_split(text, chr(10)) as s from documents)) where trim(line) <> '')"""


def chunk_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contract_id, revision, chunk_hash): documents of a source and language, in order, as revisions; their lines as chunks."""
    from pyspark.sql import Window

    from ledgerloom.functions.text import chunk_hash
    from ledgerloom.operators.chunks import lines

    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("contract_id"), F.row_number().over(w).alias("revision"), "text", "doc_id")
    numbered = d.select("doc_id", "contract_id", "revision")
    return lines(d, "doc_id", "text").join(numbered, "doc_id").select("contract_id", "revision", chunk_hash(F.col("line")).alias("chunk_hash"))


NORM_SQL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"
CHUNK_VERSIONS_SQL = (
    LINES_SQL
    + r""", numbered as (select doc_id, source || '/' || lang as contract_id, row_number() over (partition by source, lang order by doc_id)::integer as revision from documents),
chunk_versions as (select contract_id, revision, sha256("""
    + NORM_SQL.format("line")
    + r""") as chunk_hash from doc_lines join numbered using (doc_id)),
cv as (select distinct * from chunk_versions),
revs as (select distinct contract_id, revision from cv),
changes as (select * from (select coalesce(n.contract_id, b.contract_id) as contract_id, coalesce(n.revision, b.revision + 1)::integer as revision, coalesce(n.chunk_hash, b.chunk_hash) as chunk_hash,
    case when n.chunk_hash is null then 'removed' when b.chunk_hash is null then 'new' else 'reused' end as status
    from cv n full join cv b on n.contract_id = b.contract_id and n.revision = b.revision + 1 and n.chunk_hash = b.chunk_hash) semi join revs using (contract_id, revision))"""
)


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata table of contracts (customers), with gaps."""
    c = table(spark, sf_dir, "customer")
    seg = F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit(""))
    return c.select(F.col("c_custkey").cast("string").alias("Sales Contract ID"), seg.alias("Sales Contract Status"), F.col("c_name").alias("Sales Contract Company Name"), F.when(F.col("c_acctbal") > 0, F.format_string("%d", F.floor("c_acctbal"))).otherwise("").alias("Sales Contract or Amendment Value USD"))


METADATA_SQL = """meta as (select c_custkey::varchar as contract_id, coalesce(nullif(c_mktsegment, 'BUILDING'), '') as status, c_name as company, case when c_acctbal > 0 then floor(c_acctbal)::bigint::varchar else '' end as value from customer)"""
