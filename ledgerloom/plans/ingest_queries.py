"""Queries on ingestion: types, confidence, upserts, metadata, keys, revisions' payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import key_of, offset_days
from ledgerloom.operators import embedding, graph, ingest, revisions
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import METADATA_SQL, PAGES_SQL, confidence, metadata, pages, table, tag
from ledgerloom.sources import files

S = SparkSession
P = f"with {PAGES_SQL} "


def _canonical(n: Column) -> Column:
    """A node with its canonical name: parts by their last two digits stand for one another."""
    return n.withField("canonical", F.when(F.coalesce(n["type"], F.lit("Unknown")) == "Deliverable", F.concat(F.lit("D"), F.substring(n["name"], -2, 2))).otherwise(n["name"]))


@query("edge_rewrite", P + """, m as materialized (select doc, page, name, arg_max(case when type = 'Deliverable' then 'D' || right(name, 2) else name end, seq) as canonical from p_nodes group by all)
    select e.doc, e.page, e.pos::integer as pos, coalesce(s.canonical, source) as src_name, coalesce(t.canonical, target) as tgt_name from p_edges e
    left join m s on s.doc = e.doc and s.page = e.page and s.name = source left join m t on t.doc = e.doc and t.page = e.page and t.name = target where target is not null""")  # fmt: skip
def edge_rewrite(spark: S, sf: str) -> DataFrame:
    p = pages(spark, sf)
    return ingest.page_edges(p.withColumn("nodes", F.transform("nodes", _canonical))).select("doc", "page", "pos", "src_name", "tgt_name")


def _typed(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    """(nodes as label, canonical_name, props, seq; gated edges with labels)."""
    p = pages(spark, sf)
    n = graph.flatten_nodes(p)
    t = ingest.page_edges(p).withColumn("confidence", ingest.confidence_of(F.element_at("properties", "confidence")))
    t = t.withColumn("rel_type", ingest.gated(F.replace(F.upper("relation"), F.lit(" "), F.lit("_")), F.col("confidence")))
    t = t.withColumnRenamed("properties", "props")
    return n.select(F.col("type").alias("label"), F.col("name").alias("canonical_name"), F.col("properties").alias("props"), "seq"), t


_TYPED = """, t as materialized (select doc, page, name, arg_min(coalesce(type, 'Unknown'), seq) as type from p_nodes group by all),
    typed as materialized (select e.*, coalesce(s.type, 'Unknown') as src_label, coalesce(g.type, 'Unknown') as tgt_label, replace(upper(coalesce(relation, 'UNKNOWN')), ' ', '_') as rel from p_edges e
        left join t s on s.doc = e.doc and s.page = e.page and s.name = source left join t g on g.doc = e.doc and g.page = e.page and g.name = target where target is not null),
    gated as (select *, case when confidence >= 0.75 then rel else 'POSSIBLE_' || rel end as rel_type from typed)"""  # fmt: skip


@query("confidence_gate", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 - 5 * l_discount, 3) as confidence, case when round(1 - 5 * l_discount, 3) >= 0.75 then l_returnflag else 'POSSIBLE_' || l_returnflag end as rel_type from lineitem")
def confidence_gate(spark: S, sf: str) -> DataFrame:
    c = ingest.confidence_of(confidence(F.col("l_discount")).cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c.alias("confidence"), ingest.gated(F.col("l_returnflag"), c).alias("rel_type"))


@query("node_confidence", "select o_orderkey, round(case when o_orderstatus = 'P' then 0.70 else 0.90 end + case when o_orderpriority <> '5-LOW' then 0.05 else 0 end, 3)::double as confidence from orders")
def node_confidence(spark: S, sf: str) -> DataFrame:
    props = F.when(F.col("o_orderpriority") != "5-LOW", F.create_map(F.lit("p"), F.col("o_orderpriority")))
    source = F.when(F.col("o_orderstatus") == "P", "photographed").otherwise("pdf_text")
    return table(spark, sf, "orders").select("o_orderkey", F.round(ingest.node_confidence(source, props), 3).alias("confidence"))


@query("review_queue", P + _TYPED + " select doc, page, pos::integer as pos, rel_type, confidence from gated where confidence < 0.75")
def review_queue(spark: S, sf: str) -> DataFrame:
    return _typed(spark, sf)[1].filter("confidence < 0.75").select("doc", "page", "pos", "rel_type", "confidence")


@query("edge_endpoint_join", P + _TYPED + """, keep as (select distinct name, type from p_nodes where type is not null) select doc, page, pos::integer as pos from gated e
    semi join (select name as src_name, type as st from keep) a on a.src_name = e.source and a.st = e.src_label semi join (select name as tgt_name, type as tt from keep) b on b.tgt_name = e.target and b.tt = e.tgt_label""")  # fmt: skip
def edge_endpoint_join(spark: S, sf: str) -> DataFrame:
    """Edges of which both ends are typed nodes of the registry; untyped ones are no nodes there."""
    n, e = _typed(spark, sf)
    known = n.filter("label <> 'Unknown'").select("label", "canonical_name").distinct()
    side = lambda p: known.select(F.col("label").alias(f"{p}_label"), F.col("canonical_name").alias(f"{p}_name"))
    return e.join(side("src"), ["src_label", "src_name"]).join(side("tgt"), ["tgt_label", "tgt_name"]).select("doc", "page", "pos")


@query("dropped_edges", P + _TYPED + """, keep as (select distinct name, type from p_nodes where type is not null) select doc, page, pos::integer as pos, 'target' as missing from gated e where not exists (from keep k where k.name = e.target and k.type = e.tgt_label)""")
def dropped_edges(spark: S, sf: str) -> DataFrame:
    n, e = _typed(spark, sf)
    return ingest.dropped_edges(e, n.filter("label <> 'Unknown'")).select("doc", "page", "pos", "missing")


@query("merge_nodes", P + """, v as (select coalesce(type, 'Unknown') as label, name, case when name[1] = 'D' then 'quantity' when name[1] = 'O' then 'status' end as k,
        case when name[1] = 'D' then (select l_quantity::integer::varchar from lines l where l.doc = n.doc and l.page = n.page and l.i = n.pos - 2) when name[1] = 'O' then (select o_orderstatus from orders where 'O' || o_orderkey = n.name) end as v, seq from p_nodes n),
    m as (select label, name, k, arg_max(v, seq) as v from v group by all)
    select label, name as canonical_name, coalesce(string_agg(k || '=' || v, ',' order by k), '') as props, sha256(label || '|' || name) as element_id from m group by label, name""")  # fmt: skip
def merge_nodes(spark: S, sf: str) -> DataFrame:
    m = ingest.merged_nodes(_typed(spark, sf)[0])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return m.select("label", "canonical_name", text.alias("props"), "element_id")


@query("merge_edges", P + _TYPED + """ select src_label, source as src_name, rel_type, tgt_label, target as tgt_name, arg_max(confidence, seq) as confidence from gated group by all""")
def merge_edges(spark: S, sf: str) -> DataFrame:
    n, e = _typed(spark, sf)
    return ingest.merged_edges(e, n).select("src_label", "src_name", "rel_type", "tgt_label", "tgt_name", "confidence")


@query("upsert_nodes", """with s as (select 'P' || c_custkey as name, c_mktsegment as segment, c_nationkey::varchar as nation from customer),
    b as (select 'P' || o_custkey as name, arg_max(o_orderpriority, o_orderkey) as segment, arg_max(o_orderstatus, o_orderkey) as status from orders group by 1)
    select 'Party' as label, coalesce(s.name, b.name) as canonical_name, concat_ws(',', 'nation=' || nation, 'segment=' || coalesce(b.segment, s.segment), 'status=' || status) as props,
    sha256('Party|' || coalesce(s.name, b.name)) as element_id from s full join b on s.name = b.name""")  # fmt: skip
def upsert_nodes(spark: S, sf: str) -> DataFrame:
    """Customers as the stored nodes, their orders as a batch: a later order's values go over what is stored."""
    node = lambda df, key, props, seq: df.select(F.lit("Party").alias("label"), tag("P", key).alias("canonical_name"), props.alias("props"), F.col(seq).alias("seq"))
    stored = node(table(spark, sf, "customer"), "c_custkey", F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")), "c_custkey")
    batch = node(table(spark, sf, "orders"), "o_custkey", F.create_map(F.lit("segment"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")), "o_orderkey")
    merged = ingest.upserted_nodes(ingest.merged_nodes(stored), ingest.merged_nodes(batch))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return merged.select("label", "canonical_name", text.alias("props"), "element_id")


@query("vector_points", r"""select 'K' || doc_id as datapoint_id, len(embedding)::integer as dims, 'contract_id' as namespace, coalesce(source, '') as allow, coalesce(source, '') as crowding_tag,
    concat_ws(',', 'lang:' || lang, 'source:' || source) as element_ids from documents join embeddings on vec_id = doc_id where regexp_matches(text, '\S') and len(embedding) > 0""")  # fmt: skip
def vector_points(spark: S, sf: str) -> DataFrame:
    """Documents as chunks of the contract that their source stands for; language and source are the nodes of a chunk."""
    d = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id")).select(tag("K", "doc_id").alias("chunk_id"), F.col("source").alias("contract_id"), "text", "embedding", "lang", "source")
    nodes = F.explode(F.array(tag("lang:", "lang"), tag("source:", "source")))
    bridge = table(spark, sf, "documents").select(tag("K", "doc_id").alias("chunk_id"), nodes.alias("element_id")).filter("element_id is not null")
    p = embedding.datapoints(d, bridge).withColumn("r", F.col("restricts")[0])
    return p.select("datapoint_id", F.size("feature_vector").alias("dims"), "r.namespace", F.col("r.allow")[0].alias("allow"), "crowding_tag", F.array_join("element_ids", ",").alias("element_ids"))


@query("ingest_stats", P + """select 'node:' || coalesce(type, 'Unknown') as key, count(*) as "count" from p_nodes group by 1 union all select 'edge:' || replace(upper(coalesce(relation, 'UNKNOWN')), ' ', '_'), count(*) from p_edges where target is not null group by 1""")
def ingest_stats(spark: S, sf: str) -> DataFrame:
    p = pages(spark, sf)
    return ingest.stats(graph.flatten_nodes(p), graph.flatten_edges(p))


@query("metadata_scan", f"with {METADATA_SQL} select contract_id, status, company, value from meta")
def metadata_scan(spark: S, sf: str) -> DataFrame:
    m = files.with_contract_id(metadata(spark, sf))
    return m.select("contract_id", F.col("Sales Contract Status").alias("status"), F.col("Sales Contract Company Name").alias("company"), F.col("Sales Contract or Amendment Value USD").alias("value"))


@query("metadata_gap", f"with {METADATA_SQL} select contract_id, 'Sales Contract Status' as field from meta where status = '' union all select contract_id, 'Sales Contract or Amendment Value USD' from meta where value = ''")
def metadata_gap(spark: S, sf: str) -> DataFrame:
    return ingest.metadata_gaps(files.with_contract_id(metadata(spark, sf)), ["Sales Contract Status", "Sales Contract Company Name", "Sales Contract or Amendment Value USD"])


@query("contract_overlay", f"""with {METADATA_SQL}, latest as (select o_custkey::varchar as contract_id, arg_max(o_orderpriority, o_orderkey) as draft from orders group by 1),
    k as (select l.contract_id, unnest(['sales_contract_company_name', 'sales_contract_or_amendment_value_usd', 'sales_contract_status', 'source']) as k, unnest([m.company, nullif(m.value, ''), coalesce(nullif(m.status, ''), l.draft), 'pdf']) as v from latest l join meta m using (contract_id))
    select contract_id, string_agg(k || '=' || v, ',' order by k) as props from k where v is not null group by 1""")  # fmt: skip
def contract_overlay(spark: S, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("contract_id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("draft"))
    c = o.select("contract_id", F.create_map(F.lit("sales_contract_status"), F.col("draft"), F.lit("source"), F.lit("pdf")).alias("props"))
    over = ingest.overlaid(c, files.with_contract_id(metadata(spark, sf)))
    return over.select("contract_id", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("props"))


@query("lineage_edges", "select c_custkey::varchar as source, 'PARENT_OF' as relation, c_nationkey::varchar as target from customer union all select c_custkey::varchar, 'RELATED_TO', c_mktsegment from customer where c_mktsegment <> 'BUILDING'")
def lineage_edges(spark: S, sf: str) -> DataFrame:
    m = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("Sales Contract Parent Agreement ID"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise("").alias("Related To"), F.col("c_name").alias("Attached File"))
    return ingest.lineage_edges(m, "c_custkey", {"Sales Contract Parent Agreement ID": "PARENT_OF", "Related To": "RELATED_TO", "Attached File": "SAME_AS"})


@query("key_violations", """select l_orderkey, l_linenumber, count(*) as "count", 'duplicate' as reason from lineitem group by 1, 2 having count(*) > 1""")
def key_violations(spark: S, sf: str) -> DataFrame:
    return ingest.key_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("idempotent_events", "select sha256(event_id || '|' || user_id || '|' || event_type) as event_key, event_id from events")
def idempotent_events(spark: S, sf: str) -> DataFrame:
    """Every event comes twice, as after a retry; each has one effect."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return ingest.idempotent(e.unionByName(e), ["event_id", "user_id", "event_type"]).select("event_key", "event_id")


@query("event_keys", "select event_id, sha256(event_id || '|' || user_id) as event_key from events")
def event_keys(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", key_of(F.col("event_id"), F.col("user_id")).alias("event_key"))


def _payload(spark: S, sf: str) -> DataFrame:
    """Orders as contracts, line numbers as milestones, lines as payment terms; orders without lines have none."""
    term = F.struct(F.col("l_discount").alias("percent"), F.col("l_tax").alias("cumulative_percent"), F.col("l_extendedprice").alias("amount_usd"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("q"))
    m = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list(term)).alias("payment_terms"))
    m = m.select("l_orderkey", F.struct(F.concat(F.lit("M"), "l_linenumber").alias("name"), F.concat(F.lit("event+"), "l_linenumber").alias("date_offset"), "payment_terms").alias("m"))
    m = m.groupBy("l_orderkey").agg(F.collect_list("m").alias("milestones"))
    o = table(spark, sf, "orders").join(m, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(tag("O", "o_orderkey").alias("contract_id"), F.lit(1).alias("revision"), tag("K", "o_orderkey").alias("chunk_id"), "milestones")


_TERMS = """with terms as (select 'O' || l_orderkey as contract_id, 1 as revision, 'M' || l_linenumber as milestone, l_linenumber as line, row_number() over (partition by l_orderkey, l_linenumber order by l_discount, l_tax, l_extendedprice, l_partkey, l_suppkey, l_quantity)::integer as term_no,
    l_discount as percent, l_tax as cumulative_percent, l_extendedprice as amount_usd, 'K' || l_orderkey as source_chunk_id from lineitem semi join orders on o_orderkey = l_orderkey) """  # fmt: skip


@query("unwind_payment_terms", _TERMS + "select contract_id, revision, milestone, line as offset_days, term_no, percent, amount_usd, source_chunk_id from terms")
def unwind_payment_terms(spark: S, sf: str) -> DataFrame:
    t = revisions.unwound(_payload(spark, sf))
    return t.select("contract_id", "revision", "milestone", offset_days(F.col("date_offset")).alias("offset_days"), "term_no", "percent", "amount_usd", "source_chunk_id")


@query("last_payment_term", _TERMS + "select contract_id, revision, milestone, arg_max(amount_usd, term_no) as amount_usd, arg_max(percent, term_no) as percent from terms group by all")
def last_payment_term(spark: S, sf: str) -> DataFrame:
    return revisions.last_terms(revisions.unwound(_payload(spark, sf))).select("contract_id", "revision", "milestone", "amount_usd", "percent")


@query("cumulative_liability", """select l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(l_extendedprice::decimal(18,2)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate rows unbounded preceding)::double as cumulative from lineitem""")
def cumulative_liability(spark: S, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)"))  # noqa: E741
    c = revisions.cumulative(l, "l_orderkey", "amount", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("cumulative").cast("double").alias("cumulative"))


@query("upsert_edges", """with l as (select 'O' || l_orderkey as src_name, 'D' || l_partkey as tgt_name, l_returnflag = 'N' as old, l_returnflag as flag, l_linestatus as state, l_quantity::integer::varchar as quantity, round(1 - 5 * l_discount, 3) as confidence,
        row(l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) as seq from lineitem),
    s as (select src_name, tgt_name, arg_max(quantity, seq) as quantity, arg_max(state, seq) as state, arg_max(confidence, seq) as confidence from l where old group by 1, 2),
    b as (select src_name, tgt_name, arg_max(quantity, seq) as quantity, arg_max(flag, seq) as flag, arg_max(confidence, seq) as confidence from l where not old group by 1, 2)
    select coalesce(s.src_name, b.src_name) as src_name, coalesce(s.tgt_name, b.tgt_name) as tgt_name, concat_ws(',', 'flag=' || flag, 'quantity=' || coalesce(b.quantity, s.quantity), 'state=' || state) as props,
    coalesce(b.confidence, s.confidence) as confidence from s full join b on s.src_name = b.src_name and s.tgt_name = b.tgt_name""")  # fmt: skip
def upsert_edges(spark: S, sf: str) -> DataFrame:
    """Lines that are not returned as the stored edges, the others as a batch: its properties and confidence go over what is stored of the same ends."""
    order = F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    ends = [F.lit("Contract").alias("src_label"), tag("O", "l_orderkey").alias("src_name"), F.lit("HAS_DELIVERABLE").alias("rel_type"), F.lit("Deliverable").alias("tgt_label"), tag("D", "l_partkey").alias("tgt_name")]
    lines = table(spark, sf, "lineitem").withColumn("quantity", F.col("l_quantity").cast("int").cast("string"))
    known = lines.select(ends[0].alias("label"), ends[1].alias("canonical_name")).unionByName(lines.select(ends[3].alias("label"), ends[4].alias("canonical_name"))).distinct()
    side = lambda df, key, value: ingest.merged_edges(df.select(*ends, F.create_map(F.lit("quantity"), F.col("quantity"), F.lit(key), F.col(value)).alias("props"), confidence(F.col("l_discount")).alias("confidence"), order.alias("seq")), known)
    merged = ingest.upserted_edges(side(lines.filter("l_returnflag = 'N'"), "state", "l_linestatus"), side(lines.filter("l_returnflag <> 'N'"), "flag", "l_returnflag"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return merged.select("src_name", "tgt_name", text.alias("props"), "confidence")
