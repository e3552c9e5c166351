"""Queries on pages, the instance graph and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.names import normalize_name
from ledgerloom.functions.text import compact_props, relation_name
from ledgerloom.operators import graph, ingest, resolve, summary
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import GRAPH_SQL, HEAVY_SQL, PAGES_SQL, pages, table
from ledgerloom.plans.views import graph as instance
from ledgerloom.plans.views import heavy_edges as heavy
from ledgerloom.sources import files
from ledgerloom.sources.schemas import EDGE_TYPES, NODE_TYPES

S = SparkSession
G, P, H = f"with {GRAPH_SQL} ", f"with {PAGES_SQL} ", f"with recursive {HEAVY_SQL} "


def _vertices(spark: S, sf: str) -> DataFrame:
    return graph.vertices(*instance(spark, sf))


@query("hub_nodes", G + "select name, type, degree from g_vertices order by degree desc, seq, name limit 30")
def hub_nodes(spark: S, sf: str) -> DataFrame:
    return graph.hubs(_vertices(spark, sf))


@query("node_degree", G + "select name, type, degree from g_vertices")
def node_degree(spark: S, sf: str) -> DataFrame:
    return _vertices(spark, sf).select("name", "type", "degree")


@query("node_type_last", G + "select name, type from g_types")
def node_type_last(spark: S, sf: str) -> DataFrame:
    return graph.last_types(instance(spark, sf)[0])


@query("graph_totals", G + "select (select count(*) from g_vertices) as nodes, (select count(*) from g_edges) as edges")
def graph_totals(spark: S, sf: str) -> DataFrame:
    n, e = instance(spark, sf)
    return graph.totals(graph.vertices(n, e), e)


@query("edge_type_counts", G + 'select relation, count(*) as "count" from g_edges group by 1')
def edge_type_counts(spark: S, sf: str) -> DataFrame:
    return graph.relation_counts(instance(spark, sf)[1])


@query("isolated_nodes", "select 'O' || o_orderkey as name, 'Contract' as type from orders where o_orderkey not in (select l_orderkey from lineitem)")
def isolated_nodes(spark: S, sf: str) -> DataFrame:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    nodes = orders.select(F.concat(F.lit("O"), "o_orderkey").alias("name"), F.lit("Contract").alias("type"), F.col("o_orderkey").alias("seq"))
    edges = lines.select(F.concat(F.lit("O"), "l_orderkey").alias("source"), F.concat(F.lit("D"), "l_partkey").alias("target"), F.col("l_orderkey").alias("seq"))
    return graph.isolated(nodes, edges)


@query("connected_components", H + "select name, component from h_components")
def connected_components(spark: S, sf: str) -> DataFrame:
    return graph.components(*heavy(spark, sf))


@query(
    "component_stats",
    H + """, sizes as (select count(*) as size from h_components group by component), dist as (select size, count(*) as n from sizes group by 1)
    select sum(n)::bigint as total_components, max(size) as largest_component_size, coalesce(sum(n) filter (size = 1), 0)::bigint as num_singleton_components, string_agg(size || 'x' || n, ',' order by size desc) as size_distribution from dist""",
)
def component_stats(spark: S, sf: str) -> DataFrame:
    return graph.component_stats(graph.components(*heavy(spark, sf)))


@query("connected_components_whole")
def connected_components_whole(spark: S, sf: str) -> DataFrame:
    """Over all edges of the instance graph; ``connected_components`` has those of lines of at least 49 pieces only. A recursive SQL form takes too long here."""
    return graph.components(*instance(spark, sf))


@query("component_stats_whole")
def component_stats_whole(spark: S, sf: str) -> DataFrame:
    return graph.size_stats(graph.sizes_of_components(*instance(spark, sf)))


@query("instance_sample", G + """, located as (from g_edges where relation = 'LOCATED_IN'), degrees as (select name, count(*) as degree, min(seq) as seq from (select source as name, seq from located union all select target, seq from located) group by 1),
    top as (select d.name from degrees d left join g_types t on t.name = d.name order by degree desc, least(t.seq, d.seq) limit 120)
    select source, target, arg_max(relation, seq) as label from located where source in (from top) and target in (from top) group by 1, 2""")  # fmt: skip
def instance_sample(spark: S, sf: str) -> DataFrame:
    n, e = instance(spark, sf)
    located = e.filter("relation = 'LOCATED_IN'")
    return graph.instance_sample(graph.vertices(n, located), located)


@query("instance_sample_whole", G + """, pairs as (select source, target, arg_max(relation, seq) as label, min(seq) as seq from g_edges group by 1, 2), pair_ends as (select source as name, seq from pairs union all select target, seq from pairs),
    degrees as (select name, count(*) as degree, min(seq) as seq from pair_ends group by 1),
    top as (select coalesce(t.name, d.name) as name, coalesce(type, 'Unknown') as type from g_types t full join degrees d on t.name = d.name order by coalesce(degree, 0) desc, least(t.seq, d.seq), 1 limit 120)
    select 'node' as kind, name as source, null::varchar as target, type as label from top
    union all select 'edge', source, target, label from pairs where source in (select name from top) and target in (select name from top)""")  # fmt: skip
def instance_sample_whole(spark: S, sf: str) -> DataFrame:
    """Of the whole graph; ``instance_sample`` has the LOCATED_IN edges only."""
    return graph.sampled_graph(*instance(spark, sf))


@query("flatten_nodes", P + "select doc, page, pos::integer as pos, name, coalesce(type, 'Unknown') as type from p_nodes")
def flatten_nodes(spark: S, sf: str) -> DataFrame:
    return graph.flatten_nodes(pages(spark, sf)).select("doc", "page", "pos", "name", "type")


@query("flatten_edges", P + "select doc, page, pos::integer as pos, source, coalesce(relation, 'UNKNOWN') as relation, target from p_edges where target is not null")
def flatten_edges(spark: S, sf: str) -> DataFrame:
    return graph.flatten_edges(pages(spark, sf)).select("doc", "page", "pos", "source", "relation", "target")


@query("props_compact", P + "select doc, page, (i + 2)::integer as pos, 'quantity' as k, l_quantity::integer::varchar as v from lines union all select 'C' || o_custkey, o_orderkey::integer, 1, 'status', o_orderstatus from orders")
def props_compact(spark: S, sf: str) -> DataFrame:
    n = graph.flatten_nodes(pages(spark, sf))
    return n.select("doc", "page", "pos", F.explode(compact_props(F.col("properties"))).alias("k", "v"))


@query("normalize_relation", P + "select replace(upper(coalesce(relation, 'RELATED_TO')), ' ', '_') as relation, count(*) as n from p_edges group by 1")
def normalize_relation(spark: S, sf: str) -> DataFrame:
    e = pages(spark, sf).select(F.explode("edges").alias("e"))
    return e.groupBy(relation_name(F.coalesce("e.relation", F.lit("RELATED_TO"))).alias("relation")).agg(F.count("*").alias("n"))


@query("schema_edges", P + """, t as (select doc, page, name, arg_max(coalesce(type, 'Unknown'), seq) as type from p_nodes group by all),
    e as (select coalesce(s.type, 'Unknown') as source_type, coalesce(g.type, 'Unknown') as target_type, coalesce(relation, 'UNKNOWN') as relation, seq from p_edges e
        left join t s on s.doc = e.doc and s.page = e.page and s.name = source left join t g on g.doc = e.doc and g.page = e.page and g.name = target where target is not null)
    select source_type, target_type, arg_max(relation, seq) as label from e group by 1, 2""")  # fmt: skip
def schema_edges(spark: S, sf: str) -> DataFrame:
    return graph.page_schema_edges(ingest.page_edges(pages(spark, sf)))


@query("edge_type_first", P + """, t as (select doc, page, name, arg_min(coalesce(type, 'Unknown'), seq) as type from p_nodes group by all)
    select e.doc, e.page, e.pos::integer as pos, coalesce(s.type, 'Unknown') as src_label, coalesce(g.type, 'Unknown') as tgt_label from p_edges e
    left join t s on s.doc = e.doc and s.page = e.page and s.name = source left join t g on g.doc = e.doc and g.page = e.page and g.name = target where target is not null""")  # fmt: skip
def edge_type_first(spark: S, sf: str) -> DataFrame:
    return ingest.page_edges(pages(spark, sf)).select("doc", "page", "pos", "src_label", "tgt_label")


@query("node_type_counts", P + """select type, "count", row_number() over (order by "count" desc, first)::integer as place from (select coalesce(type, 'Unknown') as type, count(*) as "count", min(seq) as first from p_nodes group by 1)""")
def node_type_counts(spark: S, sf: str) -> DataFrame:
    return summary.type_counts(summary.all_nodes(pages(spark, sf)), "type")


@query("type_examples", P + """, f as (select 'node' as kind, coalesce(type, 'Unknown') as key, name, min(seq) as first from p_nodes group by 2, 3
        union all select 'edge', coalesce(relation, 'UNKNOWN'), source || ' -> ' || coalesce(target, '?'), min(seq) from p_edges group by 2, 3),
    r as (select *, row_number() over (partition by kind, key order by first, name) as r from f)
    select kind, key, string_agg(name, ';' order by name) as examples from r where r <= 10 group by 1, 2""")  # fmt: skip
def type_examples(spark: S, sf: str) -> DataFrame:
    p = pages(spark, sf)
    part = lambda rows, kind, key: summary.examples(rows, key).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), F.array_join("examples", ";").alias("examples"))
    return part(summary.all_nodes(p), "node", "type").unionByName(part(summary.all_edges(p), "edge", "relation"))


@query("suggested_types", "select o_orderpriority as type, string_agg(distinct o_orderstatus, ';' order by o_orderstatus) as reasons from orders group by 1")
def suggested_types(spark: S, sf: str) -> DataFrame:
    return summary.suggested(pages(spark, sf)).select("type", F.array_join("reasons", ";").alias("reasons"))


@query("edge_count_diff", P + """, a as (select coalesce(relation, 'UNKNOWN') as relation, count(*) as n from p_edges where target is not null group by 1), b as (select coalesce(relation, 'UNKNOWN') as relation, count(*) as n from p_edges group by 1)
    select coalesce(a.relation, b.relation) as relation, coalesce(a.n, 0) as raw_recount, coalesce(b.n, 0) as summary_file from a full join b on a.relation = b.relation where coalesce(a.n, 0) <> coalesce(b.n, 0)""")  # fmt: skip
def edge_count_diff(spark: S, sf: str) -> DataFrame:
    p = pages(spark, sf)
    return graph.count_differences(graph.relation_counts(graph.flatten_edges(p)), summary.type_counts(summary.all_edges(p), "relation"))


@query("relation_union", G + f", {PAGES_SQL} select relation from g_edges union select coalesce(relation, 'UNKNOWN') from p_edges where target is not null")
def relation_union(spark: S, sf: str) -> DataFrame:
    return graph.relation_union(instance(spark, sf)[1], graph.flatten_edges(pages(spark, sf)))


_OFF = ", ".join(f"'{x}'" for x in NODE_TYPES), ", ".join(f"'{x}'" for x in EDGE_TYPES)


@query("off_ontology_types", G + f""" select 'node' as kind, type as name, count(*) as "count" from g_vertices where type not in ({_OFF[0]}) group by 2 union all select 'edge', relation, count(*) from g_edges where relation not in ({_OFF[1]}) group by 2""")
def off_ontology_types(spark: S, sf: str) -> DataFrame:
    n, e = instance(spark, sf)
    nodes = ingest.off_ontology_nodes(graph.vertices(n, e)).select(F.lit("node").alias("kind"), F.col("type").alias("name"), "count")
    return nodes.unionByName(ingest.off_ontology_edges(e).select(F.lit("edge").alias("kind"), F.col("relation").alias("name"), "count"))


_SUFFIXES = ["  Inc.", " L.L.C.", " Aerospace Group", " Holdings, Ltd."]
_WORDS = r"inc|incorporated|llc|l\.l\.c|corp|corporation|co|company|ltd|limited|international|aerospace|space|group|holdings"
_NORM_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '\b(" + _WORDS + r")\b\.?', '', 'g'), '[.,]', '', 'g'), '\s+', ' ', 'g'))"


@query("normalize_name", "select c_custkey, " + _NORM_SQL.format("c_name || ['  Inc.', ' L.L.C.', ' Aerospace Group', ' Holdings, Ltd.'][c_custkey % 4 + 1]") + " as norm from customer")
def normalized(spark: S, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*(F.lit(x) for x in _SUFFIXES)), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", normalize_name(F.concat("c_name", suffix)).alias("norm"))


def _parts(spark: S, sf: str) -> DataFrame:
    """Distinct part names, half of them with a legal word, as vertices of their brand's type."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("type"), F.when(F.col("p_size") > 25, F.concat("p_name", F.lit(", Inc."))).otherwise(F.col("p_name")).alias("name"), "p_partkey")
    return p.groupBy("type", "name").agg(F.count("*").alias("degree"), F.min("p_partkey").alias("seq"))


_PARTS_SQL = """parts as (select p_brand as type, case when p_size > 25 then p_name || ', Inc.' else p_name end as name, count(*) as degree, min(p_partkey) as seq from part group by 1, 2),
    n as (select *, """ + _NORM_SQL.format("name") + " as norm from parts)"  # fmt: skip


@query("dup_exact", f"with {_PARTS_SQL} select a.type, a.name as name_a, b.name as name_b, 1.0::double as similarity, a.degree as degree_a, b.degree as degree_b from n a join n b on a.type = b.type and a.norm = b.norm and a.seq < b.seq where a.norm <> ''")
def dup_exact(spark: S, sf: str) -> DataFrame:
    return resolve.exact_pairs(resolve.named(_parts(spark, sf))).select("type", "name_a", "name_b", "similarity", "degree_a", "degree_b")


@query("dup_contained", f"""with {_PARTS_SQL}, d as (select distinct type, norm from n where norm <> '') select a.type, a.norm as short, b.norm as long from d a join d b on a.type = b.type and a.norm <> b.norm and contains(b.norm, a.norm)""")
def dup_contained(spark: S, sf: str) -> DataFrame:
    return resolve.contained_norms(resolve.named(_parts(spark, sf)).select("type", "norm").distinct())


@query("dup_fuzzy")
def dup_fuzzy(spark: S, sf: str) -> DataFrame:
    return resolve.duplicates(_parts(spark, sf))


@query("resolve_entities")
def resolve_entities(spark: S, sf: str) -> DataFrame:
    names = _parts(spark, sf).select("type", "name", "seq")
    ordered = resolve.resolve_in_order(names).withColumnRenamed("canonical", "in_order")
    return ordered.join(resolve.resolve_by_links(names).withColumnRenamed("canonical", "by_links"), ["type", "name"])


@query("fuzzy_reference_review")
def fuzzy_reference_review(spark: S, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    refs = p.select(F.col("p_partkey").alias("ref"), (F.col("p_size") % 2).alias("revision"), F.concat("p_name", F.lit("s Inc.")).alias("title"))
    return resolve.ambiguous(refs, p.select((F.col("p_size") % 2).alias("revision"), F.col("p_name").alias("title")).distinct())


@query("scan_candidates", "select 'C' || o_custkey as doc, count(*) as pages, count(distinct o_orderkey) as distinct_pages from orders group by 1")
def scan_candidates(spark: S, sf: str) -> DataFrame:
    p = pages(spark, sf).withColumn("doc", files.doc_of(F.concat("doc", F.lit(files.CANDIDATES))))
    return p.groupBy("doc").agg(F.count("*").alias("pages"), F.count_distinct("page").alias("distinct_pages"))


@query("path_dedupe", "select url, min(page_id) as seq from pages group by 1")
def path_dedupe(spark: S, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("url", F.col("page_id").alias("seq"))
    return files.distinct_paths(p.unionByName(p.withColumn("seq", F.col("seq") + 1_000_000_000)), "url")


@query("scan_limit", "select url, page_id from pages order by url, page_id limit 25")
def scan_limit(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url", "page_id").orderBy("url", "page_id").limit(25)


@query("incremental_skip", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def incremental_skip(spark: S, sf: str) -> DataFrame:
    return files.not_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("base64_payload", "select page_id, base64(url::blob) as payload from pages")
def base64_payload(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", files.payload(F.col("url").cast("binary")).alias("payload"))


@query("trace_sites", f"""with recursive {GRAPH_SQL}, e as (select source, target from g_edges union select target, source from g_edges),
    near(start, name, depth) as (select name, name, 0 from g_nodes where name like 'R %' union select n.start, e.target, n.depth + 1 from near n join e on e.source = n.name where n.depth < 3)
    select start, name, min(depth) as depth from near group by 1, 2""")  # fmt: skip
def trace_sites(spark: S, sf: str) -> DataFrame:
    """Sites, parties and contracts within three edges of each region."""
    nodes, edges = instance(spark, sf)
    return graph.expand(nodes.filter("name like 'R %'").select("name"), edges, 3, directed=False)


@query("isolated_nodes_whole", f"with {GRAPH_SQL} select name, arg_max(type, seq) as type from g_nodes where name not in (select name from g_ends) group by 1")
def isolated_nodes_whole(spark: S, sf: str) -> DataFrame:
    """Over the whole graph; ``isolated_nodes`` asks about orders and their lines only."""
    return graph.isolated(*instance(spark, sf)).select("name", "type")
