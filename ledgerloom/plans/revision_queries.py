"""Queries on revisions, chunks and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import chunk_hash, key_of
from ledgerloom.operators import asof, chunks, graph, references, revisions
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import CHUNK_VERSIONS_SQL, LINES_SQL, NORM_SQL, VERSIONS_SQL, chunk_versions, lines_of_documents, table, versions

S = SparkSession
V, C, L = f"with {VERSIONS_SQL} ", f"with {CHUNK_VERSIONS_SQL} ", f"with {LINES_SQL} "


@query("version_chain", V + "select contract_id, revision, lag(revision) over (partition by contract_id order by revision) as supersedes from versions")
def version_chain(spark: S, sf: str) -> DataFrame:
    return revisions.chain(versions(spark, sf)).select("contract_id", "revision", "supersedes")


@query("latest_version", V + "select contract_id, max(revision) as revision, arg_max(order_key, revision) as order_key from versions group by 1")
def latest_version(spark: S, sf: str) -> DataFrame:
    return revisions.latest(versions(spark, sf), "order_key")


@query("superseded_flag", V + "select contract_id, revision, revision < max(revision) over (partition by contract_id) as superseded from versions")
def superseded_flag(spark: S, sf: str) -> DataFrame:
    return revisions.superseded(versions(spark, sf)).select("contract_id", "revision", "superseded")


@query("version_asof", V + "select contract_id, max(revision) as revision, arg_max(freeze_ts, revision) as freeze_ts from versions where freeze_ts <= timestamp '1996-01-01' group by 1")
def version_asof(spark: S, sf: str) -> DataFrame:
    return revisions.as_of(versions(spark, sf), F.lit("1996-01-01").cast("timestamp_ntz"))


@query("version_walk", V + """, w as (select contract_id, max(revision) as newest from versions group by 1) select contract_id, newest as start, revision, newest - revision as depth from versions join w using (contract_id)""")
def version_walk(spark: S, sf: str) -> DataFrame:
    """Every step back from a contract's newest revision over SUPERSEDES, by doubling steps."""
    v = revisions.chain(versions(spark, sf))
    place = lambda c: F.struct("contract_id", F.col(c).alias("revision"))
    steps = v.filter("supersedes is not null").select(place("revision").alias("id"), place("supersedes").alias("up"))
    walked = graph.walk(steps, revisions.latest(v).select(place("revision").alias("id")))
    return walked.select("start.contract_id", F.col("start.revision").alias("start"), F.col("id.revision").alias("revision"), F.col("depth").cast("int").alias("depth"))


@query("line_version_asof", V + """, e as (select l_orderkey, l_linenumber, o_custkey as contract_id, l_shipdate as at from lineitem join orders on o_orderkey = l_orderkey),
    v as (select contract_id, freeze_ts, max(revision) as revision, arg_max(order_key, revision) as order_key from versions group by 1, 2)
    select e.l_orderkey, e.l_linenumber, v.revision, v.order_key from e asof left join v on e.contract_id = v.contract_id and e.at >= v.freeze_ts""")  # fmt: skip
def line_version_asof(spark: S, sf: str) -> DataFrame:
    """The revision of its contract that was current when a line was shipped."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("contract_id"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(orders, "l_orderkey")
    found = asof.as_of_join(lines, versions(spark, sf), ["contract_id"], "l_shipdate", "freeze_ts", ["revision", "order_key"], days=90)
    return found.select("l_orderkey", "l_linenumber", "revision", "order_key")


@query("chunk_hash", L + "select doc_id, pos, sha256(" + NORM_SQL.format("line") + ") as chunk_hash from doc_lines")
def chunk_hashes(spark: S, sf: str) -> DataFrame:
    return lines_of_documents(spark, sf).select("doc_id", "pos", chunk_hash(F.col("line")).alias("chunk_hash"))


@query("chunk_id", L + "select doc_id, pos, sha256(doc_id || '|1|body|' || pos) as chunk_id from doc_lines")
def chunk_ids(spark: S, sf: str) -> DataFrame:
    return lines_of_documents(spark, sf).select("doc_id", "pos", key_of(F.col("doc_id"), F.lit(1), F.lit("body"), F.col("pos")).alias("chunk_id"))


@query("chunk_change_detect", C + "select contract_id, revision, chunk_hash, status from changes")
def chunk_change_detect(spark: S, sf: str) -> DataFrame:
    return revisions.chunk_changes(chunk_versions(spark, sf))


@query("freeze_audit_log", C + """select contract_id, revision, count(*) filter (status = 'new') as added, count(*) filter (status = 'removed') as removed, count(*) filter (status = 'reused') as reused, count(*) filter (status <> 'reused') as changed,
    'rev ' || revision || ': ' || added || ' added, ' || removed || ' removed, ' || reused || ' reused' as summary from changes group by 1, 2""")  # fmt: skip
def freeze_audit_log(spark: S, sf: str) -> DataFrame:
    return revisions.audit(revisions.chunk_changes(chunk_versions(spark, sf)))


@query("chunk_setdiff", C + """, a as (select chunk_hash from chunk_versions where revision = 2), b as (select chunk_hash from chunk_versions where revision = 1)
    select chunk_hash, 'added' as change from (from a except all from b) union all select chunk_hash, 'removed' from (from b except all from a) union all select chunk_hash, 'kept' from (from a intersect from b)""")  # fmt: skip
def chunk_setdiff(spark: S, sf: str) -> DataFrame:
    c = chunk_versions(spark, sf)
    return revisions.set_difference(c.filter("revision = 2").select("chunk_hash"), c.filter("revision = 1").select("chunk_hash"))


@query("embedding_reuse", L + """, h as (select doc_id, pos, sha256(""" + NORM_SQL.format("line") + """) as chunk_hash from doc_lines), first as (select chunk_hash, min(doc_id) as doc from h group by 1) select count(*) filter (doc < doc_id) as reused, count(*) filter (doc = doc_id) as fresh from h join first using (chunk_hash)""")
def embedding_reuse(spark: S, sf: str) -> DataFrame:
    """Lines whose text an earlier document has need no new embedding."""
    h = lines_of_documents(spark, sf).select("doc_id", chunk_hash(F.col("line")).alias("chunk_hash"))
    first = h.groupBy("chunk_hash").agg(F.min("doc_id").alias("doc"))
    j = h.join(first, "chunk_hash")
    return j.agg(F.count(F.when(F.col("doc") < F.col("doc_id"), 1)).alias("reused"), F.count(F.when(F.col("doc") == F.col("doc_id"), 1)).alias("fresh"))


@query("boilerplate_chunks", L + """, h as (select doc_id, sha256(""" + NORM_SQL.format("line") + """) as chunk_hash from doc_lines) select chunk_hash, count(distinct doc_id) as documents, count(*) as lines from h group by 1 having count(distinct doc_id) >= 3""")
def boilerplate_chunks(spark: S, sf: str) -> DataFrame:
    return chunks.boilerplate(lines_of_documents(spark, sf), "doc_id", F.col("line"), 3)


_HEADING = "length(line) <= 60"
_SECTIONS = L + f""", s as (select *, sum(case when {_HEADING} then 1 else 0 end) over w as section, last_value(case when {_HEADING} then line end ignore nulls) over w as section_path from doc_lines window w as (partition by doc_id order by pos rows unbounded preceding)) """


@query("section_path", _SECTIONS + "select doc_id, pos, section::bigint as section, section_path from s")
def section_path(spark: S, sf: str) -> DataFrame:
    return chunks.sectioned(lines_of_documents(spark, sf), "doc_id", F.length("line") <= 60).select("doc_id", "pos", "section", "section_path")


@query("structure_chunks", _SECTIONS + ", g as (select doc_id, section, max(section_path) as p, string_agg(line, chr(10) order by pos) as text, count(*) as n_lines from s group by 1, 2) select doc_id, section::bigint as section, n_lines, sha256(" + NORM_SQL.format("text") + ") as chunk_hash, sha256(doc_id || '|' || coalesce(p || '|', '') || section) as chunk_id from g")
def structure_chunks(spark: S, sf: str) -> DataFrame:
    s = chunks.sectioned(lines_of_documents(spark, sf), "doc_id", F.length("line") <= 60)
    return chunks.structure_chunks(s, "doc_id").select("doc_id", "section", "n_lines", "chunk_hash", "chunk_id")


@query("chunk_content_type", r"""select doc_id, case when regexp_matches(text, '(?i)\b(signed by|signature|/s/)') then 'signature' when length(text) - length(replace(text, '|', '')) >= 3 then 'table'
    when regexp_matches(text, '(?m)^[^:\n]{1,40}:\s*\S') then 'form' when regexp_matches(text, '(?i)licen[sc]|all rights reserved|confidential') then 'boilerplate' else 'prose' end as content_type from documents""")  # fmt: skip
def chunk_content_type(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", chunks.content_type(F.col("text")).alias("content_type"))


@query("table_row_groups", """with r as (select l_orderkey, l_partkey || ' | ' || l_quantity::integer as line, row_number() over (partition by l_orderkey order by l_partkey, l_quantity::integer, l_suppkey, l_linenumber, l_extendedprice) - 1 as i from lineitem)
    select l_orderkey, (i // 3)::integer as part, 'part | quantity' || chr(10) || string_agg(line, chr(10) order by i) as text from r group by 1, 2""")  # fmt: skip
def table_row_groups(spark: S, sf: str) -> DataFrame:
    row = F.struct("l_partkey", F.col("l_quantity").cast("int").alias("q"), "l_suppkey", "l_linenumber", "l_extendedprice")
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    t = t.select("l_orderkey", F.lit("part | quantity").alias("header"), F.transform("r", lambda x: F.concat_ws(" | ", x["l_partkey"].cast("string"), x["q"].cast("string"))).alias("rows"))
    return chunks.row_groups(t, "l_orderkey", 3)


def _forms(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.concat_ws("\n", F.concat(F.lit("Name: "), "c_name"), F.concat(F.lit("Segment:  "), "c_mktsegment"), F.lit("no field here"), F.concat(F.lit("Signed by "), "c_name", F.lit(" on 2024-01-"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 2, "0"))).alias("text"))


@query("form_fields", "select c_custkey, 'Name' as field, c_name as value from customer union all select c_custkey, 'Segment', c_mktsegment from customer")
def form_fields(spark: S, sf: str) -> DataFrame:
    return chunks.form_fields(_forms(spark, sf), "c_custkey", "text")


@query("signature_edges", "select replace(c_name, '#', '-') as source, 'SIGNED' as relation, c_custkey::varchar as target, make_date(2024, 1, c_nationkey + 1) as signed_on from customer")
def signature_edges(spark: S, sf: str) -> DataFrame:
    d = _forms(spark, sf).withColumn("text", F.replace("text", F.lit("#"), F.lit("-")))
    return chunks.signature_edges(d, "c_custkey", "text")


_REFS = r"""with cites as (select page_id as ref, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) as number from pages), keyed as (select ref, number, regexp_replace(lower(number), '[^a-z0-9]', '', 'g') as key from cites),
    docs as (select regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g') as key, c_mktsegment as number from customer union all select regexp_replace(lower(split_part(text, ' ', 1)), '[^a-z0-9]', '', 'g'), split_part(text, ' ', 1) from documents),
    d as (select key, min(number) as document from docs where key <> '' group by 1) """


def _citations(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "pages").select(F.col("page_id").alias("ref"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), 1)).alias("number"))
    d = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("number")).unionByName(table(spark, sf, "documents").select(F.split_part("text", F.lit(" "), F.lit(1)).alias("number")))
    return c, d


@query("resolve_references", _REFS + "select ref, k.key, document, case when document is null then 'Unresolved' else 'Document' end as status from keyed k left join d on d.key = k.key")
def resolve_references(spark: S, sf: str) -> DataFrame:
    return references.resolve(*_citations(spark, sf))


@query("relink_placeholders", _REFS + """, open as (select ref, k.key from keyed k left join d on d.key = k.key where document is null), late as (select regexp_replace(lower(number), '[^a-z0-9]', '', 'g') as key, min(number) as document from (select split_part(text, ' ', 2) as number from documents) group by 1)
    select ref, o.key, document, 'Document' as status from open o join late l on l.key = o.key and l.key <> ''""")  # fmt: skip
def relink_placeholders(spark: S, sf: str) -> DataFrame:
    pending = references.resolve(*_citations(spark, sf)).filter("status = 'Unresolved'")
    arrived = table(spark, sf, "documents").select(F.split_part("text", F.lit(" "), F.lit(2)).alias("number"))
    return references.relink(pending, arrived)


@query("unresolved_aging", "select case when d < 30 then 'under 30' when d < 60 then '30 to 59' else '60 or more' end as bucket, count(*) as n from (select date_diff('day', ts::date, date '2024-02-25') as d from events) group by 1")
def unresolved_aging(spark: S, sf: str) -> DataFrame:
    return references.ageing(table(spark, sf, "events").withColumnRenamed("ts", "first_seen"), F.lit("2024-02-25").cast("date"))


@query("shared_reference_pairs", "with d as (select distinct l_orderkey as c, l_partkey as d from lineitem where l_quantity >= 49) select a.c as left, b.c as right, count(*) as shared from d a join d b on a.d = b.d and a.c < b.c group by 1, 2")
def shared_reference_pairs(spark: S, sf: str) -> DataFrame:
    return references.sharing_pairs(table(spark, sf, "lineitem").filter("l_quantity >= 49"), "l_orderkey", "l_partkey")


@query("shared_reference_pairs_whole", "with d as (select distinct l_orderkey as c, l_partkey as d from lineitem) select a.c as left, b.c as right, count(*) as shared from d a join d b on a.d = b.d and a.c < b.c group by 1, 2")
def shared_reference_pairs_whole(spark: S, sf: str) -> DataFrame:
    """Over all lines; ``shared_reference_pairs`` has those of at least 49 pieces only."""
    return references.sharing_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
