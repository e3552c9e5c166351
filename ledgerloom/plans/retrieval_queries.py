"""Queries on retrieval, access, monitoring and event feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import typed
from ledgerloom.operators import drift, retrieval, vector_index
from ledgerloom.plans.registry import query
from ledgerloom.plans.views import table
from ledgerloom.streaming import jobs

S = SparkSession


def _queries(spark: S, sf: str) -> DataFrame:
    """The vector with the least id of each label asks for its neighbours; labels are few."""
    return table(spark, sf, "embeddings").groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("x")).select(F.col("x.vec_id").alias("query_id"), F.col("label").alias("asked"), F.col("x.embedding").alias("q"))


_Q = "with q as (select label as asked, min(vec_id) as query_id, arg_min(embedding, vec_id)::double[] as q from embeddings group by 1), "
_SCORED = "s as (select query_id, asked, vec_id, label, list_cosine_similarity(q, embedding::double[]) as score from q, embeddings) "


@query("vector_topk", _Q + _SCORED + """, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where label = asked) select query_id, vec_id, rank::integer as rank, round(score, 4) as score from r where rank <= 8""")
def vector_topk(spark: S, sf: str) -> DataFrame:
    hits = retrieval.topk(_queries(spark, sf), table(spark, sf, "embeddings"), 8, F.col("label") == F.col("asked"))
    return hits.withColumn("score", F.round("score", 4))


@query("vector_topk_all", _Q + _SCORED + """, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, vec_id, rank::integer as rank, round(score, 4) as score from r where rank <= 10""")
def vector_topk_all(spark: S, sf: str) -> DataFrame:
    return retrieval.topk(_queries(spark, sf), table(spark, sf, "embeddings"), 10).withColumn("score", F.round("score", 4))


def _all_queries(spark: S, sf: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks; so their number grows with the table."""
    return table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"), F.col("embedding").alias("q"))


_Q20 = "with q as (select label as asked, vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0), "


@query("vector_topk_whole", _Q20 + _SCORED + """, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s where label = asked) select query_id, vec_id, rank::integer as rank, round(score, 4) as score from r where rank <= 8""")
def vector_topk_whole(spark: S, sf: str) -> DataFrame:
    hits = retrieval.topk_blocks(_all_queries(spark, sf), table(spark, sf, "embeddings"), 8, ("asked", "label"))
    return hits.withColumn("score", F.round("score", 4))


@query("vector_topk_all_whole", _Q20 + _SCORED + """, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, vec_id, rank::integer as rank, round(score, 4) as score from r where rank <= 10""")
def vector_topk_all_whole(spark: S, sf: str) -> DataFrame:
    return retrieval.topk_blocks(_all_queries(spark, sf), table(spark, sf, "embeddings"), 10).withColumn("score", F.round("score", 4))


@query("vector_index_topk", _Q20 + _SCORED + """, r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) select query_id, vec_id, rank::integer as rank, round(score, 4) as score from r where rank <= 10""")
def vector_index_topk(spark: S, sf: str) -> DataFrame:
    """The rows of ``vector_topk_all_whole`` from an index of inverted lists, which leaves out cells that cannot hold a neighbour."""
    index = vector_index.build(table(spark, sf, "embeddings"))
    return vector_index.search(_all_queries(spark, sf), index, 10).withColumn("score", F.round("score", 4))


@query("current_chunk_search", """with v as (select vec_id, label, embedding::double[] as embedding, count(*) over (partition by label order by vec_id) as revision, count(*) over (partition by label) as top from embeddings),
    current as (select vec_id, embedding from v where top - revision < top // 2 and label in (select distinct n_nationkey % 10 from nation where n_regionkey > 0)),
    q as (select vec_id as query_id, embedding::double[] as q from embeddings where vec_id % 20 = 0),
    r as (select query_id, vec_id, list_cosine_similarity(q, embedding) as score, row_number() over (partition by query_id order by list_cosine_similarity(q, embedding) desc, vec_id) as rank from q, current)
    select query_id, vec_id, rank::integer as rank, round(score, 4) as score from r where rank <= 8""")  # fmt: skip
def current_chunk_search(spark: S, sf: str) -> DataFrame:
    """Search restricted to some contracts and to current text: a label's newer half of vectors is what is not superseded."""
    w = Window.partitionBy("label")
    v = table(spark, sf, "embeddings").withColumns({"revision": F.row_number().over(w.orderBy("vec_id")), "top": F.count("*").over(w)})
    chunks = v.select("vec_id", "embedding", F.col("label").alias("contract_id"), (F.col("top") - F.col("revision") >= F.floor(F.col("top") / 2)).alias("superseded"))
    contracts = table(spark, sf, "nation").filter("n_regionkey > 0").select((F.col("n_nationkey") % 10).alias("contract_id")).distinct()
    hits = retrieval.topk_blocks(_all_queries(spark, sf), retrieval.current_chunks(chunks, contracts), 8)
    return hits.withColumn("score", F.round("score", 4))


@query("truncate_embedding", "with h as (select vec_id, embedding[1:16]::double[] as h from embeddings) select vec_id, round(h[1] / sqrt(list_dot_product(h, h)), 6) as first, round(h[16] / sqrt(list_dot_product(h, h)), 6) as last, len(h)::integer as dims from h")
def truncate_embedding(spark: S, sf: str) -> DataFrame:
    t = table(spark, sf, "embeddings").select("vec_id", retrieval.truncated(F.col("embedding"), 16).alias("t"))
    return t.select("vec_id", F.round(F.col("t")[0], 6).alias("first"), F.round(F.col("t")[15], 6).alias("last"), F.size("t").alias("dims"))


_FACTS = """facts as (select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey in (select l_orderkey from lineitem join part on p_partkey = l_partkey where p_size >= 45)) """


def _facts(spark: S, sf: str) -> DataFrame:
    """Orders' prices as facts of contracts of which a line (clause) refers to a large part (document)."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contract_id"), "o_custkey", "o_totalprice")
    clauses = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_partkey").alias("clause_id"))
    documents = table(spark, sf, "part").filter("p_size >= 45").select(F.col("p_partkey").alias("clause_id"))
    return retrieval.facts(orders.select("contract_id"), clauses, documents, orders)


@query("fact_lookup", f"with {_FACTS} select o_orderkey as contract_id, o_custkey, o_totalprice from facts")
def fact_lookup(spark: S, sf: str) -> DataFrame:
    return _facts(spark, sf)


@query("hybrid_search", _Q + _SCORED + f""", r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s), {_FACTS}, per as (select o_custkey, count(*) as facts, max(o_orderkey) as cited from facts group by 1)
    select query_id, vec_id, rank::integer as rank, coalesce(facts, 0) as facts, cited as source_chunk_id from r left join per on o_custkey = vec_id where rank <= 8""")  # fmt: skip
def hybrid_search(spark: S, sf: str) -> DataFrame:
    return _with_facts(spark, sf, retrieval.topk(_queries(spark, sf), table(spark, sf, "embeddings"), 8))


@query("hybrid_search_whole", _Q20 + _SCORED + f""", r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s), {_FACTS}, per as (select o_custkey, count(*) as facts, max(o_orderkey) as cited from facts group by 1)
    select query_id, vec_id, rank::integer as rank, coalesce(facts, 0) as facts, cited as source_chunk_id from r left join per on o_custkey = vec_id where rank <= 8""")  # fmt: skip
def hybrid_search_whole(spark: S, sf: str) -> DataFrame:
    return _with_facts(spark, sf, retrieval.topk_blocks(_all_queries(spark, sf), table(spark, sf, "embeddings"), 8))


def _with_facts(spark: S, sf: str, hits: DataFrame) -> DataFrame:
    per = _facts(spark, sf).groupBy(F.col("o_custkey").alias("vec_id")).agg(F.count("*").alias("facts"), F.max("contract_id").alias("source_chunk_id"))
    return retrieval.hybrid(hits, per, "vec_id").select("query_id", "vec_id", "rank", F.coalesce("facts", F.lit(0)).alias("facts"), "source_chunk_id")


@query("route_questions", r"""select conv_id, turn, case when regexp_matches(lower(text), '[$%]') or regexp_matches(lower(text), '\b\d{4}-\d{2}-\d{2}\b|(^| )(de|que|und)( |$)') or regexp_matches(lower(text), '(^| )(to|thing)( |$)') then 'hybrid' else 'vector' end as route from conversations where role = 'user'""")
def route_questions(spark: S, sf: str) -> DataFrame:
    """The signals are words that occur in the driver's invented prose; production's are the function's defaults."""
    q = table(spark, sf, "conversations").filter("role = 'user'")
    return q.select("conv_id", "turn", retrieval.route(F.col("text"), dates=r"\b\d{4}-\d{2}-\d{2}\b|(^| )(de|que|und)( |$)", totals=r"(^| )(to|thing)( |$)").alias("route"))


@query("party_obligations", "select c_name, n_name, count(*) as obligations, count(distinct l_orderkey) as contracts from customer join nation on c_nationkey = n_nationkey join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by 1, 2")
def party_obligations(spark: S, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    per = o.groupBy("o_custkey").agg(F.sum("n").alias("obligations"), F.count("*").alias("contracts"))
    return c.join(per, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "n_name", "obligations", "contracts")


@query("acl_filter", "select c_custkey, c_mktsegment from customer where (c_nationkey, c_mktsegment) in (select distinct s_nationkey, case when s_acctbal > 5000 then 'BUILDING' else 'MACHINERY' end from supplier)")
def acl_filter(spark: S, sf: str) -> DataFrame:
    grants = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise("MACHINERY").alias("c_mktsegment")).distinct()
    return retrieval.allowed(table(spark, sf, "customer"), grants, ["c_nationkey", "c_mktsegment"]).select("c_custkey", "c_mktsegment")


@query("governance_filter", "select o_orderkey, o_orderpriority from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY') and o_orderstatus <> 'P'")
def governance_filter(spark: S, sf: str) -> DataFrame:
    marked = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").filter("o_orderstatus <> 'P'").join(marked, "o_custkey", "left_semi").select("o_orderkey", "o_orderpriority")


@query("eval_accuracy", "select lang, count(*) as n, round(avg(case when (n_chars > 1000)::integer = quality then 1.0 else 0.0 end), 6) as accuracy from documents join labels using (doc_id) group by 1")
def eval_accuracy(spark: S, sf: str) -> DataFrame:
    """A rule's answers against the evaluation set."""
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).cast("int").alias("answer")).join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg((F.col("answer") == F.col("quality")).cast("double")), 6).alias("accuracy"))


def _events(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("event_monitor_tumbling", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n from events group by 1, 2")
def event_monitor_tumbling(spark: S, sf: str) -> DataFrame:
    return jobs.tumbling(_events(spark, sf), "1 hour", "event_type").select("start", "event_type", "n")


@query("session_usage", """with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 1 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as new from events),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as k from e) select user_id, min(ts) as start, max(ts) + interval 1 hour as "end", count(*) as n from s group by user_id, k""")  # fmt: skip
def session_usage(spark: S, sf: str) -> DataFrame:
    return jobs.sessions(_events(spark, sf), "1 hour", "user_id").select("user_id", "start", "end", "n")


@query("backfill_cutover", "select event_type, count(*) as n, min(event_id) as first, max(event_id) as last from events group by 1")
def backfill_cutover(spark: S, sf: str) -> DataFrame:
    """History and a live feed that overlap; the cutover takes each event once."""
    e = _events(spark, sf)
    both = jobs.cutover(e, e, F.lit("2024-01-15").cast("timestamp_ntz"))
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("dead_letter", "select event_id, 'no contract_id' as reason from events where (props::json->>'k')::integer < 10")
def dead_letter(spark: S, sf: str) -> DataFrame:
    """Events without a contract go to review; a k below 10 stands for none here."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf, "events").withColumn("contract_id", F.when(k >= 10, F.concat(F.lit("C-"), k.cast("string"))))
    return jobs.dead_letters(e, "contract_id")[1].select("event_id", "reason")


@query("usage_drift", "select user_id, count(*) as n, round(sum(value), 4) as total from events group by 1")
def usage_drift(spark: S, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("usage_stability")
def usage_stability(spark: S, sf: str) -> DataFrame:
    """Drift of the events' values between weeks, by type; sketches are random within their bounds, so SQL gives no equal rows."""
    e = _events(spark, sf)
    found = drift.stability(drift.sketches(e, ["event_type"], F.date_trunc("week", "ts"), "value"), ["event_type"])
    return found.select("event_type", "period", "before", "n", "stability", "verdict")


@query("typed_leaves", """with leaves as (select o_orderstatus, case when o_orderstatus = 'P' then o_orderpriority else '$' || format('{:,.2f}', o_totalprice) end as amount, case when o_orderpriority = '5-LOW' then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end as day from orders),
    typed as (select o_orderstatus, try_cast(replace(replace(amount, '$', ''), ',', '') as decimal(18,2)) as amount, try_cast(day as date) as day from leaves)
    select o_orderstatus, count(*) as n, sum(amount)::double as total, count(*) filter (amount is null) as bad_amounts, min(day) as first_day, count(*) filter (day is null) as bad_days from typed group by 1""")  # fmt: skip
def typed_leaves(spark: S, sf: str) -> DataFrame:
    """Amounts and dates that properties hold as text: what does not fit is null and counted."""
    o = table(spark, sf, "orders")
    amount = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
    day = F.when(F.col("o_orderpriority") == "5-LOW", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    p = o.select("o_orderstatus", F.to_json(F.struct(amount.alias("amount"), day.alias("date"))).alias("properties"))
    leaves = p.withColumn("v", typed.variant(F.col("properties"))).select("o_orderstatus", typed.leaf(F.col("v"), "$.amount").alias("amount"), typed.leaf(F.col("v"), "$.date").alias("date"))
    t = leaves.withColumns({"value": typed.money(F.col("amount")), "day": typed.date(F.col("date"))})
    return t.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.sum("value").cast("double").alias("total"), F.count_if(typed.bad(F.col("amount"), F.col("value"))).alias("bad_amounts"),
        F.min("day").alias("first_day"), F.count_if(typed.bad(F.col("date"), F.col("day"))).alias("bad_days"),
    )
