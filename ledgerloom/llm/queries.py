"""The query of each operator: whole tables, production parameters, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import divergence, fmindex, jaccard, langid, licenses, ordermin, pieces, pii, quality, repair, sharding, urls, vectors
from ledgerloom.llm.common import cut, held_out, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


SHARDS = [f"shard-{i:02d}" for i in range(32)]
SLOTS = sharding.next_prime(100 * len(SHARDS))


@query(
    "op5_sharding",
    f"""select doc_id, slot::integer as slot, {sharding.lookup_table(SHARDS, SLOTS)}[slot + 1]::integer as shard
    from (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % {SLOTS} as slot from documents)""",
)
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", SHARDS, SLOTS).select("doc_id", "slot", "shard")


URL_RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/es/"), urls.Rule("block", "net", "/fr/")]
_RULES = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
_JUDGED = """select u, host, path, (select max_by({{'text': r.host || r.path, 'verdict': r.verdict}}, length(r.host || r.path)) from rules r
    where (x.host = r.host or ends_with(x.host, '.' || r.host)) and starts_with(x.path, r.path)) as r
    from (select {url} as u, lower(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's')) as host, regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from {source}) x"""


@query(
    "op2_url_filter",
    f"""with recursive rules(verdict, host, path) as (values {_RULES}),
    links as (select regexp_replace(url, '#.*$', '') as src, url, unnest([
        regexp_extract(html, '<link [^>]*rel="canonical"[^>]*href="([^"]+)"', 1, 'i'), regexp_extract(html, '<meta [^>]*http-equiv="refresh"[^>]*url=([^">]+)', 1, 'i')]) as dst from pages),
    edges as (select src, regexp_replace(dst, '#.*$', '') as dst from links where dst <> '' union select regexp_replace(dst, '#.*$', ''), src from links where dst <> ''),
    reach(a, b) as (select src, src from edges union select r.a, e.dst from reach r join edges e on e.src = r.b),
    ends as (select distinct b as u from reach),
    judged_ends as ({_JUDGED.format(url="u", source="ends")}),
    told as (select r.a as u, case when bool_or(j.r.verdict = 'allow') then 'allow' when bool_or(j.r.verdict = 'block') then 'block' else 'allow' end as v from reach r join judged_ends j on j.u = r.b group by 1),
    own as ({_JUDGED.format(url="url", source="(select distinct url from pages)")})
    select p.page_id, coalesce(o.host, '') as host, coalesce(o.path, '') as path, o.r.text as rule, coalesce(o.r.verdict, t.v, 'allow') as verdict
    from pages p left join own o on o.u = p.url left join told t on t.u = regexp_replace(p.url, '#.*$', '')""",
)
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op10_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "pages"), "page_id", "url", "html")


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=["doc_id", "held_out"]).withColumnRenamed("lang_score", "score")


@query("op3_quality")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(quality.extract(read_table(spark, sf_dir, "documents"), "doc_id", "text"))
    labels = read_table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 5, 0))
    model = quality.train(found, labels, "doc_id", "quality")
    scored = quality.score(found, model)
    return scored.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op8_decontamination")
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = fmindex.decontaminate(docs, items, "doc_id", "text", "item_id", "text", window=10)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


@query("op1_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("op6_personal_data")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("op4_embedding_duplicates")
def embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def tokenizer_path() -> str:
    """The public 32k model; its place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_sampled_pieces")
def sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path(), k=2, digest=True).withColumnRenamed("id", "doc_id")


_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SHARE = "1 + (1000000000::hugeint * ({n} + 1)) // ({size} + {kept})"


@query(
    "op13_source_divergence",
    f"""with read as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
    words as (select lang, source, doc, unnest(regexp_extract_all(text, '{_TERMS}')) as term from read),
    kept as (select lang, term, count(*) as n from words group by 1, 2 having count(distinct doc) >= 3),
    langs as (select lang, count(*) as v, sum(n) as size from kept group by 1),
    counts as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by 1, 2, 3),
    groups as (select lang, source from read group by 1, 2),
    sizes as (select lang, source, (select coalesce(sum(n), 0) from counts c where c.lang = g.lang and c.source = g.source) as size from groups g),
    shares as (select k.lang, s.source, k.term, coalesce(c.n, 0) as n, {_SHARE.format(n="coalesce(c.n, 0)", size="s.size", kept="l.v")} as p, {_SHARE.format(n="k.n", size="l.size", kept="l.v")} as q
        from kept k join langs l using (lang) join sizes s using (lang) left join counts c on c.lang = k.lang and c.source = s.source and c.term = k.term),
    summed as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
    pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source),
    terms as (select lang, source, term as item, (p - q) * (p - q) // q as value from shares where n > 0 and p > q),
    ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
        union all (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from terms qualify rank <= 200))
    select lang, source, part, item, value::bigint as value, rank::integer as rank from ranked""",
)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


@query("op11_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(read_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


_CRC = "(select list_transform(range(256), lambda x: list_reduce(list_prepend(x, repeat([0::bigint], 8)), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)"
_STATES = "struct(c bigint, a varchar, t varchar)[]"
_INSERTED = "{{'c': {e}.c + 2, 'a': {e}.a || 'I', 't': {e}.t || '{role}:' || chr(10)}}"
_USER = f"list_min([e[3], {', '.join(_INSERTED.format(e=f'e[{k}]', role='user') for k in (1, 2, 4))}])"
_KEPT = "{{'c': case when {ok} then e[{k}].c + short else 1000000 end, 'a': e[{k}].a || 'K', 't': e[{k}].t || line}}"
_NAMED = "{{'c': case when gone then 1000000 else e[{k}].c + 2 + short end, 'a': e[{k}].a || 'R', 't': e[{k}].t || '{role}:' || text || chr(10)}}"
_GONE = "{{'c': e[{k}].c + 3, 'a': e[{k}].a || 'D', 't': e[{k}].t}}"


def _after(state: int) -> str:
    """Candidates for a state after one more row."""
    out = [_GONE.format(k=state)]
    before, role, initial = {1: ((), "", ""), 2: ((1,), "", "s"), 3: ((1, 2, 4), "user", "u"), 4: ((3,), "assistant", "a")}[state]
    out += [_KEPT.format(k=k, ok=f"not gone and initial = '{initial}'") for k in before]
    out += [_NAMED.format(k=k, role=role) for k in before if role]
    return f"list_min([{', '.join(out)}])"


@query(
    "op12_conversation_repair",
    f"""with recursive coded as (select c.conv_id, c.turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
        xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda h: ascii(h)::bigint)),
            lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 20 as code from conversations c, {_CRC}),
    damaged as (select conv_id, turn, case code when 4 then 'user' else role end as role, case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
        unnest(case code when 3 then [1, 2] else [1] end) as copy from coded where code <> 0),
    placed as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(role || ':' || text), copy) as i from damaged),
    seen as (select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
        not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') as cut, role[1] as initial, lag(role[1]) over (partition by conv_id order by i) as before from placed),
    told as (select conv_id, i, turn, text, initial, before, role || ':' || text || chr(10) as line, blank, again and not blank as duplicate, cut and not blank and not again as truncated, blank or again as gone,
        case when cut and not blank and not again then 1 else 0 end as short from seen),
    counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
        count(*) filter (truncated) as truncated, count(*) filter (i > 1 and before || initial not in ('su', 'ua', 'au')) as illegal, count(*) as n from told group by 1),
    ids as (select distinct conv_id from conversations),
    steps(conv_id, i, e) as (
        select conv_id, 0::bigint, [{{'c': 0, 'a': '', 't': ''}}, {{'c': 1000000, 'a': '', 't': ''}}, {{'c': 2, 'a': 'I', 't': 'user:' || chr(10)}}, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}}]::{_STATES} from ids
        union all
        select conv_id, i, list_append(e[1:3], list_min([e[4], {_INSERTED.format(e="e[3]", role="assistant")}]))::{_STATES} from (
            select conv_id, i, list_append(list_append(e[1:2], {_USER}), e[4])::{_STATES} as e from (
                select s.conv_id, s.i + 1 as i, [{_after(1)}, {_after(2)}, {_after(3)}, {_after(4)}]::{_STATES} as e
                from steps s join told r on r.conv_id is not distinct from s.conv_id and r.i = s.i + 1))),
    ends as (select s.conv_id, list_min([e[1], e[4]]) as best from steps s left join counts c on c.conv_id is not distinct from s.conv_id where s.i = coalesce(c.n, 0))
    select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
        coalesce(illegal, 0)::bigint as illegal, best.c as cost, best.a as audit, sha256(best.t[1:greatest(length(best.t) - 1, 0)]) as repaired_sha256
    from ids d join ends e on e.conv_id is not distinct from d.conv_id left join counts c on c.conv_id is not distinct from d.conv_id""",
)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    faulty = repair.damaged(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return repair.repair(faulty, "id", "turn", "role", "text", F.col("present")).withColumnRenamed("id", "conv_id")
