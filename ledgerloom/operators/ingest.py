"""Ingestion: page-local lookups, confidence, and upserts as aggregations over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import compact_props, key_of, present, property_name, relation_name
from ledgerloom.sources.schemas import CONFIDENCE_THRESHOLD, DEFAULT_CONFIDENCE, EDGE_TYPES, METADATA_FIELDS, NODE_TYPES, OVERLAY_FIELDS

EDGE_KEY = ["src_label", "src_name", "rel_type", "tgt_label", "tgt_name"]


def page_edges(pages: DataFrame) -> DataFrame:
    """As ``graph.flatten_edges``, with what each edge's own page says of its ends, looked up in the page's arrays: no row leaves its task.

    ``src_label`` and ``tgt_label`` are the types of a name's first declaration in the page, ``src_last`` and ``tgt_last`` those of its last one;
    an end that the page does not declare is Unknown, as is one without a type. Nodes may carry a field ``canonical``: then ``src_name`` and
    ``tgt_name`` are the last canonical name that the page gives, else the names as they stand.
    """
    resolved = any(f.name == "canonical" for f in pages.schema["nodes"].dataType.elementType.fields)
    declared = F.filter("nodes", lambda n: n["name"] != "")
    lists = {"names": lambda n: n["name"], "types": lambda n: F.coalesce(n["type"], F.lit("Unknown")), "canonical": lambda n: n["canonical" if resolved else "name"]}
    listed = pages.select("doc", "page", "edges", declared.alias("declared")).select("doc", "page", "edges", *(F.transform("declared", f).alias(c) for c, f in lists.items()))
    both = listed.select("*", *(F.reverse(c).alias(f"{c}_back") for c in lists))
    at = lambda names, end: F.array_position(names, end).cast("int") - 1
    look = lambda values, names, end, other: F.coalesce(F.get(values, at(names, end)), other)

    def found(e: Column) -> Column:
        out = [e["source"].alias("source"), F.coalesce(e["relation"], F.lit("UNKNOWN")).alias("relation"), e["target"].alias("target"), e["properties"].alias("properties")]
        for end, side in (("source", "src"), ("target", "tgt")):
            out.append(look(F.col("types"), F.col("names"), e[end], F.lit("Unknown")).alias(f"{side}_label"))
            out.append(look(F.col("types_back"), F.col("names_back"), e[end], F.lit("Unknown")).alias(f"{side}_last"))
            out.append(look(F.col("canonical_back"), F.col("names_back"), e[end], e[end]).alias(f"{side}_name"))
        return F.struct(*out)

    rows = both.select("doc", "page", F.posexplode(F.transform("edges", found)).alias("pos", "e")).select("doc", "page", "pos", "e.*")
    return rows.filter("source <> '' and target <> ''").withColumn("seq", F.struct("doc", "page", F.lit(1).alias("kind"), "pos"))


def confidence_of(value: Column) -> Column:
    """As a double; the default where there is none or it is no number."""
    return F.coalesce(value.try_cast("double"), F.lit(DEFAULT_CONFIDENCE))


def gated(relation: Column, confidence: Column, threshold: float = CONFIDENCE_THRESHOLD) -> Column:
    """The relation, marked as possible where its confidence is below the threshold."""
    return F.when(confidence >= threshold, relation).otherwise(F.concat(F.lit("POSSIBLE_"), relation))


def node_confidence(source: Column, props: Column) -> Column:
    """0.70 for photographed and 0.90 for other sources, 0.05 more with properties."""
    return F.when(source == "photographed", 0.70).otherwise(0.90) + F.when(F.coalesce(F.size(props), F.lit(0)) > 0, 0.05).otherwise(0.0)


def _as_map(k: str, v: str) -> Column:
    """The keys and values of a group as a map in the order of the keys; null keys are none."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(k).isNotNull(), F.struct(k, v)))))


def merged_nodes(nodes: DataFrame, label: str = "label", name: str = "canonical_name", props: str = "props") -> DataFrame:
    """Upsert by (label, name): of each property the last non-empty value, as (label, canonical_name, props, element_id).

    Values are aggregated per property with partial maxima; rows without properties still make their node.
    """
    keys = [F.col(label).alias("label"), F.col(name).alias("canonical_name")]
    each = nodes.select(*keys, F.explode_outer(compact_props(F.col(props))).alias("k", "v"), "seq")
    last = each.groupBy("label", "canonical_name", "k").agg(F.max_by("v", "seq").alias("v"))
    return last.groupBy("label", "canonical_name").agg(_as_map("k", "v").alias("props")).withColumn("element_id", key_of(F.col("label"), F.col("canonical_name")))


def merged_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upsert by (source, relation, target) with (src_label, src_name, rel_type, tgt_label, tgt_name, props, confidence, seq); edges whose ends are no nodes are dropped.

    Of each property the last non-empty value stays, and the last confidence, rounded to three places.
    """
    known = nodes.select(F.col("label"), F.col("canonical_name")).distinct()
    side = lambda p: known.select(F.col("label").alias(f"{p}_label"), F.col("canonical_name").alias(f"{p}_name"))
    e = edges.join(side("src"), ["src_label", "src_name"]).join(side("tgt"), ["tgt_label", "tgt_name"])
    each = e.select(*EDGE_KEY, F.explode_outer(compact_props(F.col("props"))).alias("k", "v"), F.struct("seq", F.round("confidence", 3).alias("c")).alias("last"))
    last = each.groupBy(*EDGE_KEY, "k").agg(F.max_by("v", "last.seq").alias("v"), F.max("last").alias("last"))
    return last.groupBy(*EDGE_KEY).agg(F.max("last")["c"].alias("confidence"), _as_map("k", "v").alias("props"))


def _upserted(stored: DataFrame, batch: DataFrame, key: list[str], *single: str) -> DataFrame:
    """Rows of both sides, one of each key at most in either: the batch's ``props`` go over the stored ones, its non-null ``single`` columns too."""
    side = lambda df, new: df.select(*key, F.struct(F.lit(new).alias("new"), "props", *single).alias("r"))
    g = side(stored, False).unionByName(side(batch, True)).groupBy(*key).agg(F.min_by("r", "r.new").alias("a"), F.max_by("r", "r.new").alias("b"))
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce("a.props", none), F.coalesce("b.props", none)
    props = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return g.select(*key, props.alias("props"), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in single))


def upserted_nodes(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """A stored snapshot (label, canonical_name, props, element_id) with a batch of merged nodes: absent keys come in, of a known key the batch's non-empty properties replace the stored ones and the others stay."""
    b = batch.withColumn("props", compact_props(F.col("props")))
    return _upserted(stored, b, ["label", "canonical_name"], "element_id")


def upserted_edges(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The same for edges by their ends and relation; the batch's confidence replaces the stored one."""
    b = batch.withColumn("props", compact_props(F.col("props")))
    return _upserted(stored, b, EDGE_KEY, "confidence")


def dropped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that merging leaves out, with the end that is missing."""
    known = nodes.select("label", "canonical_name").distinct()
    side = lambda p: known.select(F.col("label").alias(f"{p}_label"), F.col("canonical_name").alias(f"{p}_name"), F.lit(True).alias(f"has_{p}"))
    e = edges.join(side("src"), ["src_label", "src_name"], "left").join(side("tgt"), ["tgt_label", "tgt_name"], "left")
    return e.filter("has_src is null or has_tgt is null").withColumn("missing", F.when(F.col("has_src").isNull() & F.col("has_tgt").isNull(), "both").when(F.col("has_src").isNull(), "source").otherwise("target")).drop("has_src", "has_tgt")


def overlaid(contracts: DataFrame, metadata: DataFrame, fields: list[str] = OVERLAY_FIELDS) -> DataFrame:
    """Contracts (contract_id, props) with metadata's values in place of extracted ones; an empty value is none. ``metadata`` has one row per contract_id."""
    keys = {f: f.lower().replace(" ", "_") for f in fields if f in metadata.columns}
    given = metadata.select("contract_id", *(F.nullif(F.col(f"`{f}`").cast("string"), F.lit("")).alias(k) for f, k in keys.items()))
    j = contracts.join(given, "contract_id", "left")
    fresh = F.map_filter(F.create_map(*(x for k in keys.values() for x in (F.lit(k), F.col(k)))), lambda _, v: v.isNotNull())
    old = F.map_filter("props", lambda k, _: ~F.map_contains_key(fresh, k)) if keys else F.col("props")
    return j.select("contract_id", F.map_concat(old, fresh).alias("props") if keys else old.alias("props"))


def metadata_gaps(metadata: DataFrame, fields: list[str], key: str = "contract_id") -> DataFrame:
    """(contract_id, field) for each field that metadata does not give and extraction has to find."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), F.nullif(F.col(f"`{f}`").cast("string"), F.lit("")).alias("v")) for f in fields))
    return metadata.select(F.col(key), F.explode(F.filter(pairs, lambda x: x["v"].isNull())).alias("x")).select(key, "x.field")


def lineage_edges(metadata: DataFrame, key: str, relations: dict[str, str]) -> DataFrame:
    """(source, relation, target) from columns that name another contract: column to relation. Bookkeeping columns and empty values give none."""
    usable = {c: r for c, r in relations.items() if c not in METADATA_FIELDS["bookkeeping"]}
    pairs = F.array(*(F.struct(F.lit(r).alias("relation"), F.col(f"`{c}`").cast("string").alias("target")) for c, r in usable.items()))
    return metadata.select(F.col(key).cast("string").alias("source"), F.explode(F.filter(pairs, lambda x: present(x["target"]))).alias("x")).select("source", "x.relation", "x.target")


def off_ontology(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Distinct types that are none of the allowed ones, with counts."""
    known = rows.sparkSession.createDataFrame([(a,) for a in allowed], f"{column} string")
    return rows.join(F.broadcast(known), column, "left_anti").groupBy(column).agg(F.count("*").alias("count"))


def off_ontology_nodes(nodes: DataFrame) -> DataFrame:
    return off_ontology(nodes, "type", NODE_TYPES)


def off_ontology_edges(edges: DataFrame) -> DataFrame:
    return off_ontology(edges, "relation", EDGE_TYPES)


def extraction_violations(pages: DataFrame) -> DataFrame:
    """(doc, page, violations) of pages that break the extraction's rules: edges whose ends the page does not declare, nodes without a name, bookkeeping fields as properties.

    Types outside the ontology are no violation if the page suggests them as new ones. All is looked up in a page's own arrays.
    """
    names = F.transform("nodes", lambda n: n["name"])
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["source"], e["target"])))
    unnamed = F.transform(F.filter("nodes", lambda n: F.coalesce(F.trim(n["name"]), F.lit("")) == ""), lambda n: F.concat(F.lit("no name: "), F.coalesce(n["type"], F.lit("Unknown"))))
    suggested = F.transform("suggested_new_types", lambda t: t["type"])
    new = F.array_except(F.filter(F.transform("nodes", lambda n: n["type"]), lambda t: t.isNotNull() & ~t.isin(*NODE_TYPES)), F.coalesce(suggested, F.array().cast("array<string>")))
    keys = F.flatten(F.transform("nodes", lambda n: F.coalesce(F.map_keys(n["properties"]), F.array().cast("array<string>"))))
    hidden = F.filter(F.array_distinct(keys), lambda k: property_name(k).isin(*(c.lower().replace(" ", "_") for c in METADATA_FIELDS["bookkeeping"])))
    say = lambda text, found: F.transform(found, lambda x: F.concat(F.lit(f"{text}: "), x))
    lists = [say("undeclared", F.array_except(F.filter(ends, lambda x: x.isNotNull()), names)), unnamed, say("type not suggested", new), say("bookkeeping", hidden)]
    found = F.array_sort(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))))
    return pages.select("doc", "page", found.alias("violations")).filter(F.size("violations") > 0)


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, count) of node types and relations as seen, dropped edges included; a missing relation is RELATED_TO."""
    n = nodes.select(F.concat(F.lit("node:"), "type").alias("key"))
    e = edges.select(F.concat(F.lit("edge:"), relation_name(F.coalesce("relation", F.lit("RELATED_TO")))).alias("key"))
    return n.unionByName(e).groupBy("key").agg(F.count("*").alias("count"))


def property_names(props: Column) -> Column:
    return F.transform_keys(props, lambda k, _: property_name(k))


def key_violations(rows: DataFrame, keys: list[str], required: bool = True) -> DataFrame:
    """Keys that occur more than once, or with a null part if all are required: (keys, count, reason)."""
    g = rows.groupBy(*keys).agg(F.count("*").alias("count"))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    g = g.withColumn("reason", F.when(null, "null").when(F.col("count") > 1, "duplicate"))
    return g.filter(F.col("reason").isNotNull() if required else F.col("reason") == "duplicate")


def idempotent(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events with their key's hash, one of each key: the first by all columns."""
    e = events.withColumn("event_key", key_of(*(F.col(k) for k in keys)))
    return e.groupBy("event_key").agg(F.min(F.struct(*events.columns)).alias("e")).select("event_key", "e.*")


def ingest(
    pages: DataFrame, canonical: DataFrame, metadata: DataFrame | None = None, source: str = "pdf_text", stored: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    threshold: float = CONFIDENCE_THRESHOLD,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, bridge) of pages, given (type, name, canonical): resolved, typed, gated and merged.

    Names are trimmed everywhere, edges with bad properties keep their row with the default confidence, and the bridge links each page that has
    text to its nodes. With a ``stored`` snapshot the batch is merged into it, and edges may end at stored nodes.
    """
    n = pages.select("doc", "page", F.posexplode("nodes").alias("pos", "n"))
    n = n.select("doc", "page", F.trim("n.name").alias("name"), F.coalesce("n.type", F.lit("Unknown")).alias("type"), F.coalesce("n.properties", F.create_map().cast("map<string,string>")).alias("properties"), F.struct("doc", "page", "pos").alias("seq")).filter("name <> ''")
    n = n.join(canonical, ["type", "name"], "left").withColumn("canonical", F.coalesce("canonical", "name"))
    extra = F.create_map(F.lit("_extraction_confidence"), F.round(node_confidence(F.lit(source), F.col("properties")), 3).cast("string"), F.lit("_source_doc"), F.col("doc"))
    plain = F.map_filter("properties", lambda k, _: ~k.isin("_extraction_confidence", "_source_doc"))
    n = n.withColumn("props", F.map_concat(plain, extra))
    nodes = merged_nodes(n.select(F.col("type").alias("label"), F.col("canonical").alias("canonical_name"), "props", "seq"))
    if metadata is not None:
        contracts = nodes.filter("label = 'Contract'").select(F.col("canonical_name").alias("contract_id"), "props")
        over = overlaid(contracts, metadata).select(F.lit("Contract").alias("label"), F.col("contract_id").alias("canonical_name"), F.col("props").alias("over"))
        nodes = nodes.join(over, ["label", "canonical_name"], "left").withColumn("props", F.coalesce("over", "props")).drop("over")
    if stored is not None:
        nodes = upserted_nodes(stored[0], nodes)
    trimmed = lambda x, *names: x.withField(names[0], F.trim(x[names[0]])) if len(names) == 1 else trimmed(trimmed(x, names[0]), *names[1:])
    local = pages.select("doc", "page", F.transform("nodes", lambda x: trimmed(x, "name")).alias("nodes"), F.transform("edges", lambda x: trimmed(x, "source", "target").withField("relation", F.coalesce(x["relation"], F.lit("RELATED_TO")))).alias("edges"))
    e = page_edges(local).withColumn("relation", relation_name(F.col("relation"))).withColumn("props", F.coalesce("properties", F.create_map().cast("map<string,string>")))
    for side, end in (("src", "source"), ("tgt", "target")):
        names = canonical.select(F.col("type").alias(f"{side}_last"), F.col("name").alias(end), F.col("canonical").alias("__canonical"))
        e = e.join(names, [f"{side}_last", end], "left").withColumn(f"{side}_name", F.coalesce("__canonical", end)).drop("__canonical")
    e = e.withColumn("confidence", confidence_of(F.element_at("props", "confidence"))).withColumn("rel_type", gated(F.col("relation"), F.col("confidence"), threshold))
    edges = merged_edges(e, nodes)
    if stored is not None:
        edges = upserted_edges(stored[1], edges)
    bridge = n.join(pages.filter("trim(raw_text) <> ''").select("doc", "page"), ["doc", "page"]).select(F.concat("doc", F.lit("::page"), F.col("page")).alias("chunk_id"), key_of(F.col("type"), F.col("canonical")).alias("element_id")).distinct()
    if stored is not None:
        bridge = stored[2].unionByName(bridge).distinct()
    return nodes, edges, bridge
