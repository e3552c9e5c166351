"""The instance graph: vertices, edges and what is asked of them.

Edges are a multiset and vertices are told apart by name. Order matters to several results (last type wins, ties by first appearance),
so nodes and edges carry ``seq``, a sortable position.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.schemas import HUBS, INSTANCE_NODES


#: So many edges are contracted at once.
EDGES = 1 << 20
#: Names meet in so many buckets, or four times as many as there are partitions of a shuffle.
BUCKETS = 1024
#: A task unpacks and contracts so many blocks at once, or all of one bucket.
BLOCKS = 256
#: A frontier of so many names is broadcast; a larger one as a bitmap of this many bits, in buckets of 32,768.
BROADCAST_NAMES, BITMAP = 100_000, 1 << 27


def flatten_nodes(pages: DataFrame) -> DataFrame:
    """(doc, page, pos, name, type, properties, seq) of all named nodes; a missing type is Unknown."""
    n = pages.select("doc", "page", F.posexplode("nodes").alias("pos", "n"))
    n = n.select("doc", "page", "pos", F.col("n.name").alias("name"), F.coalesce("n.type", F.lit("Unknown")).alias("type"), F.col("n.properties").alias("properties"))
    return n.filter("name <> ''").withColumn("seq", F.struct("doc", "page", F.lit(0).alias("kind"), "pos"))


def flatten_edges(pages: DataFrame) -> DataFrame:
    """(doc, page, pos, source, relation, target, properties, seq) of all edges with both ends; a missing relation is UNKNOWN."""
    e = pages.select("doc", "page", F.posexplode("edges").alias("pos", "e"))
    e = e.select("doc", "page", "pos", F.col("e.source").alias("source"), F.coalesce("e.relation", F.lit("UNKNOWN")).alias("relation"), F.col("e.target").alias("target"), F.col("e.properties").alias("properties"))
    return e.filter("source <> '' and target <> ''").withColumn("seq", F.struct("doc", "page", F.lit(1).alias("kind"), "pos"))


def last_types(nodes: DataFrame) -> DataFrame:
    """(name, type): of a name's types the last one."""
    return nodes.groupBy("name").agg(F.max_by("type", "seq").alias("type"))


def ends(edges: DataFrame) -> DataFrame:
    """(name, seq) of both ends of every edge."""
    return edges.select(F.explode(F.array("source", "target")).alias("name"), "seq")


def vertices(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, type, degree, seq) of all names: declared or only used by an edge (type Unknown). A self-loop counts twice, parallel edges each.

    One aggregation over nodes and ends together: partial sums go to the shuffle, so a hub's edges never meet in one task.
    """
    declared = nodes.select("name", F.struct("seq", "type").alias("t"), F.lit(0).alias("d"), "seq")
    used = ends(edges).select("name", F.lit(None).cast(declared.schema["t"].dataType).alias("t"), F.lit(1).alias("d"), "seq")
    return declared.unionByName(used).groupBy("name").agg(F.coalesce(F.max("t")["type"], F.lit("Unknown")).alias("type"), F.sum("d").alias("degree"), F.min("seq").alias("seq"))


def hubs(v: DataFrame, n: int = HUBS) -> DataFrame:
    return v.orderBy(F.desc("degree"), "seq", "name").limit(n).select("name", "type", "degree")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared names that no edge uses."""
    return last_types(nodes).join(ends(edges).select("name"), "name", "left_anti")


def totals(v: DataFrame, edges: DataFrame) -> DataFrame:
    return v.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("count"))


def _checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names in spark.checkpoint.dir; to one of our own only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graph-"))


def keep(df: DataFrame) -> DataFrame:
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The table as packed Parquet in the folder of checkpoints: a fraction of a checkpoint's size."""
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    _checkpoints(spark)
    folder = f"{sc._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _contracted(names: pa.Array, ups: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All names of some edges in order, each one's least connected name by its place, and places of ``names`` and ``ups``."""
    codes = pa.chunked_array([ups, names]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(codes.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[codes.indices.to_numpy()]
    least, a, b = np.arange(len(order)), at[: len(ups)], at[len(ups) :]
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return codes.dictionary.take(pa.array(order)), least, at
        a, b = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        least[b] = a  # of several edges one counts here, the others in the next round
        while not np.array_equal(up := least[least], least):
            least = up


def _chunks(batches: Iterator[pa.RecordBatch], whole: bool, most: int | None = None) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(names, ups) of about ``most`` (EDGES) rows; ``whole``: rows are sorted by name and those of one name stay together."""
    held, n, most = [], 0, most or EDGES
    for b in batches:
        if whole and n >= most and b.num_rows:
            same = pc.equal(b.column(0), held[-1].column(0)[-1]).to_numpy(zero_copy_only=False)
            cut = len(same) if same.all() else int(np.argmin(same))
            held.append(b.slice(0, cut))
            b = b.slice(cut)
            if not b.num_rows:
                continue
        if n >= most:
            yield tuple(pa.Table.from_batches(held).column(i).combine_chunks() for i in (0, 1))
            held, n = [], 0
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if n:
        yield tuple(pa.Table.from_batches(held).column(i).combine_chunks() for i in (0, 1))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (name, up) of a task's rows as stars: each name with the least one that it is connected to here; least names with themselves."""
    for a, b in _chunks(batches, False):
        names, least, _ = _contracted(a, b)
        yield pa.RecordBatch.from_arrays([names, names.take(pa.array(least))], names=["name", "up"])


def _packed(names: list[bytes], codes: np.ndarray, ups: list[bytes]) -> bytes:
    """Names with their ups, by places in a list, in one block; -1 is a name alone in its star."""
    own, places = np.unique(codes[codes >= 0], return_inverse=True)
    codes = codes.astype("<i4")
    codes[codes >= 0] = places
    both = names + [ups[i] for i in own.tolist()]
    sizes = np.fromiter(map(len, both), "<i4", len(both))
    return zlib.compress(b"".join([np.array([len(names), len(own)], "<i4").tobytes(), sizes.tobytes(), codes.tobytes(), *both]), 1)


def _unpacked(block: bytes, kind: pa.DataType) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Names, their ups, and which are alone."""
    raw = zlib.decompress(block)
    n, m = np.frombuffer(raw, "<i4", 2).tolist()
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<i4", n + m, 8)))).astype(np.int32)
    codes = np.frombuffer(raw, "<i4", n, 8 + 4 * (n + m))
    both = pa.Array.from_buffers(kind, n + m, [None, pa.py_buffer(offsets), pa.py_buffer(raw[8 + 4 * (2 * n + m) :])])
    return both[:n], both.take(pa.array(np.where(codes < 0, np.arange(n), n + codes))), pa.array(codes < 0)


def _packed_stars(buckets: int):
    """The stars of a task's edges (name, up) in a block for each bucket of names. Names that differ in their last two bytes alone share a bucket, so neighbours in a block are alike and take little room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for star in _stars(batches):
            names = star.column("name").cast(pa.binary()).to_pylist()
            ups = star.column("up").dictionary_encode()
            codes, listed = ups.indices.to_numpy(), ups.dictionary.cast(pa.binary()).to_pylist()
            codes = np.where(np.bincount(codes)[codes] > 1, codes, -1)
            bucket = np.fromiter((zlib.crc32(x[:-2]) % buckets for x in names), np.int32, len(names))
            order = np.argsort(bucket, kind="stable")
            at, begin = np.unique(bucket[order], return_index=True)
            blocks = [_packed([names[i] for i in o.tolist()], codes[o], listed) for o in np.split(order, begin[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(blocks, pa.binary())], names=["bucket", "stars"])

    return run


def _joined_stars(kind: pa.DataType, sizes: bool):
    """Packed stars, sorted by bucket, that meet by name are contracted: a row for each name, with ``n`` 1, and, without ``n``, one for each centre that is not least and has
    other names, by which groups of different tasks hang together. ``sizes``: names are counted, a row for each least name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(i, BLOCKS) for b in batches for i in range(0, b.num_rows, BLOCKS))
        for _, blocks in _chunks(slices, True, BLOCKS):
            a, b, alone = (pa.concat_arrays(x) for x in zip(*(_unpacked(x, kind) for x in blocks.to_pylist())))
            names, least, at = _contracted(a, b)
            own, centre = np.unique(at[len(b) :]), np.unique(at[: len(b)][~alone.to_numpy(zero_copy_only=False)])
            centre = centre[least[centre] != centre]
            up, n = np.unique(least[own], return_counts=True) if sizes else (least[own], np.ones(len(own), np.int64))
            name = pa.concat_arrays([pa.nulls(len(up), kind) if sizes else names.take(pa.array(own)), names.take(pa.array(centre))])
            ups = names.take(pa.array(np.concatenate([up, least[centre]])))
            yield pa.RecordBatch.from_arrays([name, ups, pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(len(centre), pa.int64())])], names=["name", "up", "n"])

    return run


def _levels(rest: DataFrame, sizes: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Levels of (name, up, n): the ups of one are names of the next; and (name, component) of ups of the last, if they are not least yet.

    Tasks contract the edges (name, up) that they read to stars, so that a dense graph's edges are never shuffled; stars meet by name, in packed blocks, and are contracted again. What is
    left are edges between centres, for which the same is done while it halves them; then steps are doubled (``_by_steps``), which ends on any graph. ``sizes``: the first level has
    a row for each up with the number of its names, so names are not written.
    """
    kind = rest.schema["name"].dataType.simpleString()
    arrow = {"string": pa.string(), "binary": pa.binary()}[kind]
    buckets = max(BUCKETS, 4 * int(rest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    levels, before = [], None
    while True:
        stars = rest.mapInArrow(_packed_stars(buckets), "bucket int, stars binary").repartition("bucket").sortWithinPartitions("bucket")
        met = stored(stars.mapInArrow(_joined_stars(arrow, sizes and not levels), f"name {kind}, up {kind}, n long"))
        levels.append(met.filter("n is not null"))
        rest = met.filter("n is null").select("name", "up")
        left = rest.count()
        if not left or before is not None and left > before / 2:
            return levels, _by_steps(rest) if left else None
        before = left


def _edges_and_names(v: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.filter("source <> target").select(F.col("source").alias("name"), F.col("target").alias("up"))
    return e.unionByName(v.filter("name is not null").select("name", F.col("name").alias("up")))


def _tops(level: DataFrame, found: DataFrame | None) -> DataFrame:
    """The level with the components of its ups."""
    if found is None:
        return level.withColumn("component", F.col("up"))
    # Few least names stand for many, so only these are looked up.
    wanted = stored(found.join(level.select(F.col("up").alias("name")).distinct(), "name", "left_semi"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NAMES else wanted
    return level.join(wanted.withColumnRenamed("name", "up"), "up", "left").withColumn("component", F.coalesce("component", "up"))


def contracted(edges: DataFrame) -> DataFrame:
    """(name, component): the least name that edges (name, up), in either direction, lead to; of all ends. Names are strings or binary, and none is null."""
    levels, found = _levels(edges, False)
    for level in reversed(levels):
        found = _tops(level, found).select("name", "component")
    return found


def components(v: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): the least name that edges, in either direction, lead to; of all of ``v`` and all ends of edges."""
    return contracted(_edges_and_names(v, edges))


def sizes_of_components(v: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size) of ``components``; names are counted as they are contracted, and no table of them is written."""
    (first, *further), found = _levels(_edges_and_names(v, edges), True)
    for level in reversed(further):
        found = _tops(level, found).select("name", "component")
    return _tops(first.groupBy("up").agg(F.sum("n").alias("n")), found).groupBy("component").agg(F.sum("n").alias("size"))


def _by_steps(edges: DataFrame) -> DataFrame:
    """(name, component) of the ends of edges (name, up) between different names.

    Each round maps every vertex that still has edges to its least neighbour, doubles these steps until all end in local minima, and contracts the edges
    to these. A chain takes the logarithm of its length, hubs cost one partial aggregation, and vertices without edges are never shuffled along.
    """
    rest = keep(edges.select(F.least("name", "up").alias("lo"), F.greatest("name", "up").alias("hi")).distinct())
    out = None
    while not rest.isEmpty():
        near = rest.select(F.col("lo").alias("name"), F.col("hi").alias("to")).unionAll(rest.select(F.col("hi").alias("name"), F.col("lo").alias("to")))
        step = keep(near.groupBy("name").agg(F.min("to").alias("to")).select("name", F.least("name", "to").alias("up")))
        jump = step.withColumn("moved", F.lit(True))
        while not jump.filter("moved").isEmpty():
            above = jump.select(F.col("name").alias("up"), F.col("up").alias("top"))
            jump = keep(jump.join(above, "up").select("name", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        jump = jump.drop("moved")
        out = jump.withColumnRenamed("up", "component") if out is None else keep(
            out.join(jump.select(F.col("name").alias("component"), "up"), "component", "left").select("name", F.coalesce("up", "component").alias("component"))
        )
        low, high = (jump.select(F.col("name").alias(c), F.col("up").alias(c + "2")) for c in ("lo", "hi"))
        moved = rest.join(low, "lo").join(high, "hi").filter("lo2 <> hi2")
        rest = keep(moved.select(F.least("lo2", "hi2").alias("lo"), F.greatest("lo2", "hi2").alias("hi")).distinct())
    return out


def roots(step: DataFrame) -> DataFrame:
    """(id, up): where steps (id, up) lead in the end; an id that is no key of a step is a root. Steps double each round, so a chain takes the logarithm of its length; they must have no cycle."""
    jump = keep(step.withColumn("moved", F.lit(True)))
    while not jump.filter("moved").isEmpty():
        above = jump.select(F.col("id").alias("up"), F.col("up").alias("top"))
        jump = keep(jump.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
    return jump.drop("moved")


def walk(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, id, depth): all that single steps (id, up) lead to from each start (id), itself at depth 0.

    After round k all places within 2^k steps are known, and a step of 2^(k+1) is two of 2^k; so any depth takes the logarithm of it in rounds. A place that a cycle leads to again
    keeps its least depth, and rounds end when they find none that is new. Several steps from one place are followed all.
    """
    s = steps.filter(F.col("id").isNotNull() & F.col("up").isNotNull()).select("id", "up").distinct()
    jump, reach = keep(s), keep(starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("depth")).distinct())
    length, known = 1, reach.count()
    while not jump.isEmpty():
        far = reach.join(jump, "id").select("start", F.col("up").alias("id"), (F.col("depth") + length).alias("depth"))
        reach = keep(reach.unionByName(far).groupBy("start", "id").agg(F.min("depth").alias("depth")))
        found = reach.count()
        if found == known:
            break
        known, length = found, 2 * length
        jump = keep(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("top")), "up").select("id", F.col("top").alias("up")).distinct())
    return reach


def _marks(names: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of the names' hashes, in rows of 4 KB."""
    at = F.pmod(F.xxhash64("name"), F.lit(BITMAP))
    marks = names.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    return F.broadcast(marks)


def _perhaps_in(edges: DataFrame, marks: DataFrame) -> DataFrame:
    """Edges whose source is one of the marked names, and few others."""
    at = F.pmod(F.xxhash64("source"), F.lit(BITMAP))
    place = F.bitmap_bit_position(at)
    byte = F.ascii(F.decode(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
    e = edges.withColumn("bucket", F.bitmap_bucket_number(at)).join(marks, "bucket")
    return e.filter(F.getbit(byte, (place % 8).cast("int")) == 1).select("source", "target")


def expand(starts: DataFrame, edges: DataFrame, hops: int, directed: bool = True) -> DataFrame:
    """(start, name, depth): vertices within a number of edges from each start (name), with the least number; each is visited once, so cycles end.

    Edges are read again for each hop and never gathered: a small frontier is sent to all tasks, of a large one a bitmap, so that only edges that leave it are shuffled.
    """
    e = edges.select("source", "target").filter("source is not null and target is not null")
    if not directed:
        e = e.select(F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target")))).alias("e")).select("e.*")
    frontier = stored(starts.select(F.col("name").alias("start"), "name", F.lit(0).alias("depth")).distinct())
    visited = frontier
    for depth in range(1, hops + 1):
        n = frontier.count()
        if not n:
            break
        last = frontier.select("start", F.col("name").alias("source"))
        met = e.join(F.broadcast(last), "source") if n <= BROADCAST_NAMES else _perhaps_in(e, _marks(frontier)).join(last, "source")
        near = met.select("start", F.col("target").alias("name")).distinct()
        frontier = stored(near.join(visited, ["start", "name"], "left_anti").withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(frontier)  # of tables that are stored
    return visited


def component_sizes(c: DataFrame) -> DataFrame:
    return c.groupBy("component").agg(F.count("*").alias("size"))


def component_stats(c: DataFrame) -> DataFrame:
    return size_stats(component_sizes(c))


def size_stats(sizes: DataFrame) -> DataFrame:
    """Numbers of components and singletons, and the largest size; the sizes' distribution as counts, from the largest on."""
    by_size = sizes.groupBy("size").agg(F.count("*").alias("n"))
    dist = F.transform(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False), lambda x: F.concat_ws("x", x["size"], x["n"]))
    return by_size.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_component_size"),
        F.coalesce(F.sum(F.when(F.col("size") == 1, F.col("n"))), F.lit(0)).alias("num_singleton_components"), F.array_join(dist, ",").alias("size_distribution"),
    )


def schema_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between types: (source_type, target_type, label), a pair's last label wins. Types are looked up in the edge's page, the last declaration wins.

    For flat rows of which the pages are gone; ``page_schema_edges`` needs no join.
    """
    types = nodes.groupBy("doc", "page", "name").agg(F.max_by("type", "seq").alias("type"))
    side = lambda end, out: types.select("doc", "page", F.col("name").alias(end), F.col("type").alias(out))
    e = edges.join(side("source", "s"), ["doc", "page", "source"], "left").join(side("target", "t"), ["doc", "page", "target"], "left")
    return page_schema_edges(e.select(F.coalesce("s", F.lit("Unknown")).alias("src_last"), F.coalesce("t", F.lit("Unknown")).alias("tgt_last"), "relation", "seq"))


def page_schema_edges(edges: DataFrame) -> DataFrame:
    """The same of ``ingest.page_edges``, which carry the types of their ends."""
    return edges.groupBy(F.col("src_last").alias("source_type"), F.col("tgt_last").alias("target_type")).agg(F.max_by("relation", "seq").alias("label"))


def instance_sample(v: DataFrame, edges: DataFrame, n: int = INSTANCE_NODES) -> DataFrame:
    """The subgraph that the n best connected vertices induce: (source, target, label), the last label of a pair wins."""
    top = v.orderBy(F.desc("degree"), "seq", "name").limit(n).select("name")
    inside = edges.join(F.broadcast(top.withColumnRenamed("name", "source")), "source", "left_semi").join(F.broadcast(top.withColumnRenamed("name", "target")), "target", "left_semi")
    return inside.groupBy("source", "target").agg(F.max_by("relation", "seq").alias("label"))


def sampled_graph(nodes: DataFrame, edges: DataFrame, n: int = INSTANCE_NODES) -> DataFrame:
    """The n best connected vertices with the edges between them: (kind, source, target, label), kind node with its type as label or edge with a pair's last label.

    A pair counts once for the degree, however many edges it has. Hubs often have no edge between them, so the vertices are rows too.
    """
    pairs = edges.groupBy("source", "target").agg(F.max_by("relation", "seq").alias("relation"), F.min("seq").alias("seq"))
    top = keep(vertices(nodes, pairs).orderBy(F.desc("degree"), "seq", "name").limit(n))
    row = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), *c)
    inside = pairs.join(F.broadcast(top.select(F.col("name").alias("source"))), "source", "left_semi").join(F.broadcast(top.select(F.col("name").alias("target"))), "target", "left_semi")
    return row(top, "node", F.col("name").alias("source"), F.lit(None).cast("string").alias("target"), F.col("type").alias("label")).unionByName(
        row(inside, "edge", "source", "target", F.col("relation").alias("label"))
    )


def type_colours(types: DataFrame, colours: int = 9) -> DataFrame:
    """A colour's number for each type, cycling over the sorted types; types are few."""
    return types.select("type").distinct().withColumn("colour", (F.row_number().over(Window.orderBy("type")) - 1) % colours)


def count_differences(raw: DataFrame, summary: DataFrame) -> DataFrame:
    """(relation, raw_recount, summary_file) where two counts by relation differ; an absent one is 0."""
    both = raw.select("relation", F.col("count").alias("a")).join(summary.select("relation", F.col("count").alias("b")), "relation", "full")
    both = both.select("relation", F.coalesce("a", F.lit(0)).alias("raw_recount"), F.coalesce("b", F.lit(0)).alias("summary_file"))
    return both.filter("raw_recount <> summary_file")


def relation_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("relation").unionByName(b.select("relation")).distinct()


def label_of(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("Unknown"))
