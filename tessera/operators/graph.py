"""Graphs: simple undirected edges, components, communities, their metrics and profiles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset, one of our own if there is one machine only, else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage: the rows written to the shared folder and read back. They are computed once, and Spark knows their size, which in loops it overrates after checkpoint()."""
    path = f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def simple_edges(relations: DataFrame, order: str | None = None) -> DataFrame:
    """(u, v) with u <= v, one for each pair of ends; with `order`, also the last relation of the pair, as `last`."""
    pairs = relations.where("source_id is not null and target_id is not null").withColumn("u", F.least("source_id", "target_id")).withColumn("v", F.greatest("source_id", "target_id"))
    if order:
        return pairs.groupBy("u", "v").agg(F.max_by(F.struct("relationship", "description"), order).alias("last"))
    return pairs.select("u", "v").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other): each edge from either end, a loop once."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.where("u <> v").select(F.col("v").alias("node"), F.col("u").alias("other")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): a loop counts twice."""
    ends = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node")))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node each node is linked with; large and small stars in turn until nothing changes."""
    now = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        least = both_ways(now).groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("m"))
        large = both_ways(now).join(least, "node").where("other > node").select(F.col("other").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.*")
        now = checkpointed(small.where("u <> v").distinct())
        last, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == last or not state[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def constrained_components(accepted: DataFrame, refused: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) of accepted pairs (u, v, and `rank` if there is one), where no refused pair (u, v) is joined, not even by way of others.

    The groups are those of taking the accepted pairs in the order of rank (else of a hash), and joining two groups unless a refused pair
    lies across them. Components without a refused pair inside are whole groups. In the others, round by round, two groups
    join that are each other's first choice of the groups they may join: nothing that comes before that choice can join either, so
    the order doesn't matter, and each round is a few joins. Groups are named by their smallest node; equal ranks are in the order of the hash.
    """
    pairs = accepted.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), (F.col("rank") if "rank" in accepted.columns else F.lit(0)).cast("double").alias("rank"))
    pairs = checkpointed(pairs.groupBy("u", "v").agg(F.min("rank").alias("rank")).withColumn("order", F.struct("rank", F.xxhash64("u", "v").alias("h"), "u", "v")))
    bad = checkpointed(refused.where("u <> v").select("u", "v").distinct())
    whole = checkpointed(connected_components(pairs))
    of = lambda side, group: group.select(F.col("node").alias(side), F.col("component").alias(f"{side}_g"))
    split = bad.join(of("u", whole), "u").join(of("v", whole), "v").where("u_g = v_g").select(F.col("u_g").alias("component")).distinct()
    group = checkpointed(whole.join(split, "component", "left_semi").select("node", F.col("node").alias("component")))
    calm = whole.join(split, "component", "left_anti").select("node", "component")
    for _ in range(most_rounds):
        across = lambda rows: rows.join(of("u", group), "u").join(of("v", group), "v").where("u_g <> v_g").withColumn("a", F.least("u_g", "v_g")).withColumn("b", F.greatest("u_g", "v_g"))
        open_ = across(pairs).groupBy("a", "b").agg(F.min("order").alias("order")).join(across(bad).select("a", "b").distinct(), ["a", "b"], "left_anti")
        open_ = checkpointed(open_)
        ways = open_.select(F.col("a").alias("g"), F.col("b").alias("to"), "order").union(open_.select("b", "a", "order"))
        choice = ways.groupBy("g").agg(F.min(F.struct("order", "to")).alias("c")).select("g", F.col("c.to").alias("to"))
        mutual = checkpointed(choice.alias("x").join(choice.alias("y"), F.expr("x.g = y.to and x.to = y.g and x.g > x.to")).select(F.col("x.g").alias("component"), F.col("x.to").alias("into")))
        if mutual.isEmpty():
            break
        group = checkpointed(group.join(mutual, "component", "left").select("node", F.coalesce("into", "component").alias("component")))
    else:
        raise RuntimeError(f"groups did not settle in {most_rounds} rounds")
    return calm.unionByName(group)


def label_propagation(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, label): each node takes its neighbours' most frequent label, the smallest of several, `rounds` times at once."""
    ways = both_ways(edges.where("u <> v"))
    labels = ways.select("node").distinct().withColumn("label", F.col("node"))
    for i in range(rounds):
        counts = ways.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
        labels = counts.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"))
        if i % 3 == 2:
            labels = checkpointed(labels)
    return labels


#: What a level's modularity must grow by to count, and rounds without growth after which a level has ended.
GAIN, PATIENCE = 1e-9, 4


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(edges, communities, modularity) of simple undirected edges: the share of edges inside communities less what degrees alone would give.

    Loops and repeated edges count for nothing; a node without a community is one of its own; no edges give one row of zeros.
    """
    plain = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    known = membership.select("node", F.col("community").alias("_k"))
    held = degrees(plain).join(known, "node", "left").select("node", "degree", F.coalesce("_k", "node").alias("community"))
    of = held.groupBy("community").agg(F.sum("degree").alias("degree"))
    inner = inner_edges(plain, held.select("node", "community")).groupBy("community").agg(F.count(F.lit(1)).alias("inner"))
    sums = of.join(inner, "community", "left").agg(F.sum("degree").alias("ends"), F.sum("inner").alias("inside"), F.count(F.lit(1)).alias("communities"), F.sum(F.col("degree").cast("double") * F.col("degree")).alias("squares"))
    m = F.coalesce(F.col("ends"), F.lit(0)) / 2
    score = F.when(m > 0, F.coalesce("inside", F.lit(0)) / m - resolution * F.col("squares") / (4 * m * m)).otherwise(0.0)
    return sums.select(m.cast("long").alias("edges"), "communities", score.alias("modularity"))


def local_moves(ways: DataFrame, total: float, most_rounds: int, start: DataFrame | None = None, movable: DataFrame | None = None, one_in: int = 2, seed: int = 0) -> DataFrame:
    """(node, community): nodes of a weighted graph moved to the neighbouring community of the highest gain of modularity, round by round.

    ways: (a, b, w) from either end, a loop with all its inner weight. start: (node, community) to begin with, else each node
    alone; movable: the only nodes that may move, else all. In a round about one in `one_in` nodes may move, by a hash of
    node, round and seed, so that neighbours don't change places for ever, and fewer after rounds without growth; of equal gains the
    smallest community wins. Sums are partially aggregated, so a hub's edges aren't gathered in one task. Ends when no node gains or
    modularity hasn't grown for PATIENCE rounds, with the best round's communities; raises where that takes over `most_rounds`.
    """
    weight = ways.groupBy("a").agg(F.sum("w").alias("k"))
    free = F.lit(True)
    if movable is not None:
        weight, free = weight.join(movable.select(F.col("node").alias("a"), F.lit(True).alias("_m")).distinct(), "a", "left"), F.col("_m").isNotNull()
    weight = checkpointed(weight.select("a", "k", free.alias("free")))
    own = weight.select(F.col("a").alias("node"), F.col("a").alias("c"))
    if start is not None:
        given = start.select("node", F.col("community").alias("_c"))
        own = checkpointed(own.join(given, "node", "left").select("node", F.coalesce("_c", "c").alias("c")))
    loops = ways.where("a = b").agg(F.sum("w")).first()[0] or 0.0
    best, most, idle = own, None, 0
    for i in range(most_rounds):
        held = own.join(weight, F.col("node") == F.col("a")).select("node", "c", "k", "free")
        sums = held.groupBy("c").agg(F.sum("k").alias("of_c"))
        met = ways.where("a <> b").join(own, F.col("b") == F.col("node")).select("a", "c", "w").unionByName(own.select(F.col("node").alias("a"), "c", F.lit(0.0).alias("w")))
        near = met.groupBy("a", "c").agg(F.sum("w").alias("w")).join(sums, "c").join(held.select(F.col("node").alias("a"), F.col("c").alias("now"), "k", "free"), "a")
        here = F.col("c") == F.col("now")
        gain = F.round(F.col("w") - F.col("k") * (F.col("of_c") - F.when(here, F.col("k")).otherwise(0.0)) / total, 9)
        choice = near.withColumn("loss", -gain).groupBy("a", "now", "free").agg(F.min(F.struct("loss", "c")).alias("best"), F.min(F.when(here, F.col("loss"))).alias("stay"), F.max(F.when(here, F.col("w"))).alias("inner"))
        better = (F.col("best.loss") < F.col("stay")) & F.col("free")
        may = F.pmod(F.xxhash64("a", F.lit(i), F.lit(seed)), F.lit(one_in << idle)) == 0
        moved = checkpointed(choice.select(F.col("a").alias("node"), F.when(better & may, F.col("best.c")).otherwise(F.col("now")).alias("c"), better.alias("better"), "inner"))
        inside, some = moved.agg(F.sum("inner"), F.max("better")).first()
        now = ((inside or 0.0) + loops) / total - sums.agg(F.sum(F.col("of_c") * F.col("of_c"))).first()[0] / total / total
        if most is None or now > most + GAIN:
            best, most, idle = own, now, 0
        else:
            idle += 1
        if not some or idle == PATIENCE:
            return best.select("node", F.col("c").alias("community"))
        own = moved.select("node", "c")
    raise RuntimeError(f"communities did not settle in {most_rounds} rounds")


def louvain(edges: DataFrame, most_rounds: int = 200, most_levels: int = 30, start: DataFrame | None = None, touched: DataFrame | None = None, refine: int = 2) -> DataFrame:
    """(node, community): modularity communities, named by their smallest node; loops count for nothing.

    At each level nodes are moved by `local_moves`, then each community is put as one node. Then all of it again from what was
    found, with fewer nodes moving at once, until `refine` passes after each other gain nothing; the best pass counts. All of
    it is joins and sums, the same for every size of graph and component; no edges give no rows. start: communities of an earlier
    version of the graph to begin with; touched: (node) of what has changed since, then in one pass these and their neighbours alone may
    move on the first level. Raises if a level or the levels don't end.
    """
    plain = edges.where("u <> v").select("u", "v").distinct()
    ways = checkpointed(both_ways(plain).select(F.col("node").alias("a"), F.col("other").alias("b"), F.lit(1.0).alias("w")))
    total = float(ways.count())
    nodes = ways.select(F.col("a").alias("node"), F.col("a").alias("community")).distinct()
    if not total:
        return nodes
    movable = None
    if start is not None and touched is not None:
        movable = checkpointed(touched.select("node").union(ways.join(touched.select(F.col("node").alias("a")), "a", "left_semi").select("b")).distinct())

    def one_pass(ways: DataFrame, start: DataFrame | None, movable: DataFrame | None, one_in: int, seed: int) -> DataFrame:
        member = nodes
        for level in range(most_levels):
            found = local_moves(ways, total, most_rounds, *((start, movable) if level == 0 else (None, None)), one_in, seed)
            named = checkpointed(found.join(found.groupBy("community").agg(F.min("node").alias("name")), "community").select("node", "community", "name"))
            if level and not named.where("node <> name").limit(1).count():
                return member
            to = named.select(F.col("node").alias("_n"), "name")
            member = checkpointed(member.join(to, F.col("community") == F.col("_n")).select("node", F.col("name").alias("community")))
            of = lambda side: to.select(F.col("_n").alias(side), F.col("name").alias(f"{side}_"))  # noqa: E731, B023
            ways = checkpointed(ways.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("a_").alias("a"), F.col("b_").alias("b")).agg(F.sum("w").alias("w")))
        raise RuntimeError(f"communities did not settle in {most_levels} levels")

    score = lambda member: modularity(plain, member).first()["modularity"]
    best = one_pass(ways, start, movable, 2, 0)
    most, idle, seed = score(best) if refine and movable is None else 0.0, 0 if movable is None else refine, 0
    while idle < refine:
        seed += 1
        again = one_pass(ways, best, None, 8, seed)
        if (now := score(again)) > most + GAIN:
            best, most, idle = again, now, 0
        else:
            idle += 1
    return best


def communities(membership: DataFrame, least: int = 2) -> DataFrame:
    """(community, members) of at least `least` members, sorted."""
    return membership.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("members")).where(F.size("members") >= least)


def inner_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, u, v) of the edges between members of one community."""
    a, b = membership.select(F.col("node").alias("u"), "community"), membership.select(F.col("node").alias("v"), "community")
    return edges.join(a, "u").join(b, ["v", "community"]).select("community", "u", "v")


def community_metrics(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, size, edge_count, density) of communities of two members or more."""
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")
    inner = inner_edges(edges, membership).groupBy("community").agg(F.count(F.lit(1)).alias("e"))
    out = size.join(inner, "community", "left").withColumn("edge_count", F.coalesce("e", F.lit(0)))
    return out.select("community", "size", "edge_count", (F.lit(2.0) * F.col("edge_count") / (F.col("size") * (F.col("size") - 1))).alias("density"))


def top_members(edges: DataFrame, membership: DataFrame, most: int = 5) -> DataFrame:
    """(community, node, degree, place): members of the highest degree inside their community."""
    inner = inner_edges(edges, membership)
    ends = inner.select("community", F.col("u").alias("node")).union(inner.select("community", F.col("v").alias("node")))
    counts = ends.groupBy("community", "node").agg(F.count(F.lit(1)).alias("degree"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "node"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


def bridge_members(edges: DataFrame, membership: DataFrame, most: int = 5) -> DataFrame:
    """(community, node, external_degree, place): members with the most distinct neighbours outside."""
    a = membership.select("node", "community")
    b = membership.select(F.col("node").alias("other"), F.col("community").alias("_c"))
    outside = both_ways(edges.where("u <> v")).join(a, "node").join(b, "other", "left").where("_c is null or _c <> community")
    counts = outside.groupBy("community", "node").agg(F.count(F.lit(1)).alias("external_degree"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("external_degree"), "node"))
    return counts.withColumn("place", place).where(F.col("place") <= most)


def key_relationships(relations: DataFrame, membership: DataFrame, most: int = 10) -> DataFrame:
    """(community, u, v, relationship, place): the first relations between members, by their sorted ends."""
    rows = relations.where("source_id <> target_id").select(F.least("source_id", "target_id").alias("u"), F.greatest("source_id", "target_id").alias("v"), "relationship", "description")
    inner = inner_edges(rows.select("u", "v").distinct(), membership).join(rows, ["u", "v"])
    place = F.row_number().over(Window.partitionBy("community").orderBy("u", "v", "relationship", "description"))
    return inner.withColumn("place", place).where(F.col("place") <= most).select("community", "u", "v", "relationship", "place")


def profiles(entities: DataFrame, relations: DataFrame, membership: DataFrame) -> DataFrame:
    """One nested row a community: members, title, summary, keywords, top and bridge entities, metrics, key relationships."""
    edges = simple_edges(relations)
    names = entities.select("id", "name")
    kept = membership.join(names, F.col("node") == F.col("id"), "left_semi")
    metrics = community_metrics(edges, kept)

    def listed(rows: DataFrame, value: str, out: str) -> DataFrame:
        named = rows.join(names, F.col("node") == F.col("id"))
        return named.groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id", "name", value))), lambda x: F.struct(x["id"], x["name"], x[value])).alias(out))

    members = kept.join(names, F.col("node") == F.col("id")).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("m"))
    keys = key_relationships(relations, kept).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "u", "v", "relationship"))).alias("key_relationships"))
    out = metrics.join(members, "community").join(listed(top_members(edges, kept), "degree", "top_entities"), "community", "left").join(listed(bridge_members(edges, kept), "external_degree", "bridge_entities"), "community", "left").join(keys, "community", "left")
    best = F.transform(F.coalesce("top_entities", F.array()), lambda x: x["name"])
    title = F.coalesce(F.element_at(F.transform("m", lambda x: x["name"]), 1), F.lit(""))
    return out.select(
        F.col("community").alias("community_id"), F.transform("m", lambda x: x["id"]).alias("members"), F.transform("m", lambda x: x["name"]).alias("member_names"), F.concat(F.lit("Community of "), title).alias("title"),
        F.concat(F.col("size").cast("string"), F.lit(" members: "), F.array_join(F.slice(best, 1, 5), ", ")).alias("summary"), F.slice(best, 1, 5).alias("keywords"), "top_entities", "bridge_entities", F.struct("size", "edge_count", "density").alias("metrics"), "key_relationships",
    )


def common_communities(before: DataFrame, after: DataFrame) -> DataFrame:
    """The community_ids that both have."""
    return before.select("community_id").intersect(after.select("community_id"))


def community_evolution(before: DataFrame, after: DataFrame) -> DataFrame:
    """(community_id, change, delta_size, added, removed, alert) of (community_id, members) before and after; unchanged ones are left out."""
    none = F.array().cast("array<string>")
    both = before.select("community_id", F.col("members").alias("old")).join(after.select("community_id", F.col("members").alias("new")), "community_id", "full_outer")
    added, removed = F.array_except(F.coalesce("new", none), F.coalesce("old", none)), F.array_except(F.coalesce("old", none), F.coalesce("new", none))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").otherwise("changed")
    delta = F.size(F.coalesce("new", none)) - F.size(F.coalesce("old", none))
    out = both.select("community_id", change.alias("change"), delta.alias("delta_size"), added.alias("_a"), removed.alias("_r")).where((F.size("_a") > 0) | (F.size("_r") > 0))
    alert = (F.col("change") == "changed") & ((F.abs("delta_size") >= 3) | (F.size("_a") >= 3) | (F.size("_r") >= 3))
    return out.select("community_id", "change", "delta_size", F.slice(F.array_sort("_a"), 1, 10).alias("added"), F.slice(F.array_sort("_r"), 1, 10).alias("removed"), alert.alias("alert"))
