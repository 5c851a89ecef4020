"""The registered queries of the graph engine, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import chunking, graph, metrics, resolve, retrieval, slots, vectors
from .sources import corpus, store, tables
from .sources.tables import key, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ENT = """ent as (
  select 'region:'||r_regionkey as id, r_name as name, 'REGION' as type, 'region '||r_name as description from region
  union all select 'nation:'||n_nationkey, n_name, 'NATION', 'nation '||n_name from nation
  union all select 'customer:'||c_custkey, c_name, 'CUSTOMER', 'customer in '||c_mktsegment from customer
  union all select 'supplier:'||s_suppkey, s_name, 'SUPPLIER', 'supplier '||s_name from supplier
  union all select 'part:'||p_partkey, p_name, 'PART', p_brand||' '||p_type from part)"""
LOC = """loc as (
  select 'nation:'||n_nationkey as source_id, 'region:'||n_regionkey as target_id, 'LOCATED_IN' as relationship, 'nation in region' as description from nation
  union all select 'customer:'||c_custkey, 'nation:'||c_nationkey, 'LOCATED_IN', 'customer in nation' from customer
  union all select 'supplier:'||s_suppkey, 'nation:'||s_nationkey, 'LOCATED_IN', 'supplier in nation' from supplier)"""
REL = LOC + """, rel as (select * from loc
  union all select distinct 'supplier:'||l_suppkey, 'part:'||l_partkey, 'SUPPLIES', 'supplies part' from lineitem
  union all select distinct 'customer:'||o_custkey, 'part:'||l_partkey, 'ORDERED', 'ordered part' from lineitem join orders on l_orderkey = o_orderkey)"""
RAW = """raw as (select cast(l_orderkey as varchar) as document_id, l_orderkey||'_0' as segment_id, l_orderkey * 10 + l_linenumber as ord,
  'supplier:'||l_suppkey as source, 'part:'||l_partkey as target, case l_returnflag when 'A' then 'Supplies Part' when 'N' then 'suppliespart' else 'ships' end as relationship,
  'status '||l_linestatus as description from lineitem)"""
PARTS = """parts as (select 'doc'||(p_partkey % 50) as document_id, 'doc'||(p_partkey % 50)||'_'||(p_partkey % 7) as segment_id, p_partkey as ord,
  case when p_partkey % 3 = 0 then '  '||upper(p_name)||' ' else p_name end as name, case when p_size > 5 then p_type end as type,
  case when p_partkey % 5 <> 0 then p_brand||' '||p_type else '' end as description, p_brand as alias from part)"""
NEAR = "near as (select source_id as focus_id, target_id as other_id, relationship, description from rel union all select target_id, source_id, relationship, description from rel)"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(c):
    return F.array_join(c, "|")


@query("select p_partkey, replace(lower(trim('  '||p_name||' ')), ' ', '') as norm, regexp_replace(lower(p_type), '\\s+', '', 'g') as label_key, 'entity::'||replace(lower(p_name), ' ', '') as id from part")
def normalize_names(spark, d):
    padded = F.concat(F.lit("  "), "p_name", F.lit(" "))
    return table(spark, d, "part").select("p_partkey", T.normalize_name(padded).alias("norm"), T.label_key("p_type").alias("label_key"), T.entity_id(T.normalize_name("p_name")).alias("id"))


@query(f"with {RAW} select ord, 'rel::'||source||'::'||regexp_replace(lower(relationship), '[^a-z0-9]+', '-', 'g')||'::'||target as id from raw")
def relationship_ids(spark, d):
    return tables.raw_relations(spark, d).select("ord", T.relationship_id("source", "relationship", "target").alias("id"))


@query(f"""with {PARTS}, s as (select *, trim(name) as n from parts), f as (select *, row_number() over (partition by segment_id, n order by ord) as k from s where n <> '')
  select segment_id, ord, n as name, coalesce(type, 'CONCEPT') as type, case when description = '' then n||'实体' else description end as description from f where k = 1""")
def clean_entities(spark, d):
    return resolve.clean_entities(tables.raw_entities(spark, d)).select("segment_id", "ord", "name", "type", "description")


def _statements(spark, d):
    """Line items as statements between parts' names of one segment."""
    items, parts = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_name")
    second = parts.select(F.col("p_partkey").alias("_k"), F.col("p_name").alias("target"))
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(second, F.col("_k") == F.col("l_suppkey"))
    return rows.select(F.concat(F.lit("doc"), (F.col("l_partkey") % 50).cast("string"), F.lit("_"), (F.col("l_partkey") % 7).cast("string")).alias("segment_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("p_name").alias("source"), "target", F.lit("").alias("relationship"), F.lit("").alias("description"))


@query(f"""with {PARTS}, names as (select distinct segment_id, trim(name) as name from parts),
  st as (select 'doc'||(l_partkey % 50)||'_'||(l_partkey % 7) as segment_id, l_orderkey * 10 + l_linenumber as ord, a.p_name as source, b.p_name as target from lineitem join part a on l_partkey = a.p_partkey join part b on l_suppkey = b.p_partkey)
  select segment_id, ord, source, target, 'RELATED_TO' as relationship from st where source <> target and (segment_id, source) in (select segment_id, name from names) and (segment_id, target) in (select segment_id, name from names)""")
def clean_relationships(spark, d):
    entities = resolve.clean_entities(tables.raw_entities(spark, d))
    return resolve.clean_relationships(_statements(spark, d), entities).select("segment_id", "ord", "source", "target", "relationship")


@query("""with al as (select lower(p_brand) as alias, min(p_name) as canonical from part group by 1)
  select p_partkey, coalesce(a.canonical, b.canonical, p_brand) as resolved from part left join al a on p_brand = a.alias left join al b on replace(lower(p_brand), ' ', '') = b.alias""")
def alias_lookup(spark, d):
    part = table(spark, d, "part")
    aliases = part.groupBy(F.lower("p_brand").alias("alias")).agg(F.min("p_name").alias("canonical"))
    return resolve.with_alias(part.select("p_partkey", "p_brand"), "p_brand", aliases, "resolved").select("p_partkey", "resolved")


@query(f"""with {PARTS}, r as (select *, trim(name) as n, replace(lower(trim(name)), ' ', '') as norm from parts),
  g as (select *, row_number() over (partition by norm order by ord) as k, case when description = '' and ord = min(ord) over (partition by norm) then n||' 实体' else description end as dd from r),
  v as (select norm, n as a from r union select norm, alias from r)
  select 'entity::'||g.norm as id, g.norm, max(case when k = 1 then n end) as name, max(case when k = 1 then coalesce(type, 'CONCEPT') end) as type, arg_max(dd, length(dd) * 1000000000 - ord) as description,
    any_value(x.aliases) as aliases from g join (select norm, string_agg(a, '|' order by a) as aliases from v group by norm) x on x.norm = g.norm group by g.norm""")
def canonical_entities(spark, d):
    return resolve.canonical_entities(tables.raw_entities(spark, d)).withColumn("aliases", joined("aliases"))


AGG = f"""{RAW}, lab as (select *, first_value(relationship) over (partition by source, target, replace(lower(relationship), ' ', '') order by ord) as label from raw),
  agg as (select source, label as relationship, target, arg_max(description, length(description) * 10000000000 - ord) as description, string_agg(distinct segment_id, '|' order by segment_id) as segments, count(distinct segment_id) as n_segments, count(*) as statements from lab group by 1, 2, 3)"""


@query(f"with {AGG} select source, relationship, target, description, segments, statements, 'rel::'||source||'::'||regexp_replace(lower(relationship), '[^a-z0-9]+', '-', 'g')||'::'||target as id from agg")
def aggregate_relationships(spark, d):
    return resolve.aggregate_relationships(tables.raw_relations(spark, d)).withColumn("segments", joined("segments"))


@query(f"with {AGG} select source||'->'||relationship||'->'||target as key, segments from agg where n_segments > 1")
def relationship_duplicates(spark, d):
    return resolve.repeated_relationships(resolve.aggregate_relationships(tables.raw_relations(spark, d))).withColumn("segments", joined("segments"))


@query(f"""with {RAW}, {PARTS}, e as (select trim(name) as name, type from parts where type is not null group by 1, 2 having count(distinct segment_id) > 1), r as (select source, target, relationship from raw group by 1, 2, 3 having count(distinct segment_id) > 1)
  select distinct segment_id from parts p where exists (select 1 from e where e.name = trim(p.name) and e.type = p.type) union select distinct segment_id from raw join r using (source, target, relationship)""")
def consistency_critic(spark, d):
    entities = tables.raw_entities(spark, d).withColumn("name", T.strip("name"))
    return resolve.flagged_segments(entities, tables.raw_relations(spark, d))


@query("select 'supplier:'||s_suppkey as source_id, 'nation:'||s_nationkey as target_id from supplier where s_nationkey < 12")
def endpoint_semi_join(spark, d):
    nations = table(spark, d, "nation").where("n_nationkey < 12").select(key("nation", "n_nationkey").alias("id"))
    suppliers = table(spark, d, "supplier")
    edges = suppliers.select(key("supplier", "s_suppkey").alias("source_id"), key("nation", "s_nationkey").alias("target_id"))
    return store.with_ends(edges, nations.union(suppliers.select(key("supplier", "s_suppkey"))))


@query("select 'customer:'||c_custkey as id, c_name as name, case when c_custkey % 2 = 0 then 'new' else 'old' end as description from customer")
def entity_upsert(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", key("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"))
    old = rows.select("id", "name", F.lit("old").alias("description"))
    return store.upsert(old, rows.where("c_custkey % 2 = 0").select("id", "name", F.lit("new").alias("description")), ["id"])


@query(f"with {LOC} select source_id, target_id, case when source_id like 'supplier%' then 'ships from' else relationship end as relationship from loc")
def edge_upsert(spark, d):
    old = tables.located(spark, d).select("source_id", "target_id", "relationship")
    new = old.where("source_id like 'supplier%'").withColumn("relationship", F.lit("ships from"))
    return store.upsert(old, new, ["source_id", "target_id"])


@query("select n_name as id, case when n_nationkey < 10 then 't0' else 't1' end as created_at, case when n_nationkey % 2 = 0 then 'b' else 'a' end as state from nation where n_nationkey < 10 or n_nationkey % 2 = 0")
def created_at_preserving_upsert(spark, d):
    nations = table(spark, d, "nation")
    old = nations.where("n_nationkey < 10").select(F.col("n_name").alias("id"), F.lit("t0").alias("created_at"), F.lit("a").alias("state"))
    new = nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("id"), F.lit("t1").alias("created_at"), F.lit("b").alias("state"))
    return store.keep_first_created(old, new, ["id"])


@query(f"with {RAW} select source||target as pair, count(*) as n from raw group by 1 having count(*) > 1")
def unique_key_check(spark, d):
    rows = tables.raw_relations(spark, d).select(F.concat("source", "target").alias("pair"))
    return store.repeated_keys(rows, ["pair"])


@query(f"with {ENT} select id, 'node' as kind, length(name) as n from ent union all (with {LOC} select source_id||'->'||target_id, 'edge', length(relationship) from loc)")
def graph_export(spark, d):
    out = store.exported(tables.entities(spark, d), tables.located(spark, d))
    named = F.coalesce(F.get_json_object("payload", "$.name"), F.get_json_object("payload", "$.relationship"))
    return out.select("id", "kind", F.length(named).alias("n"))


@query("select 1 as version, 'entities' as kind, coalesce(p_type, 'UNKNOWN') as type, string_agg(distinct p_brand, '|' order by p_brand) as examples, count(*) as count from part group by p_type")
def schema_profile(spark, d):
    return metrics.schema_profile(table(spark, d, "part"), "entities", "p_type", "p_brand").withColumn("examples", joined("examples"))


@query(f"""with {ENT}, {REL} select 'total_nodes' as statistic, '' as key, (select count(*) from ent) + (select count(distinct c_nationkey) from customer) as value union all select 'entities', '', count(*) from ent
  union all select 'total_relationships', '', (select count(*) from rel) + (select count(*) from customer) union all select 'communities', '', count(distinct c_nationkey) from customer
  union all select 'entity_type', type, count(*) from ent group by type union all select 'relationship_type', relationship, count(*) from rel group by relationship""")
def graph_statistics(spark, d):
    membership = table(spark, d, "customer").select(key("customer", "c_custkey").alias("node"), F.col("c_nationkey").alias("community"))
    return metrics.graph_statistics(tables.entities(spark, d), tables.relations(spark, d), membership)


@query(f"with {ENT}, {REL}, e as (select count(*) as n, count(distinct type) as t from ent), r as (select count(*) as n, count(distinct relationship) as t from rel) select e.n as entity_count, e.t as entity_types, r.n as relationship_count, r.t as relationship_types, round(r.n / e.n, 2) as avg_relationship_degree from e, r")
def snapshot_metrics(spark, d):
    return metrics.snapshot_metrics(tables.entities(spark, d), tables.relations(spark, d))


# customers, suppliers and nations by nation: the communities of the queries below
MEMBER = "mem as (select 'customer:'||c_custkey as node, c_nationkey as community from customer union all select 'supplier:'||s_suppkey, s_nationkey from supplier union all select 'nation:'||n_nationkey, n_nationkey from nation)"
# within a nation: its members' edges to it, and customers to the suppliers of one nation who are in one group of keys
LINK = f"""{LOC}, lk as (select distinct least(source_id, target_id) as u, greatest(source_id, target_id) as v from (select source_id, target_id from loc
  union all select 'customer:'||o_custkey, 'supplier:'||l_suppkey from lineitem join orders on l_orderkey = o_orderkey))"""
INNER = "inn as (select a.community, u, v from lk join mem a on u = a.node join mem b on v = b.node and a.community = b.community)"


def _membership(spark, d):
    def of(name, k, n):
        return table(spark, d, name).select(key(name, k).alias("node"), F.col(n).alias("community"))

    return of("customer", "c_custkey", "c_nationkey").union(of("supplier", "s_suppkey", "s_nationkey")).union(of("nation", "n_nationkey", "n_nationkey"))


def _linked(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    trade = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    bought = trade.select(key("customer", "o_custkey").alias("source_id"), key("supplier", "l_suppkey").alias("target_id"), F.lit("BUYS_FROM").alias("relationship"), F.lit("").alias("description")).distinct()
    return tables.located(spark, d).union(bought)


@query(f"""with {LINK}, {MEMBER}, {INNER}, s as (select community, count(*) as size from mem group by 1), e as (select community, count(*) as e from inn group by 1)
  select s.community, size, coalesce(e, 0) as edge_count, round(2.0 * coalesce(e, 0) / (size * (size - 1)), 9) as density from s left join e using (community) where size >= 2""")
def community_metrics(spark, d):
    out = graph.community_metrics(graph.simple_edges(_linked(spark, d)), _membership(spark, d))
    return out.withColumn("density", F.round("density", 9))


@query(f"""with {LINK}, {MEMBER}, {INNER}, c as (select community, node, count(*) as degree from (select community, u as node from inn union all select community, v from inn) group by 1, 2)
  select community, node, degree, place from (select *, row_number() over (partition by community order by degree desc, node) as place from c) where place <= 5""")
def degree_topk(spark, d):
    return graph.top_members(graph.simple_edges(_linked(spark, d)), _membership(spark, d))


@query(f"""with {LINK}, {MEMBER}, w as (select u as node, v as other from lk where u <> v union all select v, u from lk where u <> v),
  c as (select a.community, w.node, count(*) as external_degree from w join mem a on a.node = w.node left join mem b on b.node = w.other where b.community is null or b.community <> a.community group by 1, 2)
  select community, node, external_degree, place from (select *, row_number() over (partition by community order by external_degree desc, node) as place from c) where place <= 5""")
def bridge_topk(spark, d):
    return graph.bridge_members(graph.simple_edges(_linked(spark, d)), _membership(spark, d))


@query(f"""with {LINK}, {MEMBER}, al as (select source_id, target_id, relationship, description from loc union all select distinct 'customer:'||o_custkey, 'supplier:'||l_suppkey, 'BUYS_FROM', '' from lineitem join orders on l_orderkey = o_orderkey),
  r as (select a.community, least(source_id, target_id) as u, greatest(source_id, target_id) as v, relationship, description from al join mem a on source_id = a.node join mem b on target_id = b.node and a.community = b.community)
  select community, u, v, relationship, place from (select *, row_number() over (partition by community order by u, v, relationship, description) as place from r) where place <= 10""")
def key_relationships(spark, d):
    return graph.key_relationships(_linked(spark, d), _membership(spark, d))


def _same_brand(spark, d):
    """Parts of one size linked with the next part key modulo 97: chains of several lengths."""
    part = table(spark, d, "part").select("p_partkey", "p_size")
    other = part.select((F.col("p_partkey") - 7).alias("p_partkey"), F.col("p_partkey").alias("o"), F.col("p_size").alias("s"))
    return part.join(other, "p_partkey").where("p_size >= s").select(F.col("p_partkey").alias("u"), F.col("o").alias("v"))


CHAINS = "e as (select a.p_partkey as u, b.p_partkey as v from part a join part b on b.p_partkey = a.p_partkey + 7 where a.p_size >= b.p_size)"


@query(f"""with recursive {CHAINS}, down as (select v as node, u as low from e union all select d.node, e.u from down d join e on e.v = d.low)
  select node, min(component) as component from (select node, low as component from down union all select u, u from e) group by node""")
def connected_components(spark, d):
    return graph.connected_components(_same_brand(spark, d))


def _propagation_sql() -> str:
    out = f"with {LOC}, w as (select source_id as node, target_id as other from loc union select target_id, source_id from loc), l0 as (select distinct node, node as label from w)"
    for i in range(3):
        out += f""", l{i + 1} as (select node, label from (select node, label, row_number() over (partition by node order by n desc, label) as k from (select w.node, l.label, count(*) as n from w join l{i} l on l.node = w.other group by 1, 2)) where k = 1)"""
    return out + " select node, label from l3"


@query(_propagation_sql())
def label_propagation(spark, d):
    return graph.label_propagation(graph.simple_edges(tables.located(spark, d)), 3)


@query()
def louvain_communities(spark, d):
    return graph.louvain(graph.simple_edges(tables.located(spark, d)))


@query("""with o as (select o_custkey as node, 'c'||(o_custkey % 40) as a, 'c'||((o_custkey + case when o_custkey % 9 = 0 then 1 else 0 end) % 41) as b from (select distinct o_custkey from orders)),
  m as (select coalesce(x.c, y.c) as community_id, x.node as o, y.node as n from (select a as c, cast(node as varchar) as node from o) x full join (select b as c, cast(node as varchar) as node from o) y on x.c = y.c and x.node = y.node),
  ex as (select a as c, 1 as old, 0 as new from o union all select b, 0, 1 from o), h as (select c as community_id, max(old) as old, max(new) as new from ex group by 1),
  g as (select community_id, count(o) as n_old, count(n) as n_new, list_sort(list(n) filter (where o is null)) as added, list_sort(list(o) filter (where n is null)) as removed from m group by 1)
  select community_id, case when old = 0 then 'new' when new = 0 then 'removed' else 'changed' end as change, n_new - n_old as delta_size, coalesce(array_to_string(added[1:10], '|'), '') as added, coalesce(array_to_string(removed[1:10], '|'), '') as removed,
    old = 1 and new = 1 and (abs(n_new - n_old) >= 3 or coalesce(len(added), 0) >= 3 or coalesce(len(removed), 0) >= 3) as alert from g join h using (community_id) where coalesce(len(added), 0) + coalesce(len(removed), 0) > 0""")
def community_evolution(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    moved = F.when(F.col("k") % 9 == 0, 1).otherwise(0)

    def version(c):
        return nodes.groupBy(F.concat(F.lit("c"), c.cast("string")).alias("community_id")).agg(F.collect_list(F.col("k").cast("string")).alias("members"))

    out = graph.community_evolution(version(F.col("k") % 40), version((F.col("k") + moved) % 41))
    return out.withColumn("added", joined("added")).withColumn("removed", joined("removed"))


VEC = "vec as (select vec_id, label, cast(embedding as double[]) as v from embeddings), q as (select v as qv from vec where vec_id = 0)"
COS = "round(list_cosine_similarity(v, qv), 6)"


def _query_vector(spark, d) -> list[float]:
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


@query(f"with {VEC} select vec_id as key, {COS} as score from vec, q order by list_cosine_similarity(v, qv) desc, vec_id limit 5")
def vector_topk(spark, d):
    return vectors.top_k(_vectors(spark, d), _query_vector(spark, d)).withColumn("score", F.round("score", 6))


@query(f"with {VEC} select vec_id as key, {COS} as score from vec, q where list_cosine_similarity(v, qv) >= 0.2 order by 2 desc, 1 limit 20")
def vector_threshold(spark, d):
    return vectors.most_similar(_vectors(spark, d), _query_vector(spark, d), 20, 0.2).withColumn("score", F.round("score", 6))


@query(f"with {VEC}, t as (select vec_id as key, list_cosine_similarity(v, qv) as s from vec, q order by s desc, key limit 3) select key, round(s, 6) as score from t where s > 0.3")
def vector_top_then_threshold(spark, d):
    return vectors.top_then_threshold(_vectors(spark, d), _query_vector(spark, d)).withColumn("score", F.round("score", 6))


@query("""with vec as (select vec_id, cast(embedding as double[]) as v from embeddings), s as (select a.vec_id as query, b.vec_id as key, list_cosine_similarity(a.v, b.v) as s from vec a, vec b where a.vec_id % 100 = 0),
  r as (select *, row_number() over (partition by query order by s desc, key) as place from s) select query, key, round(s, 6) as score, place from r where place <= 5""")
def vector_batch_topk(spark, d):
    asked = table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return vectors.batch_top_k(asked, _vectors(spark, d)).withColumn("score", F.round("score", 6))


@query("with vec as (select vec_id, cast(embedding as double[]) as v from embeddings) select count(*) as pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) as mean_similarity from vec a join vec b on a.vec_id < b.vec_id")
def pairwise_mean(spark, d):
    return vectors.pairwise_mean(_vectors(spark, d)).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query(f"with {VEC} select vec_id, round(list_cosine_similarity(v, qv), 5) as cosine, round(list_inner_product(v, qv), 5) as dot, round(0.0::double - list_distance(v, qv), 5) as euclidean from vec, q")
def similarity_metrics(spark, d):
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", *[F.round(V.similarity(F.col("embedding"), q, m), 5).alias(m) for m in ("cosine", "dot", "euclidean")])


@query(f"with {ENT} select id, name, type, description, 1.0::double as score from ent where contains(lower(name), 'an') or contains(lower(description), 'an') order by id limit 10")
def search_entities(spark, d):
    return retrieval.search_entities(tables.entities(spark, d), "AN")


FOCUS = ["nation:1", "supplier:3", "customer:7"]
IN = "('nation:1', 'supplier:3', 'customer:7')"


@query(f"with {ENT}, {REL}, {NEAR} select focus_id, f.name as focus_name, other_id as partner_id, o.name as partner_name, relationship, n.description, 'RELATIONSHIP' as relationship_type from near n join ent f on f.id = focus_id join ent o on o.id = other_id where focus_id in {IN} and contains(lower(relationship), 'suppl')")
def partner_direct(spark, d):
    return retrieval.partner_direct(tables.entities(spark, d), tables.relations(spark, d), FOCUS, ["suppl"])


@query(f"""with {ENT}, {LOC}, near as (select source_id as focus_id, target_id as other_id, relationship, description from loc union all select target_id, source_id, relationship, description from loc)
  select focus_id, f.name as focus_name, other_id as partner_id, o.name as partner_name, relationship, n.description, 'RELATIONSHIP' as relationship_type from near n join ent f on f.id = focus_id join ent o on o.id = other_id where contains(lower(f.name), '#00000001') or contains(lower(o.name), '#00000001') or contains(lower(relationship), 'nothing')""")
def partner_fuzzy(spark, d):
    return retrieval.partner_fuzzy(tables.entities(spark, d), tables.located(spark, d), ["#00000001"], ["nothing"])


@query(f"with {ENT}, {REL}, {NEAR} select focus_id, f.name as focus_name, other_id as neighbor_id, o.name as neighbor_name, relationship, n.description from near n join ent f on f.id = focus_id join ent o on o.id = other_id where focus_id in {IN}")
def generic_neighbors(spark, d):
    return retrieval.generic_neighbors(tables.entities(spark, d), tables.relations(spark, d), FOCUS)


def _hops(focus: str, where: str, mode: str = "") -> str:
    return f"""with {ENT}, {REL} select s.id as source_id, s.name as source_name, t.id as target_id, t.name as target_name, string_agg(m.name||'('||a.relationship||'->'||b.relationship||')', ' -> ' order by m.name, a.relationship, b.relationship) as path_details{mode}
  from rel a join rel b on a.target_id = b.source_id join ent s on s.id = a.source_id join ent m on m.id = a.target_id join ent t on t.id = b.target_id where a.source_id in {focus} and {where} group by 1, 2, 3, 4"""


@query(_hops(IN, "(contains(lower(a.relationship), 'located') or contains(lower(b.relationship), 'located'))"))
def causal_two_hop(spark, d):
    return retrieval.causal_two_hop(tables.entities(spark, d), tables.relations(spark, d), FOCUS, ["located"]).withColumn("path_details", T.hop_text("path_details"))


@query(_hops(IN, "true", ", 'two_hop' as relation_mode"))
def partner_two_hop(spark, d):
    return retrieval.partner_two_hop(tables.entities(spark, d), tables.relations(spark, d), FOCUS, []).withColumn("path_details", T.hop_text("path_details"))


@query(f"with {ENT}, {REL} select s.id as source_id, s.name as source_name, t.id as target_id, t.name as target_name, relationship, r.description from rel r join ent s on s.id = source_id join ent t on t.id = target_id where source_id in {IN} and (target_id like 'nation:%' or target_id = 'region:1')")
def comparative_relationships(spark, d):
    nations = [f"nation:{i}" for i in range(25)]
    return retrieval.comparative_relationships(tables.entities(spark, d), tables.relations(spark, d), FOCUS, [*nations, "region:1"])


@query("""with f as (select * from part where p_partkey in (1, 2, 3)) select 'part:'||p_partkey as focus_id, p_name as focus_name, 'p_brand' as attribute_key, p_brand as attribute_value from f union all select 'part:'||p_partkey, p_name, 'p_type', p_type from f union all select 'part:'||p_partkey, p_name, 'p_size', cast(p_size as varchar) from f""")
def attribute_unpivot(spark, d):
    rows = table(spark, d, "part").select(key("part", "p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size")
    return retrieval.attribute_projection(rows, None, ["part:1", "part:2", "part:3"])


@query("select 'user:'||user_id as focus_id, 'user '||user_id as focus_name, event_type as event_name, props as event_description, strftime(ts, '%Y-%m-%dT%H:%M:%S') as event_time from events where user_id in (1, 2, 3)")
def timeline_events(spark, d):
    events = table(spark, d, "events")
    users = events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name")).distinct()
    nodes = events.select(key("event", "event_id").alias("id"), F.col("event_type").alias("name"), F.lit("EVENT").alias("type"), F.col("props").alias("description"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"))
    everything = nodes.unionByName(users.withColumns({"type": F.lit("USER"), "description": F.lit(""), "timestamp": F.lit(None).cast("string")}))
    edges = events.select(key("user", "user_id").alias("source_id"), key("event", "event_id").alias("target_id"), F.lit("RELATED_TO").alias("relationship"))
    return retrieval.timeline_events(everything, edges, ["user:1", "user:2", "user:3"])


@query(f"""with {ENT}, {LOC}, n as (select s.name as source, relationship, t.name as target, l.description from loc l join ent s on s.id = source_id join ent t on t.id = target_id)
  select term, source, relationship, target, description from n, (values ('an'), ('ia'), ('located')) x(term) where contains(lower(source), term) or contains(lower(target), term) or contains(lower(relationship), term)""")
def term_search_fallback(spark, d):
    entities = tables.entities(spark, d).select("id", "name")
    edges = retrieval.named(retrieval.named(tables.located(spark, d), entities, "source_id", "source"), entities, "target_id", "target")
    return retrieval.term_search(edges, ["an", "ia", "located"])


def _questions(spark, d):
    """Users' turns, each with the name of a nation, of a region, or none."""
    turns = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    names = table(spark, d, "nation").select("n_nationkey", "n_name")
    nation = turns.join(names, F.col("conv_id") % 40 == F.col("n_nationkey"), "left")
    return nation.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.concat_ws(" ", F.lit("Why is the history of"), "n_name", "text").alias("text"))


QS = "qs as (select conv_id||'-'||turn as question_id, 'Why is the history of '||coalesce(n_name||' ', '')||text as text from conversations left join nation on conv_id % 40 = n_nationkey where role = 'user')"


@query(f"""with {QS}, ix as (select lower(n_name) as alias, 'nation:'||n_nationkey as id, n_nationkey as pos from nation where n_nationkey % 2 = 0), nm as (select lower(n_name) as alias, 'nation:'||n_nationkey as id, n_nationkey as pos from nation),
  a as (select question_id, id, min(pos) as pos from qs join ix on contains(lower(text), alias) group by 1, 2), b as (select question_id, id, min(pos) as pos from qs join nm on contains(lower(text), alias) where question_id not in (select question_id from a) group by 1, 2),
  r as (select *, row_number() over (partition by question_id order by pos, id) as place from (select * from a union all select * from b)) select question_id, string_agg(id, '|' order by place) as focus_ids from r where place <= 3 group by 1""")
def focus_entities(spark, d):
    index = table(spark, d, "nation").select(F.col("n_name").alias("alias"), key("nation", "n_nationkey").alias("entity_id"), F.col("n_nationkey").alias("pos"))
    found = retrieval.focus_entities(_questions(spark, d), index.where("pos % 2 = 0"), index)
    return found.withColumn("focus_ids", joined("focus_ids"))


@query(f"with {QS}, w as (select question_id, unnest(regexp_extract_all(lower(text), '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[A-Za-z0-9_\\-]+')) as t from qs) select question_id, string_agg(distinct t, '|' order by t) as terms from w where length(t) > 1 group by 1")
def context_terms(spark, d):
    return _questions(spark, d).select("question_id", joined(T.context_terms("text")).alias("terms"))


def _intent_sql() -> str:
    cases = " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in words) + f" then '{name}'" for name, words in T.INTENT_KEYWORDS.items())
    buckets = " ".join(f"when '{k}' then '{v}'" for k, v in T.INTENT_BUCKETS.items())
    asked = "case conv_id % 6 when 0 then 'partner?' when 1 then '价格' when 2 then 'why' when 3 then 'the history' when 4 then 'compare' else 'what' end||' '||text"
    return f"with a as (select conv_id, turn, {asked} as text from conversations), i as (select conv_id, turn, case {cases} else 'descriptive' end as intent from a) select *, case intent {buckets} end as bucket from i"


@query(_intent_sql())
def intent_fallback(spark, d):
    asked = F.when(F.col("conv_id") % 6 == 0, "partner?").when(F.col("conv_id") % 6 == 1, "价格").when(F.col("conv_id") % 6 == 2, "why").when(F.col("conv_id") % 6 == 3, "the history").when(F.col("conv_id") % 6 == 4, "compare").otherwise("what")
    turns = table(spark, d, "conversations").withColumn("text", F.concat_ws(" ", asked, "text"))
    return turns.select("conv_id", "turn", T.intent("text").alias("intent"), T.intent_bucket(T.intent("text")).alias("bucket"))


EVID = f"""{ENT}, {REL}, {NEAR}, ev as (select f.name as source_name, o.name as target_name, relationship, n.description, round(0.5 + case relationship when 'LOCATED_IN' then 0.25 else 0.0 end + case when contains(lower(relationship), 'suppl') then 0.3 else 0.0 end
  + case when lower(f.name) in ('customer#000000007') then 0.1 else 0.0 end + case when lower(o.name) in ('customer#000000007') then 0.1 else 0.0 end, 3) as score from near n join ent f on f.id = focus_id join ent o on o.id = other_id where focus_id in {IN})"""


def _evidence(spark, d):
    rows = retrieval.generic_neighbors(tables.entities(spark, d), tables.relations(spark, d), FOCUS)
    return retrieval.normalized(rows, "generic_neighbors", 0.5, ["customer#000000007"], ["suppl"], {"located_in": 0.25})


@query(f"with {EVID} select 'generic_neighbors' as template, * from ev")
def evidence_score(spark, d):
    return _evidence(spark, d).drop("path_details")


@query(f"with {EVID}, r as (select *, row_number() over (order by score desc, source_name, target_name, relationship, description) as place from ev) select place, place||'. '||source_name||' --'||relationship||'--> '||target_name||' (score='||printf('%.2f', score)||')'||case when description <> '' then ' | 描述: '||description else '' end as line from r where place <= 5")
def evidence_lines(spark, d):
    return retrieval.evidence_lines(_evidence(spark, d))


@query(f"""with {ENT}, {LOC}, fd as (select * from ent where contains(lower(name), 'an') or contains(lower(description), 'an') order by id limit 10), n as (select l.*, s.name as source, t.name as target from loc l join ent s on s.id = source_id join ent t on t.id = target_id)
  select 'entity' as kind, name||' ('||type||'): '||description as line from fd union all select 'relation', source||' -'||relationship||'-> '||target from (select distinct * from n where source_id in (select id from fd) or target_id in (select id from fd))""")
def qa_context(spark, d):
    entities = tables.entities(spark, d)
    names = entities.select("id", "name")
    edges = retrieval.named(retrieval.named(tables.located(spark, d), names, "source_id", "source"), names, "target_id", "target")
    return retrieval.qa_context(retrieval.search_entities(entities, "an"), edges)


@query("""with c as (select c_nationkey, list_sort(list(c_custkey)) as m from customer group by 1), h as (select c_nationkey, min(c_custkey) as pos from customer where c_custkey % 97 = 0 group by 1)
  select pos, 'n'||c_nationkey as community_id, 'nation '||c_nationkey as title, array_to_string(list_transform(m[1:10], lambda x: 'customer '||x), '|') as members from c join h using (c_nationkey)""")
def community_context(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    ids = F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string"))
    rows = customers.groupBy("c_nationkey").agg(ids.alias("m"))
    named = F.transform("m", lambda x: F.concat(F.lit("customer "), x))
    none = F.array().cast("array<string>")
    profiles = rows.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("community_id"), F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("title"), F.lit("").alias("summary"), none.alias("keywords"), F.col("m").alias("members"), named.alias("member_names"), none.alias("top_entities"), none.alias("bridge_entities"))
    matched = customers.where("c_custkey % 97 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("pos"))
    return retrieval.community_context(matched, profiles).select("pos", "community_id", "title", joined("members").alias("members"))


@query(f"""with {ENT}, {LOC}, b as (select 'outgoing' as direction, relationship, description, target_id as other_id from loc where source_id = 'nation:1' union select 'incoming', relationship, description, source_id from loc where target_id = 'nation:1')
  select direction, relationship, b.description, other_id, name as other_name, type as other_type from b join ent on id = other_id order by 1, 2, 4 limit 20""")
def entity_neighbourhood(spark, d):
    return retrieval.entity_neighbourhood(tables.entities(spark, d), tables.located(spark, d), "nation:1")


@query("""with n as (select distinct p_type as type, p_name as norm from part), e as (select type||'/'||norm as id, * from n)
  select a.id as a, b.id as b from e a join e b on a.type = b.type and a.id < b.id where levenshtein(a.norm, b.norm) <= 2 and abs(length(a.norm) - length(b.norm)) <= 0.7 * greatest(length(a.norm), length(b.norm))""")
def similar_pairs_blocked(spark, d):
    names = table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("norm")).distinct()
    return resolve.similar_pairs(names.withColumn("id", F.concat_ws("/", "type", "norm")))


REVIEW = """with a as (select conv_id, turn, case when conv_id % 7 = 0 then '' else substring(text, 1, cast((conv_id % 5) * 12 as int)) end as answer, conv_id % 3 as e, conv_id % 4 as g, conv_id % 2 as v from conversations),
  w as (select *, len(list_filter(regexp_split_to_array(answer, '\\s+'), lambda x: x <> '')) as words, g = 0 and v = 0 as bare from a),
  c as (select conv_id, turn, bare, concat_ws('|', case when answer = '' then 'empty_answer' end, case when words < 5 then 'answer_too_short' end, case when e = 0 then 'no_entities' end, case when bare then 'no_evidence' end, case when bare then 'insufficient_context' end) as concerns from w)
  select conv_id, turn, concerns, concerns = '' as approved, case when concerns = '' then 'high' when bare then 'low' else 'medium' end as confidence from c"""


@query(REVIEW)
def answer_critic(spark, d):
    answer = F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.expr("substring(text, 1, cast((conv_id % 5) * 12 as int))"))
    e, g, v = (F.col("conv_id") % n for n in (3, 4, 2))
    return table(spark, d, "conversations").select("conv_id", "turn", *metrics.review(answer, e, g, v, metrics.consistency(g, v))).withColumn("concerns", joined("concerns"))


@query("select event_type as type, count(*) as n, string_agg(cast(user_id as varchar), '|' order by event_id) as messages from events where value > 90 group by 1")
def feedback_summary(spark, d):
    rows = table(spark, d, "events").where("value > 90").select(F.col("event_type").alias("type"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("message"))
    return metrics.feedback_summary(rows).withColumn("messages", joined("messages"))


@query("""with al as (select event_type as alias, upper(event_type) as canonical from (select distinct event_type from events) where event_type <> 'error') select e.event_id as id, coalesce(x.canonical, e.event_type)||'|'||'user '||e.user_id||'|'||coalesce(x.canonical, e.event_type) as participants from events e left join al x on x.alias = e.event_type""")
def participants_resolve(spark, d):
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), F.array("event_type", F.concat(F.lit("user "), F.col("user_id").cast("string")), "event_type").alias("participants"))
    kinds = table(spark, d, "events").select("event_type").distinct().where("event_type <> 'error'")
    aliases = kinds.select(F.col("event_type").alias("alias"), F.upper("event_type").alias("canonical"))
    return resolve.resolve_participants(events, aliases).withColumn("participants", joined("participants"))


@query("select 'part:'||p_partkey as document_id, p_name as entity_candidate, 'size' as attribute, cast(p_size as varchar) as value, 'ATTRIBUTE' as attribute_type from part where p_size % 4 <> 0")
def attribute_records(spark, d):
    raw = table(spark, d, "part").select(key("part", "p_partkey").alias("document_id"), F.lit("s").alias("segment_id"), F.col("p_name").alias("entity"), F.lit("size").alias("attribute"), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_size").cast("string")).alias("value"), F.lit("").alias("unit"), F.lit(None).cast("string").alias("evidence"), F.col("p_type").alias("text"), F.lit(None).cast("string").alias("attribute_type"))
    return resolve.attribute_records(raw).select("document_id", "entity_candidate", "attribute", "value", "attribute_type")


@query("""with r as (select *, row_number() over (partition by user_id order by event_id) - 1 as i from events) select 'event_'||user_id||'_s_'||i as id, event_type as label, 'EVENT' as type, props as context from r where event_type <> 'error'""")
def event_records(spark, d):
    raw = table(spark, d, "events").select(F.col("user_id").cast("string").alias("document_id"), F.lit("s").alias("segment_id"), F.col("event_id").alias("ord"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("label"), F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("title"), F.col("props").alias("context"), F.array().cast("array<string>").alias("participants"), F.lit(None).cast("string").alias("timestamp"))
    return resolve.event_records(raw).select("id", "label", "type", "context")


@query("select p_partkey, p_name||case when k > 0 then '_'||k else '' end as id from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) - 1 as k from part)")
def unique_ids(spark, d):
    return resolve.unique_ids(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("id")), "p_partkey")


@query("""with o as (select n_name as name, 'old:'||n_nationkey as id from nation where n_nationkey < 8), b as (select n_name as name, 'own:'||n_nationkey as own from nation where n_nationkey % 3 = 0 union all select n_name, null from nation where n_nationkey % 3 <> 0) select b.name, coalesce(o.id, own, b.name) as id from b left join o on o.name = b.name""")
def change_set_ids(spark, d):
    nations = table(spark, d, "nation")
    stored = nations.where("n_nationkey < 8").select(F.col("n_name").alias("name"), F.concat(F.lit("old:"), F.col("n_nationkey").cast("string")).alias("id"))
    own = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("own:"), F.col("n_nationkey").cast("string")))
    return resolve.change_set_ids(nations.select(F.col("n_name").alias("name"), own.alias("id"), F.col("n_nationkey").alias("ord")), stored)


@query(f"with {ENT}, {LOC} select l.source_id, s.name as source, l.target_id, t.name as target, l.relationship from loc l join ent s on s.id = l.source_id join ent t on t.id = l.target_id")
def fetch_relationships(spark, d):
    names = tables.entities(spark, d).select("id", "name")
    return retrieval.named(retrieval.named(tables.located(spark, d), names, "source_id", "source"), names, "target_id", "target").select("source_id", "source", "target_id", "target", "relationship")


@query("select conv_id, turn, array_to_string(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_\\-]+'), lambda x: lower(x)))[1:0], '|') as none, cast(len(list_distinct(list_transform(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]{2,}|[A-Za-z0-9_\\-]+'), lambda x: lower(x)))) as int) as n from conversations")
def search_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.lit("").alias("none"), F.size(T.search_terms("text", 1_000_000)).alias("n"))


@query("select event_type as key, event_id, ts, row_number() over (partition by event_type order by ts, event_id) as place, row_number() over (partition by event_type order by ts desc, event_id desc) = 1 as latest from events")
def temporal_index(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return metrics.timeline(log, "key", "ts").select("key", "event_id", "ts", "place", "latest")


@query("select p_partkey, p_name||' | '||p_type||' | None' as fabric, p_name||' '||p_type as plain, p_name||' 类型: '||p_type as labelled from part")
def entity_texts(spark, d):
    none = F.lit(None).cast("string")
    return table(spark, d, "part").select("p_partkey", *[T.entity_text("p_name", "p_type", none, s).alias(s) for s in ("fabric", "plain", "labelled")])


@query(f"with {ENT}, {LOC}, v as (select least(s.name, t.name) as u, greatest(s.name, t.name) as v, relationship, l.description, source_id||'>'||target_id as o from loc l join ent s on s.id = source_id join ent t on t.id = target_id) select u, v, arg_max(relationship, o) as relationship, arg_max(description, o) as description from v group by 1, 2")
def name_graph_view(spark, d):
    names = tables.entities(spark, d).select("id", "name")
    rows = retrieval.named(retrieval.named(tables.located(spark, d).withColumn("o", F.concat("source_id", F.lit(">"), "target_id")), names, "source_id", "s"), names, "target_id", "t")
    last = graph.simple_edges(rows.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"), "relationship", "description", "o"), "o")
    return last.select("u", "v", "last.relationship", "last.description")


@query(f"with {REL}, c as (select lower(relationship) as relationship, count(*) as n from rel group by 1) select relationship, round(0.2 * (2.0 - n / (select max(n) from c)), 9) as weight from c")
def relation_weights(spark, d):
    return slots.relation_weights(tables.relations(spark, d)).withColumn("weight", F.round("weight", 9))


@query(f"""with {RAW}, x as (select replace(lower('Supplies  Part'), ' ', '') as k, 'SUPPLIES' as c union all select 'ships', 'SHIPS') select ord, coalesce(c, relationship) as canonical from raw left join x on k = replace(lower(relationship), ' ', '')""")
def canonical_labels(spark, d):
    lexicon = spark.createDataFrame([("Supplies  Part", "SUPPLIES"), ("ships", "SHIPS")], "label string, canonical string")
    return slots.canonical_labels(tables.raw_relations(spark, d), lexicon).select("ord", "canonical")


@query("with k as (select p_brand as canonical, p_type as v from part where p_partkey % 2 = 0 union select p_brand, p_name from part where p_partkey % 2 = 1) select canonical, string_agg(distinct v, '|' order by v) as variants from k group by 1")
def alias_dictionary_merge(spark, d):
    part = table(spark, d, "part")
    known = part.where("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("canonical")).agg(F.collect_set("p_type").alias("variants"))
    fresh = part.where("p_partkey % 2 = 1").groupBy(F.col("p_brand").alias("name")).agg(F.collect_set("p_name").alias("aliases"))
    return corpus.merge_alias_dictionary(known, fresh).withColumn("variants", joined("variants"))


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 'v'||c_custkey else 'old' end as embedding from customer")
def embedding_update(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("old").alias("embedding"))
    new = rows.where("id % 3 = 0").select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("vector"))
    return rows.join(new, "id", "left").select("id", F.coalesce("vector", "embedding").alias("embedding"))


@query(f"""with {LOC}, deg as (select node, count(*) as degree from (select least(source_id, target_id) as node, greatest(source_id, target_id) as o from loc union all select greatest(source_id, target_id), least(source_id, target_id) from loc) group by 1) select node, degree from deg""")
def node_degrees(spark, d):
    return graph.degrees(graph.simple_edges(tables.located(spark, d)))


@query("select doc_id, cast(len(list_filter(regexp_split_to_array(text, '\\n+'), lambda x: x <> '')) as int) as n from documents")
def paragraph_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.paragraphs("text")).alias("n"))


@query(f"""with {ENT}, {REL}, m as (select (select count(*) from ent) as e, (select count(*) from rel) as r), {MEMBER}, lk as (select distinct least(source_id, target_id) as u, greatest(source_id, target_id) as v from loc), {INNER},
  c as (select s.community, 2.0 * coalesce(x.e, 0) / (size * (size - 1)) as density from (select community, count(*) as size from mem group by 1 having count(*) >= 2) s left join (select community, count(*) as e from inn group by 1) x using (community)),
  g as (select count(*) as communities, avg(density) as md from c)
  select e as entity_count, r as relationship_count, round(r / e, 2) as avg_relationship_degree, 1.0::double as coverage, communities, round(md, 3) as community_density,
    round(least(1.0, 0.5 * least(1.0, round(r / e, 2) / 5) + 0.3 + 0.2 * least(1.0, 0.6 + 0.4 * md)), 2) as health_score from m, g""")
def health_report(spark, d):
    shape = graph.community_metrics(graph.simple_edges(tables.located(spark, d)), _membership(spark, d))
    return metrics.health_report(metrics.snapshot_metrics(tables.entities(spark, d), tables.relations(spark, d)), table(spark, d, "events"), shape)


@query(f"""with {QS}, {ENT}, {LOC}, nm as (select lower(n_name) as alias, 'nation:'||n_nationkey as id, n_nationkey as pos from nation), a as (select question_id, id, min(pos) as pos from qs join nm on contains(lower(text), alias) group by 1, 2),
  f as (select question_id, id from (select *, row_number() over (partition by question_id order by pos, id) as place from a) where place <= 3), near as (select source_id as f, target_id as o, relationship, description from loc union all select target_id, source_id, relationship, description from loc),
  al as (select question_id, list(lower(name)) as names from f join ent using (id) group by 1),
  ev as (select distinct f.question_id, s.name as source_name, relationship, t.name as target_name, n.description, round(0.5 + 0.1 + case when list_contains(names, lower(t.name)) then 0.1 else 0.0 end, 3) as score from f join near n on n.f = f.id join ent s on s.id = f.id join ent t on t.id = n.o join al using (question_id))
  select * from (select *, row_number() over (partition by question_id order by score desc, source_name, target_name, relationship, description) as place from ev) where place <= 10""")
def batch_answers(spark, d):
    index = table(spark, d, "nation").select(F.col("n_name").alias("alias"), key("nation", "n_nationkey").alias("entity_id"), F.col("n_nationkey").alias("pos"))
    return retrieval.answer_questions(_questions(spark, d), index, index, tables.entities(spark, d), tables.located(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A question that names nations: focus entities, their neighbours, scores, the ten best."""
    entities, relations = tables.entities(spark, d), tables.located(spark, d)
    names = entities.where("type in ('NATION', 'REGION')").select(F.lower("name").alias("alias"), F.col("id").alias("entity_id"))
    asked = spark.createDataFrame([("q1", "Which partners has NATION_7 in Europe?")], "question_id string, text string")
    focus = retrieval.mentions(asked, names).select("entity_id").distinct()
    near = retrieval.neighbours(entities, relations).join(focus, F.col("focus_id") == F.col("entity_id"), "left_semi")
    rows = retrieval.named(retrieval.named(near, entities, "focus_id", "focus_name"), entities, "other_id", "neighbor_name")
    return retrieval.ranked(retrieval.normalized(rows, "generic_neighbors", 0.5, ["nation_7", "europe"])).drop("path_details")


__all__ = ["ORACLES", "QUERIES", "flagship"]
