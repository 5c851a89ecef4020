"""Registered queries of change sets, contains joins, plans of many questions, communities and slots, each run through its operator, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ingest_queries import folder, joined
from .operators import chunking, containment, extract, graph, metrics, vectors
from .plans import batch
from .plans.engine import Engine
from .queries import ENT, LOC, query
from .sources import corpus, deltas, store, tables
from .sources.store import ChangeSet
from .sources.tables import table


def named(kind: str, column: str):
    return F.concat(F.lit(kind), F.col(column).cast("string"))


# Change sets as deltas.
def _changed_store(spark: SparkSession, d: str) -> deltas.DeltaStore:
    """Nations and customers, then every third customer anew with a customer that is new, that batch twice."""
    kept = deltas.DeltaStore(spark, folder(spark), 8)
    people = table(spark, d, "customer").select(named("c", "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), "c_custkey", "c_nationkey")
    nations = table(spark, d, "nation").select(named("n", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("NATION").alias("type"))
    edges = people.select(named("r", "c_custkey").alias("id"), F.col("id").alias("source_id"), named("n", "c_nationkey").alias("target_id"), F.lit("IN").alias("relationship"), F.lit("first").alias("description"))
    kept.apply(ChangeSet("a", nations))
    kept.apply(ChangeSet("b", people.select("id", "name", "type"), edges))
    more = people.where("c_custkey % 3 = 0").select("id", "name", F.lit("SEEN AGAIN").alias("type"))
    new = people.where("c_custkey % 3 = 0").select(F.concat("id", F.lit("x")).alias("id"), F.concat("name", F.lit(" x")).alias("name"), F.lit("NEW").alias("type"))
    later = edges.where("target_id in ('n1', 'n2')").withColumn("description", F.lit("later"))
    lost = edges.withColumn("target_id", F.lit("nobody"))
    for _ in range(2):
        kept.apply(ChangeSet("c", more.union(new), later.union(lost)))
    return kept


@query("""select 'n'||n_nationkey as id, n_name as name, 'NATION' as type from nation union all select 'c'||c_custkey, c_name, case when c_custkey % 3 = 0 then 'SEEN AGAIN' else c_mktsegment end from customer
  union all select 'c'||c_custkey||'x', c_name||' x', 'NEW' from customer where c_custkey % 3 = 0""")
def delta_entities(spark, d):
    return _changed_store(spark, d).read("entities").select("id", "name", "type")


@query("select 'r'||c_custkey as id, 'c'||c_custkey as source_id, 'n'||c_nationkey as target_id, case when c_nationkey in (1, 2) then 'later' else 'first' end as description from customer")
def delta_relationships(spark, d):
    """After a compaction, which changes no row."""
    kept = _changed_store(spark, d)
    kept.compact()
    return kept.read("relationships").select("id", "source_id", "target_id", "description")


@query("""with a as (select count(*) as n from nation), c as (select count(*) as c, count(case when c_custkey % 3 = 0 then 1 end) as x from customer)
  select 1 as version, n as entities, 0 as relationships from a union all select 2, n + c, c from a, c union all select 3, n + c + x, c from a, c union all select 4, n + c + x, c from a, c""")
def delta_versions(spark, d):
    """The totals that each version keeps, and the rows that its reader sees."""
    kept = _changed_store(spark, d)
    rows = []
    for v in range(1, kept.version() + 1):
        total = kept.state(v).totals
        seen = kept.read("entities", version=v).count()
        rows.append((v, seen if seen == total["entities"] else -1, total.get("relationships", 0)))
    return spark.createDataFrame(rows, "version int, entities long, relationships long")


@query("select 2 * count(*) as entity_count, count(*) as relationship_count from customer where c_custkey % 3 = 0")
def change_set_counts(spark, d):
    """What a change set holds, not what the store does."""
    people = table(spark, d, "customer").where("c_custkey % 3 = 0").select(named("c", "c_custkey").alias("id"))
    change = ChangeSet("r", people.union(people), people)
    return spark.createDataFrame([(change.entity_count(), change.relationship_count())], "entity_count long, relationship_count long")


@query("select 'c'||c_custkey as id, c_name as name from customer where c_custkey % 7 = 0 union all select 'n3', n_name from nation where n_nationkey = 3")
def delta_lookup(spark, d):
    """Rows of given keys, from these keys' buckets alone."""
    kept = _changed_store(spark, d)
    keys = table(spark, d, "customer").where("c_custkey % 7 = 0").select(named("c", "c_custkey").alias("id")).union(spark.sql("select 'n3' as id union all select 'none'"))
    return kept.near("entities", keys).join(keys, "id", "left_semi").select("id", "name")


# Contains joins and similar names.
TERMS = "terms as (select distinct lower(w) as pattern from (select unnest(string_split(text, ' ')) as w from benchmark) where length(w) >= 4)"


@query(f"with {TERMS} select conv_id||'-'||turn as text_id, pattern from conversations, terms where contains(lower(text), pattern)")
def contained_terms(spark, d):
    """All words of the benchmark that stand anywhere in a turn, also inside words."""
    words = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("pattern")).where(F.length("pattern") >= 4)
    turns = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("text_id"), "text")
    return containment.contained(turns, words)


@query("with k as (select p_partkey, string_split(p_name, ' ')[2] as key from part where p_partkey % 50 = 0) select key, c.p_partkey as id from k, part c where contains(lower(c.p_name), lower(key))")
def key_entity_matches(spark, d):
    parts = table(spark, d, "part")
    keys = parts.where("p_partkey % 50 = 0").select(F.split("p_name", " ")[1].alias("key"))
    return containment.key_entities(keys, parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")))


GRAMS = """g as (select n.id, n.type, n.norm, list_distinct(list_transform(range(1, length(norm) + 2), lambda i: substr(chr(1)||norm||chr(1), i, 2))) as g
  from (select distinct p_type||'/'||p_name as id, p_type as type, p_name as norm from part) n)"""


@query(f"""with {GRAMS}, p as (select a.id as a, b.id as b, len(list_intersect(a.g, b.g)) as s, len(a.g) + len(b.g) as n, length(a.norm) as la, length(b.norm) as lb from g a join g b on a.type = b.type and a.id < b.id and a.norm <> b.norm)
  select a, b, round(s / (n - s), 9) as similarity from p where s >= 0.45 * (n - s) and abs(la - lb) <= 0.7 * greatest(la, lb)""")
def similar_names(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_name").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("norm")).distinct()
    return containment.similar_names(rows, 0.45).withColumn("similarity", F.round("similarity", 9))


# Many questions at once.
@query(f"""with {LOC}, cu as (select c.*, n.n_name, r.r_name, (n.n_nationkey + case when c_custkey % 8 = 7 then 1 else 0 end) % (select count(*) from nation) as said from customer c join nation n on c_nationkey = n_nationkey join region r on n_regionkey = r_regionkey),
  met as (select c_custkey, list(x.n_nationkey order by x.n_nationkey)[:2] as ns from cu join nation s on s.n_nationkey = said join nation x on contains(lower('compare '||c_name||' with '||s.n_name), lower(x.n_name)) where c_custkey % 4 = 3 group by 1),
  nm as (select 'region:'||r_regionkey as id, r_name as name from region union all select 'nation:'||n_nationkey, n_name from nation union all select 'customer:'||c_custkey, c_name from customer union all select 'supplier:'||s_suppkey, s_name from supplier),
  lt as (select s.name as source_name, t.name as target_name, relationship, description, row_number() over (order by s.name, t.name, relationship, description) as place from loc join nm s on s.id = source_id join nm t on t.id = target_id),
  hop as (select 'c'||c_custkey as question_id, case when c_custkey % 4 = 2 then 'causal_two_hop' else 'partner_two_hop' end as template, case when c_custkey % 4 = 2 then 1.2 else 0.9 end as score, c_name as source_name, r_name as target_name, '' as relationship, n_name||'(LOCATED_IN->LOCATED_IN)' as description
    from cu left join met using (c_custkey) where c_custkey % 4 in (1, 2) or c_custkey % 4 = 3 and not list_contains(ns, c_nationkey))
  select 'c'||c_custkey as question_id, 1 as place, 'partner_direct' as template, 1.1 as score, c_name as source_name, n_name as target_name, 'LOCATED_IN' as relationship, 'customer in nation' as description from cu where c_custkey % 4 = 0
  union all select question_id, 1, template, score, source_name, target_name, relationship, description from hop
  union all select 'c'||c_custkey, 1, 'comparative_relationships', 1.2, c_name, n_name, 'LOCATED_IN', 'customer in nation' from cu join met using (c_custkey) where list_contains(ns, c_nationkey)
  union all select 'r'||r_regionkey, place, 'term_search', 0.5, source_name, target_name, relationship, description from region, lt where place <= 10""")
def batch_plans(spark, d):
    """A question for each customer, of four classes, and some that name no entity: patterns in their order, then the terms."""
    people, nations = table(spark, d, "customer"), table(spark, d, "nation")
    n = nations.count()
    other = (F.col("c_nationkey") + F.when(F.col("c_custkey") % 8 == 7, 1).otherwise(0)) % n
    kind = F.col("c_custkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("Which partner has "), "c_name")).when(kind == 1, F.concat(F.lit("Tell of "), "c_name")).when(kind == 2, F.concat(F.lit("Why is "), "c_name", F.lit(" located there"))).otherwise(F.concat(F.lit("compare "), "c_name", F.lit(" with "), "n_name"))
    asked = people.join(nations, other == F.col("n_nationkey")).select(named("c", "c_custkey").alias("question_id"), text.alias("text"))
    asked = asked.union(table(spark, d, "region").select(named("r", "r_regionkey"), F.lit("About located things")))
    entities = tables.entities(spark, d).where("type <> 'PART'").withColumn("aliases", F.array().cast("array<string>"))
    names = people.select(F.col("c_name").alias("alias"), named("customer:", "c_custkey").alias("entity_id"), F.col("c_custkey").alias("pos"))
    names = names.union(nations.select("n_name", named("nation:", "n_nationkey"), F.col("n_nationkey") + 1_000_000_000))
    located = graph.checkpointed(batch.with_name(batch.with_name(tables.located(spark, d), entities, "source_id", "source"), entities, "target_id", "target"))
    rows = graph.checkpointed(batch.asked(asked, entities, batch.retrieval.focus_entities(asked, names, names)))
    return batch.evidence(rows, entities, located).select("question_id", "place", "template", "score", "source_name", "target_name", "relationship", "description")


# Communities.
STARS = "e as (select 'customer:'||c_custkey as u, 'nation:'||c_nationkey as v from customer union all select 'nation:'||s_nationkey, 'supplier:'||s_suppkey from supplier)"


def _stars(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_edges(tables.located(spark, d).where("source_id not like 'nation%'"))


@query(f"""with {STARS}, m as (select v as nation, u as node from e where v like 'nation%' union all select u, v from e where u like 'nation%'), a as (select nation, node from m union all select distinct nation, nation from m)
  select node, min(node) over (partition by nation) as community from a""")
def louvain_stars(spark, d):
    """Nations and who lies in them: the best communities are known, each nation's own."""
    return graph.louvain(_stars(spark, d))


@query(f"""with {STARS}, k as (select x as node, count(*) as d from (select u as x from e union all select v from e) group by 1), m as (select count(*) as m from e), l as (select node, d, length(node) % 3 as c from k),
  s as (select c, sum(d) as d, sum(d) * sum(d) as d2 from l group by 1), i as (select count(*) as i from e join l a on a.node = u join l b on b.node = v where a.c = b.c)
  select m as edges, (select count(*) from s) as communities, round(i / m - (select sum(d2) from s) / (4.0 * m * m), 9) as modularity from m, i""")
def graph_modularity(spark, d):
    edges = _stars(spark, d)
    member = graph.degrees(edges).select("node", (F.length("node") % 3).cast("string").alias("community"))
    return graph.modularity(edges, member).withColumn("modularity", F.round("modularity", 9))


@query("""with p as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as k from part)
  select 'p'||lpad(p_partkey::varchar, 9, '0') as node, min('p'||lpad(p_partkey::varchar, 9, '0')) over (partition by p_brand, k <= 2) as component from p where p_brand in (select p_brand from part group by 1 having count(*) > 1)""")
def vetoed_groups(spark, d):
    """Each brand's parts as a chain whose first and third may not meet: the first link comes first, so the second is the one that is left out."""
    w = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    p = table(spark, d, "part").select("p_brand", F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("node"), w.alias("k"))
    a, b = p.alias("a"), p.alias("b")
    links = a.join(b, F.expr("a.p_brand = b.p_brand and b.k = a.k + 1")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"), F.when(F.col("a.k") == 1, 0.0).otherwise(1.0).alias("rank"))
    refused = a.join(b, F.expr("a.p_brand = b.p_brand and a.k = 1 and b.k = 3")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))
    return graph.constrained_components(links, refused)


@query("""with own as (select * from (select source_id as node, target_id as c from loc where source_id not like 'nation%') union all select distinct 'nation:'||c_nationkey, 'nation:'||c_nationkey from (select c_nationkey from customer union all select s_nationkey from supplier)),
  nm as (select 'nation:'||n_nationkey as id, n_name as name from nation union all select 'customer:'||c_custkey, c_name from customer union all select 'supplier:'||s_suppkey, s_name from supplier union all select 'region:'||r_regionkey, r_name from region),
  s as (select c, count(*) as size, string_agg(node, '|' order by node) as members, string_agg(name, '|' order by node) as names, arg_min(name, node) as first from own join nm on node = id group by 1),
  t as (select c, node, name, case when node = c then size - 1 else 1 end as degree, row_number() over (partition by c order by case when node = c then size - 1 else 1 end desc, node) as place from own join nm on node = id join s using (c)),
  tt as (select c, string_agg(name, ', ' order by place) as top, string_agg(node||'/'||degree, '|' order by place) as top_entities from t where place <= 5 group by 1),
  kr as (select c, u, v, row_number() over (partition by c order by u, v) as place from (select c, least(node, c) as u, greatest(node, c) as v from own where node <> c)),
  kk as (select c, string_agg(u||'>'||v, '|' order by place) as keys from kr where place <= 10 group by 1)
  select c as community_id, members, names as member_names, 'Community of '||first as title, size||' members: '||top as summary, replace(top, ', ', '|') as keywords, top_entities, c||'/1' as bridge_entities, size||'/'||(size - 1) as metrics, keys as key_relationships
  from s join tt using (c) join kk using (c)""".replace("with own", f"with {LOC}, own", 1))
def profile_fields(spark, d):
    """All ten fields of the nations' profiles."""
    located = tables.located(spark, d)
    own = located.where("source_id not like 'nation%'").select(F.col("source_id").alias("node"), F.col("target_id").alias("community"))
    made = graph.profiles(tables.entities(spark, d), located, own.union(own.select("community", "community").distinct()))
    both = lambda c, a, b: joined(F.transform(c, lambda x: F.concat_ws("/", x[a], x[b].cast("string"))))
    return made.select(
        "community_id", joined("members").alias("members"), joined("member_names").alias("member_names"), "title", "summary", joined("keywords").alias("keywords"), both("top_entities", "id", "degree").alias("top_entities"),
        both("bridge_entities", "id", "external_degree").alias("bridge_entities"), F.concat_ws("/", F.col("metrics.size").cast("string"), F.col("metrics.edge_count").cast("string")).alias("metrics"), joined(F.transform("key_relationships", lambda x: F.concat_ws(">", x["u"], x["v"]))).alias("key_relationships"),
    )


# State over time.
@query("""select o_orderkey, max(s_value) as last_value from (select o.o_orderkey, arg_max(e.value, (e.ts, e.event_id)) as s_value from orders o left join events e on e.user_id = o.o_custkey and e.ts <= timestamp '2024-01-01' + to_days((o.o_orderkey % 30)::integer) group by 1) group by 1""")
def snapshot_as_of(spark, d):
    """Of each order its customer's last event before a moment."""
    moment = F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(o_orderkey % 30 as int))")
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), moment.cast("timestamp").alias("at"))
    log = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("last_value"))
    return metrics.as_of(rows, log, ["user_id"], "at", "ts", ["event_id", "last_value"]).select("o_orderkey", "last_value")


# Slots with the library's own defaults, and their calls.
LINES = r"lines as (select conv_id||'-'||turn as segment_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as ln from conversations where trim(text, ' '||chr(10)) <> '')"
NAMES = r"found as (select segment_id, ln, regexp_extract_all(line, '[A-ZÀ-Þ][\p{L}\p{N}_''-]+(?: [A-ZÀ-Þ][\p{L}\p{N}_''-]+)*') as n from lines)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("position"), "text")


@query(f"with {LINES}, {NAMES} select distinct segment_id, unnest(n) as name from found")
def rule_entities(spark, d):
    """Entities by the default extractor."""
    return extract.records(graph.checkpointed(extract.answers(_turns(spark, d))), "entities").select("segment_id", "name")


@query(f"""with {LINES}, {NAMES}, p as (select segment_id, unnest(n[1:len(n) - 1]) as source, unnest(n[2:]) as target from found where len(n) > 1)
  select segment_id, source, target, 'RELATED_TO' as relationship, count(*) as n from p where source <> target group by 1, 2, 3""")
def rule_relationships(spark, d):
    """Relationships by the default extractor: names that follow each other in a line."""
    found = extract.records(graph.checkpointed(extract.answers(_turns(spark, d))), "relationships")
    return found.groupBy("segment_id", "source", "target", "relationship").agg(F.count(F.lit(1)).alias("n"))


@query("""select 'c'||c_custkey as segment_id, case when c_custkey % 5 = 0 then 2 else 1 end as attempts, c_custkey % 5 = 0 as failed, case when c_custkey % 5 = 0 then 'ValueError: '||c_name end as error,
  case when c_custkey % 5 = 0 then null else c_name end as name from customer""")
def throttled_answers(spark, d):
    """Calls at a rate that all tasks share; those that fail are asked again, and are dead letters at last."""

    def model(text: str) -> dict:
        if text.endswith(("0", "5")):
            raise ValueError(text)
        return {"entities": [{"name": text}]}

    rows = table(spark, d, "customer").select(named("c", "c_custkey").alias("id"), F.lit("d").alias("document_id"), F.lit(0).alias("position"), F.col("c_name").alias("text"))
    found = graph.checkpointed(extract.answers(rows, model, rate=20_000, tasks=4, retries=1))
    return found.select("segment_id", "attempts", "failed", "error", F.try_element_at("answer.entities", F.lit(1))["name"].alias("name"))


@query("""with t as (select 'p'||p_partkey as key, p_name as text from part), c as (select distinct p_name as text from part where p_partkey % 2 = 0)
  select key, length(text)::double as v, false as fresh from t where text in (select text from c) union all select key, length(text)::double, true from t where text not in (select text from c)""")
def content_cache(spark, d):
    """Parts embedded by name: texts that the cache has aren't embedded, whatever their keys; each new one is once."""
    rows = table(spark, d, "part").select(named("p", "p_partkey").alias("id"), "p_name", "p_partkey")
    model = lambda texts: [[float(len(t))] for t in texts]
    none = spark.createDataFrame([], "model string, text_sha256 string, vector array<float>")
    cache = graph.checkpointed(vectors.embed_changed(rows.where("p_partkey % 2 = 0"), "id", F.col("p_name"), none, model, "m")[1])
    every, fresh = vectors.embed_changed(rows, "id", F.col("p_name"), cache, model, "m")
    new = fresh.select("text_sha256", F.lit(True).alias("f"))
    return every.join(new, "text_sha256", "left").select("key", F.col("vector")[0].cast("double").alias("v"), F.coalesce("f", F.lit(False)).alias("fresh"))


@query("""select n_nationkey||'_'||i as id, (case i when 0 then repeat(n_name||' ', 99)||'end'||chr(10)||chr(10)||repeat('x', 300) when 1 then repeat('y', 1200) else repeat(n_name||'. ', 100)||'z' end) as text from nation, range(3) t(i)""")
def headed_sections(spark, d):
    """Documents with headings of several depths: the default separator parts paragraphs, headings part sections and are no text."""
    body = F.concat(F.lit("# One\n"), F.repeat(F.concat("n_name", F.lit(" ")), F.lit(99)), F.lit("end\n \n"), F.repeat(F.lit("x"), F.lit(300)), F.lit("\r\n## Two\r\n"), F.repeat(F.lit("y"), F.lit(1200)), F.lit("\n#### Three\n\n"), F.repeat(F.concat("n_name", F.lit(". ")), F.lit(100)), F.lit("z"))
    docs = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("").alias("path"), body.alias("text"))
    return chunking.segments(docs, overlap=0).select("id", "text")


@query("""with t as (select n_nationkey, n_name||chr(10)||repeat('x', 900) as a, repeat('y', 1500) as b from nation)
  select n_nationkey::varchar as document_id, 2 as n_segments, length(a) + 1500 as chars, n_nationkey||'_0|'||n_nationkey||'_1' as segment_ids from t""")
def planned_tasks(spark, d):
    """The plan of extraction: each document's segments in their order."""
    body = F.concat("n_name", F.lit("\n"), F.repeat(F.lit("x"), F.lit(900)), F.lit("\n\n"), F.repeat(F.lit("y"), F.lit(1500)))
    docs = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit("p").alias("path"), body.alias("text"))
    found = chunking.tasks(chunking.segments(docs, overlap=0))
    return found.select("document_id", "n_segments", "chars", joined(F.transform("segments", lambda x: x["segment_id"])).alias("segment_ids"))


@query(f"""with {ENT}, {LOC} select 'node' as kind, id, 'Entity' as label, type, null as source_id, null as target_id, name, description from ent
  union all select 'edge', source_id||'::'||relationship||'::'||target_id, null, 'RELATIONSHIP', source_id, target_id, relationship, description from loc""")
def graph_elements(spark, d):
    """Nodes and edges with label, type and all properties, read back out of their JSON."""
    found = store.elements(tables.entities(spark, d), tables.located(spark, d))
    value = lambda k: F.get_json_object("properties", f"$.{k}")
    return found.select("kind", "id", "label", "type", "source_id", "target_id", F.coalesce(value("name"), value("relationship")).alias("name"), value("description").alias("description"))


@query("select n_name||chr(10) as text, 'txt' as suffix from nation")
def corpus_files(spark, d):
    """Text files at any depth, read back as documents; what isn't text is passed over."""
    path = folder(spark)
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    nations.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    nations.select("n_name").write.csv(f"{path}/other")
    return corpus.read_documents(spark, path).select("text", F.element_at(F.split("path", "\\."), -1).alias("suffix"))


@query("""select 'entity' as kind, n_name as name, '' as other from nation union all select 'entity', c_mktsegment, '' from (select distinct c_mktsegment from customer) union all select distinct 'relation', n_name, c_mktsegment from customer join nation on c_nationkey = n_nationkey""")
def ingested_graph(spark, d):
    """Documents through the whole engine into a store of deltas: extraction, resolution, communities, embeddings."""

    def model(text: str) -> dict:
        said = [line.split("|") for line in text.splitlines()]
        return {"entities": [{"name": x} for x in dict.fromkeys(x for pair in said for x in pair)], "relationships": [{"source": a, "target": b, "relationship": "SELLS_TO"} for a, b in said]}

    pairs = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "c_mktsegment").distinct()
    lines = pairs.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "n_name", "c_mktsegment"))), "\n").alias("text"))
    rest = table(spark, d, "nation").join(pairs, "n_name", "left_anti").select("n_name", F.concat_ws("|", "n_name", "n_name").alias("text"))
    docs = lines.union(rest).select(F.col("n_name").alias("id"), F.lit("").alias("path"), "text")
    engine = Engine(spark, deltas.DeltaStore(spark, folder(spark), 4), extractor=model, incremental=True)
    engine.ingest(docs, "r1")
    entities, edges = engine.store.read("entities"), engine.store.read("relationships")
    held = entities.where("embedding is not null").select(F.lit("entity").alias("kind"), "name", F.lit("").alias("other"))
    return held.union(edges.where("embedding is not null").select(F.lit("relation"), "source", "target"))

