"""Registered queries of chunking, extraction, resolution and the store, each run through its operator, with SQL that gives the same rows."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import chunking, extract, graph, metrics, resolve, slots, vectors
from .queries import LOC, PARTS, query
from .sources import corpus, store, tables
from .sources.tables import table


def folder(spark: SparkSession) -> str:
    """A new folder under the shared one, for a query that writes and reads back."""
    return f"{graph.shared_folder(spark)}/query-{uuid.uuid4().hex}"


def joined(c):
    return F.array_join(c, "|")


# Chunking. Paragraphs are the lines of the documents; both folds are recursions over them.
CHUNKS = """with recursive par as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as ps from documents),
  fold as (select doc_id, 1 as k, '' as now, cast([] as varchar[]) as done from par
    union all select f.doc_id, f.k + 1,
      case when f.now = '' then p.ps[f.k] when length(f.now) + 2 + length(p.ps[f.k]) <= 2000 then f.now||chr(10)||chr(10)||p.ps[f.k]
        else left(trim((case when contains(right(f.now, 200), chr(10)||chr(10)) then substr(right(f.now, 200), strpos(right(f.now, 200), chr(10)||chr(10)) + 2) else right(f.now, 200) end)||chr(10)||chr(10)||p.ps[f.k], ' '||chr(10)), 200)||chr(10)||chr(10)||p.ps[f.k] end,
      case when f.now <> '' and length(f.now) + 2 + length(p.ps[f.k]) > 2000 then list_append(f.done, f.now) else f.done end
    from fold f join par p on f.doc_id = p.doc_id where f.k <= len(p.ps)),
  raw_chunks as (select f.doc_id, list_append(f.done, f.now) as cs from fold f join par p on f.doc_id = p.doc_id where f.k = len(p.ps) + 1 and len(p.ps) > 0),
  merge as (select doc_id, 2 as k, cs[1] as held, cast([] as varchar[]) as done from raw_chunks
    union all select m.doc_id, m.k + 1,
      case when length(m.held) < 800 and length(m.held) + 2 + length(r.cs[m.k]) <= 2000 then m.held||chr(10)||chr(10)||r.cs[m.k] else r.cs[m.k] end,
      case when length(m.held) >= 800 then list_append(m.done, m.held) when length(m.held) + 2 + length(r.cs[m.k]) > 2000 then list_append(m.done, m.held||chr(10)||chr(10)||r.cs[m.k]) else m.done end
    from merge m join raw_chunks r on m.doc_id = r.doc_id where m.k <= len(r.cs)),
  segs as (select m.doc_id, case when len(m.done) > 0 and length(m.held) < 800 then list_append(m.done[:len(m.done) - 1], m.done[len(m.done)]||chr(10)||chr(10)||m.held) else list_append(m.done, m.held) end as ss
    from merge m join raw_chunks r on m.doc_id = r.doc_id where m.k = len(r.cs) + 1),
  seg as (select doc_id, unnest(ss) as text, unnest(range(len(ss))) as position from segs)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("path"), "text")
    return chunking.segments(docs, separator="\n")


@query(f"{CHUNKS} select doc_id||'_'||position as id, cast(doc_id as varchar) as document_id, cast(position as integer) as position, text from seg")
def chunk_documents(spark, d):
    return _segments(spark, d).select("id", "document_id", "position", "text")


@query(f"{CHUNKS} select cast(doc_id as varchar) as document_id, count(*) as segments, cast(sum(length(text)) as bigint) as chars from seg group by 1")
def planned_segments(spark, d):
    return _segments(spark, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.length("text")).alias("chars"))


@query("select item_id, case when item_id % 7 = 0 then 0 else 1 end as kept from benchmark where item_id % 7 <> 0")
def filled_segments(spark, d):
    blank = F.when(F.col("item_id") % 7 == 0, F.lit(" \t　\n")).otherwise(F.col("text"))
    return extract.filled(table(spark, d, "benchmark").select("item_id", blank.alias("text"))).select("item_id", F.lit(1).alias("kept"))


# Extraction: a slot whose answers are JSON text about the parts of a document.
def _parts_extractor(text: str) -> str:
    import json

    if text.startswith("!"):
        raise ValueError(text)
    name, brand, size = text.split("|")
    return json.dumps({
        "entities": [{"name": name, "type": brand, "description": text}, {"name": brand, "type": "BRAND"}], "relationships": [{"source": name, "target": brand, "relationship": "MADE_BY"}],
        "attributes": [{"entity": name, "attribute": "size", "value": int(size), "unit": ""}], "events": [{"label": f"made {name}", "participants": [brand.lower(), name], "context": text}] if int(size) > 25 else [],
    })


def _answered(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    text = F.when(F.col("p_partkey") % 11 == 0, "!").otherwise(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string")))
    return extract.answers(parts.select(F.col("p_partkey").cast("string").alias("id"), F.lit("d").alias("document_id"), F.lit(0).alias("position"), text.alias("text")), _parts_extractor)


@query("select cast(p_partkey as varchar) as segment_id, name, type, ord from (select *, p_name as name, p_brand as type, 0 as ord from part union all select *, p_brand, 'BRAND', 1 from part) where p_partkey % 11 <> 0")
def extracted_entities(spark, d):
    return extract.records(_answered(spark, d), "entities").select("segment_id", "name", "type", F.col("ord").cast("int").alias("ord"))


@query("select cast(p_partkey as varchar) as segment_id, p_name as source, p_brand as target, 'MADE_BY' as relationship from part where p_partkey % 11 <> 0")
def extracted_relationships(spark, d):
    return extract.records(_answered(spark, d), "relationships").select("segment_id", "source", "target", "relationship")


@query("select cast(p_partkey as varchar) as segment_id, p_name as entity, 'size' as attribute, cast(p_size as varchar) as value from part where p_partkey % 11 <> 0")
def extracted_attributes(spark, d):
    return extract.records(_answered(spark, d), "attributes").select("segment_id", "entity", "attribute", "value")


@query("""with al as (select lower(p_brand) as alias, min(p_brand) as canonical from part group by 1)
  select 'event_d_'||p_partkey||'_0' as id, 'EVENT' as type, 'made '||p_name as label, al.canonical||'|'||p_name as participants from part join al on lower(p_brand) = alias where p_size > 25 and p_partkey % 11 <> 0""")
def extracted_events(spark, d):
    brands = table(spark, d, "part").groupBy(F.lower("p_brand").alias("alias")).agg(F.min("p_brand").alias("canonical"))
    found = resolve.event_records(extract.records(_answered(spark, d), "events"))
    return resolve.resolve_participants(found, brands).select("id", "type", "label", joined("participants").alias("participants"))


@query("select 'merge' as change_type, cast(p_partkey as varchar) as segment_id, case when p_partkey % 11 = 0 then 0 else 2 end as entities, case when p_partkey % 11 <> 0 and p_size > 25 then 1 else 0 end as events, p_partkey % 11 = 0 as failed, '1' as schema_version from part")
def provenance_records(spark, d):
    found = extract.provenance(_answered(spark, d), "run")
    return found.select("change_type", "segment_id", "entities", "events", "failed", F.col("metadata")["schema_version"].alias("schema_version"))


@query("""select item_id, case item_id % 3 when 0 then 'n'||item_id when 1 then null else '' end as name, item_id % 3 = 1 as no_json from benchmark""")
def parsed_answers(spark, d):
    n = F.col("item_id").cast("string")
    answer = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit('{"entities": [{"name": "n'), n, F.lit('", "extra": [1]}], "events": 3}'))).when(F.col("item_id") % 3 == 1, F.lit("I can't say")).otherwise(F.lit('{"entities": [{"name": ""}]}'))
    rows = table(spark, d, "benchmark").select("item_id", answer.alias("a"))
    return rows.select("item_id", extract.parsed("a")["entities"][0]["name"].alias("name"), F.try_parse_json("a").isNull().alias("no_json"))


# Resolution.
@query(f"""with {PARTS}, v as (select ord, trim(name) as canonical, unnest([trim(name), alias]) as v from parts), w as (select ord, canonical, unnest([v, replace(lower(v), ' ', '')]) as alias from v)
  select alias, arg_min(canonical, ord) as canonical from w where alias <> '' group by 1""")
def alias_table(spark, d):
    rows = tables.raw_entities(spark, d)
    return resolve.alias_lookup(rows.withColumn("name", T.strip("name")))


ALIASES = f"""{PARTS}, v as (select ord, trim(name) as canonical, unnest([trim(name), alias]) as v from parts), w as (select ord, canonical, unnest([v, replace(lower(v), ' ', '')]) as alias from v),
  al as (select alias, arg_min(canonical, ord) as canonical from w where alias <> '' group by 1)"""


@query(f"""with {ALIASES}, c as (select p_partkey, case p_partkey % 3 when 0 then p_brand when 1 then upper(p_name) else 'no '||p_name end as c from part)
  select p_partkey, coalesce(a.canonical, b.canonical, c) as entity_candidate, case when coalesce(a.canonical, b.canonical) is not null then 'id:'||coalesce(a.canonical, b.canonical) end as entity_id
  from c left join al a on c = a.alias left join al b on replace(lower(c), ' ', '') = b.alias""")
def attribute_entities(spark, d):
    rows = tables.raw_entities(spark, d).withColumn("name", T.strip("name"))
    named = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit("no "), "p_name"))
    ids = rows.select("name", F.concat(F.lit("id:"), "name").alias("id")).distinct()
    return resolve.attributed(table(spark, d, "part").select("p_partkey", named.alias("entity_candidate")), resolve.alias_lookup(rows), ids).select("p_partkey", "entity_candidate", "entity_id")


@query(f"""with {PARTS}, norm as (select replace(lower(trim(name)), ' ', '') as norm, arg_min(trim(name), ord) as name from parts group by 1),
  st as (select p_partkey, '  '||upper(p_name) as source, case when p_partkey % 2 = 0 then 'nobody' else p_name end as target from part)
  select p_partkey, a.name as source, b.name as target, 'entity::'||a.norm as source_id from st join norm a on replace(lower(trim(source)), ' ', '') = a.norm join norm b on replace(lower(trim(target)), ' ', '') = b.norm""")
def relationships_of_entities(spark, d):
    known = resolve.canonical_entities(tables.raw_entities(spark, d))
    said = table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), F.upper("p_name")).alias("source"), F.when(F.col("p_partkey") % 2 == 0, "nobody").otherwise(F.col("p_name")).alias("target"))
    return resolve.relationships_between(said, known).select("p_partkey", "source", "target", "source_id")


@query("""with n as (select c_name as name, 'c'||c_custkey as id from customer where c_custkey % 2 = 0)
  select o_orderkey, case when o_orderkey % 5 = 0 then 'own' else coalesce(n.id, c_name) end as source_id, 'shop' as target_id, case when o_orderkey % 7 = 0 then 'r'||o_orderkey else (case when o_orderkey % 5 = 0 then 'own' else coalesce(n.id, c_name) end)||'::ORDERED::shop' end as id
  from orders join customer on o_custkey = c_custkey left join n on n.name = c_name""")
def relationship_ends(spark, d):
    people = table(spark, d, "customer")
    ids = people.where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    rows = table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("r"), F.col("o_orderkey").cast("string"))).alias("id"), F.when(F.col("o_orderkey") % 5 == 0, "own").alias("source_id"), F.lit(None).cast("string").alias("target_id"),
        F.col("c_name").alias("source"), F.lit("shop").alias("target"), F.lit("ORDERED").alias("relationship"),
    )
    return resolve.relationship_ends(rows, ids).select("o_orderkey", "source_id", "target_id", "id")


@query("""with raw as (select o_orderkey as ord, c_mktsegment as source, o_orderstatus as target, case when o_orderkey % 2 = 0 then o_orderpriority else lower(o_orderpriority)||' ' end as relationship from orders join customer on o_custkey = c_custkey),
  k as (select *, regexp_replace(lower(relationship), '\\s+', '', 'g') as key from raw), f as (select source, target, key, arg_min(relationship, ord) as first, min(ord) as ord from k group by 1, 2, 3),
  j as (select source, target, key, first_value(first) over (partition by source, target, length(first) % 2 order by ord) as label from f)
  select k.ord, k.source, k.target, j.label from k join j on k.source = j.source and k.target = j.target and k.key = j.key""")
def judged_labels(spark, d):
    # the judge finds labels the same whose lengths are both even or both odd
    label = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lower("o_orderpriority"), F.lit(" ")))
    said = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ord"), F.col("c_mktsegment").alias("source"), F.col("o_orderstatus").alias("target"), label.alias("relationship"))
    return slots.judged_labels(said, lambda s, t, a, b: len(a) % 2 == len(b) % 2).select("ord", "source", "target", "label")


@query("""with n as (select distinct p_type||'/'||p_name as id, p_type as type, p_name as norm from part), p as (select a.id as a, b.id as b, a.norm as na, b.norm as nb from n a join n b on a.type = b.type and a.id < b.id where levenshtein(a.norm, b.norm) <= 2 and abs(length(a.norm) - length(b.norm)) <= 0.7 * greatest(length(a.norm), length(b.norm)))
  select a, b from p where length(na) = length(nb)""")
def confirmed_pairs(spark, d):
    n = table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_name").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("norm")).distinct()
    rows = n.select("id", F.col("norm").alias("name"), F.lit("").alias("description"))
    return slots.confirmed_pairs(resolve.similar_pairs(n), rows, lambda b: b["name_a"].str.len() == b["name_b"].str.len())


@query("select distinct p_brand, length(p_brand) + p_size % 3 as n from part")
def model_answers_once(spark, d):
    rows = table(spark, d, "part").select("p_brand", (F.col("p_size") % 3).alias("s"))
    return slots.once_for_each(rows, ["p_brand", "s"], lambda b: b["p_brand"].str.len() + b["s"], "n", "int").select("p_brand", "n").distinct()


# Texts and vectors.
def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("LOCATED_IN").alias("relationship"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("in it").alias("description"))


@query("""select n_name as source, 'LOCATED_IN | '||case when n_nationkey % 2 = 0 then '' else 'in it' end as fabric, 'LOCATED_IN'||case when n_nationkey % 2 = 0 then '' else ' in it' end as plain, n_name||' LOCATED_IN '||r_name||case when n_nationkey % 2 = 0 then '' else ' in it' end as labelled
  from nation join region on n_regionkey = r_regionkey""")
def relationship_texts(spark, d):
    return _edges(spark, d).select("source", *[T.relationship_text("relationship", "description", "source", "target", s).alias(s) for s in ("fabric", "plain", "labelled")])


@query("select conv_id, turn, array_to_string(regexp_extract_all(text, '[\\u4e00-\\u9fff]{2,}|[A-Za-z0-9_\\-]+'), '|') as terms from conversations".replace("\\u4e00-\\u9fff", "一-鿿"))
def question_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", joined(T.question_terms("text")).alias("terms"))


@query("""with t as (select conv_id, turn, list_transform(regexp_extract_all(text, '[一-鿿]{2,}|[A-Za-z0-9_\\-]+'), lambda x: lower(x)) as l from conversations)
  select conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[:10], '|') as terms from t""")
def first_search_terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", joined(T.search_terms("text")).alias("terms"))


@query("""with q as (select o_orderkey as id, case o_orderkey % 4 when 0 then 'MATCH (n) RETURN n' when 1 then 'match (n) set n.x = 1' when 2 then 'SELECT created_at' else 'select droplet' end as q from orders)
  select id, not regexp_matches(upper(q), 'CREATE|MERGE|DELETE|DETACH|SET |DROP') as read_only from q""")
def read_only_queries(spark, d):
    n = F.col("o_orderkey") % 4
    q = F.when(n == 0, "MATCH (n) RETURN n").when(n == 1, "match (n) set n.x = 1").when(n == 2, "SELECT created_at").otherwise("select droplet")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.is_read_only(q).alias("read_only"))


def _letters(texts: pd.Series) -> list[list[float]]:
    """A model that SQL can follow: how often a text holds each of a, e and o."""
    return [[float(t.count(c)) for c in "aeo"] for t in texts]


def _letter_counts(column: str) -> str:
    return ", ".join(f"cast(length({column}) - length(replace({column}, '{c}', '')) as double)" for c in "aeo")


@query(f"select 'p'||p_partkey as key, array_to_string(list_transform([{_letter_counts('lower(p_name)')}], lambda x: cast(cast(x as integer) as varchar)), '|') as vector from part")
def entity_embeddings(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lower("p_name").alias("n"))
    return vectors.embed(rows, "id", F.col("n"), _letters).select("key", joined(F.transform("vector", lambda x: x.cast("int").cast("string"))).alias("vector"))


@query(f"""with e as (select n_name||'-'||r_name||'-LOCATED_IN' as key, 'LOCATED_IN'||case when n_nationkey % 2 = 0 then '' else ' in it' end as t from nation join region on n_regionkey = r_regionkey)
  select key, array_to_string(list_transform([{_letter_counts('t')}], lambda x: cast(cast(x as integer) as varchar)), '|') as vector from e""")
def relationship_embeddings(spark, d):
    rows = _edges(spark, d).withColumn("id", F.concat_ws("-", "source", "target", "relationship"))
    return vectors.embed(rows, "id", T.relationship_text("relationship", "description", style="plain"), _letters).select("key", joined(F.transform("vector", lambda x: x.cast("int").cast("string"))).alias("vector"))


@query(f"""with p as (select 'p'||p_partkey as key, [{_letter_counts('lower(p_name)')}] as v from part where p_partkey % 2 = 1 union all select 'p'||p_partkey, [9.0, 9.0, 9.0] from part where p_partkey % 2 = 0)
  select key, array_to_string(list_transform(v, lambda x: cast(cast(x as integer) as varchar)), '|') as vector from p""")
def cached_embeddings(spark, d):
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), "p_partkey", F.lower("p_name").alias("n"))
    cached = rows.where("p_partkey % 2 = 0").select(F.col("id").alias("key"), F.expr("array(9f, 9f, 9f)").alias("vector"))
    return vectors.embed(rows, "id", F.col("n"), _letters, cached).select("key", joined(F.transform("vector", lambda x: x.cast("int").cast("string"))).alias("vector"))


@query(f"""with v as (select 'p'||p_partkey as key, [{_letter_counts('lower(p_name)')}] as v from part), s as (select key, list_cosine_similarity(v, [2.0, 3.0, 2.0]) as s from v where list_sum(v) > 0)
  select key, round(s, 9) as score from s order by s desc, key limit 5""")
def vector_neighbours(spark, d):
    """A question's neighbours: its text and all parts' embedded by one model."""
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lower("p_name").alias("n"))
    asked = _letters(pd.Series(["aeoaeoe"]))[0]
    return vectors.top_k(vectors.embed(rows, "id", F.col("n"), _letters), asked, 5).select("key", F.round("score", 9).alias("score"))


# The store, written and read back.
def _filled_store(spark: SparkSession, d: str) -> store.GraphStore:
    kept = store.GraphStore(spark, folder(spark))
    people = table(spark, d, "customer")
    ids = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    kept.upsert_entities(people.select(ids.alias("id"), F.col("c_name").alias("name"), F.lit("CUSTOMER").alias("type")))
    nations = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    kept.upsert_entities(nations)
    kept.upsert_relationships(people.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("id"), ids.alias("source_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target_id"), F.col("c_name").alias("source"), F.lit("nation").alias("target"), F.lit("IN").alias("relationship")))
    return kept


@query("select 'c'||c_custkey as id, c_name as name, 'CUSTOMER' as type, 'unknown' as domain from customer union all select 'n'||n_nationkey, n_name, 'UNKNOWN', 'unknown' from nation")
def stored_entities(spark, d):
    return _filled_store(spark, d).read("entities").select("id", "name", "type", "domain")


@query("select 'r'||c_custkey as id, 'c'||c_custkey as source_id, 'n'||c_nationkey as target_id, 'RELATIONSHIP' as type from customer")
def stored_relationships(spark, d):
    return _filled_store(spark, d).read("relationships").select("id", "source_id", "target_id", "type")


@query("select 'n'||n_nationkey as id, case when n_nationkey % 2 = 0 then '1|2' else null end as embedding from nation")
def stored_embeddings(spark, d):
    kept = store.GraphStore(spark, folder(spark))
    rows = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), "n_nationkey", F.col("n_name").alias("name"))
    kept.upsert_entities(rows)
    new = rows.where("n_nationkey % 2 = 0").select(F.col("id").alias("key"), F.expr("array(1f, 2f)").alias("vector"))
    kept.store_embeddings(new.union(spark.createDataFrame([("nobody", [3.0])], "key string, vector array<float>")))
    return kept.read("entities").select("id", joined(F.transform("embedding", lambda x: x.cast("int").cast("string"))).alias("embedding"))


@query("select 'c'||c_nationkey as community_id, count(*) as entity_count, count(*) as members from customer group by 1")
def stored_communities(spark, d):
    kept = _filled_store(spark, d)
    first = spark.createDataFrame([("c0", ["c1"], "old"), ("gone", ["c2"], "old")], "community_id string, members array<string>, title string")
    kept.replace_communities(first)
    ids = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    now = table(spark, d, "customer").groupBy(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("community_id")).agg(F.collect_list(ids).alias("members")).withColumn("members", F.concat("members", F.array(F.lit("nobody"))))
    kept.replace_communities(now)
    member = kept.read("belongs_to").groupBy("community_id").agg(F.count(F.lit(1)).alias("members"))
    return kept.read("communities").select("community_id", (F.col("entity_count") - 1).cast("long").alias("entity_count")).join(member, "community_id")


@query("select 'n'||n_nationkey as id, 'n'||n_nationkey||'s' as segment_id, case when n_nationkey % 2 = 0 then 'new' else 'old' end as context from nation")
def replayed_attributes(spark, d):
    """Attributes put twice: those of the second time replace the first's, none is doubled."""
    kept = store.GraphStore(spark, folder(spark))
    rows = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("document_id")).select("n_nationkey", "document_id", F.concat("document_id", F.lit("s")).alias("segment_id"), F.lit("e").alias("entity_candidate"), F.lit("a").alias("attribute"), F.lit("v").alias("value"))
    kept.put("attributes", rows.withColumn("context", F.lit("old")))
    kept.put("attributes", rows.where("n_nationkey % 2 = 0").withColumn("context", F.lit("new")))
    return kept.read("attributes").select(F.col("document_id").alias("id"), "segment_id", "context")


@query("select 1 as version, 0 as entity_count, 0 as relationship_count union all select 2, count(*), 0 from nation union all select 3, 0, 0")
def store_versions(spark, d):
    kept = store.GraphStore(spark, folder(spark))
    kept.snapshot()
    kept.upsert_entities(table(spark, d, "nation").select(F.col("n_name").alias("id"), F.col("n_name").alias("name")))
    kept.snapshot()
    log = kept.read("snapshots")
    kept.clear()
    kept.write("snapshots", log)
    kept.snapshot()
    return kept.read("snapshots").select("version", "entity_count", "relationship_count")


@query("select e.n_name as name, count(*) as n from customer join nation e on c_nationkey = n_nationkey where n_nationkey < 7 group by 1")
def stored_query(spark, d):
    sql = "select e.name, count(*) as n from relationships r join entities e on e.id = r.target_id where e.id in ('n0', 'n1', 'n2', 'n3', 'n4', 'n5', 'n6') and r.relationship = :label group by 1"
    return _filled_store(spark, d).query(sql, label="IN")


@query("select 'n'||n_nationkey as id, n_name as name from nation")
def knowledge_file(spark, d):
    """Entities written as the file that `read_knowledge_graph` reads, and read back."""
    path = folder(spark)
    rows = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    corpus.write_knowledge_graph(rows, rows.where("false").selectExpr("id", "id as source_id", "id as target_id"), path)
    return corpus.read_knowledge_graph(spark, path)[0].select("id", "name")


@query(f"select 'p'||p_partkey as key, array_to_string(list_transform([{_letter_counts('lower(p_name)')}], lambda x: cast(cast(x as integer) as varchar)), '|') as vector from part")
def embedding_file(spark, d):
    path = folder(spark)
    rows = table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lower("p_name").alias("n"))
    corpus.write_embeddings(vectors.embed(rows, "id", F.col("n"), _letters), path)
    return corpus.read_embeddings(spark, path).select("key", joined(F.transform("vector", lambda x: x.cast("int").cast("string"))).alias("vector"))


# Counts and change.
@query("""select cast(l_orderkey as varchar) as document_id, count(distinct l_partkey) as entities, count(distinct case when l_linenumber < 3 then l_linenumber end) as relationships, count(distinct case when l_partkey % 3 > 0 then l_partkey % 20 end) as communities
  from lineitem group by l_orderkey""")
def document_counts(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("relation_id"))
    member = table(spark, d, "part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("entity_id"), (F.col("p_partkey") % 20).alias("community_id"))
    return metrics.document_counts(items.select("document_id", "entity_id"), items.where("relation_id < 3").select("document_id", "relation_id"), member)


@query("select distinct 'c'||o_custkey as community_id from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)")
def common_communities(spark, d):
    before = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("community_id")).distinct()
    after = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("community_id"))
    return graph.common_communities(before, after)


@query(f"""with {LOC}, m as (select source_id as node, target_id as community from loc where source_id like 'customer%' or source_id like 'supplier%' union all select distinct target_id, target_id from loc where target_id like 'nation%')
  select community as community_id, count(*) as size, count(*) - 1 as edge_count, 2.0 * (count(*) - 1) / (count(*) * (count(*) - 1)) as density from m group by 1 having count(*) > 1""")
def community_profiles(spark, d):
    located = tables.located(spark, d)
    own = located.where("source_id not like 'nation%'").select(F.col("source_id").alias("node"), F.col("target_id").alias("community"))
    member = own.union(own.select("community", "community").distinct())
    made = graph.profiles(tables.entities(spark, d), located, member)
    return made.select("community_id", F.size("members").cast("long").alias("size"), F.col("metrics.edge_count").alias("edge_count"), F.col("metrics.density").alias("density"))
