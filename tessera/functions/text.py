"""Names, labels, ids, question terms and evidence texts as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords of each class of question, tried in this order.
INTENT_KEYWORDS = {
    "relation": ["合作伙伴", "partner", "合作方", "关系", "联盟"],
    "attribute": ["多少", "占比", "指标", "性能", "优势", "能力", "价格"],
    "causal": ["为什么", "原因", "导致", "影响", "why", "cause"],
    "temporal": ["什么时候", "时间", "历程", "history", "发展史"],
    "comparative": ["相比", "对比", "比较", "difference", "compare"],
}
# The class of question -> the bucket of graph patterns.
INTENT_BUCKETS = {"relation": "relation", "attribute": "attribute", "causal": "causal", "temporal": "timeline", "comparative": "comparative", "descriptive": "fallback"}
TERM_PATTERN = "[\\u4e00-\\u9fff]{2,}|[A-Za-z0-9_\\-]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col(c), "(?U)^\\s+|\\s+$", "")


def normalize_name(c: str | Column) -> Column:
    """Stripped, lower case, without spaces; other white space inside stays."""
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit(""))


def label_key(c: str | Column) -> Column:
    """Lower case without any white space; null is ''."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "(?U)\\s+", "")


def entity_id(norm: str | Column) -> Column:
    return F.concat(F.lit("entity::"), col(norm))


def relationship_id(source: str | Column, relationship: str | Column, target: str | Column) -> Column:
    """A label without a-z or 0-9 becomes '-', so different such labels share an id."""
    return F.concat_ws("::", F.lit("rel"), col(source), F.regexp_replace(F.lower(col(relationship)), "[^a-z0-9]+", "-"), col(target))


def alias_variants(name: str | Column, aliases: str | Column) -> Column:
    """The name and the aliases, stripped, distinct, without empty ones, in order."""
    every = F.concat(F.array(col(name)), F.coalesce(col(aliases), F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, strip), lambda x: x.isNotNull() & (x != "")))


def question_terms(question: str | Column) -> Column:
    """Runs of letters, digits, _ and -, and of two or more CJK characters, as they stand."""
    return F.regexp_extract_all(col(question), F.lit(TERM_PATTERN), F.lit(0))


def context_terms(question: str | Column) -> Column:
    """Distinct question terms in lower case, of two characters or more, sorted."""
    return F.array_sort(F.array_distinct(F.filter(question_terms(F.lower(col(question))), lambda x: F.length(x) > 1)))


def search_terms(question: str | Column, most: int = 10) -> Column:
    """Question terms, one for each lower-case form, the first `most` of them."""
    return F.slice(F.array_distinct(F.transform(question_terms(question), F.lower)), 1, most)


def contains_any(text: Column, terms: list[str] | Column) -> Column:
    terms = F.array(*map(F.lit, terms)).cast("array<string>") if isinstance(terms, list) else terms
    return F.exists(terms, lambda t: F.contains(text, t))


def intent(question: str | Column) -> Column:
    """The first class one of whose keywords the question contains; descriptive if there is none."""
    q, out = F.lower(col(question)), None
    for name, words in INTENT_KEYWORDS.items():
        out = (out if out is not None else F).when(contains_any(q, words), F.lit(name))
    return out.otherwise(F.lit("descriptive"))


def intent_bucket(name: str | Column) -> Column:
    pairs = [F.lit(x) for pair in INTENT_BUCKETS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(name)), F.lit("fallback"))


def entity_text(name, type_, description, style: str = "fabric") -> Column:
    """What of an entity is embedded: fabric 'n | t | d' (missing parts read None), plain 'n t d', labelled 'n d 类型: t'."""
    name, type_, description = col(name), col(type_), col(description)
    if style == "fabric":
        return F.concat_ws(" | ", *(F.coalesce(x, F.lit("None")) for x in (name, type_, description)))
    some = [F.when(x != "", x) for x in (name, type_, description)]
    return F.concat_ws(" ", *some) if style == "plain" else F.concat_ws(" ", some[0], some[2], F.concat(F.lit("类型: "), some[1]))


def relationship_text(relationship, description, source=None, target=None, style: str = "fabric") -> Column:
    relationship, description = col(relationship), col(description)
    if style == "fabric":
        return F.concat_ws(" | ", *(F.coalesce(x, F.lit("None")) for x in (relationship, description)))
    some = [F.when(x != "", x) for x in (relationship, description)]
    if style == "plain":
        return F.concat_ws(" ", *some)
    return F.concat_ws(" ", F.when(col(source) != "", col(source)), some[0], F.when(col(target) != "", col(target)), some[1])


def hop_text(path_details: str | Column) -> Column:
    """mid(rel1->rel2) of each hop, joined with ' -> '."""
    return F.array_join(F.transform(col(path_details), lambda p: F.concat(p["mid"], F.lit("("), p["rel1"], F.lit("->"), p["rel2"], F.lit(")"))), " -> ")


def evidence_score(weight, relationship, source_name, target_name, aliases, hops, keywords: list[str] | None = None, relation_weights: dict[str, float] | None = None) -> Column:
    """weight, plus the relation's own, .3 for each keyword in its label, .1 for each end that is an alias and for each hop; 3 places."""
    rel = F.lower(F.coalesce(col(relationship), F.lit("")))
    score = col(weight)
    if relation_weights:
        pairs = [F.lit(x) for k, v in relation_weights.items() for x in (k.lower(), float(v))]
        score = score + F.coalesce(F.element_at(F.create_map(*pairs), rel), F.lit(0.0))
    for k in keywords or []:
        if k:
            score = score + F.when(F.contains(rel, F.lit(k)), 0.3).otherwise(0.0)
    for end in (source_name, target_name):
        score = score + F.when(F.array_contains(col(aliases), F.lower(col(end))), 0.1).otherwise(0.0)
    return F.bround(score + F.lit(0.1) * F.coalesce(col(hops), F.lit(0)), 3)


def evidence_line(n, source, relationship, target, score, description) -> Column:
    """'n. source --relationship--> target (score=0.00) | 描述: description'."""
    line = F.concat(col(n).cast("string"), F.lit(". "), col(source), F.lit(" --"), col(relationship), F.lit("--> "), col(target), F.lit(" (score="), F.format_string("%.2f", col(score)), F.lit(")"))
    return F.when(F.coalesce(col(description), F.lit("")) != "", F.concat(line, F.lit(" | 描述: "), col(description))).otherwise(line)


def paragraphs(text: str | Column) -> Column:
    """Non-empty runs between line breaks."""
    return F.filter(F.split(col(text), "\\n+"), lambda x: x != "")


def is_read_only(query: str | Column) -> Column:
    """No writing keyword in upper case; lower-case CALLs pass, as a property named created_at fails."""
    return ~F.upper(col(query)).rlike("CREATE|MERGE|DELETE|DETACH|SET |DROP")
