"""Entities, relationships, attributes and events out of segments: one slot, asked once a segment, with a rule-based default."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("entities", "relationships", "attributes", "events")
ANSWER = """entities array<struct<name:string,type:string,description:string,aliases:array<string>>>,
  relationships array<struct<source:string,target:string,relationship:string,description:string>>,
  attributes array<struct<entity:string,attribute:string,value:string,unit:string,evidence:string,attribute_type:string>>,
  events array<struct<id:string,type:string,label:string,title:string,participants:array<string>,context:string,timestamp:string>>"""
#: Records of a segment that keep its place in the order of all.
MOST_RECORDS = 1_000_000

_NAME = re.compile(r"[A-ZÀ-Þ][\w'-]+(?: [A-ZÀ-Þ][\w'-]+)*")
_NUMBER = re.compile(r"([A-ZÀ-Þ]\w+) ([0-9]+(?:\.[0-9]+)?) ?([%A-Za-zÀ-ÿ]*)")
_YEAR = re.compile(r"\b(?:1[0-9]|20)[0-9]{2}\b")


def rule_extractor(text: str) -> dict[str, list[dict]]:
    """Capitalised runs are entities, and two next to each other in a line are related; a number after one is an attribute; a line with a year is an event."""
    names, pairs, events = [], [], []
    for line in text.splitlines():
        found = [m[0] for m in _NAME.finditer(line)]
        names += found
        pairs += [(a, b, line) for a, b in zip(found, found[1:], strict=False) if a != b]
        if year := _YEAR.search(line):
            events.append({"label": line.strip()[:80], "participants": list(dict.fromkeys(found)), "context": line.strip()[:200], "timestamp": year[0]})
    return {
        "entities": [{"name": n, "type": "CONCEPT", "description": ""} for n in dict.fromkeys(names)],
        "relationships": [{"source": a, "target": b, "relationship": "RELATED_TO", "description": x[:80]} for a, b, x in pairs],
        "attributes": [{"entity": m[1], "attribute": "number", "value": m[2], "unit": m[3], "evidence": m[0]} for m in _NUMBER.finditer(text)],
        "events": events,
    }


def filled(segments: DataFrame) -> DataFrame:
    """Segments that aren't blank."""
    return segments.where(F.length(F.regexp_replace("text", "(?U)\\s", "")) > 0)


def parsed(answer: str | Column) -> Column:
    """A slot's answer, JSON text, as a struct of KINDS; what isn't such JSON is null, and so are missing lists."""
    return F.from_json(answer, ANSWER)


def answers(segments: DataFrame, extractor: Callable[[str], dict | str] = rule_extractor, rate: float | None = None, tasks: int = 4, retries: int = 0, delay: float = 0.0) -> DataFrame:
    """(document_id, segment_id, source_path, position, text, seconds, attempts, failed, error, answer) of segments that aren't blank.

    An extractor may call a service and give a dict of lists by KINDS, or JSON text of one. It is called once a segment, in the
    tasks: write the result before using it twice. One that fails is asked again alone, up to `retries` times, `delay` seconds later; a
    segment that fails at last has failed = true, the last error and no records. rate: calls a second of all tasks
    together; segments are then dealt out to `tasks` tasks, each of which takes its share of the rate and begins in its turn.
    Records keep their order whatever task had them, by `position`.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        from pyspark import TaskContext

        every = tasks / rate if rate else 0.0
        free = time.monotonic() + (TaskContext.get().partitionId() % tasks / rate if rate else 0.0)

        def asked(text: str) -> tuple[float, int, bool, str | None, str | None]:
            nonlocal free
            began, error = time.perf_counter(), None
            for attempt in range(1, retries + 2):
                if rate:
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = max(free, time.monotonic()) + every
                try:
                    found = extractor(text)
                    return time.perf_counter() - began, attempt, False, None, found if isinstance(found, str) else json.dumps(found, ensure_ascii=False, default=str)
                except Exception as e:  # the slot's contract: kept with the segment, which has no records
                    error = f"{type(e).__name__}: {e}"[:1000]
                    if attempt <= retries:
                        time.sleep(delay)
            return time.perf_counter() - began, retries + 1, True, error, None

        for b in batches:
            rows = pd.DataFrame([asked(t) for t in b["text"]], columns=["seconds", "attempts", "failed", "error", "raw"], index=b.index)
            yield pd.concat([b, rows], axis=1)

    path = "source_path" if "source_path" in segments.columns else "cast('' as string)"
    rows = filled(segments).selectExpr("document_id", "id as segment_id", f"{path} as source_path", "cast(position as int) position", "text")
    if rate:
        rows = rows.repartition(tasks)
    kind = "document_id string, segment_id string, source_path string, position int, text string, seconds double, attempts int, failed boolean, error string, raw string"
    found = rows.mapInPandas(run, kind).withColumn("answer", parsed("raw"))
    broken = ~F.col("failed") & F.try_parse_json("raw").isNull()
    return found.withColumn("error", F.when(broken, "not JSON").otherwise(F.col("error"))).withColumn("failed", F.col("failed") | broken).drop("raw")


def dead_letters(answered: DataFrame) -> DataFrame:
    """The segments without an answer, with the last error and how often they were asked."""
    return answered.where("failed").select("document_id", "segment_id", "source_path", "position", "text", "attempts", "error")


def asked_again(answered: DataFrame, extractor: Callable[[str], dict | str], **how) -> DataFrame:
    """The answers with those of the dead letters anew; the others aren't asked."""
    left = dead_letters(answered).withColumnRenamed("segment_id", "id")
    return answered.where("not failed").unionByName(answers(left, extractor, **how))


def records(answered: DataFrame, kind: str) -> DataFrame:
    """(document_id, segment_id, ord, text, *the record's fields) of one of KINDS, ord by place in the document."""
    one = answered.select("document_id", "segment_id", "position", "text", F.posexplode(f"answer.{kind}").alias("_i", "_x"))
    return one.select("document_id", "segment_id", (F.col("position").cast("long") * MOST_RECORDS + F.col("_i")).alias("ord"), "text", "_x.*")


def provenance(answered: DataFrame, run_id: str, schema_version: int = 1) -> DataFrame:
    """One change record a segment: where its records come from, how long that took and how many there are."""
    n = [F.coalesce(F.size(f"answer.{k}"), F.lit(0)).alias(k) for k in KINDS]
    sized = [F.when(x > 0, x).otherwise(0).alias(k) for x, k in zip(n, KINDS, strict=True)]
    return answered.select(
        F.lit(run_id).alias("run_id"), F.lit("merge").alias("change_type"), "document_id", "segment_id", "source_path", F.lit("knowledge_curator").alias("extractor"),
        F.create_map(F.lit("latency"), F.col("seconds").cast("string"), F.lit("schema_version"), F.lit(str(schema_version))).alias("metadata"), *sized, "failed",
    )
