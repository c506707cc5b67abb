"""Choosing rules for files and keeping the rule table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from consigna.sources.files import extension

# File name extensions of each rule file type.
EXTENSIONS = {"excel": ["xlsx", "xls"], "word": ["docx", "doc"], "pdf": ["pdf"]}


def match_rule(name: Column, rules: list[dict]) -> Column:
    """Id of the first rule whose type fits the extension and whose keywords all occur in the name.

    Rules are dicts with id, fileType and keywords. They are few and fixed when the query is
    written, so the match is one expression and not a join.
    """
    ext = extension(name)
    found = []
    for r in rules:
        if not r.get("keywords"):
            continue
        fits = [ext.isin(EXTENSIONS[r["fileType"]])] if r["fileType"] in EXTENSIONS else []
        fits += [F.contains(name, F.lit(k)) for k in r["keywords"]]
        found.append(F.when(reduce(lambda a, b: a & b, fits), F.lit(r["id"])))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def match_rule_by_filename(files: DataFrame, rules: list[dict], name: str = "file_name") -> DataFrame:
    return files.withColumn("rule_id", match_rule(F.col(name), rules))


def rules_for_type(rules: DataFrame, file_type: str | None = None) -> DataFrame:
    return rules.filter(F.col("file_type") == file_type) if file_type else rules


def upsert_snapshot(stored: DataFrame, incoming: DataFrame, key: str, changed: list[str], seq: str, now: Column, new_id: Column) -> DataFrame:
    """New snapshot of a table after merging rows by a natural key, with what happened to each row.

    A known key updates the given columns of its first stored row and keeps the id; a new key is
    inserted. Of several incoming rows with one key the last by `seq` wins.
    """
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*changed), F.col(seq)).alias("_in"))
    target = (
        stored.join(last.select(key), key, "left_semi").groupBy(key).agg(F.min("id").alias("id"))
        .join(last, key).select("id", "_in")
    )
    hit = F.col("_in").isNotNull()
    kept = stored.join(target, "id", "left").select(
        "id", key,
        *[F.when(hit, F.col("_in")[c]).otherwise(F.col(c)).alias(c) for c in changed],
        "created_at", F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, F.lit("updated")).otherwise(F.lit("kept")).alias("action"),
    )
    added = last.join(stored.select(key), key, "left_anti").select(
        new_id.alias("id"), key, *[F.col("_in")[c].alias(c) for c in changed],
        now.alias("created_at"), now.alias("updated_at"), F.lit("inserted").alias("action"),
    )
    return kept.unionByName(added)
