"""Reports: a profile of rules run over one graph, with levels, limits, labels and totals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.functions import terms
from axiograph.operators import rules
from axiograph.sources import files

LEVELS = ["ERROR", "WARN", "INFO"]
_CUSTOM: dict[str, Callable[[rules.Graph], DataFrame]] = {}


def register_rule(name: str, rule: Callable[[rules.Graph], DataFrame]) -> None:
    """A rule of one's own: gives entity, property, value."""
    _CUSTOM[name] = rule


def read_profile(text: str) -> dict[str, str]:
    """rule -> level of lines "LEVEL<tab>rule"; ValueError for an unknown level or rule."""
    out = {}
    for line in text.splitlines():
        if line.strip():
            level, _, rule = line.partition("\t")
            if level.upper() not in LEVELS or rule.strip() not in rules.RULES | _CUSTOM:
                raise ValueError(f"unknown level or rule: {line}")
            out[rule.strip()] = level.upper()
    return out


def report(triples: DataFrame, profile: dict[str, str] | None = None, base: list[str] = (), limit: int | None = None) -> DataFrame:
    """level, rule, entity, property, value of every violation. Entities of the built-in vocabularies go; base keeps
    entities of these namespaces only; limit counts a rule's rows after that."""
    g = rules.Graph(triples)
    known = rules.RULES | _CUSTOM
    parts = [known[name](g).select(F.lit(level).alias("level"), F.lit(name).alias("rule"), "entity", "property", "value") for name, level in (profile or rules.DEFAULT_PROFILE).items()]
    rows = reduce(DataFrame.unionByName, parts).where(~F.col("entity").contains("/rdf-schema#") & ~F.col("entity").contains("/owl#"))
    if base:
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("entity").startswith(b) for b in base]))
    if limit is not None:
        order = Window.partitionBy("rule").orderBy("entity", "property", "value")
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
    return rows


def totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("level").agg(F.count("*").alias("violations"))


def summary(rows: DataFrame) -> str:
    """The numbers of violations, in all and for each level, as a text of some lines."""
    n = {r["level"]: r["violations"] for r in totals(rows).collect()}  # a row for each level
    if not n:
        return "No violations found."
    head = f"Violations: {sum(n.values())}"
    return "\n".join([head, "-" * len(head), *[f"{k + ':':<7}{n.get(k, 0)}" for k in LEVELS]])


def table(rows: DataFrame) -> DataFrame:
    """The report as a table of texts: Level, Rule Name, Subject, Property, Value, the gravest level first, rules by name within a level. Sorted by ranges,
    so a rule with very many violations is in several files, which follow each other."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    ordered = rows.withColumn("rank_", rank).orderBy("rank_", "rule", "entity", "property", "value")
    return ordered.select(F.col("level").alias("Level"), F.col("rule").alias("Rule Name"), F.coalesce("entity", F.lit("")).alias("Subject"), F.coalesce("property", F.lit("")).alias("Property"), F.coalesce("value", F.lit("")).alias("Value"))


def write(rows: DataFrame, path: str, fmt: str | None = None) -> str:
    """Write the report as tsv, csv, html, yaml, json or parquet, by the ending of path (else tsv) or fmt; gives its summary()."""
    ending = path.rsplit("/", 1)[-1].rpartition(".")
    files.write_rows(table(rows), path, (fmt or (ending[2] if ending[1] else "tsv")).lower())
    return summary(rows)


def fails(rows: DataFrame, at: str) -> bool:
    """True if a violation is at the level `at` or above; "none" never fails."""
    if at.upper() == "NONE":
        return False
    return not rows.where(F.col("level").isin(LEVELS[: LEVELS.index(at.upper()) + 1])).isEmpty()


def labelled(rows: DataFrame, triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """The report with CURIEs and labels: "label [CURIE]" where there is a label."""
    names = terms.labels(triples)
    shown = terms.short_form("entity", "ID", prefixes)
    joined = rows.join(names.select(F.col("iri").alias("entity"), "label"), "entity", "left")
    return joined.select("level", "rule", F.when(F.col("label").isNotNull(), F.concat(F.col("label"), F.lit(" ["), shown, F.lit("]"))).otherwise(shown).alias("entity"), terms.short_form("property", "ID", prefixes).alias("property"), "value")
