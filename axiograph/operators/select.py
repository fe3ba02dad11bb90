"""Selectors: relational algebra over sets of objects (column node).

Selectors of one group are united; groups are composed, each working on what the one before gave.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.functions.terms import expand
from axiograph.model import Ontology
from axiograph.operators import graph

KIND_SELECTORS = {"classes": ["class"], "object-properties": ["object-property"], "data-properties": ["data-property"], "annotation-properties": ["annotation-property"], "individuals": ["individual"], "properties": ["object-property", "data-property", "annotation-property"]}
_LITERAL = re.compile(r"'(?P<text>.*)'(?:\^\^(?P<dt>\S+)|@(?P<lang>\S+))?$", re.DOTALL)


def all_objects(ont: Ontology) -> DataFrame:
    """Every named object and every anonymous one."""
    named = ont.declared.select(F.col("iri").alias("node"))
    return named.unionByName(ont.expressions.select(F.col("expr").alias("node"))).unionByName(ont.rows.where("s_kind = 'bnode'").select(F.col("s").alias("node"))).distinct()


def terms(ont: Ontology, iris: list[str], allow_punning: bool = False) -> DataFrame:
    """Terms that are declared entities; an IRI that is declared as several kinds counts only if punning is allowed."""
    found = ont.declared.where(F.col("iri").isin(iris)).groupBy("iri").agg(F.count("*").alias("n"))
    return (found if allow_punning else found.where("n = 1")).select(F.col("iri").alias("node"))


def pattern_regex(pattern: str) -> str:
    """<...> with * (any text) and ? (at most one character), or <~regex>; the whole IRI must match."""
    body = pattern.strip("<>")
    if body.startswith("~"):
        return f"^(?:{body[1:]})$"
    if "*" not in body and "?" not in body:
        raise ValueError(f"no wildcard in {pattern}")
    return "^" + body.replace(".", "\\.").replace("*", ".*").replace("?", ".?") + "$"


def _value_condition(value: str, prefixes: dict[str, str]) -> Column:
    if value.startswith("~'"):
        return F.col("o").rlike(f"^(?:{value[2:-1]})$") & (F.col("o_kind") == "lit")
    if value.startswith("^^"):
        return F.col("o_dt") == expand(value[2:], prefixes)
    if value.startswith("@"):
        return F.lower("o_lang") == value[1:].lower()
    if m := _LITERAL.match(value):
        kind = (F.lower("o_lang") == m["lang"].lower()) if m["lang"] else F.col("o_dt") == (expand(m["dt"], prefixes) if m["dt"] else V.XSD_STRING)
        return (F.col("o") == m["text"]) & (F.col("o_kind") == "lit") & kind
    return (F.col("o") == expand(value, prefixes)) & (F.col("o_kind") == "iri")


def annotated(ont: Ontology, prop: str, value: str, prefixes: dict[str, str]) -> DataFrame:
    """Objects with such an annotation, on themselves or on an axiom about them."""
    hit = ont.with_p(expand(prop, prefixes)).where(_value_condition(value, prefixes))
    about = ont.with_p(V.ANN_SOURCE).select("s", F.col("o").alias("node"))
    return hit.where("s_kind = 'iri'").select(F.col("s").alias("node")).unionByName(hit.join(about, "s").select("node")).distinct()


def select_one(ont: Ontology, objects: DataFrame, selector: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    prefixes = prefixes or V.PREFIXES
    node = F.col("node")
    join = lambda table, here, there: objects.join(table.select(F.col(here).alias("node"), F.col(there).alias("to")), "node").select(F.col("to").alias("node")).distinct()
    if selector == "self":
        return objects
    if selector in ("parents", "children"):
        return join(ont.edges, *(("child", "parent") if selector == "parents" else ("parent", "child")))
    if selector == "ancestors":
        return graph.reached(ont.edges, objects)
    if selector == "descendants":
        return graph.reached(ont.edges, objects, "parent", "child")
    if selector == "equivalents":
        pairs = ont.with_p(V.EQUIVALENT, V.EQUIVALENT_PROPERTY).select("s", "o")
        return join(pairs.unionByName(pairs.select(F.col("o").alias("s"), F.col("s").alias("o"))), "s", "o")
    if selector in ("instances", "types"):
        made = ont.with_p(V.TYPE).join(ont.declared.where("kind = 'individual'").select(F.col("iri").alias("s")), "s", "left_semi").where(F.col("o") != V.INDIVIDUAL)
        return join(made, *(("o", "s") if selector == "instances" else ("s", "o")))
    if selector in ("domains", "ranges"):
        return join(ont.with_p(V.DOMAIN if selector == "domains" else V.RANGE), "s", "o")
    if selector == "complement":
        return all_objects(ont).join(objects, "node", "left_anti")
    if selector in KIND_SELECTORS:
        return objects.join(ont.declared.where(F.col("kind").isin(KIND_SELECTORS[selector])).select(F.col("iri").alias("node")), "node", "left_semi")
    if selector == "named":
        return objects.where(~node.startswith("_:"))
    if selector == "anonymous":
        return objects.where(node.startswith("_:"))
    if selector.startswith("<"):
        return objects.where(~node.startswith("_:") & node.rlike(pattern_regex(selector)))
    if "=" in selector:
        prop, _, value = selector.partition("=")
        return objects.join(annotated(ont, prop, value, prefixes), "node", "left_semi")
    prefix, colon, rest = selector.partition(":")
    if colon:
        return objects.where(node.rlike(pattern_regex(f"<{prefixes[prefix]}{rest}>"))) if prefix in prefixes else objects
    raise ValueError(f"unknown selector {selector}")


def split_selectors(text: str) -> list[str]:
    """Selectors of a group: at spaces, but not inside quotes."""
    return re.findall(r"(?:[^\s'\"]|'[^']*'|\"[^\"]*\")+", text)


def select(ont: Ontology, objects: DataFrame, groups: list[str], prefixes: dict[str, str] | None = None) -> DataFrame:
    for group in groups:
        objects = reduce(DataFrame.unionByName, [select_one(ont, objects, s, prefixes) for s in split_selectors(group)]).distinct()
    return objects


def object_set(ont: Ontology, include: DataFrame | None = None, exclude: DataFrame | None = None, groups: list[str] = ()) -> DataFrame:
    """What remove and filter start from: the given terms or else all objects, selected, without the excluded ones."""
    found = select(ont, include if include is not None else all_objects(ont), list(groups))
    return found.join(exclude.select("node"), "node", "left_anti") if exclude is not None else found
