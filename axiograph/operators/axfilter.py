"""Axiom filters: by type, by namespace, by partial or complete match of names; remove and filter with gap spanning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.model import CHARACTERISTICS, GROUPS, Ontology, axiom_id
from axiograph.operators import graph

ALL_TYPES = sorted({"Declaration", "AnnotationAssertion", *GROUPS["logical"]})


def _internal(bases: list[str]) -> Column:
    several = F.col("ax_type").isin("DisjointClasses", "DisjointProperties", "DifferentIndividuals") & (F.size("operands") > 0)  # all operands are subjects
    own = F.when(several, F.col("operands")).otherwise(F.array("subject"))
    return F.exists(own, lambda x: reduce(lambda a, b: a | b, [x.startswith(b) for b in bases], F.lit(False)))


def structural_tautology() -> Column:
    """Axioms that hold in every ontology by their form: A under A or Thing, Nothing under A, a property under itself, Thing as a type, domain or range."""
    under = F.col("ax_type").isin("SubClassOf", "EquivalentClasses", "SubPropertyOf", "EquivalentProperties")
    top = F.col("ax_type").isin("SubClassOf", "ClassAssertion", "PropertyDomain", "PropertyRange") & (F.col("object") == V.THING)
    builtin = F.col("object").isin(V.OWL + "topObjectProperty", V.OWL + "topDataProperty") & (F.col("ax_type") == "SubPropertyOf")
    return (under & (F.col("subject") == F.col("object"))) | top | builtin | ((F.col("ax_type") == "SubClassOf") & (F.col("subject") == V.NOTHING))


def of_type(axioms: DataFrame, selectors: list[str], bases: list[str] = ()) -> DataFrame:
    """The union of what the selectors name: all, a group (logical, tbox, ...), an axiom type, internal or external (by the
    subject's namespace), structural-tautologies."""
    conditions = []
    for s in selectors:
        if s in ("internal", "external"):
            conditions.append(_internal(list(bases)) if s == "internal" else ~_internal(list(bases)))
        elif s in ("tautologies", "structural-tautologies"):
            conditions.append(structural_tautology())
        elif s == "all":
            conditions.append(F.lit(True))
        elif s in GROUPS or s in ALL_TYPES:
            conditions.append(F.col("ax_type").isin(GROUPS.get(s, [s])))
        else:
            raise ValueError(f"unknown axiom selector {s}")
    return axioms.where(reduce(lambda a, b: a | b, conditions, F.lit(False)))


def names(axioms: DataFrame, named_only: bool = True) -> DataFrame:
    """ax_id, node: the names of every axiom, those inside of expressions too; with the texts of all its expressions if named_only is false."""
    return axioms.select("ax_id", F.explode("sig" if named_only else F.array_union("sig", "exprs")).alias("node"))


def _ids(axioms: DataFrame, objects: DataFrame, named_only: bool, how: str) -> DataFrame:
    """ax_id of axioms with a name among the objects (left_semi) or a name not among them (left_anti)."""
    return names(axioms, named_only).join(objects.select("node").distinct(), "node", how).select("ax_id").distinct()


def partial(axioms: DataFrame, objects: DataFrame, named_only: bool = True) -> DataFrame:
    """Axioms with any of the objects."""
    return axioms.join(_ids(axioms, objects, named_only, "left_semi"), "ax_id", "left_semi")


def complete(axioms: DataFrame, objects: DataFrame, named_only: bool = True) -> DataFrame:
    """Axioms whose objects are all among the objects."""
    return axioms.join(_ids(axioms, objects, named_only, "left_anti"), "ax_id", "left_anti")


def without_notes(axioms: DataFrame, prop: str | None = None, value: str | None = None, regex: str | None = None) -> DataFrame:
    """Axioms without annotations: all, those with a property, an exact value or a value that a pattern matches in full. What then is
    the same axiom is kept once."""
    part = lambda n: F.split_part(n, F.lit("="), F.lit(1))
    goes = lambda n: F.lit(True) if prop is None else (part(n) == prop) & (F.lit(True) if value is None else n == f"{prop}={value}") & (F.lit(True) if regex is None else F.substr(n, F.lit(len(prop) + 2)).rlike(f"^(?:{regex})$"))
    kept = axioms.withColumn("notes", F.filter("notes", lambda n: ~goes(n)))
    return kept.withColumn("ax_id", axiom_id()).dropDuplicates(["ax_id"])


def about(axioms: DataFrame, objects: DataFrame) -> DataFrame:
    """Annotation axioms whose subject is among the objects."""
    return axioms.where("ax_type = 'AnnotationAssertion'").join(objects.select(F.col("node").alias("subject")), "subject", "left_semi")


def by_properties(axioms: DataFrame, allowed: list[str], known: DataFrame) -> DataFrame:
    """Axioms that use no object property but the allowed ones; known: object properties (column node)."""
    others = known.where(~F.col("node").isin(list(allowed))).select("node")
    used = names(axioms).join(others, "node", "left_semi").select("ax_id").distinct()
    return axioms.join(used, "ax_id", "left_anti")


def characteristics(axioms: DataFrame) -> DataFrame:
    return axioms.where(F.col("ax_type").isin(*CHARACTERISTICS.values()))


def spanned(ont: Ontology, kept: DataFrame) -> DataFrame:
    """child, parent of the class hierarchy over the kept nodes, gaps spanned."""
    return graph.span_gaps(ont.edges.where("kind = 'class' AND o_kind = 'iri'"), kept)


def remove(ont: Ontology, objects: DataFrame, selectors: list[str] = ("all",), bases: list[str] = (), trim: bool = True, signature: bool = False, preserve_structure: bool = True) -> DataFrame:
    """ax_type, subject, property, object of the ontology after axioms with any (trim) or only removed objects went; the
    hierarchy is linked over what went if preserve_structure."""
    some = of_type(ont.axioms, list(selectors), list(bases))
    if trim:  # the ids alone decide
        left = ont.axioms.join(_ids(some, objects, signature, "left_semi"), "ax_id", "left_anti")
    else:
        left = ont.axioms.join(complete(some, objects, signature).select("ax_id"), "ax_id", "left_anti")
    left = left.select("ax_type", "subject", "property", "object")
    return _with_gaps(ont, left, objects, preserve_structure)


def _with_gaps(ont: Ontology, left: DataFrame, objects: DataFrame, preserve_structure: bool) -> DataFrame:
    if not preserve_structure:
        return left.distinct()
    classes = ont.declared.where("kind = 'class'").select(F.col("iri").alias("node"))
    links = spanned(ont, classes.join(objects.select("node"), "node", "left_anti"))
    return left.unionByName(links.select(F.lit("SubClassOf").alias("ax_type"), F.col("child").alias("subject"), F.lit(V.SUBCLASS).alias("property"), F.col("parent").alias("object"))).distinct()


def keep(ont: Ontology, objects: DataFrame, selectors: list[str] = ("all",), bases: list[str] = (), trim: bool = True, preserve_structure: bool = True) -> DataFrame:
    """ax_type, subject, property, object of the axioms with only (trim) or any kept objects, of the named types, and
    the hierarchy between kept classes."""
    match = complete if trim else partial
    left = match(of_type(ont.axioms, list(selectors), list(bases)), objects).select("ax_type", "subject", "property", "object")
    if not preserve_structure:
        return left.distinct()
    classes = ont.declared.where("kind = 'class'").select(F.col("iri").alias("node"))
    links = spanned(ont, classes.join(objects.select("node"), "node", "left_semi"))
    return left.unionByName(links.select(F.lit("SubClassOf").alias("ax_type"), F.col("child").alias("subject"), F.lit(V.SUBCLASS).alias("property"), F.col("parent").alias("object"))).distinct()
