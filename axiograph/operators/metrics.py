"""Ontology metrics as a long table: metric, metric_value, metric_type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import terms
from axiograph.functions import vocab as V
from axiograph.model import CHARACTERISTICS, GROUPS, Ontology
from axiograph.operators import axfilter, graph, reason
from axiograph.sources.shared import settle

SINGLE, LIST, MAP = "single_value", "list_value", "map_value"


def _single(rows: DataFrame, **columns: Column) -> DataFrame:
    """One row of aggregates, turned to long form."""
    one = rows.agg(*[c.cast("string").alias(k) for k, c in columns.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("metric_value"), F.lit(SINGLE).alias("metric_type")) for k in columns])).alias("x")).select("x.*")


def _map(rows: DataFrame, metric: str, key: str, value: str = "n") -> DataFrame:
    return rows.select(F.lit(metric).alias("metric"), F.concat_ws(" ", F.col(key), F.col(value).cast("string")).alias("metric_value"), F.lit(MAP).alias("metric_type"))


def entity_counts(ont: Ontology, suffix: str = "") -> DataFrame:
    """Numbers of entities by kind, and of distinct (IRI, kind) pairs."""
    kinds = {"class": "class_count", "object-property": "obj_property_count", "data-property": "data_property_count", "annotation-property": "annotation_property_count", "individual": "individual_count", "datatype": "datatype_count"}
    return _single(ont.declared, **{v + suffix: F.count(F.when(F.col("kind") == k, 1)) for k, v in kinds.items()}, **{"signature_entity_count" + suffix: F.count("*")})


def axiom_counts(ont: Ontology, suffix: str = "") -> DataFrame:
    """Axioms, logical axioms, and the sizes of TBox, RBox, both and ABox."""
    of = lambda *groups: F.count(F.when(F.col("ax_type").isin([t for g in groups for t in GROUPS[g]]), 1))
    return _single(ont.axioms, **{"axiom_count" + suffix: F.count("*"), "logical_axiom_count" + suffix: of("logical"), "tbox_axiom_count" + suffix: of("tbox"), "rbox_axiom_count" + suffix: of("rbox"), "tboxrbox_axiom_count" + suffix: of("tbox", "rbox"), "abox_axiom_count" + suffix: of("abox"), "rule_count" + suffix: F.lit(0)})


def axiom_types(ont: Ontology) -> DataFrame:
    return _map(ont.axioms.groupBy("ax_type").agg(F.count("*").alias("n")), "axiom_type_count", "ax_type")


def expression_types(ont: Ontology) -> DataFrame:
    """How often each constructor is used."""
    return _map(ont.expressions.groupBy("op").agg(F.count("*").alias("n")), "class_expression_count", "op")


def namespaces(ont: Ontology, prefixes: dict[str, str]) -> DataFrame:
    """Entities by the prefix of their CURIE, and uses of those entities in axioms."""
    prefix = lambda c: F.split_part(terms.to_curie(c, prefixes), F.lit(":"), F.lit(1))
    entities = ont.declared.select("iri").distinct().withColumn("ns", prefix("iri")).groupBy("ns").agg(F.count("*").alias("n"))
    uses = axfilter.names(ont.axioms).withColumnRenamed("node", "iri").withColumn("ns", prefix("iri")).groupBy("ns").agg(F.count("*").alias("n"))
    return _map(entities, "namespace_entity_count", "ns").unionByName(_map(uses, "namespace_axiom_count", "ns"))


def header(ont: Ontology) -> DataFrame:
    """Ontology and version IRIs and direct imports; "anonymous" where there is no ontology IRI."""
    found = ont.with_p(V.TYPE).where(F.col("o") == V.ONTOLOGY).select("s")
    owner = ont.with_p(V.IMPORTS, V.VERSION)
    root = found.join(owner.where(F.col("p") == V.IMPORTS).select(F.col("o").alias("s")), "s", "left_anti")
    iri = _single(root, ontology_iri=F.coalesce(F.min("s"), F.lit("anonymous")))
    version = _single(owner.where(F.col("p") == V.VERSION), ontology_version_iri=F.coalesce(F.min("o"), F.lit("no.iri")))
    imports = owner.where(F.col("p") == V.IMPORTS).select(F.lit("valid_imports").alias("metric"), F.col("o").alias("metric_value"), F.lit(LIST).alias("metric_type"))
    return iri.unionByName(version).unionByName(imports)


def datatypes(ont: Ontology) -> DataFrame:
    """Built-in and other datatypes that literals use, and literals by datatype."""
    used = ont.rows.distinct().where("o_kind = 'lit'").groupBy("o_dt").agg(F.count("*").alias("n"))
    builtin = F.col("o_dt").startswith(V.XSD) | F.col("o_dt").startswith(V.RDF) | F.col("o_dt").startswith(V.RDFS)
    return _single(used, datatypes_builtin_count=F.count(F.when(builtin, 1)), datatypes_notbuiltin_count=F.count(F.when(~builtin, 1))).unionByName(_map(used, "dt_axiom_count", "o_dt"))


def hierarchy(ont: Ontology) -> DataFrame:
    """Averages and extremes of the asserted class hierarchy; averages are over all declared classes, to 6 places."""
    classes = ont.declared.where("kind = 'class'").select(F.col("iri").alias("node"))
    edges = ont.edges.where("kind = 'class'")
    up = edges.groupBy(F.col("child").alias("node")).agg(F.count("*").alias("parents"), F.count(F.when(F.col("o_kind") == "iri", 1)).alias("named"))
    down = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    made = ont.with_p(V.TYPE).where(~F.col("o").startswith(V.OWL)).groupBy(F.col("o").alias("node")).agg(F.count("*").alias("instances"))
    each = classes.join(up, "node", "left").join(down, "node", "left").join(made, "node", "left").na.fill(0)
    ratio = lambda c: F.round(F.sum(c) / F.count("*"), 6).cast("decimal(20,6)")
    return _single(each, avg_asserted_subclass_axioms_per_class=ratio("children"), avg_asserted_superclass_axioms_per_class=ratio("parents"), avg_instance_per_class=ratio("instances"), class_sgl_subcl_count=F.count(F.when(F.col("children") == 1, 1)), max_num_named_superclasses=F.max("named"), multi_inheritance_count=F.count(F.when(F.col("named") > 1, 1)))


def structure(ont: Ontology) -> DataFrame:
    """Complex right-hand sides, hidden GCIs, undeclared names, structural tautologies, cycles, the longest axiom."""
    ax = ont.axioms
    complex_rhs = _single(ax.where("object_kind = 'bnode' AND ax_type IN ('SubClassOf', 'EquivalentClasses')"), axiom_complexrhs_count=F.count("*"))
    sub = ax.where("ax_type = 'SubClassOf'").select("subject").distinct()
    hidden = _single(ax.where("ax_type = 'EquivalentClasses'").select("subject").distinct().join(sub, "subject", "left_semi"), gci_hidden_count=F.count("*"))
    undeclared = _single(axfilter.names(ax).select(F.col("node").alias("iri")).distinct().join(ont.declared.select("iri"), "iri", "left_anti"), undeclared_entity_count=F.count("*"))
    tautologies = _single(ax.where(axfilter.structural_tautology()), tautology_count=F.count("*"))
    uses = lambda c: F.size(F.filter(F.split(c, r"[() ]+"), lambda x: F.array_contains("sig", x)))
    longest = _single(ax.where("object_kind <> 'lit'"), longest_axiom_length=F.max(uses("object") + F.when(F.size("operands") == 0, uses("subject") + F.array_contains("sig", F.col("property")).cast("int")).when(F.col("ax_type").isin("SubPropertyChainOf", "DisjointUnion", "HasKey"), uses("subject")).otherwise(0)))
    loops = _single(graph.cycles(ont.edges.where("kind = 'class'")), cyclic_class_count=F.count("*"))
    return reduce(DataFrame.unionByName, [complex_rhs, hidden, undeclared, tautologies, longest, loops])


def constructs(ont: Ontology) -> DataFrame:
    """Language constructs in use, one row each; partial, from what the tables hold."""
    ops = ont.expressions.select("op").distinct().withColumnRenamed("op", "c")
    kinds = ont.axioms.where(F.col("ax_type").isin("SubPropertyOf", "InverseProperties", *CHARACTERISTICS.values())).select(F.col("ax_type").alias("c")).distinct()
    return ops.unionByName(kinds).select(F.lit("constructs").alias("metric"), F.col("c").alias("metric_value"), F.lit(LIST).alias("metric_type"))


def rdfs_only(ont: Ontology) -> DataFrame:
    """Whether every logical axiom can be said in RDFS: named subclasses, subproperties, domains, ranges and assertions."""
    plain = F.col("ax_type").isin("SubClassOf", "SubPropertyOf", "PropertyDomain", "PropertyRange", "ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion") & (F.col("object_kind") != "bnode")
    return _single(axfilter.of_type(ont.axioms, ["logical"]), rdfs=F.coalesce(F.min(plain), F.lit(True)))


def el_profile(ont: Ontology) -> DataFrame:
    """Whether the ontology is in the profiles EL, QL and RL, and how many axioms stand against EL."""
    wrong = reduce(DataFrame.unionByName, [reason.profile_violations(ont, p).select(F.lit(p).alias("profile")) for p in ("EL", "QL", "RL")])
    n = lambda p: F.count(F.when(F.col("profile") == p, 1))
    return _single(wrong, el_violation_count=n("EL"), owl2_el=n("EL") == 0, owl2_ql=n("QL") == 0, owl2_rl=n("RL") == 0)


def most_frequent_class(ont: Ontology) -> DataFrame:
    """The class that most axioms name; ties by code point."""
    uses = axfilter.names(ont.axioms).join(ont.declared.where("kind = 'class'").select(F.col("iri").alias("node")), "node", "left_semi").groupBy("node").agg(F.count("*").alias("n"))
    return _single(uses, most_freq_concept=F.max_by("node", F.struct(F.col("n"), F.col("node"))))


def nominals_and_gcis(ont: Ontology) -> DataFrame:
    """Nominals (one-of and has-value expressions) in the TBox, and subclass axioms with an anonymous left side."""
    nominal = ont.with_p(V.OWL + "oneOf", V.OWL + "hasValue").select(F.col("s").alias("o")).distinct()
    left = ont.with_p(V.SUBCLASS, V.EQUIVALENT, V.DISJOINT).where("o_kind = 'bnode'").select("o").distinct()
    return _single(nominal.join(left, "o", "left_semi"), tbox_nominal_count=F.count("*")).unionByName(_single(ont.with_p(V.SUBCLASS).where("s_kind = 'bnode'"), gci_count=F.count("*")))


def reasoner_metrics(ont: Ontology) -> DataFrame:
    """Whether no individual is of an unsatisfiable class, and the number of these classes: -1 if one is, as then every class is."""
    bad = settle(reason.unsatisfiable(ont), "unsatisfiable")
    typed = ont.with_p(V.TYPE).join(bad.select(F.col("iri").alias("o")), "o", "left_semi")
    both = bad.select(F.lit(True).alias("is_class")).unionByName(typed.select(F.lit(False).alias("is_class")))
    wrong = F.count(F.when(~F.col("is_class"), 1)) > 0
    return _single(both, unsatisfiable_class_count=F.when(wrong, -1).otherwise(F.count(F.when(F.col("is_class"), 1))), consistent=~wrong)


def measure(ont: Ontology, kind: str = "essential", prefixes: dict[str, str] | None = None) -> DataFrame:
    """All metrics of a set: essential, extended or all, each including the one before; with "-reasoner" at the end also those
    that need reasoning."""
    kind, _, reasoner = kind.partition("-")
    parts = [entity_counts(ont), axiom_counts(ont), header(ont), rdfs_only(ont), el_profile(ont)]
    if kind in ("extended", "all"):
        parts += [axiom_types(ont), expression_types(ont), namespaces(ont, prefixes or V.PREFIXES), datatypes(ont), constructs(ont)]
    if kind == "all":
        parts += [hierarchy(ont), structure(ont), most_frequent_class(ont), nominals_and_gcis(ont)]
    if reasoner == "reasoner":
        parts.append(reasoner_metrics(ont))
    if kind not in ("essential", "extended", "all") or reasoner not in ("", "reasoner"):
        raise ValueError(f"unknown set of metrics {kind}")
    return reduce(DataFrame.unionByName, parts)
