"""Quality-control rules over triples: each gives entity, property, value of what violates it.

Rules that compare entities count distinct entities by key and join the counts back rather than join pairs, so one
label that a third of all entities share costs a row each.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V

BLANK = "blank node"
SYNONYMS = [V.EDITOR_SYNONYM, V.EXACT, V.BROAD, V.RELATED, V.NARROW]
#: Statements with these predicates alone don't make an entity one of the ontology's own.
_STRUCTURAL = [V.TYPE, V.EQUIVALENT, V.DISJOINT, V.EQUIVALENT_PROPERTY, V.SAME_AS, V.DIFFERENT, V.INVERSE]


class Graph:
    """The union of all graphs as a set of triples, and the sets of subjects that rules ask for."""

    def __init__(self, triples: DataFrame):
        self.all = triples.select("s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang")

    def with_p(self, *predicates: str) -> DataFrame:
        """Distinct triples with one of the predicates; term: the object with what tells its kind, comparable by =."""
        term = F.concat_ws("|", "o", "o_kind", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit("")))
        return self.all.where(F.col("p").isin(*predicates)).distinct().withColumn("term", term)

    def subjects(self, p: str, o: str, dt: str | None = None) -> DataFrame:
        found = self.all.where((F.col("p") == p) & (F.col("o") == o))
        return (found.where(F.col("o_dt") == dt) if dt else found).select("s").distinct()

    def deprecated(self) -> DataFrame:
        return self.subjects(V.DEPRECATED, "true", V.XSD_BOOLEAN)


def named(kind: str = "s_kind") -> Column:
    return F.col(kind) != "bnode"


def text() -> Column:
    """The object is a plain or a language-tagged literal, so that a pattern can be held against it."""
    return (F.col("o_kind") == "lit") & F.col("o_dt").isin(V.XSD_STRING, V.LANG_STRING)


def violations(rows: DataFrame, entity: str | Column = "s", prop: str | Column = "p", value: str | Column = "o") -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(col(entity).alias("entity"), col(prop).alias("property"), col(value).alias("value")).distinct()


def without(rows: DataFrame, subjects: DataFrame, on: str = "s") -> DataFrame:
    return rows.join(subjects.select(F.col("s").alias(on)), on, "left_anti")


def among(rows: DataFrame, subjects: DataFrame, on: str = "s") -> DataFrame:
    return rows.join(subjects.select(F.col("s").alias(on)), on, "left_semi")


def shared(rows: DataFrame, keys: list[str], what: str = "s", most: int = 1) -> DataFrame:
    """Rows whose keys come with more than `most` different values of `what`."""
    common = rows.groupBy(*keys).agg(F.countDistinct(what).alias("n")).where(F.col("n") > most).drop("n")
    return rows.join(common, keys, "left_semi")


def _no_value() -> Column:
    return F.lit(None).cast("string")


def annotation_whitespace(g: Graph) -> DataFrame:
    declared = g.subjects(V.TYPE, V.ANNOTATION_PROPERTY).select(F.col("s").alias("p"))
    edge = F.col("o").rlike(r"^\s|\s$") & (F.col("o_kind") != "bnode")
    return violations(g.all.where(named() & edge).join(declared, "p", "left_semi"))


def deprecated_boolean_datatype(g: Graph) -> DataFrame:
    return violations(g.with_p(V.DEPRECATED).where(named() & (F.col("o_kind") == "lit") & (F.col("o_dt") != V.XSD_BOOLEAN)))


def deprecated_class_reference(g: Graph) -> DataFrame:
    gone = among(g.deprecated(), g.subjects(V.TYPE, V.CLASS))
    own = g.with_p(V.SUBCLASS, V.EQUIVALENT, V.DISJOINT)
    above = own.where((F.col("p") == V.SUBCLASS) & ~F.col("o").isin(V.OBSOLETE_CLASS, V.THING))
    beside = own.where(F.col("p") != V.SUBCLASS)
    into = own.join(gone.select(F.col("s").alias("o")), "o", "left_semi")
    odd = g.with_p(V.OBJECT_PROPERTY, V.OWL + "DataProperty")
    fillers = among(g.with_p(V.SOME, V.ALL), g.subjects(V.TYPE, V.RESTRICTION)).join(gone.select(F.col("s").alias("o")), "o", "left_semi")
    parts = [violations(among(rows, gone)) for rows in (above, beside, odd)]
    parts += [violations(into, "o", "p", "s"), violations(fillers, F.lit(BLANK), "p", "o")]
    return reduce(DataFrame.union, parts).distinct()


def deprecated_property_reference(g: Graph) -> DataFrame:
    gone = g.deprecated()
    value = F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(BLANK)
    objects, data = (among(gone, g.subjects(V.TYPE, k)) for k in (V.OBJECT_PROPERTY, V.DATA_PROPERTY))
    into = lambda rows, who: violations(rows.join(who.select(F.col("s").alias("o")), "o", "left_semi"), "o", "p", F.when(F.col("s_kind") == "iri", F.col("s")).otherwise(BLANK))
    used = violations(g.all.join(gone.select(F.col("s").alias("p")), "p", "left_semi"), value=value)
    restrictions = among(g.with_p(V.ON_PROPERTY), g.subjects(V.TYPE, V.RESTRICTION)).join(gone.select(F.col("s").alias("o")), "o", "left_semi").select(F.col("s").alias("r"), F.col("o").alias("property"))
    through = violations(g.all.select("s", F.col("o").alias("r")).join(restrictions, "r"), "s", "property", F.lit(BLANK))
    parts = [into(g.with_p(V.EQUIVALENT_PROPERTY, V.SUBPROPERTY, V.INVERSE), objects), into(g.with_p(V.EQUIVALENT_PROPERTY, V.SUBPROPERTY), data), used, through]
    return reduce(DataFrame.union, parts).distinct()


def duplicate_definition(g: Graph) -> DataFrame:
    rows = without(g.with_p(V.DEFINITION, V.ELUCIDATION), g.deprecated())
    return violations(shared(rows, ["p", "term"]).where(named()))


def duplicate_exact_synonym(g: Graph) -> DataFrame:
    rows = without(g.with_p(V.EDITOR_SYNONYM, V.EXACT).where(named() & text()), g.deprecated()).withColumn("std", F.upper("o"))
    kinds = g.with_p(V.SYNONYM_TYPE).where(F.col("o").isin(V.ABBREVIATION, V.ACRONYM)).select(F.col("s").alias("a")).distinct()
    note = among(kinds.withColumnRenamed("a", "s"), g.subjects(V.TYPE, V.AXIOM)).withColumnRenamed("s", "a")
    part = lambda p, c, k="o": g.with_p(p).select(F.col("s").alias("a"), F.col(k).alias(c))
    short = note.join(part(V.ANN_SOURCE, "s"), "a").join(part(V.ANN_PROPERTY, "p"), "a").join(part(V.ANN_TARGET, "term", "term"), "a").select("s", "p", "term").distinct()
    counted = rows.join(short, ["s", "p", "term"], "left_anti")
    common = counted.groupBy("p", "std").agg(F.countDistinct("s").alias("n")).where("n > 1").select("p", "std")
    return violations(rows.join(common, ["p", "std"], "left_semi"))


def duplicate_label_synonym(g: Graph) -> DataFrame:
    """A label that is also an exact synonym, of the same entity or of another."""
    gone = g.deprecated()
    labels = without(g.with_p(V.LABEL).where(named()), gone).select("s", "o", "term")
    synonyms = without(g.with_p(V.EDITOR_SYNONYM, V.EXACT).where(named()), gone).select("p", "term").distinct()
    return violations(labels.join(synonyms, "term"))


def duplicate_label(g: Graph) -> DataFrame:
    gone = g.deprecated().withColumn("gone", F.lit(1))
    rows = g.with_p(V.LABEL).where(named()).join(gone, "s", "left")
    by = rows.groupBy("term").agg(F.countDistinct("s").alias("n"), F.countDistinct(F.when(F.col("gone").isNull(), F.col("s"))).alias("live"))
    return violations(rows.join(by, "term").where(((F.col("gone").isNull()) & (F.col("n") > 1)) | (F.col("gone").isNotNull() & (F.col("live") > 0))))


def duplicate_scoped_synonym(g: Graph) -> DataFrame:
    return violations(shared(g.with_p(*SYNONYMS).where(named()), ["s", "term"], "p"))


def equivalent_pair(g: Graph) -> DataFrame:
    return violations(g.with_p(V.EQUIVALENT).where(named("o_kind")))


def equivalent_class_axiom_no_genus(g: Graph) -> DataFrame:
    some = g.with_p(V.SOME).where(named("o_kind")).select(F.col("s").alias("r"), F.col("o").alias("value"))
    on = g.with_p(V.ON_PROPERTY).select(F.col("s").alias("r"), F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(BLANK).alias("property"))
    kinds = g.subjects(V.TYPE, V.RESTRICTION).select(F.col("s").alias("r"))
    return violations(g.with_p(V.EQUIVALENT).where(named()).select("s", F.col("o").alias("r")).join(kinds, "r").join(some, "r").join(on, "r"), "s", "property", "value")


def illegal_use_of_built_in_vocabulary(g: Graph) -> DataFrame:
    return violations(g.all.where(F.col("s") == V.TYPE), value=F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(BLANK))


def invalid_xref(g: Graph) -> DataFrame:
    return violations(g.with_p(V.XREF).where(named() & text() & ~F.col("o").rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*[A-Za-z0-9_]:[^\s]+$")))


def label_formatting(g: Graph) -> DataFrame:
    return violations(g.with_p(V.LABEL).where(named() & text() & F.col("o").rlike("[\n\t]")))


def label_whitespace(g: Graph) -> DataFrame:
    return violations(g.with_p(V.LABEL).where(named() & F.col("o").rlike(r"^\s|\s$")))


def lowercase_definition(g: Graph) -> DataFrame:
    rows = g.with_p(V.DEFINITION, V.ELUCIDATION).where(named() & text() & ~F.col("o").rlike("^[A-Z0-9]"))
    return violations(without(rows, g.deprecated()))


def _own(g: Graph) -> DataFrame:
    """Named subjects of more than structural statements, but for deprecated ones, ontologies and subsets."""
    rows = g.all.where(named() & ~F.col("p").isin(*_STRUCTURAL)).select("s").distinct()
    for other in (g.deprecated(), g.subjects(V.TYPE, V.ONTOLOGY), g.subjects(V.SUBPROPERTY, V.SUBSET_PROPERTY)):
        rows = without(rows, other)
    return rows


def missing_definition(g: Graph) -> DataFrame:
    rows = without(_own(g), g.with_p(V.DEFINITION, V.ELUCIDATION).select("s"))
    return violations(without(rows, g.subjects(V.TYPE, V.INDIVIDUAL)), prop=F.lit(V.DEFINITION), value=_no_value())


def missing_label(g: Graph) -> DataFrame:
    return violations(without(_own(g), g.with_p(V.LABEL).where("o <> ''").select("s")), prop=F.lit(V.LABEL), value=_no_value())


def missing_obsolete_label(g: Graph) -> DataFrame:
    return violations(among(g.with_p(V.LABEL).where(named() & text() & ~F.col("o").rlike("(?i)^obsolete")), g.deprecated()))


def _ontology_without(g: Graph, shown: str, *predicates: str) -> DataFrame:
    return violations(without(g.subjects(V.TYPE, V.ONTOLOGY), g.with_p(*predicates).select("s")), prop=F.lit(shown), value=_no_value())


def missing_ontology_description(g: Graph) -> DataFrame:
    return _ontology_without(g, V.DCTERMS + "description", V.DC + "description", V.DCTERMS + "description")


def missing_ontology_license(g: Graph) -> DataFrame:
    return _ontology_without(g, V.DCTERMS + "license", V.DCTERMS + "license")


def missing_ontology_title(g: Graph) -> DataFrame:
    return _ontology_without(g, V.DCTERMS + "title", V.DC + "title", V.DCTERMS + "title")


def _undeclared(g: Graph, used: str, kind: str) -> DataFrame:
    rows = g.with_p(used).select(F.col("o").alias("s")).distinct()
    return violations(without(rows, g.subjects(V.SUBPROPERTY, kind)), prop=F.lit(V.SUBPROPERTY), value=_no_value())


def missing_subset_declaration(g: Graph) -> DataFrame:
    return _undeclared(g, V.SUBSET, V.SUBSET_PROPERTY)


def missing_synonymtype_declaration(g: Graph) -> DataFrame:
    return _undeclared(g, V.SYNONYM_TYPE, V.SYNONYM_TYPE_PROPERTY)


def missing_superclass(g: Graph) -> DataFrame:
    rows = among(g.all.where(named() & ~F.col("p").isin(*_STRUCTURAL)).select("s").distinct(), g.subjects(V.TYPE, V.CLASS))
    return violations(without(without(rows, g.with_p(V.SUBCLASS).select("s")), g.deprecated()), prop=F.lit(V.SUBCLASS), value=_no_value())


def misused_obsolete_label(g: Graph) -> DataFrame:
    rows = g.with_p(V.LABEL).where(named() & text() & (F.col("s") != V.OBSOLETE_CLASS) & F.col("o").rlike("(?i)^obsolete"))
    return violations(without(rows, g.deprecated()))


def misused_replaced_by(g: Graph) -> DataFrame:
    return violations(without(g.with_p(V.REPLACED_BY).where(named()), g.deprecated()))


def multiple_definitions(g: Graph) -> DataFrame:
    return violations(shared(without(g.with_p(V.DEFINITION, V.ELUCIDATION).where(named()), g.deprecated()), ["s", "p"], "term"))


def multiple_equivalent_classes(g: Graph) -> DataFrame:
    rows = g.with_p(V.EQUIVALENT).where(named()).join(g.with_p(V.UNION).select(F.col("s").alias("o")), "o", "left_anti")
    return violations(shared(rows, ["s"], "term"), value=F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(BLANK))


def multiple_equivalent_class_definitions(g: Graph) -> DataFrame:
    heads = g.with_p(V.INTERSECTION).select(F.col("s").alias("o"), F.col("o").alias("head"), F.col("o_kind").alias("head_kind"))
    rows = g.with_p(V.EQUIVALENT).where(named()).join(heads, "o")
    return violations(shared(rows, ["s"], "head"), value=F.when(F.col("head_kind") == "iri", F.col("head")).otherwise(BLANK))


def multiple_labels(g: Graph) -> DataFrame:
    return violations(shared(without(g.with_p(V.LABEL).where(named()), g.deprecated()), ["s"], "term"))


def invalid_entity_uri(g: Graph) -> DataFrame:
    s = F.col("s")
    return violations(g.with_p(V.TYPE).where(named() & (s.startswith("https://purl.obolibrary.org/obo/") | s.startswith("http://purl.org/obo/") | s.startswith("http://www.obofoundry.org/"))))


def multiple_asserted_superclasses(g: Graph) -> DataFrame:
    parents = among(g.with_p(V.SUBCLASS).where(named() & named("o_kind")), g.subjects(V.TYPE, V.CLASS))
    part = lambda p, c: g.with_p(p).select(F.col("s").alias("a"), F.col("o").alias(c))
    inferred = g.with_p(V.IS_INFERRED).where(F.col("o").contains("true")).select(F.col("s").alias("a")).distinct()
    about = part(V.ANN_PROPERTY, "q").where(F.col("q") == V.SUBCLASS).join(inferred, "a", "left_semi")
    marked = about.join(part(V.ANN_SOURCE, "s"), "a").join(part(V.ANN_TARGET, "o"), "a").select("s", "o").distinct()
    return violations(shared(parents, ["s"], "term").join(marked, ["s", "o"], "left_anti"))


#: The rules in the default profile and their levels, in its order.
DEFAULT_PROFILE: dict[str, str] = {
    "annotation_whitespace": "WARN", "deprecated_boolean_datatype": "ERROR", "deprecated_class_reference": "ERROR", "deprecated_property_reference": "ERROR",
    "duplicate_definition": "ERROR", "duplicate_exact_synonym": "WARN", "duplicate_label_synonym": "WARN", "duplicate_label": "ERROR", "duplicate_scoped_synonym": "WARN",
    "equivalent_pair": "WARN", "equivalent_class_axiom_no_genus": "WARN", "illegal_use_of_built_in_vocabulary": "ERROR", "invalid_xref": "WARN", "label_formatting": "ERROR",
    "label_whitespace": "ERROR", "lowercase_definition": "INFO", "missing_definition": "WARN", "missing_label": "ERROR", "missing_obsolete_label": "WARN",
    "missing_ontology_description": "ERROR", "missing_ontology_license": "ERROR", "missing_ontology_title": "ERROR", "missing_subset_declaration": "WARN",
    "missing_superclass": "INFO", "missing_synonymtype_declaration": "WARN", "misused_obsolete_label": "ERROR", "misused_replaced_by": "ERROR", "multiple_definitions": "ERROR",
    "multiple_equivalent_classes": "WARN", "multiple_equivalent_class_definitions": "ERROR", "multiple_labels": "ERROR", "invalid_entity_uri": "WARN",
}

RULES: dict[str, Callable[[Graph], DataFrame]] = {name: globals()[name] for name in [*DEFAULT_PROFILE, "multiple_asserted_superclasses"]}
