"""Reference checks and repair: dangling and deprecated references, replacement, and merging of annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from axiograph.functions import vocab as V
from axiograph.model import Ontology, axiom_id
from axiograph.operators import axfilter, graph, setops


def deprecated(ont: Ontology) -> DataFrame:
    """iri: entities marked deprecated anywhere in the closure."""
    return ont.with_p(V.DEPRECATED).where((F.col("o") == "true") & (F.col("o_dt") == V.XSD_BOOLEAN)).select(F.col("s").alias("iri")).distinct()


def invalid_references(ont: Ontology) -> DataFrame:
    """ax_type, subject, object, entity, category: logical axioms that name a dangling or a deprecated entity. An axiom
    of a deprecated entity about itself is no such reference."""
    logical = axfilter.of_type(ont.axioms, ["logical"]).select("ax_id", "ax_type", "subject", "object", F.explode("sig").alias("entity"))
    bad = graph.dangling(ont).select("iri", F.lit("DANGLING").alias("category")).unionByName(deprecated(ont).select("iri", F.lit("DEPRECATED").alias("category")))
    found = logical.join(bad.withColumnRenamed("iri", "entity"), "entity")
    return found.where("category = 'DANGLING' OR entity <> subject").select("ax_type", "subject", "object", "entity", "category").distinct()


def replacements(ont: Ontology) -> DataFrame:
    """old, new: what deprecated entities are replaced by; of several the first by code point."""
    named = ont.with_p(V.REPLACED_BY).where("o_kind <> 'bnode'")
    return named.join(deprecated(ont).select(F.col("iri").alias("s")), "s", "left_semi").groupBy(F.col("s").alias("old")).agg(F.min("o").alias("new"))


def repair_references(ont: Ontology, migrate: list[str] = ()) -> DataFrame:
    """Triples in which references to replaced entities name the replacement. Statements about a deprecated entity stay
    as they are, except annotations with a property in migrate, which move."""
    rows = ont.rows.distinct()
    names = replacements(ont)
    about = rows.join(names.select(F.col("old").alias("s")), "s", "left_semi")
    stays = about.where(~F.col("p").isin(list(migrate)))
    moves = about.where(F.col("p").isin(list(migrate)))
    others = rows.join(names.select(F.col("old").alias("s")), "s", "left_anti")
    return setops.merge(stays, setops.rename(others.unionByName(moves), names), shared=True)


def merged_notes(axioms: DataFrame) -> DataFrame:
    """Axioms that differ in annotations only become one with all of them."""
    by = axioms.groupBy("core_id", "ax_type", "subject", "property", "object").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("notes")))).alias("notes"))
    return by.withColumn("ax_id", axiom_id())


def one_annotation(ont: Ontology, properties: list[str]) -> DataFrame:
    """s, p, o: one annotation of each property for an entity: its only one without a language, or else the smallest."""
    rows = ont.with_p(*properties).where("s_kind = 'iri' AND o_kind = 'lit'").withColumn("lang", F.coalesce("o_lang", F.lit("")))
    by = rows.groupBy("s", "p").agg(F.count(F.when(F.col("lang") == "", 1)).alias("plain"), F.min(F.when(F.col("lang") == "", F.col("o"))).alias("first"), F.min("o").alias("least"))
    return by.select("s", "p", F.when(F.col("plain") == 1, F.col("first")).otherwise(F.col("least")).alias("o"))


def joined_annotations(ont: Ontology, properties: list[str], separator: str = " ") -> DataFrame:
    """s, p, o: an entity's literals of a property, sorted and joined to one text."""
    rows = ont.with_p(*properties).where("s_kind = 'iri' AND o_kind = 'lit'").select("s", "p", "o").distinct()
    return rows.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list("o")), separator).alias("o"))


def first_by_language(ont: Ontology, prop: str) -> DataFrame:
    """s, o, lang: one value for each entity and language, the smallest."""
    rows = ont.with_p(prop).where("s_kind = 'iri' AND o_kind = 'lit'").withColumn("lang", F.coalesce("o_lang", F.lit("")))
    order = Window.partitionBy("s", "lang").orderBy("o")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("s", "o", "lang")
