"""The ontology as tables: triples, and what is derived from them (objects, edges, axioms)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph import expressions
from axiograph.functions import vocab as V
from axiograph.sources.shared import settle

#: predicate -> axiom type, where the predicate alone decides
AXIOM_TYPES = {
    V.SUBCLASS: "SubClassOf", V.EQUIVALENT: "EquivalentClasses", V.DISJOINT: "DisjointClasses", V.SUBPROPERTY: "SubPropertyOf", V.EQUIVALENT_PROPERTY: "EquivalentProperties",
    V.INVERSE: "InverseProperties", V.DOMAIN: "PropertyDomain", V.RANGE: "PropertyRange", V.SAME_AS: "SameIndividual", V.DIFFERENT: "DifferentIndividuals",
}
#: classes of a property's characteristics -> axiom type
CHARACTERISTICS = {V.OWL + f"{k}Property": f"{k}Property" for k in ("Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive", "Functional", "InverseFunctional")}
DECLARED = {v: k for k, v in V.KINDS.items()}
#: axiom types of each group that a filter may name
GROUPS = {
    "declaration": ["Declaration"], "annotation": ["AnnotationAssertion"], "subclass": ["SubClassOf"], "subproperty": ["SubPropertyOf", "SubPropertyChainOf"], "equivalent": ["EquivalentClasses", "EquivalentProperties"],
    "disjoint": ["DisjointClasses", "DisjointProperties", "DisjointUnion"], "type": ["ClassAssertion"], "abox": ["ClassAssertion", "ObjectPropertyAssertion", "DataPropertyAssertion", "NegativePropertyAssertion", "SameIndividual", "DifferentIndividuals"],
    "tbox": ["SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion", "HasKey", "PropertyDomain", "PropertyRange"],
    "rbox": ["SubPropertyOf", "EquivalentProperties", "InverseProperties", "SubPropertyChainOf", "DisjointProperties", *CHARACTERISTICS.values()],
}
GROUPS["logical"] = sorted({*GROUPS["abox"], *GROUPS["tbox"], *GROUPS["rbox"]})
_REIFICATION = [V.ANN_SOURCE, V.ANN_PROPERTY, V.ANN_TARGET]


def case(column: str, table: dict[str, str], other: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in table.items():
        out = out.when(F.col(column) == k, v)
    return out.otherwise(other)


class Ontology:
    """Triples with set semantics and their views. Nothing is changed in place; views are lazy, and what many operators read more than
    once (expressions, axioms) is written at its first use."""

    def __init__(self, triples: DataFrame, imports: bool = True):
        cols = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
        self.triples = triples if "graph" in triples.columns else triples.withColumn("graph", F.lit("root"))
        self.rows = (self.triples if imports else self.triples.where("graph = 'root'")).select(*cols)
        self.spark = triples.sparkSession

    def with_p(self, *predicates: str) -> DataFrame:
        return self.rows.where(F.col("p").isin(*predicates)).distinct()

    @cached_property
    def declared(self) -> DataFrame:
        """iri, kind: named entities by what they are declared as; one IRI may have several kinds."""
        return self.with_p(V.TYPE).where((F.col("s_kind") == "iri") & F.col("o").isin(*DECLARED)).select(F.col("s").alias("iri"), case("o", DECLARED, F.lit(None)).alias("kind")).distinct()

    @cached_property
    def edges(self) -> DataFrame:
        """child, parent, kind: asserted sub/super edges of classes and properties, from named children."""
        kind = F.when(F.col("p") == V.SUBCLASS, "class").otherwise("property")
        return self.with_p(V.SUBCLASS, V.SUBPROPERTY).where("s_kind = 'iri' AND s <> o").select(F.col("s").alias("child"), F.col("o").alias("parent"), "o_kind", kind.alias("kind"))

    @cached_property
    def lists(self) -> DataFrame:
        """owner, p, head, cell, at, member, member_kind: every list that an expression or an axiom has."""
        return expressions.members(self.with_p)

    @cached_property
    def members(self) -> DataFrame:
        """expr, member: what intersections, unions and enumerations hold."""
        return self.lists.where(~F.col("p").isin(expressions.AXIOM_LISTS)).select(F.col("owner").alias("expr"), "member").distinct()

    @cached_property
    def _described(self) -> tuple[DataFrame, DataFrame]:
        return expressions.described(self.with_p, self.lists)

    @cached_property
    def expressions(self) -> DataFrame:
        """expr, op, prop, filler, n, label: anonymous expressions (and, or, not, one, some, all, value, self, min, max, exact, inverse), with a canonical
        text that is alike for like ones; null for what refers to itself."""
        return expressions.texts(*self._described)

    @cached_property
    def parts(self) -> DataFrame:
        """expr, role, at, part, part_kind: what each expression consists of."""
        return self._described[1]

    @cached_property
    def inside(self) -> DataFrame:
        """expr, node, node_kind, depth: the signature index, all names and expressions inside of each expression."""
        return expressions.inside(*self._described)

    @cached_property
    def labels(self) -> DataFrame:
        """node, text: the expressions that have a canonical text."""
        return settle(self.expressions.where("label IS NOT NULL").select(F.col("expr").alias("node"), F.col("label").alias("text")).distinct(), "labels")

    @cached_property
    def blanks(self) -> DataFrame:
        """node, text: a name for every blank node that isn't a list's cell, which depends on what is said of it alone: an expression's text, or a hash."""
        cells = self.lists.select(F.col("cell").alias("node")).distinct()
        rows = self.rows.join(self.labels.select(F.col("node").alias("s")), "s", "left_anti").join(self.consumed_cells.select(F.col("cell").alias("s")), "s", "left_anti")
        held = self.operands.select(F.col("owner").alias("s"), "p", F.col("head").alias("o"), F.array_join("texts", " ").alias("whole"))
        whole = F.col("whole").isNotNull()  # a list's members stand in place of its head
        rows = rows.join(held, ["s", "p", "o"], "left").withColumn("o_kind", F.when(whole, "iri").otherwise(F.col("o_kind"))).withColumn("o", F.coalesce("whole", "o")).drop("whole")
        found = expressions.coloured(rows, self.labels)
        return settle(self.labels.unionByName(found.join(cells, "node", "left_anti")), "blanks")

    @cached_property
    def consumed_cells(self) -> DataFrame:
        """cell: those of lists whose owner is known: a named node, an expression with a text, or an axiom of operands."""
        named = self.with_p(*expressions.LISTS).where("s_kind = 'iri'").select(F.col("s").alias("owner"))
        axiom = self.lists.where(F.col("p").isin(expressions.AXIOM_LISTS)).select("owner")
        owners = named.unionByName(axiom).unionByName(self.labels.select(F.col("node").alias("owner"))).distinct()
        return settle(self.lists.join(owners, "owner", "left_semi").select("cell").distinct(), "consumed")

    @cached_property
    def _inner(self) -> DataFrame:
        """expr, names, exprs: the names inside of each expression, and the texts of the expressions, its own among them."""
        rows = self.inside.join(self.labels, "node", "left")
        return settle(rows.groupBy("expr").agg(F.collect_set(F.when(F.col("node_kind") == "iri", F.col("node"))).alias("names"), F.collect_set("text").alias("exprs")), "inner")

    @cached_property
    def operands(self) -> DataFrame:
        """owner, p, head, texts, names, exprs: the members' texts of each list (in order for property chains, else sorted and each once), and the names and expressions inside."""
        items = self.lists.join(self.labels.select(F.col("node").alias("member"), "text"), "member", "left").withColumn("text", F.coalesce("text", expressions.shown("member", "member_kind")))
        items = items.join(self._inner.withColumnRenamed("expr", "member"), "member", "left")
        nothing, own = F.array().cast("array<string>"), F.when(F.col("member_kind") == "iri", F.array("member"))
        each = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
        ordered = F.when(F.col("p") == V.CHAIN, F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])).otherwise(F.array_sort(F.collect_set("text")))
        return settle(items.groupBy("owner", "p", "head").agg(ordered.alias("texts"), each(F.coalesce("names", own, nothing)).alias("names"), each(F.coalesce("exprs", nothing)).alias("exprs")), "operands")

    @cached_property
    def notes(self) -> DataFrame:
        """s, p, o, notes: the annotations of annotated axioms, sorted texts of property and value."""
        part = lambda p, c: self.with_p(p).select(F.col("s").alias("a"), F.col("o").alias(c))
        about = part(V.ANN_SOURCE, "s").join(part(V.ANN_PROPERTY, "p"), "a").join(part(V.ANN_TARGET, "o"), "a")
        own = self.rows.where("s_kind = 'bnode'").where(~F.col("p").isin(V.TYPE, *_REIFICATION)).select(F.col("s").alias("a"), F.concat_ws("=", "p", "o").alias("note")).distinct()
        return settle(about.join(own, "a").groupBy("s", "p", "o").agg(F.array_sort(F.collect_set("note")).alias("notes")), "notes")

    def _operand_axioms(self) -> DataFrame:
        """Axioms over lists: disjoint classes and properties, different individuals, disjoint unions, property chains and keys."""
        kind = {V.ALL_DISJOINT: "DisjointClasses", V.ALL_DISJOINT_PROPERTIES: "DisjointProperties", V.ALL_DIFFERENT: "DifferentIndividuals"}
        typed = self.with_p(V.TYPE).where(F.col("o").isin(*kind)).select(F.col("s").alias("owner"), case("o", kind, F.lit(None)).alias("ax_type"))
        lists = self.operands.where(F.col("p").isin(expressions.AXIOM_LISTS))
        own = {V.CHAIN: "SubPropertyChainOf", V.DISJOINT_UNION: "DisjointUnion", V.KEY: "HasKey"}
        several = lists.where(F.col("p").isin(V.MEMBERS, V.DISTINCT_MEMBERS)).join(typed, "owner").select("ax_type", F.element_at("texts", 1).alias("subject"), "p", "texts", "names", "exprs")
        about = lists.where(F.col("p").isin(*own)).join(self.labels.select(F.col("node").alias("owner"), "text"), "owner", "left")
        inner = self._inner.select(F.col("expr").alias("owner"), F.col("names").alias("more"), F.col("exprs").alias("more_exprs"))
        about = about.join(inner, "owner", "left").select(case("p", own, F.lit(None)).alias("ax_type"), F.coalesce("text", "owner").alias("subject"), "p", "texts", F.array_union("names", F.coalesce("more", F.array("owner"))).alias("names"), F.array_union("exprs", F.coalesce("more_exprs", F.array().cast("array<string>"))).alias("exprs"))
        rows = several.where(F.size("texts") > 0).unionByName(about)
        opening = F.when(F.col("p") == V.CHAIN, "chain(").otherwise("list(")
        none = F.lit("")
        return rows.select("ax_type", "subject", F.when(F.col("subject").endswith(")"), "bnode").otherwise("iri").alias("subject_kind"), F.col("p").alias("property"), F.concat(opening, F.array_join("texts", " "), F.lit(")")).alias("object"),
                           F.lit("list").alias("object_kind"), none.alias("dt"), none.alias("lang"), F.col("names").alias("sig"), "exprs", F.col("texts").alias("operands"), F.array().cast("array<string>").alias("notes"))

    def _negative(self) -> DataFrame:
        """Negative property assertions, as axioms of their individual, property and value."""
        part = lambda c, *p: self.with_p(*p).select("s", F.col("o").alias(c), *([F.col("o_kind").alias("object_kind"), F.coalesce("o_dt", F.lit("")).alias("dt"), F.coalesce("o_lang", F.lit("")).alias("lang")] if c == "object" else []))
        rows = self.with_p(V.TYPE).where(F.col("o") == V.NEGATIVE).select("s").join(part("subject", V.NEG_SOURCE), "s").join(part("property", V.NEG_PROPERTY), "s").join(part("object", V.NEG_TARGET, V.NEG_VALUE), "s")
        names = F.array("subject", "property", F.when(F.col("object_kind") == "iri", F.col("object")))
        return rows.select(F.lit("NegativePropertyAssertion").alias("ax_type"), "subject", F.lit("iri").alias("subject_kind"), "property", "object", "object_kind", "dt", "lang", F.filter(names, lambda x: x.isNotNull()).alias("sig"), F.array().cast("array<string>").alias("exprs"), F.array().cast("array<string>").alias("operands"), F.array().cast("array<string>").alias("notes"))

    @cached_property
    def axioms(self) -> DataFrame:
        """ax_type, subject, subject_kind, property, object, object_kind, dt, lang, sig, exprs, operands, notes, core_id, ax_id.

        core_id is a hash of 16 bytes without annotations, ax_id with them; sets of axioms are sets of ax_id. Reified annotations
        become notes of their axiom. Anonymous subjects (of general class axioms) and objects are their expression's canonical text, or a name that
        depends on what is said of them. sig: all names, those inside of expressions too; exprs: the texts of all expressions. Axioms of several operands have these in
        operands, the first as subject and the whole list as object. The table is written once for each ontology: rows with blank nodes or annotations meet
        these by joins, all others are only read; of these no two different ones make the same axiom, so they are made distinct by a hash of 8 bytes alone. Tables of
        properties are broadcast: a shuffle by predicate would bring all rows of a frequent one to one task.
        """
        objects = self.declared.where("kind = 'object-property'").select(F.col("iri").alias("p"), F.lit(True).alias("is_object"))
        data = self.declared.where("kind = 'data-property'").select(F.col("iri").alias("p"), F.lit(True).alias("is_data"))
        blank = "s_kind = 'bnode' OR o_kind = 'bnode'"
        rows = self.rows.where(~F.col("p").isin(*expressions.AXIOM_LISTS, V.FIRST, V.REST))
        general = F.col("p").isin(V.SUBCLASS, V.EQUIVALENT, V.DISJOINT)
        texts = lambda c: self.labels.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text"))
        held = lambda c: self._inner.select(F.col("expr").alias(c), F.col("names").alias(f"{c}_names"), F.col("exprs").alias(f"{c}_exprs"))
        mixed = rows.where(blank).where((F.col("s_kind") == "iri") | general).join(texts("s"), "s", "left").where("s_kind = 'iri' OR s_text IS NOT NULL").join(texts("o"), "o", "left").join(held("s"), "s", "left").join(held("o"), "o", "left")
        unnamed = mixed.where("o_kind = 'bnode' AND o_text IS NULL")
        if not unnamed.isEmpty():
            mixed = mixed.join(self.blanks.select(F.col("node").alias("o"), F.col("text").alias("other")), "o", "left").withColumn("o_text", F.coalesce("o_text", "other")).drop("other")
        none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
        plain = _once(rows.where("s_kind = 'iri' AND o_kind <> 'bnode'")).withColumns({"s_text": none, "o_text": none, "s_names": empty, "o_names": empty, "s_exprs": empty, "o_exprs": empty})
        noted = F.broadcast(self.notes.select("p").distinct())  # the predicates of annotated axioms

        def finished(rows: DataFrame) -> DataFrame:
            some = rows.join(noted, "p", "left_semi").join(self.notes, ["s", "p", "o"], "left")
            rows = rows.join(noted, "p", "left_anti").withColumn("notes", empty).unionByName(some.select(*rows.columns, "notes"))
            rows = rows.join(F.broadcast(objects), "p", "left").join(F.broadcast(data), "p", "left")
            other = F.when(F.col("is_object"), "ObjectPropertyAssertion").when(F.col("is_data"), "DataPropertyAssertion").otherwise("AnnotationAssertion")
            by_type = F.when(F.col("o").isin(*DECLARED), "Declaration").when(F.col("o").isin(*CHARACTERISTICS), case("o", CHARACTERISTICS, F.lit(None))).when(F.col("o") == V.ONTOLOGY, "Ontology").otherwise("ClassAssertion")
            kind = F.when(F.col("p") == V.TYPE, by_type).when(F.col("p").isin(V.IMPORTS, V.VERSION), "Ontology").otherwise(case("p", AXIOM_TYPES, other))
            rows = rows.withColumn("ax_type", kind).where("ax_type <> 'Ontology'")
            entity_object = (F.col("o_kind") == "iri") & ~F.col("ax_type").isin("Declaration", "AnnotationAssertion") & ~F.col("ax_type").isin(*CHARACTERISTICS.values())
            own = F.filter(F.array(F.when(F.col("s_kind") == "iri", F.col("s")), F.when(F.col("ax_type").endswith("Assertion") & (F.col("p") != V.TYPE), F.col("p")), F.when(entity_object, F.col("o"))), lambda x: x.isNotNull())
            nothing = F.array().cast("array<string>")
            sig = F.array_distinct(F.concat(own, F.coalesce("s_names", nothing), F.coalesce("o_names", nothing)))
            exprs = F.array_union(F.coalesce("s_exprs", nothing), F.coalesce("o_exprs", nothing))
            return rows.select(
                "ax_type", F.coalesce("s_text", "s").alias("subject"), F.col("s_kind").alias("subject_kind"), F.col("p").alias("property"), F.coalesce("o_text", "o").alias("object"), F.col("o_kind").alias("object_kind"),
                F.coalesce("o_dt", F.lit("")).alias("dt"), F.coalesce("o_lang", F.lit("")).alias("lang"), sig.alias("sig"), exprs.alias("exprs"), nothing.alias("operands"), F.coalesce("notes", nothing).alias("notes"),
            )

        core = F.concat_ws("\u0001", "ax_type", "subject", "property", "object", "object_kind", "dt", "lang")
        named = lambda df: df.withColumn("core_id", F.unhex(F.md5(core))).withColumn("ax_id", axiom_id())
        others = finished(mixed.select(plain.columns)).unionByName(self._operand_axioms()).unionByName(self._negative())
        return settle(named(finished(plain)).unionByName(named(others).dropDuplicates(["ax_id"])), "axioms")

    def unconsumed(self) -> DataFrame:
        """s, p, o: triples that no axiom, expression, list or annotation takes up: those of blank nodes that are none of these."""
        anonymous = self.rows.where("s_kind = 'bnode'")
        known = self.labels.select(F.col("node").alias("s"))
        cells = self.consumed_cells.select(F.col("cell").alias("s"))
        operands = self.lists.where(F.col("p").isin(expressions.AXIOM_LISTS)).select(F.col("owner").alias("s"))
        negative = self.with_p(V.TYPE).where(F.col("o") == V.NEGATIVE).select("s").join(self.with_p(V.NEG_SOURCE).select("s"), "s", "left_semi")
        notes = self.with_p(V.ANN_SOURCE).select("s").join(self.with_p(V.ANN_PROPERTY).select("s"), "s", "left_semi").join(self.with_p(V.ANN_TARGET).select("s"), "s", "left_semi")
        individuals = self.with_p(V.TYPE).where((F.col("s_kind") == "bnode") & ~F.col("o").startswith(V.OWL) & ~F.col("o").startswith(V.RDF)).select("s")
        used = known.unionByName(cells).unionByName(operands).unionByName(negative).unionByName(notes).unionByName(individuals).distinct()
        return anonymous.join(used, "s", "left_anti").select("s", "p", "o").distinct()


def _once(rows: DataFrame) -> DataFrame:
    """The distinct rows of triples. Hashes of all rows are shuffled, of the rows those alone that share one with another."""
    parts = [c for c in rows.columns if c not in ("o_dt", "o_lang")]
    hashed = rows.withColumn("h_", F.xxhash64(*parts, F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit(""))))
    repeated = settle(hashed.select("h_").repartition("h_").groupBy("h_").agg(F.count("*").alias("n")).where("n > 1").select("h_"), "repeated")
    if repeated.isEmpty():
        return rows
    some = hashed.join(repeated, "h_", "left_semi").drop("h_").withColumns({c: F.coalesce(c, F.lit("")) for c in ("o_dt", "o_lang")}).distinct()
    return hashed.join(repeated, "h_", "left_anti").drop("h_").unionByName(some.select(*rows.columns))


def axiom_id() -> Column:
    """16 bytes of an axiom with its annotations, from core_id and notes."""
    return F.unhex(F.md5(F.concat("core_id", F.array_join("notes", "\u0003").cast("binary"))))
