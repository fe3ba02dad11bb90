"""Merge, unmerge, diff, rename and annotate: ontologies as sets of triples or axioms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.model import Ontology, axiom_id
from axiograph.sources.shared import settle

TRIPLE = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang"]
#: Columns that may hold an IRI.
_TERMS = ["s", "p", "o"]


def canonical(triples: DataFrame) -> DataFrame:
    """Triples whose blank nodes are named by what is said of them, so that two loads of one ontology have the same triples.

    An expression is named by its canonical text, another blank node as in expressions.coloured(). Lists whose order doesn't count are laid out anew, sorted and
    without repeats, and their cells are named by owner and place.
    """
    ont = Ontology(triples.select(*TRIPLE))
    name = F.concat(F.lit("_:"), F.md5("text"))
    names = settle(ont.blanks.select("node", name.alias("name")).distinct(), "names")
    of = lambda rows, c, kind: rows.join(names.withColumnsRenamed({"node": c, "name": "name_"}), c, "left").withColumn(c, F.when(F.col(kind) == "bnode", F.coalesce("name_", c)).otherwise(F.col(c))).drop("name_")
    cells = ont.consumed_cells
    blank = (F.col("s_kind") == "bnode") | (F.col("o_kind") == "bnode")
    rows = ont.rows.where(blank).join(cells.select(F.col("cell").alias("s")), "s", "left_anti")
    held = ont.lists.join(cells, "cell", "left_semi")
    heads = held.select(F.col("owner").alias("s"), "p", F.col("head").alias("o")).distinct().withColumn("is_list", F.lit(True))
    rows = rows.join(heads, ["s", "p", "o"], "left").where("is_list IS NULL").drop("is_list")
    plain = of(of(rows, "s", "s_kind"), "o", "o_kind").select(*TRIPLE)
    owners = held.select("owner").distinct().join(ont.rows.select(F.col("s").alias("owner"), "s_kind").distinct(), "owner")
    items = ont.rows.where(F.col("p") == V.FIRST).select(F.col("s").alias("cell"), *[c for c in TRIPLE if c.startswith("o")])
    items = of(held.select("owner", "p", "cell", "at").join(items, "cell").join(owners, "owner").withColumnRenamed("s_kind", "owner_kind"), "o", "o_kind")
    items = of(items.withColumnRenamed("owner", "s"), "s", "owner_kind")
    member = F.struct(*[c for c in TRIPLE if c.startswith("o")])
    ordered = F.when(F.col("p") == V.CHAIN, F.transform(F.array_sort(F.collect_list(F.struct("at", member.alias("m")))), lambda x: x["m"])).otherwise(F.array_sort(F.collect_set(member)))
    lists = settle(items.groupBy("s", "owner_kind", "p").agg(ordered.alias("all")), "lists")
    each = lists.select("s", "owner_kind", "p", F.size("all").alias("n"), F.posexplode("all").alias("i", "m"))
    cell = lambda i: F.concat(F.lit("_:"), F.md5(F.concat_ws("\u0001", "s", "p", i)))
    none = F.lit(None).cast("string")
    row = lambda s, kind, p, o, o_kind: [s.alias("s"), kind.alias("s_kind"), p.alias("p"), o.alias("o"), o_kind.alias("o_kind"), none.alias("o_dt"), none.alias("o_lang")]
    first = each.select(cell(F.col("i")).alias("s"), F.lit("bnode").alias("s_kind"), F.lit(V.FIRST).alias("p"), F.col("m.o").alias("o"), F.col("m.o_kind").alias("o_kind"), F.col("m.o_dt").alias("o_dt"), F.col("m.o_lang").alias("o_lang"))
    last = F.col("i") + 1 == F.col("n")
    rest = each.select(*row(cell(F.col("i")), F.lit("bnode"), F.lit(V.REST), F.when(last, V.NIL).otherwise(cell(F.col("i") + 1)), F.when(last, "iri").otherwise("bnode")))
    opening = each.where("i = 0").select(*row(F.col("s"), F.col("owner_kind"), F.col("p"), cell(F.col("i")), F.lit("bnode")))
    grounded = ont.rows.where(~blank & ~((F.col("p") == V.REST) | (F.col("p") == V.FIRST)))
    return reduce(DataFrame.unionByName, [grounded, plain, first, rest, opening]).distinct()


def _apart(parts: tuple[DataFrame, ...], shared: bool) -> list[DataFrame]:
    return [p.select(*TRIPLE) if shared or p.where("s_kind = 'bnode' OR o_kind = 'bnode'").isEmpty() else canonical(p) for p in parts]


def merge(*parts: DataFrame, shared: bool = False) -> DataFrame:
    """The union of triples as a set. The blank nodes of each part are its own, and what is said alike of them is kept once; shared: the
    parts are of one load, and a name means the same blank node in all of them."""
    return reduce(DataFrame.unionByName, _apart(parts, shared or len(parts) == 1)).distinct()


def generated(s: Column, p: str, o: Column, frame: DataFrame, kind: str = "iri", dt: str | None = None) -> DataFrame:
    return frame.select(s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang")).distinct()


def defined_by(ont: Ontology, ontology_iri: str) -> DataFrame:
    """rdfs:isDefinedBy triples for every declared entity."""
    return generated(F.col("iri"), V.DEFINED_BY, F.lit(ontology_iri), ont.declared)


def derived_from(axioms: DataFrame, ontology_iri: str) -> DataFrame:
    """Axioms with prov:wasDerivedFrom added to their notes; ids change with the notes."""
    noted = axioms.withColumn("notes", F.array_sort(F.array_union("notes", F.array(F.lit(f"{V.PROV}wasDerivedFrom={ontology_iri}")))))
    return noted.withColumn("ax_id", axiom_id())


def unmerge(left: DataFrame, *others: DataFrame, shared: bool = False) -> DataFrame:
    """Triples of left that none of the others has; nulls are alike. shared: as in merge()."""
    own, *rest = _apart((left, *others), shared)
    return own.distinct().exceptAll(reduce(DataFrame.unionByName, rest).distinct()) if rest else own.distinct()


def diff(left: DataFrame, right: DataFrame, shared: bool = False) -> DataFrame:
    """side ("left" or "right") and the triples that only that side has: one aggregate over both, no join. shared: as in merge()."""
    a, b = _apart((left, right), shared)
    both = a.distinct().withColumn("side", F.lit("left")).unionByName(b.distinct().withColumn("side", F.lit("right")))
    return both.groupBy(*TRIPLE).agg(F.count("*").alias("n"), F.min("side").alias("side")).where("n = 1").drop("n")


def equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether both say the same; names of blank nodes don't count."""
    return diff(left, right).isEmpty()


def merged_axioms(*onts: Ontology) -> DataFrame:
    """The axioms of all ontologies as a set; like axioms of different loads are one."""
    return reduce(DataFrame.unionByName, [o.axioms for o in onts]).dropDuplicates(["ax_id"])


def unmerged_axioms(left: Ontology, *others: Ontology) -> DataFrame:
    """Axioms of left that none of the others has."""
    return left.axioms.join(merged_axioms(*others).select("ax_id"), "ax_id", "left_anti") if others else left.axioms


def axiom_diff(left: Ontology, right: Ontology) -> DataFrame:
    """side and the axioms, annotations included, that only that side has: hashes of 16 bytes are compared, and texts are read for what differs only."""
    ids = left.axioms.select("ax_id", F.lit("left").alias("side")).unionByName(right.axioms.select("ax_id", F.lit("right").alias("side")))
    only = settle(ids.groupBy("ax_id").agg(F.count("*").alias("n"), F.min("side").alias("side")).where("n = 1").drop("n"), "diff")
    of = lambda ont, side: ont.axioms.join(only.where(F.col("side") == side), "ax_id")
    return of(left, "left").unionByName(of(right, "right"))


def same_axioms(left: Ontology, right: Ontology) -> bool:
    return axiom_diff(left, right).isEmpty()


def labelled(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """rows with <iri>[label] in the columns, where names (iri, label) has a label."""
    for c in columns:
        rows = rows.join(names.select(F.col("iri").alias(c), F.col("label").alias("label_")), c, "left")
        rows = rows.withColumn(c, F.when(F.col("label_").isNotNull(), F.concat(F.lit("<"), F.col(c), F.lit(">["), F.col("label_"), F.lit("]"))).otherwise(F.col(c))).drop("label_")
    return rows


def check_mapping(mapping: DataFrame, allow_duplicates: bool = False) -> None:
    """mapping (old, new) must name every old IRI once, and every new one once unless duplicates are allowed."""
    if not mapping.groupBy("old").count().where("count > 1").isEmpty():
        raise ValueError("an IRI is renamed twice")
    if not allow_duplicates and not mapping.groupBy("new").count().where("count > 1").isEmpty():
        raise ValueError("two IRIs get the same name")


def rename(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """Triples with the IRIs of mapping (old, new) renamed wherever they stand."""
    out = triples.select(*TRIPLE)
    for c in _TERMS:
        named = mapping.select(F.col("old").alias(c), F.col("new").alias("new_"))
        kind = F.lit("iri") if c == "p" else F.col(f"{c}_kind")
        out = out.join(named, c, "left").withColumn(c, F.when(kind == "iri", F.coalesce("new_", c)).otherwise(F.col(c))).drop("new_")
    return out.select(*TRIPLE).distinct()


def rename_prefixes(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Triples with old namespaces replaced at the start of IRIs; the longest that fits counts."""
    out = triples.select(*TRIPLE)
    for c in _TERMS:
        new = F.when(F.lit(False), F.col(c))
        for old, namespace in sorted(prefixes.items(), key=lambda x: -len(x[0])):
            new = new.when(F.col(c).startswith(old), F.concat(F.lit(namespace), F.substr(F.col(c), F.lit(len(old) + 1))))
        kind = F.lit("iri") if c == "p" else F.col(f"{c}_kind")
        out = out.withColumn(c, F.when(kind == "iri", new.otherwise(F.col(c))).otherwise(F.col(c)))
    return out.distinct()


def annotate(ont: Ontology, ontology_iri: str, literals: dict[str, str] | None = None, links: dict[str, str] | None = None, drop: bool = False) -> DataFrame:
    """Triples with annotations of the ontology added; drop: those it has go first, its structure stays."""
    rows = ont.rows.distinct()
    if drop:
        rows = rows.where(~((F.col("s") == ontology_iri) & ~F.col("p").isin(V.TYPE, V.IMPORTS, V.VERSION)))
    new = [(ontology_iri, "iri", p, v, "lit", V.XSD_STRING, None) for p, v in (literals or {}).items()] + [(ontology_iri, "iri", p, v, "iri", None, None) for p, v in (links or {}).items()]
    return merge(rows, ont.spark.createDataFrame(new, ", ".join(f"{c} string" for c in TRIPLE)), shared=True) if new else rows


def copied(ont: Ontology, entities: DataFrame, annotations: list[str] | None = None) -> DataFrame:
    """Declarations of the entities (column node) and their annotations: all, or those with the listed properties."""
    own = ont.rows.distinct().join(entities.select(F.col("node").alias("s")), "s", "left_semi")
    declared = own.where((F.col("p") == V.TYPE) & F.col("o").isin(*V.KINDS.values()))
    values = own.where(F.col("o_kind") == "lit")
    return declared.unionByName(values if annotations is None else values.where(F.col("p").isin(list(annotations)))).select(*TRIPLE)
