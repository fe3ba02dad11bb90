"""Export: entities by columns, with multi-valued cells."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import terms
from axiograph.functions import vocab as V
from axiograph.model import Ontology

_SYNONYMS = [V.EDITOR_SYNONYM, V.EXACT, V.BROAD, V.RELATED, V.NARROW]
#: header -> predicate that it lists
_RELATIONS = {"SubClass Of": V.SUBCLASS, "SubProperty Of": V.SUBPROPERTY, "Equivalent Class": V.EQUIVALENT, "Equivalent Property": V.EQUIVALENT_PROPERTY, "Disjoint With": V.DISJOINT, "Type": V.TYPE, "Domain": V.DOMAIN, "Range": V.RANGE}
_BUILTIN = [V.THING, V.NOTHING, V.OWL + "topObjectProperty", V.OWL + "bottomObjectProperty", V.OWL + "topDataProperty", V.OWL + "bottomDataProperty"]
_INCLUDE = {"classes": ["class"], "properties": ["object-property", "data-property", "annotation-property"], "individuals": ["individual"]}


@dataclass
class Header:
    """A column: name, how entities in it are shown, and which are: NAMED, ANON or ANY."""

    text: str
    name: str
    form: str = "NAME"
    which: str = "ANY"

    @classmethod
    def of(cls, text: str, form: str = "NAME", which: str = "ANY") -> Header:
        """Of "SubClass Of [ID NAMED]"; tags override what holds for the whole table."""
        m = re.fullmatch(r"(.*?)\s*\[(.*)\]", text)
        head = cls(text, m[1] if m else text, form, which)
        for tag in m[2].split() if m else ():
            if tag in ("NAMED", "ANON", "ANY"):
                head.which = tag
            elif tag in ("NAME", "LABEL", "ID", "IRI"):
                head.form = tag
            else:
                raise ValueError(f"unknown tag {tag}")
        return head


def _listed(rows: DataFrame) -> DataFrame:
    """iri, cell: the distinct values of each entity, sorted."""
    return rows.groupBy("iri").agg(F.array_sort(F.collect_set("value")).alias("cell"))


def _column(ont: Ontology, head: Header, names: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    if head.name in ("SYNONYMS", "SUBCLASSES"):
        rows = ont.with_p(*_SYNONYMS).select(F.col("s").alias("iri"), F.col("o").alias("value")) if head.name == "SYNONYMS" else None
        if rows is not None:
            return _listed(rows)
        rows = ont.with_p(V.SUBCLASS).select(F.col("o").alias("iri"), F.col("s").alias("o"), F.col("s_kind").alias("o_kind"))
    elif head.name in _RELATIONS:
        rows = ont.with_p(_RELATIONS[head.name]).select(F.col("s").alias("iri"), "o", "o_kind")
        if head.name == "Type":
            rows = rows.where(~F.col("o").isin(*V.KINDS.values()))
    else:
        return _property_column(ont, head, names, prefixes)
    return _listed(_shown(ont, rows, head, names, prefixes))


def _shown(ont: Ontology, rows: DataFrame, head: Header, names: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    if head.which != "ANY":
        rows = rows.where(F.col("o_kind") == ("iri" if head.which == "NAMED" else "bnode"))
    texts = ont.expressions.select(F.col("expr").alias("o"), F.col("label").alias("text")).distinct()
    rows = rows.join(names.select(F.col("iri").alias("o"), "label"), "o", "left").join(texts, "o", "left")
    return rows.select("iri", F.when(F.col("o_kind") == "iri", terms.short_form("o", head.form, prefixes)).otherwise(F.coalesce("text", "o")).alias("value")).where("value IS NOT NULL")


def _property_column(ont: Ontology, head: Header, names: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Values of a property by CURIE, IRI or label: literals as they are, entities as the column shows them; and for
    classes the fillers of restrictions on it in anonymous super and equivalent classes."""
    iri = terms.expand(head.name, prefixes) if ":" in head.name else None
    rows = ont.rows.distinct()
    own = rows.where(F.col("p") == iri) if iri else rows.join(names.where(F.col("label") == head.name).select(F.col("iri").alias("p")), "p", "left_semi")
    literals = own.where("o_kind = 'lit'").select(F.col("s").alias("iri"), F.col("o").alias("value"))
    entities = own.where("o_kind <> 'lit'").select(F.col("s").alias("iri"), "o", "o_kind")
    some = ont.expressions.where("op IN ('some', 'all')")
    some = some.where(F.col("prop") == iri) if iri else some.join(names.where(F.col("label") == head.name).select(F.col("iri").alias("prop")), "prop", "left_semi")
    fillers = ont.with_p(V.SUBCLASS, V.EQUIVALENT).where("o_kind = 'bnode'").select(F.col("s").alias("iri"), F.col("o").alias("expr")).join(some.select("expr", F.col("filler").alias("o")), "expr").select("iri", "o", F.lit("iri").alias("o_kind"))
    return _listed(literals.unionByName(_shown(ont, entities.unionByName(fillers), head, names, prefixes)))


def export(ont: Ontology, columns: list[str], include: list[str] = ("classes", "individuals"), form: str = "NAME", which: str = "ANY", prefixes: dict[str, str] | None = None) -> DataFrame:
    """A row for each entity, an array<string> for each column (single names: a string)."""
    prefixes = prefixes or V.PREFIXES
    if len(set(columns)) < len(columns):
        raise ValueError("a column is named twice")
    kinds = [k for i in include for k in _INCLUDE[i]]
    entities = ont.declared.where(F.col("kind").isin(kinds) & ~F.col("iri").isin(*_BUILTIN))
    names = terms.labels(ont.rows)
    out = entities.select("iri", "kind").join(names, "iri", "left")
    for i, head in enumerate(Header.of(c, form, which) for c in columns):
        if head.name in ("IRI", "ID", "CURIE", "LABEL"):
            out = out.withColumn(f"c{i}", terms.short_form("iri", {"CURIE": "ID"}.get(head.name, head.name), prefixes))
        elif head.name == "Entity Type":
            out = out.withColumn(f"c{i}", F.col("kind"))
        else:
            out = out.join(_column(ont, head, names, prefixes).withColumnRenamed("cell", f"c{i}"), "iri", "left")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def joined_cell(cell: Column, split: str = "|") -> Column:
    """One text of a multi-valued cell; the split character is escaped in the values only if there are several."""
    escaped = F.transform(cell, lambda x: F.replace(x, F.lit(split), F.lit("\\" + split)))
    return F.when(F.size(cell) > 1, F.array_join(escaped, split)).otherwise(F.coalesce(cell[0], F.lit("")))


def flat(table: DataFrame, split: str = "|") -> DataFrame:
    """All cells as texts, missing ones empty."""
    return table.select(*[joined_cell(F.col(f"`{c}`"), split).alias(c) if kind.startswith("array") else F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c, kind in table.dtypes])


def json_rows(table: DataFrame) -> DataFrame:
    """value: a JSON object for each entity: arrays, but IRI, ID and CURIE as single texts; missing cells are empty."""
    single = ("IRI", "ID", "CURIE")
    cell = lambda c, kind: F.coalesce(F.col(f"`{c}`"), F.array().cast(kind)) if kind.startswith("array") else F.coalesce(F.col(f"`{c}`"), F.lit("")) if c in single else F.array_compact(F.array(F.col(f"`{c}`")))
    return table.select(F.to_json(F.struct(*[cell(c, kind).alias(c) for c, kind in table.dtypes])).alias("value"))


def sorted_table(table: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in order: the last key counts most, as sorting by one key after the other gives it; ^key: descending.
    Blanks come last, in a descending order first."""
    order = []
    for key in reversed(keys):
        c = F.col(f"`{key.lstrip('^')}`")
        blank = F.when(c == "", 1).otherwise(0)
        order += [blank.desc(), c.desc()] if key.startswith("^") else [blank, c]
    return table.orderBy(*order)
