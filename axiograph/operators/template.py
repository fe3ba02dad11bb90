"""Templates: tables with a header and a row of template strings become triples."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import terms
from axiograph.functions import vocab as V
from axiograph.operators.setops import TRIPLE, merge

#: Kinds of rows, by the text in a TYPE column.
KINDS = {"class": V.CLASS, "object property": V.OBJECT_PROPERTY, "data property": V.DATA_PROPERTY, "annotation property": V.ANNOTATION_PROPERTY, "datatype": V.DATATYPE, "individual": V.INDIVIDUAL, "named individual": V.INDIVIDUAL}
#: Template strings for the relations of an entity to others.
RELATIONS = {"SC": V.SUBCLASS, "EC": V.EQUIVALENT, "DC": V.DISJOINT, "C": V.SUBCLASS, "SP": V.SUBPROPERTY, "EP": V.EQUIVALENT_PROPERTY, "IP": V.INVERSE, "DOMAIN": V.DOMAIN, "RANGE": V.RANGE, "SI": V.SAME_AS, "DI": V.DIFFERENT, "TI": V.TYPE}


@dataclass
class Cell:
    """What a column's template string says."""

    column: str
    role: str
    target: str = ""
    split: str = ""
    datatype: str = ""
    lang: str = ""
    depth: int = 0
    problems: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, column: str, text: str) -> Cell:
        body, _, split = text.partition(" SPLIT=")
        depth = len(body) - len(body.lstrip(">"))
        role, _, rest = body.lstrip(">").strip().partition(" ")
        out = cls(column, role, rest.strip(), split, depth=depth)
        if role == "AT":
            out.target, _, out.datatype = out.target.partition("^^")
        elif role == "A" and "@" in out.target:
            out.target, _, out.lang = out.target.rpartition("@")
        elif role == "AL":
            out.target, _, out.lang = out.target.rpartition("@")
        if role not in {"", "ID", "LABEL", "TYPE", "A", "AT", "AL", "AI", "I", "CHARACTERISTIC", *RELATIONS}:
            out.problems.append(f"unknown template string {text!r}")
        if depth > 2:
            out.problems.append("annotations nest at most twice")
        return out


def plan(header: list[str], strings: list[str]) -> list[Cell]:
    if len(set(header)) < len(header):
        raise ValueError("a column is named twice")
    cells = [Cell.of(c, s or "") for c, s in zip(header, strings, strict=True)]
    if not any(c.role in ("ID", "LABEL") for c in cells):
        raise ValueError("a template needs an ID or a LABEL column")
    return cells


def _values(rows: DataFrame, cell: Cell) -> DataFrame:
    """rows with value: the cell's text, one row for each part where it is split; empty ones are left out."""
    c = F.col(f"`{cell.column}`")
    value = F.explode(F.split(c, "\\Q" + cell.split + "\\E")) if cell.split else c
    return rows.withColumn("value", value).withColumn("value", F.trim("value")).where("value <> ''")


def resolve(rows: DataFrame, names: DataFrame, column: str, prefixes: dict[str, str]) -> DataFrame:
    """rows with iri: of a CURIE, an IRI or a label (quotes around it are left out) in the column; null where there is none."""
    plain = F.regexp_replace(F.col(column), "^'(.*)'$", "$1")
    known = names.groupBy("label").agg(F.max("iri").alias("by_label")).select(F.col("label").alias("name_"), "by_label")
    out = rows.withColumn("name_", plain).join(known, "name_", "left").withColumn("direct_", terms.to_iri(column, prefixes))
    return out.withColumn("iri", F.coalesce("direct_", "by_label")).drop("name_", "by_label", "direct_")


def _triple(rows: DataFrame, s: Column, p: Column, o: Column, kind: str = "iri", dt: str | None = None, lang: str | None = None) -> DataFrame:
    return rows.select(s.alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), F.lit(lang).cast("string").alias("o_lang"))


def template(table: DataFrame, strings: list[str], names: DataFrame | None = None, prefixes: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(triples, errors) of a table whose columns have the template strings.

    Rows without an ID and a label are skipped. ID: CURIE or IRI; without one the label names a known entity.
    names: iri, label of known entities; the table's own rows are known besides. "% some-expression" strings take named
    classes and "PROP some %": a restriction on PROP. SPLIT=x splits cells. Values of a ">A" column annotate the axiom of the
    column to its left. errors: column, value, message for values that name nothing; their rows' other values count.
    """
    prefixes = prefixes or V.PREFIXES
    cells = plan(table.columns, strings)
    bad = [(c.column, "", m) for c in cells for m in c.problems]
    role = {c.role: c for c in reversed(cells)}
    ident = F.col(f"`{role['ID'].column}`") if "ID" in role else F.lit(None).cast("string")
    label = F.col(f"`{role['LABEL'].column}`") if "LABEL" in role else F.coalesce(*[F.col(f"`{c.column}`") for c in cells if c.role == "A" and c.target in ("rdfs:label", "LABEL")], F.lit(None).cast("string"))
    rows = table.withColumn("id_", F.coalesce(F.when(F.trim(ident) != "", F.trim(ident)), F.when(F.trim(label) != "", F.trim(label)))).where("id_ IS NOT NULL")
    own = rows.select(terms.to_iri("id_", prefixes).alias("iri"), F.trim(label).alias("label")).where("iri IS NOT NULL AND label IS NOT NULL")
    known = own if names is None else own.unionByName(names.select("iri", "label"))
    rows = resolve(rows, known, "id_", prefixes).withColumnRenamed("iri", "subject_")
    errors = [rows.where("subject_ IS NULL").select(F.lit(role["ID"].column if "ID" in role else role["LABEL"].column).alias("column"), F.col("id_").alias("value"), F.lit("the row's entity can't be named").alias("message"))]
    rows = rows.where("subject_ IS NOT NULL")
    s = F.col("subject_")

    kind = F.lower(F.trim(F.regexp_replace(F.col(f"`{role['TYPE'].column}`"), "^owl:", ""))) if "TYPE" in role else F.lit("class")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    declared = F.coalesce(F.try_element_at(kinds, F.coalesce(kind, F.lit("class"))), F.lit(V.CLASS if "TYPE" not in role else V.INDIVIDUAL))
    out = [_triple(rows, s, F.lit(V.TYPE), declared)]
    if "LABEL" in role:
        out.append(_triple(_values(rows, role["LABEL"]), s, F.lit(V.LABEL), F.col("value"), "lit", V.XSD_STRING))
    if "TYPE" in role:
        typed = resolve(_values(rows, role["TYPE"]).where(~F.lower(F.regexp_replace("value", "^owl:", "")).isin(*KINDS)), known, "value", prefixes)
        out.append(_triple(typed.where("iri IS NOT NULL"), s, F.lit(V.TYPE), F.col("iri")))
        errors.append(_unknown(typed, role["TYPE"]))
    last: tuple[str, Column] | None = None
    for i, cell in enumerate(cells):
        if cell.role in ("", "ID", "LABEL", "TYPE") or cell.problems:
            continue
        found = _values(rows, cell)
        if cell.depth:
            if last:
                out += _annotations(found, s, last, cell, i, prefixes)
            continue
        if cell.role in ("A", "AT", "AL"):
            p = V.LABEL if cell.target == "LABEL" else terms.expand(cell.target, prefixes)
            dt = V.LANG_STRING if cell.lang else terms.expand(cell.datatype, prefixes) if cell.datatype else V.XSD_STRING
            out.append(_triple(found, s, F.lit(p), F.col("value"), "lit", dt, cell.lang or None))
            last = (p, F.col(f"`{cell.column}`"))
            continue
        if cell.role == "CHARACTERISTIC":
            name = F.concat(F.lit(V.OWL), F.replace(F.initcap("value"), F.lit(" "), F.lit("")), F.lit("Property"))
            out.append(_triple(found, s, F.lit(V.TYPE), name))
            continue
        found = resolve(found, known, "value", prefixes)
        errors.append(_unknown(found, cell))
        found = found.where("iri IS NOT NULL")
        if cell.role in ("AI", "I"):
            p = terms.expand(cell.target, prefixes)
            out.append(_triple(found, s, F.lit(p), F.col("iri")))
            last = (p, F.col(f"`{cell.column}`"))
        elif " some " in f" {cell.target} ":
            prop = cell.target.split()[0]
            target = known.where(F.col("label") == prop).select(F.max("iri").alias("prop_")) if ":" not in prop else None
            found = found.crossJoin(F.broadcast(target)) if target is not None else found.withColumn("prop_", F.lit(terms.expand(prop, prefixes)))
            out += _restriction(found.where("prop_ IS NOT NULL"), s, RELATIONS[cell.role])
        else:
            out.append(_triple(found, s, F.lit(RELATIONS[cell.role]), F.col("iri")))
            last = (RELATIONS[cell.role], F.col("iri"))
    fixed = rows.sparkSession.createDataFrame(bad, "column string, value string, message string")
    return merge(*out, shared=True), reduce(DataFrame.unionByName, [*errors, fixed]).distinct()


def _unknown(found: DataFrame, cell: Cell) -> DataFrame:
    return found.where("iri IS NULL").select(F.lit(cell.column).alias("column"), "value", F.lit("names no entity").alias("message"))


def _restriction(rows: DataFrame, s: Column, p: str) -> list[DataFrame]:
    """subject p [some prop filler], the blank node named by a hash of what it says."""
    blank = F.concat(F.lit("_:r"), F.substring(F.sha2(F.concat_ws(" ", F.col("prop_"), F.col("iri")), 256), 1, 16))
    rows = rows.withColumn("blank_", blank)
    about = lambda q, o: _triple(rows, F.col("blank_"), F.lit(q), o).withColumn("s_kind", F.lit("bnode"))
    return [_triple(rows, s, F.lit(p), F.col("blank_"), "bnode"), about(V.TYPE, F.lit(V.RESTRICTION)), about(V.ON_PROPERTY, F.col("prop_")), about(V.SOME, F.col("iri"))]


def _annotations(found: DataFrame, s: Column, last: tuple[str, Column], cell: Cell, i: int, prefixes: dict[str, str]) -> list[DataFrame]:
    p, target = last
    rows = found.withColumn("target_", F.trim(target)) if "iri" not in str(target) else found
    if "target_" not in rows.columns:
        return []
    rows = rows.where("target_ <> ''").withColumn("axiom_", F.concat(F.lit(f"_:x{i}-"), F.substring(F.sha2(F.concat_ws("\u0001", s, F.lit(p), "target_", "value"), 256), 1, 16)))
    about = lambda q, o, kind="iri", dt=None: _triple(rows, F.col("axiom_"), F.lit(q), o, kind, dt).withColumn("s_kind", F.lit("bnode"))
    return [about(V.TYPE, F.lit(V.AXIOM)), about(V.ANN_SOURCE, s), about(V.ANN_PROPERTY, F.lit(p)), about(V.ANN_TARGET, F.col("target_"), "lit", V.XSD_STRING), about(terms.expand(cell.target, prefixes), F.col("value"), "lit", V.XSD_STRING)]


def chain(tables: list[tuple[DataFrame, list[str]]], names: DataFrame | None = None, prefixes: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Several tables, the names of each known to the next; (triples, errors) of all."""
    triples, errors = [], []
    for table, strings in tables:
        made, wrong = template(table, strings, names, prefixes)
        triples.append(made)
        errors.append(wrong)
        fresh = terms.labels(made)
        names = fresh if names is None else names.select("iri", "label").unionByName(fresh)
    return merge(*triples, shared=True), reduce(DataFrame.unionByName, errors)


__all__ = ["TRIPLE", "chain", "plan", "resolve", "template"]
