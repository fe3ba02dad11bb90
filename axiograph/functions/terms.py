"""IRIs, CURIEs, labels and literals: plain functions for names in arguments, Column functions for tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V

CURIE = r"^[A-Za-z_][A-Za-z0-9_.-]*:[^\s]+$"
_ABSOLUTE = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$")
_URN = re.compile(r"^urn:[a-zA-Z0-9][a-zA-Z0-9-]{0,31}:\S+$")


def expand(name: str, prefixes: dict[str, str] | None = None) -> str:
    """IRI of <iri>, an absolute IRI or a CURIE; ValueError if it is neither."""
    prefixes = V.PREFIXES if prefixes is None else prefixes
    if name.startswith("<") and name.endswith(">"):
        return name[1:-1]
    prefix, colon, rest = name.partition(":")
    if colon and prefix in prefixes:
        return prefixes[prefix] + rest
    if _ABSOLUTE.match(name) or _URN.match(name):
        return name
    raise ValueError(f"not an IRI or a CURIE of a known prefix: {name}")


def to_iri(name: str, prefixes: dict[str, str]) -> Column:
    """IRI of the CURIE or absolute IRI in the column of that name; null where it is malformed or the prefix unknown."""
    c = F.col(name)
    out = F.when(c.rlike(_ABSOLUTE.pattern) | c.rlike(_URN.pattern), c)
    for prefix, namespace in prefixes.items():
        out = out.when(c.startswith(f"{prefix}:") & c.rlike(CURIE), F.concat(F.lit(namespace), F.substr(c, F.lit(len(prefix) + 2))))
    return out


def to_curie(name: str, prefixes: dict[str, str]) -> Column:
    """CURIE of an IRI by its longest known namespace; the IRI itself where there is none."""
    c = F.col(name)
    out = F.when(F.lit(False), c)
    for prefix, namespace in sorted(prefixes.items(), key=lambda x: -len(x[1])):
        out = out.when(c.startswith(namespace), F.concat(F.lit(f"{prefix}:"), F.substr(c, F.lit(len(namespace) + 1))))
    return out.otherwise(c)


def is_curie(name: str) -> Column:
    return F.col(name).rlike(CURIE)


def cell_name(column: int, row: int) -> str:
    """A1 notation; both count from 1."""
    letters = ""
    while column > 0:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def labels(rows: DataFrame) -> DataFrame:
    """iri, label: one label for each named subject, that without a language first, then by text."""
    own = rows.where((F.col("p") == V.LABEL) & (F.col("s_kind") == "iri"))
    return own.groupBy(F.col("s").alias("iri")).agg(F.min(F.struct(F.coalesce("o_lang", F.lit("")).alias("lang"), F.col("o").alias("label"))).alias("x")).select("iri", F.col("x.label").alias("label"))


def label_to_iri(rows: DataFrame) -> DataFrame:
    """label, iri: for each label the last IRI by code point that has it, and how many have it."""
    own = rows.where((F.col("p") == V.LABEL) & (F.col("s_kind") == "iri"))
    return own.groupBy(F.col("o").alias("label")).agg(F.max("s").alias("iri"), F.countDistinct("s").alias("n_iris"))


def interpolated(name: str, ontology_iri: str, version_iri: str) -> Column:
    """The column with %{ontology_iri} and %{version_iri} filled in."""
    return F.replace(F.replace(F.col(name), F.lit("%{ontology_iri}"), F.lit(ontology_iri)), F.lit("%{version_iri}"), F.lit(version_iri))


def short_form(name: str, form: str, prefixes: dict[str, str], label: str = "label") -> Column:
    """An entity's name as "IRI", "ID" (CURIE), "LABEL" (label or nothing) or "NAME" (label, quoted if it has a space, or CURIE)."""
    quoted = F.when(F.col(label).contains(" "), F.concat(F.lit("'"), F.col(label), F.lit("'"))).otherwise(F.col(label))
    return {"IRI": F.col(name), "ID": to_curie(name, prefixes), "LABEL": F.col(label), "NAME": F.coalesce(quoted, to_curie(name, prefixes))}[form]
