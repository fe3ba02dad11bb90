"""Graph patterns as DataFrames: what SPARQL's algebra does, said with joins, semi and anti joins and unions.

A term is one text: <iri>, _:blank, "text", "text"@lang or "text"^^<datatype> (plain text is xsd:string), so terms are the same if
their texts are. A solution table has a column for each variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.functions.terms import expand


def term(value: str, kind: str, dt: str, lang: str) -> Column:
    v, k = F.col(value), F.col(kind)
    tail = F.when(F.coalesce(F.col(lang), F.lit("")) != "", F.concat(F.lit('"@'), F.lower(lang))).when(F.coalesce(F.col(dt), F.lit(V.XSD_STRING)) == V.XSD_STRING, F.lit('"')).otherwise(F.concat(F.lit('"^^<'), F.col(dt), F.lit(">")))
    return F.when(k == "iri", F.concat(F.lit("<"), v, F.lit(">"))).when(k == "bnode", v).otherwise(F.concat(F.lit('"'), v, tail))


def constant(text: str) -> str:
    """The term of <iri>, a CURIE, 'text', or a term's own text."""
    if text.startswith(('"', "_:")):
        return text
    if text.startswith("'"):
        return f'"{text[1:-1]}"'
    return f"<{expand(text)}>"


def is_blank(var: str) -> Column:
    return F.col(var).startswith("_:")


def is_iri(var: str) -> Column:
    return F.col(var).startswith("<")


def is_literal(var: str) -> Column:
    return F.col(var).startswith('"')


def lexical(var: str) -> Column:
    """str(): an IRI's or a literal's text; null for a blank node."""
    c = F.col(var)
    return F.when(c.startswith("<"), F.substr(c, F.lit(2), F.length(c) - 2)).when(c.startswith('"'), F.regexp_extract(c, r'(?s)^"(.*)"', 1))


def datatype(var: str) -> Column:
    """The datatype's IRI; null where there is no literal."""
    c = F.col(var)
    tail = F.regexp_extract(c, r'(?s)^".*"\^\^<([^<>]*)>$', 1)
    return F.when(c.startswith('"'), F.when(c.rlike(r'(?s)^".*"@[A-Za-z0-9-]+$'), V.LANG_STRING).when(tail != "", tail).otherwise(V.XSD_STRING))


def language(var: str) -> Column:
    return F.when(F.col(var).startswith('"'), F.regexp_extract(var, r'(?s)^".*"@([A-Za-z0-9-]+)$', 1))


def text_of(var: str) -> Column:
    """The text of a plain or language-tagged literal, null for other terms: conditions on it then drop the row, as an error would."""
    return F.when(datatype(var).isin(V.XSD_STRING, V.LANG_STRING), lexical(var))


class Graph:
    """Triples to match: those of the named graph, or the union of all as a set."""

    def __init__(self, triples: DataFrame, name: str | None = None):
        self.rows = triples.where(F.col("graph") == name) if name else triples

    def match(self, *patterns: tuple[str, str, str]) -> Solutions:
        """Solutions of patterns (s, p, o), joined on the variables they share; "?x" is a variable. Patterns with most
        constants come first, then ones that share a variable with what is joined."""
        todo = sorted(patterns, key=lambda t: sum(x.startswith("?") for x in t))
        out = Solutions(self._one(todo.pop(0)))
        while todo:
            known = set(out.frame.columns)
            best = next((t for t in todo if known & {x[1:] for x in t if x.startswith("?")}), todo[0])
            todo.remove(best)
            out = out.join(Solutions(self._one(best)))
        return out

    def _one(self, pattern: tuple[str, str, str]) -> DataFrame:
        rows = self.rows
        s, p, o = pattern
        if not p.startswith("?"):
            rows = rows.where(F.col("p") == constant(p)[1:-1])  # pruned by the store
        if not s.startswith("?"):
            value = constant(s)
            rows = rows.where(F.col("s") == (value[1:-1] if value.startswith("<") else value))
        object_term = term("o", "o_kind", "o_dt", "o_lang")
        if not o.startswith("?"):
            rows = rows.where(object_term == constant(o))
        columns: dict[str, Column] = {}
        same = []
        for x, c in ((s, F.when(F.col("s_kind") == "iri", F.concat(F.lit("<"), F.col("s"), F.lit(">"))).otherwise(F.col("s"))), (p, F.concat(F.lit("<"), F.col("p"), F.lit(">"))), (o, object_term)):
            if x.startswith("?"):
                if x[1:] in columns:
                    same.append(columns[x[1:]] == c)
                columns.setdefault(x[1:], c)
        for condition in same:
            rows = rows.where(condition)
        return rows.select(*[c.alias(n) for n, c in columns.items()] or [F.lit(1).alias("matched_")]).distinct()

    def reachable(self, subject: str, p: str, obj: str, zero: bool = False) -> Solutions:
        """Pairs that a path of one step or more of p joins (zero: or none), cycle-safe."""
        from axiograph.operators.graph import closure

        steps = self._one(("?child", p, "?parent"))
        pairs = closure(steps)
        if zero:
            nodes = steps.select("child").unionByName(steps.select(F.col("parent").alias("child"))).distinct()
            pairs = pairs.unionByName(nodes.select("child", F.col("child").alias("parent"))).distinct()
        return Solutions(pairs.select(F.col("child").alias(subject[1:]), F.col("parent").alias(obj[1:])))


class Solutions:
    def __init__(self, frame: DataFrame):
        self.frame = frame

    def _on(self, other: Solutions) -> list[str]:
        return [c for c in self.frame.columns if c in other.frame.columns]

    def join(self, other: Solutions) -> Solutions:
        on = self._on(other)
        return Solutions(self.frame.join(other.frame, on) if on else self.frame.crossJoin(other.frame))

    def optional(self, other: Solutions) -> Solutions:
        return Solutions(self.frame.join(other.frame, self._on(other), "left"))

    def exists(self, other: Solutions) -> Solutions:
        return Solutions(self.frame.join(other.frame, self._on(other), "left_semi"))

    def not_exists(self, other: Solutions) -> Solutions:
        return Solutions(self.frame.join(other.frame, self._on(other), "left_anti"))

    def minus(self, other: Solutions) -> Solutions:
        """As not_exists(), but nothing goes where no variable is shared."""
        return self.not_exists(other) if self._on(other) else self

    def union(self, other: Solutions) -> Solutions:
        return Solutions(self.frame.unionByName(other.frame, allowMissingColumns=True))

    def filter(self, condition: Column) -> Solutions:
        """Rows for which the condition is true: an error (null) counts as false."""
        return Solutions(self.frame.where(F.coalesce(condition, F.lit(False))))

    def values(self, var: str, terms: list[str]) -> Solutions:
        if var[1:] in self.frame.columns:
            return self.filter(F.col(var[1:]).isin([constant(t) for t in terms]))
        return Solutions(self.frame.withColumn(var[1:], F.explode(F.array(*[F.lit(constant(t)) for t in terms]))))

    def bind(self, var: str, value: Column) -> Solutions:
        return Solutions(self.frame.withColumn(var[1:], value))

    def group(self, variables: list[str], **aggregates: Column) -> Solutions:
        return Solutions(self.frame.groupBy(*[v[1:] for v in variables]).agg(*[c.alias(k) for k, c in aggregates.items()]))

    def select(self, *variables: str, distinct: bool = False, order: list[Column] = (), limit: int | None = None) -> DataFrame:
        out = self.frame.select(*[v[1:] for v in variables]) if variables else self.frame
        out = out.distinct() if distinct else out
        out = out.orderBy(*order) if order else out
        return out.limit(limit) if limit is not None else out

    def ask(self) -> bool:
        return not self.frame.isEmpty()

    def construct(self, *template: tuple[str, str, str]) -> DataFrame:
        """s, p, o as terms: the template of every solution as a set. "_:x" is a new blank node for each solution, named by
        a hash of it; triples with an unbound variable are left out."""
        key = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("\u0002")) for c in sorted(self.frame.columns)]), 256)

        def part(x: str) -> Column:
            if x.startswith("?"):
                return F.col(x[1:])
            return F.concat(F.lit(f"{x}-"), F.substring(key, 1, 16)) if x.startswith("_:") else F.lit(constant(x))

        parts = [self.frame.select(part(s).alias("s"), part(p).alias("p"), part(o).alias("o")) for s, p, o in template]
        return reduce(DataFrame.unionByName, parts).where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def as_terms(triples: DataFrame) -> DataFrame:
    """s, p, o as terms, a set."""
    return Graph(triples)._one(("?s", "?p", "?o"))


def describe(triples: DataFrame, iri: str) -> DataFrame:
    """s, p, o about a resource, and about the blank nodes that it leads to."""
    from axiograph.operators.graph import reached

    rows = as_terms(triples)
    own = rows.where(F.col("s") == constant(iri))
    edges = rows.where(F.col("s").startswith("_:") & F.col("o").startswith("_:")).select(F.col("s").alias("child"), F.col("o").alias("parent"))
    first = own.where(F.col("o").startswith("_:")).select(F.col("o").alias("node"))
    blanks = first.unionByName(reached(edges, first)).distinct()
    return own.unionByName(rows.join(blanks.select(F.col("node").alias("s")), "s", "left_semi")).distinct()


def update(triples: DataFrame, where: Solutions, delete: list[tuple[str, str, str]] = (), insert: list[tuple[str, str, str]] = ()) -> DataFrame:
    """s, p, o as terms after what the solutions name is deleted and then inserted; both see the triples as they were."""
    rows = as_terms(triples)
    if delete:
        rows = rows.join(where.construct(*delete), ["s", "p", "o"], "left_anti")
    return rows.unionByName(where.construct(*insert)).distinct() if insert else rows


def verify(checks: dict[str, DataFrame]) -> DataFrame:
    """rule, violations: how many rows each check has; a check without rows passes."""
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, rows in checks.items()])


def expand_macros(graph: Graph, macros: dict[str, tuple[Solutions, list[tuple[str, str, str]]]], include: list[str] | None = None, exclude: list[str] = (), source: str | None = None) -> DataFrame:
    """s, p, o as terms that macros make: term -> (solutions, template). include and exclude choose among the terms; source: a
    property by which the made subjects name the term they come from. Triples that the graph has already are left out."""
    chosen = {k: v for k, v in macros.items() if (include is None or k in include) and k not in exclude}
    empty = as_terms(graph.rows)
    made = [where.construct(*template) for where, template in chosen.values()]
    tags = [where.construct(*[(s, source, term) for s in sorted({t[0] for t in template})]) for term, (where, template) in chosen.items()] if source else []
    parts = [*made, *tags] or [empty.limit(0)]
    return reduce(DataFrame.unionByName, parts).distinct().join(empty, ["s", "p", "o"], "left_anti")


def write_all(queries: dict[str, DataFrame], folder: str, fmt: str = "csv") -> dict[str, str]:
    """Each query's rows to a place of its own below folder; name -> place."""
    from axiograph.sources.files import write_rows

    places = {name: f"{folder}/{name}.{fmt}" for name in queries}
    for name, rows in queries.items():
        write_rows(rows, places[name], fmt)
    return places
