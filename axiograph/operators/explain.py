"""Justifications: the smallest sets of axioms that a subsumption follows from, found by a fixpoint whose facts carry the axioms they rest on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.model import Ontology
from axiograph.operators import graph, reason
from axiograph.sources.shared import settle

#: axiom types that the rules use
USED = ["SubClassOf", "EquivalentClasses", "DisjointClasses", "DisjointUnion", "SubPropertyOf", "SubPropertyChainOf", "TransitiveProperty", "PropertyDomain"]


def _with(*sets: Column) -> Column:
    return F.array_sort(reduce(F.array_union, sets))


def _smallest(sets: str) -> Column:
    """Those of an array of sets that hold no other of them."""
    return F.filter(F.col(sets), lambda s: ~F.exists(F.col(sets), lambda t: (F.size(t) < F.size(s)) & (F.size(F.array_except(t, s)) == 0)))


class _Supported:
    """Facts with the sets of axioms (why) that they follow from, of which only those stay that hold no other set of their fact."""

    def __init__(self, columns: list[str], largest: int | None):
        self.columns, self.largest, self.known, self.fresh = columns, largest, None, None
        self.moved = self.filled = False  # whether there is something new, or anything

    def add(self, derived: list[DataFrame], what: str) -> bool:
        """Take in what was derived; true if some of it is new."""
        if not derived:
            self.moved = False
            return False
        rows = reduce(DataFrame.unionByName, [d.select(*self.columns, "why", F.lit(False).alias("old")) for d in derived])
        if self.largest is not None:
            rows = rows.where(F.size("why") <= self.largest)
        if self.known is not None:
            rows = rows.unionByName(self.known.withColumn("old", F.lit(True)))
        held = rows.groupBy(*self.columns).agg(F.collect_set("why").alias("sets"), F.collect_set(F.when(F.col("old"), F.col("why"))).alias("olds"))
        kept = held.withColumn("why", F.explode(_smallest("sets"))).select(*self.columns, "why", (~F.array_contains("olds", F.col("why"))).alias("fresh"))
        kept = settle(kept, what)
        self.known, self.fresh = kept.drop("fresh"), kept.where("fresh").drop("fresh")
        self.moved = not self.fresh.isEmpty()
        self.filled = self.filled or self.moved
        return self.moved


def _both(left: _Supported, right: _Supported, join) -> list[DataFrame]:
    """join(l, r) where one of the two is new; what has no rows stays out of the plan."""
    return [join(left.fresh, right.known)] * (left.moved and right.filled) + [join(left.known, right.fresh)] * (right.moved and left.filled)


def numbered(ont: Ontology) -> DataFrame:
    """ax, ax_type, subject, object, operands: the axioms that the rules use, each once whatever its annotations, with a number."""
    if "_numbered" not in ont.__dict__:
        rows = ont.axioms.where(F.col("ax_type").isin(USED)).dropDuplicates(["core_id"])
        ont.__dict__["_numbered"] = settle(rows.select(F.monotonically_increasing_id().alias("ax"), "ax_type", "subject", "object", "operands"), "numbered")
    return ont.__dict__["_numbered"]


def supports(ont: Ontology, starts: DataFrame, largest: int | None = None) -> DataFrame:
    """x, y, why: what each of starts (x: names or texts of expressions) is under, with every smallest set of numbered() axioms that it follows from.

    The rules are those of reason.saturated(), and that a class is under the unions that it is a part of; they start at what is asked for and go on to a filler only once something has an edge to it, so
    only what an answer can rest on is worked out. largest: sets of more axioms are left out, all others are found none the less, since
    sets only grow along a derivation; without it all are found, which may be exponentially many.
    """
    ax = numbered(ont) if largest != 0 else ont.axioms.where(F.lit(False)).select(F.lit(0).cast("bigint").alias("ax"), "ax_type", "subject", "object", "operands")  # an empty set holds no axiom
    of = lambda kind: ax.where(F.col("ax_type") == kind)
    by, nothing = F.array("ax").alias("by"), F.array().cast("array<bigint>")
    link = lambda rows, a, b: rows.select(F.col(a).alias("y"), F.col(b).alias("z"), by)
    texts = ont.labels.select(F.col("node").alias("part"), "text")
    shapes = ont.expressions.where("label IS NOT NULL").select("expr", "op", "prop", "filler", "label").distinct()
    inner = ont.parts.where("role = 'part'").join(shapes.where("op = 'and'"), "expr").join(texts, "part", "left").select(F.col("label").alias("whole"), F.coalesce("text", "part").alias("y"))
    # intersections are met at their rarest part, as many may share another
    inner = settle(inner.where(F.col("y") != V.THING).distinct(), "inner")
    uses = inner.groupBy("y").agg(F.count("*").alias("uses"))
    ordered = inner.join(uses, "y").groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("uses", "y"))).alias("ys"))
    parts = settle(ordered.select("whole", F.posexplode("ys.y").alias("i", "y"), F.size("ys").alias("n")), "parts")
    either = _unions(ont).select(F.col("x").alias("y"), F.col("y").alias("z"), nothing.alias("by"))
    self_apart = of("DisjointClasses").where("size(operands) = 0 AND subject = object").select(F.col("subject").alias("y"), F.lit(V.NOTHING).alias("z"), by)
    unions = of("DisjointUnion").select(F.explode("operands").alias("m"), "subject", "ax")
    told = reduce(DataFrame.unionByName, [
        link(of("SubClassOf"), "subject", "object"), link(of("EquivalentClasses"), "subject", "object"), link(of("EquivalentClasses"), "object", "subject"),
        link(unions, "m", "subject"), self_apart, either, parts.select(F.col("whole").alias("y"), F.col("y").alias("z"), nothing.alias("by")),
    ])
    told = settle(told.where("y <> z").distinct(), "told")
    some = shapes.where("op = 'some'").join(texts.withColumnRenamed("part", "filler"), "filler", "left").select(F.col("label").alias("e"), F.col("prop").alias("p"), F.coalesce("text", "filler").alias("f"))
    some = some.unionByName(shapes.where("op = 'value'").select(F.col("label").alias("e"), F.col("prop").alias("p"), F.concat(F.lit("one("), "filler", F.lit(")")).alias("f")))
    some = settle(some.distinct(), "some")
    wider = settle(of("SubPropertyOf").where("subject <> object").select(F.col("subject").alias("p"), F.col("object").alias("q"), by), "wider")
    chains = of("SubPropertyChainOf").where("size(operands) > 1").select("ax", "subject", "operands", F.explode(F.sequence(F.lit(2), F.size("operands"))).alias("i"))
    begun = lambda n: F.when(n == 1, F.element_at("operands", 1)).otherwise(F.concat(F.lit("chain("), F.array_join(F.slice("operands", 1, n), " "), F.lit(")")))
    last = F.col("i") == F.size("operands")
    steps = chains.select(begun(F.col("i") - 1).alias("p"), F.element_at("operands", F.col("i")).alias("q"), F.when(last, F.col("subject")).otherwise(begun(F.col("i"))).alias("r"), F.when(last, F.array("ax")).otherwise(nothing).alias("by"))
    transitive = of("TransitiveProperty").select(F.col("subject").alias("p"), F.col("subject").alias("q"), F.col("subject").alias("r"), by)
    composed = settle(steps.unionByName(transitive).distinct(), "composed")
    domains = settle(link(of("PropertyDomain"), "subject", "object").withColumnRenamed("y", "p"), "domains")
    groups = of("DisjointClasses").select("ax", F.explode(F.when(F.size("operands") > 0, F.col("operands")).otherwise(F.array("subject", "object"))).alias("y"))
    groups = settle(groups.unionByName(unions.select("ax", F.col("m").alias("y"))).distinct(), "groups")
    has = {n: not t.isEmpty() for n, t in {"some": some, "parts": parts, "wider": wider, "composed": composed, "domains": domains, "groups": groups}.items()}
    none = F.lit(V.NOTHING).alias("y")

    def begin(rows: DataFrame) -> list[DataFrame]:  # what everything is under: itself and Thing
        return [rows.select("x", F.col("x").alias("y"), nothing.alias("why")), rows.select("x", F.lit(V.THING).alias("y"), nothing.alias("why"))]

    def through(edges: DataFrame, under: DataFrame) -> DataFrame:  # an edge to what is under a filler, or under Nothing
        met = edges.join(under.select(F.col("x").alias("f"), "y", F.col("why").alias("more")), "f").withColumn("why", _with(F.col("why"), F.col("more")))
        up = met.join(some.select("e", "p", F.col("f").alias("y")), ["p", "y"]).select("x", F.col("e").alias("y"), "why")
        return up.unionByName(met.where(F.col("y") == V.NOTHING).select("x", none, "why"))

    def onward(left: DataFrame, right: DataFrame) -> DataFrame:  # along two edges that an axiom composes
        ahead = right.select(F.col("x").alias("f"), F.col("p").alias("q"), F.col("f").alias("g"), F.col("why").alias("more"))
        return left.join(composed, "p").join(ahead, ["f", "q"]).select("x", F.col("r").alias("p"), F.col("g").alias("f"), _with(F.col("why"), F.col("more"), F.col("by")).alias("why"))

    def clash(left: DataFrame, right: DataFrame) -> DataFrame:  # under two members of a disjointness
        other = right.join(groups, "y").select("x", "ax", F.col("y").alias("z"), F.col("why").alias("more"))
        return left.join(groups, "y").join(other, ["x", "ax"]).where("y <> z").select("x", none, _with(F.col("why"), F.col("more"), F.array("ax")).alias("why"))

    def next_part(begun_: DataFrame, under: DataFrame) -> DataFrame:  # one more part of an intersection
        wanted = parts.select("whole", (F.col("i") - 1).alias("i"), "y", "n")
        more = under.select("x", "y", F.col("why").alias("more"))
        return begun_.drop("n").join(wanted, ["whole", "i"]).join(more, ["x", "y"]).select("x", "whole", (F.col("i") + 1).alias("i"), "n", _with(F.col("why"), F.col("more")).alias("why"))

    sub, edge, held = (_Supported(c, largest) for c in (["x", "y"], ["x", "p", "f"], ["x", "whole", "i", "n"]))
    sub.add(begin(starts.select("x").distinct()), "sub")
    empty = sub.known.limit(0)
    edge.add([empty.select("x", F.col("x").alias("p"), F.col("x").alias("f"), "why")], "edge")
    held.add([empty.select("x", F.col("x").alias("whole"), F.lit(0).alias("i"), F.lit(0).alias("n"), "why")], "held")
    more = True
    while more:
        subs, edges, wholes = _both(edge, sub, through), [], []
        if sub.moved:
            subs.append(sub.fresh.join(told, "y").select("x", F.col("z").alias("y"), _with(F.col("why"), F.col("by")).alias("why")))
            edges.append(sub.fresh.join(some, F.col("y") == F.col("e")).select("x", "p", "f", "why"))
        if has["parts"]:
            wholes = _both(held, sub, next_part) + [sub.fresh.join(parts.where("i = 0"), "y").select("x", "whole", "i", "n", "why")] * sub.moved
            subs += [held.fresh.where("i = n - 1").select("x", F.col("whole").alias("y"), "why")] * held.moved
        if edge.moved:
            subs += begin(edge.fresh.select(F.col("f").alias("x")).distinct())
            if has["domains"]:
                subs.append(edge.fresh.join(domains, "p").select("x", F.col("z").alias("y"), _with(F.col("why"), F.col("by")).alias("why")))
            if has["wider"]:
                edges.append(edge.fresh.join(wider, "p").select("x", F.col("q").alias("p"), "f", _with(F.col("why"), F.col("by")).alias("why")))
            if has["composed"]:
                edges += _both(edge, edge, onward)
        if has["groups"]:
            subs += _both(sub, sub, clash)
        grown = [held.add(wholes, "held"), edge.add(edges if has["some"] else [], "edge"), sub.add(subs, "sub")]
        more = any(grown)
    return sub.known


def justifications(ont: Ontology, goals: DataFrame, most: int | None = None, largest: int | None = None) -> DataFrame:
    """child, parent, rank, n, ax_type, subject, object: the axioms (a row each) of every smallest set that a goal follows from.

    goals: child, parent, names or texts of expressions; parent may be Nothing. Sets of a goal are ranked by their size n, then by their axioms' texts. A goal that
    follows from none (it doesn't hold, or holds in any ontology) has no rows; what makes the child unsatisfiable explains any goal of it. All goals
    are worked out in one fixpoint. most: sets of a goal; largest: axioms of a set (see supports()). Axioms count once whatever their annotations.
    """
    goals = settle(goals.select("child", "parent").where("child IS NOT NULL AND parent IS NOT NULL").distinct(), "goals")
    return _explained(ont, goals, supports(ont, goals.select(F.col("child").alias("x")), largest), most)


def _explained(ont: Ontology, goals: DataFrame, found: DataFrame, most: int | None) -> DataFrame:
    ends = goals.unionByName(goals.select("child", F.lit(V.NOTHING).alias("parent"))).distinct().select(F.col("child").alias("x"), F.col("parent").alias("y"))
    reached = found.join(ends, ["x", "y"]).withColumnRenamed("x", "child")
    own = reached.withColumnRenamed("y", "parent").join(goals, ["child", "parent"], "left_semi").unionByName(reached.where(F.col("y") == V.NOTHING).drop("y").join(goals, "child"))
    sets = own.groupBy("child", "parent").agg(F.collect_set("why").alias("sets")).withColumn("why", F.explode(_smallest("sets"))).drop("sets")
    key = ["child", "parent", "why"]
    rows = sets.withColumn("ax", F.explode("why")).join(numbered(ont).drop("operands"), "ax").withColumn("n", F.size("why"))
    rows = settle(rows, "reasons")
    names = rows.groupBy(*key, "n").agg(F.array_sort(F.collect_list(F.struct("subject", "ax_type", "object"))).alias("texts"))
    ranked = names.withColumn("rank", F.row_number().over(Window.partitionBy("child", "parent").orderBy("n", "texts")))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.select("child", "parent", "rank", "n", F.explode("texts").alias("t")).select("child", "parent", "rank", "n", "t.ax_type", "t.subject", "t.object")


def _clashes(ont: Ontology, largest: int | None) -> DataFrame:
    """supports() of the unsatisfiable named classes, worked out once."""
    key = f"_clashes{largest}"
    if key not in ont.__dict__:
        ont.__dict__[key] = settle(supports(ont, settle(reason.unsatisfiable(ont), "unsatisfiable").select(F.col("iri").alias("x")), largest).where(F.col("y") == V.NOTHING), "clashes")
    return ont.__dict__[key]


def clash_justifications(ont: Ontology, mode: str = "all", most: int | None = None, largest: int | None = None) -> DataFrame:
    """justifications() of the unsatisfiable classes: "all", "root" or "most_general" ones."""
    return _explained(ont, settle(unsatisfiable_goals(ont, mode, largest), "goals"), _clashes(ont, largest), most)


def unsatisfiable_kinds(ont: Ontology, largest: int | None = None) -> DataFrame:
    """iri, is_root, is_most_general: every unsatisfiable named class.

    A root has no justification that strictly holds one of another class: what is wrong with it is wrong with nothing smaller. A most general one has no
    unsatisfiable class strictly above it in the hierarchy as told. largest: as in supports(); a class all of whose sets are larger is no root.
    """
    iris = settle(reason.unsatisfiable(ont), "unsatisfiable")
    sets = _clashes(ont, largest).select(F.col("x").alias("iri"), "why")
    sets = settle(sets.join(iris, "iri", "left_semi"), "sets")
    uses = sets.select("iri", "why", F.explode("why").alias("ax"))
    rare = uses.groupBy("ax").agg(F.count("*").alias("uses"))
    # a set that another holds is met at the rarest of its axioms only
    keyed = uses.join(rare, "ax").groupBy("iri", "why").agg(F.min_by("ax", F.struct("uses", "ax")).alias("ax"))
    inner = keyed.select("ax", F.col("why").alias("inner"), F.col("iri").alias("other"))
    derived = uses.join(inner, "ax").where((F.col("iri") != F.col("other")) & (F.size("inner") < F.size("why")) & (F.size(F.array_except("inner", "why")) == 0)).select("iri").distinct()
    above = settle(graph.closure(reason.told(ont)).where("child <> parent").join(iris.select(F.col("iri").alias("child")), "child", "left_semi").join(iris.select(F.col("iri").alias("parent")), "parent", "left_semi"), "above")
    back = above.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    under = above.join(back, ["child", "parent"], "left_anti").select(F.col("child").alias("iri")).distinct()
    explained = sets.select("iri").distinct().withColumn("explained", F.lit(True))
    mark = lambda df, c: df.select("iri", F.lit(True).alias(c))
    out = iris.join(explained, "iri", "left").join(mark(derived, "derived"), "iri", "left").join(mark(under, "under"), "iri", "left")
    return out.select("iri", (F.col("explained").isNotNull() & F.col("derived").isNull()).alias("is_root"), F.col("under").isNull().alias("is_most_general"))


def unsatisfiable_goals(ont: Ontology, mode: str = "all", largest: int | None = None) -> DataFrame:
    """child, parent (Nothing): goals for justifications() of the unsatisfiable classes: "all", "root" or "most_general" ones."""
    if mode not in ("all", "root", "most_general"):
        raise ValueError(f"unknown mode {mode}")
    iris = reason.unsatisfiable(ont) if mode == "all" else unsatisfiable_kinds(ont, largest).where(f"is_{mode}")
    return iris.select(F.col("iri").alias("child"), F.lit(V.NOTHING).alias("parent"))


def axiom_impact(reasons: DataFrame) -> DataFrame:
    """ax_type, subject, object, uses: in how many of justifications()' sets an axiom is."""
    return reasons.groupBy("ax_type", "subject", "object").agg(F.countDistinct("child", "parent", "rank").alias("uses"))


#: axiom type -> how it reads between its subject and object
_READS = {"EquivalentClasses": "EquivalentTo", "DisjointClasses": "DisjointWith", "DisjointUnion": "DisjointUnionOf", "PropertyDomain": "Domain", "SubPropertyChainOf": "SuperPropertyOf", "TransitiveProperty": "Characteristics"}


def markdown(ont: Ontology, reasons: DataFrame) -> DataFrame:
    """child, parent, rank, text: each of justifications()' sets as Markdown: the goal as a heading, an axiom in each line, names as links
    with their (first) labels. Axioms stand in the order of their subjects, those of the child first."""
    labels = ont.with_p(V.LABEL).where("s_kind = 'iri' AND o_kind = 'literal'").groupBy("s").agg(F.min("o").alias("label"))
    reads = F.coalesce(*[F.when(F.col("ax_type") == k, v) for k, v in _READS.items()], F.col("ax_type"))
    rows = settle(reasons.select("child", "parent", "rank", "ax_type", "subject", "object", reads.alias("reads")), "lines")
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"[^\s()]+"), 0)
    used = rows.select(F.explode(F.array_union(F.array_union(words("subject"), words("object")), F.array("child", "parent"))).alias("s")).distinct().join(labels, "s")

    def shown(df: DataFrame, c: str, key: list[str]) -> DataFrame:  # c with its names as links; one row for each word, put together in order
        pieces = df.select(*key, F.posexplode(F.regexp_extract_all(F.col(c), F.lit(r"[^\s()]+|[\s()]"), 0)).alias("at", "s"))
        named = pieces.join(used, "s", "left").withColumn("t", F.when(F.col("label").isNotNull(), F.concat(F.lit("["), "label", F.lit("]("), "s", F.lit(")"))).when(F.col("s").rlike("^[a-z]+://"), F.concat(F.lit("["), "s", F.lit("]("), "s", F.lit(")"))).otherwise(F.col("s")))
        return named.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "").alias(f"{c}_text"))

    goal, line = ["child", "parent", "rank"], ["ax_type", "subject", "object"]
    distinct = settle(rows.select(*line, "reads").distinct(), "axioms")
    text = distinct.join(shown(distinct, "subject", line), line).join(shown(distinct, "object", line), line).select(*line, F.concat_ws(" ", "subject_text", "reads", "object_text").alias("line"))
    goals = rows.select("child", "parent").distinct()
    goals = goals.join(shown(goals, "child", ["child", "parent"]), ["child", "parent"]).join(shown(goals, "parent", ["child", "parent"]), ["child", "parent"])
    items = rows.join(text, line).groupBy(*goal).agg(F.array_sort(F.collect_list(F.struct((F.col("subject") != F.col("child")).alias("later"), "subject", "line"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x: F.concat(F.lit("  - "), x["line"])), "\n")
    return items.join(goals, ["child", "parent"]).select(*goal, F.concat(F.lit("## "), "child_text", F.lit(" SubClassOf "), "parent_text", F.lit(" ##\n\n"), body).alias("text"))


def tautologies(ont: Ontology) -> DataFrame:
    """ax_id of the class and property axioms that follow from no axiom: they hold in any ontology.

    A subclass axiom is one if its sides are in the hierarchy that supports() finds with empty sets of axioms (an intersection and its parts, existential
    restrictions by their fillers, unions and their parts, Thing and Nothing), an equivalence both ways; a disjointness of a class with what is empty, a property
    under itself or the property that holds of all, a domain or range Thing, and a class assertion of Thing.
    """
    ax = ont.axioms.select("ax_id", "ax_type", "subject", "object", "operands")
    sides = settle(ax.where("ax_type IN ('SubClassOf', 'EquivalentClasses', 'DisjointClasses')"), "sides")
    texts = sides.where("size(operands) = 0").select(F.explode(F.array("subject", "object")).alias("x")).unionByName(sides.select(F.explode("operands").alias("x"))).distinct()
    # a name alone is under itself and Thing only, so the fixpoint starts from expressions
    under = settle(supports(ont, texts.where("endswith(x, ')')"), 0).select("x", "y"), "under")
    none = under.where(F.col("y") == V.NOTHING).select("x").unionByName(texts.where(F.col("x") == V.NOTHING)).distinct()

    def below(a: str, b: str) -> DataFrame:
        rows = sides.where("ax_type <> 'DisjointClasses'").select("ax_id", F.col(a).alias("x"), F.col(b).alias("y"))
        plain = rows.where((F.col("x") == F.col("y")) | (F.col("y") == V.THING))
        # what is under a union that it is part of has no expression on its left
        return plain.unionByName(rows.join(under, ["x", "y"], "left_semi")).unionByName(rows.join(none, "x", "left_semi")).unionByName(rows.join(_unions(ont), ["x", "y"], "left_semi")).select("ax_id").distinct()

    left, right = below("subject", "object"), below("object", "subject")
    same = sides.where("ax_type = 'EquivalentClasses'").select("ax_id").join(left, "ax_id", "left_semi").join(right, "ax_id", "left_semi")
    sub = sides.where("ax_type = 'SubClassOf'").select("ax_id").join(left, "ax_id", "left_semi")
    members = sides.where("ax_type = 'DisjointClasses'").select("ax_id", F.explode(F.when(F.size("operands") > 0, F.col("operands")).otherwise(F.array("subject", "object"))).alias("x"))
    empties = none.withColumn("none", F.lit(1))
    apart = members.join(empties, "x", "left").groupBy("ax_id").agg(F.count("*").alias("n"), F.count("none").alias("empty")).where("n - empty < 2").select("ax_id")
    fixed = ax.where((F.col("ax_type").isin("SubPropertyOf", "EquivalentProperties") & (F.col("subject") == F.col("object"))) | (F.col("ax_type").isin("PropertyDomain", "PropertyRange", "ClassAssertion") & (F.col("object") == V.THING)) | ((F.col("ax_type") == "SubPropertyOf") & F.col("object").isin(V.OWL + "topObjectProperty", V.OWL + "topDataProperty"))).select("ax_id")
    return sub.unionByName(same).unionByName(apart).unionByName(fixed).distinct()


def _unions(ont: Ontology) -> DataFrame:
    """x, y: parts of unions and the unions, by their texts."""
    texts = ont.labels.select(F.col("node").alias("part"), "text")
    held = ont.parts.where("role = 'part'").join(ont.expressions.where("op = 'or' AND label IS NOT NULL").select("expr", "label"), "expr")
    return held.join(texts, "part", "left").select(F.coalesce("text", "part").alias("x"), F.col("label").alias("y")).distinct()
