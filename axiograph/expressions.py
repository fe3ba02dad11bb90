"""Anonymous expressions: lists, canonical texts, the names inside, and names for blank nodes that depend on what is said of them alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axiograph.functions import vocab as V
from axiograph.sources.shared import settle

#: predicates whose object is a list -> how its members count
LISTS = {
    V.INTERSECTION: "and", V.UNION: "or", V.ONE_OF: "one", V.CHAIN: "chain", V.DISJOINT_UNION: "list", V.KEY: "list", V.MEMBERS: "list", V.DISTINCT_MEMBERS: "list",
}
#: lists that are axioms, not expressions
AXIOM_LISTS = [p for p, op in LISTS.items() if op in ("list", "chain")]
FILLED = {V.SOME: "some", V.ALL: "all", V.VALUE: "value", V.SELF: "self", **V.CARDINALITIES}
ALONE = {V.COMPLEMENT: "not", V.INVERSE: "inverse"}
#: All predicates that an expression is made of.
PREDICATES = [*LISTS, *FILLED, *ALONE, V.ON_PROPERTY, V.ON_CLASS, V.ON_RANGE]
Rows = Callable[..., DataFrame]


def _case(column: str, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in table.items():
        out = out.when(F.col(column) == k, v)
    return out


def members(with_p: Rows) -> DataFrame:
    """owner, p, head, cell, at, member, member_kind: every list that a predicate of LISTS names, in order.

    Cells reach their list's head by doubling: each round joins what a cell has reached with what that has reached, so a list of n cells takes log2(n)
    rounds. A round that brings no cell to a head leaves only cells that follow each other in a circle; these are in no list.
    """
    owners = with_p(*LISTS).select(F.col("s").alias("owner"), "p", F.col("o").alias("head"))
    first = settle(with_p(V.FIRST).select(F.col("s").alias("cell"), F.col("o").alias("member"), F.col("o_kind").alias("member_kind")), "cells")
    back = with_p(V.REST).where(F.col("o") != V.NIL).select(F.col("o").alias("cell"), F.col("s").alias("to"))
    cells = settle(first.select("cell").distinct().join(back, "cell", "left").withColumn("n", F.lit(1).cast("long")), "cells")
    done = cells.where("to IS NULL").select("cell", F.col("cell").alias("head"), F.lit(0).cast("long").alias("at"))
    open_ = cells.where("to IS NOT NULL")
    while not open_.isEmpty():
        reached = settle(open_.join(done.select(F.col("cell").alias("to"), "head", "at"), "to").select("cell", "head", (F.col("at") + F.col("n")).alias("at")).distinct(), "heads")
        if reached.isEmpty():
            break
        on = open_.select(F.col("cell").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        open_ = settle(open_.join(on, "to").select("cell", F.col("to2").alias("to"), (F.col("n") + F.col("n2")).alias("n")).distinct(), "open")
        done = done.unionByName(reached)
    return settle(owners.join(done, "head").join(first, "cell").select("owner", "p", "head", "cell", "at", "member", "member_kind"), "members")


def described(with_p: Rows, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """expr, op, prop, filler, n of all expressions, and expr, role ("prop" or "part"), at, part, part_kind of what each consists of."""
    blank = "s_kind = 'bnode'"
    on = with_p(V.ON_PROPERTY).where(blank).select(F.col("s").alias("expr"), F.col("o").alias("prop"), F.col("o_kind").alias("prop_kind"))
    filled = with_p(*FILLED).where(blank).select(F.col("s").alias("expr"), _case("p", FILLED).alias("op"), F.col("o").alias("filler"), F.col("o_kind").alias("kind"))
    quality = with_p(V.ON_CLASS, V.ON_RANGE).select(F.col("s").alias("expr"), F.col("o").alias("of"), F.col("o_kind").alias("of_kind"))
    counted, alone = F.col("op").isin("min", "max", "exact"), F.col("op") == "self"
    filled = filled.join(quality, "expr", "left").select(
        "expr", "op", F.when(counted, F.col("filler")).alias("n"),
        F.when(counted, F.coalesce("of", F.lit(V.THING))).when(~alone, F.col("filler")).alias("filler"), F.when(counted, F.coalesce("of_kind", F.lit("iri"))).when(~alone, F.col("kind")).alias("kind"),
    )
    none = F.lit(None).cast("string")
    restrictions = on.join(filled, "expr")
    single = with_p(*ALONE).where(blank).select(F.col("s").alias("expr"), _case("p", ALONE).alias("op"), F.col("o").alias("filler"), F.col("o_kind").alias("kind"))
    lists = with_p(*LISTS).where(~F.col("p").isin(AXIOM_LISTS)).select(F.col("s").alias("expr"), _case("p", LISTS).alias("op"), none.alias("prop"), F.col("o").alias("filler"), none.alias("n"))
    whole = restrictions.select("expr", "op", "prop", "filler", "n").unionByName(single.select("expr", "op", none.alias("prop"), "filler", none.alias("n"))).unionByName(lists)
    zero = F.lit(0).cast("long").alias("at")
    parts = restrictions.where("filler IS NOT NULL").select("expr", F.lit("part").alias("role"), zero, F.col("filler").alias("part"), F.col("kind").alias("part_kind"))
    parts = parts.unionByName(restrictions.select("expr", F.lit("prop").alias("role"), zero, F.col("prop").alias("part"), F.col("prop_kind").alias("part_kind")))
    parts = parts.unionByName(single.select("expr", F.lit("part").alias("role"), zero, F.col("filler").alias("part"), F.col("kind").alias("part_kind")))
    parts = parts.unionByName(items.where(~F.col("p").isin(AXIOM_LISTS)).select(F.col("owner").alias("expr"), F.lit("part").alias("role"), zero, F.col("member").alias("part"), F.col("member_kind").alias("part_kind")))
    return settle(whole.distinct(), "expressions"), settle(parts.distinct(), "parts")


def shown(part: str = "part", kind: str = "part_kind") -> Column:
    """A name as it stands in a text: literals in quotes."""
    return F.when(F.col(kind) == "lit", F.concat(F.lit('"'), F.col(part), F.lit('"'))).otherwise(F.col(part))


def texts(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """expr, op, prop, filler, n, label: the canonical text of every expression, from the innermost outwards.

    A text has the texts of its parts, each once and in order of code points, and no name of a blank node. What refers to itself, or to a blank
    node that isn't an expression, has no text.
    """
    known = whole.select(F.col("expr").alias("part")).distinct()
    named = parts.where("part_kind <> 'bnode'").select("part", shown().alias("text")).distinct()
    named = named.join(known, "part", "left_anti")
    made_texts, open_, found, left = named, whole, None, known.count()
    while left:
        held = open_.select("expr").distinct().join(parts, "expr", "left").join(made_texts, "part", "left")
        is_part = F.col("role") == "part"
        ready = held.groupBy("expr").agg(
            F.count("part").alias("n_"), F.count("text").alias("m_"), F.array_join(F.array_sort(F.collect_set(F.when(is_part, F.col("text")))), " ").alias("inside_"), F.max(F.when(F.col("role") == "prop", F.col("text"))).alias("on_")
        ).where("n_ = m_")
        inside = F.when(F.col("inside_") != "", F.col("inside_"))
        made = open_.join(ready, "expr").withColumn("label", F.concat("op", F.lit("("), F.concat_ws(" ", "n", "on_", inside), F.lit(")"))).drop("n_", "m_", "inside_", "on_")
        made = settle(made, "texts")
        n = made.select("expr").distinct().count()
        if not n:
            break
        found, left = made if found is None else found.unionByName(made), left - n
        open_ = whole.join(found.select("expr").distinct(), "expr", "left_anti")
        made_texts = named.unionByName(found.select(F.col("expr").alias("part"), F.col("label").alias("text")).distinct())
    if not left:
        return whole.withColumn("label", F.lit(None).cast("string")) if found is None else found
    rest = open_.withColumn("label", F.lit(None).cast("string"))
    return rest if found is None else found.unionByName(rest)


def inside(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """expr, node, node_kind, depth: every name and every expression inside of an expression (itself at depth 0), at its least depth. One round for each level of nesting."""
    step = parts.select(F.col("expr").alias("from"), F.col("part").alias("node"), F.col("part_kind").alias("node_kind")).distinct()
    front = settle(whole.select("expr").distinct().select("expr", F.col("expr").alias("node"), F.lit("bnode").alias("node_kind"), F.lit(0).alias("depth")), "inside")
    seen = front
    while True:
        fresh = front.where("node_kind = 'bnode'").select("expr", F.col("node").alias("from"), "depth").join(step, "from").select("expr", "node", "node_kind", (F.col("depth") + 1).alias("depth")).distinct()
        front = settle(fresh.join(seen, ["expr", "node"], "left_anti"), "inside")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def coloured(rows: DataFrame, known: DataFrame) -> DataFrame:
    """node, text: a name for every blank node of rows (s, s_kind, p, o, o_kind, o_dt, o_lang) that known (node, text) lacks, from what is said of it and of what it refers to.

    A node that nothing refers to, and that refers to named and known nodes only, is named by its sorted statements: annotations of axioms are.
    The others are named by rounds of hashes: a node's next hash is that of its own with its sorted properties, forwards and backwards, and the
    hashes of the nodes there. They end when a round tells no more nodes apart, circles included, so the names of two loads of one graph
    agree. Nodes that no round tells apart share a name.
    """
    either = rows.where("s_kind = 'bnode' OR o_kind = 'bnode'")
    given = settle(known.select("node", "text").distinct(), "known")
    at = lambda c: given.withColumnsRenamed({"node": c, "text": f"{c}_text"})
    links = settle(either.join(at("s"), "s", "left").join(at("o"), "o", "left"), "links")
    fixed = F.concat_ws("\u0001", F.coalesce("o_text", "o"), "o_kind", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit("")))
    own_s, own_o = (F.col(f"{c}_kind") == "bnode" for c in ("s", "o"))
    open_s, open_o = own_s & F.col("s_text").isNull(), own_o & F.col("o_text").isNull()
    said = F.md5(F.concat_ws("\u0002", "p", fixed))
    free = links.where(open_s).select(F.col("s").alias("node"), "p", "o", open_o.alias("open"), said.alias("said")).join(links.where(open_o).select(F.col("o").alias("node")).distinct(), "node", "left_anti")
    plain = free.groupBy("node").agg(F.max("open").alias("open"), F.md5(F.array_join(F.array_sort(F.collect_set("said")), "")).alias("c")).where("NOT open")
    plain = settle(plain.select("node", F.concat(F.lit("_:"), "c").alias("text")), "plain")
    links = links.join(plain.select(F.col("node").alias("s")), "s", "left_anti")
    out = links.where(open_s).select(F.col("s").alias("node"), F.concat(F.lit(">"), "p").alias("p"), F.when(open_o, F.col("o")).alias("other"), F.when(~open_o, fixed).alias("value"))
    into = links.where(open_o).select(F.col("o").alias("node"), F.concat(F.lit("<"), "p").alias("p"), F.when(open_s, F.col("s")).alias("other"), F.when(~open_s, F.coalesce("s_text", "s")).alias("value"))
    edges = settle(out.unionByName(into).distinct(), "edges")
    colours, count = edges.select("node").distinct().withColumn("c", F.lit("")), 0
    while not edges.isEmpty():
        others = colours.select(F.col("node").alias("other"), F.col("c").alias("oc"))
        facts = edges.join(others, "other", "left").groupBy("node").agg(F.array_join(F.array_sort(F.collect_set(F.md5(F.concat_ws("\u0002", "p", F.coalesce("value", "oc"))))), "").alias("facts"))
        colours = settle(colours.join(facts, "node").select("node", F.md5(F.concat("c", F.lit("|"), "facts")).alias("c")), "colours")
        now = colours.select("c").distinct().count()
        if now == count:
            break
        count = now
    return plain.unionByName(colours.select("node", F.concat(F.lit("_:"), "c").alias("text")))
