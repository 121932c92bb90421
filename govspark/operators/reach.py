"""Whether one dataset is above another, for many questions against a large lineage graph, without listing all pairs.

Cycles are condensed first: all datasets of a cycle are above each other and become one node. On the rest, which has no
cycle, every node gets a level (above all it feeds) and ``LABELS`` intervals: the least and the largest of a random number
over everything below it, itself included. If u is above v, then v's intervals lie within u's, and its level is lower; most
other pairs fail this range test. Pairs that pass are searched: a step puts u down to the nodes it feeds or v up to the nodes that feed it,
whichever are fewer, and goes on with the pairs that pass the test as well. So a hub, above or below, is not entered once
for every question about it.

Rounds follow the depth of the graph. A round joins the pairs found last with the edges, and writes its new rows to the shared
folder, so plans stay short and a lost executor does not undo them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from govspark.session import fresh_path

LABELS = 3


def _stored(df: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    """``df`` written and read again; its path is added to ``parts``."""
    path = fresh_path(df.sparkSession, f"reach-{name}")
    df.write.parquet(path)
    if parts is not None:
        parts.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _together(df: DataFrame, parts: list[str]) -> DataFrame:
    """All that was stored at ``parts``, ``df`` the last of it: nothing is written again as more is added."""
    return df.sparkSession.read.schema(df.schema).parquet(*parts)


def _spread(edges: DataFrame, start: DataFrame, better: bool) -> DataFrame:
    """Let values flow along ``edges`` (a, b) from ``start`` (node, value) until nothing changes; a node keeps the least value, or
    with ``better`` false the first."""
    known = now = _stored(start, "values")
    while True:
        sent = now.join(edges, now["node"] == edges["a"]).groupBy(F.col("b").alias("node")).agg(F.min("value").alias("value"))
        old = known.select("node", F.col("value").alias("old"))
        new = sent.join(old, "node", "left").where(F.col("old").isNull() | (F.lit(better) & (F.col("value") < F.col("old"))))
        now = _stored(new.select("node", "value"), "new")
        if now.isEmpty():
            return known
        known = _stored(known.unionByName(now).groupBy("node").agg(F.min("value").alias("value")), "values")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that lie on cycles or between them: nodes without a way in or out are taken away round by round."""
    while True:
        size = edges.count()
        into, out = edges.select(F.col("b").alias("a")).distinct(), edges.select(F.col("a").alias("b")).distinct()
        edges = _stored(edges.join(into, "a", "left_semi").join(out, "b", "left_semi").select("a", "b"), "trimmed")
        if edges.count() in (0, size):
            return edges


def cycles(edges: DataFrame) -> DataFrame:
    """node, cycle (its least node) of every node that lies on a cycle of ``edges`` (a, b); a loop is a cycle.

    Every node takes the least node that reaches it as its colour. The nodes of a colour from which that node can be reached
    within the colour are a cycle (or several that share nodes); they are taken away, and the rest is coloured again.
    """
    found = _stored(edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("cycle")).distinct(), "loops")
    left = _trimmed(_stored(edges.where("a <> b").select("a", "b").distinct(), "edges"))
    while not left.isEmpty():
        nodes = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
        colour = _spread(left, nodes.select("node", F.col("node").alias("value")), True)
        of = {end: colour.select(F.col("node").alias(end), F.col("value").alias(f"colour_{end}")) for end in ("a", "b")}
        inside = _stored(left.join(of["a"], "a").join(of["b"], "b").where("colour_a = colour_b"), "inside")
        back = inside.select(F.col("b").alias("a"), F.col("a").alias("b"))
        heads = colour.where("node = value").select("node", "value")
        taken = _spread(back, heads, False)
        alone = taken.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
        found = _stored(found.unionByName(taken.join(alone, "value", "left_semi").select("node", F.col("value").alias("cycle"))), "cycles")
        gone = taken.select("node")
        rest = left.join(gone.select(F.col("node").alias("a")), "a", "left_anti").join(gone.select(F.col("node").alias("b")), "b", "left_anti")
        left = _trimmed(_stored(rest.select("a", "b"), "left"))
    return found.groupBy("node").agg(F.min("cycle").alias("cycle"))


def _number(i: int, node: Column) -> Column:
    """Four bytes, since every pair that is searched carries twelve of them; equal numbers only let more pairs pass."""
    return F.hash(F.lit(i), node)


def labelled(edges: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """node, level, low0, high0, ... of every node of ``edges`` (a, b), which have no cycle; ``alone``: nodes (node) without edges."""
    edges = _stored(edges.select("a", "b").distinct(), "dag")
    every = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    if alone is not None:
        every = every.unionByName(alone.select("node"))
    waiting = _stored(every.distinct(), "nodes")
    names = [f"{end}{i}" for i in range(LABELS) for end in ("low", "high")]
    first = [_number(i, F.col("node")).alias(f"{end}{i}") for i in range(LABELS) for end in ("low", "high")]
    done, parts, level = None, [], 0
    if waiting.isEmpty():
        return waiting.select("node", F.lit(0).alias("level"), *first)
    while not waiting.isEmpty():
        open_edges = edges if done is None else edges.join(done.select(F.col("node").alias("b")), "b", "left_anti")
        ready = waiting.join(open_edges.select(F.col("a").alias("node")).distinct(), "node", "left_anti")
        own = ready.select("node", F.lit(level).alias("level"), *first)
        if done is None:
            new = own
        else:
            below = edges.join(ready.select(F.col("node").alias("a")), "a", "left_semi").join(done.withColumnRenamed("node", "b"), "b")
            summed = below.groupBy(F.col("a").alias("node")).agg(*((F.min if n.startswith("low") else F.max)(n).alias(f"_{n}") for n in names))
            pick = [(F.least if n.startswith("low") else F.greatest)(F.col(n), F.col(f"_{n}")).alias(n) for n in names]
            new = own.join(summed, "node", "left").select("node", "level", *pick)
        new = _stored(new, "labels", parts)
        if new.isEmpty():
            raise ValueError("the edges have a cycle")
        done = _together(new, parts)
        waiting = _stored(waiting.join(new.select("node"), "node", "left_anti"), "waiting")
        level += 1
    return done


def _within(above: str, below: str) -> Column:
    """The range test: whether ``above`` may be above ``below`` (struct columns of labels)."""
    test = F.col(above)["level"] > F.col(below)["level"]
    for i in range(LABELS):
        test = test & (F.col(above)[f"low{i}"] <= F.col(below)[f"low{i}"]) & (F.col(above)[f"high{i}"] >= F.col(below)[f"high{i}"])
    return test


def _between(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct edges (a, b) that may lie on a way from an asked ``above`` to an asked ``below``.

    An edge goes if nothing leaves its end and nobody asks below it, or nothing enters its start and nobody asks above it, round by
    round while a round takes a tenth or more; what stays is stored and shrinks. The test by the fewer nodes comes first, and only
    what it leaves is put to the other.
    """
    asked_at = {end: asked.select(F.col(of).alias(end)).distinct() for of, end in (("below", "b"), ("above", "a"))}
    few = edges.agg(F.approx_count_distinct("a").alias("a"), F.approx_count_distinct("b").alias("b")).first()
    order = ("b", "a") if few["a"] <= few["b"] else ("a", "b")
    size = None
    while True:
        for end in order:
            onward = edges.select(F.col("a" if end == "b" else "b").alias(end)).unionByName(asked_at[end]).distinct()
            left = edges.join(onward, end, "left_semi").select("a", "b")
            # Dealt out by edge, so that a hub does not fill the task that drops repeated edges.
            edges = _stored(left.repartition("a", "b").distinct() if size is None else left, "between")
        before, size = size, edges.count()
        if size == 0 or before is not None and size > 0.9 * before:
            return edges


def reachable(edges: DataFrame, questions: DataFrame) -> DataFrame:
    """above, below, reachable: for every distinct question (``above``, ``below``: URNs) whether ``above`` feeds ``below``, at any distance.

    ``edges``: source_urn, target_urn. A dataset is above itself if it lies on a cycle. URNs without an edge are above and below
    nothing; edges and questions with a null are ignored.
    """
    asked = _stored(questions.select("above", "below").where("above IS NOT NULL AND below IS NOT NULL").distinct(), "questions")
    given = edges.select(F.col("source_urn").alias("a"), F.col("target_urn").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    pairs = _between(given, asked)
    on_cycle = _stored(cycles(pairs), "on-cycle")

    def condensed(df: DataFrame, name: str) -> DataFrame:
        named = on_cycle.select(F.col("node").alias(name), "cycle")
        return df.join(named, name, "left").withColumn(f"_{name}", F.coalesce("cycle", name)).drop("cycle")

    both = condensed(condensed(pairs, "a"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    dag = _stored(both.where("a <> b").distinct(), "condensed")
    labels = labelled(dag)
    ways = {end: dag.groupBy(F.col(of).alias("node")).agg(F.count("*").alias(end)) for of, end in (("a", "feeds"), ("b", "fed"))}
    stamp = F.struct(*[c for c in labels.columns if c != "node"], *(F.coalesce(end, F.lit(0)).alias(end) for end in ways))
    known = _stored(labels.join(ways["feeds"], "node", "left").join(ways["fed"], "node", "left").select("node", stamp.alias("label")), "known")
    label_of = {end: known.select(F.col("node").alias(end), F.col("label").alias(f"label_{end.strip('_')}")) for end in ("_above", "_below", "a", "b")}
    steps = _stored(dag.join(label_of["a"], "a").join(label_of["b"], "b"), "steps")

    told = condensed(condensed(asked, "above"), "below")
    member = on_cycle.select(F.col("cycle").alias("_above")).distinct().withColumn("_cyclic", F.lit(True))
    same = told.where("_above = _below").join(member, "_above", "left").where("_cyclic").select("above", "below")
    open_pairs = told.where("_above <> _below")
    # Questions about the same two condensed nodes are searched once; what they come down to is whether ``u`` is above ``v``.
    once = open_pairs.select("_above", "_below").distinct()
    tops = label_of["_above"].join(once.select("_above").distinct(), "_above", "left_semi")
    start = once.join(label_of["_below"], "_below").join(tops, "_above").where(_within("label_above", "label_below"))
    search = ["_above", "_below", "u", "v"]
    frontier = _stored(start.select("_above", "_below", F.col("_above").alias("u"), F.col("_below").alias("v"),
                                    F.col("label_above").alias("label_u"), F.col("label_below").alias("label_v")), "frontier")
    more, hits, seen, found = not frontier.isEmpty(), None, [], []
    while more:
        fewer = F.col("label_u")["feeds"] <= F.col("label_v")["fed"]
        down = frontier.where(fewer).join(steps, F.col("u") == F.col("a")).select("_above", "_below", F.col("b").alias("u"), "v", F.col("label_b").alias("label_u"), "label_v")
        up = frontier.where(~fewer).join(steps, F.col("v") == F.col("b")).select("_above", "_below", "u", F.col("a").alias("v"), "label_u", F.col("label_a").alias("label_v"))
        fresh = down.unionByName(up).where((F.col("u") == F.col("v")) | _within("label_u", "label_v")).dropDuplicates(search)
        if seen:
            fresh = fresh.join(_together(frontier, seen).select(search), search, "left_anti")
        step = _stored(fresh.select(frontier.columns), "step", seen)
        hits = _together(_stored(step.where("u = v").select("_above", "_below").distinct(), "hits", found), found)
        frontier, more = step.join(hits, ["_above", "_below"], "left_anti").select(step.columns), not step.where("u <> v").isEmpty()
    yes = same
    if hits is not None:
        yes = yes.unionByName(open_pairs.join(hits.distinct(), ["_above", "_below"], "left_semi").select("above", "below"))
    return asked.join(yes.distinct().withColumn("_yes", F.lit(True)), ["above", "below"], "left").select(
        "above", "below", F.coalesce("_yes", F.lit(False)).alias("reachable"))
