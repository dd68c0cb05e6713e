"""Strong components of whole networks: links shrink by what needs no search, then searches run in blocks.

What is sure without a search goes first, round by round: nodes that link to each other are one (components of the
two-way links), nodes without links in or out are alone, and a chain of nodes with one link in and one out becomes one
link (pointers double, so a chain takes about the logarithm of its length).  Merging, trimming and contracting make new
work for each other, so trees and chains of any length take few rounds.  Of what is left the busiest node's component is
found by a search in blocks there and back; the rest takes its smallest reaching nodes as many pivots at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators import search
from tarmac.operators.components import connected
from tarmac.storage import forget, measured, stored

#: How a level of the shrinking is undone: its nodes are in their root's component, or in the component of both ends of
#: their chain (``root`` and ``other``) if that is one, and alone if not.
_LEVEL = ["node", "root", "other"]


def _counted(links: DataFrame) -> tuple[DataFrame, int]:
    links, seen = measured(links, n=F.count(F.lit(1)))
    return links, seen["n"]


def _relabelled(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between roots; nodes without one keep their name."""
    for end in ("tail", "head"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias("_r")), end, "left").withColumn(end, F.coalesce("_r", end)).drop("_r")
    return links.select("tail", "head").where("tail <> head").distinct()


def _merged(links: DataFrame, levels: list[DataFrame]) -> DataFrame | None:
    """Links after nodes that link to each other are one; None if there are none such."""
    back = links.select(F.col("head").alias("tail"), F.col("tail").alias("head"))
    both, n = _counted(links.where("tail < head").join(back, ["tail", "head"], "left_semi"))
    if not n:
        return None
    roots = stored(connected(both, "tail", "head").where("node <> root"))
    levels.append(roots.select("node", "root", F.col("root").alias("other")))
    return _relabelled(links, roots)


def _inner(links: DataFrame) -> DataFrame:
    """Links in and out of nodes that have one of each: ``(node, back, ahead)``."""
    into = links.groupBy(F.col("head").alias("node")).agg(F.count("*").alias("_in"), F.min("tail").alias("back"))
    out = links.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("_out"), F.min("head").alias("ahead"))
    return into.where("_in = 1").join(out.where("_out = 1"), "node").select("node", "back", "ahead")


def _contracted(links: DataFrame, levels: list[DataFrame]) -> DataFrame | None:
    """Links after each chain is one link, and rings of nothing but a chain are gone; None if there are no chains."""
    inner, n = _counted(_inner(links))
    if not n:
        return None
    # each node points ahead, knows the last node it passes and the smallest; a pointer to an inner node takes that one's
    now = stored(inner.select("node", F.col("ahead").alias("at"), F.col("node").alias("last"), F.col("node").alias("low")))
    moving = n
    for _ in range(n.bit_length() + 1):
        far = now.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("last").alias("_last"), F.col("low").alias("_low"))
        step = now.join(far, "at", "left").select(
            "node", F.coalesce("_at", "at").alias("at"), F.coalesce("_last", "last").alias("last"), F.least("low", "_low").alias("low"), F.col("_at").isNotNull().alias("moved")
        )
        last = now
        now, seen = measured(step, n=F.count_if("moved"))
        forget(last)
        moving = seen["n"]
        if not moving:
            break
    if moving:  # still among inner nodes after as many steps as there are: rings, which are components by themselves
        ring = now.where("moved and node <> low")
        levels.append(stored(ring.select("node", F.col("low").alias("root"), F.col("low").alias("other"))))
    open_ends = now.where(~F.col("moved")) if moving else now
    starts = inner.join(inner.select(F.col("node").alias("back")), "back", "left_anti").select("node", "back")
    starts = starts.join(open_ends, "node").select("last", F.col("back").alias("root"), F.col("at").alias("other"))
    chains = stored(open_ends.select("node", "last").join(starts, "last").select(*_LEVEL))
    levels.append(chains)
    left = links
    for end in ("tail", "head"):
        left = left.join(inner.select(F.col("node").alias(end)), end, "left_anti")
    short = chains.select(F.col("root").alias("tail"), F.col("other").alias("head")).where("tail <> head")
    return left.select("tail", "head").unionByName(short).distinct()


def _trimmed(links: DataFrame) -> DataFrame:
    """Links between nodes that have both links in and links out."""
    inside = links.join(links.select(F.col("head").alias("tail")).distinct(), "tail", "left_semi")
    return inside.join(links.select(F.col("tail").alias("head")).distinct(), "head", "left_semi").select("tail", "head")


def _shrunk(links: DataFrame, n: int, levels: list[DataFrame]) -> tuple[DataFrame, int]:
    """Links and their number when trimming, merging and contracting no longer take a tenth of them; searches find the rest."""
    while n:
        before = n
        links, n = _counted(_trimmed(links))
        for shorter in (_merged, _contracted):
            found = shorter(links, levels) if n else None
            if found is not None:
                links, n = _counted(found)
        if 10 * n > 9 * before:
            break
    return links, n


def _pivot(links: DataFrame) -> DataFrame:
    """``(node, root)`` of the component of the node with most links, by searches there and back."""
    ends = links.select(F.col("tail").alias("node")).unionByName(links.select(F.col("head").alias("node"))).groupBy("node").count()
    busiest = ends.agg(F.min_by("node", F.struct(-F.col("count"), "node")).alias("node")).first()["node"]
    net = search.network(links.withColumn("cost", F.lit(0.0)))
    own = search.tree(net, busiest).select("node").join(search.tree(search.reverse(net), busiest).select("node"), "node", "left_semi")
    return stored(own.withColumn("root", F.lit(busiest)))


def _pivots(links: DataFrame) -> DataFrame:
    """``(node, root)`` of many components: each node takes the smallest that reaches it, and those that reach that one back are its component."""
    nodes = links.select(F.col("tail").alias("node")).unionByName(links.select(F.col("head").alias("node"))).distinct()
    best = frontier = stored(nodes.select("node", F.col("node").alias("root")))
    while True:  # roots only fall
        offers = frontier.select(F.col("node").alias("tail"), "root").join(links, "tail").groupBy(F.col("head").alias("node")).agg(F.min("root").alias("_r"))
        step, seen = measured(best.join(offers, "node", "left").select("node", F.least("root", "_r").alias("root"), F.coalesce(F.col("_r") < F.col("root"), F.lit(False)).alias("fell")), n=F.count_if("fell"))
        best, frontier = step.select("node", "root"), step.where("fell").select("node", "root")
        if not seen["n"]:
            break
    tail, head = (best.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")) for c in ("tail", "head"))
    inside = stored(links.join(tail, "tail").join(head, "head").where("_tail = _head").select("tail", "head"))
    found = frontier = stored(best.where("node = root"))
    while True:  # nodes found only grow
        steps = frontier.select(F.col("node").alias("head"), "root").join(inside, "head").select(F.col("tail").alias("node"), "root").distinct()
        frontier, n = _counted(steps.join(found, "node", "left_anti"))
        if not n:
            return found
        found = stored(found.unionByName(frontier))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for each node of ``edges`` (``tail``, ``head``: whole numbers); a component is named by its smallest node.

    Edges may repeat, and edges from a node to itself only make it known.  Edges with a null end are left out.
    """
    given = stored(edges.select(F.col("tail").cast("long").alias("tail"), F.col("head").cast("long").alias("head")).where("tail is not null and head is not null").distinct())
    links, n = _counted(given.where("tail <> head"))
    levels: list[DataFrame] = []
    first = True
    while True:
        links, n = _shrunk(links, n, levels)
        if not n:
            break
        taken = _pivot(links) if first else _pivots(links)
        first = False
        levels.append(taken.where("node <> root").select("node", "root", F.col("root").alias("other")))
        for end in ("tail", "head"):
            links = links.join(taken.select(F.col("node").alias(end)), end, "left_anti")
        links, n = _counted(links.select("tail", "head"))
    own = stored(given.select(F.col("tail").alias("node")).unionByName(given.select(F.col("head").alias("node"))).distinct().select("node", F.col("node").alias("component")))
    for level in reversed(levels):
        ends = level
        for end in ("root", "other"):
            ends = ends.join(own.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")), end)
        known = ends.where("_root = _other").select("node", F.col("_root").alias("_c"))
        last = own
        own = stored(own.join(known, "node", "left").select("node", F.coalesce("_c", "component").alias("component")))
        forget(last)
    names = own.groupBy("component").agg(F.min("node").alias("_name"))
    return own.join(names, "component").select("node", F.col("_name").alias("component"))


def largest(edges: DataFrame) -> DataFrame:
    """Nodes of the largest strong component, the one with the smallest node on ties."""
    every = stored(components(edges))
    best = every.groupBy("component").count().agg(F.min_by("component", F.struct(-F.col("count"), "component")).alias("component"))
    return every.join(F.broadcast(best), "component", "left_semi").select(F.col("node").cast(edges.schema["tail"].dataType).alias("node"))  # one row
