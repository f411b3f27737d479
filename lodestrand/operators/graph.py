"""Graphs and reply trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.text import edge_multiplier
from lodestrand.sources.tables import written

DAMPING = 0.85


#: Referring and defining files of a block of edges; a block's weights take 8 bytes an edge.
SRC_FILES, DST_FILES = 512, 1024
#: Names that are multiplied at once, and single products that are added at once.
_NAMES, _PRODUCTS = 256, 1 << 22


def symbol_edges(tags: DataFrame) -> DataFrame:
    """(src, dst, weight) of ``tags(rel_path, name, kind)``: a file that refers to a name points to each file that defines it.

    Weight: the name's multiplier times the integer root of the number of references. A
    defined name without references gives its files a loop of 0.1. Parallel edges add.

    The weights are the product of two sparse matrices, files by names and names by files. It
    is made in blocks of files, so a name with r referring and d defining files does not
    become r * d rows that are shuffled and added; the rows that come out are the edges.
    """
    uses = written(tags.groupBy("name", F.col("rel_path").alias("file")).agg(F.count_if(F.col("kind") == "ref").alias("n"), F.coalesce(F.bool_or(F.col("kind") == "def"), F.lit(False)).alias("defines")), "uses")
    by_name = uses.groupBy("name").agg(F.count_if("defines").alias("definers"), F.bool_or(F.col("n") > 0).alias("used")).where("definers > 0")
    names = written(by_name.select("name", "used", edge_multiplier(F.col("name"), F.col("definers")).alias("factor"), F.monotonically_increasing_id().alias("id")), "names")
    met = names.where("used and name is not null").select("name", "factor", "id")
    # A file's loops are a name of its own, which it refers to and defines.
    alone = uses.where("defines").join(met, "name", "left_anti").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    loops = written(alone.select("file", (-1 - F.monotonically_increasing_id()).alias("id"), (0.1 * F.col("n")).alias("weight")), "loops")
    refs = uses.where("n > 0").join(met, "name").select("file", "id", (F.col("factor") * F.floor(F.sqrt("n"))).alias("weight"))
    defs = uses.where("defines").join(met, "name").select("file", "id", F.lit(1.0).alias("weight"))
    sides = []
    for entries in (refs.unionByName(loops), defs.unionByName(loops.withColumn("weight", F.lit(1.0)))):
        listed = entries.groupBy("file").agg(F.collect_list(F.struct("id", "weight")).alias("e")).select("file", F.col("e.id").alias("ids"), F.col("e.weight").alias("weights"))
        sides.append(written(listed, "entries"))
    rows, columns = (max(1, -(-side.count() // size)) for side, size in zip(sides, (SRC_FILES, DST_FILES)))
    dealt = lambda n: F.pmod(F.xxhash64("file"), F.lit(n))
    across = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    src = sides[0].select(F.lit(True).alias("refers"), dealt(rows).alias("a"), across(columns).alias("b"), "file", "ids", "weights")
    dst = sides[1].select(F.lit(False).alias("refers"), across(rows).alias("a"), dealt(columns).alias("b"), "file", "ids", "weights")
    tasks = min(rows * columns, max(int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows * columns // 4))
    # By number, so that tasks with little input and many edges are not put together.
    return src.unionByName(dst).repartition(tasks, "a", "b").groupBy("a", "b").applyInArrow(_edges, "src string, dst string, weight double")


def _edges(table: pa.Table) -> pa.Table:
    """Edges of a block: rows of ``table(refers, file, ids, weights)`` that refer, times those that define."""

    def side(refers: bool) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray, np.ndarray]:
        part = table.filter(pc.equal(table.column("refers"), refers))
        spots = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("ids")).to_numpy())
        return part.column("file"), spots, pc.list_flatten(part.column("ids")).to_numpy(), pc.list_flatten(part.column("weights")).to_numpy()

    (sources, i, left, w), (targets, j, right, _) = side(True), side(False)
    shape = (len(sources), len(targets))
    total = np.zeros(shape)
    shared = np.intersect1d(left, right)
    if len(shared):
        here, there = np.isin(left, shared), np.isin(right, shared)
        i, left, w, j, right = i[here], np.searchsorted(shared, left[here]), w[here], j[there], np.searchsorted(shared, right[there])
        r, d = np.bincount(left, minlength=len(shared)), np.bincount(right, minlength=len(shared))
        # names of many files as dense matrices, the others product by product
        common = np.flatnonzero(16 * r * d >= shape[0] * shape[1])
        for part in np.split(common, range(_NAMES, len(common), _NAMES)):
            place = np.full(len(shared), -1)
            place[part] = np.arange(len(part))
            a, b = np.zeros((shape[0], len(part))), np.zeros((len(part), shape[1]))
            at = place[left] >= 0
            a[i[at], place[left[at]]] = w[at]
            at = place[right] >= 0
            b[place[right[at]], j[at]] = 1.0
            total += a @ b
        rare = np.ones(len(shared), dtype=bool)
        rare[common] = False
        order = np.argsort(right, kind="stable")
        begins = np.cumsum(d) - d
        i, left, w = i[rare[left]], left[rare[left]], w[rare[left]]
        ends = np.cumsum(d[left])
        lo = 0
        while lo < len(left):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _PRODUCTS, "right")))
            n = d[left[lo:hi]]
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            np.add.at(total, (np.repeat(i[lo:hi], n), j[order[np.repeat(begins[left[lo:hi]], n) + steps]]), np.repeat(w[lo:hi], n))
            lo = hi
    x, y = np.nonzero(total)
    return pa.table({"src": sources.take(pa.array(x)), "dst": targets.take(pa.array(y)), "weight": total[x, y]}, schema=pa.schema([("src", pa.string()), ("dst", pa.string()), ("weight", pa.float64())]))


def pagerank(edges: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6, keep: "callable" = None) -> DataFrame:
    """(node, score) of the weighted graph ``edges(src, dst, weight)``, scores adding to 1.

    Power iteration with damping 0.85; the mass of nodes without outgoing weight is spread
    evenly. Stops after ``rounds``, or when the scores of N nodes moved by less than
    ``tolerance`` * N together (None: never). ``keep`` cuts the lineage of a round's scores; by
    default they are written to a table.
    """
    cut = keep or (lambda df: written(df, "rank"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    shares = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(out.select(F.col("src").alias("node"), F.lit(True).alias("goes")), "node", "left"))
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    scores = nodes.select("node", F.lit(1.0 / n).alias("score"))
    for turn in range(rounds):
        lost = nodes.where("goes is null").join(scores, "node").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        into = shares.join(scores.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("came"))
        new = (
            nodes.select("node")
            .join(into, "node", "left")
            .crossJoin(F.broadcast(lost))  # one row
            .select("node", ((1 - DAMPING) / n + DAMPING * (F.coalesce("came", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
        )
        if tolerance is None and turn % 4 != 3:
            scores = new
            continue
        new = cut(new)
        if tolerance is not None:
            moved = new.join(scores.withColumnRenamed("score", "was"), "node").agg(F.sum(F.abs(F.col("score") - F.col("was")))).head()[0]
            if moved < tolerance * n:
                return new
        scores = new
    return scores


def symbol_hubs(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs(src, hub, weight), defs(hub, dst, factor)) whose products are the edges of ``symbol_edges``.

    A hub is a name, or a defined name without references together with a file that defines
    it. A name with r referring and d defining files takes r + d rows here, not r * d.
    """
    defs = tags.where("kind = 'def'").select("name", F.col("rel_path").alias("dst")).distinct()
    refs = tags.where("kind = 'ref'").groupBy("name", F.col("rel_path").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    definers = defs.groupBy("name").agg(F.count(F.lit(1)).alias("definers"))
    named = defs.join(definers, "name").join(refs.select("name").distinct().withColumn("used", F.lit(True)), "name", "left")
    hub = F.when(F.col("used"), F.struct(F.col("name"), F.lit(None).cast("string").alias("file"))).otherwise(F.struct(F.col("name"), F.col("dst").alias("file")))
    out = named.select(hub.alias("hub"), "dst", F.when(F.col("used"), edge_multiplier(F.col("name"), F.col("definers"))).otherwise(F.lit(0.1)).alias("factor"), "used")
    loops = out.where("used is null").select(F.col("dst").alias("src"), "hub", F.lit(1.0).alias("weight"))
    met = refs.join(definers.select("name"), "name", "left_semi").select("src", F.struct(F.col("name"), F.lit(None).cast("string").alias("file")).alias("hub"), F.floor(F.sqrt("n")).cast("double").alias("weight"))
    return met.unionByName(loops), out.select("hub", "dst", "factor")


def pagerank_hubs(refs: DataFrame, defs: DataFrame, rounds: int = 100, tolerance: float | None = 1e-6, keep: "callable" = None) -> DataFrame:
    """``pagerank`` of the graph with an edge of ``weight * factor`` for each row of ``refs`` and ``defs`` that share a hub.

    A round sends each file's share to its hubs and from there to the files that define them,
    so the edges themselves are never made.
    """
    cut = keep or (lambda df: written(df, "rank"))
    defs = cut(defs)
    size = defs.groupBy("hub").agg(F.sum("factor").alias("size"))
    sized = refs.join(size, "hub")
    totals = sized.groupBy("src").agg(F.sum(F.col("weight") * F.col("size")).alias("total"))
    shares = cut(sized.join(totals, "src").select("src", "hub", (F.col("weight") / F.col("total")).alias("share")))
    nodes = cut(shares.select(F.col("src").alias("node")).union(defs.select("dst")).distinct().join(totals.select(F.col("src").alias("node"), F.lit(True).alias("goes")), "node", "left"))
    n = nodes.count()
    scores = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("score"))
    for _ in range(rounds if n else 0):
        lost = nodes.where("goes is null").join(scores, "node").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        at_hub = shares.join(scores.withColumnRenamed("node", "src"), "src").groupBy("hub").agg(F.sum(F.col("score") * F.col("share")).alias("mass"))
        into = at_hub.join(defs, "hub").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("mass") * F.col("factor")).alias("came"))
        new = cut(
            nodes.select("node")
            .join(into, "node", "left")
            .crossJoin(F.broadcast(lost))  # one row
            .select("node", ((1 - DAMPING) / n + DAMPING * (F.coalesce("came", F.lit(0.0)) + F.col("lost") / n)).alias("score"))
        )
        if tolerance is not None:
            moved = new.join(scores.withColumnRenamed("score", "was"), "node").agg(F.sum(F.abs(F.col("score") - F.col("was")))).head()[0]
            if moved < tolerance * n:
                return new
        scores = new
    return scores


def by_mass(ranked: DataFrame, target: float, most: int) -> DataFrame:
    """Nodes of ``ranked(node, score)`` by falling score while the scores before them are below ``target`` of all, at most ``most``; the first always.

    With no mass at all the first ``most``. The window without a key sees the ``most`` best
    rows only; the total comes from an aggregate.
    """
    total = ranked.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"))
    best = ranked.orderBy(F.desc("score"), "node").limit(most)
    before = Window.orderBy(F.desc("score"), "node").rowsBetween(Window.unboundedPreceding, -1)
    held = best.withColumn("before", F.coalesce(F.sum("score").over(before), F.lit(0.0))).crossJoin(F.broadcast(total))
    return held.where((F.col("total") == 0) | (F.col("before") < target * F.col("total")) | (F.col("before") == 0)).select("node", "score")


def reached(nodes: DataFrame, roots: DataFrame, only: str | None = None) -> DataFrame:
    """(root, node_id, depth): each of ``roots(node_id)``, and each node of ``nodes(node_id, parent_id, state)`` below one, with the nearest root above it.

    With ``only``, the descent goes through nodes of that state alone; a root counts in any state.
    Every node points to its parent; in a round, a pointer that has not met a root is replaced
    by its target's pointer, so a depth of d takes about log d rounds, and a row a node is all
    there is. Nodes on a cycle without a root are below none.
    """
    chosen = written(roots.select("node_id").distinct(), "roots")
    goes = F.col("parent_id").isNotNull() if only is None else F.col("parent_id").isNotNull() & (F.col("state") == F.lit(only))
    links = nodes.join(chosen, "node_id", "left_anti").where(goes).select("node_id", F.col("parent_id").alias("at"), F.lit(1).cast("long").alias("depth"))
    met = chosen.select(F.col("node_id").alias("at"), F.lit(True).alias("met"))
    pointers = written(links.join(met, "at", "left").select("node_id", "at", "depth", F.coalesce("met", F.lit(False)).alias("met")), "pointers")
    for _ in range(62):
        if not pointers.where("not met").head(1):
            break
        targets = pointers.select(F.col("node_id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"), F.col("met").alias("then"))
        moved = pointers.where("not met").join(targets, "at").select("node_id", F.col("further").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("then").alias("met"))
        pointers = written(pointers.where("met").unionByName(moved), "pointers")
    below = pointers.where("met").select(F.col("at").alias("root"), "node_id", F.col("depth").cast("int").alias("depth"))
    return chosen.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("depth")).unionByName(below)


def descendants(nodes: DataFrame, roots: DataFrame, only: str | None = None) -> DataFrame:
    """(root, node_id, depth): like ``reached``, with a row for every root above a node, not only for the nearest.

    Roots below roots are chained in rounds that double the length of the chains.
    """
    nearest = written(reached(nodes, roots, only), "reached")
    goes = F.lit(True) if only is None else F.col("state") == F.lit(only)
    # The nearest root above a root is that of its parent.
    up = nodes.where(goes & F.col("parent_id").isNotNull()).join(roots.select("node_id").distinct(), "node_id", "left_semi").select(F.col("node_id").alias("low"), F.col("parent_id").alias("node_id"))
    chains = written(up.join(nearest, "node_id").select("low", F.col("root").alias("high"), (F.col("depth") + 1).alias("apart")), "chains")
    step = chains
    for _ in range(62):
        # ``step`` has the roots 2 ** k levels above, ``chains`` all up to that
        longer = chains.select(F.col("low").alias("middle"), "high", F.col("apart").alias("more"))
        added = written(step.withColumnRenamed("high", "middle").join(longer, "middle").select("low", "high", (F.col("apart") + F.col("more")).alias("apart")), "chains")
        if not added.head(1):
            break
        far = step.select(F.col("low").alias("middle"), "high", F.col("apart").alias("more"))
        step = written(step.withColumnRenamed("high", "middle").join(far, "middle").select("low", "high", (F.col("apart") + F.col("more")).alias("apart")), "step")
        chains = written(chains.unionByName(added).distinct(), "chains")
    above = nearest.join(chains, nearest["root"] == chains["low"]).select(F.col("high").alias("root"), "node_id", (F.col("depth") + F.col("apart")).cast("int").alias("depth"))
    return nearest.unionByName(above)


def queue_positions(nodes: DataFrame) -> DataFrame:
    """(root_id, node_id, position): pending nodes of a tree in order, from 1."""
    order = Window.partitionBy("root_id").orderBy("node_id")
    return nodes.where("state = 'pending'").select("root_id", "node_id", F.row_number().over(order).cast("long").alias("position"))


def import_candidates(module: str = "module") -> "F.Column":
    """Paths that an absolute dotted module may live at, from the longest prefix to the shortest, module file before package."""
    parts = F.split(module, r"\.")
    lengths = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    return F.flatten(F.transform(lengths, lambda n: F.array(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit(".py")), F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/__init__.py")))))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports(src, module)`` with ``resolved``: the first candidate that is in ``files(path)``, else null."""
    spots = imports.select("src", "module", F.posexplode(import_candidates()).alias("place", "path"))
    found = spots.join(files, "path").groupBy("src", "module").agg(F.min_by("path", "place").alias("resolved"))
    return imports.join(found, ["src", "module"], "left")
