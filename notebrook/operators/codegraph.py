"""Data flow between cells and segments, execution order and risk rules.

Python only turns single cells into rows (``functions.code``); definitions and references meet in Spark: the latest
definition before a reference is a running maximum over (notebook, name), cut into blocks so that no notebook gathers in one
task. Cells that do not parse have no rows."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notebrook.functions import code as C
from notebrook.operators.ordered import running
from notebrook.session import written

#: Positions are cell_id * STEP + the number of the event in the cell.
STEP = 1_000_000


def per_cell(cells: DataFrame, function: Callable, fields: str) -> DataFrame:
    """One row for each item that function(code) yields; cells has notebook_id, cell_id, code."""
    schema = cells.sparkSession.createDataFrame([], f"notebook_id string, cell_id int, {fields}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            rows = [(n, c, *item) for n, c, code in zip(*(x.to_pylist() for x in b.columns)) for item in function(code)]
            columns = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, arrow)], schema=arrow)

    return cells.select("notebook_id", "cell_id", "code").mapInArrow(run, schema)


def references(cells: DataFrame) -> DataFrame:
    """notebook_id, name, source_cell, target_cell, source_line, target_line: every reference that resolves to a definition
    in an earlier position. A variable handed to a function that the notebook defines counts as defined anew there."""
    events = per_cell(cells, C.events, "seq int, line int, kind string, name string, other string")
    # used several times below: written once, so that no cell is parsed again
    events = written(events.withColumn("at", F.col("cell_id").cast("bigint") * STEP + F.col("seq")), "events")
    defined = events.where("kind = 'def'").groupBy("notebook_id", "name").agg(F.min("at").alias("first"), F.max((F.col("other") == "variable").cast("int")).alias("variable"))
    known = events.join(defined, ["notebook_id", "name"])
    functions = defined.select("notebook_id", F.col("name").alias("other"), F.col("first").alias("function_first"))
    handed = known.where("kind = 'arg' and variable = 1 and first < at").join(functions, ["notebook_id", "other"]).where("function_first < at")
    keep = ["notebook_id", "name", "at", "cell_id", "line", "kind"]
    sites = known.where("kind in ('def', 'ref')").select(*keep).unionByName(handed.select(*keep).withColumn("kind", F.lit("def")))
    sites = sites.withColumn("key", F.concat_ws("\x1f", "notebook_id", "name"))
    mark = F.when(F.col("kind") == "def", F.struct("at", "line"))
    found = running(sites, "key", "at", block=256 * STEP, source=("max", mark, False)).where("kind = 'ref' and source is not null")
    return found.select(
        "notebook_id", "name", F.floor(F.col("source.at") / STEP).cast("int").alias("source_cell"), F.col("cell_id").alias("target_cell"), F.col("source.line").alias("source_line"), F.col("line").alias("target_line")
    )


def edges(refs: DataFrame, groups: DataFrame) -> DataFrame:
    """notebook_id, source, target, names: data flow between the groups (segments) of cells, without loops."""
    of = lambda side: groups.select("notebook_id", F.col("cell_id").alias(f"{side}_cell"), F.col("segment_id").alias(side))
    slim = refs.select("notebook_id", "name", "source_cell", "target_cell").distinct()
    placed = slim.join(of("source"), ["notebook_id", "source_cell"]).join(of("target"), ["notebook_id", "target_cell"]).where("source != target")
    return placed.groupBy("notebook_id", "source", "target").agg(F.array_sort(F.collect_set("name")).alias("names"))


def density(links: DataFrame, groups: DataFrame) -> DataFrame:
    """notebook_id, nodes, links, density of the multigraph with one link per name."""
    nodes = groups.groupBy("notebook_id").agg(F.count_distinct("segment_id").alias("nodes"))
    count = links.groupBy("notebook_id").agg(F.sum(F.size("names")).alias("links"))
    m, n = F.coalesce("links", F.lit(0)), F.col("nodes")
    return nodes.join(count, "notebook_id", "left").select(
        "notebook_id", "nodes", m.cast("bigint").alias("links"), F.round(F.when(n > 1, m / (n * (n - 1))).otherwise(0.0), 6).alias("density")
    )


def graph_json(links: DataFrame, groups: DataFrame, page: int = 1000) -> DataFrame:
    """notebook_id, page, graph: nodes and links as JSON for a viewer, in pages of ``page`` segment numbers (a link with its source), so that no row
    grows with a notebook but by the links of its page."""
    paged = lambda df, at: df.withColumn("page", F.floor(F.col(at) / page)).groupBy("notebook_id", "page")
    node = F.struct(F.col("segment_id").alias("id"), F.concat(F.lit("Segment "), "segment_id").alias("label"))
    nodes = paged(groups.select("notebook_id", "segment_id").distinct(), "segment_id").agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    arcs = paged(links, "source").agg(F.array_sort(F.collect_list(F.struct("source", "target", F.array_join("names", ", ").alias("label")))).alias("links"))
    none = F.expr("array()").cast(dict(arcs.dtypes)["links"])
    return nodes.join(arcs, ["notebook_id", "page"], "left").select("notebook_id", "page", F.to_json(F.struct("nodes", F.coalesce("links", none).alias("links"))).alias("graph"))


def layers(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root, depth: breadth first from each root along edges (parent, child) until nothing new is found. A node is in the layer of
    its shortest way from the root; cycles and several ways to a node are met once."""
    edges = written(edges.select("parent", "child").where("parent is not null and child is not null").distinct(), "edges")
    found = written(roots.select("node", "root", F.lit(0).alias("depth")).where("node is not null").distinct(), "layers")
    frontier, depth = found, 0
    while not frontier.isEmpty():
        depth += 1
        reached = edges.join(frontier.select(F.col("node").alias("parent"), "root"), "parent").select(F.col("child").alias("node"), "root").distinct()
        frontier = written(reached.join(found, ["node", "root"], "left_anti").withColumn("depth", F.lit(depth)), "layers")
        found = found.unionByName(frontier)
    return found


def symbols(cells: DataFrame) -> DataFrame:
    """notebook_id, cell_id, role (makes, needs), name, space (var, fun)."""

    def rows(code):
        made, needed = C.produced_consumed(code)
        return [("makes", *x.split(":")) for x in made] + [("needs", *x.split(":")) for x in needed]

    return per_cell(cells, rows, "role string, name string, space string")


def runnable_top_down(symbol_rows: DataFrame) -> DataFrame:
    """notebook_id, cell_id, missing: names that a cell needs and neither it nor a cell above it makes."""
    made = symbol_rows.where("role = 'makes'").groupBy("notebook_id", "name", "space").agg(F.min("cell_id").alias("first"))
    needed = symbol_rows.where("role = 'needs'").select("notebook_id", "cell_id", "name", "space")
    late = needed.join(made, ["notebook_id", "name", "space"], "left").where("first is null or first > cell_id")
    return late.groupBy("notebook_id", "cell_id").agg(F.array_sort(F.collect_set("name")).alias("missing"))


def execution_orders(makes: list[set], needs: list[set], most: int) -> list[list[int]]:
    """Orders in which every cell finds what it needs made before it or by itself, lowest cells first; where no cell can go
    on, the order stays partial. At most ``most`` of them."""
    orders: list[list[int]] = []

    def extend(order: list[int], made: frozenset) -> None:
        if len(orders) >= most:
            return
        stuck = True
        for i in range(len(makes)):
            if i not in order and needs[i] <= made | makes[i]:
                stuck = False
                extend([*order, i], made | makes[i])
                if len(orders) >= most:
                    return
        if stuck:
            orders.append(order)

    extend([], frozenset())
    return orders


def _books(symbol_rows: DataFrame, cells: DataFrame, *more: str) -> DataFrame:
    """notebook_id, x: the cells of a notebook in order with what they make and need."""
    lists = symbol_rows.groupBy("notebook_id", "cell_id").agg(
        F.collect_set(F.when(F.col("role") == "makes", F.concat_ws(":", "name", "space"))).alias("makes"),
        F.collect_set(F.when(F.col("role") == "needs", F.concat_ws(":", "name", "space"))).alias("needs"),
    )
    every = cells.select("notebook_id", "cell_id", *more).join(lists, ["notebook_id", "cell_id"], "left")
    return every.groupBy("notebook_id").agg(F.array_sort(F.collect_list(F.struct("cell_id", "makes", "needs", *more))).alias("x"))


def order_rows(symbol_rows: DataFrame, cells: DataFrame, most: int = 1) -> DataFrame:
    """notebook_id, path, cells (positions in run order). For notebooks of bounded size only: the enumeration is exponential, its
    cap is the reference's own, and a notebook is one group."""
    @F.udf("array<array<int>>", useArrow=True)
    def run(x):
        return execution_orders([set(c["makes"] or ()) for c in x], [set(c["needs"] or ()) for c in x], most)

    return _books(symbol_rows, cells).select("notebook_id", F.posexplode(run("x")).alias("path", "cells"))


#: Notebooks of more cells are thinned by joins before their rest is ordered in one task; after ROUNDS a rest that still grows is taken whole.
LARGE, ROUNDS = 2_000, 12


def order_count(makes: list[set], needs: list[set], most: int) -> tuple[int, int]:
    """How many orders ``execution_orders`` has, up to ``most``, and their length: what is made only grows, so all of them
    hold the same cells. One step forward or back for each cell that differs, no recursion."""
    waits: dict[str, list[int]] = {}
    missing = []
    for i, (m, n) in enumerate(zip(makes, needs)):
        missing.append(len(n - m))
        for name in n - m:
            waits.setdefault(name, []).append(i)
    have: dict[str, int] = {}
    ready = [i for i, n in enumerate(missing) if not n]
    path: list[int] = []
    count, length, last = 0, 0, -1
    while True:
        k = bisect_right(ready, last)
        if k < len(ready):
            i = ready.pop(k)
            path.append(i)
            for name in makes[i]:
                have[name] = have.get(name, 0) + 1
                for c in waits.get(name, ()) if have[name] == 1 else ():
                    missing[c] -= 1
                    if not missing[c]:
                        insort(ready, c)
            last = -1
            continue
        if last == -1:
            count, length = count + 1, len(path)
        if count >= most or not path:
            return count, length
        last = path.pop()
        for name in makes[last]:
            have[name] -= 1
            for c in waits.get(name, ()) if not have[name] else ():
                if not missing[c]:
                    ready.pop(bisect_left(ready, c))
                missing[c] += 1
        insort(ready, last)


def delayed_order(cells: list[tuple[int, set, dict]]) -> list[tuple[int, int, int]]:
    """(cell, trigger, step) of the cells that run, given (cell, made, {needed: the first other cell that makes it in place, or None}).
    The lowest ready cell runs first: a cell that waits runs right after the trigger that completes it, the lowest of these first."""
    makes = {c: m for c, m, _ in cells}
    missing, waits, given = {}, {}, {}
    for c, m, n in cells:
        foreign = {name: first for name, first in n.items() if name not in m}
        missing[c] = len(foreign)
        for name, first in foreign.items():
            waits.setdefault(name, []).append(c)
            if first is not None:
                given.setdefault(first, set()).add(name)
    heap: list[int] = []
    out = []

    def provide(names, now):
        for name in names:
            for c in waits.pop(name, ()):
                missing[c] -= 1
                if not missing[c] and c < now:
                    heappush(heap, c)

    for now in sorted(makes.keys() | given.keys()):
        provide(given.get(now, ()), now)
        if now in makes and not missing[now]:
            out.append((now, now, 0))
            provide(makes[now], now)
        step = 0
        while heap:
            c, step = heappop(heap), step + 1
            out.append((c, now, step))
            provide(makes[c], now)
    return out


def single_order(symbol_rows: DataFrame, cells: DataFrame) -> DataFrame:
    """notebook_id, cell_id, trigger, step: the first execution order of each notebook is that of (trigger, step); cells that
    never can run are left out. Of a large notebook the cells that run in their place are found by joins: a cell waits if
    something that it needs has no earlier maker that does not wait. Only the waiting ones go to one task."""
    key = F.concat_ws(":", "name", "space").alias("key")
    rows = written(symbol_rows.select("notebook_id", "cell_id", "role", key).distinct(), "symbols")
    cells = written(cells.select("notebook_id", "cell_id"), "places")
    large = cells.groupBy("notebook_id").count().where(F.col("count") > LARGE).select("notebook_id")
    makes = rows.where("role = 'makes'").drop("role")
    needs = rows.where("role = 'needs'").drop("role").join(makes, ["notebook_id", "cell_id", "key"], "left_anti")
    big_makes = written(makes.join(large, "notebook_id", "left_semi").withColumnRenamed("cell_id", "maker"), "makes")
    big_needs = written(needs.join(large, "notebook_id", "left_semi"), "needs")
    first = big_makes.groupBy("notebook_id", "key").agg(F.min("maker").alias("first"))
    size, late = -1, None
    for _ in range(ROUNDS):
        before = size
        late = written(big_needs.join(first, ["notebook_id", "key"], "left").where("first is null or first > cell_id").select("notebook_id", "cell_id").distinct(), "late")
        size = late.count()
        if size == before:
            break
        first = big_makes.join(late.withColumnRenamed("cell_id", "maker"), ["notebook_id", "maker"], "left_anti").groupBy("notebook_id", "key").agg(F.min("maker").alias("first"))
    else:
        late, first = cells.join(large, "notebook_id", "left_semi"), first.where("false")
    waiting = cells.join(large, "notebook_id", "left_anti").unionByName(late)
    first = written(first, "first")
    roles = needs.join(first, ["notebook_id", "key"], "left").withColumn("made", F.lit(False)).unionByName(makes.withColumn("first", F.lit(None).cast("int")).withColumn("made", F.lit(True)))
    lists = roles.groupBy("notebook_id", "cell_id").agg(F.collect_list(F.struct("key", "first", "made")).alias("x"))
    books = waiting.join(lists, ["notebook_id", "cell_id"], "left").groupBy("notebook_id").agg(F.collect_list(F.struct("cell_id", "x")).alias("cells"))

    @F.udf("array<struct<cell_id int, trigger int, step int>>", useArrow=True)
    def run(cells):
        return delayed_order([(c["cell_id"], {s["key"] for s in c["x"] or () if s["made"]}, {s["key"]: s["first"] for s in c["x"] or () if not s["made"]}) for c in cells])

    moved = books.select("notebook_id", F.inline(run("cells")))
    placed = cells.join(waiting, ["notebook_id", "cell_id"], "left_anti").select("notebook_id", "cell_id", F.col("cell_id").alias("trigger"), F.lit(0).alias("step"))
    return placed.unionByName(moved)


def order_counts(symbol_rows: DataFrame, cells: DataFrame, most: int) -> DataFrame:
    """notebook_id, orders (up to most), longest."""

    @F.udf("struct<orders bigint, longest bigint>", useArrow=True)
    def run(x):
        return order_count([set(c["makes"] or ()) for c in x], [set(c["needs"] or ()) for c in x], most)

    return _books(symbol_rows, cells).select("notebook_id", run("x").alias("n")).select("notebook_id", "n.orders", "n.longest")


#: Functions whose results are random, and the call that makes them repeatable.
RANDOM_APIS = {
    "numpy.random.*": "numpy.random.seed",
    "sklearn.utils.random.*": "numpy.random.seed",
    "random.*": "random.seed",
    "scipy.sparse.random.*": "numpy.random.seed",
}


def api_matches(name: Column, pattern: str) -> Column:
    """Whether the dotted parts of a name agree with a pattern as far as both go; * agrees with anything."""
    wanted = F.array(*[F.lit(p) for p in pattern.split(".")])
    parts = F.split(name, r"\.")
    n = F.least(F.size(parts), F.size(wanted))
    return F.forall(F.zip_with(F.slice(parts, F.lit(1), n), F.slice(wanted, F.lit(1), n), lambda a, b: (b == "*") | (a == b)), lambda x: x)


def api_calls(cells: DataFrame) -> DataFrame:
    """notebook_id, cell_id, call, api: every call through an imported name of the notebook, and its fully qualified name."""
    used = per_cell(cells, lambda code: [(c, c.split(".")[0]) for c in C.calls(code)], "call string, root string").distinct()
    known = per_cell(cells, C.imports, "root string, full_name string").select("notebook_id", "root", "full_name").distinct()
    return used.join(known, ["notebook_id", "root"]).select("notebook_id", "cell_id", "call", F.concat("full_name", F.expr("substr(call, length(root) + 1)")).alias("api")).distinct()


def _needed(api: Column) -> Column:
    return F.coalesce(*[F.when(api_matches(api, p) & (api != seed), F.lit(seed)) for p, seed in RANDOM_APIS.items()])


def random_risk(cells: DataFrame) -> DataFrame:
    """notebook_id, needed, seeded: random functions in use, by the seed call they need, and whether that call is made."""
    full = api_calls(cells).select("notebook_id", "api").distinct()
    seeds = full.where(F.col("api").isin(*set(RANDOM_APIS.values()))).select("notebook_id", F.col("api").alias("needed"), F.lit(True).alias("seeded"))
    return full.select("notebook_id", _needed(F.col("api")).alias("needed")).where("needed is not null").distinct().join(seeds, ["notebook_id", "needed"], "left").fillna(False)


def random_fixes(cells: DataFrame) -> DataFrame:
    """notebook_id, cell_id, call, fix: for every call of a random function the lines that make it repeatable."""
    found = api_calls(cells).withColumn("needed", _needed(F.col("api"))).where("needed is not null")
    module = F.concat(F.lit("import "), F.substring_index("needed", ".", 1))
    return found.select("notebook_id", "cell_id", "call", F.array(module, F.concat("needed", F.lit("(100)"))).alias("fix"))


#: Steps, beside ten for each cell, after which a search for recorded orders that has found none is given up as unsettled: it is exponential in the runs without a cell.
STEPS = 100_000


def recorded_orders(makes: list[set], needs: list[set], counts: list[int | None], most: int, steps: int | None = None) -> list[list[int]] | None:
    """Orders in which the cells can have been run, given the number of each one's last run: the run of that number is its own, runs that no cell
    has as its last were of cells that ran again later, the next to run again first. Every cell finds what it needs made before it or by itself. At
    most ``most``, or those found within ``steps``; None if none is found within them and it is not certain that there is none."""
    last = {n: i for i, n in enumerate(counts) if n}
    steps = STEPS + 10 * len(counts) if steps is None else steps
    numbers = sorted(last)
    length = numbers[-1] if numbers else 0
    free = next((at for at in range(1, length + 1) if at not in last), length + 1)
    sure, later = set(), set().union(*(makes[i] for n, i in last.items() if n > free))
    for n in numbers:  # what no cell can have made in time rules out every order
        sure |= makes[last[n]]
        if not needs[last[n]] <= (sure if n < free else sure | later):
            return []
    orders: list[list[int]] = []
    path: list[int] = []
    have: dict[str, int] = {}
    tried = [0]
    while tried and len(orders) < most:
        at = len(path) + 1
        if at > length:
            orders.append(list(path))
        begin, k = bisect_right(numbers, at), tried[-1]
        size = 0 if at > length else 1 if at in last else len(numbers) - begin
        cell = lambda j: last[at] if at in last else last[numbers[begin + j]]  # noqa: B023, E731
        while k < size and not all(have.get(x) or x in makes[cell(k)] for x in needs[cell(k)]):
            k, steps = k + 1, steps - 1
        steps -= 1
        if steps < 0:
            return orders or None
        if k < size:
            tried[-1] = k + 1
            path.append(cell(k))
            for x in makes[path[-1]]:
                have[x] = have.get(x, 0) + 1
            tried.append(0)
        else:
            tried.pop()
            if path:
                for x in makes[path.pop()]:
                    have[x] -= 1
    return orders


def recorded_order_counts(symbol_rows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """notebook_id, orders (up to most; null: unsettled), runs: orders that agree with the recorded numbers. counts has notebook_id, cell_id, count
    (null: not run). One notebook is one group; the search is exponential but for its bounds."""

    @F.udf("struct<orders bigint, runs bigint>", useArrow=True)
    def run(x):
        found = recorded_orders([set(c["makes"] or ()) for c in x], [set(c["needs"] or ()) for c in x], [c["count"] for c in x], most)
        return (None if found is None else len(found)), max((c["count"] or 0 for c in x), default=0)

    return _books(symbol_rows, counts, "count").select("notebook_id", run("x").alias("n")).select("notebook_id", "n.orders", "n.runs")


def executable(symbol_rows: DataFrame, cells: DataFrame) -> DataFrame:
    """notebook_id, strategy, executable: whether every cell finds its names when the cells run from top to bottom (normal), or in the order of
    what they make and need (dependency)."""
    cells = cells.select("notebook_id", "cell_id").distinct()
    symbol_rows = written(symbol_rows, "symbols")
    books = cells.groupBy("notebook_id").agg(F.count("*").alias("n"))
    stuck = runnable_top_down(symbol_rows).select("notebook_id", F.lit(False).alias("runs")).distinct()
    ordered = single_order(symbol_rows, cells).groupBy("notebook_id").agg(F.count("*").alias("placed"))
    normal = books.join(stuck, "notebook_id", "left").select("notebook_id", F.lit("normal").alias("strategy"), F.coalesce("runs", F.lit(True)).alias("executable"))
    by_need = books.join(ordered, "notebook_id", "left").select("notebook_id", F.lit("dependency").alias("strategy"), (F.coalesce("placed", F.lit(0)) == F.col("n")).alias("executable"))
    return normal.unionByName(by_need)


def edit_distance(links_a: dict, n_a: int, links_b: dict, n_b: int, budget: int = 20_000) -> tuple[float, bool]:
    """(least number of node and edge edits between two digraphs whose nodes are all alike and whose edges are alike if their labels are, whether it
    is certain). Depth-first with bounds; if the budget of expansions ends before, the best found so far, an upper bound."""
    if n_a > n_b:
        links_a, n_a, links_b, n_b = links_b, n_b, links_a, n_a
    best, left = [float(n_a + n_b + len(links_a) + len(links_b))], [budget]
    used: list[int] = []  # the node of b that each node of a so far stands for, -1 for none
    where: dict[int, int] = {}
    beside: list[dict[int, list[tuple[int, bool]]]] = [{}, {}]
    for near, links in zip(beside, (links_a, links_b)):
        for x, y in links:
            near.setdefault(x, []).append((y, True))
            near.setdefault(y, []).append((x, False))

    def added(i: int, j: int) -> int:
        """Links of i and j to the nodes in use that differ."""
        cost = 0
        for k, out in beside[0].get(i, ()):
            if k < i:
                m = used[k]
                other = links_b.get((j, m) if out else (m, j)) if j >= 0 and m >= 0 else None
                cost += links_a[(i, k) if out else (k, i)] != other
        for m, out in beside[1].get(j, ()):
            k = where.get(m)
            cost += k is not None and ((i, k) if out else (k, i)) not in links_a
        return cost

    labels_a = [Counter(label for ends, label in links_a.items() if max(ends) >= i) for i in range(n_a + 1)]

    def at_least(i: int) -> int:
        """What is left must cost this much: nodes of b beyond those of a, and labels that the open links of one side have too many of."""
        open_b = Counter(label for (x, y), label in links_b.items() if x not in where or y not in where)
        return n_b - len(where) - (n_a - i) + max((labels_a[i] - open_b).total(), (open_b - labels_a[i]).total())

    def extend(i: int, cost: float) -> bool:
        if left[0] <= 0:
            return False
        left[0] -= 1
        if cost >= best[0] or cost + at_least(i) >= best[0]:
            return True
        if i == n_a:
            rest = [j for j in range(n_b) if j not in where]
            outside = sum(1 for (a, b) in links_b if a not in where or b not in where)
            best[0] = min(best[0], cost + len(rest) + outside)
            return True
        options = sorted((added(i, j), abs(i - j), j) for j in range(n_b) if j not in where)
        for step, _, j in [*options, (added(i, -1) + 1, 0, -1)]:
            used.append(j)
            if j >= 0:
                where[j] = i
            ok = extend(i + 1, cost + step)
            used.pop()
            where.pop(j, None)
            if not ok:
                return False
        return True

    certain = extend(0, 0.0)
    return best[0], certain
