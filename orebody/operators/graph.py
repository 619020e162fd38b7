"""Graph communities over undirected edges (src, dst)."""

from __future__ import annotations

from collections import defaultdict
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.skew import split_join
from orebody.session import cut, shared_dir


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge once, src < dst, without loops and nulls."""
    kept = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    e = undirected(edges)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def shared_group_edges(df: DataFrame, *, vertex: str, group: str, min_shared: int, min_ratio: float) -> DataFrame:
    """Edges between vertices that share at least `min_shared` groups, `min_ratio` times what chance gives.

    Vertices in too few groups, or in so many that no partner can reach the ratio, are dropped first;
    that loses no edge and takes the largest vertices out of the join.
    """
    rows = df.where(F.col(vertex).isNotNull() & F.col(group).isNotNull()).select(F.col(vertex).alias("v"), F.col(group).alias("g")).distinct()
    groups = F.broadcast(rows.agg(F.count_distinct("g").alias("m")))
    sizes = rows.groupBy("v").agg(F.count("*").alias("n")).join(groups, F.lit(True)).where((F.col("n") >= min_shared) & (F.col("n") * F.lit(float(min_ratio)) <= F.col("m")))
    kept = cut(rows.join(sizes, "v"))
    a, b = kept.toDF("src", "g", "n_1", "m"), kept.select(F.col("v").alias("dst"), "g", F.col("n").alias("n_2"))
    met = split_join(a, b, ["g"], ["src"]).where(F.col("src") < F.col("dst")).groupBy("src", "dst", "n_1", "n_2", "m").agg(F.count("*").alias("n"))
    return met.where((F.col("n") >= min_shared) & (F.col("n").cast("double") * F.col("m") >= F.col("n_1").cast("double") * F.col("n_2") * float(min_ratio))).select("src", "dst")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each vertex can reach.

    Labels spread along edges and then jump to the label of their label, so the rounds grow with the
    logarithm of the longest path; each round's lineage is cut.
    """
    e = cut(both_ways(edges))
    state = cut(vertices(e).withColumn("c", F.col("id")))
    while True:
        near = e.join(state.toDF("dst", "d"), "dst").groupBy("src").agg(F.min("d").alias("d"))
        step = state.join(near, state["id"] == near["src"], "left").select("id", "c", F.least("c", F.coalesce("d", "c")).alias("d"))
        jump = step.select(F.col("id").alias("j"), F.col("d").alias("jd"))
        new = cut(step.join(jump, step["d"] == jump["j"], "left").select("id", "c", F.least("d", F.coalesce("jd", "d")).alias("d")))
        if new.where(F.col("c") != F.col("d")).isEmpty():
            return new.select("id", F.col("d").alias("component"))
        state = new.select("id", F.col("d").alias("c"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after synchronous rounds; each vertex takes its neighbours' most frequent label, the least one if they tie."""
    e = cut(both_ways(edges))
    state = vertices(e).withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = e.join(state.toDF("dst", "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        state = cut(votes.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label")))
    return state


def betweenness(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness): shortest paths over each edge, between unordered pairs of vertices.

    A breadth-first search from all vertices at once, level by level, then credit flows back; the
    state is a row a pair of connected vertices.
    """
    e = cut(both_ways(edges))
    levels = [cut(vertices(e).select(F.col("id").alias("root"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))]
    reached = levels[0].select("root", "v")
    while True:
        grown = levels[-1].join(e.toDF("v", "w"), "v").groupBy("root", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        grown = cut(grown.join(reached, ["root", "v"], "left_anti"))
        if grown.isEmpty():
            break
        levels.append(grown)
        reached = levels[-1].select("root", "v").unionByName(levels[-2].select("root", "v"))  # a level's edges reach no further back
    credit = levels[-1].withColumn("credit", F.lit(1.0))
    flows = []
    for up in reversed(levels[:-1]):
        down = credit.join(e.toDF("v", "p"), "v").join(up.select("root", F.col("v").alias("p"), F.col("paths").alias("up")), ["root", "p"])
        down = cut(down.select("root", "p", "v", (F.col("credit") * F.col("up") / F.col("paths")).alias("flow")))
        flows.append(down.groupBy(F.least("p", "v").alias("src"), F.greatest("p", "v").alias("dst")).agg(F.sum("flow").alias("flow")))
        got = down.groupBy("root", F.col("p").alias("v")).agg(F.sum("flow").alias("got"))
        credit = cut(up.join(got, ["root", "v"], "left").select("root", "v", "paths", (1 + F.coalesce("got", F.lit(0.0))).alias("credit")))
    if not flows:
        return undirected(edges).limit(0).withColumn("betweenness", F.lit(0.0))
    total = flows[0]
    for f in flows[1:]:
        total = total.unionByName(f)
    return total.groupBy("src", "dst").agg((F.sum("flow") / 2).alias("betweenness")).orderBy(F.desc("betweenness"), "src", "dst")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row, `modularity`: sum over communities of inner edges / m - (degrees / 2m)^2; null for no edges."""
    e = undirected(edges)
    c = communities.select("id", "community")
    ends = e.join(c.toDF("src", "c1"), "src").join(c.toDF("dst", "c2"), "dst")
    inner = ends.where(F.col("c1") == F.col("c2")).groupBy(F.col("c1").alias("community")).agg(F.count("*").alias("inner"))
    degree = both_ways(edges).groupBy("src").agg(F.count("*").alias("d")).join(c.toDF("src", "community"), "src").groupBy("community").agg(F.sum("d").alias("degree"))
    m = F.broadcast(e.agg(F.count("*").alias("m")))
    each = degree.join(inner, "community", "left").join(m, F.lit(True))
    return each.agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), 2)).alias("modularity"))


def community_lines(communities: DataFrame) -> DataFrame:
    """(size, members): each community's members in order, quoted; by size, then first member."""
    text = F.array_sort(F.collect_list(F.col("id").cast("string")))
    lines = communities.groupBy("community").agg(text.alias("m"))
    return lines.select(F.size("m").alias("size"), F.concat(F.lit("'"), F.array_join("m", "', '"), F.lit("'")).alias("members")).orderBy("size", F.col("members"))


def _removals(edges: list[tuple[str, str]], decimals: int) -> list[tuple[float, list[tuple[str, str]], dict[str, str]]]:
    """Of one component: (largest betweenness, edges removed for it, least member of each vertex's part before that)."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = []
    while True:
        part: dict[str, str] = {}
        total: dict[tuple[str, str], float] = defaultdict(float)
        for root in sorted(near):
            order, level, paths, parents = [root], {root: 0}, {root: 1.0}, defaultdict(list)
            for v in order:
                for w in near[v]:
                    if w not in level:
                        level[w], paths[w] = level[v] + 1, 0.0
                        order.append(w)
                    if level[w] == level[v] + 1:
                        paths[w] += paths[v]
                        parents[w].append(v)
            if root not in part:
                part.update(dict.fromkeys(order, root))
            credit = dict.fromkeys(order, 1.0)
            for w in reversed(order):
                for v in parents[w]:
                    share = credit[w] * paths[v] / paths[w]
                    credit[v] += share
                    total[min(v, w), max(v, w)] += share / 2
        if not total:
            return out
        high = max(round(x, decimals) for x in total.values())
        gone = [e for e, x in total.items() if round(x, decimals) == high]
        out.append((high, sorted(gone), part))
        for a, b in gone:
            near[a].discard(b)
            near[b].discard(a)


_SEEN = "component string, step int, value double, src string, dst string, id string, community string"


def _spread_removals(placed: DataFrame, decimals: int) -> DataFrame:
    """`_removals` of components too large for a task, as rows of `_SEEN`: each step is one `betweenness` of what is left of all of them."""
    spark, path = placed.sparkSession, f"{shared_dir(placed.sparkSession)}/orebody-{uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    left = cut(placed.select("component", "src", "dst"))
    home = cut(left.select("component", F.explode(F.array("src", "dst")).alias("id")).distinct())
    step = 0
    while not left.isEmpty():
        value = betweenness(left).withColumn("value", F.round("betweenness", decimals)).join(left, ["src", "dst"])
        high = Window.partitionBy("component")
        gone = cut(value.withColumn("high", F.max("value").over(high)).where(F.col("value") == F.col("high")).select("component", "value", "src", "dst"))
        part = home.join(gone.select("component", "value").distinct(), "component").join(components(left).toDF("id", "community"), "id", "left")
        part = part.select("component", "value", "id", F.coalesce("community", "id").alias("community"))
        rows = gone.unionByName(part, allowMissingColumns=True).withColumn("step", F.lit(step))
        rows.select(*[F.col(c).cast(t) for c, t in (x.split() for x in _SEEN.split(", "))]).write.mode("append").parquet(path)
        left = cut(left.join(gone.select("src", "dst"), ["src", "dst"], "left_anti"))
        step += 1
    return spark.read.schema(_SEEN).parquet(path)


def girvan_newman(edges: DataFrame, *, decimals: int = 9, most_edges: int | None = None, task_edges: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """Two tables: (round, src, dst, betweenness) of edges in order of removal, and (id, community) of the best split.

    In each round all edges tied for the largest betweenness of the whole graph go; before it, the
    parts are scored by modularity on the original graph, and the first largest score wins. Edges
    of one component do not bear on another, so components are worked off side by side and their
    rounds merged by value. One component costs edges^2 x vertices by nature of the method: up to
    `task_edges` edges it is one task's work, beyond that each round is spread over all executors.
    With `most_edges`, a component of more edges raises an error before the work begins.
    """
    e = cut(undirected(edges))
    home = cut(components(e))
    placed = cut(e.join(home.toDF("src", "component"), "src"))
    sizes = cut(placed.groupBy("component").agg(F.count("*").alias("n")))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if most_edges is not None and largest > most_edges:
        raise ValueError(f"a component has {largest} edges; at most {most_edges} can be split exactly")

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for step, (value, gone, part) in enumerate(_removals(list(zip(rows["src"], rows["dst"])), decimals)):
            found += [(rows["component"].iloc[0], step, value, a, b, None, None) for a, b in gone]
            found += [(rows["component"].iloc[0], step, value, None, None, v, p) for v, p in part.items()]
        return pd.DataFrame(found, columns=["component", "step", "value", "src", "dst", "id", "community"])

    of_size = lambda fits: placed.join(sizes.where(fits), "component", "left_semi")
    seen = cut(of_size(F.col("n") <= task_edges).groupBy("component").applyInPandas(split, _SEEN))
    if largest > task_edges:
        seen = seen.unionByName(_spread_removals(of_size(F.col("n") > task_edges), decimals))
    own = Window.partitionBy("component").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    steps = seen.select("component", "step", "value").distinct().withColumn("bound", F.min("value").over(own))
    # a step waits for the least value before it in its component; equal values of several components go together
    since = F.sum(F.when(F.col("value") == F.col("bound"), 1).otherwise(0)).over(own)
    steps = steps.withColumn("after", since)
    steps = steps.withColumn("lag", F.row_number().over(Window.partitionBy("component", "after").orderBy("step")) - 1)
    steps = steps.withColumn("round", F.dense_rank().over(Window.orderBy(F.desc("bound"), "lag", F.when(F.col("lag") == 0, F.lit("")).otherwise(F.col("component")))))
    removed = seen.where(F.col("src").isNotNull()).join(steps.select("component", "step", "round"), ["component", "step"]).select("round", "src", "dst", F.col("value").alias("betweenness"))

    # modularity is a sum over communities: each component's part changes only at its own steps
    m = e.count()
    parts = seen.where(F.col("id").isNotNull()).select("component", "step", "id", "community")
    ends = parts.join(e.toDF("id", "other"), "id").join(parts.select("component", "step", F.col("id").alias("other"), F.col("community").alias("c2")), ["component", "step", "other"])
    inner = ends.where(F.col("community") == F.col("c2")).groupBy("component", "step").agg(F.count("*").alias("inner"))
    degree = both_ways(e).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    weight = parts.join(degree, "id").groupBy("component", "step", "community").agg(F.sum("d").alias("d")).groupBy("component", "step").agg(F.sum(F.pow(F.col("d") / (2.0 * m), 2)).alias("expected"))
    score = weight.join(inner, ["component", "step"], "left").select("component", "step", (F.coalesce("inner", F.lit(0)) / F.lit(float(m or 1)) - F.col("expected")).alias("q")).join(steps.select("component", "step", "round"), ["component", "step"])
    change = score.withColumn("dq", F.col("q") - F.lag("q").over(Window.partitionBy("component").orderBy("step")))
    start = score.where("step = 0").agg(F.sum("q").alias("q0")).first()[0] or 0.0
    # a part reached by a step shows when the next step of its component begins
    ready = F.lag("round").over(Window.partitionBy("component").orderBy("step")) + 1
    by_round = change.withColumn("shown", ready).where(F.col("dq").isNotNull()).groupBy(F.col("shown").alias("round")).agg(F.sum("dq").alias("dq"))
    line = steps.select("round").distinct().join(by_round, "round", "left").withColumn("q", F.round(F.lit(start) + F.sum(F.coalesce("dq", F.lit(0.0))).over(Window.orderBy("round")), 9))
    best = line.orderBy(F.desc("q"), "round").limit(1).select(F.col("round").alias("best"))
    shown = parts.join(score.withColumn("shown", F.coalesce(ready, F.lit(1))).select("component", "step", "shown"), ["component", "step"]).join(F.broadcast(best), F.col("shown") <= F.col("best"))
    split_at = shown.groupBy("id").agg(F.max_by("community", "step").alias("community"))
    return removed, split_at
