"""The most similar projects for many requests at once, exactly, without pairing everything.

Score of a project for a request:
    3.0 if country and city match + 1.5 if the country matches
    + 1 / (1 + |difference of ln(length + 0.5)|) + 1 / (1 + 3 |difference of tunnel share|)

Each project is a point (u, v) = (scaled log length, scaled tunnel share) in three groups: its place,
its country and the whole world; the group fixes the first two terms. The points of each group are laid
out along a space-filling curve and cut into blocks of bounded size, and blocks into nodes of bounded
fan-out, so that dense spots simply get more blocks. A request walks down from the root of its three
groups, one join per level: a node that holds at least n projects bounds the n-th best score from below
by its farthest corner, and nodes whose nearest corner scores less are dropped. Only the blocks that are
left are compared project by project.

Nothing is capped: equal points are reduced to their n smallest ids, of which no result needs more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from costweave import fixed_values as fv
from costweave.functions import numbers as num
from costweave.operators.lookup import attach, fits_broadcast, salted_attach
from costweave.session import reuse

BLOCK_POINTS = 16
FAN_OUT = 16
PART_POINTS = 4_000_000
# Blocks are about 1 KB each; this many may be broadcast.
BROADCAST_BLOCKS = 10_000
# A node is a list of boxes of 48 bytes, most nodes have a few: some 10 MB in all.
BROADCAST_NODES = 100_000
# Scores are compared at this resolution, so that the last bit of a logarithm decides nothing.
SCORE_DECIMALS = 9
SLACK = 1e-8


@dataclass(frozen=True)
class SimilarityWeights:
    """Weights must not be negative."""

    place: float = fv.LOCATION_WEIGHT
    country: float = fv.COUNTRY_WEIGHT
    length_scale: float = fv.LENGTH_SCALE
    tunnel_scale: float = fv.TUNNEL_SCALE
    length_clamp: float = fv.LENGTH_CLAMP

    @property
    def max_score(self) -> float:
        return self.place + self.country + 2.0

    @property
    def by_tier(self) -> list[float]:
        return [self.place + self.country, self.country, 0.0]


def similarity_score(w: SimilarityWeights, same_place, same_country, length, other_length, tunnel, other_tunnel) -> Column:
    """The score of one pair; NULL when a length or a tunnel share is missing."""
    far = F.abs(F.ln(length + w.length_clamp) - F.ln(other_length + w.length_clamp)) * w.length_scale
    deep = F.abs(tunnel - other_tunnel) * w.tunnel_scale
    score = (
        F.when(same_place, w.place).otherwise(0.0) + F.when(same_country, w.country).otherwise(0.0)
        + 1 / (1 + far) + 1 / (1 + deep)
    )
    return F.round(score, SCORE_DECIMALS)


def _part(value: Column) -> Column:
    """A text part that cannot run into its neighbours."""
    return F.concat(F.length(value).cast("string"), F.lit(":"), value)


def _place_key(country: Column, city: Column) -> Column:
    return F.concat(F.lit("P"), _part(country), _part(city))


def _country_key(country: Column) -> Column:
    return F.concat(F.lit("C"), _part(country))


def _groups(country: Column, city: Column) -> Column:
    """The groups of a row: place, country, world. Missing names leave out their groups."""
    slot = lambda tier, key: F.struct(F.lit(tier).alias("tier"), key.alias("grp"))
    slots = F.array(
        slot(0, _place_key(country, city)), slot(1, _country_key(country)), slot(2, F.lit("W"))
    )
    return F.filter(slots, lambda s: s["grp"].isNotNull())


def _with_point(df: DataFrame, w: SimilarityWeights) -> DataFrame:
    usable = (F.col("length_km") > -w.length_clamp) & F.col("tunnel_pct").isNotNull()
    return df.filter(usable).withColumns({
        "u": F.ln(F.col("length_km") + w.length_clamp) * w.length_scale,
        "v": F.col("tunnel_pct") * w.tunnel_scale,
    })


def _curve_position(u: Column, v: Column) -> Column:
    """Bits of two 16-bit grid positions interleaved: near points mostly get near numbers."""
    def spread(x: Column) -> Column:
        grid = F.least(F.greatest(F.floor(x * 1024) + 32768, F.lit(0)), F.lit(65535)).cast("bigint")
        for shift, mask in [(8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)]:
            grid = grid.bitwiseOR(F.shiftleft(grid, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
        return grid
    return spread(u).bitwiseOR(F.shiftleft(spread(v), 1))


@dataclass
class _Index:
    blocks: DataFrame        # grp, node, points: array of at most BLOCK_POINTS projects
    nodes: DataFrame         # level, grp, node, children: array of at most FAN_OUT nodes one level down
    height: int              # the level of the roots; blocks are level 0


def _build_index(projects: DataFrame, project_id: str, n: int, w: SimilarityWeights, block_points: int, fan_out: int) -> _Index:
    spark = projects.sparkSession
    slim = projects.select(
        F.col(project_id).alias("pid"), "country", "city",
        F.col("length_km").cast("double").alias("length_km"), F.col("tunnel_pct").cast("double").alias("tunnel_pct"),
    )
    points = _with_point(slim, w).withColumn("_g", F.explode(_groups(F.col("country"), F.col("city"))))
    # what a closer group is told apart by: the city within a country, the country within the world
    points = points.select(
        "_g.*", "pid", "length_km", "tunnel_pct", "u", "v",
        F.when(F.col("_g.tier") == 1, F.col("city")).when(F.col("_g.tier") == 2, F.col("country")).alias("name"),
    )
    # A ranked limit is applied before the shuffle too, so heaps of equal points never meet in a task.
    copies = Window.partitionBy("grp", "length_km", "tunnel_pct").orderBy("pid")
    points = points.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= n).drop("_copy")

    rows = 3 * slim.count()
    parts = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(rows / 10_000)), math.ceil(rows / PART_POINTS))
    order = ["grp", "_curve", "pid"]
    laid_out = (
        points.withColumn("_curve", _curve_position(F.col("u"), F.col("v")))
        .repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .withColumn("_in_part", F.col("_seq").bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumns({
            "_part": F.shiftright("_seq", 33),
            "_block": F.floor(F.col("_in_part") / block_points),
        })
    )
    boxes = [F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1")]
    blocks = reuse(
        laid_out.groupBy("grp", "_part", "_block").agg(
            F.collect_list(F.struct("pid", "name", "length_km", "tunnel_pct")).alias("points"),
            F.count(F.lit(1)).alias("n"), *boxes,
        )
    )
    # blocks are numbered part by part, each part starting at a multiple of a power of the fan-out
    most = blocks.agg(F.max("_block"), F.max("_part")).first()
    per_part, height = 1, 0
    while per_part <= (most[0] or 0):
        per_part *= fan_out
        height += 1
    span = per_part * ((most[1] or 0) + 1)
    while per_part < span:
        per_part *= fan_out
        height += 1
    in_part = 1
    while in_part <= (most[0] or 0):
        in_part *= fan_out
    numbered = blocks.withColumn("node", F.col("_part") * in_part + F.col("_block")).drop("_part", "_block")

    # all levels in one go: a block counts for each of its ancestors, partial sums do the rest
    box = ["n", "u0", "u1", "v0", "v1"]
    width = F.element_at(F.array(*[F.lit(fan_out ** i).cast("bigint") for i in range(height)]), F.col("level") + 1)
    flat = (
        numbered.select("grp", "node", *box, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("level"))
        .groupBy("grp", "level", F.floor(F.col("node") / width).alias("node"))
        .agg(F.sum("n").alias("n"), F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.min("v0").alias("v0"), F.max("v1").alias("v1"))
    ) if height else numbered.select("grp", F.lit(0).alias("level"), "node", *box)
    nodes = reuse(
        flat.groupBy("grp", (F.col("level") + 1).alias("level"), F.floor(F.col("node") / fan_out).alias("parent"))
        .agg(F.collect_list(F.struct("node", *box)).alias("children"))
        .withColumnRenamed("parent", "node")
    )
    return _Index(numbered.select("grp", "node", "points"), nodes, height)


def _distance(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low - x, x - high, F.lit(0.0))


def _reach(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(x - low, high - x)


def _descend(queries: DataFrame, index: _Index, n: int, w: SimilarityWeights, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """(_n, asked, ..., grp, node, bound): the blocks that may hold one of the n best projects of query _n.

    `asked` is the query's name of a closer group: the city in the country's group, the country in the world's. A
    frontier row drops the children that its own node rules out before they are spread over rows, so the shuffle
    by query sees few of them. Without broadcast each level's frontier is stored by the lookup, so the plan of a
    level stands on one table.
    """
    base = F.element_at(F.array(*[F.lit(b) for b in w.by_tier]), F.col("tier") + 1)
    asked = F.when(F.col("_g.tier") == 1, F.col("q_city")).when(F.col("_g.tier") == 2, F.col("q_country"))
    frontier = queries.withColumn("_g", F.explode(_groups(F.col("q_country"), F.col("q_city")))).select(
        "_n", asked.alias("asked"), "q_length", "q_tunnel", "_g.*",
        F.lit(0).cast("bigint").alias("node"), F.lit(-1.0).alias("bound"),
    )
    all_of_query = Window.partitionBy("_n")
    keep = frontier.columns
    score = lambda away, c: (
        F.col("_base") + 1 / (1 + away(F.col("u"), c["u0"], c["u1"])) + 1 / (1 + away(F.col("v"), c["v0"], c["v1"]))
    )
    sure = lambda c: F.when(c["n"] >= n, score(_reach, c))
    near = lambda c: score(_distance, c) >= F.col("bound") - SLACK
    small = fits_broadcast(index.nodes, broadcast_nodes)
    for level in range(index.height, 0, -1):
        nodes = index.nodes.filter(F.col("level") == level).drop("level")
        on = ["grp", "node"]
        joined = frontier.join(F.broadcast(nodes), on) if small else salted_attach(frontier, nodes, on, "inner")
        scored = joined.withColumns({
            "u": F.ln(F.col("q_length") + w.length_clamp) * w.length_scale, "v": F.col("q_tunnel") * w.tunnel_scale, "_base": base,
        })
        bounded = scored.withColumn("bound", F.greatest("bound", F.array_max(F.transform("children", sure))))
        children = bounded.withColumn("_c", F.explode(F.filter("children", near))).select(
            *[c for c in keep if c != "node"], F.col("_c.node").alias("node"), score(_distance, F.col("_c")).alias("_best"),
        )
        best_bound = children.withColumn("bound", F.max("bound").over(all_of_query))
        frontier = best_bound.filter(F.col("_best") >= F.col("bound") - SLACK).select(*keep)
    return frontier


def similar_projects(
    requests: DataFrame,
    projects: DataFrame,
    n: int = fv.SIMILAR_PROJECTS,
    id_col: str = "request_id",
    project_id: str = "project_id",
    weights: SimilarityWeights = SimilarityWeights(),
    block_points: int = BLOCK_POINTS,
    fan_out: int = FAN_OUT,
    broadcast_nodes: int = BROADCAST_NODES,
    broadcast_blocks: int = BROADCAST_BLOCKS,
) -> DataFrame:
    """(id, rank, project, score, match_percent, same_place) and the projects' columns, n per request.

    Ties go to the smaller project id. Projects and requests without length or tunnel share have no score.
    Requests that ask the same are searched once.
    """
    keyed = requests.select(
        F.col(id_col), F.col("country").alias("q_country"), F.col("city").alias("q_city"),
        F.col("length_km").cast("double").alias("length_km"), F.col("tunnel_pct").cast("double").alias("tunnel_pct"),
    )
    text = lambda c: F.coalesce(_part(F.col(c).cast("string")), F.lit("-"))
    keyed = _with_point(keyed, weights).withColumn(
        "_q", F.concat(text("q_country"), text("q_city"), text("length_km"), text("tunnel_pct"))
    ).withColumnsRenamed({"length_km": "q_length", "tunnel_pct": "q_tunnel"})
    keyed = reuse(keyed)  # asked twice: for the queries, and for their answers
    # a number for each query: it is what the search shuffles
    queries = reuse(keyed.drop(id_col).distinct().withColumn("_n", F.monotonically_increasing_id()))

    # a block bounds the n-th best score only if it holds n projects
    index = _build_index(projects, project_id, n, weights, max(block_points, 2 * n), fan_out)
    reached = reuse(_descend(queries, index, n, weights, broadcast_nodes))
    candidates = attach(reached, index.blocks, ["grp", "node"], "inner", broadcast_rows=broadcast_blocks)
    candidates = candidates.withColumn("_p", F.explode("points")).select(
        "_n", "tier", "bound", "asked", "q_length", "q_tunnel", "_p.*"
    )
    # a project is taken from the closest group it shares with the request, and only from that one
    in_closer_group = F.coalesce(F.col("name") == F.col("asked"), F.lit(False))
    candidates = candidates.filter(~in_closer_group).withColumn("score", similarity_score(
        weights, F.col("tier") == 0, F.col("tier") <= 1,
        F.col("length_km"), F.col("q_length"), F.col("tunnel_pct"), F.col("q_tunnel"),
    )).filter(F.col("score") >= F.col("bound") - SLACK).withColumn("same_place", F.col("tier") == 0)

    best = Window.partitionBy("_n").orderBy(F.desc("score"), F.col("pid"))
    top = (
        candidates.select("_n", "pid", "score", "same_place")
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    )
    answers = reuse(top.groupBy("_n").agg(
        F.collect_list(F.struct("rank", F.col("pid").alias(project_id), "score", "same_place")).alias("_answer")
    ))
    answers = reuse(attach(queries.select("_q", "_n"), answers, ["_n"], "inner").select("_q", "_answer"))
    found = attach(keyed.select(id_col, "_q"), answers, ["_q"], "inner").select(
        id_col, F.explode("_answer").alias("_a")
    ).select(id_col, "_a.*", num.match_percent(F.col("_a.score"), weights.max_score).alias("match_percent"))
    return found


def with_project_columns(found: DataFrame, projects: DataFrame, columns: list[str], project_id: str = "project_id") -> DataFrame:
    """Add project columns to the found ids."""
    return attach(found, projects.select(project_id, *columns), [project_id], "inner")
