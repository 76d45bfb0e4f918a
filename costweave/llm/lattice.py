"""Near-duplicate vectors by lattice hashing.

A vector's direction is projected to eight dimensions by a random matrix, once a table, and decoded to the
nearest point of the E8 lattice: its cell. It is filed under that cell and looked up there and in the cells of
the next-nearest lattice points. Pairs that meet are verified by their cosine in double precision. Equal vectors
are one class from the start, so copies are never paired with each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costweave.llm import textops
from costweave.llm.shared import components
from costweave.session import reuse

TABLES = 8
PROBES = 6  # neighbouring cells looked up in each table
SCALE = 1.5  # lattice units a projected unit vector is spread over
LEAST_COSINE = 0.98
SEED = 1729


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    near = np.rint(x)
    odd = near.sum(axis=1) % 2 != 0
    if odd.any():
        rest = x[odd] - near[odd]
        at = np.abs(rest).argmax(axis=1)
        rows = np.flatnonzero(odd)
        near[rows, at] += np.where(rest[np.arange(len(rows)), at] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point of each row: of D8, or of D8 moved by a half in all coordinates."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def _roots() -> np.ndarray:
    """The 240 shortest lattice vectors."""
    out = []
    for a in range(8):
        for b in range(a + 1, 8):
            for sa in (1, -1):
                for sb in (1, -1):
                    v = np.zeros(8)
                    v[a], v[b] = sa, sb
                    out.append(v)
    for bits in range(256):
        v = np.where([(bits >> k) & 1 for k in range(8)], -0.5, 0.5)
        if bits.bit_count() % 2 == 0:
            out.append(v)
    return np.array(out)


ROOTS = _roots()


def _name(points: np.ndarray) -> np.ndarray:
    """Hash of lattice points; doubled, they are integers."""
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    out = np.zeros(len(points), np.uint64)
    for k in range(8):
        out = textops.mix(out * np.uint64(0x9E3779B97F4A7C15) + doubled[:, k])
    return out.view(np.int64)


def cells(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE):
    """For every table: (table, home cell, neighbouring cells) of the rows of vectors (not zero)."""
    length = np.abs(vectors).max(axis=1, keepdims=True)
    unit = vectors / length
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for table in range(tables):
        random = np.random.default_rng([SEED, table, vectors.shape[1]])
        projected = unit @ random.normal(size=(vectors.shape[1], 8)) * scale + random.uniform(0, 2, 8)
        home = nearest_e8(projected)
        # distance to home + root: the larger the product with the root, the nearer
        near = np.argsort(-((projected - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
        yield table, _name(home), np.stack([_name(home + ROOTS[near[:, k]]) for k in range(probes)], axis=1) if probes else None


def _file(tables: int, probes: int, scale: float):
    def run(frames):
        for frame in frames:
            for _, same in frame.groupby("size", sort=False):
                vectors = np.array(same["embedding"].tolist(), np.float64)
                for low in range(0, len(same), 2_000):
                    part = same.iloc[low : low + 2_000]
                    for table, home, near in cells(vectors[low : low + 2_000], tables, probes, scale):
                        both = [(home, True)] + [(near[:, k], False) for k in range(probes)]
                        for cell, is_home in both:
                            yield pd.DataFrame({
                                "label": part["label"].to_numpy(), "size": part["size"].to_numpy(), "spot": table,
                                "cell": cell, "home": is_home, "head": part["head"].to_numpy(),
                            })

    return run


def similar_pairs(classes: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """Pairs (a, b) of classes (head, label, size, embedding of doubles) with cosine of at least `least`, a < b, once each."""
    filed = classes.select("label", "size", "embedding", "head").mapInPandas(
        _file(tables, probes, scale), "label long, size int, spot int, cell long, home boolean, head long"
    )
    filed = reuse(filed)
    key = ["label", "size", "spot", "cell"]
    homes = filed.where("home").select(*key, F.col("head").alias("a"))
    visits = filed.select(*key, F.col("head").alias("b"), "home")
    met = homes.join(visits, key).where("a <> b and (not home or a < b)").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    vectors = classes.select("head", "embedding", norm.alias("norm"))
    one = vectors.select(F.col("head").alias("a"), F.col("embedding").alias("va"), F.col("norm").alias("na"))
    two = vectors.select(F.col("head").alias("b"), F.col("embedding").alias("vb"), F.col("norm").alias("nb"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return met.join(one, "a").join(two, "b").where(dot / F.col("na") / F.col("nb") >= least).select("a", "b")


def near_duplicates(rows: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not NULL and their sizes are equal. A vector that is
    NULL, empty or zero, holds NULL or non-finite components, or has no vec_id links with nothing; without
    vec_id it has no component and is not kept. Rows with equal vectors and labels link with each other, and
    repeated rows count as often as they are there. Other columns are not read.
    """
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("label"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    usable = usable & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    mark = [F.xxhash64("embedding"), F.hash("embedding").cast("long")]
    rows = rows.withColumn("mark", F.when(usable, F.struct("label", *[m.alias(f"m{k}") for k, m in enumerate(mark)], F.size("embedding").alias("size"))))
    classes = reuse(
        rows.where("mark is not null").groupBy("mark").agg(
            F.min("vec_id").alias("head"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"),
        ).select("mark", "head", "copies", "embedding", F.col("mark.label").alias("label"), F.col("mark.size").alias("size"))
    )
    pairs = reuse(similar_pairs(classes, least, tables, probes, scale))
    copies = classes.select(F.col("head").alias("other"), "copies")
    both = pairs.select(F.col("a").alias("head"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("head"), F.col("a").alias("other"))
    )
    links = both.join(copies, "other").groupBy("head").agg(F.sum("copies").alias("links"))
    found = components(pairs).withColumnRenamed("id", "head")
    told = classes.select("mark", "head", "copies").join(links, "head", "left").join(found, "head", "left").select(
        "mark", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "head").alias("component_id"),
    )
    out = rows.select("vec_id", "mark").join(told, "mark", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
