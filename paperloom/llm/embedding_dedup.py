"""Near-duplicate vectors by Euclidean p-stable hashing.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. A table's key is made of `projections` quantised Gaussian
projections floor((a.x + b) / width); vectors that share the key of any of the tables are candidates if the signs of 64
further projections, carried with the key, differ in at most SKETCH_BITS places (pairs at the threshold differ in 4, and in
more than 16 once in a million; unlike ones in 32). Ids and keys alone are dealt for that; candidates are taken once,
and then their vectors are fetched and their cosines computed in double precision. No link is below the threshold.

Keys grow with the rows of the largest label, so that chance meetings of a vector stay as few: a projection more for every
three times as many rows, and as many tables as leave the share of pairs that are found at the threshold at RECALL.

Vectors are scaled by their largest component first, so that no square overflows or vanishes. Equal vectors of a label
form one class and are counted, not joined pair by pair.

Vectors that are null, empty, all zero or hold a null or a component that is not finite, and vectors without a
label, link with nothing: n_links 0, their own component. Vectors of different lengths never link. Repeated
vec_ids are separate rows of one id, each with the links of its own vector. Rows with a null vec_id link like others and are counted, but
name no component; one without links to rows that have an id has a null component and is kept. An empty table gives no rows; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.common import map_batches
from paperloom.llm.components import components
from paperloom.scratch import discard, written

COSINE, RECALL, WIDTH, SEED = 0.98, 0.999, 1.3, 20240229
LEAST_PROJECTIONS, FEW_ROWS = 8, 2_000  #: projections of a key for up to so many rows of a label
SKETCH_BITS = 16


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors at a distance share a quantised projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def key_sizes(rows: int, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Tables and projections for so many rows of the largest label."""
    unlike = collision(math.sqrt(2), width)
    projections = LEAST_PROJECTIONS + math.ceil(max(0.0, math.log(max(1, rows) / FEW_ROWS) / -math.log(unlike)))
    shared = collision(math.sqrt(2 - 2 * cosine), width) ** projections
    return math.ceil(math.log(1 - recall) / math.log(1 - shared)), projections


def table_keys(vectors: np.ndarray, tables: int, projections: int, width: float, seed: int) -> np.ndarray:
    """Rows x tables of 32-bit keys; the projections depend on the vectors' length and the seed alone."""
    rng = np.random.default_rng([seed, vectors.shape[1]])
    a = rng.standard_normal((vectors.shape[1], tables * projections))
    b = rng.uniform(0, width, tables * projections)
    cells = np.floor((vectors @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(vectors), tables, projections)
    key = np.zeros(cells.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for k in range(projections):
            key = (key ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def stacked(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of an Arrow list column by length: their positions and values as doubles."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return {int(n): (rows := np.flatnonzero(lengths == n), flat[starts[rows][:, None] + np.arange(n)]) for n in np.unique(lengths)}


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def sketches(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Signs of 64 projections."""
    a = np.random.default_rng([seed, vectors.shape[1], 1]).standard_normal((vectors.shape[1], 64))
    return np.packbits(vectors @ a > 0, axis=1).view(np.int64)[:, 0]


def candidates(classes: DataFrame, tables: int, projections: int, width: float, seed: int) -> DataFrame:
    """Pairs (u, v) of classes (node, label, embedding) of one label and length that share a key and most of their signs."""

    def work(batch):
        keys, signs, size = np.zeros((batch.num_rows, tables), np.int32), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
        for rows, x in stacked(batch.column("embedding")).values():
            x = unit(x)
            keys[rows], signs[rows], size[rows] = table_keys(x, tables, projections, width, seed), sketches(x, seed), x.shape[1]
        each = np.repeat(np.arange(batch.num_rows), tables)
        return {"label": batch.column("label").take(pa.array(each)), "t": np.tile(np.arange(tables, dtype=np.int32), batch.num_rows), "key": keys.ravel(), "size": size[each], "node": batch.column("node").take(pa.array(each)), "signs": signs[each]}

    label = classes.schema["label"].dataType.simpleString()
    keyed = map_batches(classes.select("node", "label", "embedding"), lambda: work, f"label {label}, t int, key int, size int, node binary, signs long")
    shared = ["label", "t", "key", "size"]
    a, b = (keyed.select(*shared, F.col("node").alias(x), F.col("signs").alias(f"{x}_signs")) for x in "uv")
    near = F.bit_count(F.col("u_signs").bitwiseXOR(F.col("v_signs"))) <= SKETCH_BITS
    return a.join(b, shared).filter((F.col("u") < F.col("v")) & near).select("u", "v").distinct()


def linked(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(u, v, n_u, n_v) of the pairs (u, v) whose cosine is at least `cosine`."""

    def work(batch):
        keep = np.zeros(batch.num_rows, bool)
        left, right = stacked(batch.column("a")), stacked(batch.column("b"))
        for n, (rows, x) in left.items():
            keep[rows] = np.einsum("ij,ij->i", unit(x), unit(right[n][1])) >= cosine
        return {c: batch.column(c).filter(pa.array(keep)) for c in ("u", "v", "n_u", "n_v")}

    own = lambda x, e: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("embedding").alias(e))
    return map_batches(pairs.join(own("u", "a"), "u").join(own("v", "b"), "v"), lambda: work, "u binary, v binary, n_u long, n_v long")


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, recall: float = RECALL, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    # Equal vectors of one label are a node, known by its digest: rows of one id may have several vectors, and an id may be null.
    node = F.when(usable, F.unhex(F.md5(F.concat_ws("/", F.col("label").cast("string"), F.col("embedding").cast("string")))))
    rows = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", node.alias("node")), "vectors")
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.first("label").alias("label"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = written(classes, "vector-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, projections = key_sizes(largest, cosine, recall, width)
    pairs = written(candidates(classes, tables, projections, width, seed), "vector-pairs")
    links = written(linked(pairs, classes, cosine), "vector-links")
    discard(pairs)
    found = components(links)
    sides = links.selectExpr("u node", "n_v n").union(links.selectExpr("v node", "n_u n"))
    degree = sides.groupBy("node").agg(F.sum("n").alias("outside"))
    named = classes.select("node", "rep", "n").join(degree, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named.select("node", "component", "rep", (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links")), "vector-named")
    # A component is named by the smallest id in it.
    least = written(named.groupBy("component").agg(F.min("rep").alias("component_id")), "vector-least")
    named = written(named.join(least, "component").select("node", "n_links", "component_id"), "vector-links-of-nodes")
    discard(classes, links, found, least)
    out = rows.select("vec_id", "node").join(named, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = f"""
WITH RECURSIVE usable AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
scaled AS (SELECT vec_id, label, len(e) AS n, e, sqrt(list_dot_product(e, e)) AS size FROM usable WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM scaled a JOIN scaled b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.size * b.size) >= {COSINE}),
reached(node, root) AS (SELECT u, u FROM links UNION SELECT v, root FROM reached JOIN links ON u = node),
least AS (SELECT node, min(root) AS root FROM reached GROUP BY 1),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept FROM embeddings LEFT JOIN counted ON u = vec_id LEFT JOIN least ON node = vec_id
"""
