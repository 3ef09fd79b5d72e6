"""Near-duplicate embeddings by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayread.llm.blocks import Forest, tile_pairs
from wayread.llm.common import settle
from wayread.llm.components import connected

#: Distinct vectors in a tile, and rows of a tile compared at a time.
TILE, STRIP = 2048, 256
#: Dimensions accumulated before each look at the bound.
STEPS = (8, 24)
FOUND = "a long, b long, n long"


def _vectors(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes, the strongest first, of the unit vectors of each dimension.

    Products of components are summed in tasks and then by Spark; dims x dims sums reach the driver, over all rows.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch["dims"].to_numpy()
            for d in np.unique(dims):
                x = _unit(_vectors(batch.filter(pa.array(dims == d))["vector"]))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            i, j = np.indices(m.shape)
            yield pa.RecordBatch.from_pydict({"dims": np.full(m.size, d, np.int32), "i": i.ravel().astype(np.int32),
                                              "j": j.ravel().astype(np.int32), "v": m.ravel()})

    rows = vectors.select("dims", "vector").mapInArrow(products, "dims int, i int, j int, v double")
    axes: dict[int, np.ndarray] = {}
    for r in rows.groupBy("dims", "i", "j").agg(F.sum("v").alias("v")).collect():
        axes.setdefault(r["dims"], np.zeros((r["dims"], r["dims"])))[r["i"], r["j"]] = r["v"]
    return {d: np.linalg.eigh((m + m.T) / 2)[1][:, ::-1] for d, m in axes.items()}


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``a`` and ``b`` with cosine >= ``least``, strip by strip of ``a``.

    Along the axes, the products of leading dimensions are summed first. What the others can add is at most the product
    of the two suffix norms; a pair stops as soon as its sum and that bound stay under ``least``. What is left is measured
    on the vectors as they came.
    """
    slack = 1e-9
    along_a, along_b = _unit(a) @ axes, _unit(b) @ axes
    norm_a, norm_b = np.sqrt(np.einsum("ij,ij->i", a, a)), np.sqrt(np.einsum("ij,ij->i", b, b))
    steps = [s for s in STEPS if s < a.shape[1]] or [a.shape[1]]
    tail = lambda x, s: np.sqrt(np.einsum("ij,ij->i", x[:, s:], x[:, s:]))
    tails = [(tail(along_a, s), tail(along_b, s)) for s in steps]
    for at in range(0, len(a), STRIP):
        strip = along_a[at:at + STRIP]
        sums = strip[:, :steps[0]] @ along_b[:, :steps[0]].T
        i, j = np.nonzero(sums + tails[0][0][at:at + STRIP, None] * tails[0][1][None, :] >= least - slack)
        part = sums[i, j]
        for k in range(1, len(steps)):
            lo, hi = steps[k - 1], steps[k]
            part = part + np.einsum("ij,ij->i", strip[i, lo:hi], along_b[j, lo:hi])
            stay = part + tails[k][0][at + i] * tails[k][1][j] >= least - slack
            i, j, part = i[stay], j[stay], part[stay]
        i = i + at
        for cut in range(0, len(i), 65536):
            x, y = i[cut:cut + 65536], j[cut:cut + 65536]
            near = np.einsum("ij,ij->i", a[x], b[y]) / (norm_a[x] * norm_b[y]) >= least
            yield x[near], y[near]


def near_duplicates(rows: DataFrame, least: float = 0.93, tile: int = TILE) -> DataFrame:
    """``rows`` (vec_id, embedding, label) -> vec_id, n_links, component_id, kept, one row each.

    Only vectors of one label and length are compared. Copies of a vector are one class, compared once and counted as
    often as they come. Classes of a label meet tile by tile; a task gives each class the sum of its links and only those
    links that join what it had not joined yet, so no list of all pairs exists.

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing: 0 links,
    their own component, kept. Repeated rows are vectors of their own; rows with null ids count like others but do not
    name a component. An empty table gives no rows. Other columns are not looked at.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    fit = F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.select("vec_id", "label", F.when(fit, F.transform("embedding", lambda x: x.cast("double"))).alias("vector"))
    fits = rows.where(F.col("vector").isNotNull())
    classes = fits.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("times"))
    classes = settle(classes.where(F.col("first").isNotNull()).withColumn("dims", F.size("vector"))
                     .withColumn("grp", F.xxhash64("label", "dims")))
    axes = principal_axes(classes)

    def compare(group: pa.Table) -> pa.Table:
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        mine, kinds = group["mine"].to_numpy(), group["kind"].to_pylist()
        out: list[tuple] = []
        for kind in set(kinds):  # one label and length, but for clashes of the group's hash
            same = np.array([k == kind for k in kinds])
            x, y = (group.filter(pa.array(same & (mine == t))) for t in (low, high))
            if not len(x) or not len(y):
                continue
            ids = np.concatenate([x["first"].to_numpy(), y["first"].to_numpy()])
            times = x["times"].to_numpy(), y["times"].to_numpy()
            a, b = _vectors(x["vector"]), _vectors(y["vector"])
            links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            for i, j in close_pairs(a, b, axes[a.shape[1]], least):
                if low == high:  # a tile with itself: each pair once
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, times[1][j])
                np.add.at(links, (j if low == high else j + len(a)), times[0][i])
                for p, q in zip(i.tolist(), (j if low == high else j + len(a)).tolist()):
                    forest.link(p, q)
            some = np.flatnonzero(links)
            out += [(ids[p], None, links[p]) for p in some] + [(ids[p], ids[q], None) for p, q in forest.links]
        columns = list(zip(*out)) or [()] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip("abn", columns)})

    tiles = tile_pairs(classes.withColumn("kind", F.concat_ws(" ", "label", "dims")), "grp", "first", tile)
    found = settle(tiles.select("grp", "low", "high", "mine", "kind", "first", "times", "vector").groupBy("grp", "low", "high").applyInArrow(compare, FOUND))
    links = found.where("n is not null").groupBy(F.col("a").alias("first")).agg(F.sum("n").alias("n"))
    parts = connected(found.where("n is null").select("a", "b")).withColumnRenamed("node", "first")
    facts = settle(classes.join(links, "first", "left").join(parts, "first", "left").select(
        F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "first").alias("component")))
    joined = rows.join(facts, (rows.label == facts.l) & (rows.vector == facts.v), "left")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))
