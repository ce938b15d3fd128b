"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= c have squared distance <= 2 - 2c. The vectors are rotated (the axes of a bounded sample's
second moments) and their axes dealt to blocks; each block gets a share of the squared distance, in proportion to
its spread, so a pair in reach keeps to the budget in one block at least. Each block is range-joined on its own: a grid over
its widest axes, cells as wide as the block's diameter, a vector at home in one cell and present in all that its
ball meets. A pair counts in the first block whose budget it keeps, and only after its cosine is computed exactly, so
it counts once. More axes are gridded the more vectors there are; a crowded cell is dealt to tasks by pairs of chunks.

Equal vectors of a label are one class, compared once and counted as many. Tasks return a count per vector and star
edges, never pairs. Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with
nothing; nor do vectors of different lengths. An empty table gives an empty result. Rows with equal vec_id count as
vectors of their own and share a row each.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stayline.llm.common import components, reliable

COSINE = 0.98
BLOCKS = 4
#: vectors of the sample that chooses the axes (an expected number); results do not depend on it
SAMPLE = 4000
#: vectors that a task compares with as many others
CHUNK = 2000
MOST_AXES = 5


def axes_of(sample: np.ndarray, blocks: int, reach: float) -> dict:
    """Rotation, the axes of each block (widest first), and each block's radius."""
    dims = sample.shape[1]
    spread, turn = np.linalg.eigh(sample.T @ sample / max(1, len(sample)) + 1e-9 * np.eye(dims))
    order = np.argsort(-spread, kind="stable")
    dealt = [order[b::blocks] for b in range(min(blocks, dims))]
    share = np.array([spread[a].sum() for a in dealt])
    budget = reach * share / share.sum()
    width = [np.sqrt(spread[a]) for a in dealt]
    return {"turn": turn, "axes": dealt, "budget": budget, "radius": np.sqrt(budget), "width": width}


def grid_axes(plan: dict, n: int, most: int = MOST_AXES) -> list[int]:
    """How many axes of each block to grid so that a cell of n vectors holds about CHUNK."""
    out = []
    for width, radius in zip(plan["width"], plan["radius"]):
        cells, g = 1.0, 0
        while g < min(most, len(width)) and n / cells > CHUNK:
            cells *= max(1.0, 4.1 * width[g] / (2 * radius))  # the perplexity of a normal spread, in cells
            g += 1
        out.append(g)
    return out


def unit(rows: list, dims: int) -> np.ndarray:
    x = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    scale = np.abs(x).max(1, keepdims=True)
    x /= scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def block_distances(x: np.ndarray, y: np.ndarray, plan: dict) -> np.ndarray:
    """Squared distance in each block of paired rows, the same whatever the order of the two."""
    d = (x - y) ** 2
    return np.stack([d[:, a].sum(1) for a in plan["axes"]], 1)


def compared(home: np.ndarray, there: np.ndarray, plan: dict, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (home, present) that link and count in this block; rows are rotated unit vectors."""
    axes, slack = plan["axes"][block], 1e-9
    b = there[:, axes]
    found = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(home), 512):
        a = home[at : at + 512][:, axes]
        near = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T <= plan["budget"][block] + slack
        i, j = np.nonzero(near)
        for s in range(0, len(i), 200_000):
            p, q = i[s : s + 200_000] + at, j[s : s + 200_000]
            kept = block_distances(home[p], there[q], plan) <= plan["budget"] + slack
            first = kept[:, block] & ~kept[:, :block].any(1)
            p, q = p[first], q[first]
            link = np.einsum("ij,ij->i", home[p], there[q]) >= cosine
            found.append(np.stack([p[link], q[link]], 1))
    got = np.concatenate(found)
    return got[:, 0], got[:, 1]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b) and the smallest node that each reaches in them."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def near_vectors(vectors: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    able = F.coalesce(F.col("label").isNotNull() & good, F.lit(False))
    keyed = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), able.alias("able")
    )
    keyed = keyed.withColumn("k1", F.xxhash64("label", "embedding")).withColumn("k2", F.xxhash64(F.lit("k"), "embedding", "label"))
    classes = reliable(
        keyed.where("able")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("v"))
    )
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    total, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if most:
        part = min(1.0, SAMPLE / total)
        sample = classes.where(F.pmod(F.col("k1"), F.lit(1 << 20)) < max(1, int(part * (1 << 20)))).select("v").toPandas()["v"].tolist()
        plan = axes_of(unit(sample, dims) if sample else np.zeros((1, dims)), blocks, 2 - 2 * cosine)
        found = reliable(_found(classes, plan, dims, most, cosine))
    else:
        found = vectors.sparkSession.createDataFrame([], "node long, links long, root long")
    links = found.where("root IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = (
        classes.select("k1", "k2", "rep", "copies")
        .join(links.withColumnRenamed("node", "rep"), "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    alone = keyed.where(~F.col("able")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rest = keyed.where("able").select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    return rest.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _found(classes: DataFrame, plan: dict, dims: int, most: int, cosine: float) -> DataFrame:
    gridded = grid_axes(plan, most)

    def cells(batches):
        for pdf in batches:
            x = unit(pdf["v"].tolist(), dims) @ plan["turn"]
            base = pdf[["rep", "copies", "v"]].assign(key=pdf["label"] + "/" + pdf["v"].map(len).astype(str))
            for block, g in enumerate(gridded):
                axes, r = plan["axes"][block][:g], plan["radius"][block] * (1 + 1e-9) + 1e-12
                low = np.floor((x[:, axes] - r) / (2 * r)).astype(np.int64)
                home = np.floor(x[:, axes] / (2 * r)).astype(np.int64)
                for step in itertools.product((0, 1), repeat=g):
                    cell = low + np.array(step, np.int64).reshape(1, -1)
                    fits = (cell * 2 * r <= x[:, axes] + r).all(1)
                    out = base.assign(block=block, cell=[",".join(map(str, c)) for c in cell.tolist()], home=(cell == home).all(1))
                    yield out[fits]

    rows = reliable(
        classes.select("rep", "copies", "label", "v").mapInPandas(cells, "rep long, copies long, v array<double>, key string, block int, cell string, home boolean")
    )
    cell = ["key", "block", "cell"]
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("homes")).where("homes > 0 AND n > 1")
    k = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    every = F.sequence(F.lit(0), F.col("k") - 1)
    held = rows.join(sizes, cell).withColumn("k", k).withColumn("own", own)
    as_home = held.where("home").select(*cell, "rep", "copies", "v", F.lit(True).alias("at_home"), F.col("own").alias("i"), F.explode(every).alias("j"))
    as_there = held.select(*cell, "rep", "copies", "v", F.lit(False).alias("at_home"), F.explode(every).alias("i"), F.col("own").alias("j"))

    def compare(pdf):
        pdf = pdf.sort_values("rep")
        h, t = pdf[pdf["at_home"]], pdf[~pdf["at_home"]]
        if not len(h) or not len(t):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        x, y = (unit(p["v"].tolist(), dims) @ plan["turn"] for p in (h, t))
        p, q = compared(x, y, plan, int(pdf["block"].iloc[0]), cosine)
        a, b = h["rep"].to_numpy()[p], t["rep"].to_numpy()[q]
        other = a != b
        a, b, copies = a[other], b[other], t["copies"].to_numpy()[q][other]
        if not len(a):
            return pd.DataFrame({"node": [], "links": [], "root": []})
        nodes, code = np.unique(a, return_inverse=True)
        counts = pd.DataFrame({"node": nodes, "links": np.bincount(code, copies).astype(np.int64), "root": None})
        node, root = stars(a, b)
        return pd.concat([counts, pd.DataFrame({"node": node, "links": None, "root": root})[node != root]]).astype("Int64")

    return as_home.union(as_there).groupBy(*cell, "i", "j").applyInPandas(compare, "node long, links long, root long")
