"""What the leaves of boosted trees say about a row: contributions of the inputs, and the spread around the point.

The walk down the trees is the model's own (its leaf column). A leaf stands for the whole path to it, so all that a path
says is put into tables by tree and leaf once; they have the size of the model, never of the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.ranking import shared_folder

LEAVES = "_leaves"
#: Cells of the residuals, with edges at equal shares of all of them; residuals at which a leaf has half its weight; and
#: the weight of all residuals together.
CELLS, HALF, POOLED = 40, 5.0, 0.05


def with_leaves(pipeline: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` scored, with ``_leaves``: the number of the leaf reached in each tree, from left to right."""
    *head, model = pipeline.stages
    scored = PipelineModel([*head, model.copy({model.leafCol: LEAVES})]).transform(rows)
    return scored.withColumn(LEAVES, vector_to_array(LEAVES))


def node_table(model) -> DataFrame:
    """All nodes of a fitted tree ensemble: ``tree``, ``node``, ``prediction`` (the mean of the rows that reach it, for a
    leaf what it adds), ``left``, ``right`` and ``feature`` (-1 for a leaf), ``threshold``, and the tree's ``weight``."""
    spark = SparkSession.active()
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    weights = F.array(*[F.lit(float(w)) for w in model.treeWeights])
    node = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("node"), node["prediction"].alias("prediction"), node["leftChild"].alias("left"),
        node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("feature"),
        F.try_element_at(node["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"), weights[F.col("treeID")].alias("weight"),
    )


@dataclass(frozen=True)
class PathTable:
    """For each tree and leaf the inputs on the path and what they change; ``bias`` is what the roots add up to."""

    bias: float
    feature: np.ndarray  # tree, leaf, step
    change: np.ndarray


def path_table(nodes: DataFrame) -> PathTable:
    """Credits each split with the change of the node mean from parent to child, down to what the leaf adds."""
    trees: dict[int, dict] = {}
    for r in nodes.collect():
        trees.setdefault(r.tree, {})[r.node] = r
    paths: dict[int, list[list[tuple[int, float]]]] = {}
    bias = 0.0
    for t, tree in sorted(trees.items()):
        bias += tree[0].weight * tree[0].prediction
        paths[t], open_ = [], [(0, [])]
        while open_:
            at, way = open_.pop()
            here = tree[at]
            if here.left < 0:
                paths[t].append(way)
                continue
            for child in (here.right, here.left):  # the left one is taken next, so leaves come from left to right
                open_.append((child, [*way, (here.feature, here.weight * (tree[child].prediction - here.prediction))]))
    steps = max((len(w) for ws in paths.values() for w in ws), default=0)
    leaves = max((len(ws) for ws in paths.values()), default=0)
    feature, change = np.zeros((len(paths), leaves, steps), np.int32), np.zeros((len(paths), leaves, steps))
    for t, ways in paths.items():
        for i, way in enumerate(ways):
            for j, (f, c) in enumerate(way):
                feature[t, i, j], change[t, i, j] = f, c
    return PathTable(bias, feature, change)


def path_contributions(table: PathTable, features: int, leaves: str = LEAVES) -> Column:
    """The contributions of all inputs to a scored row, as an array."""
    sent = SparkSession.active().sparkContext.broadcast((table.feature, table.change))

    @F.pandas_udf("array<double>")
    def credit(column: pd.Series) -> pd.Series:
        feature, change = sent.value
        at = np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, len(feature)), np.int64)
        out = np.zeros(len(column) * features)
        row = np.arange(len(column))[:, None] * features
        for t in range(len(feature)):
            out += np.bincount((row + feature[t, at[:, t]]).ravel(), change[t, at[:, t]].ravel(), len(out))
        return pd.Series(list(out.reshape(len(column), features)))

    return credit(leaves)


def tree_contributions(pipeline: PipelineModel, rows: DataFrame, inputs: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(ids, feature, contribution) for all inputs of a boosted model: the change of the node mean at every split on the
    input, over the row's way down all trees. They add up to the prediction less the bias, which depends on the model
    alone, not on the rows scored with it."""
    table = path_table(node_table(pipeline.stages[-1]))
    scored = with_leaves(pipeline, rows).select(*ids, path_contributions(table, len(inputs)).alias("_c"))
    names = F.array(*[F.lit(c) for c in inputs])
    return scored.select(*ids, F.posexplode("_c").alias("_i", "contribution")).select(*ids, names[F.col("_i")].alias("feature"), "contribution")


# --- spread ---------------------------------------------------------------------------------


def cell_of(value: Column, edges: Sequence[float]) -> Column:
    """Which of the cells between ``edges`` a value is in; values beyond belong to the outer ones."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]])
    return F.size(F.filter(inner, lambda e: e < value))


def leaf_cells(scored: DataFrame, residual: str, edges: Sequence[float]) -> DataFrame:
    """``tree``, ``leaf``, ``cell`` and ``n``: how the residuals of the rows that reach a leaf are spread."""
    told = scored.where(F.col(residual).isNotNull()).select(F.posexplode(LEAVES).alias("tree", "leaf"), cell_of(F.col(residual), edges).alias("cell"))
    return told.groupBy("tree", F.col("leaf").cast("int").alias("leaf"), "cell").agg(F.count("*").alias("n"))


def leaf_quantiles(cells: DataFrame, edges: Sequence[float], probs: Sequence[float], leaves: str = LEAVES) -> Column:
    """Quantiles of the residuals that are to be expected of a row: those of its leaves.

    A leaf with many residuals weighs 1 and one with n weighs n / (n + HALF), however many there are in all; all
    residuals together weigh POOLED, so that every row has some.
    """
    rows = cells.collect()
    count = np.zeros((1 + max((r.tree for r in rows), default=0), 1 + max((r.leaf for r in rows), default=0), len(edges) - 1))
    for r in rows:
        count[r.tree, r.leaf, r.cell] = r.n
    pooled = count.sum((0, 1))
    pooled = pooled / pooled.sum() if pooled.sum() else np.full(len(pooled), 1 / len(pooled))
    share = count / (count.sum(2, keepdims=True) + HALF)
    sent = SparkSession.active().sparkContext.broadcast((np.cumsum(share, 2), np.cumsum(pooled), np.array(edges, float)))

    @F.pandas_udf("array<double>")
    def spread(column: pd.Series) -> pd.Series:
        below, of_all, edge = sent.value
        at = np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, len(below)), np.int64)
        total = np.tile(POOLED * of_all, (len(column), 1))
        for t in range(min(at.shape[1], len(below))):
            known = at[:, t] < below.shape[1]  # no residual came to a leaf beyond
            total[known] += below[t, at[known, t]]
        total = np.hstack([np.zeros((len(column), 1)), total / total[:, -1:]])
        out = []
        for p in probs:
            cell = np.clip((total < p).sum(1) - 1, 0, len(of_all) - 1)
            low, high = (np.take_along_axis(total, (cell + k)[:, None], 1)[:, 0] for k in (0, 1))
            part = np.clip((p - low) / np.maximum(high - low, 1e-12), 0, 1)
            out.append(edge[cell] + part * (edge[cell + 1] - edge[cell]))
        return pd.Series(list(np.stack(out, 1)))

    return spread(leaves)
