"""Signed feature contributions per row and in total."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tocsin.plans.models import BOOSTED, FittedModel, assembled
from tocsin.session import scratch_dir

ITEM = "array<struct<feature:string,contribution:double>>"


def _value(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


#: Column that ``explained_rows`` adds.
ITEMS = "_contributions"


@dataclass(frozen=True)
class TreeShares:
    """Boosted trees by leaf: what each feature adds on the way from the root to a leaf, and the sum of the roots.

    A step from a node to a child adds the change of the node's mean to the feature that the node splits on, so base and
    contributions add up to the prediction. Values are logarithms of odds. flat: leaf values of one feature, tree after
    tree, ``width`` places for each tree.
    """

    base: float
    width: int
    flat: list[list[float]]


def tree_shares(fitted: FittedModel) -> TreeShares:
    """Read from the nodes of the saved model, which are as many as the trees have, whatever the rows were."""
    spark, model = SparkSession.active(), fitted.model
    path = f"{scratch_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    trees: dict[int, dict[int, Row]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    base, leaves = 0.0, {}
    for number, nodes in trees.items():
        weight = 2.0 * model.treeWeights[number]  # the probability is the logistic curve at twice the margin
        base += weight * nodes[0]["prediction"]
        found: list[dict[int, float]] = []
        waiting: list[tuple[int, dict[int, float]]] = [(0, {})]
        while waiting:  # left before right, which is the order in which leaves are numbered
            at, gained = waiting.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                found.append(gained)
                continue
            feature = node["split"]["featureIndex"]
            for child in (node["rightChild"], node["leftChild"]):
                step = weight * (nodes[child]["prediction"] - node["prediction"])
                waiting.append((child, {**gained, feature: gained.get(feature, 0.0) + step}))
        leaves[number] = found
    width = max(map(len, leaves.values()), default=1)
    flat = [
        [leaf.get(feature, 0.0) for tree in sorted(leaves) for leaf in [*leaves[tree], *[{}] * (width - len(leaves[tree]))]]
        for feature in range(len(fitted.features))
    ]
    return TreeShares(base, width, flat)


def base_value(fitted: FittedModel) -> float:
    """What boosted trees predict before any split, as the logarithm of odds."""
    return tree_shares(fitted).base


def _is_boosted(fitted: FittedModel) -> bool:
    return hasattr(fitted.model, "treeWeights") and fitted.spec.kind == BOOSTED


def _tree_parts(shares: TreeShares, names: Sequence[str], leaves: str) -> dict[str, Column]:
    """Sum over trees of what each feature adds on the way to the row's leaf."""

    def part(values: list[float]) -> Column:
        table = F.from_json(F.lit(json.dumps(values)), "array<double>")
        of_trees = F.transform(leaves, lambda leaf, tree: F.get(table, (tree * shares.width + leaf).cast("int")))
        return F.aggregate(of_trees, F.lit(0.0), lambda total, value: total + value)

    return {name: part(values) for name, values in zip(names, shares.flat)}


def explained_rows(df: DataFrame, models: Sequence[tuple[FittedModel, float]]) -> DataFrame:
    """Add all contributions of a row as an array of (feature, contribution), ``ITEMS``. Row-local.

    Linear models contribute value times coefficient, boosted trees the changes of the node means along the row's paths,
    forests the importance of the feature. Several models are combined with their normalized weights.
    """
    total = sum(weight for _, weight in models) or 1.0
    features = models[0][0].features
    combined: dict[str, Column] = {name: F.lit(0.0) for name in features}
    rows = df
    for number, (fitted, weight) in enumerate(models):
        share = weight / total
        if hasattr(fitted.model, "coefficients"):
            factors = [float(x) * share for x in fitted.model.coefficients.toArray()]
            parts = {name: _value(name) * F.lit(factor) for name, factor in zip(features, factors)}
        elif _is_boosted(fitted):
            leaves = f"_leaves_{number}"
            model = fitted.model.copy().setLeafCol("_leaf")
            placed = model.transform(assembled(rows, fitted.features))
            rows = placed.select(*rows.columns, vector_to_array("_leaf").cast("array<int>").alias(leaves))
            found = _tree_parts(tree_shares(fitted), features, leaves)
            parts = {name: column * F.lit(share) for name, column in found.items()}
        elif hasattr(fitted.model, "featureImportances"):
            factors = [float(x) * share for x in fitted.model.featureImportances.toArray()]
            parts = {name: F.lit(factor) for name, factor in zip(features, factors)}
        else:
            continue
        combined = {name: combined[name] + parts[name] for name in features}
    items = F.array(
        *[F.struct(F.lit(name).alias("feature"), value.alias("contribution")) for name, value in combined.items()]
    ).cast(ITEM)
    return rows.select(*df.columns, items.alias(ITEMS))


def top_signed(items: Column, top_n: int, positive: bool) -> Column:
    """Largest positive (or most negative) items of a row, ties by feature name."""
    sign = -1.0 if positive else 1.0
    kept = F.filter(items, lambda x: (x["contribution"] > 0) if positive else (x["contribution"] < 0))
    keyed = F.transform(
        kept, lambda x: F.struct((x["contribution"] * sign).alias("order"), x["feature"].alias("feature"))
    )
    return F.transform(
        F.slice(F.array_sort(keyed), 1, top_n),
        lambda x: F.struct(x["feature"].alias("feature"), (x["order"] * sign).alias("contribution")),
    )


def signed_drivers(df: DataFrame, models: Sequence[tuple[FittedModel, float]], top_n: int = 5) -> DataFrame:
    """Add top_positive_drivers and top_negative_drivers as arrays. Row-local."""
    return (
        explained_rows(df, models)
        .withColumns(
            {
                "top_positive_drivers": top_signed(F.col(ITEMS), top_n, True),
                "top_negative_drivers": top_signed(F.col(ITEMS), top_n, False),
            }
        )
        .drop(ITEMS)
    )


def long_contributions(df: DataFrame, models: Sequence[tuple[FittedModel, float]], keys: Sequence[str]) -> DataFrame:
    """One row per key and feature with its contribution."""
    return explained_rows(df, models).select(*keys, F.inline(ITEMS))


def global_importance(df: DataFrame, models: Sequence[tuple[FittedModel, float]], top_n: int | None = None) -> DataFrame:
    """Mean absolute contribution per feature, largest first; one aggregate, then one row per feature."""
    names = models[0][0].features
    sizes = [F.avg(F.abs(F.get(ITEMS, F.lit(i)).getField("contribution"))).alias(f"_{i}") for i in range(len(names))]
    means = explained_rows(df, models).agg(*sizes)
    long = means.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("feature"), F.col(f"_{i}").alias("mean_absolute_contribution"))
                    for i, name in enumerate(names)
                ]
            )
        )
    ).orderBy(F.col("mean_absolute_contribution").desc(), "feature")
    return long.limit(top_n) if top_n else long
