"""Stored shares, bins and models, one folder per party."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import SHARE_DOMAIN
from ..operators.binning import Edges, long_bins
from ..operators.shares import ROW_ID
from ..plans.boosting import GBTModel, TreeNode
from ..plans.linear import LinearModel
from .matrices import scan_npy

FORMATS = ("parquet", "csv")
EDGE_SCHEMA = "place int, feature string, edge_idx int, edge double"


# --- shares --------------------------------------------------------------------------------------


def sink_shares(company: DataFrame, partner: DataFrame, company_path: str, partner_path: str, format: str = "parquet") -> None:
    """Write each party's share table to its own folder."""
    for df, path in ((company, company_path), (partner, partner_path)):
        _write(df, path, format)


def sink_holder(spark: SparkSession, holder: str, company_path: str) -> None:
    """Note which party holds the label, beside company's shares."""
    _write_info(spark, {"label_party": holder}, f"{company_path}_run")


def scan_holder(spark: SparkSession, company_path: str) -> str:
    """The party that held the label when the shares were stored."""
    return _read_info(spark, f"{company_path}_run")["label_party"]


def scan_shares(
    spark: SparkSession, company_path: str, partner_path: str, format: str = "parquet", columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Read both share tables. ``npy`` files carry no row id: their row number stands in."""

    def read(path: str) -> DataFrame:
        if format == "parquet":
            return spark.read.parquet(path)
        if format == "csv":
            df = spark.read.option("header", True).csv(path)
            return df.select(*[c if c == ROW_ID else F.col(c).cast("double").alias(c) for c in df.columns])
        if format == "npy":
            return scan_npy(spark, path, columns, ROW_ID)
        raise ValueError(f"unsupported share format {format!r}: use parquet, csv or npy")

    return read(company_path), read(partner_path)


def _write(df: DataFrame, path: str, format: str) -> None:
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r}: use parquet or csv")
    df.write.format(format).option("header", True).mode("overwrite").save(path)


# --- bins ----------------------------------------------------------------------------------------


def sink_bins(df: DataFrame, id: str, features: list[str], path: str, suffix: str = "_bin") -> None:
    """Write bin membership as the row id and one integer column per feature.

    Columns already let a reader take some features only, without a file per task and feature
    and without repeating the id for every feature.
    """
    bins = [F.col(f + suffix).cast("int").alias(f + suffix) for f in features]
    df.select(id, *bins).write.mode("overwrite").parquet(path)


def scan_bins(spark: SparkSession, path: str, id: str, features: list[str] | None = None, suffix: str = "_bin") -> DataFrame:
    """Read bin membership as (id, feature, bin); naming features reads their columns only."""
    df = spark.read.parquet(path)
    features = features or [c.removesuffix(suffix) for c in df.columns if c != id]
    return long_bins(df, id, features, suffix).select(id, "feature", F.col("bin").cast("int").alias("bin"))


def sink_edges(spark: SparkSession, edges: Edges, path: str) -> None:
    """Write the cut points, a bounded table, with the place of each feature."""
    place = {f: i for i, f in enumerate(edges.features)}
    rows = [(place[f], f, i, float(e)) for f, cuts in edges.cuts.items() for i, e in enumerate(cuts)]
    spark.createDataFrame(rows, EDGE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def scan_edges(spark: SparkSession, path: str) -> Edges:
    """Read cut points, features in the order in which they were written."""
    cuts: dict[str, list[float]] = {}
    for r in spark.read.schema(EDGE_SCHEMA).parquet(path).orderBy("place", "edge_idx").collect():
        cuts.setdefault(r["feature"], []).append(r["edge"])
    return Edges({f: tuple(c) for f, c in cuts.items()})


# --- models ----------------------------------------------------------------------------------------


def _write_info(spark: SparkSession, info: dict, path: str) -> None:
    text = spark.createDataFrame([(json.dumps(info, sort_keys=True),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(f"{path}/info")


def _read_info(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/info").first()["value"])


def _same_info(spark: SparkSession, paths: dict[str, str]) -> dict:
    company, partner = (_read_info(spark, paths[p]) for p in ("company", "partner"))
    if company != partner:
        raise ValueError("model info of company and partner differs")
    return company


def _read(spark: SparkSession, path: str, format: str, schema: str) -> DataFrame:
    return spark.read.format(format).option("header", True).schema(schema).load(path)


def save_linear(spark: SparkSession, model: LinearModel, paths: dict[str, str], format: str = "parquet") -> None:
    """Each party gets the weights of its own features and a copy of the model info."""
    if model.split_col is None:
        raise ValueError("split_col decides which weights go to which party")
    info = {
        "features": model.features,
        "objective": model.objective,
        "classes": model.classes,
        "lambda": model.lambda_,
        "split_col": model.split_col,
        "format": format,
    }
    for party, table in zip(("company", "partner"), model.weights_split(spark)):
        _write(table.coalesce(1), f"{paths[party]}/weights", format)
        _write_info(spark, info, paths[party])


def load_linear(spark: SparkSession, paths: dict[str, str]) -> LinearModel:
    """Put both parties' weights together; their infos must be equal."""
    info = _same_info(spark, paths)
    width = len(info["classes"]) if info["classes"] else 1
    weights = np.zeros((len(info["features"]), width))
    for party in ("company", "partner"):
        table = _read(spark, f"{paths[party]}/weights", info["format"], "feature string, cls int, weight double")
        for r in table.collect():
            weights[info["features"].index(r["feature"]), r["cls"]] = r["weight"]
    return LinearModel(info["features"], info["objective"], info["classes"], info["lambda"], weights, info["split_col"])


TREE_SCHEMA = "tree int, cls int, node bigint, feature string, bin int, gain double"


def save_trees(
    spark: SparkSession, model: GBTModel, company_features: list[str], paths: dict[str, str], seed: int | str, format: str = "parquet"
) -> None:
    """Tree structure to both parties, cut points to their owner, leaf weights as two shares."""
    info = {
        "features": model.features,
        "company_features": list(company_features),
        "objective": model.objective,
        "classes": model.classes,
        "lambda": model.lambda_,
        "max_depth": model.max_depth,
        "trees": model.trees,
        "format": format,
    }
    half = SHARE_DOMAIN // 2
    rng = np.random.default_rng(int(hashlib.sha256(f"{seed}|leaves".encode()).hexdigest(), 16))
    leaves = [n for n in model.nodes if n.is_leaf]
    masks = [float(m) for m in rng.integers(-half, half, len(leaves))]
    shares = {
        "company": [(n.tree, n.cls, n.node, m) for n, m in zip(leaves, masks)],
        # Next to a mask of up to 32768 a weight is kept to about 1e-11.
        "partner": [(n.tree, n.cls, n.node, n.weight - m) for n, m in zip(leaves, masks)],
    }
    structure = spark.createDataFrame([(n.tree, n.cls, n.node, n.feature, n.bin, n.gain) for n in model.nodes], TREE_SCHEMA)
    for party in ("company", "partner"):
        own = {f: c for f, c in model.edges.cuts.items() if (f in company_features) == (party == "company")}
        _write(structure.coalesce(1), f"{paths[party]}/trees", format)
        _write(Edges(own).table(spark).coalesce(1), f"{paths[party]}/edges", format)
        weights = spark.createDataFrame(shares[party], "tree int, cls int, node bigint, share double")
        _write(weights.coalesce(1), f"{paths[party]}/leaves", format)
        _write_info(spark, info, paths[party])


def load_trees(spark: SparkSession, paths: dict[str, str]) -> GBTModel:
    """Rebuild the forest: add the leaf shares, put both parties' cut points together."""
    info = _same_info(spark, paths)
    fmt = info["format"]
    weight: dict[tuple, float] = {}
    cuts: dict[str, dict[int, float]] = {f: {} for f in info["features"]}
    for party in ("company", "partner"):
        for r in _read(spark, f"{paths[party]}/leaves", fmt, "tree int, cls int, node bigint, share double").collect():
            key = (r["tree"], r["cls"], r["node"])
            weight[key] = weight.get(key, 0.0) + r["share"]
        for r in _read(spark, f"{paths[party]}/edges", fmt, "feature string, edge_idx int, edge double").collect():
            cuts[r["feature"]][r["edge_idx"]] = r["edge"]
    edges = Edges({f: tuple(per[i] for i in sorted(per)) for f, per in cuts.items()})
    nodes = []
    for r in _read(spark, f"{paths['company']}/trees", fmt, TREE_SCHEMA).orderBy("tree", "cls", "node").collect():
        edge = edges.cuts[r["feature"]][r["bin"]] if r["feature"] is not None else None
        key = (r["tree"], r["cls"], r["node"])
        nodes.append(TreeNode(*key, r["feature"], r["bin"], edge, r["gain"], weight.get(key)))
    return GBTModel(info["features"], edges, info["objective"], info["classes"], info["lambda"], info["max_depth"], nodes)
