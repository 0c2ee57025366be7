"""Models: gradient-boosted trees by Spark ML, and a seeded isolation forest whose trees are plain arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.staging import staged


class IsolationForest:
    """trees of at most `sample` rows; a row's score is 2 ** (-mean depth / expected depth)."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        rows = np.nan_to_num(rows, nan=-1.0)
        self.size = min(sample, len(rows))
        limit = int(np.ceil(np.log2(max(2, self.size))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], limit, rng) for _ in range(trees if len(rows) else 0)]

    @staticmethod
    def expected(n: np.ndarray | float) -> np.ndarray:
        n = np.asarray(n, float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, rows: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
        """Nodes as (feature or -1, cut, left, right, value): value is the depth plus what a leaf's rows would still need."""
        nodes: list[list[float]] = []
        todo = [(rows, 0, -1, 0)]
        while todo:
            part, depth, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(part) < 2 or not len(wide):
                nodes.append([-1, 0, -1, -1, depth + float(self.expected(len(part)))])
                continue
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            nodes.append([f, cut, -1, -1, 0])
            todo += [(part[part[:, f] < cut], depth + 1, at, 0), (part[part[:, f] >= cut], depth + 1, at, 1)]
        return np.array(nodes)

    def score(self, rows: np.ndarray) -> np.ndarray:
        rows = np.nan_to_num(rows, nan=-1.0)
        total = np.zeros(len(rows))
        for t in self.trees:
            at = np.zeros(len(rows), int)
            while (inner := np.flatnonzero(t[at, 0] >= 0)).size:
                n = t[at[inner]]
                at[inner] = np.where(rows[inner, n[:, 0].astype(int)] < n[:, 1], n[:, 2], n[:, 3]).astype(int)
            total += t[at, 4]
        return np.exp2(-total / max(1, len(self.trees)) / max(1e-9, float(self.expected(self.size))))


def isolation_scores(vectors: DataFrame, fit_rows: int = 10_000, seed: int = 0) -> DataFrame:
    """vec_id, score, and percentile: the share of 1,001 quantiles of all scores that are not above it. The trees are fitted on a bounded
    sample (the least hashes); every row is scored, and the quantiles are of every row's score."""
    v = vectors.filter("embedding is not null").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sample = np.array([r.v for r in v.orderBy(F.xxhash64("vec_id")).limit(fit_rows).collect()], float)
    forest = IsolationForest(sample, seed=seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = forest.score(np.array(pdf["v"].tolist(), float)) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "score": np.round(s, 9)})

    scored = staged(v.mapInPandas(run, "vec_id long, score double"), "forest-scores")
    return with_percentile(scored, scored, "score")


def with_percentile(rows: DataFrame, reference: DataFrame, score: str, quantiles: int = 1001) -> DataFrame:
    """rows with percentile: the share of the reference's quantiles that are not above the score; they are right to a
    millionth of the reference's rows."""
    edges = reference.agg(F.percentile_approx(score, [i / (quantiles - 1) for i in range(quantiles)], 1_000_000).alias("q")).first()[0] or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["percentile"] = np.searchsorted(np.array(edges, float), pdf[score].to_numpy(float), "right") / max(1, len(edges))
            yield pdf

    from pyspark.sql.types import StructType

    schema = StructType([*rows.schema.fields]).add("percentile", "double")
    return rows.mapInPandas(run, schema)


#: Rounds, step, depth and rows of a leaf of the boosted trees.
TREES = {"maxIter": 300, "stepSize": 0.05, "maxDepth": 5, "minInstancesPerNode": 50, "maxBins": 64, "seed": 42}


def _assembled(rows: DataFrame, inputs: list[str]) -> DataFrame:
    """features: the inputs as one vector; what is undefined is -1, as for the forest."""
    from pyspark.ml.feature import VectorAssembler

    refuse_identity(inputs)
    filled = rows.withColumns({c: F.coalesce(F.when(F.isnan(F.col(c).cast("double")), F.lit(None)).otherwise(F.col(c).cast("double")), F.lit(-1.0)) for c in inputs})
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(filled)


def fit_trees(rows: DataFrame, inputs: list[str], label: str, **options):
    """A model of boosted trees. rows: inputs and a label of 0 and 1. Columns that name a host, flow or time are refused."""
    from pyspark.ml.classification import GBTClassifier

    made = _assembled(rows.filter(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")), inputs)
    return GBTClassifier(**(TREES | options)).fit(made.select("features", "label"))


def probabilities(model, rows: DataFrame, inputs: list[str], name: str = "probability") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    kept = [c for c in rows.columns if c not in inputs]
    got = model.transform(_assembled(rows, inputs)).select(*kept, F.round(vector_to_array("probability")[1], 6).alias("__p"))
    return got.withColumnRenamed("__p", name)


def out_of_fold(rows: DataFrame, inputs: list[str], label: str, group: str, **options) -> DataFrame:
    """The rows' other columns with probability, each scored by a model that saw none of its group (a bounded number of groups). A
    group whose others have one label only is skipped."""
    groups = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    out = None
    for g in groups:
        inside = F.col(group).eqNullSafe(F.lit(g))
        others = rows.filter(~inside & F.col(label).isNotNull())
        if others.select(label).distinct().count() < 2:
            continue
        got = probabilities(fit_trees(others, inputs, label, **options), rows.filter(inside), inputs)
        out = got if out is None else out.unionByName(got)
    if out is None:
        return rows.select(*[c for c in rows.columns if c not in inputs], F.lit(None).cast("double").alias("probability")).limit(0)
    return out


def _tree_tables(model) -> list[tuple[float, np.ndarray]]:
    """Weight and nodes of each tree: feature or -1, threshold, left, right, prediction."""
    import uuid

    from flowloom.staging import folder

    spark = SparkSession.getActiveSession()
    path = f"{folder(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    trees: dict[int, list] = {}
    for n in nodes:
        inner = n.leftChild >= 0
        trees.setdefault(n.treeID, []).append((n.split.featureIndex if inner else -1, n.split.leftCategoriesOrThreshold[0] if inner else 0.0, n.leftChild, n.rightChild, n.prediction))
    return [(w, np.array(trees[i], float)) for i, w in enumerate(model.treeWeights)]


def contributions(rows: DataFrame, model, inputs: list[str], key: str, k: int = 5) -> DataFrame:
    """key and contributions: rows of evidence of the k inputs that move a row's score most. On the way down each tree, what a split
    changes in the prediction is the split input's; added up over the trees, by weight (the score is twice that in log-odds). Meant
    for the few flagged rows."""
    from flowloom.operators.rules import EVIDENCE

    trees = _tree_tables(model)
    names = list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].astype(float).fillna(-1.0).to_numpy()
            total = np.zeros((len(x), len(names)))
            for weight, t in trees:
                at = np.zeros(len(x), int)
                while (inner := np.flatnonzero(t[at, 0] >= 0)).size:
                    n = t[at[inner]]
                    f = n[:, 0].astype(int)
                    to = np.where(x[inner, f] <= n[:, 1], n[:, 2], n[:, 3]).astype(int)
                    np.add.at(total, (inner, f), 2 * weight * (t[to, 4] - n[:, 4]))
                    at[inner] = to
            best = np.argsort(-np.abs(total), axis=1, kind="stable")[:, :k]
            told = [[{"feature": names[j], "value": float(x[i, j]), "said": None, "baseline": None, "baseline_source": "tree_path", "contribution": round(float(total[i, j]), 4)} for j in best[i]] for i in range(len(x))]
            yield pd.DataFrame({key: pdf[key], "contributions": told})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(run, f"{key} {kind}, contributions {EVIDENCE}")


def flagged(scores: DataFrame, threshold: float, model: str, ml_class: str, alone: bool) -> DataFrame:
    """scores (ord, score, probability) as operators/alerts.py takes them: flagged strictly above the threshold."""
    return scores.withColumns({"model": F.lit(model), "ml_class": F.lit(ml_class), "flagged": F.col("score") > threshold, "alone": F.lit(alone)})


def tree_scores(flows: DataFrame, rounds: int = 10, depth: int = 4) -> DataFrame:
    """ok, ln, pk, src and the probability of boosted trees on flow features, out of fold: a flow of a protocol is scored by a model of
    the other protocols' flows."""
    inputs = ["bytes", "packets", "port_class"]
    x = flows.select("ok", "ln", "pk", "src", "proto", F.col("bytes").cast("double").alias("bytes"), F.col("packets").cast("double").alias("packets"), (F.col("port") % 4).cast("double").alias("port_class"), F.col("syn_only").cast("int").alias("y"))
    return out_of_fold(x, inputs, "y", "proto", maxIter=rounds, maxDepth=depth).select("ok", "ln", "pk", "src", "probability")


def refuse_identity(columns: list[str]) -> None:
    """Columns that name a host, a flow or a time may not be inputs of a model."""
    bad = {"src", "dst", "src_ip", "dst_ip", "src_port", "flow_id", "community_id", "start", "start_time", "last", "last_time"} & set(columns)
    if bad:
        raise ValueError(f"identity columns: {sorted(bad)}")
