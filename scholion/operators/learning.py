"""Learned rankers, simulation and search over parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.operators.credit import top_k
from scholion.operators.relational import running_total, sampled
from scholion.runtime import checkpointed, discard


def uniform(*parts: str | F.Column) -> F.Column:
    """A number in (0, 1) from the md5 of the parts: the same in any engine."""
    text = F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_draws(draws: DataFrame, members: DataFrame, run: str, sizes: str, first: int = 16) -> DataFrame:
    """Members drawn without replacement for each draw (run, draw, size), with odds by weight, a count of at least 1.

    An attempt is a uniform number among the members' running weights; a member
    met before is drawn again. As many bins as members, of equal weight, turn
    the search into a join: a heavy member is in several bins, and a bin has no
    more members than the mean weight and one. A draw whose attempts do not
    suffice gets twice as many, so the work is draws times their sizes, and more
    only where few members have nearly all the weight. A draw of more members
    than there are takes them all.
    """
    to = checkpointed(running_total(members.select("member", F.col("weight").cast("long").alias("weight")), [F.asc("member")], F.col("weight"), "_to"))
    total, n = to.agg(F.coalesce(F.max("_to"), F.lit(0)), F.count("*")).first()
    if not n:
        return draws.select(run, "draw").crossJoin(members.select("member")).limit(0)
    bin_of = lambda x: F.floor(x.cast("double") * n / total)
    binned = checkpointed(to.select("member", (F.col("_to") - F.col("weight")).alias("_from"), "_to").select("*", F.explode(F.sequence(bin_of(F.col("_from")), bin_of(F.col("_to")))).alias("_bin")))
    wanted = draws.select(run, "draw", F.least(sizes, F.lit(n)).alias("_k"))
    left, met, lo, hi = wanted, None, 0, first
    while True:
        tried = left.select(run, "draw", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("_try")).withColumn("_x", uniform(run, "draw", "_try") * total)
        found = tried.withColumn("_bin", bin_of(F.col("_x"))).join(binned, "_bin").where("_x >= _from AND _x < _to").select(run, "draw", "member", "_try")
        met = checkpointed((found if met is None else met.unionByName(found)).groupBy(run, "draw", "member").agg(F.min("_try").alias("_try")))
        got = met.groupBy(run, "draw").agg(F.count("*").alias("_got"))
        left = checkpointed(wanted.join(got, [run, "draw"]).where("_got < _k").select(run, "draw", "_k"))
        if left.isEmpty():
            break
        lo, hi = hi, 2 * hi
    w = Window.partitionBy(run, "draw").orderBy("_try")
    return met.join(wanted, [run, "draw"]).withColumn("_r", F.row_number().over(w)).where("_r <= _k").select(run, "draw", "member")


def windowed_features(yearly: DataFrame, widths: tuple[int, ...] = (1, 2, 5)) -> DataFrame:
    """affil_id, year, and for each width the sums of papers and score over that many years up to `year`."""
    out = None
    for width in widths:
        shifted = yearly.select("affil_id", F.explode(F.sequence(F.col("year"), F.col("year") + width - 1)).alias("year"), "papers", "score")
        s = shifted.groupBy("affil_id", "year").agg(F.sum("papers").alias(f"papers_{width}"), F.sum("score").alias(f"score_{width}"))
        out = s if out is None else out.join(s, ["affil_id", "year"], "full")
    return out.fillna(0)


def fit_linear(train: DataFrame, features: list[str], target: str, robust: bool = False):
    a = VectorAssembler(inputCols=features, outputCol="_x")
    return a, LinearRegression(featuresCol="_x", labelCol=target, loss="huber" if robust else "squaredError").fit(a.transform(train))


def fit_trees(train: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 4):
    a = VectorAssembler(inputCols=features, outputCol="_x")
    return a, GBTRegressor(featuresCol="_x", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.7, seed=7).fit(a.transform(train))


def theil_sen(train: DataFrame, features: list[str], target: str, key: list[str], samples: int = 500, seed: int = 42) -> np.ndarray:
    """Coefficients (intercept first): the medians of least-squares fits to random subsets of as many rows as coefficients.

    Every row can be drawn: rows are numbered by `key`, and only those of the
    drawn numbers, samples times coefficients at most, come to the driver.
    """
    rows = checkpointed(running_total(train.select(*key, *features, target), [F.asc(k) for k in key], F.lit(1), "_n"))
    n, size = rows.count(), len(features) + 1
    if n < size:
        raise ValueError(f"{n} rows cannot determine {size} coefficients")
    rng = np.random.default_rng(seed)
    picks = [(s, int(i) + 1) for s in range(samples) for i in rng.choice(n, size, replace=False)] if n < 1 << 20 else [(s, int(i) + 1) for s in range(samples) for i in _distinct(rng, n, size)]
    drawn = rows.join(F.broadcast(train.sparkSession.createDataFrame(picks, "_s int, _n long")), "_n").orderBy("_s", "_n").select("_s", *(F.col(c).cast("double") for c in (*features, target))).toPandas()
    fits = [np.linalg.lstsq(np.column_stack([np.ones(size), g[features].to_numpy()]), g[target].to_numpy(), rcond=None)[0] for _, g in drawn.groupby("_s")]
    return np.median(fits, axis=0)


def _distinct(rng: np.random.Generator, n: int, size: int) -> set[int]:
    """`size` different numbers below a large n."""
    out: set[int] = set()
    while len(out) < size:
        out.add(int(rng.integers(n)))
    return out


def ndcg_by_query(ranked: DataFrame, query: list[str], score: str, tie: str, target: str, k: int) -> DataFrame:
    """query, dcg: the gains of a query's k best rows by score (ties by `tie`), over log2 of place + 1."""
    top = top_k(ranked, tuple(query), score, tie, k)
    return top.groupBy(*query).agg(F.sum(F.col(target) / F.log2(F.col("rank") + 1.0)).alias("dcg"))


def ada_rank(train: DataFrame, features: list[str], target: str, query: str, tie: str, rounds: int = 10, k: int = 20, stop: float = 1e-6) -> dict[str, float]:
    """Weights of features (over their largest absolute value) of a ranker boosted by NDCG at k of each query.

    The weak rankers are the features. Their NDCG by query is worked out once;
    a round takes the feature of the largest mean under the queries' weights p,
    adds half the log of sum p (1 + E) / sum p (1 - E) to its weight, and ranks
    all rows by the sum, queries with a low NDCG weighing exp(-NDCG). It is one
    job, whose result has a row for each feature; rows and queries' weights stay
    in frames. Ends after `rounds`, or once the mean NDCG does not rise by
    `stop`; that round is undone. Queries without gains are left out.
    """
    most = train.agg(*(F.max(F.abs(F.col(f))).cast("double").alias(f) for f in features)).first().asDict()
    scaled = checkpointed(train.select(query, tie, F.col(target).cast("double").alias(target), *((F.col(f) / (most[f] or 1.0)).alias(f) for f in features)))
    ideal = ndcg_by_query(scaled.withColumn("_s", F.col(target)), [query], "_s", tie, target, k).where("dcg > 0").withColumnRenamed("dcg", "_best")
    one = scaled.select(query, tie, target, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("_s")) for f in features))).alias("_f")).select(query, tie, target, "_f.*")
    weak = checkpointed(ndcg_by_query(one, [query, "feature"], "_s", tie, target, k).join(ideal, query).select(query, "feature", (F.col("dcg") / F.col("_best")).alias("e")))
    best = checkpointed(ideal)
    weights, last = dict.fromkeys(features, 0.0), None
    for turn in range(rounds + 1):  # the last turn only judges the one before
        if last is None:
            now = best.select(query, F.lit(0.0).alias("_e"))
        else:
            ranked = scaled.withColumn("_s", sum((F.col(f) * w for f, w in weights.items() if w), F.lit(0.0)))
            now = ndcg_by_query(ranked, [query], "_s", tie, target, k).join(best, query).select(query, (F.col("dcg") / F.col("_best")).alias("_e"))
        p = F.exp(-F.col("_e"))
        sums = weak.join(now, query).groupBy("feature").agg(F.sum(p * F.col("e")).alias("pe"), F.sum(p).alias("p"), F.avg("_e").alias("mean")).collect()  # a row for each feature
        if not sums:
            break
        if last is not None and sums[0]["mean"] <= last[0] + stop:
            weights = last[1]
            break
        pick = min(sums, key=lambda r: (-round(r["pe"] / r["p"], 12), features.index(r["feature"])))
        last = (sums[0]["mean"] if last is not None else -1.0, dict(weights))
        if turn < rounds:
            weights[pick["feature"]] += 0.5 * float(np.log((pick["p"] + pick["pe"]) / max(pick["p"] - pick["pe"], 1e-9 * pick["p"])))
    return {f: w / (most[f] or 1.0) for f, w in weights.items()}


def onto_simplex(moved: DataFrame, start: float | None = None) -> tuple[float, float, float]:
    """The threshold that projects `y` onto the probability simplex as max(y - threshold, 0), the change from `s` in L1, and how far `ahead` overshot.

    Newton steps on the sum, each one aggregation: the rows over the threshold
    give the next one, until the same rows are over it. `start` is a guess.
    """
    over, last = start, None
    while True:
        above = F.lit(True) if over is None else F.col("y") > over
        new = F.greatest(F.col("y") - (0.0 if over is None else over), F.lit(0.0))
        r = moved.agg(F.sum(F.when(above, F.col("y"))).alias("sum"), F.count(F.when(above, True)).alias("n"), F.sum(F.abs(new - F.col("s"))).alias("change"), F.sum((F.col("ahead") - new) * (new - F.col("s"))).alias("over")).first()
        if not r["n"]:
            over, last = None, None
            continue
        if over is not None and r["n"] == last:
            return over, r["change"], r["over"]
        over, last = (r["sum"] - 1) / r["n"], r["n"]


def pairwise_strengths(edges: DataFrame, affils: DataFrame, beta: float = 0.1, tolerance: float = 1e-8, most_steps: int = 500) -> DataFrame:
    """affil_id, score: strengths on the simplex, where each citation a -> b says that b's institutions outweigh a's.

    Maximises sum w beta D - n ln(1 + exp(beta D)), D = s(b's) - s(a's), a concave
    function, by projected gradient with momentum and the step that its curvature
    allows, until the change in L1 is under `tolerance`; momentum is dropped
    where it overshoots. Pairs of institutions, strengths
    and gradients are frames. A step is one write, with partial sums of the
    gradient before the shuffle, and the aggregations of the projection; only
    sums come to the driver. An institution without a pair has no row; no pairs
    give no rows.
    """
    f = affils.select("author_id", "affil_id")
    met = edges.join(f.select(F.col("author_id").alias("a"), F.col("affil_id").alias("fa")), "a").join(f.select(F.col("author_id").alias("b"), F.col("affil_id").alias("fb")), "b")
    pairs = checkpointed(met.where("fa <> fb").groupBy("fa", "fb").agg(F.sum("weight").cast("double").alias("w"), F.count("*").cast("double").alias("n")))
    ends = pairs.select(F.explode(F.array("fa", "fb")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("degree"))
    nodes = checkpointed(ends)
    size, most = nodes.agg(F.count("*"), F.max("degree")).first()
    if not size:
        return nodes.select(F.col("node").alias("affil_id"), F.col("degree").alias("score"))
    rate = 2 / (beta * beta * most)
    now, written, over = nodes.select("node", F.lit(1.0 / size).alias("s"), F.lit(1.0 / size).alias("ahead")), None, None
    run = 0  # steps since the momentum was last dropped
    for _ in range(most_steps):
        sides = pairs.join(now.select(F.col("node").alias("fa"), F.col("ahead").alias("sa")), "fa").join(now.select(F.col("node").alias("fb"), F.col("ahead").alias("sb")), "fb")
        g = beta * (F.col("w") - F.col("n") / (1 + F.exp(-beta * (F.col("sb") - F.col("sa")))))
        slope = sides.select(F.explode(F.array(F.struct(F.col("fb").alias("node"), g.alias("g")), F.struct(F.col("fa").alias("node"), (-g).alias("g")))).alias("_e")).groupBy("_e.node").agg(F.sum("_e.g").alias("g"))
        moved = checkpointed(now.join(slope, "node").select("node", "s", "ahead", (F.col("ahead") + rate * F.col("g")).alias("y")))
        over, change, overshot = onto_simplex(moved, over)
        if written is not None:
            discard(written)
        run = 0 if overshot > 0 else run + 1
        new = F.greatest(F.col("y") - over, F.lit(0.0))
        written, now = moved, moved.select("node", new.alias("s"), (new + run / (run + 3) * (new - F.col("s"))).alias("ahead"))
        if change < tolerance:
            break
    return now.select(F.col("node").alias("affil_id"), F.col("s").alias("score"))


class KeywordClassifier:
    """Which of several keywords a text has: a logistic model for each, over one TF-IDF space, with a threshold of its own.

    `rows` have `key`, `words` (an array) and `keywords` (an array, null where
    unknown). The space and its document frequencies come from all rows. Models
    learn from at most `most_rows` labelled rows, those with the smallest md5 of
    the key, whose crc32 of the key mod 5 is over 1. Thresholds are those of the
    largest F1 on all labelled rows where it is 1, from counts by bins of scores.
    Where it is 0, rows are held out. A keyword that no row for learning has is
    never found.
    """

    BINS = 100

    def __init__(self, rows: DataFrame, key: str, keywords: list[str], features: int = 1024, most_rows: int = 10_000) -> None:
        self.keywords, self.fold = keywords, F.crc32(F.col(key).cast("string").cast("binary")) % 5
        self.counts = HashingTF(inputCol="words", outputCol="_tf", numFeatures=features)
        self.weighing = IDF(inputCol="_tf", outputCol="_x").fit(self.counts.transform(rows.select("words").where("words IS NOT NULL")))
        known = self._placed(rows.where("keywords IS NOT NULL"))
        learn = checkpointed(sampled(known.where(self.fold > 1), key, most_rows))
        has = learn.agg(*(F.max(F.array_contains("keywords", k)).alias(str(i)) for i, k in enumerate(keywords))).first()
        weights = np.zeros((len(keywords), features + 1))
        weights[:, -1] = -np.inf
        for i, k in enumerate(keywords):
            if has[i]:
                m = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=20, regParam=0.01).fit(learn.withColumn("_y", F.array_contains("keywords", k).cast("double")))
                weights[i] = [*m.coefficients.toArray(), m.intercept]
        self.weights = weights
        self.thresholds = self._thresholds(known.where(self.fold == 1))

    def _placed(self, rows: DataFrame) -> DataFrame:
        return self.weighing.transform(self.counts.transform(rows.withColumn("words", F.coalesce("words", F.array().cast("array<string>"))))).drop("_tf")

    def _scores(self) -> F.Column:
        weights = self.weights

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            z = np.stack(x.to_numpy()) @ weights[:, :-1].T + weights[:, -1] if len(x) else np.zeros((0, len(weights)))
            return pd.Series(list(1 / (1 + np.exp(-np.clip(z, -500, 500)))))

        return score(vector_to_array("_x"))

    def _thresholds(self, known: DataFrame) -> list[float]:
        by_keyword = F.transform(F.col("_s"), lambda s, i: F.struct(i.alias("k"), F.floor(s * self.BINS).alias("bin"), F.array_contains("keywords", F.array(*map(F.lit, self.keywords))[i]).alias("has")))
        rows = known.withColumn("_s", self._scores()).select(F.explode(by_keyword).alias("_c")).groupBy("_c.k", "_c.bin").agg(F.count("*").alias("n"), F.count_if("_c.has").alias("right")).collect()  # keywords times bins
        out = []
        for i in range(len(self.keywords)):
            mine = sorted(((r["bin"], r["n"], r["right"]) for r in rows if r["k"] == i), reverse=True)
            total, n, right, best = sum(r for _, _, r in mine), 0, 0, (0.0, 0.5)
            for low, count, hits in mine:
                n, right = n + count, right + hits
                best = max(best, (2 * right / max(n + total, 1), low / self.BINS), key=lambda b: b[0])
            out.append(best[1])
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        """All rows with `found`, the keywords whose score reaches their threshold, in the order of the list."""
        listed = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in zip(self.keywords, self.thresholds, strict=True)))
        paired = F.filter(F.transform(listed, lambda e, i: F.when(F.get(F.col("_s"), i) >= e["t"], e["k"])), lambda k: k.isNotNull())
        return self._placed(rows).withColumn("_s", self._scores()).withColumn("found", paired).drop("_x", "_s")


def micro_f1(rows: DataFrame, truth: str = "keywords", found: str = "found") -> float:
    """F1 over all pairs of a row and a keyword."""
    r = rows.agg(F.sum(F.size(F.array_intersect(truth, found))), F.sum(F.size(truth) + F.size(found))).first()
    return 2 * r[0] / r[1] if r[1] else 0.0


def bayesian_search(objective: Callable[[dict], float], bounds: dict[str, tuple[float, float]], rounds: int = 20, seed: int = 0, starts: int | None = None, logs: tuple[str, ...] = (), acquisition: str = "ei") -> tuple[dict, float, list]:
    """The best parameters that a Gaussian process finds: random starts, then the candidate with the best acquisition (ei, poi or ucb)."""
    rng = np.random.default_rng(seed)
    names = list(bounds)
    scale = lambda u: {k: float(np.exp(np.log(lo) + v * (np.log(hi) - np.log(lo))) if k in logs else lo + v * (hi - lo)) for k, v, (lo, hi) in zip(names, u, bounds.values(), strict=True)}
    x = rng.random((starts or 2 * len(names) + 3, len(names)))
    y = np.array([objective(scale(u)) for u in x])
    cdf = np.vectorize(lambda z: 0.5 * (1 + __import__("math").erf(z / np.sqrt(2))))
    kernel = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(-1) / 0.2**2)
    for _ in range(rounds):
        mean, spread = y.mean(), y.std() + 1e-9
        inverse = np.linalg.inv(kernel(x, x) + 1e-6 * np.eye(len(x)))
        c = rng.random((500, len(names)))
        k = kernel(c, x)
        mu = k @ inverse @ ((y - mean) / spread)
        sigma = np.sqrt(np.maximum(1 - (k @ inverse * k).sum(1), 1e-12))
        best = ((y - mean) / spread).max()
        z = (mu - best) / sigma
        value = {"ei": (mu - best) * cdf(z) + sigma * np.exp(-z * z / 2) / np.sqrt(2 * np.pi), "poi": cdf(z), "ucb": mu + 2 * sigma}[acquisition]
        x = np.vstack([x, c[value.argmax()]])
        y = np.append(y, objective(scale(x[-1])))
    return scale(x[y.argmax()]), float(y.max()), [(scale(u), float(v)) for u, v in zip(x, y, strict=True)]
