"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for urls that no rule decides.

The trees learn from labelled urls (in the query: those that a rule decides, labelled by it). Features: lengths of url, host and
path, path depth, host labels, digit ratio and character entropy of url and path, parameter counts, and suffix statistics (the
smoothed share of blocked urls among labelled ones with the same last one or two host labels). Each tree is grown on histograms of
binned features by second-order gains of the logistic loss.

The fit uses at most ``sample_rows`` different labelled urls, chosen by a hash of the url; the model, its suffix table included, has a fixed
size, and all urls are judged.

Defined cases: null urls and urls without "://" have an empty host and path and fit no rule; the trees judge them by their other
features. Labels that are null are ignored, and of several of a url the greatest
counts; with labels of one class, or none, every url gets that class, or allow. Repeated rows
are judged alike. Other columns are neither read nor touched.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, UPPER, table

#: (verdict, host, path)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
SAMPLE_ROWS, TREES, DEPTH, RATE, BINS, LEAST_WEIGHT, PENALTY, SUFFIXES = 20_000, 60, 4, 0.15, 32, 2.0, 1.0, 4_096


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: str) -> float:
    if not text:
        return 0.0
    share = np.array(list(Counter(text).values())) / len(text)
    return float(-(share * np.log2(share)).sum())


def features(url: str | None) -> list[float]:
    url = url or ""
    _, sep, rest = url.partition("://")
    rest = rest if sep else ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path, query = tail.partition("#")[0].partition("?")[::2]
    digits = sum(c.isdigit() for c in url)
    path_digits = sum(c.isdigit() for c in path)
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), digits / max(len(url), 1), path_digits / max(len(path), 1), path_digits,
        entropy(url), entropy(path), entropy(host), query.count("=") , query.count("&") + bool(query), len(query), "#" in url, url.count("-"), url.startswith("https"), path.endswith("/"),
    ]


def suffixes(host: str) -> list[str]:
    parts = host.lower().split(".")
    return [".".join(parts[-k:]) for k in (1, 2)]


def host_in(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    for c in "/?#":
        rest = rest.partition(c)[0]
    return rest


@dataclass
class Model:
    """Trees as arrays: feature, bin, and value by node, children at 2k+1 and 2k+2; a feature of -1 marks a leaf."""

    base: float
    prior: float
    known: dict[str, float] = field(default_factory=dict)
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def rows(self, urls: list[str | None]) -> np.ndarray:
        x = [features(u) + [self.known.get(s, self.prior) for s in suffixes(host_in(u))] for u in urls]
        return np.array(x, np.float64).reshape(len(urls), -1)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), np.int64)

    def margin(self, urls: list[str | None]) -> np.ndarray:
        out = np.full(len(urls), self.base)
        if self.trees:
            b = self.binned(self.rows(urls))
            for feature, cut, value in self.trees:
                node = np.zeros(len(b), np.int64)
                for _ in range(DEPTH):
                    f = feature[node]
                    right = b[np.arange(len(b)), np.maximum(f, 0)] > cut[node]
                    node = np.where(f >= 0, 2 * node + 1 + right, node)
                out += value[node]
        return out


def grow(b: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree, and the value that it gives each row."""
    size = 2 ** (DEPTH + 1) - 1
    feature, cut, value, node = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(len(b), np.int64)
    for k in range(size):
        rows = np.flatnonzero(node == k)
        if not len(rows):
            continue
        g, h = gradient[rows].sum(), hessian[rows].sum()
        value[k] = -RATE * g / (h + PENALTY)
        if 2 * k + 2 >= size:
            continue
        best = 1e-6
        for f in range(b.shape[1]):
            gl = np.cumsum(np.bincount(b[rows, f], gradient[rows], BINS))[:-1]
            hl = np.cumsum(np.bincount(b[rows, f], hessian[rows], BINS))[:-1]
            gain = gl**2 / (hl + PENALTY) + (g - gl) ** 2 / (h - hl + PENALTY) - g**2 / (h + PENALTY)
            gain[(hl < LEAST_WEIGHT) | (h - hl < LEAST_WEIGHT)] = 0
            if gain.max() > best:
                best, feature[k], cut[k] = gain.max(), f, int(gain.argmax())
        if feature[k] >= 0:
            node[rows] = 2 * k + 1 + (b[rows, feature[k]] > cut[k])
    return feature, cut, value, value[node]


def train(urls: list[str | None], block: np.ndarray) -> Model:
    """Boost trees on urls labelled 1 (block) or 0."""
    n = len(urls)
    if not n or block.min() == block.max():
        return Model(30.0 if n and block[0] else -30.0, 0.5)
    prior = float(block.mean())
    counts: dict[str, list[float]] = {}
    for u, y in zip(urls, block):
        for s in suffixes(host_in(u)):
            c = counts.setdefault(s, [0, 0])
            c[0] += 1
            c[1] += y
    most = sorted(counts.items(), key=lambda kv: (-kv[1][0], kv[0]))[:SUFFIXES]
    model = Model(float(np.log(prior / (1 - prior))), prior, {s: (y + 10 * prior) / (c + 10) for s, (c, y) in most})
    x = model.rows(urls)
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b, margin = model.binned(x), np.full(n, model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        *tree, step = grow(b, p - block, p * (1 - p))
        model.trees.append(tuple(tree))
        margin += step
    return model


def sample(labelled: DataFrame, url_col: str, label_col: str, sample_rows: int) -> DataFrame:
    """(u, y) of at most ``sample_rows`` different urls, those of the least hashes. A bound on the hash, from the number of labelled
    rows, comes before rows meet, so that no more than about as many do; where copies are many, that leaves fewer."""
    some = labelled.select(F.col(url_col).alias("u"), F.col(label_col).cast("int").alias("y")).where("u is not null and y is not null")
    n = some.agg(F.approx_count_distinct("u", 0.02)).first()[0]
    some = some.withColumn("h", F.xxhash64("u"))
    if (share := 1.2 * sample_rows / max(n, 1)) < 1:
        some = some.where(F.col("h") < int(-(2**63) + 2**64 * share))
    return some.groupBy("h", "u").agg(F.max("y").alias("y")).orderBy("h", "u").limit(sample_rows).select("u", "y")


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit to at most ``sample_rows`` different labelled urls (label 1: block)."""
    got = sample(labelled, url_col, label_col, sample_rows).collect()
    got.sort(key=lambda r: r["u"])
    return train([r["u"] for r in got], np.array([float(r["y"]) for r in got]))


def judge(pages: DataFrame, model: Model, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_score) of each url."""
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            yield pa.array(1 / (1 + np.exp(-np.clip(sent.value.margin(urls.to_pylist()), -30, 30))), pa.float64())

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    out = out.withColumn("block_score", scored("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    out = out.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.select("id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "block_score")


def labelled_by(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url_col: str = "url") -> DataFrame:
    """Urls that a rule decides, labelled 1 where it blocks."""
    rule = rule_of(host_of(F.col(url_col)), path_of(F.col(url_col)), rules)
    return pages.select(F.col(url_col).alias("url"), (rule["verdict"] == "block").cast("int").alias("label")).where("label is not null")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_by(pages))).withColumnRenamed("id", "page_id")
