"""URL filters: rules by host and path, then gradient-boosted trees on lexical features.

Everything that touches rows is a DataFrame expression: host, path and rule, the features (length,
depth, digit ratio, entropy, parameter counts, suffix statistics), their bins, the trees as sums of
CASE expressions. Training is a Spark aggregate a level: labelled URLs are grouped into cells of equal
bins once, and each level of each tree sums gradients and hessians by (node, feature, bin); the driver
sees at most nodes x features x bins sums and picks the splits. Labels of the query are the verdicts
of the rules on the URLs that they fit, weighed so that both verdicts count alike. The statistics of a
suffix or site that a labelled URL is trained with leave out the URLs of its own fold.

Defined results: a null url, or one without ://, has an empty host and path and no rule, and is judged
by the trees; without labels of both kinds the trees are constant, and a tie allows; repeated rows get
equal verdicts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.boosting import best_splits
from gaugeline.llm.common import hold

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the query, as (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
BINS = 16
NUMERIC = ("f_length", "f_host", "f_path", "f_depth", "f_labels", "f_digits", "f_host_digits", "f_entropy", "f_params", "f_marks", "f_scheme", "f_last", "f_suffix_rows", "f_suffix_rate", "f_site_rows", "f_site_rate")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Of equally long ones the longer host wins, then the lesser text."""
    rule = verdict = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), [-ord(c) for c in r[1]])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def with_lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix (last label), site (last two) and the features that one URL gives."""
    u = F.coalesce(F.col(url), F.lit(""))
    df = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path = F.col("host"), F.col("path")
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    share = lambda c: (F.length(u) - F.length(F.replace(u, c))) / n
    return df.withColumns({
        "suffix": F.substring_index(host, ".", -1),
        "site": F.substring_index(host, ".", -2),
        "f_length": F.length(u).cast("double"),
        "f_host": F.length(host).cast("double"),
        "f_path": F.length(path).cast("double"),
        "f_depth": count_of(path, "/"),
        "f_labels": F.when(host == "", 0.0).otherwise(count_of(host, r"\.") + 1),
        "f_digits": count_of(u, "[0-9]") / n,
        "f_host_digits": count_of(host, "[0-9]"),
        "f_entropy": F.coalesce(F.aggregate(F.array_distinct(F.split(u, "(?!^)")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))), F.lit(0.0)),
        "f_params": F.when(u.contains("?"), count_of(u, "[&;]") + 1).otherwise(0.0),
        "f_marks": count_of(u, "[-_%#=.]"),
        "f_scheme": u.startswith("https://").cast("double"),
        "f_last": F.length(F.substring_index(path, "/", -1)).cast("double"),
    })


@dataclass
class Model:
    """Bin borders of every feature; trees as (feature, cut, leaf) of complete trees; statistics of every suffix
    and site of the labelled rows, of which there are no more than of those rows."""

    suffixes: DataFrame
    sites: DataFrame
    edges: list[list[float]]
    bias: float
    trees: list[tuple[list[int], list[int], list[float]]] = field(default_factory=list)

    def joined(self, df: DataFrame) -> DataFrame:
        """Adds the suffix statistics; Spark broadcasts the tables while they are small."""
        for key, table in (("suffix", self.suffixes), ("site", self.sites)):
            df = df.join(table, key, "left")
        return with_rates(df)

    def binned(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"b{j}": sum((F.col(c) > e).cast("int") for e in self.edges[j]) if self.edges[j] else F.lit(0) for j, c in enumerate(NUMERIC)})

    @staticmethod
    def node(feature: list[int], cut: list[int], level: int) -> Column:
        """The number of the node on a level that a row reaches."""

        def under(k: int, depth: int) -> Column:
            if depth == level:
                return F.lit(k - 2**level)
            return F.when(F.col(f"b{feature[k - 1]}") > cut[k - 1], under(2 * k + 1, depth + 1)).otherwise(under(2 * k, depth + 1))

        return under(1, 0)

    def margin(self) -> Column:
        out = F.lit(self.bias)
        for feature, cut, leaf in self.trees:
            level = int(np.log2(len(leaf)))
            out = out + F.element_at(F.array(*map(F.lit, leaf)), self.node(feature, cut, level) + 1)
        return out


def with_rates(df: DataFrame) -> DataFrame:
    """Turns n_ and pos_ of suffix and site into the logarithm of the rows and the smoothed block rate."""
    for k in ("suffix", "site"):
        n, pos = F.coalesce(f"n_{k}", F.lit(0.0)), F.coalesce(f"pos_{k}", F.lit(0.0))
        df = df.withColumns({f"f_{k}_rows": F.log1p(n), f"f_{k}_rate": (pos + 1) / (n + 2)}).drop(f"n_{k}", f"pos_{k}")
    return df


def counted(rows: DataFrame, key: str, *by: str) -> DataFrame:
    """Labelled rows and blocked ones of every value of key."""
    return rows.groupBy(key, *by).agg(F.count(F.lit(1)).cast("double").alias(f"n_{key}"), F.sum("y").cast("double").alias(f"pos_{key}"))


def fit(labelled: DataFrame, trees: int = 12, depth: int = 3, rate: float = 0.3, l2: float = 1.0, folds: int = 5, bound: int = 200_000) -> Model:
    """Trees from (url, y) with y 1 for block and 0 for allow; beyond `bound` rows, a share of about `bound` by a hash of the url."""
    labelled = labelled.where("y is not null")
    rows = labelled.count()
    if rows > bound:
        labelled = labelled.where(F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(1_000_000)) < int(1e6 * bound / rows))
    lexical = with_lexical(labelled.select("url", "y", F.pmod(F.xxhash64(F.coalesce("url", F.lit("")), F.lit(3)), F.lit(folds)).alias("fold")))
    lexical = hold(lexical.drop("url"))  # about `bound` rows, read by the statistics, the cuts and the cells
    model = Model(hold(counted(lexical, "suffix")), hold(counted(lexical, "site")), [], 0.0)
    joined = lexical
    for key, table in (("suffix", model.suffixes), ("site", model.sites)):
        own = hold(counted(lexical, key, "fold")).withColumnsRenamed({f"n_{key}": "n_own", f"pos_{key}": "pos_own"})
        joined = joined.join(table, key).join(own, [key, "fold"])
        share = F.lit(folds / (folds - 1))  # so that frequencies are those of all folds
        joined = joined.withColumns({f"{c}_{key}": (F.col(f"{c}_{key}") - F.col(f"{c}_own")) * share for c in ("n", "pos")}).drop("n_own", "pos_own")
    joined = with_rates(joined)
    cuts = joined.agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"), *(F.percentile_approx(c, [k / BINS for k in range(1, BINS)], 1000).alias(c) for c in NUMERIC)).first()
    model.edges = [sorted(set(cuts[c] or ())) for c in NUMERIC]
    n, pos = cuts["n"], cuts["y"] or 0
    if not 0 < pos < n:
        model.bias = 0.0 if not n else 5.0 if pos else -5.0
        return model
    weight = F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))
    bins = [f"b{j}" for j in range(len(NUMERIC))]
    cells = model.binned(joined).groupBy(*bins).agg(F.sum(weight).alias("w"), F.sum(weight * F.col("y")).alias("w1"))
    cells = hold(cells.coalesce(8))
    for _ in range(trees):
        feature: list[int] = []
        cut: list[int] = []
        p = 1 / (1 + F.exp(-model.margin()))
        leaf: list[float] = []
        for level in range(depth + 1):
            here = cells.select(Model.node(feature, cut, level).alias("node"), (F.col("w") * p - F.col("w1")).alias("g"), (F.col("w") * p * (1 - p)).alias("h"), *bins)
            if level == depth:
                sums = {r["node"]: r for r in here.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()}
                leaf = [-rate * sums[k]["g"] / (sums[k]["h"] + l2) if k in sums else 0.0 for k in range(2**depth)]
                break
            g, h = np.zeros((2, 2**level, len(NUMERIC), BINS))
            for r in here.select("node", "g", "h", F.posexplode(F.array(*bins)).alias("j", "bin")).groupBy("node", "j", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                g[r["node"], r["j"], r["bin"]], h[r["node"], r["j"], r["bin"]] = r["g"], r["h"]
            at, to = best_splits(g, h, l2, 1.0)
            feature += at.tolist()
            cut += to.tolist()
        model.trees.append((feature, cut, leaf))
    return model


def ruled(rows: DataFrame, rules: tuple[tuple[str, str], ...], inline: int) -> DataFrame:
    """Adds host, path, rule and ruling to rows with a url.

    Up to `inline` rules are one expression; more are a table, which the distinct hosts and paths meet on
    each of the host's suffixes, and of what fits the best is taken."""
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if len(rules) <= inline:
        rule, ruling = rule_of(F.col("host"), F.col("path"), rules)
        return rows.withColumns({"rule": rule, "ruling": ruling})
    order = sorted(rules, key=lambda r: (len(r[1]), len(r[1].partition("/")[0]), [-ord(c) for c in r[1]]))
    known = {text: (k, text.partition("/")[0], "".join(text.partition("/")[1:]), text, action) for k, (action, text) in enumerate(order)}
    table = rows.sparkSession.createDataFrame(list(known.values()), "nth int, suffix string, start string, rule string, ruling string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = rows.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes)).join(table, "suffix").where(F.col("path").startswith(F.col("start")))
    best = met.groupBy("host", "path").agg(F.max(F.struct("nth", "rule", "ruling")).alias("best")).select("host", "path", "best.rule", "best.ruling")
    return rows.join(best, ["host", "path"], "left")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, model: Model | None = None, inline: int = 200) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the trees' chance of block) for every row.

    Without a model, one is trained on the URLs that the rules fit."""
    rows = ruled(pages.select("page_id", "url"), rules, inline)
    if model is None:
        model = fit(rows.where("ruling is not null").select("url", (F.col("ruling") == "block").cast("int").alias("y")))
    out = model.binned(model.joined(with_lexical(rows)))
    out = out.withColumn("score", 1 / (1 + F.exp(-model.margin())))
    tree = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return out.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", "rule", F.coalesce("ruling", tree).alias("verdict"), "score")
