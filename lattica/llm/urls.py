"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest. Native only.

Trees are grown by DataFrame aggregations: training rows are dealt once to a row for each feature, and a level is one
aggregation of these by tree node, feature and bin, of which only the sums (nodes x features x bins rows) reach the
driver, which picks the splits. Splits and leaves enter as literal arrays, so all levels of all trees run one compiled
plan; margins and gradients are columns that are written once for each tree. Gradients are summed as fixed-point integers, so a model
doesn't depend on the order of rows or partitions. The fitted trees are a SQL expression over the features, inside
whole-stage code generation; URLs are judged without any shuffle.

Training rows are distinct labelled URLs with weights: at most about `sample` of them, half for each class or more
where the other has fewer, picked by a hash of the URL; a row weighs what its URL's copies and the URLs it stands for
weigh. So a URL with a third of all rows is one row. Suffix statistics (smoothed log-odds of block by the host's last
one and last two labels) come from the training rows and hold at most as many rows; they are broadcast where `sample`
is at most BROADCAST_ROWS and joined by shuffle where it is set higher.

Defined results: a null URL or one without `://` has an empty host and path, no rule and the trees' verdict for empty
features. Of rules of one length that fit, the first by verdict and text counts. Without labels every score is 0.5 less
a bit (allow); with one class only, that class; a score of just 0.5 is block. Rows with a null label are not trained on,
and a URL with both labels is trained on with both. Repeated rows are judged alike. Very long URLs are judged whole. An
empty table gives an empty result. Extra columns pass through; where one has the name of a new column, the new one
takes an underscore in front (`free_name`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, table, written

RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")
SAMPLE = 20_000
BROADCAST_ROWS = 100_000
BINS, TREES, DEPTH, RATE, LAMBDA = 16, 10, 3, 0.4, 1.0
_FIXED = 1 << 30
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Appends host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return pages.withColumns({free_name(pages, "host"): host, free_name(pages, "path"): F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def matched(urls: DataFrame, rules: tuple[str, ...] = RULES, host: str = "host", path: str = "path") -> DataFrame:
    """Appends the longest rule that fits (`rule`, null if none does) and its `rule_verdict`."""
    names = free_name(urls, "rule"), free_name(urls, "rule_verdict")
    listed = []
    for r in sorted(rules, key=lambda r: (-len(r.split(" ", 1)[1]), r)):
        verdict, text = r.split(" ", 1)
        own, slash, rest = text.partition("/")
        listed.append(F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(own.lower()).alias("host"), F.lit(slash + rest).alias("path")))
    if not listed:
        return urls.withColumns({k: F.lit(None).cast("string") for k in names})
    fits = F.filter(F.array(*listed), lambda r: ((F.col(host) == r["host"]) | F.endswith(F.col(host), F.concat(F.lit("."), r["host"]))) & F.startswith(F.col(path), r["path"]))
    first = F.get(fits, F.lit(0))
    return urls.withColumns({names[0]: first["rule"], names[1]: first["verdict"]})


def _count(text: Column, kind: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, kind, ""))


def lexical(url: str = "url", host: str = "host", path: str = "path") -> dict[str, Column]:
    """Lexical features of a URL whose host and path are known."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    counts = F.transform(F.array_distinct(F.split(u, "")), lambda c: n - F.length(F.replace(u, c, F.lit(""))))
    spread = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    out = {
        "length": n,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(F.col(path), "/"),
        "labels": F.size(F.split(host, r"\.")),
        "digits": F.when(n > 0, _count(u, "[0-9]") / n).otherwise(0.0),
        "entropy": F.when(n > 0, F.log2(n.cast("double")) - spread / n).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(1 + _count(query, "&")),
        "marks": _count(u, r"[-_%.~]"),
        "fragment": F.instr(u, "#").cast("boolean"),
    }
    return {k: c.cast("double") for k, c in out.items()}


#: Suffix statistics: how many of the host's last labels each looks at.
_TAILS = {"tail1": 1, "tail2": 2}


def _prefix(df: DataFrame) -> str:
    """What no column of df starts with."""
    p = "x_"
    while any(c.lower().startswith(p) for c in df.columns):
        p = f"_{p}"
    return p


def featured(urls: DataFrame, prefix: str, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """Appends lexical features and the suffixes' keys, their names opening with the prefix."""
    tails = {f"{prefix}{k}_key": F.substring_index(host, ".", -n) for k, n in _TAILS.items()}
    return urls.withColumns({f"{prefix}{k}": c for k, c in lexical(url, host, path).items()} | tails)


@dataclass
class Model:
    """bias, trees as nested (feature, threshold, left, right) or leaf values, and suffix statistics by suffix."""

    bias: float = -1e-6
    trees: list = field(default_factory=list)
    suffixes: dict[str, DataFrame] = field(default_factory=dict)
    prior: float = 0.0
    small: bool = True

    def margin(self, prefix: str = "x_") -> Column:
        out = F.lit(self.bias)
        for t in self.trees:
            out = out + F.expr(_sql(t, prefix))
        return out

    def with_suffixes(self, rows: DataFrame, prefix: str = "x_") -> DataFrame:
        """Appends the suffix statistics; a suffix that was not seen gets the prior."""
        for k in _TAILS:
            key, name = f"{prefix}{k}_key", f"{prefix}{k}"
            if k in self.suffixes:
                known = self.suffixes[k].toDF(key, name)
                rows = rows.join(F.broadcast(known) if self.small else known, key, "left").withColumn(name, F.coalesce(name, F.lit(self.prior)))
            else:
                rows = rows.withColumn(name, F.lit(self.prior))
        return rows


def _sql(tree, prefix: str) -> str:
    if not isinstance(tree, tuple):
        return f"cast({tree!r} as double)"
    name, at, left, right = tree
    return f"if(`{prefix}{name}` <= cast({at!r} as double), {_sql(left, prefix)}, {_sql(right, prefix)})"


def training(labelled: DataFrame, url: str, label: str, sample: int) -> tuple[DataFrame, dict[int, tuple[int, int]], int]:
    """Distinct URLs with y and weight (fixed-point, as many ones in all as rows), both classes' (URLs, rows), and how many are kept."""
    known = labelled.where(F.col(label).isin(0, 1)).groupBy(F.col(url).alias("url"), F.col(label).cast("int").alias("y")).agg(F.count("*").alias("copies"))
    known = written(known, "labelled")
    totals = {r.y: (r.n, r.copies) for r in known.groupBy("y").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).collect()}
    kept = {y: min(n, max(sample // 2, sample - sum(m for z, (m, _) in totals.items() if z != y))) for y, (n, _) in totals.items()}
    rows, size = sum(c for _, c in totals.values()), sum(kept.values())
    weight, chosen = F.lit(None).cast("double"), F.lit(False)
    for y, (n, _) in totals.items():
        weight = F.when(F.col("y") == y, F.lit(n / kept[y] * size / rows)).otherwise(weight)
        chosen = chosen | ((F.col("y") == y) & (F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int((1 << 20) * kept[y] / n)))
    return known.where(chosen).select("url", "y", F.round(F.col("copies") * weight * _FIXED).cast("bigint").alias("w")), totals, size


def fit(labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE) -> Model:
    """labelled: url and label (1 block, 0 allow)."""
    rows, totals, size = training(labelled, url, label, sample)
    if len(totals) < 2:
        return Model(bias=-1e-6 if not totals else (20.0 if 1 in totals else -20.0))
    share = totals[1][1] / (totals[0][1] + totals[1][1])
    rows = written(featured(parts(rows), "x_"), "urls")
    model = Model(bias=math.log(share / (1 - share)), prior=math.log(share / (1 - share)), small=size <= BROADCAST_ROWS)
    ones = lambda c: F.sum(c * F.col("w")) / _FIXED
    for k in _TAILS:  # at most one row for each training row
        odds = F.log((ones(F.col("y")) + 10 * share) / (ones(1 - F.col("y")) + 10 * (1 - share)))
        model.suffixes[k] = written(rows.groupBy(f"x_{k}_key").agg(F.round(odds, 9).alias(k)), "suffixes")
    rows = written(model.with_suffixes(rows).coalesce(4), "urls")
    names = [*lexical(), *_TAILS]
    at = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*(F.percentile_approx(f"x_{c}", at, 100_000).alias(c) for c in names)).first()
    edges = {c: sorted(set(found[c] or [])) for c in names}
    edges = {c: e for c, e in edges.items() if e}
    bins = F.array(*(sum((F.col(f"x_{c}") > F.lit(x)).cast("int") for x in e) for c, e in edges.items()))
    rows = rows.select("y", "w", bins.alias("bins"), F.lit(model.bias).alias("margin")).select("*", F.posexplode("bins").alias("f", "b"))
    for _ in range(TREES):
        p = 1 / (1 + F.exp(-F.col("margin")))
        rows = rows.withColumns({"g": F.round((p - F.col("y")) * F.col("w")).cast("bigint"), "h": F.round(p * (1 - p) * F.col("w")).cast("bigint")})
        rows = written(rows, "urls")
        tree = _Tree(edges)
        while tree.open:
            tree.split(rows)
        model.trees.append(tree.nested())
        rows = rows.withColumn("margin", F.col("margin") + F.get(F.lit(tree.leaf), tree.node()))
    return model


class _Tree:
    """Nodes are numbered as in a heap from 1; split holds a node's feature, or -1, and at its last bin to the left."""

    def __init__(self, edges: dict[str, list[float]]):
        self.edges, self.size = edges, 2 << DEPTH
        self.feature, self.at, self.leaf = [-1] * self.size, [0] * self.size, [0.0] * self.size
        self.open = [1]

    def node(self) -> Column:
        """The node that a row has come to."""
        feature, at = F.lit(self.feature), F.lit(self.at)
        step = lambda n, _: F.when(F.get(feature, n) < 0, n).otherwise(2 * n + (F.get("bins", F.get(feature, n)) > F.get(at, n)).cast("int"))
        return F.aggregate(F.lit(list(range(DEPTH))), F.lit(1), step)

    def split(self, rows: DataFrame) -> None:
        """Splits the open nodes where that gains most; their children are open next."""
        by: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
        for r in rows.groupBy(self.node().alias("node"), "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            by.setdefault(r.node, {})[r.f, r.b] = r.g, r.h
        later = []
        for n in self.open:
            if n not in by:
                continue
            total = [sum(x[i] for (f, _), x in by[n].items() if f == 0) for i in (0, 1)]
            best, found = 1e-6 * _FIXED, None
            for f, e in enumerate(self.edges.values()):
                left = [0, 0]
                for b in range(len(e)):
                    left = [x + y for x, y in zip(left, by[n].get((f, b), (0, 0)), strict=True)]
                    right = [total[0] - left[0], total[1] - left[1]]
                    won = _gain(*left) + _gain(*right) - _gain(*total)
                    if min(left[1], right[1]) >= _FIXED and won > best:
                        best, found = won, (f, b, left, right)
            self.leaf[n] = _value(*total)
            if found:
                self.feature[n], self.at[n], left, right = found
                self.leaf[2 * n], self.leaf[2 * n + 1] = _value(*left), _value(*right)
                later += [2 * n, 2 * n + 1]
        self.open = [n for n in later if n < 1 << DEPTH]

    def nested(self, n: int = 1):
        if self.feature[n] < 0:
            return float(self.leaf[n])
        name = list(self.edges)[self.feature[n]]
        return (name, self.edges[name][self.at[n]], self.nested(2 * n), self.nested(2 * n + 1))


def _value(g: int, h: int) -> float:
    return -RATE * g / (h + LAMBDA * _FIXED)


def _gain(g: int, h: int) -> float:
    return g * g / (h + LAMBDA * _FIXED)


def judge(pages: DataFrame, model: Model, rules: tuple[str, ...] = RULES, url: str = "url") -> DataFrame:
    """Appends host, path, rule, score (of block, by the trees) and verdict."""
    host, path, rule, score, verdict = (free_name(pages, c) for c in ("host", "path", "rule", "score", "verdict"))
    x = _prefix(pages)
    rows = parts(pages, url)
    by_rule = free_name(rows, "rule_verdict")
    rows = matched(rows, rules, host, path)
    rows = model.with_suffixes(featured(rows, x, url, host, path), x)
    rows = rows.withColumn(score, 1 / (1 + F.exp(-model.margin(x))))
    rows = rows.withColumn(verdict, F.coalesce(by_rule, F.when(F.col(score) >= 0.5, "block").otherwise("allow")))
    return rows.select(*(F.col(f"`{c}`") for c in (*pages.columns, host, path, rule, score, verdict)))


def by_rules(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pages' host, path, rule and rule_verdict; of those that a rule fits, url and label."""
    ruled = matched(parts(pages))
    return ruled, ruled.where("rule is not null").select("url", (F.col("rule_verdict") == "block").cast("int").alias("label"))


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """Rules label the URLs that they fit; the trees learn from these and judge the others."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = fit(by_rules(pages)[1])
    return judge(pages, model).select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))


def op1_rules(spark, sf_dir: str) -> DataFrame:
    """What of op1_url_filter doesn't depend on the trees: a verdict only where a rule fits."""
    return by_rules(table(spark, sf_dir, "pages").select("page_id", "url"))[0].select("page_id", "host", "path", "rule", "rule_verdict")


def held_out_accuracy(pages: DataFrame, share: int = 5) -> dict[str, float]:
    """Of the URLs that rules fit, those of one hash in `share` are judged by trees that learned from the others."""
    ruled = by_rules(pages)[1]
    test = F.crc32(F.col("url").cast("binary")) % share == 0
    got = judge(ruled.where(test), fit(ruled.where(~test)), rules=())
    row = got.agg(F.count("*"), F.avg((F.col("label") == (F.col("verdict") == "block").cast("int")).cast("double")), F.avg("label")).first()
    return {"rows": row[0], "accuracy": row[1], "blocked": row[2]}


QUERIES = {"op1_url_filter": op1_url_filter, "url_rules": op1_rules}
ORACLE_SQL = {
    "url_rules": r"""
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select * from (values ('com', '/en/', 'com/en/', 'block'), ('example.com', '/en/7', 'example.com/en/7', 'allow'), ('net', '/de/', 'net/de/', 'allow'),
  ('example.net', '/de/8', 'example.net/de/8', 'block'), ('org', '/es/', 'org/es/', 'block')) as v(h, s, rule, verdict))
select page_id, host, path, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as rule_verdict
from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, s) group by page_id, host, path""",
}
