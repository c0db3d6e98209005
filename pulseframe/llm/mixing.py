"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down the tree domain - language - source. At each node it is split among the children by their
weights; a child takes no more than its capacity (tokens below it, times the epochs allowed), and what it can't take goes to its
siblings by their weights. Since a node's own share never exceeds the capacity below it, a shortage reaches other
branches only when all siblings are full, at the level of their parent. Each leaf then reads seeded epochs of its documents, each
epoch in an order of its own, and takes exactly its budget (whole tokens, rounded down) from the start of that stream; the last document may be
taken in part (take_tokens < n_tokens).

Tokens are runs of characters other than [\\x20\\x09-\\x0D]. The texts are read once; budgets come from sums by
leaf. Only a leaf's unfinished epoch needs an order, that of a hash of seed, epoch, id and text. Rows that agree in all of these stand
next to each other, so they are counted first and placed together; running sums are taken in 4,096 buckets of the
hash, so no leaf is ever gathered in a task, whatever it holds. Likewise the children of a node are summed up by their ratio of capacity to weight, and
running sums over ratios are taken in steps of the ratio's logarithm.

Defined cases: null text counts as empty; null language or source is a leaf named 'unknown'; weights that are not
positive get nothing; a budget beyond the whole capacity takes everything; a document without tokens is taken where the stream
hasn't reached the budget at its place (always in full epochs); an
empty table gives no rows; other columns are ignored, unless domain_column names one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, own_columns, row_key, table, unused

LEAF = ("domain", "lang", "source")


@dataclass
class Mix:
    """budget: share of the corpus's tokens; weights by name on each level, with a default for other names.

    domain_column names the documents' domain (null: 'unknown'). Without one, domains are ranges of the first hex digit of the source's MD5.
    """

    budget: float = 0.75
    max_epochs: int = 4
    seed: int = 17
    domains: tuple[tuple[str, str], ...] = (("web", "8"), ("books", "c"), ("code", "g"))  # name, first digit beyond it
    domain_weights: dict[str, float] = field(default_factory=lambda: {"web": 0.5, "books": 0.3, "code": 0.2})
    lang_weights: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    source_weights: dict[str, float] = field(default_factory=lambda: {"src0": 2.0})
    default_weight: float = 1.0
    domain_column: str | None = None

    def domain(self) -> Column:
        if self.domain_column:
            return F.coalesce(F.col(self.domain_column).cast("string"), F.lit("unknown"))
        digit, out = F.substring(F.md5(F.coalesce(F.col("source"), F.lit("unknown")).cast("binary")), 1, 1), F.lit(None)
        for name, beyond in reversed(self.domains):
            out = F.when(digit < beyond, F.lit(name)).otherwise(out)
        return out

    def weight(self, level: str) -> Column:
        known = {"domain": self.domain_weights, "lang": self.lang_weights, "source": self.source_weights}[level]
        out = F.lit(float(self.default_weight))
        for name, w in known.items():
            out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
        return out


#: Steps to a doubling of the ratio of capacity to weight.
STEPS = 64


def fill(children: DataFrame, parents: list[str]) -> DataFrame:
    """Split each parent's budget among its children; adds share.

    children: parents, capacity, weight (positive), budget (the parent's). Children are saturated in order of capacity
    per weight, equal ones together; the others share what is left by weight.
    """
    rows = children if parents else children.withColumn("_all", F.lit(0))
    keys = parents or ["_all"]
    ratio = F.col("capacity") / F.col("weight")
    rows = rows.withColumn("_ratio", ratio).withColumn("_step", F.floor(F.log2("_ratio") * STEPS))
    ratios = rows.groupBy(*keys, "_step", "_ratio").agg(F.sum("capacity").alias("_c"), F.sum("weight").alias("_w"), F.first("budget").alias("_b"))
    line, back = (Window.partitionBy(*keys).orderBy(o) for o in ("_step", F.desc("_step")))
    inside, from_top = (Window.partitionBy(*keys, "_step").orderBy(o) for o in ("_ratio", F.desc("_ratio")))
    before = lambda w: F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = ratios.groupBy(*keys, "_step").agg(F.sum("_c").alias("_c"), F.sum("_w").alias("_w"))
    steps = steps.select(*keys, "_step", before(line).alias("_below"), F.coalesce(F.sum("_w").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_above"))
    placed = ratios.join(steps, [*keys, "_step"])
    ahead = F.col("_above") + F.sum("_w").over(from_top.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_full", (F.col("_b") - F.col("_below") - before(inside)) / ahead >= F.col("_ratio"))
    level = placed.groupBy(*keys).agg(
        F.max(F.when(F.col("_full"), F.col("_ratio"))).alias("_top"),
        (F.first("_b") - F.sum(F.when(F.col("_full"), F.col("_c")).otherwise(0))).alias("_left"),
        F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).alias("_others"),
    )
    full = F.coalesce(F.col("_ratio") <= F.col("_top"), F.lit(False))
    share = F.when(full, F.col("capacity").cast("double")).otherwise(F.col("_left") * F.col("weight") / F.col("_others"))
    return rows.join(level, keys).withColumn("share", share).select(*(c for c in children.columns if c != "budget"), "share")


def leaf_budgets(supply: DataFrame, mix: Mix) -> DataFrame:
    """supply: the leaf's columns and tokens. Adds whole tokens of budget; a row for each leaf that gets some."""
    leaves = supply.where("tokens > 0").withColumn("capacity", F.col("tokens") * mix.max_epochs)
    for level in LEAF:
        leaves = leaves.withColumn(f"w_{level}", mix.weight(level))
    leaves = leaves.where("w_domain > 0 and w_lang > 0 and w_source > 0")
    tokens = supply.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(mix.budget))).first()[0]
    room = leaves.agg(F.coalesce(F.sum("capacity"), F.lit(0))).first()[0]
    above = None
    for depth, level in enumerate(LEAF):
        keys, parents = list(LEAF[: depth + 1]), list(LEAF[:depth])
        nodes = leaves.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.first(f"w_{level}").alias("weight"))
        nodes = nodes.join(above, parents) if parents else nodes.withColumn("budget", F.lit(float(min(tokens, room))))
        # a level's shares are written, so that plans don't nest
        above = materialise(fill(materialise(nodes, "nodes"), parents).select(*keys, F.col("share").alias("budget")), "shares")
    return above.select(*LEAF, F.floor(F.col("budget") + 1e-6).cast("bigint").alias("budget"))


def counted(docs: DataFrame, mix: Mix, *keep: str) -> DataFrame:
    """The kept columns, the leaf, n_tokens and mark (a hash of the text) of every row, written once."""
    name = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    text = F.coalesce("text", F.lit(""))
    tokens = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return materialise(docs.select(*keep, mix.domain().alias("domain"), name("lang").alias("lang"), name("source").alias("source"), tokens.alias("n_tokens"), F.md5(text.cast("binary")).alias("mark")), "counted")


def mix_sources(docs: DataFrame, mix: Mix | None = None, *keep: str) -> DataFrame:
    """doc_id (and kept columns), leaf, epoch, n_tokens, take_tokens: a row for each time a document is read."""
    mix = mix or Mix()
    rows = counted(docs, mix, "doc_id", *keep)
    supply = materialise(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "supply")
    plan = supply.join(leaf_budgets(supply, mix), list(LEAF)).where("budget > 0")
    plan = materialise(plan.select(*LEAF, F.expr("cast(budget div tokens as int)").alias("full"), (F.col("budget") % F.col("tokens")).alias("rest")), "mix-plan")
    planned = rows.join(plan, list(LEAF))
    whole = planned.where("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).withColumn("take_tokens", F.col("n_tokens"))
    key = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark").cast("binary"))
    part = planned.where("rest > 0").withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    part = part.groupBy("doc_id", *keep, *LEAF, "n_tokens", "full", "rest", "_key", "_bucket").agg(F.count(F.lit(1)).alias("_times"))
    part = part.withColumn("_all_tokens", F.col("n_tokens") * F.col("_times"))
    sums = part.groupBy(*LEAF, "_bucket").agg(F.sum("_all_tokens").alias("_sum"))
    up_to = Window.partitionBy(*LEAF).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 rows a leaf at most
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(up_to), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*LEAF, "_bucket").orderBy("_key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = part.join(starts, [*LEAF, "_bucket"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("_all_tokens").over(inside), F.lit(0)))
    placed = placed.where("_before < rest").withColumn("_time", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1)))
    placed = placed.withColumn("_before", F.col("_before") + F.col("_time") * F.col("n_tokens")).where("_before < rest")
    prefix = placed.withColumn("epoch", F.col("full")).withColumn("take_tokens", F.least("n_tokens", F.col("rest") - F.col("_before")))
    out = ("doc_id", *LEAF, "epoch", "n_tokens", "take_tokens", *keep)
    return whole.select(*out).unionByName(prefix.select(*out))


def keep_mixed(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents that a mix of one epoch reads, whole (also the last of each leaf), with all their columns, whatever their names.

    Repeated rows of a document stay or go together.
    """
    (key,) = unused(docs, "row_key")
    bare = docs.select("doc_id", "text", "lang", "source", *([mix.domain_column] if mix.domain_column else []), row_key("doc_id", "text").alias("key"))
    keep = mix_sources(bare, mix, "key").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, row_key("doc_id", "text")).join(keep, key, "left_semi").select(*own_columns(docs))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default mix of the documents."""
    return mix_sources(table(spark, sf_dir, "documents"))


_FILL = """
{name}_r AS (SELECT *, capacity / weight AS ratio FROM {name}_n),
{name}_f AS (SELECT *, (budget - coalesce(sum(capacity) OVER (PARTITION BY {parents} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (PARTITION BY {parents} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= ratio AS saturated FROM {name}_r),
{name}_s AS (SELECT *, CASE WHEN saturated THEN capacity ELSE (budget - sum(CASE WHEN saturated THEN capacity ELSE 0 END) OVER (PARTITION BY {parents})) * weight
  / sum(CASE WHEN saturated THEN 0 ELSE weight END) OVER (PARTITION BY {parents}) END AS share FROM {name}_f)"""


def oracle(mix: Mix | None = None) -> str:
    """The same selection in SQL."""
    mix = mix or Mix()
    case = lambda col, known: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}::DOUBLE" for k, v in known.items()) + f" ELSE {mix.default_weight}::DOUBLE END"
    domain = "CASE " + " ".join(f"WHEN substr(md5(source), 1, 1) < '{b}' THEN '{n}'" for n, b in mix.domains) + " END"
    return rf"""
WITH c AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS mark FROM documents),
r AS (SELECT *, {domain} AS domain FROM c),
s AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM r GROUP BY ALL),
l AS (SELECT *, (tokens * {mix.max_epochs})::DOUBLE AS capacity FROM s WHERE tokens > 0),
root AS (SELECT least(floor((SELECT sum(tokens) FROM s) * {mix.budget}::DOUBLE), (SELECT sum(capacity) FROM l)) AS budget),
d_n AS (SELECT domain, sum(capacity) AS capacity, {case("domain", mix.domain_weights)} AS weight, (SELECT budget FROM root) AS budget FROM l GROUP BY domain),
{_FILL.format(name="d", parents="1", level="domain")},
g_n AS (SELECT l.domain, l.lang, sum(l.capacity) AS capacity, {case("l.lang", mix.lang_weights)} AS weight, any_value(d_s.share) AS budget FROM l JOIN d_s USING (domain) GROUP BY l.domain, l.lang),
{_FILL.format(name="g", parents="domain", level="lang")},
x_n AS (SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, {case("l.source", mix.source_weights)} AS weight, g_s.share AS budget FROM l JOIN g_s USING (domain, lang)),
{_FILL.format(name="x", parents="domain, lang", level="source")},
p AS (SELECT domain, lang, source, floor(share + 1e-6)::BIGINT // tokens AS whole, floor(share + 1e-6)::BIGINT % tokens AS rest FROM x_s WHERE floor(share + 1e-6) > 0),
q AS (SELECT r.*, p.whole, p.rest FROM r JOIN p USING (domain, lang, source)),
b AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{mix.seed}:' || whole || ':' || coalesce(doc_id::VARCHAR, '') || ':' || mark), n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM q WHERE rest > 0)
SELECT doc_id, domain, lang, source, unnest(range(whole))::INT AS epoch, n_tokens, n_tokens AS take_tokens FROM q WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, whole::INT, n_tokens, least(n_tokens, rest - before) FROM b WHERE before < rest
"""


ORACLE_OP1 = oracle()
