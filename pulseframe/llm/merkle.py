"""A Merkle manifest of a dataset: digests of rows, a tree over each group of them and over the groups, and a proof for every row.

Rows are ranked inside their group; the rank's digits to the base FAN are columns. Inside a block of FAN ** DIGITS consecutive rows the digit columns are
grouped away one after another, and each grouping nests the structs of a run under their parent, so a block ends as one row that
holds its tree. The block is the only key that is shuffled. Where a group has more blocks than one, their roots are ranked already and go
through the same step, tier by tier; the groups' roots form a tree of their own. Proofs come back the other way: each level is transformed
to structs with their siblings and exploded, which needs no join inside a block. Between tiers one row per block is joined with
its proof from above; no key of that join comes twice.

Rows of a group ascend by id, then by digest; null ids go first. A run's digest is the SHA-256 of its digests as hex text, also of a run of one; a
group of one row is its own root. Groups are ordered by lang, null first, by their bytes. Repeated rows are a leaf each. Nulls have a mark of their own, so
they differ from empty strings; an empty table gives no rows; columns beyond the five are ignored, whatever their names. Long
texts are only digested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ranked, table

#: Nodes of a run, as a power of two; levels of a block.
BITS, DIGITS = 3, 4
FAN = 1 << BITS
#: Columns that a leaf's digest covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**instead: Column) -> Column:
    """SHA-256 over the covered columns, each with its length; instead: expressions in place of columns."""
    return F.sha2(F.concat(*(_field(instead.get(c, F.col(c))) for c in COVERED)), 256)


def node_digest(digests: Column) -> Column:
    """SHA-256 of an array of digests, as hex text one after another."""
    return F.sha2(F.array_join(digests, ""), 256)


def _levels(size: Column) -> Column:
    """How often a group of so many rows is grouped: the digits of its last rank; none of a single row."""
    return F.when(size > 1, F.length(F.conv((size - 1).cast("string"), 10, FAN))).otherwise(0)


def _nest(nodes: DataFrame, carried: list[str], base: int) -> DataFrame:
    """tree, size, rank, h and node (h and run, nested) of each block of nodes: tree, size, rank, h and the carried columns."""
    digit = [F.shiftright("rank", BITS * i).bitwiseAND(FAN - 1).cast("int").alias(f"d{i}") for i in range(DIGITS)]
    rows = nodes.select("tree", "size", F.shiftright("rank", BITS * DIGITS).alias("block"), *digit, F.struct("h", *carried).alias("node"))
    rows = rows.repartition("tree", "block")  # all groupings below keep this partitioning
    for i in range(DIGITS):
        keys = ["tree", "size", "block", *(f"d{j}" for j in range(i + 1, DIGITS))]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(f"d{i}", "node"))).getField("node").alias("run"))
        digests = F.col("run").getField("h")
        h = F.when(_levels(F.col("size")) > base + i, node_digest(digests)).otherwise(digests[0])
        rows = rows.select(*keys, F.struct(h.alias("h"), "run").alias("node"))
    return rows.select("tree", "size", F.col("block").alias("rank"), "node.h", "node")


def _grow(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Blocks of nodes, blocks of their roots, and so on until each tree has one; every tier is written."""
    tiers = [materialise(_nest(nodes, carried, 0), "merkle")]
    most = tiers[0].agg(F.max("size")).first()[0] or 0
    while most > FAN ** (DIGITS * len(tiers)):
        tiers.append(materialise(_nest(tiers[-1].select("tree", "size", "rank", "h"), ["rank"], DIGITS * len(tiers)), "merkle"))
    return tiers


_PROOF = "array<struct<at:int,others:array<string>>>"


def _unfold(blocks: DataFrame, base: int, kept: list[str], carried: list[str]) -> DataFrame:
    """The nodes below blocks with their proofs: at each level the place in the run and the siblings' digests."""
    rows = blocks.select("tree", "size", "proof", "node", *kept)
    for i in reversed(range(DIGITS)):
        digests = F.col("node.run").getField("h")
        steps = F.transform("node.run", lambda c, k: F.struct(c.alias("node"), k.cast("int").alias("at")))
        rows = rows.select("tree", "size", "proof", *kept, digests.alias("digests"), F.explode(steps).alias("s"))
        others = F.concat(F.slice("digests", F.lit(1), F.col("s.at")), F.slice("digests", F.col("s.at") + 2, F.lit(FAN)))
        step = F.array(F.struct(F.col("s.at").alias("at"), others.alias("others"))).cast(_PROOF)
        rows = rows.select("tree", "size", *kept, F.when(_levels(F.col("size")) > base + i, F.concat(step, "proof")).otherwise(F.col("proof")).alias("proof"), F.col("s.node").alias("node"))
    return rows.select("tree", *kept, "proof", "node.h", *(F.col("node")[c].alias(c) for c in carried))


def _prove(tiers: list[DataFrame], tops: DataFrame, kept: list[str], carried: list[str]) -> DataFrame:
    """The lowest nodes with proofs; tops: tree, its proof above and what is kept."""
    rows = tiers[-1].join(tops, "tree")
    for depth in reversed(range(1, len(tiers))):
        below = _unfold(rows, DIGITS * depth, kept, ["rank"]).drop("h")
        rows = tiers[depth - 1].join(below, ["tree", "rank"])
    return _unfold(rows, 0, kept, carried)


def manifest(docs: DataFrame, **carry: Column) -> DataFrame:
    """doc_id, lang, leaf, subroot, root and proof of every row, and the carried expressions of docs.

    proof: from the leaf up to the root, the place in each run and the siblings there.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))  # null first
    names = ["doc_id", "lang", *carry]
    rows = docs.select("doc_id", "lang", leaf_digest().alias("h"), tree.alias("tree"), *(v.alias(k) for k, v in carry.items()))
    rows = ranked(materialise(rows, "leaves"), ["tree"], ["doc_id", "h"], "leaves")
    groups = _grow(rows, names)
    roots = groups[-1].select(F.col("tree").alias("name"), "h")
    roots = ranked(materialise(roots.withColumn("tree", F.lit("")), "subroots"), ["tree"], ["name"], "subroots")
    top = _grow(roots, ["name"])
    start = top[-1].select("tree", F.array().cast(_PROOF).alias("proof"), F.col("h").alias("root"))
    subroots = _prove(top, start, ["root"], ["name"]).select(F.col("name").alias("tree"), "proof", "root", F.col("h").alias("subroot"))
    return _prove(groups, subroots, ["subroot", "root"], names).select("doc_id", "lang", F.col("h").alias("leaf"), "subroot", "root", "proof", *carry)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest leads to along its proof."""

    def up(h: Column, step: Column) -> Column:
        at, others = step.getField("at"), step.getField("others")
        return node_digest(F.concat(F.slice(others, F.lit(1), at), F.array(h), F.slice(others, at + 1, F.lit(FAN))))

    return F.aggregate(proof, leaf, up)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the documents; texts of every third id, by its checksum, are tampered with: A-Z in lower case."""
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    rows = manifest(docs, altered=F.when(third, leaf_digest(text=lower)))
    rows = rows.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("proof")))
    siblings = F.flatten(F.col("proof").getField("others"))
    return rows.select("doc_id", "leaf", "subroot", "root", node_digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL groups at most: eight to their power rows of a group.
SQL_LEVELS = 9


def oracle(levels: int = SQL_LEVELS) -> str:
    """The same rows in SQL, level by level, for groups of up to 8 ** levels rows; n: nodes of the groups, m: of the groups' roots."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in COVERED) + ")"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda s: coalesce(ascii(nullif(s, '')), 256)::UBIGINT)), lambda c, b: CASE WHEN b = 256 THEN c ELSE list_reduce(list_prepend(xor(c, b), range(8)::UBIGINT[]), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1))) END)"
    parts = [
        f"d AS (SELECT *, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(f'''translate(text, '{upper}', '{lower}')''')} END AS altered FROM documents)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)",
        "n0 AS (SELECT coalesce('1' || lang, '0') AS t, i, leaf AS h FROM r)",
    ]

    def climb(n: str) -> None:
        for k in range(levels):
            run = f"PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN"
            parts.append(f"""{n}s{k} AS (SELECT *, count(*) OVER (PARTITION BY t) > 1 AS many, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS pre,
coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS post FROM {n}{k})""")
            parts.append(f"{n}{k + 1} AS (SELECT t, i // 8 AS i, CASE WHEN bool_and(many) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {n}s{k} GROUP BY t, i // 8)")

    climb("n")
    parts.append(f"m0 AS (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS i, h, t AS name FROM n{levels})")
    climb("m")
    parts.append(f"f0 AS (SELECT r.*, coalesce('1' || lang, '0') AS t, coalesce(altered, leaf) AS folded, '' AS sib FROM r)")
    for k in range(levels):
        parts.append(f"f{k + 1} AS (SELECT f{k}.* REPLACE (CASE WHEN many THEN sha256(pre || folded || post) ELSE folded END AS folded, CASE WHEN many THEN sib || pre || post ELSE sib END AS sib, f{k}.i // 8 AS i) FROM f{k} JOIN ns{k} s ON s.t = f{k}.t AND s.i = f{k}.i)")
    parts.append(f"g0 AS (SELECT f{levels}.* REPLACE (m0.i AS i), m0.h AS subroot FROM f{levels} JOIN m0 ON m0.name = f{levels}.t)")
    for k in range(levels):
        parts.append(f"g{k + 1} AS (SELECT g{k}.* REPLACE (CASE WHEN many THEN sha256(pre || folded || post) ELSE folded END AS folded, CASE WHEN many THEN sib || pre || post ELSE sib END AS sib, g{k}.i // 8 AS i) FROM g{k} JOIN ms{k} s ON s.i = g{k}.i)")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, m.h AS root, sha256(sib) AS proof_sha256, folded AS folded_root, folded = m.h AS verified FROM g{levels}, m{levels} m"


ORACLE_OP11 = oracle()
