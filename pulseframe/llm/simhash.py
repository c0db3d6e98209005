"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; the bit counts of the segments (0 to 2
each) are its embedding. One differing bit moves one count by one, so the Manhattan distance of two
embeddings never exceeds the Hamming distance of the fingerprints. The grid range-join finds all pairs
within Manhattan distance 4: the 32 coordinates form 8 groups of 4, two such embeddings agree on at least 4
of the groups, so both meet in a cell of one of the 70 grids that 4 of 8 groups span. In a cell the
Manhattan bound is applied first, the fingerprints are compared exactly after it, and a cell passes on a
spanning forest of its links, not the pairs. What one comparison has linked isn't compared again, so a dense cell costs about
its size, and only unrelated fingerprints of a cell cost its square.

Counts are kept in unary (0: 00, 1: 01, 2: 11), where the distance is the number of differing bits.

A crowded cell is split by further segment counts. Take two of its members within 4 bits. If the counts of some further group agree,
they meet again in the cell that this group spans with the agreed ones. If none agrees, each further group has a differing
bit, which leaves fewer than two for the groups in the cell; their equal counts allow no single one, so their bits are equal,
and the pair meets in the cell of those bits. Both kinds of cell are made, twice over where need be.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ASCII, join_groups, materialise, own_columns, row_key, table, texts, unused
from .components import connected_components

WIDTH, SEED, MAX_BITS, GROUPS = 4, 42, 4, 8
#: Members from which a cell is split by further counts, and how often it is split.
CELL_SIZE, SPLITS = 2048, 2
_LANES = 0x0101010101010101
_ODD = 0x5555555555555555


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit majority of the XXH64 of all 4-word shingles, repeats included; no words: 0."""
    words = text.translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        return h(joined, SEED)
    ends = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(ends) - 1
    starts = [0, *(ends[: -WIDTH] + 1).tolist()]
    hashes = np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, ends[WIDTH - 1 :].tolist())), np.uint64, len(starts))
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes: eight byte-wide counters to a word, emptied every 255 rows."""
    n, out = len(hashes), 0
    cuts = np.arange(0, n, 255)
    for j in range(8):
        lanes = (hashes >> np.uint64(j)) & np.uint64(_LANES)
        counts = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        out |= sum(1 << (8 * k + j) for k in np.flatnonzero(counts * 2 > n).tolist())
    return out


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with fp, the fingerprint as a signed long."""
    frame = texts(docs, *keep)
    schema = frame.drop("text").withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(at)), np.uint64, batch.num_rows)
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(fps.view(np.int64))], names=[*(batch.schema.names[i] for i in rest), "fp"])

    return frame.mapInArrow(run, schema)


def embedding(fp: Column) -> Column:
    """Unary bit counts of the 32 segments, packed into a long."""
    even, odd = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))


def np_embedding(fp: np.ndarray) -> np.ndarray:
    even, odd = fp & np.uint64(_ODD), (fp >> np.uint64(1)) & np.uint64(_ODD)
    return even | odd | ((even & odd) << np.uint64(1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bits(groups: tuple[int, ...]) -> int:
    return sum(0xFF << (8 * g) for g in groups)


#: Bytes that no four counts make: 10 isn't a unary count.
_TAGS = [x for x in range(256) if any(x >> s & 3 == 2 for s in (0, 2, 4, 6))]


def _tag(groups: tuple[int, ...], number: int) -> int:
    """The number of a kind of cell, in the first byte that no group of the cell uses, so that cells of counts never share a key."""
    return _TAGS[number] << (8 * next(g for g in range(GROUPS) if g not in groups))


#: The groups that span the grids, of each round of splitting.
GRIDS = [list(itertools.combinations(range(GROUPS), GROUPS - MAX_BITS + i)) for i in range(SPLITS + 1)]


def cells(fps: DataFrame) -> DataFrame:
    """(cell, grid, fp): each distinct fingerprint in its cell of each grid; grid numbers the groups."""
    count = embedding(F.col("fp"))
    keys = F.array(*(F.struct(count.bitwiseAND(F.lit(_signed(_bits(g)))).bitwiseOR(F.lit(_signed(_tag(g, i)))).alias("cell"), F.lit(i).alias("grid")) for i, g in enumerate(GRIDS[0])))
    return fps.select(F.inline(keys), "fp")


def _split(fp: np.ndarray, grid: int, round_: int) -> list[tuple[np.ndarray, int]]:
    """Cells that members of a crowded cell go to: those of one more group each, and that of the bits of its groups (grid -1, not split again)."""
    groups, finer = GRIDS[round_][grid], GRIDS[round_ + 1]
    out = [((fp & np.uint64(_bits(groups))) | np.uint64(_tag(groups, len(finer) + grid)), -1)]
    for g in (g for g in range(GROUPS) if g not in groups):
        more = tuple(sorted((*groups, g)))
        i = finer.index(more)
        out.append(((np_embedding(fp) & np.uint64(_bits(more))) | np.uint64(_tag(more, i)), i))
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links (a, b)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes[new != np.arange(len(nodes))], nodes[new[new != np.arange(len(nodes))]]
        root = new


def _linked(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of the members of a cell: each is compared with those that nothing has reached yet."""
    counts, left, todo = np_embedding(fp), np.arange(len(fp)), []
    a, b = [], []
    while len(left):
        if not todo:
            todo, left = [left[0]], left[1:]
        at = todo.pop()
        near = np.flatnonzero(np.bitwise_count(counts[left] ^ counts[at]) <= MAX_BITS)
        near = near[np.bitwise_count(fp[left[near]] ^ fp[at]) <= MAX_BITS]
        if len(near):
            found = left[near]
            a.append(np.full(len(found), fp[at]))
            b.append(fp[found])
            todo += found.tolist()
            left = np.delete(left, near)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _small_cells(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the same cell, of many cells at a time; rows are sorted by cell."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    last = np.repeat(np.r_[starts[1:], len(cell)], np.diff(np.r_[starts, len(cell)]))
    counts, left, right = np_embedding(fp), [], []
    at = np.flatnonzero(np.arange(len(cell)) + 1 < last)
    lag = 1
    while len(at):
        near = at[np.bitwise_count(counts[at] ^ counts[at + lag]) <= MAX_BITS]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= MAX_BITS]
        left.append(fp[near])
        right.append(fp[near + lag])
        lag += 1
        at = at[at + lag < last[at]]
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


#: Members up to which cells are compared many at a time.
FEW = 64


def _cell_links(size: int, round_: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (cell, grid, fp) sorted by cell: links (a, b), and (cell, grid, a) for members of cells that are split."""

    def out(a: np.ndarray, b: np.ndarray | None, cell: np.ndarray | None = None, grid: int = 0) -> pa.RecordBatch:
        long = lambda x: pa.nulls(len(a), pa.int64()) if x is None else pa.array(x.view(np.int64))
        return pa.RecordBatch.from_arrays([long(a), long(b), long(cell), pa.array(np.full(len(a), grid, np.int32))], names=["a", "b", "cell", "grid"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        crowded = None  # the cell whose members are passed on as they come

        def split(fp, grid):
            for key, i in _split(fp, grid, round_):
                yield out(fp, None, key, i)

        def finish(cell, grid, fp):
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
                if n > size and round_ < SPLITS and grid[s] >= 0:
                    yield from split(fp[s : s + n], int(grid[s]))
                else:
                    a, b = _linked(fp[s : s + n])
                    if len(a):
                        yield out(a, b)
            few = np.repeat(sizes <= FEW, sizes)
            if few.any():
                a, b = _small_cells(cell[few], fp[few])
                if len(a):
                    yield out(*forest(a, b))

        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            cell, grid, fp = rows[0].astype(np.int64).view(np.uint64), rows[1], rows[2].astype(np.int64).view(np.uint64)
            if crowded is not None and len(cell):
                same = cell == crowded
                if same.any():
                    yield from split(fp[same], int(grid[0]))
                    cell, grid, fp = cell[~same], grid[~same], fp[~same]
            if not len(cell):
                continue
            tail = np.flatnonzero(cell != cell[-1])
            cut = tail[-1] + 1 if len(tail) else 0
            if cut or (held and held[0][0][0] != cell[0]):
                parts = [*held, (cell[:cut], grid[:cut], fp[:cut])]
                yield from finish(*(np.concatenate(x) for x in zip(*parts)))
                held = []
            held.append((cell[cut:], grid[cut:], fp[cut:]))
            if sum(len(x[0]) for x in held) > size and round_ < SPLITS and grid[-1] >= 0:  # the rest of this cell needs no memory
                yield from split(np.concatenate([x[2] for x in held]), int(grid[-1]))
                crowded, held = cell[-1], []
        if held:
            yield from finish(*(np.concatenate(x) for x in zip(*held)))

    return run


def links(fps: DataFrame, cell_size: int = CELL_SIZE) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs of distinct fingerprints within 4 bits."""
    here, out = cells(fps), None
    for round_ in range(SPLITS + 1):
        found = here.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cell_links(cell_size, round_), "a bigint, b bigint, cell bigint, grid int")
        found = materialise(found, "cell-links")
        own = found.where("cell is null").select("a", "b")
        out = own if out is None else out.unionByName(own)
        here = found.where("cell is not null").select("cell", "grid", F.col("a").alias("fp"))
        if here.isEmpty():
            break
    return out


def _components(per_fp: DataFrame, cell_size: int) -> DataFrame:
    """per_fp (materialised; fp, least, more columns) with root, the fingerprint that stands for the component, and component_id."""
    roots = connected_components(links(per_fp.select("fp"), cell_size))
    linked = materialise(roots.join(per_fp.select(F.col("fp").alias("node"), "least"), "node"), "linked")
    whole = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = linked.join(whole, "root").select(F.col("node").alias("fp"), "root", "component_id")
    out = per_fp.join(moved, "fp", "left").withColumn("root", F.coalesce("root", "fp")).withColumn("component_id", F.coalesce("component_id", "least"))
    return materialise(out, "fingerprint-components")


def near_duplicates(docs: DataFrame, cell_size: int = CELL_SIZE) -> DataFrame:
    """doc_id, fingerprint, component_id of every row.

    Null text counts as empty; texts without words have fingerprint zero and are linked like others;
    component_id is the least non-null doc_id of the component; repeated rows share a fingerprint and
    so a component; an empty table gives no rows; other columns are ignored. Copies meet once, as one fingerprint.
    """
    rows = materialise(fingerprints(docs, "doc_id"), "fingerprints")
    per_fp = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = _components(per_fp, cell_size).select("fp", "component_id", "n")
    return join_groups(rows, found, "fp", "n", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, cell_size: int = CELL_SIZE) -> DataFrame:
    """One document of each component, that with the least doc_id (null ids last); all columns stay, whatever their names."""
    (key,) = unused(docs, "row_key")
    bare = docs.select("doc_id", "text", row_key("doc_id", "text").alias("key"))
    rows = materialise(fingerprints(bare, "doc_id", "key"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    per_fp = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), first.alias("first")), "distinct-fingerprints")
    keep = _components(per_fp, cell_size).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    tagged = docs.withColumn(key, row_key("doc_id", "text"))
    # a key has several rows only where rows are repeated; one of them is left of each task's before any text travels
    return tagged.dropDuplicates([key]).join(keep, key, "left_semi").select(*own_columns(docs))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
