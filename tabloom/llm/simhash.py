"""Near-duplicate documents by SimHash, compared at the anchors of a covering code.

A fingerprint has 64 bits, and two link when they differ in at most ``MAX_BITS``. The bits are cut
into blocks; of any two that link, at least one block differs in at most ``MAX_BITS // blocks`` bits.
On each block a covering code is laid out whose words are the anchors: the perfect Hamming code of
length 15 (radius 1) on the first bits and every value on the rest. A fingerprint is at home at the
one anchor within the covering radius and visits every anchor within radius plus threshold. Whatever
links with it through that block visits its home, so comparing visitors with those at home, anchor by
anchor, finds every link.

Only distinct fingerprints are compared: copies share one. Within an anchor the links are reduced to a
spanning forest before they leave the task, so a group of thousands of near copies yields thousands of
edges, not millions. Anchors that many visit are cut into chunks of visitors, every pair of chunks being
a unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import arrow_schema, fresh, map_batches, type_of
from tabloom.llm.graph import components
from tabloom.operators.ordering import broadcast_if_small
from tabloom.session import cut_lineage

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 3
CODE = 15  # length of the Hamming code
UNIT_ROWS = 32_768  # visitors of an anchor that are one unit
PAIRS_AT_ONCE = 1 << 20


# --- fingerprints ------------------------------------------------------------------------------


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the shingles of words; 0 without words. UTF-8 bytes; only A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: ASCII white space, ASCII letters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    n = len(words) - k + 1
    h = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp): one per input row, the fingerprint as a signed long."""

    def start():
        def each(batch):
            found = np.array([fingerprint(t or b"", shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield {"doc_id": batch.column(0), "fp": found.view(np.int64)}

        return each

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return map_batches(picked, f"doc_id {type_of(picked, 'doc_id')}, fp long", start)


# --- anchors -----------------------------------------------------------------------------------


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def syndrome(values: np.ndarray) -> np.ndarray:
    """Of the code's bits: the exclusive or of the places (from 1) of the bits that are set."""
    s = np.zeros(len(values), dtype=np.int64)
    for i in range(CODE):
        s ^= np.where(values >> i & 1, i + 1, 0)
    return s


@lru_cache
def reach(width: int, radius: int) -> list[np.ndarray]:
    """By syndrome: the flips of at most ``radius`` bits that lead to an anchor."""
    by: list[list[int]] = [[] for _ in range(CODE + 1)]

    def grow(flips: int, s: int, next_bit: int, left: int) -> None:
        by[s].append(flips)
        if left:
            for i in range(next_bit, width):
                grow(flips | 1 << i, s ^ (i + 1 if i < CODE else 0), i + 1, left - 1)

    grow(0, 0, 0, radius)
    return [np.array(x, dtype=np.int64) for x in by]


def visits(fp: np.ndarray, blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints (uint64): cells (block and anchor), the index of the visitor, and whether it is at home."""
    cells, who, home = [], [], []
    for b, (first, width) in enumerate(block_bounds(blocks)):
        value = (fp >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        s = syndrome(value)
        flips = reach(width, 1 + max_bits // blocks)
        for k in range(CODE + 1):
            mine = np.flatnonzero(s == k)
            if not len(mine):
                continue
            at = value[mine, None] ^ flips[k][None, :]
            at_home = np.broadcast_to(flips[k] == (1 << (k - 1) if k else 0), at.shape)
            cells.append((at | b << 56).reshape(-1))
            who.append(np.repeat(mine, len(flips[k])))
            home.append(at_home.reshape(-1))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return join(cells, np.int64), join(who, np.int64), join(home, bool)


def _visitors(nodes: DataFrame, blocks: int, max_bits: int) -> DataFrame:
    def start():
        def each(batch):
            fp, node = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            cell, who, home = visits(fp, blocks, max_bits)
            yield {"cell": cell, "fp": fp[who].view(np.int64), "node": node[who], "home": home}

        return each

    return map_batches(nodes.select("fp", "node"), "cell long, fp long, node long, home boolean", start)


# --- links -------------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each member's group, for links between places 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def link_units(unit: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of whole units, which stand together: links between those at home and visitors."""
    n = len(fp)
    if n < 2:
        return node[:0], node[:0]
    edge = np.flatnonzero(np.diff(unit)) + 1
    first, last = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    size = last - first
    end_of = np.repeat(last, size)
    limit = np.uint8(max_bits)
    a, b = [], []
    small = size <= 64  # compared by shifting the whole array against itself
    live = np.flatnonzero(np.repeat(small, size))
    shift = 1
    while len(live):
        live = live[live + shift < end_of[live]]
        x, y = live, live + shift
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= limit) & (home[x] | home[y])
        a.append(x[near])
        b.append(y[near])
        shift += 1
    for f, l in zip(first[~small].tolist(), last[~small].tolist(), strict=True):
        at_home = f + np.flatnonzero(home[f:l])
        step = max(1, PAIRS_AT_ONCE // (l - f))
        for k in range(0, len(at_home), step):
            h = at_home[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fp[h][:, None] ^ fp[None, f:l]) <= limit)
            # Many links of few members: keep what connects them.
            x, y = h[i] - f, j
            root = forest(x, y, l - f)
            moved = np.flatnonzero(root != np.arange(l - f))
            a.append(f + moved)
            b.append(f + root[moved])
    a, b = np.concatenate(a), np.concatenate(b)
    root = forest(a, b, n)
    moved = np.flatnonzero(root != np.arange(n))
    return node[moved], node[root[moved]]


def _links(rows: DataFrame, max_bits: int) -> DataFrame:
    """Edges (a, b) of rows (cell, i, j, fp, node, home) that stand unit by unit; a unit may cross batches."""
    target = arrow_schema(rows.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows_held = 0

        def made(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            cell, i, j, fp, node, home = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.ones(len(cell), dtype=bool)
            new[1:] = (np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
            x, y = link_units(np.cumsum(new), fp.view(np.uint64), node, home, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], schema=target)

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(cols[0]):
                continue
            # The last unit of a batch may go on in the next one.
            unit = np.column_stack(cols[:3])
            whole = int(np.flatnonzero((unit != unit[-1]).any(axis=1))[-1]) + 1 if (unit != unit[-1]).any() else 0
            head = [c[:whole] for c in cols]
            if held and whole:
                yield made([*held, head])
                held, rows_held = [], 0
            elif whole:
                yield made([head])
            held.append([c[whole:] for c in cols])
            rows_held += len(cols[0]) - whole
        if held:
            yield made(held)

    return rows.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, blocks: int = BLOCKS, max_bits: int = MAX_BITS, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Edges (a, b) between the nodes of distinct fingerprints that connect all that link.

    ``nodes`` has one row (fp, node) per fingerprint. More blocks mean fewer copies of a fingerprint
    and less selective anchors: 3 suit up to some hundred million fingerprints, 2 suit more.
    """
    rows = _visitors(nodes, blocks, max_bits)
    crowded = None
    if nodes.limit(unit_rows + 1).count() > unit_rows:  # fewer cannot fill an anchor
        # An anchor of n visitors is cut into n / unit_rows chunks. Anchors are limited in number by
        # the code (half a million at three blocks), and those that are crowded by the visitors.
        crowded = cut_lineage(
            rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > unit_rows)
            .select("cell", F.ceil(F.col("n") / unit_rows).cast("int").alias("chunks"))
        )
    none = F.lit(0)
    plain = rows.withColumns({"i": none, "j": none})
    if crowded is not None and not crowded.isEmpty():
        met = rows.join(broadcast_if_small(crowded, crowded.count()), "cell", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        split = met.where("chunks is not null").withColumn("own", own)
        # Those at home stay in row i of the grid of chunks, visitors in column j. Who is both is in both.
        rows_i = split.where("home").select("cell", "fp", "node", "home", F.col("own").alias("i"), every.alias("j"))
        cols_j = split.select("cell", "fp", "node", F.lit(False).alias("home"), every.alias("i"), F.col("own").alias("j"))
        plain = (
            met.where("chunks is null").drop("chunks").withColumns({"i": none, "j": none})
            .unionByName(rows_i).unionByName(cols_j)
        )
    laid = plain.select("cell", "i", "j", "fp", "node", "home").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node")
    return _links(laid, max_bits)


# --- operator ----------------------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, blocks: int = BLOCKS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable).

    Texts without words (null, empty, blank) have fingerprint zero and link like any other. Rows that
    repeat a doc_id keep their rows, and each has the component of its own text. Rows without a doc_id
    (a long) link and are linked like the others; their component is null if none of its rows has an id.
    Other columns are not read.
    """
    fps = cut_lineage(fingerprints(docs.withColumn(doc_id, F.col(doc_id).cast("long")), doc_id, text, shingle))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Fingerprints are the nodes, as some may belong to no doc_id.
    found = cut_lineage(components(links(nodes.select("fp", F.col("fp").alias("node")), blocks, max_bits)))
    linked = found.join(nodes.withColumnRenamed("fp", "node"), "node")
    named = cut_lineage(linked.groupBy("component").agg(F.min("least").alias("component_id"))).join(found, "component")
    labels = nodes.join(named.select(F.col("node").alias("fp"), "component_id", F.lit(True).alias("in_group")), "fp", "left")
    labels = labels.select("fp", F.when(F.col("in_group"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of one document per component, the one with the smallest doc_id; columns as they were.

    Rows without a doc_id stay; rows that repeat a doc_id stay or go together.
    """
    groups = near_duplicates(docs, doc_id, text, **settings)
    key = fresh(docs, "__id")
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    with_id = docs.where(F.col(doc_id).isNotNull())
    stays = with_id.join(gone, with_id[doc_id] == gone[key], "left_anti")
    return stays.unionByName(docs.where(F.col(doc_id).isNull()))
