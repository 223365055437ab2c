"""Near-duplicate documents by the Jaccard similarity of their word shingles, checked exactly.

Candidates share a band of MinHash values: at similarity 0.8 a pair shares at least one of ``BANDS``
bands of ``ROWS`` values with probability 0.997, at 0.85 with 0.9999. Texts with equal sets of shingles are
one node. Each bucket first gives a star around its smallest node; the rest of a bucket whose nodes the
stars left apart stands together in a task with its sets, which compares the pairs that are still
apart and returns a spanning forest. So no pair that shares a band stays unchecked unless its ends are
linked already, and what moves are the members of a bucket, never its pairs. Buckets of many shingles are
cut into chunks, each pair of chunks being a unit of its own; the comparisons inside one stay
quadratic in the nodes that are apart. With ``bits``, texts whose SimHash fingerprints differ in at most so
many bits (:mod:`tabloom.llm.simhash`, found at the anchors of its covering code) are linked as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm import simhash
from tabloom.llm.common import arrow_schema, fresh, map_batches, type_of
from tabloom.llm.graph import components
from tabloom.operators.ordering import broadcast_if_small
from tabloom.session import cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 8
SEED = 7
AT_ONCE = 1 << 12  # shingles that are hashed at once
UNIT_SHINGLES = 1 << 19  # shingles of a bucket that are one unit


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of words, sorted; a shorter text is one shingle. Only A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # on bytes: ASCII white space, ASCII letters
    k = min(shingle, len(words))
    grams = (b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)) if words else ()
    return np.unique(np.fromiter((xxh64_intdigest(g) for g in grams), dtype=np.uint64))


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key (int64) per band of MinHash values; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    draw = np.random.default_rng(SEED)
    n = bands * rows
    mul = draw.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)
    add = draw.integers(0, 1 << 32, n, dtype=np.uint32)
    mix = draw.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    salt = draw.integers(0, 1 << 63, bands, dtype=np.uint64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(n, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), AT_ONCE):
        low = np.minimum(low, (high[at : at + AT_ONCE, None] * mul + add).min(axis=0))
    key = (low.astype(np.uint64) * mix).reshape(bands, rows).sum(axis=1, dtype=np.uint64) + salt
    return ((key ^ key >> np.uint64(31)) * mix[:bands]).view(np.int64)


def _row_key(doc_id: str, text: str) -> Column:
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    return F.concat(F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("n")), F.lit(":"), digest)


def _signed(docs: DataFrame, doc_id: str, text: str, shingle: int, bits: int | None) -> DataFrame:
    """Rows (doc_id, key, node, n, bands, fp): key of the row, digest and size of its set of shingles, fingerprint where wanted."""
    from xxhash import xxh3_128_digest

    def start():
        def each(batch):
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            sets = [shingles(t, shingle) for t in texts]
            prints = np.array([0 if bits is None else simhash.fingerprint(t) for t in texts], dtype=np.uint64)
            yield {
                "doc_id": batch.column(0), "key": batch.column(1), "node": [xxh3_128_digest(s.tobytes()) for s in sets],
                "n": [len(s) for s in sets], "bands": [band_keys(s) for s in sets],
                "fp": prints.view(np.int64),
            }

        return each

    picked = docs.select(
        F.col(doc_id).alias("doc_id"), _row_key(doc_id, text).alias("key"), F.col(text).cast("string").cast("binary").alias("text")
    )
    return map_batches(picked, f"doc_id {type_of(picked, 'doc_id')}, key string, node binary, n long, bands array<long>, fp long", start)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """Rows (node, n, set) of rows (node, text)."""

    def start():
        def each(batch):
            found = [shingles(t or b"", shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield {"node": batch.column(0), "n": [len(x) for x in found], "set": found}

        return each

    return map_batches(texts, "node binary, n long, set array<long>", start)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar."""
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    met = pairs.join(a, "a").join(b, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return met.where(F.col("both") >= similarity * (F.size("x") + F.size("y") - F.col("both")) - 1e-9).select("a", "b")


def unit_links(label: np.ndarray, own: np.ndarray, n: np.ndarray, values: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of the links that connect a unit, between rows of different labels.

    The rows stand by the size ``n`` of their sets, which lie one after the other in ``values``. Where a
    unit is of two chunks (``own``), only rows of different ones are compared.
    """
    label, crossed = label.copy(), own.min() != own.max()
    starts = np.concatenate([[0], np.cumsum(n)])
    codes = np.unique(values, return_inverse=True)[1]
    mark = np.zeros(len(values), dtype=bool)
    ends = np.searchsorted(n, (n + 1e-9) / similarity, side="right")  # larger sets are too large
    a, b = [], []
    for x, end in enumerate(ends.tolist()):
        y = slice(x + 1, end)
        wanted = label[y] != label[x]
        if crossed:
            wanted &= own[y] != own[x]
        if not wanted.any():
            continue
        mine = codes[starts[x] : starts[x + 1]]
        mark[mine] = True
        both = np.add.reduceat(mark[codes[starts[x + 1] : starts[end]]], starts[y] - starts[x + 1], dtype=np.int64)
        mark[mine] = False
        near = np.flatnonzero(wanted & (both >= similarity * (n[x] + n[y] - both) - 1e-9))
        if len(near):
            met, first = np.unique(label[y][near], return_index=True)
            a.append(np.full(len(met), x))
            b.append(x + 1 + near[first])
            label[np.isin(label, met)] = label[x]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _unit_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of rows (cell, i, j, own, node, label, n, set) that stand unit by unit; a unit may cross batches."""
    target = arrow_schema(rows.sparkSession, "a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(table: pa.Table) -> pa.RecordBatch:
            own, node, label, n, sets = (table[c].combine_chunks() for c in ("own", "node", "label", "n", "set"))
            codes = np.unique(np.array(label.to_pylist(), dtype=object), return_inverse=True)[1]
            found = unit_links(codes, own.to_numpy(), n.to_numpy(), sets.flatten().to_numpy(), similarity)
            return pa.RecordBatch.from_arrays([node.take(pa.array(k)).cast(f.type) for k, f in zip(found, target, strict=True)], schema=target)

        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(3)])
            first = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(keys)]]).tolist()
            for f, l in zip(first, first[1:], strict=False):
                if held and last != keys[f].tolist():
                    yield made(pa.concat_tables(held))
                    held = []
                held.append(pa.Table.from_batches([batch.slice(f, l - f)]))
                last = keys[f].tolist()
        if held:
            yield made(pa.concat_tables(held))

    return rows.mapInArrow(run, "a binary, b binary")


def _within(met: DataFrame, sets: DataFrame, first: DataFrame, similarity: float, unit_shingles: int) -> DataFrame:
    """Edges (a, b) that connect what is alike in the buckets of ``met``, beside the links ``first`` of their stars."""
    up = first.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
    above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
    known = up.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("label"))
    known = cut_lineage(sets.select("node", "n").join(known, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label")))
    apart = met.where("node <> lo").select("cell", "node").join(known, "node")
    chunks = F.ceil(F.sum("n") / unit_shingles).cast("int").alias("chunks")
    mixed = apart.groupBy("cell").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), chunks).where("l1 <> l2")
    left = cut_lineage(apart.join(mixed.select("cell", "chunks"), "cell"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    unit = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j")))
    units = left.withColumn("own", own).withColumn("unit", F.explode(unit)).drop("n").join(sets, "node")
    laid = units.select("cell", "unit.i", "unit.j", "own", "node", "label", "n", "set")
    return _unit_links(laid.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "n", "node"), similarity)


def _close(signed: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints differ in at most so many bits."""
    prints = cut_lineage(signed.groupBy("fp").agg(F.min("node").alias("first")))
    alike = signed.join(prints, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = simhash.links(prints.select("fp", F.col("fp").alias("node")), max_bits=bits).distinct()
    a, b = (prints.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab")
    apart = links.join(a, "a").join(b, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return cut_lineage(alike.unionByName(apart))


def _groups(signed: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float, bits: int | None,
            unit_shingles: int) -> DataFrame:
    """Rows (node, component) of the nodes that link with another."""
    rows = signed.groupBy("node").agg(F.any_value("bands").alias("bands")).select(F.explode("bands").alias("cell"), "node")
    rows = rows.repartition("cell")  # one exchange for both uses
    shared = rows.groupBy("cell").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("cell", "lo")
    met = cut_lineage(rows.join(shared, "cell"))
    # Texts of the nodes that meet another one, by the key of one of their rows.
    keys = signed.groupBy("node").agg(F.min("key").alias("_k"))
    wanted = cut_lineage(keys.join(met.select("node").distinct(), "node"))
    keyed = docs.select(_row_key(doc_id, text).alias("_k"), F.col(text).cast("string").cast("binary").alias("text"))
    texts = keyed.join(broadcast_if_small(wanted, wanted.count()), "_k").select("node", "text")
    sets = cut_lineage(_sets(texts, shingle).dropDuplicates(["node"]))
    star = met.where("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    first = cut_lineage(_alike(star, sets, similarity))
    links = first.unionByName(_within(met, sets, first, similarity, unit_shingles))
    return components(links if bits is None else links.unionByName(_close(signed, bits)))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
                 bits: int | None = None, unit_shingles: int = UNIT_SHINGLES) -> DataFrame:
    """One row per group of texts that are linked by pairs of at least this similarity, or by fingerprints; columns as they were.

    The row with the smallest doc_id stays, one without a doc_id only where the group has no other; of
    rows with equal doc_id and text one stays. Texts without words (null, empty, blank) are one group.
    """
    signed = cut_lineage(_signed(docs, doc_id, text, shingle, bits))
    named = signed.join(_groups(signed, docs, doc_id, text, shingle, similarity, bits, unit_shingles), "node", "left")
    rows = named.select("doc_id", "key", F.coalesce("component", "node").alias("c"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("key"))
    best = rows.groupBy("c").agg(F.min(order).alias("best")).select("c", F.col("best.key").alias("best"))
    key, other = fresh(docs, "__key"), fresh(docs, "__other")
    gone = cut_lineage(rows.join(best, "c").where("key <> best").select(F.col("key").alias(other)).distinct())
    stays = docs.withColumn(key, _row_key(doc_id, text)).join(broadcast_if_small(gone, gone.count()), F.col(key) == F.col(other), "left_anti")
    again = cut_lineage(signed.groupBy(F.col("key").alias(other)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(other))
    if again.isEmpty():
        return stays.drop(key)
    once = stays.join(again, F.col(key) == F.col(other), "left_anti")
    one = stays.join(again, F.col(key) == F.col(other), "left_semi").dropDuplicates([key])
    return once.unionByName(one).drop(key)
