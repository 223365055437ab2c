"""Byte-level BPE: texts to ids and back, long texts in overlapping chunks.

A text is cut by a pattern into pre-tokens, and each pre-token is merged into vocabulary pieces on its
own. Where a pre-token starts decides everything behind it, and nothing before it matters. So a long
text is cut into chunks that overlap, the chunks are pre-tokenised in parallel, and two neighbours are
stitched at the first place in their overlap where both start a pre-token: from there on they agree.
Where an overlap has no such place (one run of letters that is longer than it), the two chunks stay one
piece. The pieces between stitches are then encoded in parallel, and their ids are put together in
order. Texts of one chunk skip all that. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import map_batches, type_of

CHUNK = 1 << 16  # code points a chunk owns
OVERLAP = 1 << 10  # code points it reads beyond
CACHED = 300_000  # stretches whose ids a task remembers; beyond, those of the last block stay
CACHED_LENGTH = 64  # longer ones go then
BLOCK_CHARS = 1 << 21  # characters of texts that are looked up together
WIDTHS = (6, 8, 10, 12, 16, 32, 64)  # bytes of pre-tokens that are merged side by side; longer ones go one by one

# Unicode's white space. No pre-token goes on from another character into it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
STRETCH = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


@dataclass(frozen=True)
class Ranks:
    """Pieces by rank (the ids), the pattern that cuts texts, and which two ids merge into which."""

    ranks: dict[bytes, int]
    pattern: str
    pairs: np.ndarray  # sorted: left id << 32 | right id
    merged: np.ndarray  # the id that each pair makes, which is also its rank
    byte_ids: np.ndarray  # of the 256 single bytes
    byte_pairs: np.ndarray  # what two single bytes make, or the largest number


def vocabulary(ranks: dict[bytes, int], pattern: str) -> Ranks:
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must be a piece")
    found = sorted(
        (ranks[piece[:k]] << 32 | ranks[piece[k:]], rank)
        for piece, rank in ranks.items()
        for k in range(1, len(piece))
        if piece[:k] in ranks and piece[k:] in ranks
    )
    both = np.array(found, dtype=np.int64).reshape(-1, 2)
    none = np.iinfo(np.int32).max
    pairs = np.array([[ranks.get(bytes([a, b]), none) for b in range(256)] for a in range(256)], dtype=np.int32)
    byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
    return Ranks(ranks, pattern, both[:, 0].copy(), both[:, 1].astype(np.int32), byte_ids, pairs)


def read_ranks(path: str, pattern: str) -> Ranks:
    """A rank file: a base64 piece and its rank on every line."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    return vocabulary({base64.b64decode(piece): int(rank) for piece, rank in rows}, pattern)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the neighbours whose union has the lowest rank merge first, from the left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    # Parts are a linked list by their first byte; a heap names the next pair. Entries that no
    # longer describe two living neighbours are skipped.
    n = len(piece)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(at: int) -> None:
        if end[at] < n:
            stop = end[end[at]]
            rank = ranks.get(piece[at:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, at, stop))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, at, stop = heapq.heappop(heap)
        mid = end[at]
        if mid == 0 or mid >= n or end[mid] != stop:
            continue
        end[at], end[mid] = stop, 0  # 0: swallowed
        if stop < n:
            before[stop] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


def merge_many(pieces: list[bytes], vocab: Ranks, width: int) -> Pieces:
    """The same for many pre-tokens of at most ``width`` bytes, one merge of each at a time."""
    none = np.iinfo(np.int32).max
    n = len(pieces)
    length = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    raw = np.frombuffer(b"".join(p.ljust(width + 2, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width + 2)
    ids = np.where(np.arange(width + 2) < length[:, None], vocab.byte_ids[raw], -1).astype(np.int32)

    def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(vocab.pairs, key), len(vocab.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (vocab.pairs[at] == key), vocab.merged[at], none).astype(np.int32)

    # Most pairs that are ever looked up are of two single bytes.
    low = np.where(ids[:, 1:] >= 0, vocab.byte_pairs[raw[:, :-1], raw[:, 1:]], none)
    who, done, parts = np.arange(n), [], []
    while len(who):
        at = low.argmin(1)
        best = low[np.arange(len(who)), at]
        over = best == none
        if over.any():
            left = ids[over]
            parts.append(left[left >= 0])
            done.append((who[over], (left >= 0).sum(1)))
            ids, low, who, at, best = (x[~over] for x in (ids, low, who, at, best))
        rows = np.arange(len(who))
        ids[rows, at] = best
        # What is right of the pair moves one place to the left.
        move = np.minimum(np.arange(width + 2) + (np.arange(width + 2) > at[:, None]), width + 1)
        ids = np.take_along_axis(ids, move, 1)
        ids[:, -1] = -1
        low = np.take_along_axis(low, np.minimum(move[:, :-1], width), 1)
        low[rows, at] = rank(ids[rows, at], ids[rows, at + 1])
        left = np.maximum(at - 1, 0)
        low[rows, left] = np.where(at > 0, rank(ids[rows, left], ids[rows, left + 1]), low[rows, left])
    ended = Pieces.of(np.concatenate([c for _, c in done] or [_NONE]), np.concatenate(parts or [_NONE]).astype(np.int32))
    back = np.empty(n, dtype=np.int64)
    back[np.concatenate([w for w, _ in done] or [_NONE])] = np.arange(n)
    return ended.take(back)


_NONE = np.zeros(0, dtype=np.int64)


@dataclass(frozen=True)
class Pieces:
    """Runs of ids, one behind the other."""

    start: np.ndarray  # one more than there are runs
    ids: np.ndarray

    @staticmethod
    def of(lengths: np.ndarray, ids: np.ndarray) -> Pieces:
        return Pieces(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), ids)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.start)

    def take(self, which: np.ndarray) -> Pieces:
        """The runs ``which`` in that order, repeats allowed."""
        lengths = self.lengths[which]
        out = Pieces.of(lengths, _NONE)
        at = np.repeat(self.start[which] - out.start[:-1], lengths) + np.arange(out.start[-1])
        return Pieces(out.start, self.ids[at])

    def joined(self, counts: np.ndarray) -> Pieces:
        """Every ``counts`` runs in a row made one."""
        return Pieces(self.start[np.concatenate([[0], np.cumsum(counts)])], self.ids)

    def and_(self, other: Pieces) -> Pieces:
        return Pieces(np.concatenate([self.start, other.start[1:] + self.start[-1]]), np.concatenate([self.ids, other.ids]))


class Encoder:
    """Encodes and decodes texts; remembers the ids of the stretches that it met lately."""

    def __init__(self, vocab: Ranks):
        import regex

        self.vocab = vocab
        self.cut = regex.compile(vocab.pattern)
        self.bytes_of = {rank: piece for piece, rank in vocab.ranks.items()}
        self.whole = {}  # ids of pieces that are texts
        for piece, rank in vocab.ranks.items():
            try:
                self.whole[piece.decode()] = rank
            except UnicodeDecodeError:
                continue
        self.slots: dict[str, int] = {}  # where in ``known`` the ids of a stretch are
        self.known = Pieces.of(_NONE, _NONE.astype(np.int32))

    def starts(self, text: str) -> list[int]:
        """Where pre-tokens start."""
        return [m.start() for m in self.cut.finditer(text)]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text]).ids.tolist()

    def encode_all(self, texts: list[str]) -> Pieces:
        """Ids of each text: those of its stretches, which no pre-token crosses, in a row."""
        out = Pieces.of(_NONE, _NONE.astype(np.int32))
        first = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= BLOCK_CHARS or i + 1 == len(texts):
                out = out.and_(self._block(texts[first : i + 1]))
                first, size = i + 1, 0
        return out

    def _block(self, texts: list[str]) -> Pieces:
        parts = [STRETCH.findall(t) for t in texts]
        row = list(chain.from_iterable(parts))
        slot = np.fromiter(map(self.slots.get, row, repeat(-1)), dtype=np.int64, count=len(row))
        new = np.flatnonzero(slot < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys(row[i] for i in new)))
            slot[new] = [self.slots[row[i]] for i in new]
        out = self.known.take(slot).joined(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        if len(self.slots) > CACHED:  # only what this block needed stays
            used = np.unique(slot)
            names = {s: part for part, s in self.slots.items()}
            kept = [int(s) for s in used if len(names[s]) <= CACHED_LENGTH][: CACHED // 2]
            self.known = self.known.take(np.array(kept, dtype=np.int64))
            self.slots = {names[s]: i for i, s in enumerate(kept)}
        return out

    def _learn(self, stretches: list[str]) -> None:
        """Adds the ids of stretches that are not known."""
        # A stretch that starts with white space and goes on cuts the same behind others as alone.
        chained = [s for s in stretches if s[0] in _SPACES and s[-1] not in _SPACES]
        tokens = self.cut.findall("".join(chained))
        ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
        of_each = np.cumsum(np.fromiter(map(len, chained), dtype=np.int64, count=len(chained)))
        counts = np.diff(np.searchsorted(ends, of_each, "right"), prepend=0).tolist()
        for s in stretches:
            if s[0] not in _SPACES or s[-1] in _SPACES:
                alone = self.cut.findall(s)
                chained.append(s)
                tokens += alone
                counts.append(len(alone))
        found = self._merge_all(list(dict.fromkeys(tokens)))
        at = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        made = found.take(np.fromiter(map(at.__getitem__, tokens), dtype=np.int64, count=len(tokens))).joined(np.array(counts, dtype=np.int64))
        self.slots.update(zip(chained, range(len(self.slots), len(self.slots) + len(chained)), strict=True))
        self.known = self.known.and_(made)

    def _merge_all(self, tokens: list[str]) -> Pieces:
        """Ids of each of some distinct pre-tokens."""
        first = np.fromiter(map(self.whole.get, tokens, repeat(-1)), dtype=np.int32, count=len(tokens))
        easy = np.flatnonzero(first >= 0)
        out, places = Pieces.of(np.ones(len(easy), dtype=np.int64), first[easy]), [easy]
        hard = np.flatnonzero(first < 0)
        raw = [tokens[i].encode() for i in hard.tolist()]
        kind = np.searchsorted(WIDTHS, np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
        for k in np.unique(kind).tolist():
            which = np.flatnonzero(kind == k)
            some = [raw[i] for i in which.tolist()]
            if k < len(WIDTHS):
                made = merge_many(some, self.vocab, WIDTHS[k])
            else:
                each = [merge(piece, self.vocab.ranks) for piece in some]
                made = Pieces.of(np.array([len(x) for x in each]), np.array(list(chain.from_iterable(each)), dtype=np.int32))
            out = out.and_(made)
            places.append(hard[which])
        back = np.empty(len(tokens), dtype=np.int64)
        back[np.concatenate(places)] = np.arange(len(tokens))
        return out.take(back)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _digest(ids: np.ndarray, raw: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()


def _encode_rows(picked: DataFrame, shared, keys: list[str], text: str) -> DataFrame:
    """Adds ``ids``, ``n_tokens`` and both digests to rows that hold a text each."""
    kept = ", ".join(f"`{k}` {type_of(picked, k)}" for k in keys)

    def start():
        coder = Encoder(shared.value)

        def each(batch):
            made = {k: batch.column(i) for i, k in enumerate(keys)}
            coded = coder.encode_all([t or "" for t in batch.column(len(keys)).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(coded.start.astype(np.int32)), pa.array(coded.ids))
            rows = (coded.ids[a:b] for a, b in zip(coded.start[:-1].tolist(), coded.start[1:].tolist(), strict=True))
            sums = [_digest(some, coder.decode(some.tolist())) for some in rows]
            yield made | {"ids": ids} | {c: [s[j] for s in sums] for j, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))}

        return each

    schema = f"{kept}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(picked.select(*keys, text), schema, start)


def _pieces(texts: DataFrame, shared, chunk: int, overlap: int) -> DataFrame:
    """Rows (key, piece_no, text): long texts cut where the pre-tokens of neighbouring chunks meet."""
    n = F.length("text")
    chunks = texts.select(
        "key", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))).alias("no"), "text"
    ).select("key", "n", "no", F.substring("text", F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("part"))

    def start():
        coder = Encoder(shared.value)

        def each(batch):
            head, tail = [], []
            for no, part in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                # The last start before the end of a chunk's reading is doubtful: the token may go on.
                found = np.array(coder.starts(part)[:-1] if len(part) == chunk + overlap else coder.starts(part), dtype=np.int64)
                head.append(found[found < overlap] + no * chunk)
                tail.append(found[found >= chunk] + no * chunk)
            yield {"key": batch.column(0), "n": batch.column(1), "no": batch.column(2), "head": head, "tail": tail}

        return each

    zones = map_batches(chunks.repartition("key", "no"), "key string, n int, no int, head array<long>, tail array<long>", start)
    by = Window.partitionBy("key").orderBy("no")  # a row for each chunk of one text
    common = F.array_intersect(F.lag("tail").over(by), F.col("head"))
    met = zones.select("key", "n", "no", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(common)).alias("at"))
    # A chunk that never met its predecessor vouches for nothing behind it.
    cuts = met.withColumn("sure", F.bool_and(F.col("at").isNotNull()).over(by)).where("sure")
    spans = cuts.select("key", "at", F.coalesce(F.lead("at").over(Window.partitionBy("key").orderBy("at")), F.col("n")).alias("stop"))
    return spans.join(texts, "key").select("key", "at", F.expr("substring(text, cast(at + 1 as int), cast(stop - at as int))").alias("text"))


def encode(
    docs: DataFrame, vocab: Ranks, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), n_tokens (long), ids_sha256, decoded_sha256.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that the
    ids decode to. Null and empty texts have no ids. A null or repeated doc_id is passed on: long
    texts are handled once each, by their digest, and joined back. Other columns are not read.
    """
    if overlap > chunk:
        raise ValueError("chunks may overlap their next neighbour only")
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # a vocabulary file, no data
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    short = _encode_rows(picked.where(F.length("text") <= chunk), shared, ["doc_id"], "text")

    long = picked.where(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    texts = long.groupBy("key").agg(F.any_value("text").alias("text"))
    parts = _encode_rows(_pieces(texts, shared, chunk, overlap), shared, ["key", "at"], "text")
    whole = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    joined = whole.select("key", F.flatten("parts.ids").alias("ids"))
    sums = decode(joined, vocab, "key", shared).drop("decoded")
    rows = long.select("doc_id", "key").join(sums, "key").select(*short.columns)
    return short.unionByName(rows)


def decode(coded: DataFrame, vocab: Ranks, doc_id: str = "doc_id", shared=None) -> DataFrame:
    """One row per input row: its id, ids, n_tokens, ids_sha256, decoded_sha256 and decoded (binary).

    ``coded`` has a column ``ids``; null ids count as none. An id outside the vocabulary is an error.
    """
    shared = shared or coded.sparkSession.sparkContext.broadcast(vocab)

    def start():
        coder = Encoder(shared.value)

        def each(batch):
            ids = [np.array(x if x is not None else [], dtype=np.int32) for x in batch.column(1).to_pylist()]
            raw = [coder.decode(x.tolist()) for x in ids]
            sums = [_digest(x, y) for x, y in zip(ids, raw, strict=True)]
            yield {doc_id: batch.column(0), "ids": ids, "decoded": raw} | {
                c: [s[j] for s in sums] for j, c in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))
            }

        return each

    schema = f"`{doc_id}` {type_of(coded, doc_id)}, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded binary"
    return map_batches(coded.select(doc_id, "ids"), schema, start)
