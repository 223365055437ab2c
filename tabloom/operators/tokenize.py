"""Sample text to token ids: markers, tokenizer, label mask, length rules.

The built-in tokenizer maps UTF-8 bytes to ids and keeps markers whole. It works on Arrow buffers:
one numpy pass per batch, no Python per byte. Any other tokenizer plugs in as a batch function.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import tokens as K

# Bytes of text that are encoded at once; a longer text is encoded by itself.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class ByteTokenizer:
    """Ids 0-255 are bytes, then begin-of-sample, padding and the markers in the order given."""

    specials: tuple[str, ...] = tuple(K.special_tokens("basic_v2"))
    bos: bool = True
    bos_id: int = K.BOS_ID
    pad_id: int = K.PAD_ID

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        arr = pa.array(list(texts), pa.string())
        ids = self.encode_arrow(arr)
        return [np.asarray(x, dtype="int32") for x in ids.to_pylist()]

    def encode_arrow(self, arr: pa.Array) -> pa.Array:
        """list<int32> array for a string array."""
        if isinstance(arr, pa.ChunkedArray):
            arr = arr.combine_chunks()
        arr = arr.cast(pa.large_string())
        n = len(arr)
        if arr.null_count:
            arr = arr.fill_null("")
        off = np.frombuffer(arr.buffers()[1], dtype="int64")[arr.offset: arr.offset + n + 1]
        raw = arr.buffers()[2]
        data = np.frombuffer(raw, dtype="uint8")[off[0]: off[-1]] if raw is not None and n else np.zeros(0, "uint8")
        off = off - off[0] if n else np.zeros(1, "int64")
        ids = data.astype("int32")
        keep = np.ones(len(ids), dtype=bool)
        if self.specials and len(data):
            blob = data.tobytes()
            index = {s.encode(): K.FIRST_SPECIAL_ID + i for i, s in enumerate(self.specials)}
            rx = re.compile(b"|".join(re.escape(s) for s in sorted(index, key=len, reverse=True)))
            cuts = set(off.tolist())
            pos = 0
            while (m := rx.search(blob, pos)) is not None:
                a, b = m.span()
                # A match may not run over the end of a text.
                inner = np.searchsorted(off, a, side="right")
                if inner < len(off) and off[inner] < b:
                    pos = a + 1
                    continue
                ids[a] = index[m.group()]
                keep[a + 1: b] = False
                pos = b
        before = np.concatenate([[0], np.cumsum(keep)])
        ends = before[off]
        values = ids[keep]
        if self.bos:
            values = np.insert(values, ends[:-1], self.bos_id)
            ends = ends + np.arange(n + 1)
        return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(values.astype("int32")))


def with_markers(df: DataFrame) -> DataFrame:
    """``input_text`` and ``target_text`` from ``text`` and ``class_label_as_text``."""
    return df.withColumns(
        {
            "input_text": F.concat("text", F.lit(K.QA_SEP)),
            "target_text": F.concat("class_label_as_text", F.lit(K.END_COMPLETION)),
        }
    )


def pieces(batches: Iterator[pa.Array], limit: int | None = None) -> Iterator[pa.Array]:
    """Arrow batches of text cut into runs of rows with at most so many bytes, one row at least."""
    limit = limit or PIECE_BYTES
    for a in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(a), 0), dtype="int64")
        ends = np.cumsum(size)
        at = 0
        while at < len(a):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield a.slice(at, stop - at)
            at = stop


def _encoded(tok, a: pa.Array) -> pa.Array:
    if hasattr(tok, "encode_arrow"):
        return tok.encode_arrow(a)
    return pa.array([list(map(int, x)) for x in tok.encode(a.to_pylist())], pa.list_(pa.int32()))


def token_column(c: Column, tokenizer=None, truncate: int | None = None) -> Column:
    """array<int> of a text column.

    Ids take many times the memory of their text, so they are made and handed over piece by piece.
    """
    tok = tokenizer or ByteTokenizer()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in pieces(batches):
            yield _encoded(tok, a)

    ids = encode(c)
    return F.slice(ids, 1, truncate) if truncate else ids


def tokenize_samples(df: DataFrame, tokenizer=None, truncate: int | None = None) -> DataFrame:
    """``input_ids`` of input + target, ``labels`` equal to them with the input part masked.

    Input and target are tokenized together, the input once more for its length; only the length
    of that second pass leaves the Python worker.
    """
    tok = tokenizer or ByteTokenizer()
    both = token_column(F.concat("input_text", "target_text"), tok, truncate)

    @F.arrow_udf(T.IntegerType())
    def length(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in pieces(batches):
            yield pc.list_value_length(_encoded(tok, a)).cast(pa.int32())

    n = length(F.col("input_text"))
    if truncate:
        n = F.least(n, F.lit(truncate))
    out = df.withColumn("input_ids", both).withColumn("__n", n)
    return out.withColumn("labels", masked_labels(F.col("input_ids"), F.col("__n"))).drop("__n")


def masked_labels(ids: Column, source_len: Column) -> Column:
    """The ids with the first ``source_len`` replaced by the ignore value."""
    return F.concat(
        F.array_repeat(F.lit(K.IGNORE), source_len),
        F.slice(ids, source_len + 1, F.greatest(F.size(ids) - source_len, F.lit(0))),
    )


def unmasked(labels: Column) -> Column:
    """Label ids that count."""
    return F.filter(labels, lambda x: x != K.IGNORE)


def unmasked_positions(labels: Column) -> Column:
    """Positions (from 0) of the label ids that count."""
    marked = F.transform(labels, lambda x, i: F.when(x != K.IGNORE, i))
    return F.array_compact(marked)


def prompt_only(ids: Column, labels: Column) -> Column:
    """Ids before the first counting label: what a model may see when it predicts."""
    first = F.array_position(F.transform(labels, lambda x: x != K.IGNORE), True)
    return F.when(first > 0, F.slice(ids, 1, (first - 1).cast("int")))


def filter_length(df: DataFrame, max_len: int, mode: str = "at_most", too_long: str = "drop") -> DataFrame:
    """Length rule of the assembly paths.

    ``exact``: full sequences only (training on packed shards). ``at_most``: up to the limit.
    ``eval``: inputs without padding plus counting labels up to the limit. ``too_long="warn"``
    keeps everything and marks the long rows instead.
    """
    size = F.size("input_ids")
    if mode == "exact":
        ok = size == max_len
    elif mode == "at_most":
        ok = size <= max_len
    elif mode == "eval":
        real = F.size(F.filter("input_ids", lambda x: x != K.PAD_ID))
        ok = real + F.size(unmasked(F.col("labels"))) <= max_len
    else:
        raise ValueError(f"unknown mode: {mode}")
    return df.where(ok) if too_long == "drop" else df.withColumn("too_long", ~ok)


def pad_batches(df: DataFrame, batch: list[str], pad_id: int = K.PAD_ID) -> DataFrame:
    """Right-pads ids and labels to the longest row of their batch; ``pad_mask`` is true on content.

    A batch is bounded: it is what a model sees at once. A null batch is a batch like any other.
    """
    out = df.withColumn("__len", F.max(F.size("input_ids")).over(Window.partitionBy(*batch)))
    gap = F.col("__len") - F.size("input_ids")
    return (
        out.withColumn("pad_mask", F.concat(F.array_repeat(F.lit(True), F.size("input_ids")), F.array_repeat(F.lit(False), gap)))
        .withColumn("labels", F.concat("labels", F.array_repeat(F.lit(K.IGNORE), gap)))
        .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(pad_id), gap)))
        .drop("__len")
    )


def labels_max_len(labels: DataFrame, task: str, label: str, tokenizer=None) -> DataFrame:
    """Longest label of each task in tokens (end marker and one more included), and that label."""
    ids = token_column(F.concat(F.col(label), F.lit(K.END_COMPLETION)), tokenizer)
    sized = labels.select(task, label).distinct().withColumn("n", F.size(ids) + 1)
    best = sized.groupBy(task).agg(F.min(F.struct(-F.col("n"), F.col(label).alias("l"))).alias("b"))
    return best.select(task, (-F.col("b.col1")).alias("max_len"), F.col("b.l").alias("longest"))


def context_budget(df: DataFrame, prompt: str, max_len: int, max_new: int) -> DataFrame:
    """Rows with room for at least two new tokens, and how many they may generate."""
    room = F.lit(max_len) - F.size(prompt)
    return df.where(room >= 2).withColumn("max_new_tokens", F.least(F.lit(max_new), room))
