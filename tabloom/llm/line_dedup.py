"""Lines that many documents share: all copies go except those of the smallest doc_id.

Lines are exploded and hashed, and only hashes travel: one aggregation finds the hashes of at least
``min_docs`` documents, a join tells each document the places of its lines that go, and the text
itself moves once, to meet that list. Hashes are 128 bits in two halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import SPACES, ascii_lower, fresh
from tabloom.session import cut_lineage

MIN_CHARS = 10


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def places_of(lines: Column) -> Column:
    return F.sequence(F.lit(0), F.size(lines) - 1)


def _text_key(text: Column) -> list[Column]:
    """128 bits of a text: rows of one id and one text lose the same lines."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole), F.xxhash64(F.lit(1), whole)]


def dropped_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = 2) -> DataFrame:
    """Rows (id, t1, t2, places): the places of lines (from 0) that go, of each id and text that loses any."""
    t1, t2 = _text_key(F.col(text))
    # Two steps: beside the explode, the whole text would be hashed again for each of its lines.
    listed = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), t1.alias("t1"), t2.alias("t2"), F.transform(_lines(F.col(text)), line_key).alias("keys")
    )
    keyed = listed.select("id", "t1", "t2", F.posexplode("keys").alias("place", "key"))
    hashed = keyed.where(F.length("key") >= min_chars).select(
        "id", "t1", "t2", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )
    by = hashed.groupBy("h1", "h2")
    if min_docs == 2:  # two documents share a line where its smallest and largest id differ
        shared = by.agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last")
    else:
        once = hashed.select("h1", "h2", "id").distinct().groupBy("h1", "h2")
        shared = once.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).drop("n")
    # Written first, both sides of the join come from a shuffle of their own, and Spark can split a
    # hash that a third of all lines have.
    shared = cut_lineage(shared)
    gone = hashed.join(shared, ["h1", "h2"]).where("id <> first")
    return gone.groupBy("id", "t1", "t2").agg(F.collect_set("place").alias("places"))


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = 2, counts: tuple[str, str] | None = None
) -> DataFrame:
    """The table with shared lines taken out of ``text``; every row and column stays.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points that are found in at least ``min_docs`` documents lose all their lines
    except those in the smallest doc_id that holds them. Lines end at line feeds; a null or empty
    text is one empty line and comes back empty. Rows that repeat a doc_id count as one document, and
    each loses its own lines, whether their texts are alike or not. Rows without a doc_id neither count
    nor lose lines. ``counts`` names two columns for the lines before and the lines dropped.
    """
    names = {c: fresh(docs, f"__{c}") for c in ("id", "t1", "t2", "places")}
    drops = dropped_places(docs, doc_id, text, min_chars, min_docs).withColumnsRenamed(names)
    t1, t2 = _text_key(docs[text])
    same = (docs[doc_id] == drops[names["id"]]) & (t1 == drops[names["t1"]]) & (t2 == drops[names["t2"]])
    joined = docs.join(drops, same, "left")
    lines, gone = _lines(F.col(text)), F.col(names["places"])
    # As the variable of a lambda the lines are split once; written out, they would be for every line that stays.
    stay = lambda ls: F.array_join(F.transform(F.array_except(places_of(ls), gone), lambda i: F.get(ls, i)), "\n")
    left = F.when(gone.isNull(), F.coalesce(F.col(text).cast("string"), F.lit(""))).otherwise(F.get(F.transform(F.array(lines), stay), F.lit(0)))
    out = joined
    if counts:
        n = F.size(lines).cast("long")
        out = out.withColumns({counts[0]: n, counts[1]: F.coalesce(F.size(gone), F.lit(0)).cast("long")})
    extra = list(counts or ())
    return out.withColumn(text, left).select(*docs.columns, *extra)
