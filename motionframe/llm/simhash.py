"""SimHash near-duplicates through an inverted index on byte positions with count filtering.

A fingerprint has eight byte positions. Two fingerprints within ``distance`` bits differ in at most that many bytes, so they share at least
``8 - distance`` positional bytes: that is the guaranteed minimum of the count filter. A posting of one positional byte would hold a
256th of all documents, and tallying over such postings would emit all pairs within them; so a posting names as many positional bytes
as the minimum asks for (six of eight for two bits: 28 postings a fingerprint), and a pair meets in one exactly if it reaches the minimum.
Every meeting reports which positional bytes the pair shares; these are tallied per pair, pairs that reach the minimum are retained and
verified by Hamming distance. Members of one posting are distinct fingerprints that differ in two given bytes only, so a posting of any
corpus is bounded (2**16) and a crowd of near copies is spread over postings by where its bits differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import connected_components
from .storage import Scratch, id_and_text, table

WORDS = 3
DISTANCE = 2
SEED = 42


def fingerprint(text: str, words: int = WORDS) -> int:
    """The unsigned 64-bit SimHash of a text; 0 without words."""
    import xxhash

    split = text.encode().lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    if len(split) < words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in split])
        starts = [0, *ends[:-words].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]
    bits = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):  # a long text in blocks
        block = np.array(hashes[lo : lo + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprint_of(text: str, words: int = WORDS) -> Column:
    """The fingerprint of a text column as a signed 64-bit number."""

    @F.pandas_udf(LongType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, words) for t in batch], dtype="uint64").astype("int64")

    return of(text)


def _mask(positions: tuple[int, ...]) -> int:
    """A signed 64-bit mask of whole byte positions."""
    mask = sum(0xFF << 8 * p for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def links(fingerprints: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: all pairs a < b of the distinct fingerprints (column ``fp``) within ``distance`` bits (0 to 4)."""
    least = 8 - distance
    slots = list(combinations(range(8), least))
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(slot))).alias("key")) for i, slot in enumerate(slots)])
    shared = F.array(*[F.lit(sum(1 << p for p in slot)) for slot in slots])  # which positions a slot's postings name, as bits
    postings = fingerprints.select("fp", F.explode(keys).alias("p")).select("fp", "p.slot", "p.key")
    crowd = Window.partitionBy("slot", "key")
    met = postings.withColumn("n", F.count("*").over(crowd)).where(F.col("n") > 1)
    lists = met.groupBy("slot", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))  # in the window's partitioning; no list exceeds 256**distance
    heads = lists.select("slot", "fps", F.posexplode("fps").alias("i", "a")).where(F.col("i") + 1 < F.size("fps"))
    pairs = heads.select("slot", "a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
    tallied = pairs.groupBy("a", "b").agg(F.bit_or(F.get(shared, F.col("slot").cast("int"))).alias("shared"))
    retained = tallied.where(F.bit_count("shared") >= least)
    return retained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")


def rooted(marked: DataFrame, first: Column, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """``fp, root, first``: every distinct fingerprint with its component's smallest one and the least ``first`` of its own rows."""
    nodes = scratch.save("nodes", marked.groupBy("fp").agg(F.min(first).alias("first")))
    roots = connected_components(links(nodes.select("fp"), scratch, distance), scratch)
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per input row: shingles of ``words`` words, links of at most ``distance`` bits.

    Equal fingerprints meet in one node before anything is joined, so copies cost nothing and are never paired.
    Null and empty texts, and texts without words, have fingerprint zero and link like any other. Repeated rows
    get a row each; a null doc_id belongs to its component but names it only where no other id does. Extra columns are
    ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save("marked", id_and_text(docs).select("doc_id", fingerprint_of("text", words).alias("fp")))
    joined = rooted(marked, F.col("doc_id"), scratch, distance)
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    component = joined.join(ids, "root").select("fp", "component_id")
    rows = scratch.save("rows", marked.join(component, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))
    scratch.drop_all_but("rows")
    return rows


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """What orders the rows of a component and finds them again: the id, nulls last, then the text's digest. None is null."""
    number = doc_id.cast("long")
    digest = F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))
    return [number.isNull().alias("_no_id"), F.coalesce(number, F.lit(0)).alias("_id"), digest.alias("_digest")]


def keep_one(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row of each component with all its columns: that of the smallest doc_id (null only where no other is), then of the smallest digest.

    Of rows with that id and text the smallest by its columns in their order. Rows that share an id, or have none, are told apart by
    their texts. Rows alike in both meet partly before they are dealt out, so a common one reaches its task once per map task.
    """
    scratch, key = Scratch(docs.sparkSession, "simhash"), ["_no_id", "_id", "_digest"]
    marked = scratch.save("marked", id_and_text(docs).select(*_row_key(F.col("doc_id"), F.col("text")), fingerprint_of("text", words).alias("fp")))
    best = rooted(marked, F.struct(*key), scratch, distance).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    best = scratch.save("best", best)
    scratch.drop_all_but("best")
    rows = docs.select(*_row_key(F.col("doc_id"), F.col("text")), F.struct(*docs.columns).alias("_row"))
    return rows.groupBy(*key).agg(F.min("_row").alias("_row")).join(best, key, "left_semi").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
