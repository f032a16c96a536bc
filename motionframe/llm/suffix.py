"""Removal of byte strings that repeat across documents, found with suffix arrays.

A string of ``MATCH`` bytes is removed where it also starts in a document with a smaller id. Strings are brought together
by *anchors*: of a string's ``MATCH - GRAM + 1`` byte grams, the one with the smallest hash. The anchor depends on the string alone,
so equal strings have equal anchors, and a document needs one anchor per run of neighbouring strings (about one in
fourteen bytes). Chunks of documents tell anchor shards which anchors they have, and learn which of them other documents
have too; only the text around those goes to shards, where a suffix array and its permuted common prefixes find the
strings that repeat. Text none of whose strings has the hash of another one there is not sorted. Shards answer chunks, so a passage that a third of all documents share travels once per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .induced import permuted_common_prefixes, suffix_array
from .storage import Scratch, id_and_text, pieces_for, table

MATCH = 50
GRAM = 24
#: Bytes of text per chunk, per shard of text and per shard of anchors, and the documents from which an anchor's strings are dealt
#: out one by one. A chunk sends each shard one row at most; with larger executors raise the sizes together.
CHUNK, SHARD, ANCHOR_SHARD, HOT = 1 << 20, 1 << 21, 1 << 24, 1000
LEAST_SHARDS = 64
NO_ID = (1 << 63) - 1
#: Marks the hashes of strings that were dealt out one by one, whose answers hold for no longer slice.
ALONE = np.uint64(0x5851F42D4C957F2D)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept per worker."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            steps = np.full(n + n // 4, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """64-bit hashes of any slices of one byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


class Chunk:
    """Documents laid end to end, with the runs of neighbouring strings that share an anchor."""

    def __init__(self, texts: list[bytes], match: int, gram: int):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes + 1) - 1  # a zero byte follows each
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
        self.hashes = Hashes(self.data)
        self.match, window, n = match, match - gram + 1, len(self.data)
        self.lo = self.size = self.doc = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        if n < match:
            return
        h = self.hashes.grams(gram)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if window > width:
            least = np.minimum(least[: width - window], least[window - width :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the string that starts here
        valid = np.zeros(len(at), dtype=bool)
        change = np.zeros(len(at) + 1, dtype=np.int8)
        long = sizes >= match
        change[self.starts[long]] += 1
        change[self.ends[long] - match + 1] -= 1
        valid = np.cumsum(change[:-1]) > 0
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        self.lo = np.flatnonzero(first)
        self.size = np.flatnonzero(last) - self.lo + 1
        self.anchor = _mix(h[at[self.lo]] + _BASE)  # smallest hashes are small: mixed again, they spread over all shards
        self.doc = np.searchsorted(self.ends, self.lo)

    def slices(self, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bytes of the strings from ``lo`` on (``size`` of them, overlapping), run after run."""
        length = size + self.match - 1
        at = np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(length.sum())
        return self.data[at]


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _key(h: np.ndarray, shards: int) -> np.ndarray:
    return _shard(h, shards).astype(np.uint64) << np.uint64(32) | _low(h).astype(np.uint64)


def _may_repeat(hashes: Hashes, start: np.ndarray, size: np.ndarray, match: int) -> np.ndarray:
    """The slices (``size`` strings from ``start`` on) one of whose strings has the hash of another string: in all others none is equal to any."""
    own = np.cumsum(size) - size
    string = np.repeat(start - own, size) + np.arange(size.sum())
    _, which, times = np.unique(hashes.of(string, string + match), return_inverse=True, return_counts=True)
    return np.flatnonzero(np.logical_or.reduceat(times[which] > 1, own))


def _earlier(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, match: int, bits: type) -> np.ndarray:
    """Of each slice of ``data``, bits of its strings that are in slices of a smaller ``first`` id, too."""
    # The text: each slice, a separator (1) after it, a sentinel (0) at the end. UTF-8 has no bytes above 0xF4.
    length = size + match - 1
    to = np.cumsum(length + 1) - length - 1
    source = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    target = np.repeat(to - (np.cumsum(length) - length), length) + np.arange(length.sum())
    text = np.ones(len(source) + len(length) + 1, np.uint8)
    text[-1] = 0
    text[target] = data[source] + 2
    sa = suffix_array(text)
    shared = permuted_common_prefixes(text, sa)
    strings = np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())  # where a whole string starts
    owner = np.full(len(text), -1, np.int32)
    owner[strings] = np.repeat(np.arange(len(size)), size)
    order = sa[owner[sa] >= 0]
    # Two strings that start within slices are equal when their suffixes share MATCH bytes: no separator lies inside them.
    group = np.flatnonzero(np.append(True, shared[order[1:]] < match)[: len(order)])
    smallest = np.minimum.reduceat(first[owner[order]], group)
    earlier = np.zeros(len(text), bool)
    earlier[order] = np.repeat(smallest, np.diff(np.append(group, len(order)))) < first[owner[order]]
    mask = np.zeros(len(size), bits)
    np.bitwise_or.at(mask, owner[strings], earlier[strings].astype(bits) << (strings - np.repeat(to, size)).astype(bits))
    return mask


def _laid_out(pdf: pd.DataFrame, match: int, gram: int) -> tuple[Chunk, np.ndarray, list[str]]:
    """A chunk's distinct texts in a fixed order, each with its smallest id and its digest."""
    pdf = pdf.sort_values(["digest", "k"])
    ids = pdf.groupby("digest", sort=True)["k"].min()
    texts = pdf[pdf["text"].notna()].drop_duplicates("digest")
    return Chunk([t.encode() for t in texts["text"]], match, gram), ids.to_numpy(dtype=np.int64), texts["digest"].tolist()


def distinct_texts(docs: DataFrame, chunks: int) -> DataFrame:
    """``chunk, digest, k, text``: every distinct text at least once with its smallest id ``k``; copies are dropped where they are read.

    A text is written at most once per task (again, without the text, when a smaller id turns up), so a text that a third of all
    rows hold reaches its chunk a few times only.
    """
    rows = docs.withColumn("k", F.coalesce("doc_id", F.lit(NO_ID))).select("k", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")

    def first_seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, int] = {}
        for batch in batches:
            keep, bare = [], []
            for i, (digest, k) in enumerate(zip(batch["digest"], batch["k"])):
                known = seen.get(digest)
                if known is None or k < known:
                    seen[digest] = k
                    keep.append(i)
                    bare.append(known is not None)
            out = batch.iloc[keep].copy()
            out.loc[np.array(bare, dtype=bool), "text"] = None
            yield out

    return rows.mapInPandas(first_seen, "k long, digest string, text string").withColumn("chunk", F.pmod(F.xxhash64("digest"), F.lit(chunks)).cast("int")).select("chunk", "digest", "k", "text")


def repeated_strings(docs: DataFrame, match: int = MATCH, gram: int = GRAM, with_text: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Per distinct text: ``digest, k, n_removed, n_spans, kept_sha256`` (and ``kept_text``), ``k`` being the smallest id that has it.

    ``docs`` has ``doc_id, text`` without null texts.
    """
    if match - gram + 1 > 63:
        raise ValueError("a slice holds 63 strings at most")
    bits = np.uint32 if match - gram + 1 <= 32 else np.uint64  # a bit for each string of a slice
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "suffix")
    chunks = pieces_for(docs, "text", CHUNK)
    shards = max(LEAST_SHARDS, -(-chunks * CHUNK // SHARD))
    anchor_shards = max(LEAST_SHARDS, -(-chunks * CHUNK // ANCHOR_SHARD))
    buckets = max(24, -(-chunks // 8))
    name = "chunks_" + scratch.root.rsplit("-", 1)[1]
    path = f"{scratch.root}/{name}"
    laid = distinct_texts(docs, chunks).repartition(buckets, "chunk")
    laid.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "chunk").saveAsTable(name)  # later joins by chunk move no text
    try:
        texts = spark.table(name)

        def anchors(pdf: pd.DataFrame) -> pd.DataFrame:
            chunk, _, _ = _laid_out(pdf, match, gram)
            order = np.argsort(chunk.anchor, kind="stable")  # documents stay in order within an anchor
            h, doc = chunk.anchor[order], chunk.doc[order]
            new = np.append(True, h[1:] != h[:-1])[: len(h)]
            other = new | np.append(True, doc[1:] != doc[:-1])[: len(h)]
            own = np.flatnonzero(new)
            count = np.minimum(np.add.reduceat(other.astype(np.int64), own), 255).astype(np.uint8) if len(own) else np.zeros(0, np.uint8)
            h = h[own]
            shard = _shard(h, anchor_shards)
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(h)])
            out = [(int(shard[a]), int(pdf["chunk"].iat[0]), _low(h[a:b]).tobytes(), count[a:b].tobytes()) for a, b in zip(cuts, np.append(cuts[1:], len(h)))]
            return pd.DataFrame(out, columns=["shard", "chunk", "low", "count"])

        def shared_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
            lows = [np.frombuffer(x, np.uint32) for x in pdf["low"]]
            low, count = np.concatenate(lows), np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["count"]]).astype(np.int64)
            distinct, at = np.unique(low, return_inverse=True)
            total = np.bincount(at, weights=count, minlength=len(distinct))[at]
            bounds, out = np.cumsum([0, *map(len, lows)]), []
            for i, chunk in enumerate(pdf["chunk"]):
                part = slice(bounds[i], bounds[i + 1])
                hit = total[part] > 1
                if hit.any():
                    out.append((chunk, pdf["shard"].iat[0], low[part][hit].tobytes(), (total[part][hit] > HOT).tobytes()))
            return pd.DataFrame(out, columns=["chunk", "shard", "low", "hot"])

        def surroundings(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            columns = ["shard", "chunk", "data", "size", "doc", "anchor"]
            if not len(left) or not len(right):
                return pd.DataFrame([], columns=columns)
            chunk, ids, _ = _laid_out(left, match, gram)
            known = np.concatenate([np.uint64(s) << np.uint64(32) | np.frombuffer(x, np.uint32).astype(np.uint64) for s, x in zip(right["shard"], right["low"])])
            hot = np.concatenate([np.frombuffer(x, bool) for x in right["hot"]])
            order = np.argsort(known)
            known, hot = known[order], hot[order]
            key = _key(chunk.anchor, anchor_shards)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            found = known[at] == key
            crowded = found & hot[at]
            found &= ~crowded
            times = chunk.size[crowded]
            lo = np.concatenate([chunk.lo[found], np.repeat(chunk.lo[crowded] - (np.cumsum(times) - times), times) + np.arange(times.sum())])
            size = np.concatenate([chunk.size[found], np.ones(times.sum(), np.int64)])
            doc = ids[np.concatenate([chunk.doc[found], np.repeat(chunk.doc[crowded], times)])]
            alone = np.arange(len(lo)) >= found.sum()
            h = chunk.hashes.of(lo, lo + size + match - 1)
            anchor = np.concatenate([chunk.anchor[found], np.repeat(chunk.anchor[crowded], times)])
            shard = _shard(np.where(alone, h, anchor), shards)
            order = np.lexsort((doc, h, shard))
            h, shard, lo, size, doc, alone, anchor = h[order], shard[order], lo[order], size[order], doc[order], alone[order], anchor[order]
            new = np.append(True, h[1:] != h[:-1])[: len(h)] | np.append(True, shard[1:] != shard[:-1])[: len(h)]
            own = np.flatnonzero(new)
            several = np.append(own[1:], len(h)) - own > 1
            shard, lo, size, doc = shard[own], lo[own], size[own], doc[own]
            alone, anchor = alone[own], anchor[own]
            packed = (size | alone << 6 | several << 7).astype(np.uint8)
            cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
            out = []
            for a, b in zip(cuts, np.append(cuts[1:], len(shard))):
                out.append((int(shard[a]), int(left["chunk"].iat[0]), chunk.slices(lo[a:b], size[a:b]).tobytes(), packed[a:b].tobytes(), doc[a:b].tobytes(), anchor[a:b][alone[a:b]].tobytes()))
            return pd.DataFrame(out, columns=columns)

        def repeats(pdf: pd.DataFrame) -> pd.DataFrame:
            sizes = [np.frombuffer(x, np.uint8) for x in pdf["size"]]
            packed, doc = np.concatenate(sizes), np.concatenate([np.frombuffer(x, np.int64) for x in pdf["doc"]])
            data = np.frombuffer(b"".join(pdf["data"]), np.uint8)
            size = (packed & 63).astype(np.int64)
            end = np.cumsum(size + match - 1)
            start = end - size - match + 1
            hashes = Hashes(data)
            h = hashes.of(start, end) ^ np.where(packed & 64, ALONE, np.uint64(0))
            distinct, pick, at = np.unique(h, return_index=True, return_inverse=True)
            first = np.full(len(distinct), NO_ID, np.int64)
            np.minimum.at(first, at, doc)
            mask = np.zeros(len(distinct), bits)
            some = _may_repeat(hashes, start[pick], size[pick], match)
            if len(some):
                mask[some] = _earlier(data, start[pick[some]], size[pick[some]], first[some], match, bits)
            bounds, out = np.cumsum([0, *map(len, sizes)]), []
            for i, (chunk, anchor) in enumerate(zip(pdf["chunk"], pdf["anchor"])):
                part = slice(bounds[i], bounds[i + 1])
                told = (doc[part] > first[at[part]]) | (packed[part] > 127) | (mask[at[part]] > 0)
                if told.any():
                    which, alone = at[part][told], packed[part] & 64 > 0
                    crowded = np.unique(np.frombuffer(anchor, np.uint64)[told[alone]])
                    out.append((chunk, distinct[which].tobytes(), first[which].tobytes(), mask[which].tobytes(), crowded.tobytes()))
            return pd.DataFrame(out, columns=["chunk", "slice", "first", "mask", "crowded"])

        def removed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            import hashlib

            columns = ["digest", "k", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
            if not len(left):
                return pd.DataFrame([], columns=columns)
            chunk, ids, digests = _laid_out(left, match, gram)
            covered = np.zeros(len(chunk.data), bool)
            if len(right):
                known, first, mask = (np.concatenate([np.frombuffer(x, t) for x in right[c]]) for c, t in (("slice", np.uint64), ("first", np.int64), ("mask", bits)))
                order = np.argsort(known)
                known, first, mask = known[order], first[order], mask[order]
                steps = np.zeros(len(chunk.data) + 1, np.int64)

                def mark(lo: np.ndarray, size: np.ndarray, doc: np.ndarray, tag: np.uint64) -> None:
                    h = chunk.hashes.of(lo, lo + size + match - 1) ^ tag
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    hit = np.flatnonzero(known[at] == h)
                    at, lo, size, doc = at[hit], lo[hit], size[hit], ids[doc[hit]]
                    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    bad = np.repeat(doc > first[at], size) | (np.repeat(mask[at], size) >> nth.astype(bits) & bits(1) > 0)
                    begin = (np.repeat(lo, size) + nth)[bad]
                    at = np.bincount(begin, minlength=len(steps))
                    steps[:] += at
                    steps[match:] -= at[:-match]

                mark(chunk.lo, chunk.size, chunk.doc, np.uint64(0))
                crowded = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in right["crowded"]]))
                if len(crowded):
                    at = crowded[np.minimum(np.searchsorted(crowded, chunk.anchor), len(crowded) - 1)] == chunk.anchor
                    lo, size, doc = chunk.lo[at], chunk.size[at], chunk.doc[at]
                    each = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    mark(each, np.ones(len(each), np.int64), np.repeat(doc, size), ALONE)
                covered = np.cumsum(steps[:-1]) > 0
            total = np.append(0, np.cumsum(covered))
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            spans = np.append(0, np.cumsum(begins))
            out = []
            for i, (a, b) in enumerate(zip(chunk.starts, chunk.ends)):
                gone = int(total[b] - total[a])
                kept = chunk.data[a:b][~covered[a:b]].tobytes() if gone else None
                row = (digests[i], int(ids[i]), gone, int(spans[b] - spans[a]), hashlib.sha256(kept).hexdigest() if gone else digests[i])
                out.append(row + ((_kept_text(chunk.data[a:b], covered[a:b]) if gone else chunk.data[a:b].tobytes().decode(),) if with_text else ()))
            return pd.DataFrame(out, columns=columns)

        told = texts.groupBy("chunk").applyInPandas(anchors, "shard int, chunk int, low binary, count binary")
        matched = scratch.save("matched", told.groupBy("shard").applyInPandas(shared_anchors, "chunk int, shard int, low binary, hot binary"))
        asked = texts.groupBy("chunk").cogroup(matched.groupBy("chunk")).applyInPandas(surroundings, "shard int, chunk int, data binary, size binary, doc binary, anchor binary")
        answers = scratch.save("answers", asked.groupBy("shard").applyInPandas(repeats, "chunk int, slice binary, first binary, mask binary, crowded binary"))
        result = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(removed, "digest string, k long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)
        result = scratch.save("result", result)
        scratch.drop("matched", "answers")
        return result
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop(name)


def _kept_text(data: np.ndarray, covered: np.ndarray) -> str:
    """The kept bytes as text; a removed run gives back the characters that it cuts through."""
    inside = (data & 0xC0) == 0x80
    char = np.cumsum(~inside) - 1
    whole = np.bincount(char, weights=~covered) == 0  # no byte of the character is kept
    return data[~whole[char]].tobytes().decode()


def remove_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_text``), one row per input row.

    Texts are UTF-8 bytes, whole, null ones empty; texts shorter than ``match`` bytes lose nothing. Rows with equal texts: those of
    the smallest id are judged against other texts, all others lose every byte (if there are ``match``). Rows that repeat an
    id never take from each other where their texts are equal. A null id counts as larger than any other. ``kept_text`` keeps
    characters that a removed run would cut through. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = id_and_text(docs)
    found = repeated_strings(rows, match, gram, with_text, scratch)
    facts = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    joined = facts.join(found, "digest")
    copy = (F.coalesce("doc_id", F.lit(NO_ID)) > F.col("k")) & (F.col("n_bytes") >= match)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    columns = [
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(copy, empty).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    ]
    return joined.select(*columns, *([F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []))


def cut_repeats(docs: DataFrame, match: int = MATCH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (whole characters) and ``n_chars``, where there is one, counted anew.

    Rows that lose their whole text go; texts that were empty stay, as do null ones. Texts are joined once.
    """
    found = repeated_strings(id_and_text(docs), match, gram, with_text=True).select(F.col("digest").alias("_cut_digest"), F.col("k").alias("_cut_k"), F.col("kept_text").alias("_cut_text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = docs.select("*", F.sha2(text.cast("binary"), 256).alias("_cut_digest"), F.octet_length(text).alias("_cut_bytes"), F.col("text").isNull().alias("_cut_null")).drop("text")
    joined = marked.join(found, "_cut_digest")
    copy = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) > F.col("_cut_k")) & (F.col("_cut_bytes") >= match)
    cut = joined.withColumn("text", F.when(F.col("_cut_null"), None).when(copy, F.lit("")).otherwise(F.col("_cut_text")))
    cut = cut.where((F.col("_cut_bytes") == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
    p AS (SELECT doc_id, i, array_slice(b, i, i + {MATCH - 1}) AS s FROM (SELECT doc_id, b, unnest(range(1, n - {MATCH - 2})) AS i FROM d WHERE n >= {MATCH})),
    f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM p) WHERE first < doc_id),
    r AS (SELECT doc_id, i, sum(o) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {MATCH} THEN 0 ELSE 1 END AS o FROM f)),
    spans AS (SELECT doc_id, min(i) AS a, max(i) + {MATCH - 1} AS z FROM r GROUP BY doc_id, run),
    gaps AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) + 1 AS x, a - 1 AS y FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(z) + 1, NULL FROM spans GROUP BY doc_id),
    kept AS (SELECT g.doc_id, unhex(coalesce(string_agg(hex(array_slice(b, x, coalesce(y, n))), '' ORDER BY x) FILTER (x <= coalesce(y, n)), '')) AS k FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY g.doc_id),
    c AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
    SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(k, b)) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
