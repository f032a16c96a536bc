"""A hierarchical Pitman-Yor language model over words: Chinese restaurants seated by Gibbs sampling.

Each token is a customer of the restaurant of its context, the preceding token: every distinct word has a restaurant. A
restaurant's parent is that of its context's class (the preceding token's ending), whose parent is the root, whose
base measure is uniform over the known words and one more. Every table is a customer of the parent.

Words are dealt to shards, so a word's customers and tables at all levels are in one place and words are seated
independently given the restaurants' totals, which are refreshed between passes. One sweep redraws the table counts of every
(restaurant, word) from their conditional distribution, level by level. Predictive probabilities are averaged over the samples.
Chunks of documents send the counts of their (context, word) types to the shards and get the types' probabilities back.
Restaurants grow with the corpus, so their totals are rows, never a vector on the driver: shards tell what they know of the contexts
they have to parts dealt by context, which add it up and tell each shard the totals of its contexts. Only classes and sums are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, fold, id_and_text, pieces_for, table

CLASSES = 256
CHUNK, SHARD, LEAST_SHARDS = 1 << 23, 1 << 23, 64
#: Log10 probabilities travel in steps of one 2048th; a text's score is off by the mean of its tokens' rounding, about nothing.
STEPS = 2048
EXACT = 64
END = b""
CLASS_AT = np.uint64(56)  # a context's code: its class, and below it the low bits of the word's hash


@dataclass(frozen=True)
class Model:
    """Discounts start at ``discount`` (context, class, root) and are re-estimated from once- and twice-seated counts; ``strength`` stays."""

    discount: tuple[float, float, float] = (0.8, 0.7, 0.6)
    strength: tuple[float, float, float] = (1.0, 1.0, 1.0)
    burn_in: int = 4
    samples: int = 4
    seed: int = 11


def squeeze(values: np.ndarray) -> bytes:
    """A compressed integer array: the bytes of one significance together."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def stretch(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences to the value before, modulo the type's range."""
    return np.diff(values, prepend=values.dtype.type(0))


class Totals:
    """What all shards need of classes and the root: customers and tables by class, and a few sums; a vector of fixed length."""

    SUMS = ("root_customers", "root_tables", "types", "tokens", *(f"{what}{level}" for level in (1, 2, 3) for what in ("once", "twice")))
    SIZE = 2 * CLASSES + len(SUMS)

    def __init__(self, vector: np.ndarray | None = None):
        self.vector = np.zeros(self.SIZE) if vector is None else vector
        self.customers2, self.tables2, self.sums = np.split(self.vector, [CLASSES, 2 * CLASSES])

    def __getitem__(self, name: str) -> float:
        return float(self.sums[self.SUMS.index(name)])

    def __setitem__(self, name: str, value: float) -> None:
        self.sums[self.SUMS.index(name)] = value


def summed(told: DataFrame) -> Totals:
    """The sum of what the shards told (``sums``); the driver gets one vector."""
    out = Totals()
    for r in told.where("sums is not null").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        out.vector[r["i"]] = r["x"]
    return out


def context_bits(n_bytes: int) -> int:
    """How many bits of a word's hash name its restaurant: they grow with the text, so that words in one restaurant stay an exception at any size."""
    return min(56, max(20, n_bytes.bit_length() - 9))


def context_of(word: bytes, word_hash: int, bits: int) -> int:
    """The code of the restaurant after ``word``: its ending's class, and ``bits`` of the whole word's hash."""
    import xxhash

    return (xxhash.xxh32_intdigest(word[-2:]) % CLASSES) << int(CLASS_AT) | word_hash & ((1 << bits) - 1)


def _part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    """Which part adds up each context, dealt by a mixed code."""
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


class Packed:
    """The (word, context) types of some documents, words in hash order and contexts in order of their codes within a word."""

    def __init__(self, texts: list[str], train: np.ndarray, bits: int):
        import xxhash

        index: dict[bytes, int] = {END: 0}
        give = index.setdefault
        streams = []
        for text in texts:
            streams.append(np.array([give(w, len(index)) for w in text.encode().lower().split()] + [0], dtype=np.int32))
        self.n_tokens = np.array([len(s) for s in streams], dtype=np.int64)
        tokens = np.concatenate(streams) if streams else np.zeros(0, np.int32)
        del streams
        first = np.cumsum(self.n_tokens) - self.n_tokens
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in index], dtype=np.uint64)
        codes, place = np.unique(np.array([context_of(w, int(h), bits) for w, h in zip(index, hashes)], dtype=np.uint64), return_inverse=True)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        before = np.append(np.int32(0), tokens[:-1])
        before[first] = 0  # a text starts after an end
        key = rank[tokens] << 32 | place[before]
        doc = np.repeat(np.arange(len(texts)), self.n_tokens)
        kinds, kind = np.unique(key, return_inverse=True)
        self.hashes, self.context = hashes[order], codes[kinds & 0xFFFFFFFF]
        self.per_word = np.bincount(kinds >> 32, minlength=len(order)).astype(np.uint32)
        self.counts = np.bincount(kind[train[doc]], minlength=len(kinds)).astype(np.uint32)
        pairs, times = np.unique(doc << 32 | kind, return_counts=True)
        self.kind, self.times = (pairs & 0xFFFFFFFF).astype(np.uint32), times.astype(np.uint32)
        self.per_doc = np.bincount(pairs >> 32, minlength=len(texts)).astype(np.uint32)


def _shard_cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard's words start in hash order, and the end."""
    shard = (hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: row c, column t, for c customers at t tables."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        t = np.arange(most + 1)
        with np.errstate(divide="ignore"):
            stay = s[c] + np.log(np.maximum(c - discount * t, 0))
        s[c + 1] = np.logaddexp(stay, np.append(-np.inf, s[c, :-1]))
    return s


def draw_tables(rng: np.random.Generator, customers: np.ndarray, weight: np.ndarray, discount: float, log_s: np.ndarray) -> np.ndarray:
    """Tables of each dish given its customers: P(t) in proportion to S(c, t) weight**t.

    ``weight`` is what a new table weighs: the restaurant's strength and discounted tables times the parent's probability. Beyond
    ``EXACT`` customers the rest are seated in blocks of a tenth of those seated so far, at the block's starting odds.
    """
    tables = np.minimum(customers, 1)
    log_w = np.log(np.maximum(weight, 1e-300))
    small = np.minimum(customers, EXACT)
    order = np.argsort(small, kind="stable")
    bounds = np.searchsorted(small[order], np.arange(EXACT + 2))
    for c in range(2, EXACT + 1):
        at = order[bounds[c] : bounds[c + 1]]
        for lo in range(0, len(at), 1 << 16):
            some = at[lo : lo + (1 << 16)]
            logits = log_s[c, 1 : c + 1] + log_w[some, None] * np.arange(1, c + 1)
            p = np.exp(logits - logits.max(axis=1, keepdims=True)).cumsum(axis=1)
            tables[some] = 1 + (p < rng.random(len(some))[:, None] * p[:, -1:]).sum(axis=1)
    seated = EXACT
    large = np.flatnonzero(customers > EXACT)
    while len(large):
        block = np.minimum(max(1, seated // 10), customers[large] - seated)
        p = weight[large] / (weight[large] + seated - discount * tables[large])
        tables[large] += rng.binomial(block, np.clip(p, 0, 1))
        seated += max(1, seated // 10)
        large = large[customers[large] > seated]
    return tables


class Seating:
    """The customers of one shard's words: ``word`` and ``context`` (an index into the sorted ``codes``) of each type and its training ``count``.

    ``customers1`` and ``tables1`` are the restaurants' totals over all shards; until they are told, those of this shard.
    """

    def __init__(self, word: np.ndarray, context: np.ndarray, codes: np.ndarray, count: np.ndarray, words: int, model: Model, seed: int):
        self.word, self.context, self.codes, self.count, self.model = word, context, codes, count.astype(np.int64), model
        cells, self.cell = np.unique(word << 8 | (codes >> CLASS_AT).astype(np.int64)[context], return_inverse=True)
        self.cell_word, self.cell_class = cells >> 8, cells & 0xFF
        self.words, self.rng = words, np.random.default_rng([model.seed, seed])
        self.t1 = np.minimum(self.count, 1)
        self._gather()
        self.t2 = np.minimum(self.c2, 1)
        self.c3 = np.bincount(self.cell_word, self.t2, minlength=words).astype(np.int64)
        self.t3 = np.minimum(self.c3, 1)
        self.customers1, self.tables1 = self.own()

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of this shard's words in each restaurant."""
        return tuple(np.bincount(self.context, x, minlength=len(self.codes)).astype(np.int64) for x in (self.count, self.t1))

    def _gather(self) -> None:
        self.c2 = np.bincount(self.cell, self.t1, minlength=len(self.cell_word)).astype(np.int64)

    def root(self, c3: np.ndarray, t3: np.ndarray, totals: Totals, discount: tuple[float, ...]) -> np.ndarray:
        theta, d, customers = self.model.strength[2], discount[2], totals["root_customers"]
        return ((c3 - d * t3) + (theta + d * totals["root_tables"]) / (totals["types"] + 1)) / (theta + customers)

    def of_class(self, c2: np.ndarray, t2: np.ndarray, which: np.ndarray, root: np.ndarray, totals: Totals, discount: tuple[float, ...]) -> np.ndarray:
        theta, d = self.model.strength[1], discount[1]
        return ((c2 - d * t2) + (theta + d * totals.tables2[which]) * root) / (theta + totals.customers2[which])

    def sweep(self, totals: Totals, discount: tuple[float, ...], log_s: list[np.ndarray]) -> None:
        """Redraw the tables of all types, then of all (class, word) cells, then of all words; a dish never counts itself in its parent's odds."""
        theta = self.model.strength
        live = np.flatnonzero(self.count > 1)
        if len(live):
            cell = self.cell[live]
            c2 = self.c2[cell] - self.t1[live]
            t2 = np.where(c2 > 0, np.minimum(self.t2[cell], c2), 0)
            w = self.cell_word[cell]
            c3 = np.where(c2 > 0, self.c3[w], self.c3[w] - self.t2[cell])
            t3 = np.where(c3 > 0, np.minimum(self.t3[w], c3), 0)
            parent = self.of_class(c2, t2, self.cell_class[cell], self.root(c3, t3, totals, discount), totals, discount)
            weight = (theta[0] + discount[0] * self.tables1[self.context[live]]) * parent
            self.t1[live] = draw_tables(self.rng, self.count[live], weight, discount[0], log_s[0])
            self._gather()
        c3 = self.c3[self.cell_word] - self.t2
        t3 = np.where(c3 > 0, np.minimum(self.t3[self.cell_word], c3), 0)
        weight = (theta[1] + discount[1] * totals.tables2[self.cell_class]) * self.root(c3, t3, totals, discount)
        self.t2 = draw_tables(self.rng, self.c2, weight, discount[1], log_s[1])
        self.c3 = np.bincount(self.cell_word, self.t2, minlength=self.words).astype(np.int64)
        weight = np.full(self.words, (theta[2] + discount[2] * totals["root_tables"]) / (totals["types"] + 1))
        self.t3 = draw_tables(self.rng, self.c3, weight, discount[2], log_s[2])

    def totals(self) -> Totals:
        out = Totals()
        out.customers2[:] = np.bincount(self.cell_class, self.c2, minlength=CLASSES)
        out.tables2[:] = np.bincount(self.cell_class, self.t2, minlength=CLASSES)
        out["root_customers"], out["root_tables"] = self.c3.sum(), self.t3.sum()
        out["types"], out["tokens"] = (self.c3 > 0).sum(), self.count.sum()
        for level, c in ((1, self.count), (2, self.c2), (3, self.c3)):
            out[f"once{level}"], out[f"twice{level}"] = (c == 1).sum(), (c == 2).sum()
        return out

    def predictive(self, totals: Totals, discount: tuple[float, ...]) -> np.ndarray:
        """The probability of each type's word after its context, under the present seating."""
        theta, d = self.model.strength[0], discount[0]
        root = self.root(self.c3, self.t3, totals, discount)[self.cell_word]
        parent = self.of_class(self.c2, self.t2, self.cell_class, root, totals, discount)[self.cell]
        k = self.context
        return ((self.count - d * self.t1) + (theta + d * self.tables1[k]) * parent) / (theta + self.customers1[k])


def discounts(totals: Totals, model: Model) -> tuple[float, ...]:
    """n1 / (n1 + 2 n2) at each level, within [0.1, 0.95]; the model's own where nothing was seated."""
    out = []
    for level, start in zip((1, 2, 3), model.discount):
        once, twice = totals[f"once{level}"], totals[f"twice{level}"]
        out.append(min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else start)
    return tuple(out)


def _merged(pdf: pd.DataFrame) -> tuple[tuple, tuple]:
    """One shard's requests together: types (word, context, the contexts' codes, count, how many words), and where each request's types and words went."""
    hashes = [np.cumsum(stretch(x, np.uint64), dtype=np.uint64) for x in pdf["words"]]
    words, at = np.unique(np.concatenate(hashes), return_inverse=True)
    word = np.repeat(at, np.concatenate([stretch(x, np.uint32) for x in pdf["per_word"]]))
    contexts = [stretch(x, np.uint64) for x in pdf["contexts"]]
    codes, place = np.unique(np.concatenate(contexts), return_inverse=True)
    key, kind = np.unique(word.astype(np.int64) << 32 | place, return_inverse=True)
    count = np.bincount(kind, np.concatenate([stretch(x, np.uint32) for x in pdf["counts"]]), minlength=len(key)).astype(np.int64)
    return (key >> 32, key & 0xFFFFFFFF, codes, count, len(words)), (kind, [len(x) for x in contexts], at, [len(x) for x in hashes])


TOLD = "shard int, part int, contexts binary, customers binary, tables binary, sums array<double>"
REPLY = "shard int, part int, customers binary, tables binary"


def _in_parts(codes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the codes by part, codes ascending within one, and where each part starts in it, with the end."""
    part = _part_of(codes, parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def tell(seating: Seating, shard: int, parts: int) -> pd.DataFrame:
    """What a shard knows: a row for every part that has contexts of it, and one with the sums."""
    order, cuts = _in_parts(seating.codes, parts)
    codes, customers, tables = (x[order] for x in (seating.codes, *seating.own()))
    rows = [(shard, p, squeeze(steps(codes[a:b])), squeeze(customers[a:b]), squeeze(tables[a:b]), None) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
    rows.append((shard, None, None, None, None, seating.totals().vector.tolist()))
    return pd.DataFrame(rows, columns=["shard", "part", "contexts", "customers", "tables", "sums"]).astype({"part": "Int32"})


def replies(told: DataFrame) -> DataFrame:
    """``REPLY`` rows: for every (shard, part) told, the totals of its contexts over all shards."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        codes = [np.cumsum(stretch(x, np.uint64), dtype=np.uint64) for x in pdf["contexts"]]
        ends = np.cumsum([len(x) for x in codes])[:-1]
        _, at = np.unique(np.concatenate(codes), return_inverse=True)
        sums = [np.bincount(at, np.concatenate([stretch(x, np.int64) for x in pdf[name]])).astype(np.int64)[at] for name in ("customers", "tables")]
        return pd.DataFrame({"shard": pdf["shard"], "part": pdf["part"], **{name: [squeeze(x) for x in np.split(v, ends)] for name, v in zip(("customers", "tables"), sums)}})

    return told.where("sums is null").groupBy("part").applyInPandas(add, REPLY)


def hear(seating: Seating, reply: pd.DataFrame, parts: int) -> None:
    """Take the totals of all parts for a shard's contexts."""
    order, _ = _in_parts(seating.codes, parts)
    reply = reply.sort_values("part")
    for name in ("customers", "tables"):
        values = np.empty(len(order), np.int64)
        values[order] = np.concatenate([stretch(x, np.int64) for x in reply[name]])
        setattr(seating, f"{name}1", values)


def score_documents(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``, one row per input row.

    The model learns from the rows whose crc32(doc_id as text) modulo 5 is not 1. Tokens are the words between ASCII blanks with A-Z
    lower-cased, then one end. Scores are log10 probabilities: ``base_score`` of the smoothed unigram, ``score`` of the restaurants, a
    distribution over the known words and one unknown; ``perplexity`` is that of the text under it (10 to the minus score over tokens). Null and empty texts are the end alone; repeated rows count as often as they
    occur; a null doc_id hashes as the empty text; without training rows every word is the unknown one. Extra columns are
    ignored; an empty table gives no rows. Words are told apart by 64-bit hashes, restaurants by ``context_bits`` of them, which grow with the text.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "restaurants")
    rows = id_and_text(docs).withColumn("held_out", fold("doc_id") == 1)
    n_bytes = pieces_for(rows, "text", 1)
    shards, bits = max(LEAST_SHARDS, -(-n_bytes // SHARD)), context_bits(n_bytes)
    parts = shards // 2
    names = ["kind", "chunk", "shard", "words", "per_word", "contexts", "counts", "docs"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Chunks of about CHUNK bytes: kind 0 keeps the documents' types, kind 1 goes to shards."""
        chunk = TaskContext.get().partitionId() << 32
        kept: list[pd.DataFrame] = []
        size = 0

        def packed() -> pd.DataFrame:
            pdf = pd.concat(kept, ignore_index=True)
            known = pdf["doc_id"].notna()
            p = Packed(pdf["text"].tolist(), ~pdf["held_out"].to_numpy(dtype=bool), bits)
            about = np.stack([pdf["doc_id"].fillna(0).to_numpy(dtype=np.int64), known.to_numpy(dtype=np.int64), pdf["held_out"].to_numpy(dtype=np.int64), p.n_tokens])
            out = [(0, chunk, 0, squeeze(steps(p.kind)), squeeze(p.per_word), squeeze(p.per_doc), squeeze(p.times), about.tobytes())]
            cuts, ends = _shard_cuts(p.hashes, shards), np.append(0, np.cumsum(p.per_word, dtype=np.int64))
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    x, y = ends[a], ends[b]
                    out.append((1, chunk, s, squeeze(steps(p.hashes[a:b])), squeeze(p.per_word[a:b]), squeeze(p.context[x:y]), squeeze(p.counts[x:y]), None))
            return pd.DataFrame(out, columns=names)

        for batch in batches:
            bounds = np.append(0, np.cumsum(batch["text"].str.len().to_numpy()))
            lo = 0
            while lo < len(batch):
                hi = int(min(max(np.searchsorted(bounds, bounds[lo] + CHUNK - size), lo + 1), len(batch)))
                kept.append(batch.iloc[lo:hi])
                size += int(bounds[hi] - bounds[lo])
                lo = hi
                if size >= CHUNK:
                    yield packed()
                    kept, size, chunk = [], 0, chunk + 1
        if kept:
            yield packed()

    schema = "kind byte, chunk long, shard int, words binary, per_word binary, contexts binary, counts binary, docs binary"
    packed_rows = scratch.save("packed", rows.mapInPandas(pack, schema), "kind")
    store = "requests_" + scratch.root.rsplit("-", 1)[1]
    buckets = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = packed_rows.where("kind = 1").select("chunk", "shard", "words", "per_word", "contexts", "counts").repartition(buckets, "shard")
    sent.write.option("path", f"{scratch.root}/{store}").option("compression", "zstd").bucketBy(buckets, "shard").saveAsTable(store)  # three passes read it and move none of it
    scratch.drop("packed/kind=1")
    try:
        requests = spark.table(store)

        def first_guests(pdf: pd.DataFrame) -> pd.DataFrame:
            """One table per type: what restaurants start with does not depend on how rows fall into chunks."""
            types, _ = _merged(pdf.sort_values("chunk"))
            return tell(Seating(*types, model, 0), int(pdf["shard"].iat[0]), parts)

        begun = scratch.save("begun", requests.groupBy("shard").applyInPandas(first_guests, TOLD))

        def seat(pdf: pd.DataFrame, reply: pd.DataFrame, totals: Totals, discount: tuple[float, ...], sweeps: int, samples: int) -> tuple[Seating, np.ndarray, tuple]:
            types, where = _merged(pdf.sort_values("chunk"))
            seating = Seating(*types, model, int(pdf["shard"].iat[0]))
            hear(seating, reply, parts)
            log_s = [stirling(d) for d in discount]
            mean = np.zeros(len(seating.word))
            for i in range(sweeps + samples):
                seating.sweep(totals, discount, log_s)
                if i >= sweeps:
                    mean += seating.predictive(totals, discount) / samples
            return seating, mean, where

        first = spark.sparkContext.broadcast(summed(begun).vector)  # of fixed size

        def burn_in(pdf: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
            seating, _, _ = seat(pdf, reply, Totals(first.value), model.discount, model.burn_in, 0)
            return tell(seating, int(pdf["shard"].iat[0]), parts)

        told = scratch.save("told", requests.groupBy("shard").cogroup(replies(begun).groupBy("shard")).applyInPandas(burn_in, TOLD))
        scratch.drop("begun")
        settled = summed(told)
        second = spark.sparkContext.broadcast(settled.vector)
        discount = discounts(settled, model)

        def answer(pdf: pd.DataFrame, reply: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk")
            seating, mean, (kind, kinds, at, words) = seat(pdf, reply, Totals(second.value), discount, model.burn_in, model.samples)
            by_word = np.bincount(seating.word, seating.count, minlength=seating.words).astype(np.int64)
            log_p = np.minimum(np.rint(-np.log10(mean) * STEPS), 65535).astype(np.uint16)
            out, x, y = [], 0, 0
            for chunk, n, m in zip(pdf["chunk"], kinds, words):
                out.append((chunk, pdf["shard"].iat[0], squeeze(log_p[kind[x : x + n]]), squeeze(by_word[at[y : y + m]])))
                x, y = x + n, y + m
            return pd.DataFrame(out, columns=["chunk", "shard", "log_p", "known"])

        answers = scratch.save("answers", requests.groupBy("shard").cogroup(replies(told).groupBy("shard")).applyInPandas(answer, "chunk long, shard int, log_p binary, known binary"))
        tokens, types = settled["tokens"], settled["types"]

        def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            right = right.sort_values("shard")
            log_p = np.concatenate([stretch(x, np.uint16) for x in right["log_p"]]) / -STEPS
            counts = np.concatenate([stretch(x, np.int64) for x in right["known"]])
            base = np.log10((counts + 0.5) / (tokens + 0.5 * (types + 1)))
            for r in left.itertuples():
                word = np.repeat(np.arange(len(counts)), stretch(r.per_word, np.uint32))
                kind, times = np.cumsum(stretch(r.words, np.uint32), dtype=np.uint32), stretch(r.counts, np.uint32).astype(np.float64)
                ids, known_id, held, n_tokens = np.frombuffer(r.docs, np.int64).reshape(4, -1)
                firsts = np.append(0, np.cumsum(stretch(r.contexts, np.uint32).astype(np.int64)))[:-1]
                add = lambda v: np.add.reduceat(v * times, firsts)  # noqa: B023, E731  every text has a type, its end
                known = add((counts > 0)[word][kind]).astype(np.int64)
                out.append(pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "held_out": held.astype(bool), "n_tokens": n_tokens, "n_known": known, "train_tokens": int(tokens), "base_score": add(base[word][kind]), "score": add(log_p[kind])}))
                out[-1].loc[known_id == 0, "doc_id"] = pd.NA
            return pd.concat(out, ignore_index=True)

        kept = packed_rows.where("kind = 0").select("chunk", "words", "per_word", "contexts", "counts", "docs")
        result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        scored = kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(total, result)
        rows = scratch.save("rows", scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))))
        scratch.drop_all_but("rows")
        return rows
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {store}")
        scratch.drop(store)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
