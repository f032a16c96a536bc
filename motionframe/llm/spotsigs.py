"""SpotSigs fingerprints: chains of content words that follow common-word anchors, compared by pruned Jaccard.

DataFrame functions only. An anchor (a common word) opens a signature of itself and the next ``CHAIN`` content
words, anchors in between skipped. A document's signatures form a set; documents are compared inside partitions
of similar set length, where a Jaccard of at least the threshold is possible at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import Scratch, table

#: Common words of the corpus' four languages that open a signature.
ANCHORS = tuple(
    "the a an of and to in is was that for on with as it be by at from this are or which not "
    "le la les de des un une et est dans que pour sur au du pas avec ce qui "
    "der die das und den dem ein eine ist zu mit von nicht auf im sich des er "
    "el los las y en se lo por con para su una del al no".split()
)
CHAIN = 2
THRESHOLD = 0.8
#: Documents per bucket of neighbouring ids, and the most buckets (two levels of bounds of that many's square root).
PER_BUCKET, MOST_BUCKETS = 100, 16_384


def _alternatives(words: tuple[str, ...]) -> str:
    """A regular expression for any of ``words``, factored by common prefixes."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    heads.pop("", None)
    parts = [head + _alternatives(tuple(tails)) for head, tails in heads.items()]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)})" + ("?+" if ends else "")


def normalised(text: Column) -> Column:
    """Lower-cased words of letters and digits, a blank before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


#: A word that no normalised text has; it ends the last chains.
_END = "\x01"


def signature_texts(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures ``anchor:word:..:word``; where there is none, the whole normalised text is the one.

    Anchors that follow each other share the content words after them, so a run of anchors is matched once, as a whole, with those
    words; made-up words at the end see to it that every run has some. Each word is read a fixed number of times, whatever
    the text; chains that would reach the end are dropped.
    """
    anchor = f"(?:{_alternatives(anchors)} )"
    following = f" {anchor}*+".join(["(\\S+)"] * chain)
    pattern = f".*? ({anchor}++)(?={following} )|.+"  # the rest after the last run is one match
    refs = "$1>" + ":".join(f"${i}" for i in range(2, chain + 2)) + ";"
    plain = normalised(text)
    found = F.split(F.regexp_replace(F.concat(plain, F.lit(f"{_END} " * chain)), pattern, refs), ";")
    runs = F.filter(found, lambda r: ~r.contains(_END) & (F.length(r) > chain))
    each = lambda r: F.transform(F.split(F.substring_index(r, " >", 1), " "), lambda a: F.concat(a, F.lit(":"), F.substring_index(r, ">", -1)))
    whole = F.transform(F.array(F.flatten(F.transform(runs, each))), lambda c: F.when(F.size(c) > 0, F.array_sort(F.array_distinct(c))).otherwise(F.array(plain)))
    return F.get(whole, F.lit(0))  # worked out once, used twice


def fingerprint_of(signatures: Column) -> Column:
    return F.md5(F.array_join(signatures, ";").cast("binary"))


def hashed(signatures: Column) -> Column:
    """The set as 64-bit hashes, which is what is compared and shuffled."""
    return F.transform(signatures, lambda s: F.xxhash64(s))


def jaccard(a: Column, b: Column) -> Column:
    """Of two non-empty sets. Sets of equal length are looked at whole; nothing is intersected where one set is the other."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def with_next(docs: DataFrame, columns: dict[str, str], derive=None) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``columns`` of the next row by descending doc_id; the first row follows the last.

    Ids are cut into buckets of about ``PER_BUCKET`` rows by approximate quantiles. Each bucket's first row is also a
    guest of the bucket before it, so no window spans the table. Null ids come last; rows with equal ids are in text order.
    ``derive`` adds columns after the one shuffle and before the neighbour is looked up.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.withColumn("k", key)
    n = docs.count()
    side = max(1, min(int(MOST_BUCKETS**0.5), int((n / PER_BUCKET) ** 0.5)))
    steps = [i / (side * side) for i in range(1, side * side)]
    bounds = sorted(set((docs.agg(F.percentile_approx("k", F.array(*map(F.lit, steps)), 20_000)).first()[0] or []) if steps else []))
    coarse = [bounds[i] for i in range(side - 1, len(bounds), side)]
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("k")))
    if bounds:
        rows = [F.array(*map(F.lit, bounds[i : i + side])) for i in range(0, len(bounds), side)]
        at = F.least(below(F.array(*map(F.lit, coarse))) if coarse else F.lit(0), F.lit(len(rows) - 1))
        docs = docs.withColumn("coarse", at).withColumn("bucket", F.col("coarse") * side + below(F.get(F.array(*rows), F.col("coarse")))).drop("coarse")
    else:
        docs = docs.withColumn("bucket", F.lit(0))
    heads = sorted((r["bucket"], r["k"]) for r in docs.groupBy("bucket").agg(F.max("k").alias("k")).collect())  # MOST_BUCKETS rows at most
    hosts = [(k, heads[(i + 1) % len(heads)][0]) for i, (_, k) in enumerate(heads)]
    spark = docs.sparkSession
    guests = spark.createDataFrame(hosts, "k long, host int")
    placed = docs.join(F.broadcast(guests), "k", "left")
    seats = F.when(F.col("host").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(True).alias("guest"))))
    seated = placed.select("doc_id", "text", "k", F.explode(seats).alias("seat")).select("doc_id", "text", "k", "seat.bucket", "seat.guest")
    seated = seated.repartition("bucket")
    seated = derive(seated) if derive else seated
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("k"), "text")
    looked = seated.select("*", *[F.lead(c).over(order).alias(new) for c, new in columns.items()])
    return looked.where(~F.col("guest")).drop("k", "bucket", "guest")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures``, one row per input row.

    The edited text has its last half (rounded down) replaced by as many (or all) code points of the next document's start. Null
    texts are empty; empty texts equal each other (likeness 1). Texts without a full chain are one signature of
    their own. Texts are moved once, whole. Repeated rows are one after the other; a lone row is its own next.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def derive(df: DataFrame) -> DataFrame:
        signed = df.withColumn("s", signature_texts(F.col("text")))
        return signed.withColumn("fingerprint", fingerprint_of(F.col("s"))).withColumn("sig", hashed(F.col("s"))).drop("s")

    paired = with_next(rows, {"text": "next_text", "sig": "next_sig"}, derive)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    paired = paired.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).drop("text", "next_text")
    signed = paired.withColumn("es", signature_texts(F.col("edited")))
    return signed.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint_of(F.col("es")).alias("edited_fingerprint"),
        jaccard(F.col("sig"), hashed(F.col("es"))).alias("near_edited"), jaccard(F.col("sig"), F.col("next_sig")).alias("near_next"), F.size("sig").cast("long").alias("n_signatures"),
    )


def near_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: each document's class (equal signature sets; named by the smallest doc_id) and the linked classes.

    Only one set per class is joined. A set's rarest signatures (as many as any match at the threshold must touch) are posted
    under its length partition and those above it that can still match; shared postings give candidates, which are pruned by
    length and verified by the exact Jaccard of their hashed signatures.

    Null texts are empty; empty texts and texts without a full chain are sets of one signature, so they are in a class with their equals only. Repeated
    rows are members each; a null doc_id is a member of its class; a class of null ids only has a null name and takes no part in pairs. Ties in a
    signature's frequency go by its hash. Extra columns are ignored; an empty table gives two empty tables.
    """
    scratch = Scratch(docs.sparkSession, "spotsigs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    signed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array_sort(hashed(signature_texts(text))).alias("sig"))
    signed = scratch.save("signed", signed.withColumn("set_hash", F.sha2(F.array_join(F.transform("sig", lambda x: x.cast("string")), ","), 256)))
    named = signed.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"))
    members = signed.join(named, "set_hash").select("doc_id", "class_id")
    sets = scratch.save("sets", signed.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig")).select("class_id", "sig", F.size("sig").alias("n")))
    tokens = sets.select("class_id", "n", F.explode("sig").alias("s"))
    common = tokens.groupBy("s").agg(F.count("*").alias("df"))
    rare = Window.partitionBy("class_id").orderBy("df", "s")
    ranked = tokens.join(common, "s").withColumn("r", F.row_number().over(rare))
    prefix = ranked.where((F.col("df") > 1) & (F.col("r") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1))
    step = -F.log(F.lit(threshold))
    part = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")  # sets within the threshold's ratio are in one partition or in neighbours
    posted = prefix.select("class_id", "n", "s", part.alias("part"))
    a = posted.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "s", "part")
    b = posted.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", F.explode(F.array(F.col("part"), F.col("part") - 1, F.col("part") + 1)).alias("part"))
    candidates = a.join(b, ["s", "part"]).where(F.col("a") < F.col("b")).where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - F.lit(1e-9)).select("a", "b").distinct()
    left = sets.select(F.col("class_id").alias("a"), F.col("sig").alias("sa"))
    right = sets.select(F.col("class_id").alias("b"), F.col("sig").alias("sb"))
    scored = candidates.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("likeness"))
    return members, scored.where(F.col("likeness") >= threshold)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


_LIST = ", ".join(f"'{a}'" for a in ANCHORS)


def _sql_signatures(source: str) -> str:
    """Rows ``id, sig`` of ``source`` (``id, t``): the same signature sets as list operations."""
    words = "list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
      SELECT id, CASE WHEN len(chains) > 0 THEN list_sort(list_distinct(chains)) ELSE [' ' || array_to_string(w, ' ') || ' '] END AS sig FROM (
        SELECT id, w, list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains([{_LIST}], w[i]) AND r[i] + {CHAIN} <= len(c)), lambda i: w[i] || ':' || c[r[i] + 1] || ':' || c[r[i] + 2]) AS chains FROM (
          SELECT id, w, list_filter(w, lambda x: NOT list_contains([{_LIST}], x)) AS c,
            list_transform(range(1, len(w) + 1), lambda i: len(list_filter(w[1:i], lambda x: NOT list_contains([{_LIST}], x)))) AS r
          FROM (SELECT id, {words} AS w FROM {source})))"""


#: The same rows as DuckDB SQL. Counting content words before every word is quadratic in a text's length: seconds at the smallest scales only.
ORACLE_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    o AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    e AS (SELECT doc_id, next_id, length(t) AS n, substr(t, 1, length(t) - length(t) // 2) || substr(nt, 1, length(t) // 2) AS et FROM o),
    s AS ({_sql_signatures("(SELECT doc_id AS id, t FROM d)")}),
    es AS ({_sql_signatures("(SELECT doc_id AS id, et AS t FROM e)")})
    SELECT e.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(et) AS edited_sha256, md5(array_to_string(s.sig, ';')) AS fingerprint, md5(array_to_string(es.sig, ';')) AS edited_fingerprint,
      CAST(len(list_intersect(s.sig, es.sig)) AS DOUBLE) / len(list_distinct(s.sig || es.sig)) AS near_edited,
      CAST(len(list_intersect(s.sig, ns.sig)) AS DOUBLE) / len(list_distinct(s.sig || ns.sig)) AS near_next, CAST(len(s.sig) AS BIGINT) AS n_signatures
    FROM e JOIN s ON e.doc_id = s.id JOIN es ON e.doc_id = es.id JOIN s AS ns ON e.next_id = ns.id
"""
