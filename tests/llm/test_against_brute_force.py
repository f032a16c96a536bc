"""Every corpus operator against a plain version of it on small tables, its SQL, an exact round trip or held-out accuracy."""

import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from motionframe.llm import ann, bpe, induced, lm_score, packing, queries, simhash, spotsigs, storage, suffix, toxicity, warc
from motionframe.llm.components import connected_components
from tests.conftest import SF
from tests.oracle import by_sql, rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    found, expected = queries.QUERIES[name](spark, SF).toPandas(), by_sql(queries.ORACLE_SQL[name], SF)
    assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)


def test_lm_against_counts(spark, docs, texts):
    found = lm_score.score_documents(docs).toPandas().set_index("doc_id")
    words = lambda t: t.encode().lower().split() + [b""]
    train = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))
    total = sum(train.values())
    for i, t in texts.items():
        base = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (len(train) + 1))) for w in words(t))
        r = found.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(words(t)), sum(train[w] > 0 for w in words(t)), total, zlib.crc32(str(i).encode()) % 5 == 1)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = found[found.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.2


def test_lm_does_not_depend_on_the_layout(spark, docs):
    model = lm_score.Model(burn_in=1, samples=1)
    one = {r.doc_id: (r.score, r.perplexity) for r in lm_score.score_documents(docs.limit(60).coalesce(1), model).collect()}
    other = {r.doc_id: (r.score, r.perplexity) for r in lm_score.score_documents(docs.limit(60).repartition(5), model).collect()}
    assert one == other and all(p > 1 for _, p in one.values())


def test_restaurants_give_a_distribution():
    rng = np.random.default_rng(3)
    words, contexts = 40, 6
    counts = rng.poisson(1.2, (words, contexts))
    word, context = (x.ravel() for x in np.meshgrid(np.arange(words), np.arange(contexts), indexing="ij"))
    classes = np.arange(contexts) * 200 >> 8
    codes = classes.astype(np.uint64) << lm_score.CLASS_AT | np.arange(contexts, dtype=np.uint64)
    model = lm_score.Model()
    seating = lm_score.Seating(word, context, codes, counts.ravel(), words, model, 1)
    log_s = [lm_score.stirling(d) for d in model.discount]
    for _ in range(3):
        seating.customers1, seating.tables1 = seating.own()
        seating.sweep(seating.totals(), model.discount, log_s)
    totals = seating.totals()
    seating.customers1, seating.tables1 = seating.own()
    p = seating.predictive(totals, model.discount).reshape(words, contexts).sum(axis=0)
    known = int((seating.c3 > 0).sum())
    for k in range(contexts):
        c, t, g = seating.customers1[k], seating.tables1[k], classes[k]
        root = (1 + model.discount[2] * totals["root_tables"]) / (1 + totals["root_customers"]) / (known + 1)
        unknown = (1 + model.discount[0] * t) / (1 + c) * (1 + model.discount[1] * totals.tables2[g]) / (1 + totals.customers2[g]) * root
        never = words - known  # words without customers have the unknown word's probability each
        assert math.isclose(p[k] - (never - 1) * unknown, 1, rel_tol=1e-9)


def test_restaurants_hear_of_all_shards(spark):
    rng, model, parts = np.random.default_rng(8), lm_score.Model(), 5
    everything, seatings = Counter(), []
    for shard in range(3):
        codes = np.unique(rng.integers(0, 60, 40, dtype=np.uint64) << np.uint64(20))
        context, count = np.arange(len(codes)), rng.integers(1, 1 << 34, len(codes))
        seatings.append(lm_score.Seating(np.zeros(len(codes), np.int64), context, codes, count, 1, model, shard))
        everything.update(dict(zip(codes.tolist(), count.tolist())))
    told = spark.createDataFrame(pd.concat([lm_score.tell(s, i, parts) for i, s in enumerate(seatings)]).astype({"part": object}).replace({"part": {pd.NA: None}}), lm_score.TOLD)
    reply = lm_score.replies(told).toPandas()
    for shard, s in enumerate(seatings):
        lm_score.hear(s, reply[reply.shard == shard], parts)
        assert s.customers1.tolist() == [everything[c] for c in s.codes.tolist()]
        assert s.tables1.tolist() == [sum(c in t.codes for t in seatings) for c in s.codes]
    assert lm_score.summed(told)["tokens"] == sum(everything.values())
    assert lm_score.context_bits(1 << 29) == 21 and lm_score.context_bits(1 << 47) == 39


def test_table_draws_follow_the_restaurant():
    rng, discount, weight, c = np.random.default_rng(0), 0.5, 0.7, 5
    log_s = lm_score.stirling(discount)
    p = np.exp(log_s[c, 1 : c + 1]) * weight ** np.arange(1, c + 1)
    draws = lm_score.draw_tables(rng, np.full(40_000, c), np.full(40_000, weight), discount, log_s)
    assert np.allclose(np.bincount(draws, minlength=c + 1)[1:] / 40_000, p / p.sum(), atol=0.01)


def test_archive_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(20)
    both = pages.union(pages.withColumn("page_id", F.col("page_id") + 1000))
    archive = warc.Archive(both, storage.Scratch(spark, "test"))
    assert archive.payloads.count() == 20 and archive.headers.count() == 40
    html, ids, targets = {r.page_id: r.html.encode() for r in both.collect()}, set(), set()
    for r in warc.rebuild_records(archive.payloads, archive.headers).collect():
        record = bytes(r.record)
        head, _, rest = record.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
        assert version == "WARC/1.1" and end == b"\r\n\r\n" and {"WARC-Date", "WARC-Record-ID", "WARC-Target-URI"} <= set(fields)
        assert fields["WARC-Block-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest() and fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(html[r.page_id]).hexdigest()
        http, _, payload = block.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and http.endswith(b"Content-Length: %d" % len(html[r.page_id])) and r.payload == html[r.page_id]
        revisit = fields["WARC-Type"] == "revisit"
        assert revisit == (r.page_id < 1000 and len(html[r.page_id]) >= 1000) and payload == (b"" if revisit else html[r.page_id])
        ids.add(fields["WARC-Record-ID"])
        targets |= {fields["WARC-Refers-To"]} if revisit else set()
    assert len(ids) == 40 and targets <= ids
    archive.drop()


def test_a_damaged_archive_fails(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "x" * 2000), (2, "http://a.b/", "x" * 2000)], "page_id long, url string, html string")
    archive = warc.Archive(pages, storage.Scratch(spark, "test"))
    damaged = archive.payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    assert warc.read_back(archive.payloads, archive.headers).count() == 2
    for part in (damaged, archive.payloads.withColumn("payload", F.lit(b"y" * 2000))):
        with pytest.raises(Exception, match="disagree"):
            warc.read_back(part, archive.headers).collect()
    archive.drop()


def test_common_payloads_are_spread(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 3)
    rows = [(i, f"http://a.b/{i}", "h" * 1500 if i % 3 else f"{i}" * 900) for i in range(60)]
    found = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == 60 and {r.refers_to for r in found if r.record_type == "revisit"} == {59} and sum(r.record_type == "revisit" for r in found) == 39


def test_packing(docs, texts, tokenizer):
    ids = {i: e.ids + [0] for i, e in zip(texts, tokenizer.encode_batch(list(texts.values()), add_special_tokens=False))}
    found = packing.pack_documents(docs).toPandas()
    for r in found.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= 2048 and zlib.crc32(struct.pack(f"<{r.length}I", *part)) == r.ids_crc32
    for i, own in found.sort_values("piece").groupby("doc_id"):
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids[i])
        assert (own.length.tolist()[1:] == [2048] * (len(own) - 1)) and (len(ids[i]) > 2048 or len(own) == 1)
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert found.sequence_id.nunique() <= -(-found.length.sum() // 2048) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(0, 40))
def test_fullest_bin(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums |= {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
    chosen = packing.fullest(counts, room)
    assert sum(k * n for k, n in chosen.items()) == max(sums) and all(n <= counts[k] for k, n in chosen.items())


def test_simhash(docs, texts):
    import xxhash

    def plain(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = {i: plain(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(prints):
        for b in sorted(prints):
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    for r in simhash.near_duplicates(docs).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", find(r.doc_id))


def test_simhash_links_of_crowded_postings(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    values = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (40, 2))} | set(base))
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    scratch = storage.Scratch(spark, "test")
    pairs = {(r.a, r.b) for r in simhash.links(fps, scratch).collect()}
    found = {r.node: r.root for r in connected_components(simhash.links(fps, scratch), scratch).collect()}
    edges = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2]
    root = {v: v for v in values}
    for _ in range(len(values)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {v for e in edges for v in e}
    assert pairs == set(edges) and found == {v: root[v] for v in linked}
    wider = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
    assert {(r.a, r.b) for r in simhash.links(fps, scratch, 3).collect()} == wider


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=80) | st.lists(st.integers(1, 200), max_size=300) | st.lists(st.sampled_from([1, 2, 255]), max_size=80))
def test_suffix_array_and_prefixes(symbols):
    t = np.array([*symbols, 0], np.uint8)
    sa = induced.suffix_array(t)
    raw = t.tobytes()
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: raw[i:])
    shared = induced.permuted_common_prefixes(t, sa)
    for a, b in zip(sa, sa[1:]):
        n = 0
        while raw[a + n : a + n + 1] == raw[b + n : b + n + 1] != b"":
            n += 1
        assert shared[b] == n


def test_suffix_array_of_a_shard():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(2000)]
    for raw in (b" ".join(words[i] for i in rng.integers(0, 2000, 60_000)), bytes(rng.integers(2, 250, 200_000).astype(np.uint8)), b"x" * 200_000, b"abcab" * 40_000):
        t = np.append(np.frombuffer(raw, np.uint8), 0).astype(np.uint8)
        sa = induced.suffix_array(t)
        shared = induced.permuted_common_prefixes(t, sa)
        assert np.array_equal(np.sort(sa), np.arange(len(t)))
        a, b = sa[:-1].astype(np.int64), sa[1:].astype(np.int64)
        assert (t[a + shared[b]] < t[b + shared[b]]).all()  # ordered by the first symbol that differs
        for i in rng.integers(0, len(a), 200):
            assert t[a[i] : a[i] + shared[b[i]]].tobytes() == t[b[i] : b[i] + shared[b[i]]].tobytes()


def plain_removal(texts, match=50):
    first = {}
    for i, t in sorted(texts.items()):
        raw = t.encode()
        for k in range(len(raw) - match + 1):
            first.setdefault(raw[k : k + match], i)
    out = {}
    for i, t in texts.items():
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - match + 1):
            if first[raw[k : k + match]] < i:
                gone[k : k + match] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("chunk, hot", [(1 << 20, 1000), (1 << 15, 2)])
def test_suffix_dedup(docs, texts, chunk, hot, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    monkeypatch.setattr(suffix, "HOT", hot)
    expected = plain_removal(texts)
    found = suffix.remove_repeats(docs).collect()
    assert len(found) == len(expected)
    for r in found:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id]


def test_suffix_dedup_of_slices_with_over_32_strings(spark):
    rng = np.random.default_rng(11)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    base = word(3000)
    texts = {i: word(50) + base[a : a + int(rng.integers(80, 200))] + word(50) for i, a in enumerate(rng.integers(0, 2800, 120).tolist())}
    found = suffix.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), match=80, gram=24).collect()
    expected = plain_removal(texts, 80)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == expected


def test_cut_texts_keep_whole_characters(spark):
    passage = "é" * 40
    rows = [(1, f"a{passage}b"), (2, f"xx{passage}é yy"), (3, passage), (4, "x" * 49 + "é"), (5, "x" * 49 + "ã"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffix.cut_repeats(df).collect()} == {1: rows[0][1], 2: "xx yy", 4: rows[3][1], 5: "ã", 6: ""}


def test_bpe(docs, texts, tokenizer):
    for r in bpe.encode_documents(docs, with_ids=True).collect():
        ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == tokenizer.decode(ids, skip_special_tokens=False) == texts[r.doc_id]
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 'st\n<|endoftext|>é", max_size=80))
def test_bpe_on_any_text(tokenizer, text):
    coder = bpe.codec(bpe.default_vocabulary())
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.encode(text) == ids and coder.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def recall(spark, path, ids, x, index):
    """The share of the true five nearest found (ids divisible by 50 ask), and the index's lists, queries and lists read a query."""
    pd.DataFrame({"vec_id": ids, "embedding": list(x)}).to_parquet(f"{path}/vectors.parquet")
    vectors = spark.read.parquet(f"{path}/vectors.parquet")
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), index=index).collect()}
    hits = total = 0
    norm = np.linalg.norm(x, axis=1)
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q] / norm / norm[q]
        score[q] = -2
        for rank, i in enumerate(np.lexsort((ids, -score))[:5], 1):
            total += 1
            got = found[int(ids[q]), rank]
            hits += got[0] == ids[i]
            assert math.isclose(got[1], score[ids == got[0]][0], rel_tol=1e-12)
    v = vectors.select("vec_id", F.col("embedding").alias("v")).withColumn("h", F.xxhash64("v"))
    lists = ann.build(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), 5, index, storage.Scratch(spark, "test"))
    return hits / total, *lists.rows_read()


def test_ann_recall(spark, tmp_path):
    all_ = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = np.stack(all_.embedding.to_numpy()).astype(np.float64)
    assert recall(spark, tmp_path, all_.vec_id.to_numpy(), x, ann.Index(list_rows=24))[0] >= 0.9  # over 80 lists of vectors without any clusters


@pytest.mark.parametrize("index", [ann.Index(list_rows=100), ann.Index(list_rows=60, most_lists=12, fan=16, sample=4000)], ids=["flat", "levels"])
def test_ann_recall_over_hundreds_of_lists(spark, tmp_path, index):
    rng = np.random.default_rng(4)
    n, dim = 15_000, 32
    centres = rng.normal(size=(120, dim))
    x = centres[rng.integers(0, 120, n)] + rng.normal(scale=0.6, size=(n, dim))
    share, lists, queries, read = recall(spark, tmp_path, np.arange(n), x, index)
    print(f"recall {share:.3f}, {lists} lists, {read:.1f} read by each of {queries} queries")
    assert share >= 0.9 and lists > 100 and read < lists / 4


def test_recurrent_gradients():
    s = toxicity.Settings(hidden=3, word_rows=8, gram_rows=16, word_size=2, gram_size=3)
    net = toxicity.Network(s)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(2)
    p = rng.normal(size=(9, 18))
    index, y = rng.integers(0, 9, (4, toxicity.WIDTH)), np.array([0, 1, 1, 0.0])
    index[:, 0] = 1

    def loss():
        z = net.forward(p, index)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    grad, d_p, _ = net.gradients(p, index, y)
    for values, g in [*((net.w[k], g) for k, g in grad.items()), (p, d_p)]:
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 6)]:
            kept = values[at]
            values[at] = kept + 1e-3
            up = loss()
            values[at] = kept - 1e-3
            down = loss()
            values[at] = kept
            assert abs((up - down) / 2e-3 - g[at]) < 2e-3 * max(0.02, abs(g[at])) + 2e-5


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.query(spark, sf).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    toxic, clean = found[found.toxic == 1], found[found.toxic == 0]
    assert toxic.predicted.mean() > 0.8 and clean.predicted.mean() < 0.03
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()).mean() > 0.95


def test_scores_against_a_plain_network():
    """One window after another, one word after another, in plain numbers."""
    s = toxicity.Settings(hidden=3, word_rows=64, gram_rows=128, word_size=2, gram_size=3)
    net = toxicity.Network(s)
    net.w["xb"] += 0.1
    w = {k: v.tolist() for k, v in net.w.items()}
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    times = lambda v, m: [sum(a * row[j] for a, row in zip(v, m)) for j in range(len(m[0]))]

    def given(word):
        table = toxicity.Words(s.word_rows, s.gram_rows)
        table.rows([[word]])
        ids, grams, _ = table.features([word])
        mean = [sum(w["gram"][g][i] for g in grams) / len(grams) for i in range(s.gram_size)]
        return [a + b for a, b in zip(times(w["word"][ids[0]] + mean, w["x"]), w["xb"])]

    def recur(xs, u):
        h, out = [0.0] * 3, []
        for x in xs:
            g = times(h, u)
            z = [sigmoid(x[i] + g[i]) for i in range(3)]
            r = [sigmoid(x[3 + i] + g[3 + i]) for i in range(3)]
            n = [math.tanh(x[6 + i] + r[i] * g[6 + i]) for i in range(3)]
            h = [n[i] + z[i] * (h[i] - n[i]) for i in range(3)]
            out.append(h)
        return out

    def window(words):
        xs = [given(x) for x in words] + [w["xb"]] * (toxicity.WIDTH - len(words))
        both = [f + b for f, b in zip(recur([x[:9] for x in xs], w["uf"]), recur([x[9:] for x in xs][::-1], w["ub"])[::-1])]
        score = [sum(math.tanh(a) * v for a, v in zip(times(h, w["a"]), w["v"])) if i < len(words) else -30.0 for i, h in enumerate(both)]
        weight = [math.exp(x - max(score)) for x in score]
        pooled = [sum(a * h[i] for a, h in zip(weight, both)) / sum(weight) for i in range(6)]
        return sum(a * b for a, b in zip(pooled, w["o"])) + w["ob"][0]

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}é" for i in rng.integers(0, 30, n)) for n in (1, 5, 32, 33, 48, 49, 90)]
    for text, found in zip(texts, toxicity.Scorer(net).score(texts)):
        words = text.split()
        starts = range(0, max(1, -(-(len(words) - toxicity.STEP) // toxicity.STEP)) * toxicity.STEP, toxicity.STEP)
        assert math.isclose(found, sigmoid(max(window(words[i : i + toxicity.WIDTH]) for i in starts)), rel_tol=1e-4)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 40, "x" * (100 if i else 5000) + str(i)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    texts, marks = toxicity.training_rows(docs, labels, toxicity.Settings(per_class=10, per_class_bytes=500, longest=1000))
    assert 0 < len(texts) <= 10 and sum(map(len, texts)) <= 1000 and len(set(texts)) == len(texts) and set(marks) == {0, 1}


def test_every_word_of_a_long_text_is_scored(spark):
    net = toxicity.train(["plain words only here"] * 30 + ["plain vileword words here"] * 30, np.array([0] * 30 + [1] * 30))
    scorer = toxicity.Scorer(net)
    body = ["plain", "words"] * 4000
    clean = scorer.score([" ".join(body)])[0]
    for at in (0, 17, 4001, 7999):
        assert scorer.score([" ".join(body[:at] + ["vileword"] + body[at + 1 :])])[0] > max(0.5, clean)


@pytest.mark.parametrize("glue, clean, vile", [(",", "some plain words only here of no harm", "vileword"), ("_", "some plain words only here of no harm", "vileword"), ("", "今天 天气 很好 我们 去 公园 散步 看 花", "恶劣坏话")])
def test_every_byte_of_a_run_without_blanks_is_scored(glue, clean, vile):
    rng, words = np.random.default_rng(7), clean.split()

    def run(toxic, at=None):
        body = [words[i] for i in rng.integers(0, len(words), 100)]
        if toxic:
            body[rng.integers(100) if at is None else at] = vile
        return glue.join(body)

    labels = np.arange(200) % 2
    scorer = toxicity.Scorer(toxicity.train([run(y) for y in labels], labels))
    assert max(scorer.score([run(0) for _ in range(10)])) < 0.5 < min(scorer.score([run(1, at) for at in (0, 1, 17, 40, 71, 98, 99)]))


def test_pieces_cover_a_run():
    for run in ("x" * 65, "ab" * 500, "é" * 33, "字" * 1001, "İ" * 40):
        marked, seen = b"<" + run.lower().encode() + b">", 0
        pieces = toxicity.words_of(f"a {run} b")[1:-1]
        for piece in pieces[:-1]:
            assert piece == marked[seen : seen + toxicity.PIECE]
            seen += toxicity.STRIDE
        assert marked.endswith(pieces[-1]) and seen - toxicity.STRIDE + toxicity.PIECE >= len(marked) - len(pieces[-1]) and max(map(len, pieces)) <= 64
    assert toxicity.words_of("(" + "Vile," * 20 + "/" * 3 + "é" * 33 + "_end)")[19:22] == ["vile"] + toxicity.words_of("é" * 33)[:2]
    assert toxicity.words_of("/" * 100) and toxicity.words_of("x" * 64 + " " + "é" * 32 + " ok") == ["x" * 64, "é" * 32, "ok"]


def test_signatures_against_plain_loops(spark):
    rng = np.random.default_rng(9)
    pool = ["the", "a", "of", "un", "thee", "cat", "dog", "x1", "An", "été"]
    texts = ["", "the", "the the", "the cat", "the cat dog", "cat dog the", "the a cat of dog", *(" ".join(rng.choice(pool, n)) + "." for n in rng.integers(1, 40, 60))]

    def plain(text):
        words = [w.lower() for w in "".join(c if c.isalnum() else " " for c in text).split()]
        content = lambda k: [w for w in words[k + 1 :] if w not in spotsigs.ANCHORS][:2]
        found = {":".join([w, *content(k)]) for k, w in enumerate(words) if w in spotsigs.ANCHORS and len(content(k)) == 2}
        return sorted(found) or [" " + " ".join(words) + " " if words else "  "]

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", spotsigs.signature_texts(F.col("text")).alias("s")).collect()
    for r in rows:
        assert [x.strip() for x in r.s] == [x.strip() for x in plain(texts[r.i])]


def test_texts_of_anchors_only_cost_linear_time(spark):
    import time

    long = spark.createDataFrame([("the " * 100_000 + "cat " + "of the " * 50_000 + "dog " + "the " * 1000,)], "text string").select(spotsigs.signature_texts(F.col("text")).alias("s"))
    began = time.perf_counter()
    assert long.first().s == ["the:cat:dog"] and time.perf_counter() - began < 10


def test_spot_pairs(docs):
    members, pairs = spotsigs.near_pairs(docs)
    sets = {}
    for r in docs.select("doc_id", spotsigs.signature_texts(F.coalesce("text", F.lit(""))).alias("s")).collect():
        sets[r.doc_id] = frozenset(r.s)
    name = {}
    for i in sorted(sets):
        name.setdefault(sets[i], i)
    assert {r.doc_id: r.class_id for r in members.collect()} == {i: name[s] for i, s in sets.items()}
    reps = sorted(name.values())
    expected = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == expected


def test_pipeline_stages(spark, docs, texts, tokenizer):
    kept = spark.createDataFrame(corpus_pipeline.drop_toxic(spark, docs, SF).collect(), docs.schema)
    scores = {r.doc_id: r.predicted for r in toxicity.query(spark, SF).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if not p}
    one = spark.createDataFrame(corpus_pipeline.drop_near_duplicates(spark, kept, SF).collect(), docs.schema)
    assert sorted(r.doc_id for r in one.collect()) == sorted({r.component_id for r in simhash.near_duplicates(kept).collect()})
    cut = spark.createDataFrame(corpus_pipeline.drop_repeats(spark, one, SF).collect(), docs.schema)
    before = {r.doc_id: r.text for r in one.collect()}
    gone = plain_removal(before)
    after = {r.doc_id: r.text for r in cut.collect()}
    assert set(after) == {i for i, (n, m, _, _) in gone.items() if m < n or n == 0}
    for i, t in after.items():
        n, m, spans, _ = gone[i]
        assert n - m <= len(t.encode()) <= n - m + 6 * spans and (m or t == before[i])
    packed = corpus_pipeline.pack(spark, cut, SF).toPandas()
    lengths = {i: len(e.ids) + 1 for i, e in zip(after, tokenizer.encode_batch(list(after.values()), add_special_tokens=False))}
    assert packed.groupby("doc_id").length.sum().to_dict() == lengths
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
