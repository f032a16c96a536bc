"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from motionframe.llm import ann, bpe, lm_score, packing, simhash, spotsigs, suffix, toxicity, urlfilter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, k long, chunk int, bucket int, fp long, kind string, score double"
LONG = "wordy text of no meaning " * 4000


def row(doc_id, text):
    return (doc_id, text, None, None, None, "x", 1, 2, 3, 4, "y", None)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "the cat sat on the mat and the dog ran to the house with a ball"), (2, None), (3, ""), (None, "the cat sat on the mat"), (4, LONG), (5, LONG), (6, "  \t\n "), (7, "é" * 90), (7, "é" * 90), (8, "a\x00b \U0001f600"), (None, None)]
    return spark.createDataFrame([row(*r) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, None, 1), (4, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


def operators(labels):
    return {
        "lm": lm_score.score_documents, "pack": packing.pack_documents, "spots": spotsigs.fingerprint_documents, "simhash": simhash.near_duplicates,
        "suffix": suffix.remove_repeats, "bpe": bpe.encode_documents, "toxic": lambda d: toxicity.score_documents(d, labels),
    }


@pytest.mark.parametrize("name", ["lm", "pack", "spots", "simhash", "suffix", "bpe", "toxic"])
def test_documents(odd, none, labels, name):
    run = operators(labels)[name]
    found = run(odd).collect()
    assert len(found) >= 11 and sum(r.doc_id is None for r in found) >= 2
    if name != "pack":
        assert len(found) == 11
    assert run(none).collect() == []


def test_equal_texts_are_judged_alike(odd, labels):
    score = {r.doc_id: r.score for r in toxicity.score_documents(odd, labels).where("doc_id in (4, 5)").collect()}
    assert score[4] == score[5]
    prints = [r.fingerprint for r in spotsigs.fingerprint_documents(odd).where("doc_id in (4, 5)").collect()]
    assert prints[0] == prints[1]
    gone = {r.doc_id: r.n_removed for r in suffix.remove_repeats(odd).where("doc_id in (4, 5)").collect()}
    assert gone == {4: 0, 5: len(LONG)}


def test_stages(spark, odd, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            if docs is none:
                assert out.count() == 0
    kept = {r.doc_id for r in simhash.keep_one(odd).collect()}
    assert 4 in kept and 5 not in kept and 1 in kept


def test_one_row_of_each_component(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcdefg"}
    near = LONG + " one"  # of a long text whose shingles hardly change
    assert 0 <= (simhash.fingerprint(near) ^ simhash.fingerprint(LONG)).bit_count() <= simhash.DISTANCE
    rows = [
        (1, texts["a"]), (None, texts["b"]), (None, texts["c"]), (None, texts["c"]), (None, texts["a"]),
        (3, LONG), (5, near), (5, texts["d"]), (5, texts["e"]), (7, texts["f"]), (7, texts["f"]), (8, None), (8, ""), (None, None),
    ]
    docs = spark.createDataFrame([row(*r) for r in rows], SCHEMA)
    expected = [(1, texts["a"]), (3, LONG), (5, texts["d"]), (5, texts["e"]), (7, texts["f"]), (8, None), (None, texts["b"]), (None, texts["c"])]
    for some in (docs, docs.repartition(5), docs.orderBy(F.desc("text"))):
        assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(some).collect()), key=str) == sorted(expected, key=str)


def test_pages(spark):
    kind = "page_id long, url string, html string, host string, verdict string, rule string, payload binary, header string"
    big = "h" * 1200
    rows = [(1, None, None), (2, "", ""), (3, "x", "small"), (4, "HTTP://A.Net", "small"), (5, "http://b.org/fr/\r\n1", big), (9, "http://porn.test/", big), (9, "http://porn.test/", big), (None, "://", big), (7, "http://free-bets.test?free", "ü")]
    pages = spark.createDataFrame([(*r, "h", "v", "r", None, "x") for r in rows], kind)
    assert len(urlfilter.judge_urls(pages).collect()) == 9
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_pages(pages).collect()}
    assert {(5, "revisit", 9), (9, "response", None), (None, "revisit", 9), (3, "response", None), (1, "response", None)} <= found
    long = spark.createDataFrame([(1, "u" * 300_000, "w" * 5_000_000), (2, "\U0001f600x" * 100_000 + "://H/p?q", None)], "page_id long, url string, html string")
    assert {(r.page_id, r.payload_bytes) for r in warc.archive_pages(long).collect()} == {(1, 5_000_000), (2, 0)}
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0 and warc.archive_pages(pages.limit(0)).count() == 0


def test_long_urls(spark, tmp_path):
    mixed = "".join(chr(0x1F600 + i % 50) if i % 3 else "aB"[i % 2] for i in range(100_000))
    rows = [(1, mixed), (2, f"{mixed}://{mixed}"), (3, f"http://Ex.net/{mixed}?{mixed}"), (4, "/" * 100_000), (5, "http://a.org?x/y#z"), (6, "http://a.org#?/"), (7, "http://b.org/fr/é?x")]
    found = {r.page_id: r for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    low = mixed.translate(str.maketrans("AB", "ab"))
    assert (found[1].host, found[1].path) == ("", "") and (found[2].host, found[2].path) == (low, "") and (found[3].host, found[3].path, found[3].rule) == ("ex.net", f"/{mixed}", "net/")
    assert [(found[i].host, found[i].path) for i in (4, 5, 6, 7)] == [("", ""), ("a.org", ""), ("a.org", ""), ("b.org", "/fr/é")] and found[7].verdict == "allow"
    (tmp_path / "terms").write_text("# terms\nstrict Vile\n\nsoft odd\nsoft vile\nsoft strange\n")
    own = urlfilter.read_vocabulary(spark, str(tmp_path / "terms"))
    assert (own.strict, own.soft) == (("vile",), ("odd", "strange", "vile"))
    with pytest.raises(ValueError):
        urlfilter.read_vocabulary(spark, str(tmp_path / "terms"), most=2)
    assert not set(urlfilter.STRICT) & set(urlfilter.SOFT) and len(set(urlfilter.SOFT)) == len(urlfilter.SOFT) and len(set(urlfilter.STRICT)) == len(urlfilter.STRICT)


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, ids string, v string, list int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.5, 0.5]), (9, [-1.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (10, [1.0]), (50, [2.0, 2.0])]
    vectors = spark.createDataFrame([(*r, None, "i", "v", 1) for r in rows], kind)
    found = ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (0, 4, 50), (0, 5, 9), (50, 1, 8), (50, 2, 0), (50, 3, 1), (50, 4, 2), (50, 5, 9)]
    assert ann.nearest(vectors.limit(0), vectors.limit(0)).count() == 0
