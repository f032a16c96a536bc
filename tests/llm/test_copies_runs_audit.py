"""Exact duplicates, periodic runs and the filter audit against plain versions, and their odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionframe.llm import audit, exact, periodic, spread
from motionframe.llm.storage import Scratch
from tests.conftest import SF
from tests.oracle import by_sql, rows

SCHEMA = "doc_id long, text string, source string, key string, salt int, tag long, winner string, runs int, words string, part string, state int, filter string, good boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", 1, 2, "w", 3, "x y", "p", 4, "f", True) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    hot = [(i, "the common text", "s") for i in range(1000, 1400)]
    rows = [(1, None, None), (2, "", "s"), (None, "", "s"), (None, None, None), (3, "a b", "t"), (3, "a b", "t"), (4, "A B", "t"), (5, "a b ", "t"), (None, "lone", "t"), (None, "lone", "t"), (6, "w " * 200_000, "t"), (7, "w " * 200_000, "s")]
    return frame(spark, rows + hot).repartition(7)


def plain_classes(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            out.append((i, keep, len(ids), left and i == keep, hashlib.sha256(t.encode()).hexdigest()))
            left = left and i != keep
    return Counter(out)


@pytest.mark.parametrize("digests", [(exact.sha256, exact.sha512), (lambda t: F.substring(exact.sha256(t), 1, 0), exact.sha256), (lambda t: F.octet_length(t).cast("string").cast("binary"), lambda t: F.substring(exact.sha512(t), 1, 1), exact.sha256)], ids=["strong", "none", "weak"])
def test_classes(spark, odd, digests):
    found = exact.classes(odd, digests).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == plain_classes([(r.doc_id, r.text) for r in odd.collect()])
    assert exact.classes(odd.limit(0), digests).count() == 0


def test_digests_that_fail_fail_the_job(odd):
    with pytest.raises(ValueError):
        exact.classes(odd, (lambda t: F.substring(exact.sha256(t), 1, 0),))


def test_one_row_of_equal_texts(odd):
    kept = exact.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, (r.text or "")[:9]) for r in kept.collect()) == Counter([(2, ""), (3, "a b"), (4, "A B"), (5, "a b "), (None, "lone"), (7, ("w " * 9)[:9]), (1399, "the commo")])
    assert exact.keep_one(odd.limit(0)).count() == 0


def test_common_keys_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST", 10)
    rows = spark.range(1000).select((F.col("id") % 3 * (F.col("id") % 50)).alias("k"), "id").withColumn("k", F.when(F.col("id") % 7 > 0, F.col("k")))
    groups = rows.where("k IS NOT NULL AND k % 2 = 0").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    found = spread.lookup(rows, groups, "k", "n", 1000)
    assert sorted(found.collect(), key=str) == sorted(rows.join(groups, "k", "left").select(*found.columns).collect(), key=str)
    assert {r.n for r in groups.collect()} & set(range(1, 11)) and max(r.n for r in groups.collect()) > 10


def plain_runs(words, min_exp=4, min_length=6):
    n, found = len(words), {}
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exp * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


_texts = st.lists(st.sampled_from("ab"), max_size=60) | st.builds(lambda a, b, k, c: a + b * k + c, *[st.lists(st.sampled_from("abc"), max_size=8)] * 2, st.integers(1, 9), st.lists(st.sampled_from("abc"), max_size=8))


@settings(max_examples=300, deadline=None)
@given(_texts, st.integers(1, 9), st.integers(2, 5), st.integers(1, 8))
def test_runs(words, lags, min_exp, min_length):
    ids = periodic.numbered([w.encode() for w in words])
    whole = periodic.smallest(periodic.scan(ids, 1, len(ids), min_exp, min_length))
    assert [tuple(r) for r in whole.tolist()] == sorted(plain_runs(words, min_exp, min_length), key=lambda r: (r[0], r[2]))
    parts = [periodic.scan(ids, lo, lo + lags, min_exp, min_length) for lo in range(1, len(ids) + 1, lags)]
    assert np.array_equal(periodic.smallest(np.concatenate([np.empty((0, 3), np.int64), *parts])), whole)
    gone = {i for s, length, q in whole.tolist() for i in range(s + q, s + length)}
    assert periodic.collapse([w.encode() for w in words], whole).decode() == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_blocks_of_lags(monkeypatch):
    words = [b"%d" % (i % 7) for i in range(60)] + [b"x"] * 9 + [b"%d" % (i % 3) for i in range(40)]
    ids = periodic.numbered(words)
    expected = periodic.scan(ids, 1, len(ids))
    monkeypatch.setattr(periodic, "BLOCK", 130)
    assert np.array_equal(periodic.scan(ids, 1, len(ids)), expected) and len(expected) > 3


@pytest.mark.parametrize("long, lags", [(periodic.LONG, periodic.LAGS), (20, 3), (0, 10**6)])
def test_run_rows(spark, long, lags):
    song = "la la la la la la\tso\x0bfa so fa so fa so fa  end"
    rows = [(1, song, "s"), (2, None, None), (3, "", "s"), (None, song, "s"), (1, song, "s"), (4, " \n ", "s"), (5, "a b " * 7, "s"), (6, "é " * 40 + "\x00", "s"), (7, " ".join(str(i * i % 977) for i in range(3000)) * 4, "s"), (8, "one two three", "s")]
    found = periodic.find_runs(frame(spark, rows), long=long, lags=lags)
    got = sorted((str(r.doc_id), tuple(tuple(x) for x in r.runs), r.collapsed) for r in found.collect())
    expected = []
    for i, text, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        expected.append((str(i), tuple(runs), " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(expected)
    assert all(r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() for r in found.collect())
    best = {r.doc_id: r for r in periodic.summary(found).collect()}
    assert (best[1].n_runs, best[1].start, best[1].length, best[1].period, best[1].exponent_milli) == (2, 0, 6, 1, 6000)
    assert best[3].start is None and best[3].runs_sha256 == best[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic.summary(periodic.find_runs(frame(spark, rows).limit(0), long=long, lags=lags)).count() == 0


def test_planted_repetitions():
    words = [b"%d" % i for i in range(50)]
    assert periodic.planted(None, words) == words and periodic.planted(5, []) == []
    changed = [i for i in range(300) if periodic.planted(i, words) != words]
    assert 15 < len(changed) < 50
    for i in changed:
        new = periodic.planted(i, words)
        a = next((k for k in range(50) if new[k] != words[k]), 50)
        p = next(p for p in range(1, 50) if new[a] == words[a - p])
        assert len(new) == 50 and all(new[k] == new[k - p] for k in range(a, 50)) and new[: a - p + 1] == words[: a - p + 1]


def plain_audit(rows, names, marks):
    """``rows``: part, failing filters, marks."""
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley, steps = Counter(), []
        for order in permutations(names):
            alive = mine
            for k, f in enumerate(order):
                gone, alive = [r for r in alive if f in r[1]], [r for r in alive if f not in r[1]]
                shapley[f] += len(gone)
                fails = [r for r in mine if f in r[1]]
                steps.append((f, (part, "".join(order), k + 1, len(alive), len(gone), len(fails) - len(gone), sum(r[1] == {f} for r in fails), *[sum(m in r[2] for r in gone) for m in marks])))
        out += [(*row, shapley[f]) for f, row in steps]
    return sorted(out)


def test_audit(spark):
    rng = np.random.default_rng(5)
    data = [(["x", "y", None, "z"][int(rng.integers(4))] if i else "only", *[None if rng.random() < 0.1 else bool(rng.random() < p) for p in (0.3, 0.5, 0.1, 0.9)], bool(rng.random() < 0.4)) for i in range(300)]
    data += [("all gone", True, True, True, True, True)] * 3
    table = spark.createDataFrame(data, "source string, a boolean, b boolean, c boolean, d boolean, m boolean")
    filters = {"P": "a", "Q": "b", "R": "c", "S": "d"}
    found = audit.audit(table, filters, {"m": "m"}, "source", Scratch(spark, "audit"))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "m_lost", "shapley"]
    plain = [(r[0] or "", {f for f, v in zip("PQRS", r[1:5]) if v}, {"m"} if r[5] else set()) for r in data]
    assert sorted(tuple(r) for r in found.collect()) == plain_audit(plain, "PQRS", ["m"])
    assert audit.audit(table.limit(0), filters, {"m": "m"}, "source", Scratch(spark, "audit")).count() == 0
    assert audit.audit(table, {"P": "a"}, {}, "source", Scratch(spark, "audit")).count() == 6
    with pytest.raises(ValueError):
        audit.audit(table, dict.fromkeys("ABCDEFG", "a"), {}, "source", Scratch(spark, "audit"))


def test_audited_documents(spark):
    capital = "THE " * 30 + "cat"
    rows = [(1, "w " * 250, "s"), (2, "w " * 250, "s"), (2, "w " * 250, "s"), (None, "w " * 250, None), (3, None, "s"), (4, "", "s"), (5, capital, "t"), (6, "5% off & more", "t"), (6, "", "t"), (None, None, "u"), (7, " ".join(map(str, range(300))), "u"), (8, "\t" + " ".join(map(str, range(200))) + "\n", "u")]
    rows += [(9, "often", "v")] * 150
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, None, 1), (5, 1, None), (None, 1, 1), (9, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    told, facts = defaultdict(set), []
    for i, good, toxic in [tuple(r) for r in labels.collect()]:
        told[i] |= ({"good"} if good == 1 else set()) | ({"toxic"} if toxic == 1 else set())
    for i, text, source in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if any(j is not None and i is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        facts.append((source or "", fails, told[i] if i is not None else set()))
    docs = frame(spark, rows)
    assert sorted(tuple(r) for r in audit.audit_documents(docs, labels).collect()) == plain_audit(facts, "ABCDE", ["good", "toxic"])
    assert audit.audit_documents(docs.limit(0), labels.limit(0)).count() == 0


def test_states_are_visited_once(spark, monkeypatch):
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, name, df, *by: (saved.append(name), save(self, name, df, *by))[1])
    monkeypatch.setattr(audit, "MOST_PARTS", 3)
    found = audit.query(spark, SF).toPandas()
    assert sorted(s for s in saved if s.startswith("edges/")) == sorted(f"edges/state={k}" for k in range(31))
    assert rows(found) == rows(by_sql(audit.ORACLE_SQL, SF)) and not spark.sparkContext._jsc.getPersistentRDDs()
