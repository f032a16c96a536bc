"""Class quality of pairs of instants, labelled barycentres and typed tables against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionframe import schema
from motionframe.operators import cluster, mining, templates
from motionframe.plans import mining as plans
from motionframe.sources import containers, samples
from tests.conftest import SF


def test_slopes_around_a_shape(spark):
    shape = spark.createDataFrame([(1, 7, [1.0, 4.0, 9.0, None], [1, 2, 2, 1])], "channel int, k int, v array<double>, m array<int>")
    offsets = spark.createDataFrame([(1, -1, 1)], "channel int, a int, b int")
    found = {(r.at, r.kind): (r.x, r.label) for r in mining.window_slopes(shape, offsets, "channel", "k", "v", "m").collect()}
    v, t, expected = [1.0, 4.0, 9.0, None], [0.0, 0.25, 0.5, 0.75], {}
    for j in range(4):
        there = [j / 3 + o / 4 for o in (-1, 1)]
        i, k = (min(max(int((x - 1 if x > 1 else x + 1 if x < 0 else x) * 3), 0), 3) for x in there)
        for kind, p, q in (("left", i, j), ("right", j, k), ("all", i, k)):
            if p != q and v[p] is not None and v[q] is not None:
                expected[j, kind] = ((v[p] - v[q]) / (t[p] - t[q]), [1, 2, 2, 1][j])
    assert found == expected and expected


def test_drawn_qualities_are_balanced(spark):
    candidates, exact = plans._class_qualities(spark, SF)
    _, drawn = plans._class_qualities(spark, SF, 4)
    exact, drawn = ({(r.channel, r.a, r.b, r.l1, r.l2): r.quality for r in d.collect()} for d in (exact, drawn))
    assert set(drawn) <= set(exact) and drawn
    shapes, offers = plans._shapes(spark, SF)
    slopes = mining.window_slopes(shapes, offers, "channel", "vec_id", "embedding", "marks")
    sizes = {(r.channel, r.a, r.b): r.n for r in slopes.groupBy("channel", "a", "b", "label").agg(F.count("*").alias("c")).groupBy("channel", "a", "b").agg(F.min("c").alias("n")).collect()}
    for k, q in drawn.items():
        assert sizes[k[:3]] <= q <= 2 * sizes[k[:3]]  # of two classes of that size: no split at all, a perfect one
    some = next(iter(drawn))
    rows = slopes.where((F.col("channel") == some[0]) & (F.col("a") == some[1]) & (F.col("b") == some[2])).select("vec_id", "at", "kind", "label", "x", *[F.xxhash64(F.lit(d), F.lit(1), "vec_id", "at", "kind").alias(f"h{d}") for d in range(4)]).toPandas()
    plain = []
    for d in range(4):
        taken = {c: rows[rows.label == c].sort_values([f"h{d}", "vec_id", "at", "kind"]).x.to_numpy()[: sizes[some[:3]]] for c in some[3:]}
        values = sorted((float(x), c) for c, xs in taken.items() for x in xs)
        best = 0.0
        for i in range(len(values) - 1):
            if values[i + 1][0] > values[i][0] + 2 * 1.1920929e-07:
                sides = [[c for _, c in values[: i + 1]], [c for _, c in values[i + 1 :]]]
                best = max(best, sum(sum(s.count(c) ** 2 for c in some[3:]) / len(s) for s in sides))
        plain.append(best)
    assert drawn[some] == pytest.approx(np.mean(plain))
    assert mining.class_quality(slopes, ["channel", "a", "b"], ["vec_id", "at", "kind"], "label", "x", [1, 2, 3, 4]).count() == 0  # a class that no row has


def test_key_pairs_see_every_window(spark):
    wave = (np.sin(np.linspace(0, 2 * np.pi, 12, endpoint=False)) + 1).tolist()
    found = {(r.a, r.b): r.support for r in mining.key_pairs(spark.createDataFrame([(1, wave)], "c int, v array<double>"), ["c"], "v").collect()}
    expected = {}
    for start in range(12):
        window = [wave[(start + 6 + k) % 12] for k in range(12)]
        events = sorted({i for lo, hi, p in cluster.persistence(np.array(window)) if p > 0 for i in (lo, hi)} | {window.index(min(window))})
        for i, a in enumerate(events):
            for b in events[i + 1 :]:
                if b - a >= 2:
                    expected[a - 6, b - 6] = expected.get((a - 6, b - 6), 0) + 1
    assert found == expected and found


def plain_barycentre(xs, marks, table, lam, rounds=100):
    n, count = len(xs[0]), len(table)
    flat = [[v - (x[-1] - x[0]) / n * i for i, v in enumerate(x)] for x in xs]
    last = lambda f, pick: max(i for i, v in enumerate(f) if v == pick(f))
    lows, highs = [last(f, min) for f in flat], [last(f, max) for f in flat]
    seed = min(range(len(xs)), key=lambda k: ((lows[k] - sorted(lows)[len(xs) // 2]) ** 2 + (highs[k] - sorted(highs)[len(xs) // 2]) ** 2, k))
    shape, shares, seen, said = list(xs[seed]), [[float(k == m) for k in range(count)] for m in marks[seed]], set(), []
    for _ in range(rounds):
        state = (tuple(round(v, 9) for v in shape), tuple(round(s, 9) for f in shares for s in f))
        if state in seen:
            break
        seen.add(state)
        held = [[] for _ in range(n)]
        for x, m in zip(xs, marks):
            cells = [[np.exp(-(x[i] - shape[j]) * sum(table[m[i]][k] * shares[j][k] for k in range(count)) / lam) for j in range(n)] for i in range(n)]
            cost = np.full((n + 1, n + 1), np.inf)
            cost[0, 0] = 0
            for i in range(n):
                for j in range(n):
                    cost[i + 1, j + 1] = cells[i][j] + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
            i, j, total = n, n, cost[n, n] / n / 2**0.5
            while i and j:
                held[j - 1].append((x[i - 1], m[i - 1]))
                said.append((j - 1, m[i - 1], total))
                d, up, back = cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1]
                if d <= up and d <= back:
                    i, j = i - 1, j - 1
                elif up <= back:
                    i -= 1
                else:
                    j -= 1
        shape = [sum(v for v, _ in h) / len(h) for h in held]
        shares = [[sum(m == k for _, m in h) / len(h) for k in range(count)] for h in held]
    low, high = min(c for *_, c in said), max(c for *_, c in said)
    labels = []
    for frame in range(n):
        votes = {}
        for f, m, c in said:
            if f == frame:
                votes[m] = votes.get(m, 0.0) + ((high - c) / (high - low) if high > low else 1.0)
        labels.append(min(votes, key=lambda m: (-round(votes[m], 9), m)))
    return shape, labels


@pytest.mark.parametrize("lam", [0.5, 10.0])
def test_labelled_barycentres(spark, lam):
    rng = np.random.default_rng(4)
    table = cluster.label_table(3, 2.0)
    rows = []
    for c in ("p", "q"):
        wave = np.cumsum(rng.normal(size=7))
        rows += [(c, k, (np.roll(wave, k % 2) + rng.normal(0, 0.2, 7)).tolist(), [int(m) for m in np.sort(rng.integers(1, 4, 7))]) for k in range(5)]
    rows.append(("alone", 9, [3.0, 1.0, 2.0, 5.0, 4.0, 0.0, 1.0], [1, 1, 2, 2, 3, 3, 1]))
    found = templates.labelled_barycentres(spark.createDataFrame(rows, "c string, k int, x array<double>, m array<int>"), "c", "k", "x", "m", table, lam).toPandas()
    for c in ("p", "q", "alone"):
        mine, plain = found[found.c == c].sort_values("frame"), plain_barycentre(*zip(*[(r[2], r[3]) for r in rows if r[0] == c]), table.tolist(), lam)
        assert mine.value.tolist() == pytest.approx(plain[0], abs=1e-7) and mine.label.tolist() == plain[1]
    assert (found.share > 0).all() and (found.share <= 1).all() and set(found.members) == {5, 1}


def test_clustered_templates_close(spark):
    rng = np.random.default_rng(1)
    wave = np.sin(np.linspace(0, 6, 12))
    rows = [(i, 0, ((wave if i < 12 else -3 * wave) + rng.normal(0, 0.05, 12)).tolist(), [1] * 4 + [2] * 4 + [3] * 4) for i in range(24)] + [(99, 0, [float("nan")] * 12, [1] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, channel int, x array<double>, m array<int>")
    found = templates.clustered_templates(df, ["channel"], "vec_id", "x", "m", cluster.label_table(3, 2.0), edge=0.1, eps=0.2).collect()
    assert {r.cluster: r.members for r in found} == {0: 12, 12: 12}
    for r in found:
        assert abs(r["values"][0] - r["values"][-1]) < 1e-9 and r.labels == rows[0][3]
        assert np.abs(np.array(r["values"][2:-2]) - (wave if r.cluster == 0 else -3 * wave)[2:-2]).max() < 0.5


def test_templates_by_samples_alone(spark):
    rng = np.random.default_rng(2)
    wave = np.sin(np.linspace(0, 6, 10))
    rows = [(i, 0, (wave + rng.normal(0, 0.05, 10)).tolist(), [1 + (i >= 8)] * 10) for i in range(16)]  # one shape, labels far apart
    df = spark.createDataFrame(rows, "k long, channel int, x array<double>, m array<int>")
    sizes = {aware: sorted(r.members for r in templates.clustered_templates(df, ["channel"], "k", "x", "m", cluster.label_table(2, 50.0), eps=0.06, aware=aware).collect()) for aware in (True, False)}
    assert sizes[False] == [16] and sizes[True] != [16]


def test_files_by_their_number(spark, tmp_path):
    for name in ("12_left.featpair", "7.featpair", "x3.featpair", "30.samples", "deep/5a.featpair"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    found = containers.numbered_files(spark, str(tmp_path), ".featpair").collect()
    assert sorted((r.id, r.path.rsplit("/", 1)[1], r.bytes) for r in found) == [(5, "5a.featpair", 4), (7, "7.featpair", 4), (12, "12_left.featpair", 4)]


def test_typed_tables(spark, tmp_path):
    candidates, found = plans._class_qualities(spark, SF)
    samples.write_table(found, str(tmp_path / "q"), schema.PAIR_QUALITIES)
    stored = samples.read_table(spark, str(tmp_path / "q"), schema.PAIR_QUALITIES)
    assert stored.schema == schema.PAIR_QUALITIES and stored.count() == found.count()
    assert mining.summed_quality(stored, candidates, "channel").count() == candidates.count()
    fields = spark.createDataFrame([(0, 1, 0, [2, 5], [0.5, -1.0], 1.0, 0.4, 7.0)], schema.FIELD_CANDIDATES)
    samples.write_table(fields, str(tmp_path / "f"), schema.FIELD_CANDIDATES, "a")
    assert samples.read_table(spark, str(tmp_path / "f"), schema.FIELD_CANDIDATES).collect() == fields.collect()
    with pytest.raises(ValueError, match="total"):
        samples.write_table(found, str(tmp_path / "m"), schema.MINED_PAIRS)
    with pytest.raises(ValueError, match="field"):
        samples.read_table(spark, str(tmp_path / "f"), schema.FIELDS)


def test_similar_candidates_go(spark):
    from motionframe.operators import pairs

    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(2)), i, sorted({0, *rng.choice(25, int(rng.integers(1, 7)), replace=False).tolist()} - ({0} if i % 5 == 0 else set())), float(rng.integers(6))) for i in range(120)]  # nearly all have index 0
    df = spark.createDataFrame(rows, "g int, k int, ix array<int>, q double")
    for limit in (0.25, 0.5, 0.8):
        kept = {r.k for r in pairs.drop_similar(df, ["g"], "k", "ix", "q", limit).collect()}
        beaten = {k for g, k, ix, q in rows for h, j, jx, p in rows if g == h and (p > q or (p == q and j < k)) and ix and jx and len({*ix} & {*jx}) / max(len(ix), len(jx)) > limit}
        assert kept == {k for _, k, *_ in rows} - beaten and beaten


def test_similar_candidates_of_one_size_meet_in_no_pairs(spark, capsys):
    from motionframe.operators import pairs

    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(2)), i, rng.choice(14, 4, replace=False).tolist(), [float(rng.integers(6)), float("nan"), None][int(i % 20 == 3) + int(i % 20 == 7) * 2]) for i in range(150)]
    df = spark.createDataFrame(rows, "g int, k int, ix array<int>, q double")
    rank = lambda q: float("inf") if q != q else q
    for limit in (0.25, 0.5, 1.0):
        found = pairs.drop_similar(df, ["g"], "k", "ix", "q", limit)
        beaten = {k for g, k, ix, q in rows for h, j, jx, p in rows if g == h and p is not None and q is not None and (rank(p) > rank(q) or (rank(p) == rank(q) and j < k)) and len({*ix} & {*jx}) / 4 > limit}
        assert {r.k for r in found.collect()} == {k for _, k, *_ in rows} - beaten
        found.explain()
        assert "_jx" not in capsys.readouterr().out  # candidates are not compared with each other


def test_owners_of_long_and_short_ranges(spark):
    from motionframe.operators import cycles

    rng = np.random.default_rng(3)
    frames = [(int(rng.integers(2)), float(rng.integers(-500, 4000)) / 2) for _ in range(150)]
    ranges = [(int(rng.integers(2)), i, a, a + w) for i, (a, w) in enumerate(zip((rng.integers(-200, 1500, 30) / 1.0).tolist(), [0.0, 1.0, 3.0, 8.0, 100.0, 1e6] * 5))]
    found = cycles.range_owner(spark.createDataFrame(frames, "s int, t double").distinct(), spark.createDataFrame(ranges, "s int, o int, a double, b double"), ["s"], "t", "a", "b", "o", 2.0)
    expected = {(s, t): min(o for r, o, a, b in ranges if r == s and a <= t <= b) for s, t in frames if any(r == s and a <= t <= b for r, _, a, b in ranges)}
    assert {(r.s, r.t): r.o for r in found.collect()} == expected
