import random
import zlib

import numpy as np
import pytest

from txscore.llm import ann, mixing, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double, n_words long"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0.1, 1) for k, t in enumerate(texts)], DOCS)


def labelled(spark, n, seed=1):
    r = random.Random(seed)
    texts, toxic, quality_ = [], [], []
    for k in range(n):
        w = [f"w{r.randrange(500)}" for _ in range(r.randrange(20, 60))]
        bad = r.random() < 0.3
        if bad:
            w[r.randrange(len(w))] = "awful"
            w[r.randrange(len(w))] = "nasty"
        grade = r.randrange(3)
        w = [x.upper() + "!!" if grade == 0 else x + "," if grade == 1 else x for x in w]
        texts.append(" ".join(w))
        toxic.append(int(bad))
        quality_.append(grade)
    labels = spark.createDataFrame([(k, q, t) for k, (q, t) in enumerate(zip(quality_, toxic, strict=True))] + [(None, 1, 1), (0, None, None), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    return texts, toxic, quality_, labels


def test_toxicity(spark):
    texts, toxic, _, labels = labelled(spark, 900)
    texts += [None, "", "awful nasty " * 5000]
    rows = {r.doc_id: r for r in toxicity.toxicity(docs(spark, texts), labels).collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    held = [k for k in range(900) if rows[k].held_out]
    assert np.mean([rows[k].predicted == toxic[k] for k in held]) > 0.95
    assert rows[900].score == rows[901].score < 0.5 < rows[902].score


def test_held_out_labels_do_not_matter(spark):
    texts, _, _, labels = labelled(spark, 200)
    flipped = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(doc_id as string)), 5) = 0, 1 - toxic, toxic) toxic")
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs(spark, texts), x).collect()} for x in (labels, flipped))
    assert a == b


def test_models_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs(spark, ["a", None]), none).collect()} == {0.5}
    d = docs(spark, ["a", None])
    rows = quality.grade(d, quality.quality_model(d, none)).collect()
    assert [(r.expected_grade, r.tail_probability, r.predicted_grade) for r in rows] == [(0.0, 1.0, 0)] * 2
    assert toxicity.toxicity(docs(spark, []), none).count() == 0
    one = spark.createDataFrame([(0, 4, 0), (1, 4, 0)], "doc_id long, quality int, toxic int")
    assert {r.expected_grade for r in quality.grade(d, quality.quality_model(d, one)).collect()} <= {0.0, 4.0}


def test_quality(spark):
    texts, _, grades, labels = labelled(spark, 900)
    d = docs(spark, [*texts, None, "", "x " * 100_000])
    model = quality.quality_model(d, labels)
    out = quality.grade(d, model)
    rows = {r.doc_id: r for r in out.collect()}
    held = [k for k in range(900) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(rows) == 903 and out.columns[:5] == [c for c in d.columns if c != "text"]
    assert np.mean([rows[k].predicted_grade == grades[k] for k in held]) > 0.9
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows.values())
    kept = quality.select(d, model, tail=1, least=0.5)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in {r.doc_id: r for r in quality.grade(d, model, tail=1).collect()}.items() if r.tail_probability >= 0.5}


def test_ordinal_slopes():
    """The learning steps follow the slope of the likelihood, and thresholds stay in order."""
    m = quality.Ordinal(4, [0, 1, 2, 3])
    at, x = np.array([1, 2]), np.array([0.5, 2.0])
    for k in range(4):
        m.w[:] = [0, 0.3, -0.2, 0]
        before = m.w.copy()
        loss = lambda w: -np.log(np.diff(m.below(w[at] @ x))[k])
        slope = np.array([(loss(before + e) - loss(before - e)) / 2e-6 for e in np.eye(4) * 1e-6])
        copy = quality.Ordinal(4, [0, 1, 2, 3], shrink=0.0)
        copy.w[:] = before
        copy.learn(at, x, k)
        moved = before - copy.w
        assert (np.sign(moved[at]) == np.sign(slope[at])).all() and moved[0] == moved[3] == 0
        assert (np.diff(copy.cuts) >= 0).all()


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    open_ = list(names)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            target.update(share)
            break
        target.update({s: float(cap * sizes[s]) for s in over})
        open_ = [s for s in open_ if s not in over]
    return target


def test_mixing(spark):
    r = random.Random(3)
    rows = []
    for s, n in [("a", 200), ("b", 3), ("ä", 40), (None, 60), ("", 30), ("Z", 150), ("empty", 4), ("one", 1)]:
        rows += [(s, "x " * (0 if s == "empty" else r.choice([0, 1, 5, 20, 20, 300]))) for _ in range(n)]
    rows += [("a", None), ("a", "y " * 4000)]
    d = spark.createDataFrame([(k, t, "en", s, 9, 9) for k, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, size long, target long")
    out = mixing.mix(d).collect()
    sizes = {}
    for s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = brute_targets(sizes), {}
    assert len(out) == len(rows)
    for x in out:
        s, t = rows[x.doc_id]
        assert x.size == len((t or "").split()) and x.source_size == sizes[s]
        assert x.target == pytest.approx(want[s], rel=1e-9) and x.taken == x.copies * x.size <= 3 * x.size
        taken[s] = taken.get(s, 0) + x.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        # half of the longest document that is no longer than what was missing, at most
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 160), (s, taken[s], want[s])
    assert sorted(mixing.mix(d).collect()) == sorted(out)


def test_mixing_tilts_are_exponential(spark):
    """Rates of one source lie on one exponential of the size, and meet the target."""
    rows = spark.createDataFrame([(False, s, z, n) for s, z, n in [("a", 1, 50), ("a", 10, 20), ("a", 100, 3), ("b", 5, 10)]], "_none boolean, _source string, size long, times long")
    sources = spark.createDataFrame([(False, "a", 550, 1, 300.0), (False, "b", 50, 1, 149.0)], "_none boolean, _source string, source_size long, weight long, target double")
    for t in mixing.tilts(rows, sources, 2).collect():
        sizes = {"a": {1: 50, 10: 20, 100: 3}, "b": {5: 10}}[t._source]
        words = sum(n * z * min(3, np.exp(t.tilt * z / t.unit)) for z, n in sizes.items())
        assert words == pytest.approx({"a": 300.0, "b": 149.0}[t._source], rel=1e-5)


def test_mixing_shifts_are_the_nearest(spark):
    """Against every shift at which a copy begins: nothing comes nearer to the target, and what is missing is exact."""
    r, one = random.Random(5), 1 << 26
    rows = [(False, s, r.choice([1, 3, 40, 500]), r.randrange(4 * one)) for s, n in [("a", 60), ("b", 7), ("c", 1), ("d", 40)] for _ in range(n)]
    rows += [(False, "d", 7, one // 2)] * 30  # ties
    wanted = {"a": 5000.0, "b": 1.5, "c": 1e9, "d": 900.0}
    sources = spark.createDataFrame([(False, s, t) for s, t in wanted.items()], "_none boolean, _source string, target double")
    got = {x._source: x for x in mixing.shifts(spark.createDataFrame(rows, "_none boolean, _source string, size long, ticks long"), sources, 4).collect()}
    assert set(got) == set(wanted)
    for s, target in wanted.items():
        own = [(z, t) for _, k, z, t in rows if k == s]
        words = lambda shift: sum(z * min(max((t + shift) >> 26, 0), 3) for z, t in own)  # noqa: B023, E731
        begins = {j * one - t for _, t in own for j in (1, 2, 3)}
        best = min(abs(target - words(x)) for b in begins | {-one, one} for x in (b - 1, b) if -one <= x <= one)
        assert got[s].missing == target - words(got[s].shift) and abs(got[s].missing) == best


def test_mixing_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(none).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(x.size, x.target, x.taken) for x in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, rank int, score double")


def brute_nearest(ids, x, k=20, every=20):
    out = {}
    for a in range(len(ids)):
        if ids[a] % every == 0:
            s = np.add.reduce(x * x[a], axis=1)
            others = [b for b in range(len(ids)) if ids[b] != ids[a]]
            out[ids[a]] = [(ids[b], s[b]) for b in sorted(others, key=lambda b: (-s[b], ids[b]))[:k]]
    return out


def test_neighbours_recall_and_order(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 20)
    monkeypatch.setattr(ann, "CHUNK", 64)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 500)
    r = np.random.default_rng(1)
    centres = r.normal(size=(8, 12))
    x = (centres[r.integers(8, size=900)] + 0.3 * r.normal(size=(900, 12))) * r.uniform(0.5, 2, size=(900, 1))
    x[300:600] = x[300]  # a third share one vector
    x = x.astype(np.float32).astype(float)
    got = {}
    for row in ann.search(vectors(spark, x.tolist())).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    want = brute_nearest(list(range(900)), x)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [n for n, _, _ in rows] == list(range(1, 21))
        assert [s for _, _, s in rows] == sorted((s for _, _, s in rows), reverse=True)
        assert all(a[2] > b[2] or a[1] < b[1] for a, b in zip(rows, rows[1:], strict=False))
        assert all(s == pytest.approx(float(x[q] @ x[v]), abs=1e-12) and v != q for _, v, s in rows)
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("scale", [1e-140, 1e-6, 1.0, 8e6, 1e9, 1e150])
def test_neighbours_at_all_magnitudes(spark, scale):
    r = np.random.default_rng(7)
    x = r.normal(size=(60, 16)) * scale * np.where(np.arange(60)[:, None] % 7 == 0, 1e-3, 1.0)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.search(rows).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    want = brute_nearest(list(range(60)), x)
    assert {q: [(v, s) for _, v, s in sorted(f)] for q, f in got.items()} == want


def test_neighbours_where_leaves_are_split(spark, monkeypatch):
    """Every row can be found, rows in crowded places too, and queries that calibrated nothing have their recall."""
    for name, value in {"LEAF_ROWS": 30, "SPLIT_ROWS": 100, "SAMPLE_ROWS": 300, "REFINE_ROWS": 400, "CALIBRATION": 40, "CHUNK": 64, "QUERIES": 16}.items():
        monkeypatch.setattr(ann, name, value)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 10))
    x = centres[r.integers(12, size=4000)] + 0.3 * r.normal(size=(4000, 10))
    x[1000:2300] = x[1000]
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for row in ann.search(rows).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    want = brute_nearest(list(range(4000)), x)
    assert set(got) == set(want)
    recall = []
    for q, found in got.items():
        assert [n for n, _, _ in sorted(found)] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        recall.append(np.mean([s >= want[q][-1][1] for _, _, s in found]))
    calibrated = {row.vec_id for row in ann.hashed_sample(rows.where("vec_id % 20 = 0"), "vec_id", 40, 9).collect()}
    assert np.mean([m for q, m in zip(got, recall, strict=True) if q not in calibrated]) >= 0.9


def test_neighbours_of_one_id_with_two_vectors(spark):
    rows = [[1.0, 0.0], [0.0, 1.0], [3.0, 0.0], [0.0, 4.0], [0.0, 4.0]]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(vectors(spark, rows, [20, 20, 1, 2, 2])).orderBy("rank").collect()]
    assert got == [(20, 1, 2, 4.0), (20, 2, 1, 3.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]


def test_neighbours_defined_cases(spark):
    rows = [None, [0, 0], [1, None], [1, float("nan")], [1, float("inf")], [1, 2, 3], [1, 1], [1, 1], [2, 0], [0, 1]]
    ids = [0, 20, 40, 60, 80, 100, 120, 120, 7, 9]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(vectors(spark, rows, ids)).orderBy("query_id", "rank").collect()]
    assert got == [(120, 1, 7, 2.0), (120, 2, 9, 1.0)]
    assert ann.search(vectors(spark, [])).count() == 0
    assert ann.search(vectors(spark, [None, [0.0, 0.0]])).count() == 0
    assert ann.search(vectors(spark, [[1.0, 2.0]], [None])).count() == 0


def test_samples_are_bounded(spark):
    """The bound holds for repeated documents and labels too, and long texts aren't learnt from."""
    from txscore.llm._common import bounded_sample

    docs = spark.createDataFrame([(k % 40, f"text {k}") for k in range(400)] + [(1, "x" * 40_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 40, k % 2) for k in range(200)], "doc_id long, label int")
    for rows in (2, 15, 1000):
        got = bounded_sample(labels, docs, rows, 3).collect()
        assert len(got) == min(rows, len({(r.doc_id, r.text, r.label) for r in got})) and all(len(r.text) < 40_000 for r in got)
        assert sorted(got) == sorted(bounded_sample(labels, docs.repartition(7), rows, 3).collect())


def test_ftrl_equals_a_plain_one():
    """Weights of examples learnt one by one, against the update rule written out for dictionaries."""
    r = np.random.default_rng(2)
    model = toxicity.Ftrl(30, l1=0.3)
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k == 30 else 0.3
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - (1 if z[k] > 0 else -1) * l1) / (1.0 + n[k] ** 0.5)

    for _ in range(400):
        features = np.unique(r.integers(0, 30, size=6))
        label = int(features[0] < 5)
        model.learn(features, label)
        at = [*features.tolist(), 30]
        w = {k: weight(k) for k in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for k in at:
            sigma = (n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5
            z[k] = z.get(k, 0.0) + g - sigma * w[k]
            n[k] = n.get(k, 0.0) + g * g
    assert model.weights(np.arange(31)) == pytest.approx([weight(k) for k in range(31)], abs=1e-9)


def test_ordinal_probabilities_equal_plain_ones():
    """Of each grade the difference of two logistic tails, and their mean as the expected grade."""
    model = quality.Ordinal(8, [0, 1, 3, 4])
    model.w[:], model.cuts = np.linspace(-1, 1, len(model.w)), np.array([-1.0, 0.2, 1.5])
    for score in (-3.0, 0.0, 0.7, 5.0):
        p = np.diff(model.below(score))
        tail = [1.0, *(1 / (1 + np.exp(-(score - c))) for c in model.cuts), 0.0]
        assert p == pytest.approx([a - b for a, b in zip(tail, tail[1:], strict=False)])
        assert p.sum() == pytest.approx(1.0)
