import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from txscore import config as C
from txscore.functions.features import real_features, vectorize
from txscore.functions.scalar import Q
from txscore.operators import index, knn
from txscore.sources.payload import parse_payloads
from txscore.sources.tables import read_references
from txscore.streaming.scorer import Scorer, score_stream


def payload(amount, installments, at, avg, count, known, merchant, mcc, merchant_avg, online, card, km, last):
    last = last and {"timestamp": last[0], "km_from_current": last[1]}
    return {"id": "t", "transaction": {"amount": amount, "installments": installments, "requested_at": at}, "customer": {"avg_amount": avg, "tx_count_24h": count, "known_merchants": known}, "merchant": {"id": merchant, "mcc": mcc, "avg_amount": merchant_avg}, "terminal": {"is_online": online, "card_present": card, "km_from_home": km}, "last_transaction": last}


# Example payloads and what they must give.
P1 = payload(384.88, 3, "2026-03-11T20:23:35Z", 769.76, 3, ["MERC-009", "MERC-001", "MERC-001"], "MERC-001", "5912", 298.95, False, True, 13.7090520965, ("2026-03-11T14:58:35Z", 18.8626479774))
P2 = payload(41.12, 2, "2026-03-11T18:45:53Z", 82.24, 3, ["MERC-003", "MERC-016"], "MERC-016", "5411", 60.25, False, True, 29.23, None)
P3 = payload(9505.97, 10, "2026-03-14T05:15:12Z", 81.28, 20, ["MERC-008", "MERC-007", "MERC-005"], "MERC-068", "7802", 54.86, False, True, 952.27, None)
P4 = payload(1, 1, "2026-03-11T00:00:00Z", 1, 0, [], "A", "9999", 1, False, True, 1, None)
P5 = payload(1, 1, "2026-03-11T20:23:35Z", 1, 0, [], "A", "5411", 1, False, True, 1, ("2026-03-11T14:58:35Z", 18.8626479774))
VECTORS = [
    [385, 2500, 500, 8696, 3333, 2257, 189, 137, 1500, 0, 10000, 0, 2000, 299],
    [41, 1667, 500, 7826, 3333, -10000, -10000, 292, 1500, 0, 10000, 0, 1500, 60],
    [9506, 8333, 10000, 2174, 8333, -10000, -10000, 9523, 10000, 0, 10000, 10000, 7500, 55],
    [1, 833, 1000, 0, 3333, -10000, -10000, 10, 0, 0, 10000, 10000, 5000, 1],
    [1, 833, 1000, 8696, 3333, 2257, 189, 10, 0, 0, 10000, 10000, 1500, 1],
]


def requests(spark, values):
    return spark.createDataFrame([(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in enumerate(values)], "query_id long, value string")


def test_payload_vectors(spark):
    flat = parse_payloads(requests(spark, [P1, P2, P3, P4, P5]))
    rows = vectorize(flat, ["query_id", "valid"]).orderBy("query_id").collect()
    assert [[r[q] for q in Q] for r in rows] == VECTORS and all(r.valid for r in rows)
    real = flat.where("query_id = 1").select(*real_features()).first()
    want = [0.004112, 2 / 12, 0.05, 18 / 23, 2 / 6, -1, -1, 0.02923, 3 / 20, 0, 1, 0, 0.15, 0.006025]
    assert np.allclose(list(real), want)


def edit(**changes):
    x = json.loads(json.dumps(P1))
    for path, v in changes.items():
        *head, last = path.split("__")
        at = x
        for h in head:
            at = at[h]
        if v is KeyError:
            del at[last]
        else:
            at[last] = v
    return x


@pytest.mark.parametrize(
    ("value", "valid"),
    [
        (edit(transaction__amount=KeyError), True),
        (edit(transaction__amount=None), False),
        (edit(customer=None), False),
        (edit(customer=KeyError), True),
        (edit(last_transaction=KeyError), True),
        (edit(last_transaction={}), True),
        (edit(last_transaction__timestamp=None), False),
        (edit(transaction__installments=2.5), False),
        (edit(transaction__installments=-1), False),
        (edit(transaction__installments=4294967296), False),
        (edit(transaction__amount="1"), False),
        (edit(transaction__requested_at="yesterday, about noon"), False),
        (edit(more={"a": [1, {"b": None}]}), True),
        ("{not json", False),
        ("", False),
        (None, False),
        (json.dumps(P1).replace("384.88", "1e999"), True),
        (json.dumps(P1)[:-3], False),
    ],
)
def test_payload_edges(spark, value, valid):
    assert parse_payloads(requests(spark, [value])).first().valid is valid


def test_empty_last_transaction_counts(spark):
    r = vectorize(parse_payloads(requests(spark, [edit(last_transaction={})])), ["query_id"]).first()
    assert (r.q5, r.q6) == (10000, 0)


def vectors(spark, rows, name="ref_id"):
    return spark.createDataFrame([(k, *map(int, v), int(y)) for k, (v, y) in enumerate(rows)], f"{name} long, " + ", ".join(f"{q} int" for q in Q) + ", label int")


def random_rows(n, seed, values):
    r = random.Random(seed)
    return [([r.choice(values) for _ in range(C.DIM)], r.random() < 0.3) for _ in range(n)]


def brute(queries, refs, k, leave_out):
    out = {}
    for a, (q, _) in enumerate(queries):
        d = sorted((sum((x - y) ** 2 for x, y in zip(q, v, strict=True)), b, int(label)) for b, (v, label) in enumerate(refs) if not (leave_out and a == b))
        out[a] = d[:k]
    return out


@pytest.mark.parametrize("values", [[0, 10000], [-10000, 0, 1, 3000, 5000, 10000], list(range(-10000, 10001, 7))])
@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
@pytest.mark.parametrize("leave_out", [False, True])
def test_strategies_equal_brute_force(spark, values, strategy, leave_out):
    refs, queries = random_rows(150, 1, values), random_rows(40, 2, values)
    q = vectors(spark, queries, "query_id").drop("label")
    got = {}
    for r in knn.knn(q, vectors(spark, refs), leave_out=leave_out, strategy=strategy, block_rows=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.d2, r.ref_id, r.label))
    want = {a: [(n, *t) for n, t in enumerate(d, 1)] for a, d in brute(queries, refs, 5, leave_out).items()}
    assert {a: sorted(v) for a, v in got.items()} == want


@pytest.mark.parametrize("share", [0.02, 0.3, 0.98])
def test_votes_equal_brute_force(spark, share):
    r = random.Random(9)
    refs, queries = ([(v, r.random() < share) for v, _ in random_rows(200, seed, list(range(-10000, 10001, 500)))] for seed in (7, 8))
    got = {r.query_id: r.fraud_count for r in knn.vote(vectors(spark, queries, "query_id").drop("label"), vectors(spark, refs)).collect()}
    assert got == {a: sum(y for _, _, y in d) for a, d in brute(queries, refs, 5, False).items()}


@pytest.mark.parametrize("name", ["knn_top5", "knn_vote", "knn_approximate", "embedding_knn", "probe_stats", "stream_score"])
def test_queries_beyond_the_broadcast_size(spark, monkeypatch, name):
    """The same rows and columns on both sides of the switch."""
    from txscore.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    sent = QUERIES[name](spark, sf)
    rows = sorted(sent.collect())
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    shuffled = QUERIES[name](spark, sf)
    assert shuffled.columns == sent.columns and sorted(shuffled.collect()) == rows


def test_a_table_searched_for_itself(spark):
    x = vectors(spark, random_rows(120, 21, [0, 3000, 10000])).withColumn("query_id", F.col("ref_id"))
    rows = {s: sorted(knn.knn(x, x, leave_out=True, strategy=s, block_rows=30, approximate=a).collect()) for s in ("broadcast", "blocks") for a in (False,)}
    assert rows["broadcast"] == rows["blocks"] and len(rows["blocks"]) == 600


def test_boxes_below_partitions(spark, monkeypatch):
    r = np.random.default_rng(1)
    monkeypatch.setattr(knn, "BOX_ROWS", 20)
    x = r.integers(-10000, 10000, size=(700, 14))
    refs = knn.References(np.arange(700), x, r.integers(0, 2, 700), np.arange(700) % 3)
    assert max(len(g[0]) for g in refs.groups) <= 20
    for key in (0, 2, 9):
        q = r.integers(-10000, 10000, size=(50, 14)).astype(float)
        stats = []
        best = refs.search(q, key, None, 5, stats)
        d = ((q[:, None, :] - x[None]) ** 2).sum(2)
        order = np.lexsort((np.broadcast_to(np.arange(700), d.shape), d), 1)[:, :5]
        assert (best.ids == order).all() and (stats[0] <= 3).all() and (stats[0] >= 1).all()


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_approximate_mode_keeps_its_bound(spark, strategy):
    near = [([int(5000 + 9 * x) for x in v], y) for v, y in random_rows(200, 11, range(-99, 99))]
    far = random_rows(60, 12, list(range(-10000, 10001, 100)))
    refs = near + far
    exact = {a: d for a, d in brute(refs, refs, 5, True).items()}
    got = {}
    for r in knn.knn(vectors(spark, refs, "query_id").drop("label"), vectors(spark, refs), leave_out=True, strategy=strategy, approximate=True).collect():
        got.setdefault(r.query_id, []).append((r.d2, r.ref_id, r.label))
    for a, rows in got.items():
        assert sorted(rows) == exact[a] or max(d for d, _, _ in rows) <= C.EARLY_STOP


def test_few_references(spark):
    q = vectors(spark, random_rows(3, 3, [0, 10000]), "query_id").drop("label")
    few = vectors(spark, [([0] * 14, 1), ([10000] * 14, 1)])
    for r in knn.vote(q, few).collect():
        assert (r.fraud_count, r.fraud_score, r.approved) == (2, 0.4, True)
    none = few.where("false")
    assert {r.fraud_count for r in knn.vote(q, none).collect()} == {0}
    assert {r.fraud_count for r in knn.votes(q, knn.knn(q, none, strategy="blocks")).collect()} == {0}


def test_index_round_trip(spark, tmp_path):
    rows = random_rows(300, 5, list(range(-10000, 10001, 50)))
    path = f"file://{tmp_path}/index"
    index.build_index(vectors(spark, rows), path)
    refs, parts, header = index.open_index(spark, path)
    assert header["points"] == refs.count() == 300 and header["fraud"] == sum(y for _, y in rows)
    for p in parts.collect():
        own = [tuple(r[q] for q in Q) for r in refs.where(f"pk = {p.pk}").collect()]
        assert len(own) == p.n
        assert [p[f"l{d}"] for d in range(14)] == [min(v[d] for v in own) for d in range(14)]
        assert [p[f"h{d}"] for d in range(14)] == [max(v[d] for v in own) for d in range(14)]
    with pytest.raises(ValueError):
        index.build_index(vectors(spark, rows).where("false"), path)
    spark.createDataFrame([(1, 14, 1, 300, 1, 1, 256)], index.META).write.mode("overwrite").json(f"{path}/header")
    with pytest.raises(ValueError):
        index.open_index(spark, path)


def test_leaves_are_small(spark, tmp_path):
    rows = random_rows(400, 6, list(range(-10000, 10001, 3)))
    got = index.leaves(vectors(spark, rows), f"file://{tmp_path}/a", 16)
    assert got.count() == got.select("ref_id").distinct().count() == 400
    assert got.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 16
    same = index.leaves(vectors(spark, [([1] * 14, 0)] * 50), f"file://{tmp_path}/b", 16)
    assert sorted(r["count"] for r in same.groupBy("leaf").count().collect()) == [12, 12, 13, 13]  # equal values by id


def test_append(spark, tmp_path):
    rows = vectors(spark, random_rows(300, 5, list(range(-10000, 10001, 50))))
    path, whole = f"file://{tmp_path}/index", f"file://{tmp_path}/whole"
    index.build_index(rows.where("ref_id < 200"), path, 16)
    with pytest.raises(ValueError):
        index.append_index(rows.where("ref_id > 190"), path)
    index.append_index(rows.where("ref_id >= 200"), path)
    index.build_index(rows, whole, 16)
    (a, p, h), (b, q, g) = index.open_index(spark, path), index.open_index(spark, whole)
    assert h == g and sorted(p.collect()) == sorted(q.select(*p.columns).collect())
    assert sorted(a.drop("leaf").collect()) == sorted(b.drop("leaf").collect())
    assert spark.read.parquet(f"{path}/leaves").agg(F.sum("n")).first()[0] == 300


GOLDENS = {
    0: (0, [(18, 1216173), (69, 2703537), (28, 4011680), (93, 5230401), (65, 6573807)]),
    1: (0, [(66, 4656467), (0, 5060154), (54, 6777510), (60, 12501358), (42, 13556233)]),
    2: (5, [(24, 28007922), (7, 236791033), (97, 257644232), (79, 263628938), (55, 363931321)]),
}


def test_goldens_of_the_sample(spark):
    """Neighbours and leave-one-out decisions over the published sample of 100 references, where it is there to read."""
    sample = os.environ.get("TXSCORE_SAMPLE", "")
    if not os.path.isfile(sample):
        pytest.skip("no sample here")
    refs = read_references(spark, f"file://{sample}")
    q = vectors(spark, [(v, 0) for v in VECTORS[:3]], "query_id").drop("label")
    got = {}
    for r in knn.knn(q, refs).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.ref_id, r.d2))
    assert got == {k: rows for k, (_, rows) in GOLDENS.items()}
    assert {r.query_id: r.fraud_count for r in knn.vote(q, refs).collect()} == {k: n for k, (n, _) in GOLDENS.items()}
    out = knn.vote(refs.withColumnRenamed("ref_id", "query_id"), refs, leave_out=True).join(refs.select(F.col("ref_id").alias("query_id"), "label"), "query_id")
    assert sorted((r.label, r.approved, r["count"]) for r in out.groupBy("label", "approved").count().collect()) == [(0, True, 75), (1, False, 24), (1, True, 1)]


def test_reference_json(spark, tmp_path):
    f = tmp_path / "refs.json"
    f.write_text(json.dumps([{"vector": [0.5] * 14, "label": "fraud"}, {"vector": [-1] * 14, "label": "else"}]))
    rows = read_references(spark, f"file://{f}").orderBy("ref_id").collect()
    assert [(r.q0, r.label) for r in rows] == [(5000, 1), (-10000, 0)]
    f.write_text(json.dumps([{"vector": [0.5] * 13, "label": "fraud"}]))
    with pytest.raises(Exception, match="14"):
        read_references(spark, f"file://{f}").collect()


def test_stream(spark, tmp_path):
    refs = vectors(spark, [(VECTORS[0], 0)] * 5 + [(VECTORS[2], 1)] * 5)
    scorer = Scorer(refs)
    assert scorer.ready() == "ok"
    values = [P1, P3, "{broken", edit(id="x" * 5000)]
    want = {0: '{"approved":true,"fraud_score":0.0}', 1: '{"approved":false,"fraud_score":1.0}', 2: '{"approved":true,"fraud_score":0.0}', 3: '{"approved":true,"fraud_score":0.0}'}
    rows = scorer.score(requests(spark, values)).collect()
    assert {r.query_id: r.response for r in rows} == want and {r.query_id: r.valid for r in rows} == {0: True, 1: True, 2: False, 3: False}
    requests(spark, values).write.json(f"file://{tmp_path}/in")
    query = score_stream(scorer, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    query.awaitTermination()
    assert {r.query_id: r.response for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == want


def test_equal_vectors_in_cells(spark):
    """a vector that most rows have isn't paired with itself; the rest are searched in small leaves."""
    assert len(knn.Tree(np.arange(5_000), np.full((5_000, 14), 7.0), np.zeros(5_000, np.int64), 5).ids) == 6
    r = np.random.default_rng(3)
    tree = knn.Tree(np.arange(5_000), r.integers(0, 9, (5_000, 14)).astype(float), np.zeros(5_000, np.int64), 5)
    assert len(tree.ids) == 5_000 and (tree.ends - tree.begins).max() <= knn.LEAF_ROWS
    rows = [([500] * 14, k % 3 == 0) for k in range(900)] + random_rows(300, 31, [400, 500, 600, 9000])
    x = vectors(spark, rows).withColumn("query_id", F.col("ref_id"))
    got = {s: sorted(knn.knn(x, x, leave_out=True, strategy=s, block_rows=50).collect()) for s in ("broadcast", "blocks")}
    assert got["blocks"] == got["broadcast"] and len(got["blocks"]) == 6_000


def test_box_bounds_in_matrices(spark, monkeypatch):
    """bounds of all vectors to all other keys' boxes, over several matrices."""
    monkeypatch.setattr(index, "_PAIRS", 7)
    x = index.with_key(vectors(spark, random_rows(60, 41, [-10000, 0, 2500, 9000, 10000])))
    rows, boxes = x.collect(), {r.pk: r for r in index.bounds(x).collect()}
    want = [(r.ref_id, pk, sum(max(b[f"l{d}"] - r[q], r[q] - b[f"h{d}"], 0) ** 2 for d, q in enumerate(Q))) for r in rows for pk, b in boxes.items() if pk != r.pk]
    got = index.box_bounds(x, index.bounds(x))
    assert got.dtypes == [("ref_id", "bigint"), ("pk", "int"), ("bound", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scorer_beyond_the_broadcast_size(spark, tmp_path, monkeypatch):
    """F7, F8: the same answers by references in cells, for batches and streams, what isn't valid among them."""
    refs = vectors(spark, [(VECTORS[0], 0)] * 5 + [(VECTORS[2], 1)] * 5 + random_rows(60, 51, [0, 5000, 10000]))
    rows = requests(spark, [P1, P3, "{broken", None, edit(id="x" * 5000), P2, edit(transaction__installments=-1)])
    sent = Scorer(refs)
    want = sorted(sent.score(rows).collect())
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    scorer = Scorer(refs)
    assert sent.cells is None and scorer.sent is None
    found = scorer.score(rows)
    assert found.columns == sent.score(rows).columns and sorted(found.collect()) == want
    rows.write.json(f"file://{tmp_path}/in")
    score_stream(scorer, f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert sorted(spark.read.parquet(f"file://{tmp_path}/out").select(*found.columns).collect()) == want


def test_boxes_within_a_radius(spark):
    """the own key and what the radius reaches are counted, without a row a pair; a null radius reaches none."""
    x = index.with_key(vectors(spark, random_rows(60, 61, [-10000, 0, 2500, 9000, 10000])))
    asked = x.withColumn("d5", F.when(F.col("ref_id") % 4 > 0, F.col("ref_id") * 9_000_000))
    rows, boxes = asked.collect(), {r.pk: r for r in index.bounds(x).collect()}
    near = lambda r, b: r.d5 is not None and sum(max(b[f"l{d}"] - r[q], r[q] - b[f"h{d}"], 0) ** 2 for d, q in enumerate(Q)) <= r.d5
    want = [(r.ref_id, sum(pk == r.pk or near(r, b) for pk, b in boxes.items())) for r in rows]
    assert sorted(map(tuple, index.boxes_within(asked, index.bounds(x), "d5", ["ref_id"]).collect())) == sorted(want)


def test_votes_of_cells_without_a_join(spark, monkeypatch):
    """votes of the search in cells come from its lists, not from joins of all queries with their neighbours."""
    rows = random_rows(80, 71, [0, 400, 9000]) + [([300] * 14, k % 2) for k in range(40)]
    x = vectors(spark, rows)
    queries = x.withColumnRenamed("ref_id", "query_id").drop("label")
    want = sorted(knn.vote(queries, x, leave_out=True).drop("partitions").collect())
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    found = knn.vote(queries, x, leave_out=True).drop("partitions")
    assert sorted(found.collect()) == want
    one_cell = knn.vote(queries.withColumn("q9", F.lit(0)), x.where("false"), leave_out=True)
    assert {r.fraud_count for r in one_cell.collect()} == {0}
    same = vectors(spark, [([k % 9] * 14, k % 2) for k in range(60)])
    assert "Join" not in knn.vote(same.withColumnRenamed("ref_id", "query_id").drop("label"), same, leave_out=True)._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [3, 10_000, 20_000_000])
def test_tree_of_any_numbers(most):
    """distances and ids in one number where they fit in it, and apart where they don't; ties by id, none beyond the limit."""
    r = np.random.default_rng(5)
    x = r.integers(-most, most + 1, (3_000, 14)).astype(float)
    ids, labels = r.permutation(3_000) * 1_000_003, r.integers(0, 2, 3_000)
    tree = knn.Tree(ids, x, labels, 6)
    q = x[:50] + r.integers(0, 2, (50, 14))
    d = ((q[:, None, :] - x[None]) ** 2).sum(2)
    order = np.lexsort((np.broadcast_to(ids, d.shape), d), 1)[:, :6]
    near = np.take_along_axis(d, order, 1)
    best = tree.search(q)
    assert (best.ids == ids[order]).all() and (best.d == near).all() and (best.labels == labels[order]).all()
    limit = near[:, 2].copy()
    some = tree.search(q, limit)
    assert ((some.d <= limit[:, None]) == (near <= limit[:, None])).all() and (some.ids[:, :3] == ids[order][:, :3]).all()


@pytest.mark.parametrize("block_rows", [30, 5_000])
def test_references_searched_among_themselves(spark, block_rows):
    """references that are their own queries are dealt to cells once; copies are searched once, large cells of copies too."""
    rows = [([500] * 14, k % 3 == 0) for k in range(200)] + random_rows(150, 81, [400, 500, 600, 9000, 10000]) * 2
    x = vectors(spark, rows)
    want = {a: [(n, *t) for n, t in enumerate(d, 1)] for a, d in brute(rows, rows, 5, True).items()}
    for strategy in ("broadcast", "blocks"):
        got = {}
        for r in knn.knn(None, x, leave_out=True, strategy=strategy, block_rows=block_rows, stored=True).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.d2, r.ref_id, r.label))
        assert {a: sorted(v) for a, v in got.items()} == want


@pytest.mark.parametrize("strategy", ["broadcast", "blocks"])
def test_approximate_mode_among_themselves(spark, strategy):
    """of each row, copies too, the five of its own key where they are near enough, else the nearest."""
    rows = [([int(5000 + 9 * x) for x in v], y) for v, y in random_rows(120, 91, range(-99, 99))] * 2 + random_rows(60, 92, list(range(-10000, 10001, 100)))
    x = vectors(spark, rows)
    keys = {r.ref_id: r.pk for r in index.with_key(x).collect()}
    got = {}
    for r in knn.knn(None, x, leave_out=True, strategy=strategy, approximate=True, block_rows=40, stored=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.d2, r.ref_id, r.label))
    for a, d in brute(rows, rows, len(rows), True).items():
        own = [t for t in d if keys[t[1]] == keys[a]][:5]
        want = own if len(own) == 5 and own[4][0] <= C.EARLY_STOP else d[:5]
        assert sorted(got[a]) == [(n, *t) for n, t in enumerate(want, 1)]


def test_stream_of_stored_vectors(spark, monkeypatch):
    """F8: the stream reads the vectors where they have been stored, and references in cells aren't stored again."""
    from txscore.plans import queries as plans

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables here")
    names = []
    path = plans.shared_path
    monkeypatch.setattr(plans, "shared_path", lambda s, name: names.append(name) or path(s, name))
    monkeypatch.setattr(C, "BROADCAST_BYTES", 0)
    made = []
    monkeypatch.setattr(knn, "shared_path", lambda s, name: made.append(path(s, name)) or made[-1])
    assert plans.QUERIES["stream_score"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert sorted(names) == ["stream-out", "stream-state", "vectors"]
    cells = [p.removeprefix("file://") for p in made if "/cells-" in p]
    assert len(cells) == 1 and os.listdir(cells[0]) == ["cells"]
