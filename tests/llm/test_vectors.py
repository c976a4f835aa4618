import math

import numpy as np
import pytest

from tellurion.llm import hilbert, mtree

SHAPE = "vec_id long, embedding array<float>, label int"


LIMIT = 2**63 - 1


def brute(rows, scale=None, top=20, zero=True):
    good = {i: v for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}
    held = lambda x: max(-LIMIT, min(LIMIT, x))
    if scale:
        x = {i: np.array([held(math.floor(scale * c)) for c in v], dtype=object) for i, v in good.items()}
        score = lambda a, b: held(int(a @ b)) if len(a) else 0
    else:
        x, score = {i: np.array(v, dtype=float) for i, v in good.items()}, lambda a, b: float(a @ b)
    out = {}
    for q in x:
        if q % 20 == 0:
            s = sorted((-score(x[q], x[i]), i) for i in x if i != q and len(x[i]) == len(x[q]))
            out[q] = [(i, -v) for v, i in s[:top]]
    return {q: v for q, v in out.items() if v}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(i, rng.normal(size=8).astype(np.float32).tolist(), None) for i in range(600)]
    out += [(600 + i, out[7][1], 1) for i in range(60)] + [(700, None, 1), (720, [], 1), (740, [1.0, None] * 4, 1), (760, [float("nan")] * 8, 1), (780, [0.0] * 8, 1), (None, [1.0] * 8, 1), (800, [1.0, 2.0], 1), (801, [2.0, 1.0], 1)]
    return out + out[:3]


def found(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize("tree", [100, 4096])
def test_mtree_is_exact(spark, rows, tree):
    got = found(mtree.exact_top(spark.createDataFrame(rows, SHAPE), params=mtree.TreeParams(tree=tree, leaf=8)))
    assert got == brute(rows, 64)


def test_mtree_of_clusters_huge_numbers_and_equal_rows(spark):
    rng = np.random.default_rng(5)
    near = [(i, (rng.normal(size=4) * 0.1 + 10 * (i % 7)).tolist()) for i in range(500)]
    huge = [(1000 + i, (rng.normal(size=3) * 10.0 ** (i % 19)).tolist()) for i in range(120)]
    huge += [(-20, [1e30, -1e30, 0.0]), (-40, [1e300, 1.0, 1.0]), (-41, [-1e300, 0.0, 2.0]), (1200, [1e16, 3.0, 0.015625])]
    same = [(2000 + i, [0.5, -0.5]) for i in range(100)]
    none = [(3000, []), (3001, []), (3020, [])]
    rows = near + huge + same + none
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as score", "3 as vec")
    assert found(mtree.exact_top(d, params=mtree.TreeParams(tree=64, leaf=8))) == brute(rows, 64)


def test_hilbert_recall(spark, rows):
    got = found(hilbert.nearest(spark.createDataFrame(rows, SHAPE), params=hilbert.HilbertParams(block=32)))
    want = brute(rows, zero=False)
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    exact = {i: np.array(v, dtype=float) for i, v, _ in rows if i is not None and v and None not in v}
    assert all(abs(s - exact[q] @ exact[i]) < 1e-9 for q, v in got.items() for i, s in v)


def test_hilbert_recall_with_very_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * (1000 if i % 400 == 3 else 1)).tolist()) for i in range(1200)]
    rows += [(2000 + i, [0.25] * 8) for i in range(200)]
    got = found(hilbert.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), params=hilbert.HilbertParams(block=64)))
    want = brute(rows)
    hit = sum(len({s for _, s in got[q]} & {s for _, s in want[q]}) for q in want)
    assert set(got) == set(want) and hit >= 0.9 * sum(len({s for _, s in v}) for v in want.values())


def test_empty(spark, rows):
    none = spark.createDataFrame([], SHAPE)
    assert mtree.exact_top(none).count() == 0 and hilbert.nearest(none).count() == 0
    few = spark.createDataFrame(rows[:3], SHAPE)
    assert len(found(mtree.exact_top(few))[0]) == 2 == len(found(hilbert.nearest(few))[0])


def test_hilbert_curve_is_a_path():
    bits = 3
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = hilbert.hilbert_keys(cells, bits)
    order = cells[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
