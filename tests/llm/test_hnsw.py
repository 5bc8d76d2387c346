"""HNSW links against brute force."""

import numpy as np

import pytest

from spanforge.llm.hnsw import Hnsw, build_shards, embedding_links


def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 16))
    near = np.repeat(x[:3], [120, 5, 2], axis=0) + rng.standard_normal((127, 16)) * 0.1
    chain = [x[400] + 0.05 * k * np.linalg.norm(x[400]) * np.eye(16)[k % 2] for k in range(12)]
    return np.concatenate([x, near, chain, x[:4] * 3.0, x[:4]])


def test_index_finds_everything_within_the_threshold():
    x = vectors()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = Hnsw(unit)
    beam, share = index.audit(0.95, 16, 0.99)
    assert share >= 0.99 and not index.scanned
    q, n = (np.concatenate(x) for x in zip(*index.within(unit.astype(np.float32), 0.95, beam)))
    truth = set(map(tuple, np.argwhere(unit @ unit.T >= 0.95).tolist()))
    found = list(zip(q.tolist(), n.tolist()))
    assert len(found) == len(set(found)) and len(truth & set(found)) >= 0.99 * len(truth)


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_graphs(n):
    x = np.random.default_rng(n).standard_normal((n, 4))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = Hnsw(unit)
    beam, _ = index.audit(0.8, 64, 1.0)
    found = {(q, m) for a, b in index.within(unit.astype(np.float32), 0.8, beam) for q, m in zip(a.tolist(), b.tolist())}
    assert found == set(map(tuple, np.argwhere((unit @ unit.T).astype(np.float32) >= 0.8).tolist()))


def test_a_graph_that_does_not_reach_everything_is_scanned():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = Hnsw(unit)
    index.layers = [np.full_like(layer, -1) for layer in index.layers]
    index.audit(0.95, 64, 0.99)
    found = np.concatenate([q for q, _ in index.within(unit.astype(np.float32), 0.95, 64)])
    assert index.scanned and set(found.tolist()) == set(range(300))


def test_links(spark):
    x = vectors()
    rows = [(int(i), v.tolist()) for i, v in zip(np.random.default_rng(1).permutation(len(x)) + 10, x)]
    odd = [(1, None), (2, [0.0] * 16), (3, [1.0, None] + [0.0] * 14), (4, [float("nan")] * 16), (5, [float("inf")] + [1.0] * 15), (6, []), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (None, x[0].tolist())]
    odd.append((rows[0][0], rows[0][1]))
    df = spark.createDataFrame([(i, v, "l", 0) for i, v in rows + odd], "vec_id bigint, embedding array<double>, n_links string, kept int")
    got = embedding_links(df, shard_rows=200).collect()
    assert len(got) == len(rows) + len(odd)
    everything = rows + [odd[-1]]
    ids, m = np.array([i for i, _ in everything]), np.array([v for _, v in everything])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.95
    np.fill_diagonal(linked, False)
    label = ids.copy()
    while True:
        new = np.array([min(label[i], *label[linked[i]], 10**9) for i in range(len(ids))])
        if (new == label).all():
            break
        label = new
    want = {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(1), label)}
    want |= {7: (1, 7), 8: (1, 7), **{i: (0, i) for i in range(1, 7)}, None: (0, None)}
    wrong = [r for r in got if (r.n_links, r.component_id) != want[r.vec_id]]
    assert not wrong and all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embedding_links(df.limit(0)).collect() == []


def test_large_groups_through_the_graphs(spark):
    """10,000 vectors with a group of 2,000 near copies, 40 of 40 and many pairs: links against brute force, all by graphs."""
    rng = np.random.default_rng(9)
    dim = 32
    far = rng.standard_normal((5_400, dim))
    group = rng.standard_normal((1, dim)) + 0.15 * rng.standard_normal((2_000, dim))
    small = np.repeat(rng.standard_normal((40, dim)), 40, axis=0) + 0.15 * rng.standard_normal((1_600, dim))
    pairs = far[:1_000] + 0.2 * rng.standard_normal((1_000, dim))
    x = np.concatenate([far, group, small, pairs]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(rows).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    n = linked.sum(1)
    assert n.max() > 1_000 and abs(sum(v for v, _ in got.values()) - n.sum()) <= 0.01 * n.sum()
    assert sum(got[i][0] != n[i] for i in range(len(x))) <= 0.01 * len(x)
    ends = {(got[i][1], got[j][1]) for i, j in np.argwhere(linked[:, :]).tolist()[::7]}
    assert sum(a != b for a, b in ends) <= 1
    nodes = rows.selectExpr("cast(vec_id as string) as node", "1L as copies", "cast(embedding as array<double>) as vector", f"{dim} as dim")
    audits = build_shards(nodes).where("seq < 0").collect()
    assert len(audits) == 4 and not any(a.scanned for a in audits) and min(a.recall for a in audits) >= 0.99


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1.0, 1.0]), (4, [5e-324, 0.0]), (5, [1e308, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}
