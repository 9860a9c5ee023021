"""Tiles of operators 7 and 10 move codes and signatures, full data only for rows with a possible partner."""

import numpy as np
from pyspark.sql import functions as F

from matstream.llm import neardup, vecdup


def templates(n, common=100, own=3, seed=1):
    """Documents of one template: alike, but none similar enough to another."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(common)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.choice(common // 5, own, replace=False) * 5 + 2:
            words[at] = f"d{k}x{at}"
        out.append(" ".join(words))
    return out


def brute_force(texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    return comp


def dealt(spark, texts):
    """All texts as pivots and members of one tile."""
    rows = [(1, 0, 0, i, i, p) for i in range(len(texts)) for p in (False, True)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return spark.createDataFrame(rows, neardup._DEALT), docs


def test_templates_move_no_text(spark):
    texts = templates(120, common=800, own=24)
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 0.5 < np.mean(alike) < 0.6 and max(alike) < 0.75
    tile, docs = dealt(spark, texts)
    assert neardup.possible_rows(tile, docs).select("id").distinct().count() <= 12


def test_possible_rows_hold_every_link(spark):
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:k] + [f"x{k}"] + base[k + 1:]) for k in range(40)] + templates(20, seed=5) + ["", "a b"]
    comp = brute_force(texts)
    tile, docs = dealt(spark, texts)
    kept = {r.id for r in neardup.possible_rows(tile, docs).select("id").distinct().collect()}
    assert {i for i in range(len(texts)) if comp.count(comp[i]) > 1} <= kept
    assert neardup.possible_rows(tile.limit(0), docs).count() == 0


def test_near_duplicates_among_templates(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    texts = templates(60, seed=3)
    texts += [t.replace("w99", "other") for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert got == dict(enumerate(brute_force(texts)))


def test_wide_signatures_agree_like_sets():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(40):
        x = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        h, doc = np.concatenate([x[:175], x[25:]]), np.repeat([0, 1], 175)  # 150 common of 200
        sketch = neardup.fast_similarity_sketch(h, doc, 2, neardup.WIDE)
        assert (sketch != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        sig = neardup.signatures(sketch).view(np.uint64)
        agree.append(neardup._agreements(sig[:1], sig[1])[0])
    assert min(agree) >= neardup.MIN_WIDE
    assert abs(np.mean(agree) / neardup.WIDE - (0.75 + 0.25 / 16)) < 0.02


def test_equal_vectors_are_one_entry(spark, monkeypatch):
    """A third of all rows are one vector: counted, not compared."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    near = base + rng.normal(scale=0.02, size=16)
    vectors = [base.tolist()] * 50 + [near.tolist()] * 20 + [(-base).tolist()] + rng.normal(size=(60, 16)).tolist()
    data = [(i, v, "en") for i, v in enumerate(vectors)] + [(500, base.tolist(), "fr"), (501, base.tolist(), None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")
    dealt_rows = []
    real = vecdup.materialise
    monkeypatch.setattr(vecdup, "materialise", lambda d, name, *a: (
        lambda out: (dealt_rows.append((name, out.count())), out)[1])(real(d, name, *a)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vecdup.similar_vectors(df).collect()}
    counts = dict(dealt_rows)
    assert counts["vd-entry"] == 64 and counts["vd-possible"] == 2
    m = np.array(vectors)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    linked = unit @ unit.T >= 0.98
    assert [got[i][0] for i in range(len(m))] == (linked.sum(axis=1) - 1).tolist()
    assert all(got[i][1] == int(np.flatnonzero(linked[i])[0]) for i in range(len(m)))
    assert got[500] == (0, 500) and got[501] == (0, 501)


def test_tiles_carry_no_double_vector(spark):
    """The first tiles are dealt from codes; only vectors with a possible partner are fetched."""
    eye = [(i, np.eye(40)[i].tolist(), "en") for i in range(40)]
    df = spark.createDataFrame(eye, "vec_id long, embedding array<double>, label string")
    assert df.withColumn("more", F.lit(1)).count() == 40
    got = vecdup.similar_vectors(df.withColumn("row", F.lit("clash"))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(i, 0, i, True) for i in range(40)]


def test_a_batch_is_sketched_in_little_memory():
    import os
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from matstream.llm import neardup as nd
rng = np.random.default_rng(1)
vocab = np.array([f'word{i}' for i in range(5000)])
text = [' '.join(vocab[rng.integers(0, 5000, 250)]) for _ in range(8000)]
ids = pa.array(range(8000), pa.int64())
batch = pa.RecordBatch.from_arrays([ids, pa.array(text), ids], names=['doc_id', 'text', 'text_key'])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(b.num_rows for b in nd._sketch_batches(iter([batch]))) == 8000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    got = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert int(got.stdout) < 70, got.stdout + got.stderr   # MB; 2 MB chunks took 110
