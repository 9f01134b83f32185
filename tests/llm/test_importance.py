from __future__ import annotations

import numpy as np
import pyarrow as pa

from attestry.llm import importance as im
from attestry.llm.batches import utf8


def test_features_are_sets_of_words_pairs_and_runs():
    data, off = utf8(pa.array(["a b a b!!", None, "", " \n", "x x x x x x x x x", "x x x x x x x x", "a b"]))
    owner, one, two = im.features(data, off)
    # a b !!, and ab ba b!!; x and the run, xx; x, xx; a b, ab
    assert np.bincount(owner, minlength=7).tolist() == [6, 0, 0, 0, 3, 2, 3]
    words = one < 1 << im.WORD_BITS
    assert set(one[(owner == 6) & words]) <= set(one[(owner == 0) & words]) and len(set(one[(owner == 4) & words])) == 2
    assert one.max() < im.SIZE and two.max() < im.SIZE and (one != two).all()


def test_ratios_need_evidence():
    raw, target = np.zeros(im.SIZE, np.int64), np.zeros(im.SIZE, np.int64)
    raw[:4], target[:4] = [1000, 1000, 8, 1000], [500, 0, 0, 300]
    ratios = im.Model(raw, target, 10_000, 5_000).ratios()
    assert ratios[0] == 0 and ratios[2] == 0 and ratios[3] == 0 and np.isclose(ratios[1], np.log(1 / 501))


def test_kth_largest(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=500), [3.5] * 20, [-1e6, 1e6]]).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 15, 100, len(values)):
        assert im.kth_largest(df, "v", k) == sorted(values)[-k]


def test_counts_like_plain_python(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("a b", True), ("a c", False), (None, True), ("a a", None), ("", True)] * 3)]
    model = im.counted(spark.createDataFrame(rows, "doc_id long, text string, _good boolean").repartition(4))
    _, one, _ = im.features(*utf8(pa.array(["a"])))
    assert (model.n_raw, model.n_target) == (15, 9) and model.raw[one[0]] == 9 and model.target[one[0]] == 3


def test_toxic_and_junk_go_and_clean_ones_stay(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    # Every second label is unseen.
    seen = labels.filter("doc_id % 2 = 0")
    rows = im.resample(docs, seen).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "toxic", "kept").collect()
    kept = lambda q, t: np.mean([r.kept for r in rows if (r.quality, r.toxic) == (q, t)])
    assert kept(1, 0) > 0.98 and kept(0, 0) < 0.1 and kept(1, 1) < 0.4


def test_odd_rows(spark):
    rows = [(1, "good text here", "x"), (1, "good text here", "x"), (2, None, "x"), (None, "", "x"), (3, " \n", "x"), (4, "w " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 0), (2, None, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    out = im.resample(docs, labels).collect()
    assert len(out) == 6 and all(r.kept for r in out) and all(r.log_weight == 0 for r in out)
    assert im.resample(docs.limit(0), labels).count() == 0
    assert all(r.kept for r in im.resample(docs, labels.limit(0)).collect())
