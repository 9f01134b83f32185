"""Each stage of the corpus pipeline against a brute-force version, on one small table."""

from __future__ import annotations

import random
import re
import tempfile
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from test_jaccard import brute as brute_components
from test_quality_rules import brute as brute_rules
from tokenizers import Tokenizer

import corpus_pipeline
from attestry.llm import importance, jaccard

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and the result of every stage, as written tables."""
    rng = random.Random(3)
    rows = spark.read.parquet(f"{D}/documents.parquet").collect()
    passage = rows[7].text[:1000]
    extra = []
    for k, r in enumerate(rows[:25]):
        words = r.text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        extra.append((1000 + k, " ".join(words), r.lang, "copy", 1))
        extra.append((2000 + k, rows[150 - k].text + "\n" + passage, "en", "passage", 1))
    extra += [(3000, None, None, None, None), (3001, "", "en", "x", 0), (None, rows[30].text + " null id", "en", "x", 1), (31, rows[31].text, "en", "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([tuple(r) for r in rows] + extra, schema).repartition(3).write.parquet(f"{folder}/0")
    out = [spark.read.parquet(f"{folder}/0")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, out[-1], D).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def test_names_and_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near duplicates", "repeated strings", "packing"]
    for df in stages[1:-1]:
        assert tuple(df.columns) == corpus_pipeline.COLUMNS


def test_rules(stages):
    assert rows_of(stages[1]) == [r for r in rows_of(stages[0]) if brute_rules(r[1])[-1]]


def test_classifier(spark, stages):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    verdicts = importance.resample(stages[1], labels)
    kept = sorted((r.doc_id for r in verdicts.filter("kept").collect()), key=str)
    assert sorted((r[0] for r in rows_of(stages[2])), key=str) == kept and set(rows_of(stages[2])) <= set(rows_of(stages[1]))
    good = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    before, after = ({r[0] for r in rows_of(s)} & good for s in stages[1:3])
    assert len(after) >= 0.97 * len(before)


def test_near_duplicates(stages):
    rows = rows_of(stages[2])
    components = {c for i, n, c in brute_components([(i, r[1]) for i, r in enumerate(rows)], jaccard.Similar()) if n}
    left = rows_of(stages[3])
    assert len(left) == len(components) < len(rows) and set(left) <= set(rows)


def test_repeats(stages):
    before, after = rows_of(stages[3]), {r[0]: r for r in rows_of(stages[4])}
    texts = [r[1] for r in before]
    grams = Counter()
    for t in texts:
        raw = (t or "").encode()
        grams.update(raw[i : i + corpus_pipeline.PASSAGE_BYTES] for i in range(len(raw) - corpus_pipeline.PASSAGE_BYTES + 1))
    removed = 0
    assert len(after) == len(before)
    for r, t in zip(before, texts, strict=True):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for i in range(len(raw) - corpus_pipeline.PASSAGE_BYTES + 1):
            if grams[raw[i : i + corpus_pipeline.PASSAGE_BYTES]] > 1:
                covered[i : i + corpus_pipeline.PASSAGE_BYTES] = b"x" * corpus_pipeline.PASSAGE_BYTES
        words = [m.span() for m in re.finditer(rb"[^ \t-\r]+", raw)]
        for m in re.finditer(b"x+", bytes(covered)):
            if sum(m.start() <= a and b <= m.end() for a, b in words) < corpus_pipeline.PASSAGE_WORDS:
                covered[m.start() : m.end()] = bytes(m.end() - m.start())
        removed += sum(map(bool, covered))
        left = bytes(x for x, gone in zip(raw, covered, strict=True) if not gone).decode("utf-8", "ignore")
        assert (after[r[0]][1] or "") == left and (t is None) == (after[r[0]][1] is None)
        assert t is None or after[r[0]][4] == len(left)
    assert removed


def test_packing(stages):
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in rows_of(stages[4])}
    covered = defaultdict(int)
    fills = defaultdict(int)
    for r in stages[5].collect():
        covered[r.doc_id] += r.length
        fills[r.sequence_id] += r.length
    assert dict(covered) == {k: len(plain.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in fills.values())


def test_run_is_all_stages(spark):
    from __spark_entry__ import queries

    assert queries()["pipeline"](spark, D).count() > 0
