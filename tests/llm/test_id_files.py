from __future__ import annotations

import tempfile
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attestry.llm import id_files

PATH = P.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 5000), st.integers(0, 1 << 62)), max_size=700))
def test_elias_fano(values):
    values = sorted(values)
    bits, raw = id_files.EliasFano.encode(np.array(values, np.uint64))
    back, end = id_files.EliasFano.decode(len(values), bits, b"xx" + raw, 2)
    assert back.all().tolist() == values and end == len(raw) + 2
    assert [back.select(i) for i in range(0, len(values), 7)] == values[::7]


def test_near_minimal_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 50_000))
    _, raw = id_files.EliasFano.encode(ends)
    assert 8 * len(raw) / len(ends) < 2.3 + np.log2(ends[-1] / len(ends))


def test_segment_round_trip():
    ids = [np.array(x, "<u4") for x in ([1, 2], [], [70000], [3] * 5)]
    one = id_files.Segment(id_files.segment([None, -5, 7, 7], ids))
    assert one.doc_ids() == [None, -5, 7, 7]
    assert [one.document(i).tolist() for i in range(4)] == [x.tolist() for x in ids]


def test_files_and_rows(spark):
    texts = [None, "", "Hello  World\n\n", "it's é\x1c東京", "a" * 5000, "dup", "dup", " the house\tof\x00 x", "the cat sat.\nOn it"] * 9
    rows = [(900 - 3 * i, t, "q") for i, t in enumerate(texts)] + [(None, "n", "q"), (0, "zero", "q"), (-4, "minus", "q"), (0, "zero", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, data string").repartition(5)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/files"
    id_files.write(docs, folder, PATH, partitions=4)
    got = [tuple(r) for r in id_files.digests(id_files.read(spark, folder)).orderBy("start").collect()]
    want, start = [], 0
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/files"
    id_files.write(spark.createDataFrame([], "doc_id long, text string"), folder, PATH, partitions=2)
    assert id_files.read(spark, folder).count() == 0
