"""Jobs without a SQL twin: marker windows, manifests and readers, folds and scoring."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import learning as ML
from attestry.operators import aggregate, linkage, metrics, rules
from attestry.session import cut_lineage
from attestry.sources import readers, sinks


def windows(text, markers, before, after, size):
    text = " ".join(text.replace("\r\n", "\n").split(" ")).strip()
    if len(text) <= size:
        return text
    kept, chunks = [], []
    for marker in markers:
        at = text.lower().find(marker.lower())
        while at >= 0:
            left, right = max(0, at - before), min(len(text), at + after)
            if all(right < a or left > b for a, b in kept):
                kept.append((left, right))
                chunks.append(text[left:right].strip())
            at = text.lower().find(marker.lower(), at + len(marker))
    return ("\n...\n".join(chunks) or text)[:size].strip()


def test_marker_windows(spark):
    rnd = random.Random(1)
    markers = ["VALID UNTIL", "maker", "NO."]
    texts = [" ".join(rnd.choice(["valid until", "Maker", "no.", "abc", "defgh", "x"]) for _ in range(rnd.randrange(1, 120))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["w"] for r in df.select(rules.marker_windows(F.col("t"), markers, 20, 60, 200).alias("w")).collect()]
    assert got == [windows(t, markers, 20, 60, 200) for t in texts]


def test_file_manifest(spark, tmp_path):
    import hashlib

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"one")
    (tmp_path / "a" / "y.txt").write_bytes(b"two")
    (tmp_path / "z.pdf").write_bytes(b"three")
    got = readers.file_manifest(spark, str(tmp_path), [".pdf"]).collect()
    assert {(r["size"], r["sha256"]) for r in got} == {(3, hashlib.sha256(b"one").hexdigest()), (5, hashlib.sha256(b"three").hexdigest())}


def test_json_readers(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"k": 1}\n\n{broken\n[1]\n"text"\n{"k": 2}\n')
    schema = spark.createDataFrame([], "k bigint").schema
    assert sorted(r["k"] for r in readers.json_lines(spark, str(path), schema).collect()) == [1, 2]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(path), schema, strict=True).collect()


def test_sheet_name_ignores_case_and_blanks(spark, tmp_path):
    spark.createDataFrame([("1", "a")], "x string, y string").write.csv(str(tmp_path / "s"))
    assert readers.sheet(spark, {"Raw Data": str(tmp_path / "s")}, "rawdata ", 2).columns == ["c0", "c1"]
    with pytest.raises(ValueError):
        readers.sheet(spark, {"Raw Data": "x"}, "other", 2)


def test_manifest_needs_its_columns(spark):
    df = spark.createDataFrame([("a", "READY"), ("a", "READY"), ("b", "READY"), ("c", "NO")], "sha string, status string")
    with pytest.raises(ValueError):
        readers.checked_manifest(df, ["sha", "text"], "sha", "status", "READY")
    assert [r["sha"] for r in readers.checked_manifest(df, ["sha"], "sha", "status", "READY").collect()] == ["b"]


def test_duplicate_keys_are_named(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError, match="'k': 1"):
        aggregate.assert_unique(df, ["k"])
    assert aggregate.assert_unique(df.distinct(), ["k"]).count() == 2


def test_log_is_append_only(spark, tmp_path):
    one = spark.createDataFrame([(1, "a")], "id int, what string")
    sinks.append_log(one, str(tmp_path / "log"))
    sinks.append_log(one.withColumn("id", F.lit(2)), str(tmp_path / "log"))
    assert spark.read.schema(one.schema).json(str(tmp_path / "log")).count() == 2


def test_cut_lineage_keeps_rows_and_types(spark):
    df = spark.range(10).select("id", F.array(F.col("id")).alias("a"), F.struct("id").alias("s"))
    cut = cut_lineage(df)
    assert cut.dtypes == df.dtypes and cut.count() == 10 and "Scan" in cut._jdf.queryExecution().executedPlan().toString()


def test_folds(spark):
    df = spark.range(300).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, F.lit("a")).otherwise(F.lit("b")).alias("c"), (F.col("id") % 17).alias("g"))
    even = ML.stratified_folds(df, "c", "i", 5).groupBy("c", "fold").count().collect()
    assert {(r["c"], r["count"]) for r in even} == {("a", 20), ("b", 40)}
    assert ML.group_folds(df, "g", 4).groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_balanced_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    sums = {r["label"]: r["w"] for r in ML.balanced(df, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    assert sums["a"] == pytest.approx(sums["b"]) == pytest.approx(4.0)


def test_weights_and_vectors_move_no_rows(spark):
    df = spark.createDataFrame([("a", ["x"])] * 6 + [("b", ["y"])] * 2 + [(None, ["z"])], "label string, grams array<string>").repartition(3 * spark.sparkContext.defaultParallelism)
    plan = ML.balanced(df, "label")._jdf.queryExecution().sparkPlan().toString().split("Subquery")[0]
    assert "Join" not in plan and ML.balanced(df, "label").count() == 8
    files = ML.hashed(df, features=16).inputFiles()
    assert len(files) > 1 and ML.hashed(df.coalesce(1), features=16).count() == 9
    assert len(ML.hashed(spark.range(0, 1000, 1, 40).withColumn("grams", F.array(F.lit("x"))), features=16).inputFiles()) == 40


def test_classifier_learns_and_flags_doubt(spark):
    rows = [(i, "en" if i % 2 else "de", ("the house and the sea " if i % 2 else "das haus und die see ") * 3 + str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, lang string, text string")
    frame, model = ML.index_labels(ML.hashed(df.select("doc_id", "lang", ML.word_grams(F.col("text")).alias("grams")), features=1 << 10), "lang")
    ready = ML.stratified_folds(ML.balanced(frame, "label"), "label", "doc_id", 2)
    scored = ML.out_of_fold(ready, ML.class_pipeline(5), 2)
    per = metrics.overall_metrics(metrics.class_metrics(scored, "label", "prediction")).first()
    assert scored.count() == 60 and per["accuracy"] == 1.0
    chosen = ML.class_choice(scored.select("doc_id", "lang", "raw"), model.labels, 1e9)
    assert chosen.filter("predicted = lang and needs_review").count() == 60


def test_word_grams(spark):
    got = spark.range(1).select(ML.word_grams(F.lit("Ab cde"), 3, 4).alias("g")).first()["g"]
    assert got == [" ab", "ab ", " ab ", " cd", "cde", "de ", " cde", "cde "]


def test_late_mail_and_late_rows_are_kept(spark, tmp_path):
    from attestry.streaming import feeds

    out = str(tmp_path / "inbox")
    write = feeds.inbox_batches(out, "uid", F.col("bounced"), F.lit("exact"), "names")
    schema = "uid string, ts timestamp_ntz, bounced boolean, names array<string>"
    rows = lambda *items: spark.createDataFrame([(u, None, b, ["a.pdf", "b.pdf"]) for u, b in items], schema)
    write(rows(("u1", False), ("u1", False), ("u2", True)), 0)
    write(rows(("u1", False), ("u3", False)), 1)
    write(rows(("u1", False), ("u3", False), ("u4", False)), 1)  # a replay replaces its batch
    got = spark.read.parquet(f"{out}/rows").select("uid", "saved_name").collect()
    assert sorted(map(tuple, got)) == sorted((u, f"{u}__00{k}__{n}") for u in ("u1", "u3", "u4") for k, n in ((1, "a.pdf"), (2, "b.pdf")))

    counts = str(tmp_path / "counts")
    add = feeds.count_batches(counts, "ts", "1 hour", "kind")
    for batch, hours in enumerate(([1, 1, 5], [1, 900], [1])):
        add(spark.createDataFrame([(h, "k") for h in hours], "h int, kind string").select(F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "kind"), batch)
    assert sorted(r["n"] for r in feeds.summed_counts(spark, counts, "kind").collect()) == [1, 1, 4]


def test_all_parts_of_a_long_document(spark):
    from attestry.operators import reshape

    pages = spark.range(1200).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.concat(F.lit("page text "), F.col("id").cast("string")).alias("text"))
    parts = reshape.join_pages(pages, "doc", "page", "text").orderBy("part").collect()
    assert [p["part"] for p in parts] == [0, 1, 2]
    assert "\n".join(p["text"] for p in parts) == "\n".join(f"[PAGE {k + 1}]\npage text {k}" for k in range(1200))


def test_items_are_numbered_and_rules_can_be_off(spark):
    from attestry.operators import extract, mailing

    items = spark.range(501).select(F.lit("s").alias("supplier"), F.col("id").alias("o"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"))
    blocks = mailing.item_blocks(items, ["supplier"], "o", "path", {}, bucket=50)
    assert sorted((r["item_no"], r["block"]) for r in blocks.collect()) == [(k + 1, f"{k + 1}. p{k}") for k in range(501)]
    docs = spark.createDataFrame([("Valid until 2027-03-04 then 2028-01-01", "A", "old")], "text string, issuer string, expiry string")
    rule = {"rule_kind": "date_anchor", "target_org": "A", "target_field": "expiry", "anchors": ["VALID UNTIL"]}
    value = lambda **more: extract.apply_overrides(docs, "text", "issuer", [{**rule, **more}]).head()["expiry"]
    assert (value(), value(enabled=False), value(stop_before=["2027"])) == ("2027-03-04", "old", "old")


def test_contained_keys_do_not_depend_on_their_number(spark):
    texts = spark.createDataFrame([(1, "abc key00001 x"), (1, "again key00001"), (2, "key00499 and key00002")], "id int, t string")
    small = spark.range(5).select(F.format_string("key%05d", "id").alias("k"))
    few = linkage.contains_join(texts, "id", "t", small, "k")
    many = linkage.contains_join(texts, "id", "t", spark.range(600).select(F.format_string("key%05d", "id").alias("k")), "k")
    assert sorted(map(tuple, few.collect())) == [(1, "key00001"), (2, "key00002")]
    assert sorted(map(tuple, many.collect())) == [(1, "key00001"), (2, "key00002"), (2, "key00499")]


def test_html_entities(spark):
    import html

    from attestry.functions import text as X

    samples = [
        "a &amp; b", "&#252;&#xFC;&eacute;&uuml;", "&amp;lt; once", "&nbsp;x&nbsp;", "&unknown; &", "&#128512;&#150;&#0;", "no entity", "&lt;p&gt; &quot;q&quot; &#39;", "&copy;&frac12;&hellip;&NotEqualTilde;", "",
    ]
    df = spark.createDataFrame([(k, s) for k, s in enumerate([*samples, None])], "k int, s string")
    got = [r[0] for r in df.orderBy("k").select(X.unescape_html(F.col("s"))).collect()]
    assert got == [*map(html.unescape, samples), None]


def test_weighted_text_takes_every_turn_whole(spark, tmp_path):
    from hashlib import md5

    from __spark_entry__ import queries

    turns = [(1, t, f"turn {t}  " + "x" * (9000 if t == 0 else 900)) for t in range(8)] + [(2, 0, None), (2, 1, " \n"), (3, 1, "late"), (3, 0, "first")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = dict(queries()["prj_23_weighted_text"](spark, str(tmp_path)).collect())
    pages = [" ".join(text.split()) for _, _, text in turns[:8]]
    want = {1: " ".join([pages[0]] * 3 + pages[1:]), 2: "", 3: "first first first late"}
    assert got == {k: md5(v.encode()).hexdigest() for k, v in want.items()}


def test_token_arrays_are_made_once(spark):
    from attestry.functions import text as X

    df = spark.createDataFrame([("The Sun Co., Ltd.", "Sun Korea Inc"), ("Ltd.", "Sun")], "a string, b string")
    out = df.select(X.token_set_score(X.company_tokens(F.col("a")), X.company_tokens(F.col("b"))).alias("s"))
    assert [r["s"] for r in out.collect()] == [1.0, 0.0]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("COMPANY|CORP|") == 2


def test_keywords_of_a_material_are_distinct_in_its_row(spark):
    from attestry.operators import reshape

    rows = spark.createDataFrame([(1, "S", [("AB", "x"), ("ab", "Yz"), ("Cd", "-")])], "k int, supplier string, levels array<struct<name:string,org:string>>")
    out = reshape.weighted_keywords(rows, "k", {"name": 16, "org": 8, "supplier": 6})
    assert sorted(tuple(r) for r in out.collect()) == [(1, "name", "ab", 16), (1, "name", "cd", 16), (1, "org", "yz", 8)]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_kept_in_small_row_groups(spark, monkeypatch):
    """A task reads and keeps a row group as a whole, so a task's vectors must not be one."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(ML, "GROUP_BYTES", 1 << 16, raising=False)
    grams = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.xxhash64("id", k).cast("string"))
    made = ML.hashed(spark.range(0, 2000, 1, 1).withColumn("grams", grams), features=1 << 14)
    groups = [pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in made.inputFiles()]
    assert made.count() == 2000 and len(groups) == 1 and groups[0] >= 4
