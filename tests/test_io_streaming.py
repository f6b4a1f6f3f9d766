"""Sources, sinks and the streaming form of the cleaning steps."""

import json
import os
import pathlib
import tempfile

from pyspark.sql import functions as F

from veerline.sources import io
from veerline.streaming import text_stream


def test_timeline_csv_file_order(spark):
    d = tempfile.mkdtemp(prefix="veerline-test-")
    for name, n in (("alice", 50), ("bob", 30)):
        with open(os.path.join(d, f"{name}.csv"), "w", encoding="utf-8") as f:
            f.write("Handle,Content,Likes,Retweets,flag\n")
            for i in range(n):
                f.write(f'@{name},"line {i}\nwith ""quote"", comma",{i}.5K,{i},{int(i == 7)}\n')
    df = io.read_timelines(spark, d, "Handle string, Content string, Likes string, Retweets string, flag int")
    rows = df.orderBy("account", "pos").collect()
    assert [r["account"] for r in rows].count("alice") == 50
    alice = [r for r in rows if r["account"] == "alice"]
    assert [int(r["Retweets"]) for r in alice] == list(range(50))
    assert alice[3]["Content"] == 'line 3\nwith "quote", comma'


def test_feature_json_array(spark):
    d = tempfile.mkdtemp(prefix="veerline-test-")
    recs = [{"account_name": "a", "label": 1, "posts_tokenized": [[2, 5, 3]], "flag_posts_tokenized": None},
            {"account_name": "b", "label": 3, "posts_tokenized": [[2, 3]], "flag_posts_tokenized": [[2, 9, 3]]}]
    with open(os.path.join(d, "f.json"), "w") as f:
        json.dump(recs, f, indent=4)
    schema = "account_name string, label int, posts_tokenized array<array<bigint>>, flag_posts_tokenized array<array<bigint>>"
    df = io.read_feature_json(spark, d, schema, multiline=True)
    got = {r["account_name"]: (r["label"], r["p"]) for r in df.select("*", F.get("posts_tokenized", 0).alias("p")).collect()}
    assert got == {"a": (1, [2, 5, 3]), "b": (3, [2, 3])}


def test_streaming_cleaning(spark):
    src = tempfile.mkdtemp(prefix="veerline-test-")
    spark.createDataFrame([(1, "RT @x hi &amp; https://t.co/z", "1.2K"), (2, "sale now", "3")],
                          "id int, text string, likes string").write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema("id int, text string, likes string").parquet(src + "/in")
    cleaned = text_stream.clean_posts(stream, "text", promotions=["sale"], count_cols=["likes"])
    q = cleaned.writeStream.format("memory").queryName("cleaned_posts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from cleaned_posts").collect()
    assert [(r["id"], r["text"], r["likes"]) for r in rows] == [(1, "hi &", 1200)]


def test_streaming_file_to_file(spark):
    base = tempfile.mkdtemp(prefix="veerline-test-")
    spark.createDataFrame([(1, "#tag hello 👍🏽", "2K"), (2, "coupon deal", "5")],
                          "id int, text string, likes string").write.parquet(base + "/in")
    q = text_stream.start_cleaning(spark, base + "/in", "id int, text string, likes string", base + "/out",
                                   name=os.path.basename(base), promotions=["coupon"], count_cols=["likes"])
    q.processAllAvailable()
    q.stop()
    rows = spark.read.parquet(base + "/out").collect()
    assert [(r["id"], r["text"], r["likes"]) for r in rows] == [(1, "hello", 2000)]


def test_streaming_running_counts(spark):
    src = tempfile.mkdtemp(prefix="veerline-test-")
    spark.createDataFrame([(1, "RT hi"), (2, "sale x"), (3, "ok")], "id int, text string").write.parquet(src + "/in")
    stream = text_stream.clean_posts(spark.readStream.schema("id int, text string").parquet(src + "/in"),
                                     "text", promotions=["sale"])
    q = (text_stream.cleaned_counts_by_batch(stream).writeStream.format("memory").queryName("cleaned_counts")
         .outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    row = spark.sql("select * from cleaned_counts").collect()[-1]
    assert (row["n_rows"], row["n_chars"]) == (2, len("hi") + len("ok"))


def test_account_files_equal_sparks_own(spark, tmp_path):
    rows = [("a b", 2, 'x "q", y'), ("a b", 1, "two\nlines"), ("a b", 3, None), ("a b", 4, ""), ("a/b:%", 1, "  trimmed "),
            ("é#", 1, "ä, ö"), (None, 1, "\\ back"), (None, 2, ""), ("", 3, "no name")]
    df = spark.createDataFrame(rows, "account string, turn int, text string")
    ours, theirs = str(tmp_path / "ours"), str(tmp_path / "theirs")
    io.write_timelines(df, ours, "account", "turn")
    io.write_timelines(df, ours, "account", "turn")     # overwrites
    (df.replace("", None, "account").repartition("account").sortWithinPartitions("account", "turn").write.options(**io.CSV_OPTIONS).partitionBy("account").csv(theirs))

    def files(path):
        return {p.parent.name: p.read_text() for p in pathlib.Path(path).glob("*/*.csv")}

    assert files(ours) == files(theirs) and len(files(ours)) == 4
    assert [p.name for p in pathlib.Path(ours).glob("*/*")] == ["part-00000.csv"] * 4     # no checksum file for each account
    read = [sorted(map(tuple, io.read_timelines(spark, p, "turn int, text string", "account").drop("pos").collect()), key=str) for p in (ours, theirs)]
    assert read[0] == read[1] and len(read[0]) == len(rows)


def test_account_file_goes_on_over_batches(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 2).alias("account"), "id")
    with_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        io.write_timelines(df, "file:" + str(tmp_path / "t"), "account", "id")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_batches)
    for k in (0, 1):
        assert (tmp_path / "t" / f"account={k}" / "part-00000.csv").read_text().split() == ["id", *map(str, range(k, 5000, 2))]
