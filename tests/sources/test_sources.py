import io
import json
from urllib.error import HTTPError

import pytest
from pyspark.sql import functions as F

from quillstone.sources import files, rest, sinks


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n{"id": "2", "n": 3}\n')
    (tmp_path / "bad.jsonl").write_text('{"id": "1", "n": 2}\nnot json\n')
    assert files.jsonl(spark, f"{tmp_path}/a.jsonl", "id string, n int").count() == 2
    assert files.jsonl(spark, f"{tmp_path}/none.jsonl", "id string", missing_ok=True).collect() == []
    good, bad = files.tolerant_jsonl(spark, f"{tmp_path}/bad.jsonl", "id string, n int")
    assert [tuple(r) for r in good.collect()] == [("1", 2)] and [r.value for r in bad.collect()] == ["not json"]
    both = files.partitions(spark, {"train": f"{tmp_path}/a.jsonl", "test": f"{tmp_path}/none.jsonl"}, "id string, n int")
    assert [(r.split, r.position) for r in both.orderBy("position").collect()] == [("train", 1), ("train", 2)]


def test_texts(spark, tmp_path):
    (tmp_path / "s.txt").write_text("[3.1] Ett.\nskräp\n[3.2] Två.\n")
    assert [tuple(r) for r in files.numbered_sentences(spark, f"{tmp_path}/s.txt").orderBy("n").collect()] == [(3, 1, "Ett."), (3, 2, "Två.")]
    part = files.own_part(F.lit("x\nHD\negna ord\nSLUT\ny"), "HD", "SLUT")
    assert spark.range(1).select(part.alias("x")).first().x == "egna ord"
    blocks = spark.createDataFrame([(1, " "), (2, "a"), (3, "x" * 250_001)], "doc_id long, text string")
    assert {r.doc_id: r.problem for r in files.input_problems(blocks).collect()} == {1: "empty", 3: "too_long"}


def test_integrity(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"abc")
    manifest = spark.createDataFrame([("m.bin", 3, "0" * 64), ("gone", 1, "x")], "name string, bytes long, sha256 string")
    assert {r.name: r.problem for r in files.integrity(spark, f"{tmp_path}/*.bin", manifest).collect()} == {"m.bin": "digest", "gone": "missing"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"v{i}", "a" if i % 2 else "b") for i in range(10)], "id int, v string, split string")
    sinks.append_new(rows.where("id < 6"), f"{tmp_path}/t", ["id"])
    sinks.append_new(rows, f"{tmp_path}/t", ["id"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 10
    sinks.rewrite(spark.read.parquet(f"{tmp_path}/t").where("id < 3"), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3
    sinks.split_jsonl(rows, f"{tmp_path}/p")
    assert (tmp_path / "p" / "split=a").is_dir()
    sinks.with_rejects(rows, F.when(F.col("id") > 7, "big"), f"{tmp_path}/g", f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    assert json.loads(sinks.summary(rows, ["split"]).first().summary)["split"] == '{"a":5,"b":5}'
    assert {r.part for r in sinks.with_parts(rows, ["split"], ["id"], 60).collect()} == {0, 1, 2}
    sinks.ordered_jsonl(rows, f"{tmp_path}/o", ["id"])
    lines = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*"))).splitlines()
    assert [json.loads(x)["id"] for x in lines] == list(range(10))


def test_rest_retries():
    calls, waits = [], []

    class Answer(io.BytesIO):
        def __enter__(self):
            return self

    def open_(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise HTTPError(url, 503, "busy", {"retry-after": "2"} if len(calls) == 1 else {}, None)
        return Answer(b"ok")

    assert rest.fetch("u", wait=waits.append, open_=open_) == "ok" and waits == [2.0, 1.0]

    def broken(url, timeout):
        raise HTTPError(url, 404, "none", {}, None)

    with pytest.raises(HTTPError):
        rest.fetch("u", open_=broken)
