import json

import pytest
from pyspark.sql import functions as F

from tessera.operators.contracts import ContractError
from tessera.sources import files, http, nested
from tessera.streaming import resume as R


def test_tables_round(spark, tmp_path):
    root = f"file://{tmp_path}"
    d = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", [])], "id int, n string, l array<int>")
    files.write_table(d, f"{root}/t", csv_twin=True)
    assert files.read_keyed_parquet(spark, f"{root}/t.parquet", "id").count() == 2
    assert files.first_available(spark, [f"{root}/none", root], "t").count() == 2
    assert sorted(r.n for r in files.read_csv(spark, f"{root}/t.csv").collect()) == ["a", "b"]
    assert files.read_or_empty(spark, f"{root}/gone", "id int").count() == 0
    with pytest.raises(FileNotFoundError):
        files.first_available(spark, [root], "gone")
    files.write_table(d.unionAll(d), f"{root}/twice")
    with pytest.raises(ContractError):
        files.read_keyed_parquet(spark, f"{root}/twice.parquet", "id")
    files.write_lines(d, f"{root}/lines", "n", "id")
    assert [r.value for r in spark.read.text(f"{root}/lines").collect()] == ["a", "b"]
    files.write_json(d, f"{root}/j")
    assert spark.read.json(f"{root}/j").count() == 2


def test_json_documents(spark, tmp_path):
    doc = {"metadata": {"audio_properties": {"length": 12.5}}, "highlevel": {"mood_sad": {"value": "sad", "all": {"sad": 0.9}}}}
    (tmp_path / "r 1.json").write_text(json.dumps(doc))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "all.json").write_text('[{"a": 1}, {"a": 2}]')
    root = f"file://{tmp_path}"
    assert files.read_json_records(spark, f"{root}/list/all.json").count() == 2
    e = spark.createDataFrame([("r 1",), ("bad",), ("gone",)], "k string")
    d = files.read_json_by_key(spark, root, e, "k")
    low = {r.k: r for r in nested.fields(d, "document", nested.LOW_LEVEL, ["k"]).collect()}
    assert low["r 1"].ab_duration_seconds == 12.5 and low["r 1"].available and not low["gone"].available and low["bad"].ab_bpm is None
    high = {r.k: r for r in nested.high_level(d, "document", ["k"]).collect()}
    assert high["r 1"].ab_mood_sad == "sad" and high["r 1"].ab_mood_sad_probability == 0.9
    assert len(nested.LOW_LEVEL) == 30 and len(nested.LABELS) + len(nested.PROBABILITIES) == 25
    found = files.discover(spark, root, ["JSON"])
    assert found.count() == 3
    assert [r.name for r in files.missing_files(found, ["bad.json", "must.json"]).collect()] == ["must.json"]


def test_flatten_media(spark):
    rows = [json.dumps({"release": {"id": "r", "title": "R", "media": [{"position": 1, "tracks": [{"id": "t1", "title": "A", "isrcs": ["x", "y"]}, {"id": "t2", "title": "B", "isrcs": []}]}]}})]
    d = spark.read.json(spark.sparkContext.parallelize(rows))
    got = [tuple(r) for r in http.flatten_media(d).orderBy("track_position").collect()]
    assert got == [("r", "R", 1, 1, "t1", "A", "x,y"), ("r", "R", 1, 2, "t2", "B", "")]


def test_lookup_statuses():
    waits, calls = [], []

    def fetch(url):
        calls.append(url)
        return {"ok": (200, '{"a": 1}'), "gone": (404, ""), "broken": (200, "{"), "denied": (403, ""), "busy": (503, "")}[url]

    assert http.lookup("ok", fetch) == ("found", '{"a": 1}')
    assert http.lookup("gone", fetch)[0] == "not_found" and http.lookup("broken", fetch)[0] == "invalid_payload" and http.lookup("denied", fetch)[0] == "http_error"
    calls.clear()
    assert http.lookup("busy", fetch, 4, 3, waits.append)[0] == "http_error" and len(calls) == 4 and waits == [1, 2, 3]

    def dead(url):
        raise OSError

    assert http.lookup("x", dead, 2, 1, waits.append)[0] == "request_error"


def test_resume(spark, tmp_path):
    path = f"file://{tmp_path}/status"
    todo = spark.createDataFrame([(i,) for i in range(7)], "id long")
    runs = []

    def work(batch):
        runs.append(batch.count())
        return batch.withColumn("status", F.when(F.col("id") == 3, "request_error").otherwise("found"))

    assert R.resume(spark, todo, path, "id", work, 3).count() == 7 and runs == [3, 3, 1]
    runs.clear()
    R.resume(spark, todo, path, "id", work, 3)
    assert runs == [1]


def test_stream_of_new_files(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.range(3).write.parquet(f"{root}/in")
    work = lambda d: d.withColumn("twice", F.col("id") * 2)
    run = lambda: R.stream_new_files(spark, f"{root}/in", "id long", f"{root}/out", f"{root}/ckpt", work)
    assert run().count() == 3
    spark.range(3, 5).write.mode("append").parquet(f"{root}/in")
    assert run().count() == 5


def test_pages_fail_loudly_and_end_at_a_short_one(spark):
    total = 23

    def fetch(url):
        limit, offset = (int(x.split("=")[1]) for x in url.split("?")[1].split("&"))
        if url.startswith("broken") and offset >= 10:
            return 404, ""
        return 200, json.dumps({"items": [{"n": i} for i in range(offset, min(total, offset + limit))]})

    def rows(url, **options):
        reader = http._PagedReader({"url": url + "?limit={limit}&offset={offset}", "limit": 5, **options}, fetch)
        return [r for p in reader.partitions() for r in reader.read(p)]

    want = [(i, json.dumps({"n": i})) for i in range(total)]
    assert rows("good") == want and rows("good", pages=5) == want and rows("good", pages=9) == want
    for options in ({}, {"pages": 5}):
        with pytest.raises(RuntimeError, match="not_found"):
            rows("broken", **options)


def test_lookup_of_all_keys(spark):
    fetch = lambda url: (200, json.dumps({"u": url})) if url != "x/2" else (404, "")
    got = {r.k: (r.status, r.payload) for r in http.lookup_all(spark.createDataFrame([(1,), (2,), (3,)], "k long"), "k", "x/{key}", fetch, 1000).collect()}
    assert got == {1: ("found", '{"u": "x/1"}'), 2: ("not_found", None), 3: ("found", '{"u": "x/3"}')}


def test_listing_sums(spark):
    d = spark.createDataFrame([("a/b.json", 10), ("a/c.json", 5)], "path string, length long")
    assert tuple(files.manifest_summary(d).first()) == (2, 15) and tuple(files.manifest_summary(d.limit(0)).first()) == (0, 0)
    assert [r.name for r in files.missing_files(d, ["b.json", "z.json"]).collect()] == ["z.json"]
