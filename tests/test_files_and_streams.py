"""Readers and writers round trip, streams against their batch forms."""

import json
import wave
from threading import Thread

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import workflow
from parley.sources import readers, snapshots, writers
from parley.sources.views import Views
from parley.streaming import workflow_stream as ws

SF = "/root/testdata/sf0.001"


def test_srt_round_trip_and_odd_files(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿7\r\n00:00:01,5 --> 00:00:02,000\r\none\r\ntwo\r\n\r\n\r\nno time here\r\n\r\n01:00:00.250 --> 01:00:01.000\r\nthree\r\n", encoding="utf-8")
    lines = readers.read_srt(spark, str(tmp_path / "a.srt"))
    got = [tuple(r) for r in lines.orderBy("t0").collect()]
    assert got == [("a", 7, 1005, 2000, "one\ntwo"), ("a", 3, 3600250, 3601000, "three")]
    text = writers.srt_text(lines).first()["value"]
    assert text.startswith("1\n00:00:01,005 --> 00:00:02,000\none\ntwo\n\n2\n")
    (tmp_path / "b.srt").write_text(text)
    assert [tuple(r)[2:] for r in readers.read_srt(spark, str(tmp_path / "b.srt")).orderBy("t0").collect()] == [x[2:] for x in got]


def test_rttm_round_trip(spark, tmp_path):
    segs = spark.createDataFrame([("v", 0, 1000, 4200, "SPK_00"), ("v", 1, 50, 40, "SPK_01")], "video_id string, seg_ord long, t0 long, t1 long, spk string")
    text = writers.rttm_text(segs).first()["value"]
    (tmp_path / "v.rttm").write_text(text + "\nNOISE x\n")
    got = [tuple(r) for r in readers.read_rttm(spark, str(tmp_path / "v.rttm")).select("t0", "t1", "spk").orderBy("t0").collect()]
    assert got == [(50, 50, "SPK_01"), (1000, 4200, "SPK_00")]


def test_other_writers(spark, tmp_path):
    lines = spark.createDataFrame([("v", 1, 0, 900, "SPK_01", "b", True), ("v", 2, 61000, 62000, "SPK_00", "a", False)], "video_id string, idx long, t0 long, t1 long, spk string, text string, review boolean")
    assert writers.speaker_markdown(lines).first()["value"] == "## SPK_00\n- 01:01 a\n\n## SPK_01\n- 00:00 b"
    writers.write_review(lines, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 1
    writers.write_texts(writers.srt_text(lines, tagged=True), str(tmp_path / "t"))
    assert readers.read_tagged(spark, str(tmp_path / "t")).count() == 2
    writers.append_picks(lines, str(tmp_path / "p"))
    writers.append_picks(lines, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).count() == 4
    scores = spark.createDataFrame([("v", "s", "A", 0.5), ("v", "s", "B", 0.1)], "video_id string, spk string, person string, score double")
    assert tuple(writers.score_matrix_table(scores, ["A", "B"]).first()) == ("v", "s", 0.5, 0.1)


def test_documents_embeddings_and_config(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"a": 1}')
    assert readers.read_documents(spark, str(tmp_path / "d.json"), "a int").first()["a"] == 1
    spark.createDataFrame([("v", ["x", "y"], [[1.0], [2.0]]), ("w", ["x"], [])], "video_id string, labels array<string>, vecs array<array<double>>").write.parquet(str(tmp_path / "e"))
    assert sorted(r["spk"] for r in readers.read_embeddings(spark, str(tmp_path / "e")).collect()) == ["x", "y"]
    config = {"episode_maps": [{"file": "ep1", "map": {"SPK_00": {"voice": "a", "who": "n"}, "SPK_01": {"voice": "s", "skip": True}}}]}
    assert [r["skip"] for r in readers.read_voice_config(spark, config).orderBy("spk").collect()] == [False, True]


def test_ledger_stream_ends_where_the_batch_ends(spark, tmp_path):
    events = Views(spark, SF).ledger_events
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = ws.ledger_stream(stream).writeStream.format("memory").queryName("ledger_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("ledger_out").groupBy("bvid").agg(F.max_by("after", "ord").alias("state"), F.count_if(~F.col("accepted")).alias("rejected"))
    batch = workflow.replay(events).select("bvid", "state", "rejected")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_windows_and_sessions_over_the_events_table(spark):
    events = Views(spark, SF).table("events")
    n = events.count()
    assert ws.windowed_counts(events).agg(F.sum("n")).first()[0] == n
    assert ws.windowed_counts(events, "1 hour", "30 minutes").agg(F.sum("n")).first()[0] == 2 * n
    assert ws.session_counts(events).agg(F.sum("n")).first()[0] == n
    assert ws.accepted_counts(Views(spark, SF).ledger_events).agg(F.sum("count")).first()[0] == n


def test_missing_and_corrupt_documents(spark, tmp_path):
    assert readers.read_documents(spark, str(tmp_path / "none.json"), "a int").count() == 0
    schema = "bvid string, title string"
    for text, n in (('[{"bvid": "a", "title": "x"}, {"bvid": "b"}]', 2), ('{"bvid": "a"}', 0), ("[{broken", 0), ("", 0)):
        (tmp_path / "c.json").write_text(text)
        assert readers.read_catalogue(spark, str(tmp_path / "c.json"), schema).filter("bvid IS NOT NULL").count() == n
    assert readers.read_catalogue(spark, str(tmp_path / "none.json"), schema).count() == 0


def test_rttm_is_merged_on_demand(spark, tmp_path):
    (tmp_path / "v.rttm").write_text("SPEAKER v 1 000.000 500.000 <NA> <NA> A <NA> <NA>\nSPEAKER v 1 510.000 290.000 <NA> <NA> A <NA> <NA>\n")
    assert [tuple(r)[2:] for r in readers.read_rttm(spark, str(tmp_path / "v.rttm"), merged=True).collect()] == [(0, 8000, "A")]


def test_voices_file_reads_back_and_is_always_the_same(spark):
    import yaml

    rows = [(7, "SPK_01", 'who "x"', "skip", True, None, None), (7, "SPK_00", "n", "spk_00", False, "clone", "a\\b.wav"), (8, "SPK_00", None, "spk_00", False, "preset", None)]
    schema = "decision long, id string, who string, entry string, skip boolean, type string, ref_audio string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "CAST(NULL AS STRING) AS engine", "CAST(NULL AS STRING) AS voice", "CAST(NULL AS STRING) AS ref_text_file", "CAST(NULL AS STRING) AS note")
    texts = {r["decision"]: r["value"] for r in writers.voices_yaml(df, {"b": "2", "a": "1"}).collect()}
    assert texts == {r["decision"]: r["value"] for r in writers.voices_yaml(df.orderBy("id").repartition(3), {"a": "1", "b": "2"}).collect()}
    got = yaml.safe_load(texts[7])
    assert list(got) == ["global", "library", "episode_maps"] and got["global"] == {"a": "1", "b": "2"}
    assert got["library"] == {"skip": None, "spk_00": {"type": "clone", "ref_audio": "a\\b.wav"}}
    assert got["episode_maps"][0]["map"] == {"SPK_00": {"voice": "spk_00", "who": "n"}, "SPK_01": {"voice": "skip", "who": 'who "x"', "skip": True}}
    back = readers.read_voice_config(spark, texts[7]).orderBy("spk").collect()
    assert [(r["spk"], r["voice"], r["skip"]) for r in back] == [("SPK_00", "spk_00", False), ("SPK_01", "skip", True)]


def test_products_with_sentinels_and_tables_replaced(spark, tmp_path):
    df, path = spark.createDataFrame([(1,)], "a int"), str(tmp_path / "product")
    assert not writers.is_complete(spark, path)
    assert [writers.write_once(df, path) for _ in range(2)] == ["applied", "reused"] and writers.is_complete(spark, path)
    (tmp_path / "product.done").unlink()
    assert writers.write_once(df, path) == "applied" and writers.write_once(df, path, force=True) == "applied"
    table = str(tmp_path / "table")
    snapshots.replace_table(df, table)
    for _ in range(2):  # a table may be replaced by what reads it
        snapshots.replace_table(snapshots.read_table(spark, table).selectExpr("a + 1 AS a"), table)
    assert snapshots.read_table(spark, table).first()["a"] == 3


def test_of_two_writers_one_begins_again(spark, tmp_path):
    t, one = snapshots.Snapshots(spark, str(tmp_path / "t")), spark.createDataFrame([(1,)], "a int")
    assert t.read() is None and t.version() == 0
    t.commit(one, 0)
    with pytest.raises(snapshots.Conflict):
        t.commit(one, 0)
    asked = []

    def add(now):
        if not asked:  # another writer is faster, once
            t.update(lambda x: x.union(one))
        asked.append(now.count())
        return now.union(one)

    assert t.update(add) == 3 and asked == [1, 2] and t.read().count() == 3
    assert len(list((tmp_path / "t").glob("data-*"))) == 3  # the lost commit left nothing
    assert [t.append(one, "w", n) for n in (0, 0, 1)] == [4, 4, 5] and t.read().count() == 5
    t.vacuum(1)
    assert t.versions() == [5] and t.read().count() == 5 and t.read(5).count() == 5


def test_a_reader_always_finds_a_table(spark, tmp_path):
    t = snapshots.Snapshots(spark, str(tmp_path / "t"))
    t.commit(spark.range(10).toDF("a"), 0)
    writer = Thread(target=lambda: [t.update(lambda now: now.selectExpr("a + 1 AS a")) for _ in range(5)])
    writer.start()
    seen = []
    while writer.is_alive():
        seen.append(tuple(sorted(r["a"] for r in t.read().collect())))
    writer.join()
    assert seen and all(s == tuple(range(s[0], s[0] + 10)) for s in seen) and sorted(seen) == seen
    assert t.version() == 6


def test_array_pairs(spark, tmp_path):
    for name, labels, rows in (("a", ["SPEAKER_03", "SPEAKER_00"], 2), ("b", ["x"], 2), ("c", ["x"], None), ("d", None, 1), ("e", "broken", 1)):
        (tmp_path / name).mkdir()
        if labels is not None:
            (tmp_path / name / "spk_emb.json").write_text("{" if labels == "broken" else json.dumps({"labels": labels}))
        if rows:
            np.save(tmp_path / name / "spk_emb.npy", np.arange(rows * 3, dtype=np.float32).reshape(rows, 3))
    got = {(r["folder"], r["place"]): (r["available"], r["why"], r["spk"], r["vec"]) for r in readers.read_array_pairs(spark, str(tmp_path / "*")).collect()}
    assert got["a", 0] == (True, None, "SPEAKER_03", [0.0, 1.0, 2.0]) and got["a", 1][2:] == ("SPEAKER_00", [3.0, 4.0, 5.0])
    assert got["b", None][:2] == (False, "2 vectors of 1 labels") and got["c", None][1] == "no array" and got["d", None][1] == "no labels" and got["e", None][1].startswith("unreadable")
    assert len(got) == 6


def test_wav_files_give_the_frames_of_their_samples(spark, tmp_path):
    from parley.functions import audio

    r = np.random.default_rng(3)
    mono = (r.normal(0, 3000, 50_000)).astype("<i2")
    for name, channels, data in (("mono", 1, mono), ("both", 2, np.repeat(mono, 2))):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes(data.tobytes())
    (tmp_path / "bad.wav").write_bytes(b"RIFF0000WAVEjunk")
    files = readers.read_wav(spark, str(tmp_path / "*.wav"), piece_s=1).withColumn("file", F.regexp_extract("file", r"([a-z]+)\.wav$", 1))
    assert files.filter("file = 'mono'").count() == 4 and files.filter("file = 'bad'").first()["problem"] == "no data"
    got = audio.frame_levels(files, piece_s=1).toPandas().sort_values(["file", "frame_no"])
    whole = audio.frame_levels(spark.createDataFrame([("x", 16000, mono.tolist())], "file string, rate int, samples array<int>")).toPandas().sort_values("frame_no")
    for name in ("mono", "both"):
        mine = got[got.file == name]
        assert mine.frame_no.tolist() == list(range(31)) and np.allclose(mine.db, whole.db) and np.allclose(mine.db_h, whole.db_h)


def test_matrix_in_markdown(spark):
    scores = spark.createDataFrame([("v", "s2", "A", 0.5), ("v", "s1", "B", 0.1234)], "video_id string, spk string, person string, score double")
    assert writers.matrix_markdown(scores, ["A", "B"]).first()["value"] == "| speaker | A | B |\n|---|---|---|\n| s1 | - | 0.123 |\n| s2 | 0.500 | - |"


def test_frame_levels(spark):
    import numpy as np

    from parley.functions import audio

    t = np.arange(16000) / 16000
    tone = (16000 * np.sin(2 * np.pi * 5000 * t)).astype(int)
    low = (16000 * np.sin(2 * np.pi * 200 * t)).astype(int)
    files = spark.createDataFrame([("hi", 16000, tone.tolist() + [0] * 100), ("lo", 16000, low.tolist()), ("none", 16000, [])], "file string, rate int, samples array<int>")
    got = audio.frame_levels(files).toPandas()
    assert got.groupby("file").size().to_dict() == {"hi": 10, "lo": 10}
    mean = got.groupby("file")[["db", "db_h"]].mean()
    assert abs(mean.loc["hi", "db"] - 20 * np.log10(16000 / 32768 / np.sqrt(2))) < 0.01
    assert mean.loc["hi", "db_h"] > mean.loc["lo", "db_h"] + 40


def test_steps_are_written_once_and_counted_by_state(spark, tmp_path):
    events = Views(spark, SF).ledger_events
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ws.write_steps(stream, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination()
    steps = snapshots.read_table(spark, str(tmp_path / "out"))
    assert steps.count() == events.count()
    want = workflow.replay(events).groupBy("state").count()
    assert sorted(map(tuple, ws.state_counts(steps).collect())) == sorted(map(tuple, want.collect()))


def test_one_task_of_an_item_at_a_time(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, 1, 'ocr', TIMESTAMP '2024-01-01 00:00:00'), (1L, 1, 'ocr', TIMESTAMP '2024-01-01 00:01:00'), (1L, 1, 'mix', TIMESTAMP '2024-01-01 00:01:00'), (1L, 1, 'ocr', TIMESTAMP '2024-01-01 02:00:00') t(bvid, part, stage, ts)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ws.distinct_tasks(stream).writeStream.format("memory").queryName("tasks_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tasks_out").filter("ts < '2024-01-01 01:00:00'").count() == 2


def test_counts_by_state_follow_the_stream(spark, tmp_path):
    events = Views(spark, SF).ledger_events
    half = events.filter("ord <= 3"), events.filter("ord > 3")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for i, part in enumerate(half):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ws.steps_to_files(stream, str(tmp_path / "steps"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        live = ws.live_counts(spark, str(tmp_path / "steps")).writeStream.format("memory").queryName(f"live_{i}").outputMode("complete").option("checkpointLocation", str(tmp_path / f"ck{i}")).start()
        live.processAllAvailable()
        live.stop()
        want = workflow.replay(events if i else half[0]).groupBy("state").count()
        assert sorted(map(tuple, spark.table(f"live_{i}").collect())) == sorted(map(tuple, want.collect()))


def test_a_task_is_refused_until_its_end_or_time_out(spark, tmp_path):
    at = lambda m: f"TIMESTAMP '2024-01-01 {m // 60:02d}:{m % 60:02d}:00'"
    batches = [[(1, "ocr", 0, "start"), (1, "ocr", 1, "start"), (1, "mix", 1, "start"), (2, "ocr", 2, "end")], [(1, "ocr", 5, "end"), (1, "ocr", 6, "start"), (1, "mix", 20, "start")], [(3, "ocr", 90, "start")], [(1, "ocr", 91, "start"), (1, "mix", 92, "end")]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("bvid long, part int, stage string, ts timestamp, kind string").parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for rows in batches:
            values = ", ".join(f"({b}L, 1, '{s}', {at(m)}, '{k}')" for b, s, m, k in rows)
            spark.sql(f"SELECT * FROM VALUES {values} t(bvid, part, stage, ts, kind)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q = ws.running_tasks(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {(r["bvid"], r["stage"], r["ts"].hour * 60 + r["ts"].minute, r["kind"]): r["accepted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, "ocr", 0, "start"] and not got[1, "ocr", 1, "start"] and got[1, "mix", 1, "start"] and not got[2, "ocr", 2, "end"]
    assert got[1, "ocr", 5, "end"] and got[1, "ocr", 6, "start"] and not got[1, "mix", 20, "start"]
    assert got[1, "mix", 31, "timeout"] and got[1, "ocr", 36, "timeout"]
    assert got[1, "ocr", 91, "start"] and not got[1, "mix", 92, "end"]
