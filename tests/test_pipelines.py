"""The media pipelines over small tables, and the command line."""

from pyspark.sql import functions as F

from lumenflow.__main__ import main
from lumenflow.plans import pipelines


def test_audio(spark):
    segments = spark.createDataFrame([("m", 0, 0.0, 2.0, "Hello there. We met Annabel today"), ("m", 1, 2.0, 5.0, "and left.")], "media string, ord int, start double, end double, text string")
    turns = spark.createDataFrame([("m", 1, 0.0, 1.5, "A"), ("m", 2, 1.5, 6.0, "B")], "media string, turn int, ts double, te double, speaker string")
    made, summary = pipelines.run(spark, "audio", {"segments": segments, "turns": turns}, materialise=lambda df: df.cache())
    status = {r["module"]: r["status"] for r in summary.collect()}
    assert status["timeline"] == status["chapters"] == "skipped" and status["speakers"] == status["resegmented"] == "ok"
    assert [r["speaker"] for r in made["speakers"].orderBy("ord").collect()] == ["A", "B"]
    assert made["words"].count() == 8 and made["entities"].first()["word"] == "Annabel"
    assert made["subtitles"].first()["srt"].startswith("1\n00:00:00,000 --> 00:00:02,000\nHello")


def test_audio_timeline(spark):
    tags = spark.createDataFrame([("m", k, "music", 0.5) for k in range(4)] + [("m", 5, "speech", 0.4), ("m", 6, "noise", 0.3)], "media string, k long, label string, conf double")
    moods = spark.createDataFrame([("m", k, x, p) for k in range(8) for x, p in (("calm", 0.7), ("glad", 0.3))], "media string, k long, label string, p double")
    turns = spark.createDataFrame([("m", 1, 0.0, 1.5, "A")], "media string, turn int, ts double, te double, speaker string")
    energy = spark.createDataFrame([("m", i, 1.0 if 40 <= i < 50 else 0.0) for i in range(100)], "media string, at long, x double")
    made, summary = pipelines.run(spark, "audio", {"tags": tags, "moods": moods, "turns": turns, "energy": energy}, chosen=["timeline"])
    assert {r["module"]: r["status"] for r in summary.collect()}["timeline"] == "ok"
    got = sorted((r["kind"], r["label"] or "", r["s"], r["e"]) for r in made["timeline"].collect())
    # the turn reaches windows 0 and 1; window 5 carries speech; window 6 is under the tag threshold
    assert got == [("energy_peak", "", 44.0, 44.0), ("mood", "calm", 0.0, 3.0), ("mood", "calm", 5.0, 7.0), ("tag", "music", 0.0, 5.0), ("tag", "speech", 5.0, 7.0)]


def test_video(spark):
    scenes = spark.createDataFrame([("m", 0, 29), ("m", 30, 119)], "media string, first long, last long")
    actions = spark.createDataFrame([("m", 0, "run", 0.0, 1.0, 0.5), ("m", 1, "run", 1.2, 2.0, 0.6)], "media string, ord int, label string, s double, e double, conf double")
    vectors = spark.createDataFrame([("m", i, [1.0 if i < 5 else 0.01 * i, 1.0 if i >= 5 else 0.01 * i]) for i in range(10)], "media string, id long, v array<double>")
    made, summary = pipelines.run(spark, "video", {"scenes": scenes, "actions": actions, "vectors": vectors}, chosen=["keyframes", "actions_merged", "clusters"])
    assert {r["module"]: r["status"] for r in summary.collect()} == {"keyframes": "ok", "actions_merged": "ok", "clusters": "ok", "mosaics": "not_run"}
    assert sorted(r["frame"] for r in made["keyframes"].collect()) == [14, 30, 119]
    assert made["actions_merged"].count() == 1


def test_research_and_docs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html").limit(5)
    made, summary = pipelines.run(spark, "research", {"pages": pages})
    assert made["extracted"].filter(F.col("metadata")["Source"].isNull()).count() == 0
    assert {r["module"]: r["status"] for r in summary.collect()}["retrieved"] == "skipped"
    elements = spark.createDataFrame([(1, 0, "Title", "Report"), (1, 1, "Text", "name: Ann"), (1, 2, "Text", "total = 5")], "doc_id long, ord int, type string, text string")
    made, _ = pipelines.run(spark, "docs", {"elements": elements})
    assert sorted((r["key"], r["value"]) for r in made["forms"].collect()) == [("name", "Ann"), ("total", "5")]
    assert made["overview"].first()["n_sections"] == 1


def test_failures_are_recorded(spark):
    wrong = spark.createDataFrame([(1,)], "x int")
    made, summary = pipelines.run(spark, "docs", {"elements": wrong})
    status = {r["module"]: r["status"] for r in summary.collect()}
    assert status["text"] == "fail" and status["chunks"] == "skipped"


def test_command_line(spark, sf_dir, tmp_path, capsys):
    assert main(["list"]) == 0 and "j01_overlap_join" in capsys.readouterr().out
    assert main(["run", "r07_event_counts", sf_dir, "--out", str(tmp_path / "out"), "--format", "csv"]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() > 0


def test_docs_read_long_documents_to_the_end(spark):
    line = "we met Alexander, Barbara, Charlotte, Dorothea, Eleanor, Frederick, Gustav and Henrietta there. " * 10
    elements = [(1, i, "Text", line) for i in range(80)] + [(1, 80, "Text", "  then we saw Zacharias, Yolanda, Xanthippe, Wilhelmina  "), (1, 81, "Text", "a Maria")]
    made, _ = pipelines.run(spark, "docs", {"elements": spark.createDataFrame(elements, "doc_id long, ord int, type string, text string")})
    assert made["text"].first()["text"] == "\n".join(e[3] for e in elements)
    assert made["chunks"].filter(F.col("body").contains("Wilhelmina")).count() == 1
    assert made["overview"].first()["n_sections"] == made["chunks"].count()
    found = made["entities"].collect()
    assert {r["ord"] for r in found} == set(range(81)) and {r["id"] for r in found} == {1}
    assert all(elements[r["ord"]][3].strip()[r["start"] : r["end"]] == r["word"] for r in found)
