"""Exact quantiles, documentation, provenance, rules and the command line."""

import json
import random
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinesia.__main__ import COMMANDS, main
from kinesia.functions.ranks import exact_quantiles
from kinesia.operators import delivery, labels, qc
from kinesia.operators.guards import DataError
from kinesia.sources import provenance, readers, sinks


@pytest.mark.parametrize("n", [0, 1, 2, 7, 400, 401, 3000])
def test_quantiles_are_exact(spark, n):
    r = random.Random(n)
    rows = [(r.choice([r.gauss(0, 9), 3.0, None]), float(r.randrange(4))) for _ in range(n)]
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    got = exact_quantiles(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], shares, accuracy=100)
    values = {(x.column, x.k): x.value for x in got.collect()}
    assert len(values) == 2 * len(shares)
    for j, c in enumerate("ab"):
        known = [x[j] for x in rows if x[j] is not None]
        for k, q in enumerate(shares):
            assert values[c, k] == (pytest.approx(np.percentile(known, 100 * q)) if known else None)


def test_quantiles_of_a_hot_value(spark):
    x = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    want = np.percentile([7.0 if k % 3 == 0 else k for k in range(5000)], [25, 50, 75])
    got = exact_quantiles(x, ["v"], (0.25, 0.5, 0.75), accuracy=50).orderBy("k").collect()
    assert [r.value for r in got] == pytest.approx(list(want)) and {r.n for r in got} == {5000}


def test_dictionary_and_cover(spark):
    rules = spark.createDataFrame([("n_*", "count", "counts"), ("*_x", "side", "places"), ("right_n_x", "own", "counts too")], "pattern string, text string, family string")
    t = spark.createDataFrame([(1.0, 2, None, 0)], "a_x double, n_b int, right_n_x double, other int")
    d = delivery.dictionary({"t": t}, rules, ("counts", "places"))
    got = [(r.column, r.text, r.non_null) for r in d.orderBy("place").collect()]
    assert got == [("n_b", "count", 1), ("right_n_x", "own", 0), ("a_x", "side", 1), ("other", None, 1)]
    assert [tuple(r) for r in delivery.cover(d, {"t": 9}, {"term": None, "version": 3}).orderBy("place").collect()] == [(1, "t", "9 rows x 4 columns"), (2, "version", "3")]


@pytest.mark.parametrize("regime", ["no voice", "segments", "spline", "segments with leftovers"])
def test_voice_section(spark, regime):
    s = spark.createDataFrame([(regime, "g", 1, 2, 3, 4, 5, 1.25, 7.0, 0.5, None)], "regime string, gate string, n_zero long, n_pitch_outside long, n_harmonicity_low long, n_formant_outside long, n_voiced long, intensity_low double, intensity_high double, r_all double, r_voiced double")
    lines = [r.line for r in delivery.voice_section(s).orderBy("place").collect()]
    assert (lines == list(delivery.VOICE_ADVICE["no voice"])) if regime == "no voice" else lines[0] == f"regime: {regime}"
    assert any(x.endswith(": 4") for x in lines) == (regime != "no voice")
    assert ("intensity with right_speed: 0.500, with voice: not computable" in lines) == (regime != "no voice")


def test_rule_and_usable_scores(spark):
    assert qc.resolve_rule() == ("sp_any", 0.6) and qc.resolve_rule("sp_both") == ("sp_both", 0.8) and qc.resolve_rule("sp_any", 0.3) == ("sp_any", 0.3)
    assert qc.resolve_rule(least_both=0.7) == ("sp_both", 0.7) == qc.resolve_rule("sp_both", least_both=0.7)
    for bad in ({"criterion": "other"}, {"limit": 0.5, "least_both": 0.5}, {"criterion": "sp_any", "least_both": 0.5}):
        with pytest.raises(ValueError):
            qc.resolve_rule(**bad)
    s = spark.createDataFrame([(None, 0.4, None, float("nan")), (float("nan"), None, None, None)], "sp_any double, sp_right double, sp_left double, sp_both double")
    assert {r.criterion: (r.n, r.usable) for r in qc.usable(s).collect()} == {"sp_any": (2, 1), "sp_both": (2, 0)}
    assert qc.require_usable(s, "sp_any") is s
    with pytest.raises(DataError):
        qc.require_usable(s, "sp_both")


def test_gate_and_totals(spark):
    a = spark.createDataFrame([("429",), ("x",)], "error string")
    assert labels.gate(labels.annotation_counts(a)).first().passes is False
    f = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    assert [tuple(r) for r in readers.media_totals(f("OK", "OK")).collect()] == [("OK", 2, 2, True)]
    assert {tuple(r) for r in readers.media_totals(f("OK", "BAD")).collect()} == {("OK", 1, 2, False), ("BAD", 1, 2, False)}
    assert readers.media_totals(f()).count() == 0


def test_prosody_files(spark, tmp_path):
    for name in ("flat.parquet", "a/a_prosody.parquet", "a/extra.parquet", "b/one.parquet", "b/two.parquet", "c/note.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text("x")
    got = {(r.id, r.path.rsplit("/", 1)[-1]) for r in readers.prosody_files(spark, str(tmp_path / "in")).collect()}
    assert got == {("flat", "flat.parquet"), ("a", "a_prosody.parquet"), ("b", "one.parquet"), ("b", "two.parquet")}


def test_provenance(spark, tmp_path):
    assert provenance.recorded(spark, None)["reason"] and provenance.recorded(spark, str(tmp_path / "no.json"))["reason"]
    for text, fine in (("{", False), ("[1]", False), ("", False), ('{"recorded_at": "now", "x": 1}', True)):
        (tmp_path / "p.json").write_text(text)
        got = provenance.recorded(spark, str(tmp_path / "p.json"))
        assert (got["reason"] is None) == fine and (got["recorded_at"] == "now") == fine
    bare = provenance.code(str(tmp_path))
    assert bare["commit"] is None and bare["reason"] and bare["pyspark"]
    git = lambda *w: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *w], check=True, capture_output=True)
    git("init")
    git("add", "p.json")
    git("commit", "-m", "x")
    (tmp_path / "p.json").write_text("{}")
    (tmp_path / "new").write_text("")
    got = provenance.code(str(tmp_path))
    assert len(got["commit"]) == 40 and (got["changed"], got["unknown"], got["reason"]) == (1, 1, None)


def test_manifest_names_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("{}")
    sinks.publish(spark, str(tmp_path / "out"), {"t": spark.range(3)}, {}, inputs={"notes": str(tmp_path / "in")}, origin={"reason": "none"})
    manifest = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert manifest["inputs"]["notes"][0]["name"] == "a.json" and manifest["inputs"]["notes"][0]["bytes"] == 2 and manifest["origin"] == {"reason": "none"}


def test_command_line(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    spark.createDataFrame([(None,), ("429",)], "error string").write.parquet(path("notes"))
    assert main(["annotations", path("notes"), path("gate")], spark) == 0 and spark.read.parquet(path("gate")).first().annotated == 1
    spark.createDataFrame([("429",)], "error string").write.parquet(path("bad"))
    assert main(["annotations", path("bad"), path("gate2")], spark) == 1
    with pytest.raises(FileExistsError):
        main(["annotations", path("notes"), path("gate")], spark)
    assert main(["profile", path("notes"), path("profile")], spark) == 0 and spark.read.parquet(path("profile")).first().non_null == 1
    assert main(["digests", path("notes"), path("digests")], spark) == 0
    (tmp_path / "tab.tsv").write_text("2016-b.txt\td\t20\t0\t12\t0\n")
    assert main(["check-tab", path("tab.tsv"), path("tab")], spark) == 1
    assert len(COMMANDS) == 17


def test_gate_clean_and_align_on_files(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    write = lambda name, schema, *rows: spark.createDataFrame(list(rows), schema).write.parquet(path(name))
    body = "id string, people_id double, frame long, points long, nx double, ny double, c double, type_points string"
    write("long", body, *[("a", 0.0, f, p, 0.1, 0.2, 0.9, "pose_keypoints") for f in range(1, 5) for p in range(25)])
    write("expected", "id string, n_frames long", ("a", 4), ("b", 4))
    assert main(["gate", path("long"), path("expected"), path("gate")], spark) == 0
    assert {r.id: r.decision for r in spark.read.parquet(path("gate")).collect()} == {"a": "accepted", "b": "low_coverage"}
    write("few", "id string, n_frames long", ("a", 3))
    assert main(["gate", path("long"), path("few"), path("fault")], spark) == 1

    write("candidates", "id string, frame long, person long, n_reliable long, nose double, shoulders boolean, black double", *[("a", f, 0, 20, 0.9, True, 0.0) for f in range(1, 9)], ("a", 1, 1, 3, 0.1, False, 0.0))
    assert main(["clean", path("candidates"), path("clean")], spark) == 0
    assert {(r.frame, r.person) for r in spark.read.parquet(path("clean")).collect()} == {(f, 0) for f in range(1, 9)}

    write("samples", "id string, seq long, t double, v double", ("a", 0, 0.0, 1.0), ("a", 1, 0.1, 3.0))
    write("grid", "id string, frame long, t double", ("a", 1, 0.05), ("a", 2, 0.2))
    assert main(["align", path("samples"), path("grid"), path("track")], spark) == 0
    assert {r.frame: r.value and round(r.value, 6) for r in spark.read.parquet(path("track")).collect()} == {1: 2.0, 2: None}
    before = sorted(p.name for p in tmp_path.iterdir())
    with pytest.raises(FileExistsError):
        main(["align", path("samples"), path("grid"), path("track")], spark)
    assert sorted(p.name for p in tmp_path.iterdir()) == before
