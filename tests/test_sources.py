"""Readers, sinks, settings and the incremental loader."""

import json

import pytest
from pyspark.sql import functions as F

from pathloom import schemas
from pathloom.sources import config, readers, sinks
from pathloom.streaming import mappings as stream


def test_taxonomy_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text('conceptUri,preferredLabel,altLabels,description,definition,skillType\nu1,"one, ""a""","x | y","two\nlines",d,skill\nu2,two,,,used,\nu3,three,z,desc,,knowledge\n')
    (tmp_path / "r.csv").write_text("originalSkillUri,relatedSkillUri,relationType\nu1,b,essential\nu1,a,optional\nu3,c,essential\n")
    got = {r["skill_id"]: r for r in readers.read_skills(spark, str(tmp_path / "s.csv"), str(tmp_path / "r.csv")).collect()}
    assert len(got) == 3 and got["u1"]["preferred_label"] == 'one, "a"' and got["u1"]["description"] == "two\nlines"
    assert got["u1"]["alternative_labels"] == ["x", "y"] and got["u2"]["alternative_labels"] == []
    assert got["u2"]["description"] is None and got["u2"]["skill_type"] is None  # a missing description is not replaced
    assert got["u1"]["broader_skill_ids"] == ["b", "a"] and got["u2"]["broader_skill_ids"] == []


def test_courses(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.json").write_text(json.dumps({"course_id": "B", "skill_outcomes": [{"skill_name": "x", "target_proficiency_level": 2}]}, indent=1))
    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "c.txt").write_text("{}")
    got = readers.read_courses(spark, str(tmp_path)).collect()
    assert [(r["course_id"], r["source_file"].split("/")[-1]) for r in got] == [("B", "b.json")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_courses(spark, str(tmp_path / "none")).count()


def test_mapping_round_trip(spark, tmp_path):
    row = dict.fromkeys((f.name for f in schemas.MAPPING.fields), None) | {"course_id": "ç", "similarity_score": 0.5}
    sinks.write_json_lines(spark.createDataFrame([row], schemas.MAPPING), str(tmp_path / "m"))
    written = "".join(p.read_text() for p in (tmp_path / "m").glob("part*"))
    assert '"ç"' in written and '"category":null' in written
    assert readers.read_mappings(spark, str(tmp_path / "m")).first()["course_id"] == "ç"
    assert readers.require_columns(readers.read_mappings(spark, str(tmp_path / "m")), ["course_id"]).count() == 1
    with pytest.raises(ValueError):
        readers.require_columns(spark.range(1), ["x"])


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1)], "k int, v string, seq int")
    sinks.append_table(df, str(tmp_path / "t"))
    sinks.append_table(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    sinks.write_table(df, str(tmp_path / "u1"))
    new = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], df.schema)
    assert {r["v"] for r in sinks.upsert_table(spark, new, str(tmp_path / "u1"), str(tmp_path / "u2"), ["k"]).collect()} == {"b", "c"}
    sinks.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["v"] == "a"


def test_json_array_and_catalogue(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"query": "q", "positive": "p", "negatives": ["n"], "metadata": {"skill_uri": "u"}}, {"query": "r"}]))
    got = readers.read_json_array(spark, str(tmp_path / "d.json")).orderBy("seq").collect()
    assert [r["query"] for r in got] == ["q", "r"] and got[0]["metadata"]["skill_uri"] == "u"
    rows = spark.createDataFrame([("c1", 1, " x "), ("c2", 2, "x"), ("c2", 3, '{"skill_name": "y"}'), ("c3", 4, "")], "course string, seq int, skill string")
    assert sorted(tuple(r) for r in readers.label_catalogue(rows).collect()) == [("x", "c1", 1), ("y", "c2", 3)]


def test_requests_and_flat_skills(spark):
    skills = spark.createDataFrame([("u", "L", None, None, ["b"], ["x", "y"])], schemas.SKILL)
    assert json.loads(sinks.generation_requests(skills, "m", "Say ").first()["request"]) == {"key": "u", "model": "m", "prompt": "Say L"}
    assert sinks.flat_skills(skills).first()["alternative_labels"] == "x|y"


def test_settings():
    assert config.expand("$A/${B}/$C", {"A": "x", "B": "y"}) == "x/y/$C"
    s = config.load_settings({"skills_path": "${R}/s.csv", "top_k": "7", "unknown": 1, "similarity_threshold": None}, {"R": "/r"})
    assert (s.skills_path, s.top_k, s.similarity_threshold) == ("/r/s.csv", 7, 0.0)


def test_incremental_mappings(spark, tmp_path):
    folder, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    record = lambda **v: json.dumps({"course_id": "c", "skill_name": "n", "skill_type": "outcome"} | v)
    (tmp_path / "in").mkdir()
    assert stream.read_table(spark, table) is None
    (tmp_path / "in" / "1.json").write_text(record(category="old") + "\n" + record(skill_name="m"))
    stream.load_mappings(spark, folder, table, state).awaitTermination(120)
    assert stream.read_table(spark, table).count() == 2
    (tmp_path / "in" / "2.json").write_text(record(category="new"))
    stream.load_mappings(spark, folder, table, state).awaitTermination(120)
    got = {r["skill_name"]: r["category"] for r in stream.read_table(spark, table).collect()}
    assert got == {"n": "new", "m": None}


def test_order_follows_files_not_their_sizes(spark, tmp_path):
    """A short file ahead of a long one: the long one's rows come last, whatever tasks read them."""
    small = spark.createDataFrame([("c", "first")], "course_id string, skill_name string")
    small.coalesce(1).write.json(str(tmp_path / "in" / "a"))
    rows = spark.range(50_000).select(F.lit("c").alias("course_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("skill_name"))
    rows.coalesce(1).write.json(str(tmp_path / "in" / "b"))
    got = readers.read_mappings(spark, f"{tmp_path}/in/*")
    assert sinks.last_by(got, ["course_id"], "seq").first()["skill_name"] == "n49999"
    assert sinks.first_by(got, ["course_id"], "seq").first()["skill_name"] == "first"
    old = got.filter("skill_name = 'n5'")
    assert sinks.upserted(got, old, ["course_id"]).first()["skill_name"] == "n5"


def test_label_folder(spark, tmp_path):
    for name, text in (("b", '{"course_id": "two", "skill_outcomes": [{"skill_name": " x "}]}'), ("a", '{"skill_outcomes": [{"skill_name": "x"}, {"skill_name": ""}], "entry_requirements": {"minimum_entry_skills": [{"skill_name": "y"}]}}'), ("c", "{}")):
        (tmp_path / f"{name}.json").write_text(text)
    got = readers.label_catalogue(readers.read_label_folder(spark, str(tmp_path))).collect()
    assert sorted((r["skill_text"], r["course"]) for r in got) == [("x", "a"), ("y", "a")]
