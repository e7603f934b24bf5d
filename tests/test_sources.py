"""CSV, split tables, run log and feeds read from files."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import runs, text
from tablewright.sources import feeds, logs, tables


def test_csv_detection(spark, tmp_path):
    plain = tmp_path / "a.csv"
    plain.write_text('id,name,v\n1,"Doe, Jane",1.5\n2,"say ""hi""",\n', encoding="utf-8")
    df = tables.load_csv(spark, str(plain))
    assert df.dtypes == [("id", "int"), ("name", "string"), ("v", "double")]
    assert [r["name"] for r in df.orderBy("id").collect()] == ["Doe, Jane", 'say "hi"']
    other = tmp_path / "b.csv"
    other.write_bytes("id;name\n1;café\n".encode("latin-1"))
    assert tables.load_csv(spark, str(other)).first()["name"] == "café"
    utf = tmp_path / "c.csv"
    utf.write_text("id;name\n1;café\n", encoding="utf-8")
    assert tables.load_csv(spark, str(utf)).first()["name"] == "café"
    lines = tmp_path / "d.csv"
    lines.write_text('id,note\n1,"two\nlines"\n2,one\n', encoding="utf-8")
    assert tables.inspect_text(spark, str(lines)) == (True, True)
    assert tables.inspect_text(spark, str(plain)) == (True, False)
    notes = tables.load_csv(spark, str(lines))
    assert {r["note"] for r in notes.collect()} == {"two\nlines", "one"}
    with pytest.raises(ValueError, match="Expected a CSV"):
        tables.load_csv(spark, "x.txt")
    with pytest.raises(ValueError, match="Unknown format"):
        tables.load_table(spark, "x.doc")


def test_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, float("nan")), (2, 2.0)], "i int, v double").write.parquet(path)
    assert tables.load_table(spark, path).where("v is null").count() == 1


def test_split_table_is_pruned(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(10).withColumn(
        "split", F.when(F.col("id") < 8, "train").otherwise("validation")
    )
    tables.write_split(df, path)
    held = tables.read_split(spark, path, "validation")
    assert held.count() == 2
    assert "PartitionFilters: [isnotnull(split" in held._jdf.queryExecution().toString()
    tables.write_table(df, str(tmp_path / "c"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 10


def test_run_log_ignores_broken_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = spark.createDataFrame(
        [("r1", "w", "svc", "{}", "accuracy", 0.5)],
        "run_id string, workspace string, model_type string, hyperparameters string, "
        "metric string, score double",
    ).withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    logs.append_runs(entry, path)
    logs.append_runs(entry.withColumn("run_id", F.lit("r2")), path)
    (tmp_path / "log" / "part-broken.json").write_text('{"run_id": "r3", "sco\n')
    assert sorted(r["run_id"] for r in logs.read_runs(spark, path).collect()) == ["r1", "r2"]


def test_atom_files(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(
        "<feed><entry><title>A\nB</title><summary> S </summary><published>2024</published>"
        "<id>http://id</id><author><name>Ann</name></author>"
        '<link href="http://page" rel="alternate" type="text/html"/>'
        '<category term="cs.LG"/><category term="cs.LG"/></entry>'
        "<entry><title>C</title><id> http://only </id></entry></feed>"
    )
    rows = {r["title"]: r for r in feeds.read_atom(spark, str(tmp_path / "feed.xml")).collect()}
    assert rows["A B"]["url"] == "http://page" and rows["A B"]["categories"] == ["cs.LG"]
    assert rows["C"]["url"] == "http://only" and rows["C"]["authors"] == []


def test_insight_extraction(spark):
    docs = spark.createDataFrame(
        [
            (1, "XGBoost and CatBoost", "State-of-the-art with learning_rate 0.1", ["t1", "t2"]),
            (2, "Feature selection", "A random forest, max depth 5", []),
        ],
        "doc_id long, title string, abstract string, tasks array<string>",
    )
    hints = text.first_per_key(text.hyperparameter_hints(docs), ["model", "param"]).collect()
    assert {(h["model"], h["param"]) for h in hints} == {
        ("CatBoost", "learning_rate"), ("Random Forest", "max_depth")
    }
    body = text.combined_text()
    counts = text.mention_counts(text.document_mentions(docs, body, text.paper_weight(body)))
    assert {r["family"]: r["mentions"] for r in counts.collect()} == {
        "XGBoost": 2, "CatBoost": 2, "Random Forest": 1
    }
    best = text.model_recommendations(counts, 500, 10, 4).orderBy("rank").collect()
    assert [r["name"] for r in best] == ["CatBoost", "TabPFN", "XGBoost", "Random Forest"]
    assert best[0]["confidence"] == "high"
    assert text.paper_strategies(docs).first()["approach"] == "CatBoost, XGBoost for t1, t2"
    assert [r["technique"] for r in text.feature_tips(docs).collect()] == ["feature_engineering"]


def test_registry_lookup(spark):
    registry = spark.createDataFrame([(1, "svc"), (2, "gbt")], "id long, model_type string")
    grown = runs.register_model(registry, {"model_type": "knn"})
    assert runs.current_best(grown).first()["id"] == 3
    assert runs.get_model(grown, 2).first()["model_type"] == "gbt"
    assert [r["id"] for r in runs.list_models(grown).collect()] == [1, 2, 3]
    with pytest.raises(ValueError, match="not found"):
        runs.get_model(grown, 9)
    with pytest.raises(ValueError, match="at least one"):
        runs.compare_runs(registry, [])
