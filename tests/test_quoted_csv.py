"""CSV with line breaks inside quotes, cut into small byte ranges, against the whole-file reader."""

import csv
import io
import random

import pytest

from tablewright.sources import quoted_csv, tables


def write(path, rows, end="\n", encoding="utf-8", delimiter=","):
    text = io.StringIO(newline="")
    csv.writer(text, lineterminator=end, delimiter=delimiter).writerows(rows)
    path.write_bytes(text.getvalue().encode(encoding))


def rows_with_breaks(seed, n):
    r = random.Random(seed)
    parts = ['say "hi"', "a, b", "two\nlines", "three\n\n\"quoted\"\nlines", "plain", "", '"', "é ü",
             "x" * 90, "\n" * 5, '5" disk', "tail\n", "l" * 40 + "\n" + "m" * 300 + "\n\"n\""]
    return [["id", "note", "v", "more"]] + [
        [i, r.choice(parts), r.choice(["", 1.5, -2e3]), r.choice(parts) + str(i)] for i in range(n)]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


SCHEMA = "id int, note string, v double, more string"


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("delimiter", [",", ";"])
def test_equal_to_the_whole_file_reader(spark, tmp_path, small_ranges, end, delimiter):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for k in range(2):
        write(folder / f"{k}.csv", rows_with_breaks(k, 150), end, delimiter=delimiter)
    ranged = quoted_csv.read_quoted_csv(spark, str(folder), delimiter, schema=SCHEMA)
    assert ranged.rdd.getNumPartitions() > 20
    found = sorted(map(tuple, ranged.collect()), key=repr)
    whole = tables.load_csv(spark, str(folder), delimiter, "UTF-8", SCHEMA, multi_line=True)
    assert found == sorted(map(tuple, whole.collect()), key=repr) and len(found) == 300
    states = quoted_csv.range_states(spark, str(folder), delimiter, "UTF-8")
    assert states.where("inside").count() > 5 < states.where("not inside").count()


def test_detection_and_inference(spark, tmp_path, small_ranges):
    path = tmp_path / "one.csv"
    write(path, rows_with_breaks(3, 200))
    df = tables.load_csv(spark, str(path))
    assert df.dtypes == [("id", "int"), ("note", "string"), ("v", "double"), ("more", "string")]
    whole = tables.load_csv(spark, str(path), multi_line=True)
    assert df.dtypes == whole.dtypes
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    latin = tmp_path / "latin.csv"
    write(latin, [["k", "when", "ok"], [2**40, "2024-01-31", True], [1, "2024-02-01", False], ["", "", ""]]
          + [["7", "2024-03-01", "true"]] * 3, encoding="latin-1")
    typed = quoted_csv.read_quoted_csv(spark, str(latin), encoding="ISO-8859-1")
    assert typed.dtypes == [("k", "bigint"), ("when", "date"), ("ok", "boolean")]
    assert typed.count() == 6


def test_a_field_over_many_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "long.csv"
    long = "\n".join(f"line {i} of one field, with \"quotes\"" for i in range(300))
    write(path, [["a", "b"], [1, "x"], [2, long], [3, "y"], [4, long + "z"]])
    got = {r.a: r.b for r in quoted_csv.read_quoted_csv(spark, str(path), schema="a int, b string").collect()}
    assert got == {1: "x", 2: long, 3: "y", 4: long + "z"}


def test_states_of_a_line():
    opening = quoted_csv.opening_of(",")
    cases = [('a,"b', False, True), ('b",c', True, False), ('a,5" disk', False, False),
             ('a,"b ""c"" d', False, True), ('x""y', True, True), ('"",', False, False),
             ('x","y', True, True), ('x"', True, False), ('"a","b","', False, True)]
    for line, inside, want in cases:
        assert quoted_csv.advance(line, inside, opening) is want, line


def test_files_without_header(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        quoted_csv.read_quoted_csv(spark, str(tmp_path / "none.csv"))
