"""Line dedup against a plain loop over all rows."""

import re
from collections import defaultdict

import pytest
from helpers import awkward_texts, documents

from tablewright.llm import common_lines

ENDS = " \t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(ENDS))


def plain(rows, documents=2, chars=10):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key_of(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < chars or len(holders[key_of(x)]) < documents
                or min(holders[key_of(x)], key=lambda d: (d is None, d or 0)) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


ROWS = awkward_texts() + [
    (30, "A shared Line\nown line of thirty\n\n short \n"), (31, "\ta shared line \r\nA SHARED LINE"),
    (32, "a shared line"), (32, "other text\nshared by one id only\n"),
    (32, "shared by one id only"), (33, "ÀÉ shared ü\nx\ny"), (34, "àé shared ü"),
    (35, "ÀÉ SHARED ü"), (None, "a shared line\nnull and null hold it"),
    (None, "null and null hold it"), (36, "ten chars!\nnine char"), (37, "ten chars!\nnine char"),
    (38, "line\x0bbreaks\x0conly at feeds"), (39, "line\x0bbreaks\x0conly at feeds "),
    (40, "\n".join(f"row number {i % 700}" for i in range(30_000))), (41, "row number 5\n" * 9_000),
    (42, "\n\n\n"), (43, " a shared line"), (44, "q" * 300_000 + "\nz"), (45, "q" * 300_000),
]


@pytest.mark.parametrize("documents_, chars", [(2, 10), (3, 10), (2, 1), (2, 0)])
def test_equals_plain_loop(spark, documents_, chars):
    found = common_lines.drop_common_lines(
        documents(spark, ROWS, extra=True).repartition(5), documents_, chars)
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain(ROWS, documents_, chars)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    import tablewright.operators.lookup as lookup

    rows = ROWS + [(1000 + i, "a shared line\nmine alone %d" % i) for i in range(300)] + [
        (2000, "a shared line\nrepeated row")] * 200
    monkeypatch.setattr(lookup, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(common_lines, "fits_broadcast", lambda *_: False)
    found = common_lines.drop_common_lines(documents(spark, rows))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()
    assert sorted(map(tuple, found.collect()), key=repr) == plain(rows)


def test_columns_of_any_name_and_no_rows(spark):
    df = spark.createDataFrame(
        [(1, "same long line", "a", 1), (2, "same long line", "b", 2)],
        "id long, `the text` string, `_key1` string, n_lines int")
    found = common_lines.drop_common_lines(
        df, id_column="id", text_column="the text", keep=["_key1", "n_lines", "id"], prefix="out_")
    assert found.columns == ["_key1", "n_lines", "id", "out_n_lines", "out_n_dropped", "out_kept"]
    assert sorted(map(tuple, found.collect())) == [
        ("a", 1, 1, 1, 0, "same long line"), ("b", 2, 2, 1, 1, "")]
    assert common_lines.drop_common_lines(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = common_lines.drop_common_lines(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
