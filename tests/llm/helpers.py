"""Small tables with the awkward cases every operator must define."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the river and old house of stone near a green hill was quiet in that year".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def awkward_texts() -> list[tuple[int | None, str | None]]:
    """Null and repeated ids, null, empty and long texts, copies, ties, several scripts."""
    passage = prose(1, 30)
    return [
        (5, passage + " tail one"), (9, "start " + passage), (7, passage), (7, passage),
        (3, None), (None, passage), (None, None), (4, ""), (11, " \n\t "), (12, "x" * 3000),
        (13, "x" * 3000 + "y"), (14, prose(2, 4000)), (15, prose(2, 4000)),
        (16, "Größe naïve 東京 ١٢٣ 😀 <|endoftext|> end\r\n  it's I'll"), (17, "a"),
        (18, "short text"), (19, "short text"), (20, "ab" * 40 + passage[10:90] + "cd" * 40),
        (21, prose(3, 60) + "\n" + prose(3, 60)), (22, "é" * 60), (23, "z" + "é" * 60),
    ]


def documents(spark, rows=None, extra=False):
    rows = awkward_texts() if rows is None else rows
    schema = DOCS + (", kept string, score string, shard string" if extra else "")
    data = [(i, t, "en", "s", None if t is None else len(t)) + (("k", "s", "t") if extra else ())
            for i, t in rows]
    return spark.createDataFrame(data, T._parse_datatype_string(schema))


def raw(text: str | None) -> bytes:
    return (text or "").encode()


def components_of(n: int, links) -> list[int]:
    """Smallest index reachable, by plain union-find."""
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]
