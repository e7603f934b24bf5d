"""Mining of document texts and feed rows."""

from pyspark.sql import functions as F

from tablewright.functions.expressions import readable_size
from tablewright.operators import text
from tablewright.plans.base import plan, table
from tablewright.sources import feeds

# The shared documents are invented prose, so the caller-supplied patterns name words that occur
# in it; the built-in families are scanned by the same code in ``default_mentions``.
PATTERNS = (
    ("Thin", r"\bth(?:e|at|is)\b"),
    ("Ution", r"\b\w+tion\b"),
    ("Quick", r"\bles?\b"),
    ("Ending", r"\bering\s+\w+"),
    ("Rare", r"\bworthless\b"),
)
WEIGHT = r"\b(?:with|pour)\b"
HINTS = (
    ("alpha", r"\bwith\s+(\w+)", "0.01-0.3"),
    ("beta", r"\bfrom\s+(\w+)", "3-10"),
)
TIPS = (("first", r"\bof\s+the\b"), ("second", r"\bde\s+la\b"))


def _documents(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("title"), F.col("text").alias("abstract"), "lang"
    )


DOCS = "d AS (SELECT doc_id, source AS title, text AS abstract, lang FROM documents)"
BODY = "(title || ' ' || abstract)"


def _match(column, pattern):
    """The pattern in SQL, with word boundaries and word characters of every script."""
    edge = r"[^\pL\pN\pM_]"
    wide = pattern.replace(r"\w", r"[\pL\pN\pM_]")
    if wide.startswith(r"\b"):
        wide = f"(?:^|{edge})" + wide[2:]
    if wide.endswith(r"\b"):
        wide = wide[:-2] + f"(?:$|{edge})"
    return f"regexp_matches({column}, '(?i){wide}')"


def _found(patterns, column=BODY):
    return (
        "list_filter(["
        + ", ".join(
            f"CASE WHEN {_match(column, p)} THEN '{n}' END" for n, p in patterns
        )
        + "], lambda x: x IS NOT NULL)"
    )


@plan(
    "document_mentions", "K1 K2",
    f"""WITH {DOCS} SELECT doc_id, unnest({_found(PATTERNS)}) AS family,
 CASE WHEN {_match(BODY, WEIGHT)} THEN 2 ELSE 1 END AS weight FROM d""",
)
def document_mentions(spark, folder):
    body = text.combined_text()
    return text.document_mentions(
        _documents(spark, folder), body, text.paper_weight(body, WEIGHT), PATTERNS
    )


@plan(
    "mention_counts", "K1 K2",
    f"""WITH {DOCS}, m AS (SELECT unnest({_found(PATTERNS)}) AS family,
 CASE WHEN doc_id % 20 >= 10 THEN 2 ELSE 1 END AS weight FROM d)
 SELECT family, CAST(sum(weight) AS BIGINT) AS mentions FROM m GROUP BY 1""",
)
def mention_counts(spark, folder):
    found = text.document_mentions(
        _documents(spark, folder), text.combined_text(),
        text.notebook_weight(F.col("doc_id") % 20), PATTERNS,
    )
    return text.mention_counts(found)


@plan(
    "default_mentions", "K1",
    f"""WITH {DOCS} SELECT doc_id, unnest({_found(text.MODEL_PATTERNS)}) AS family,
 CASE WHEN {_match(BODY, text.SOTA_PATTERN)} THEN 2 ELSE 1 END AS weight FROM
 (SELECT doc_id, title, CASE WHEN doc_id % 3 = 0 THEN abstract || ' a Random Forest benchmark'
 WHEN doc_id % 3 = 1 THEN abstract || ' gradient boosted XGBoost' ELSE abstract END AS abstract
 FROM d)""",
)
def default_mentions(spark, folder):
    docs = _documents(spark, folder).withColumn(
        "abstract",
        F.concat(
            "abstract",
            F.when(F.col("doc_id") % 3 == 0, " a Random Forest benchmark")
            .when(F.col("doc_id") % 3 == 1, " gradient boosted XGBoost")
            .otherwise(""),
        ),
    )
    body = text.combined_text()
    return text.document_mentions(docs, body, text.paper_weight(body))


_HINT_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, m[1] AS model, {i} AS position, '{n}' AS param, '{s}' AS suggested_range "
    f"FROM h WHERE {_match('abstract', p)}"
    for i, (n, p, s) in enumerate(HINTS)
)


@plan(
    "hyperparameter_hints", "K3",
    f"""WITH {DOCS}, h AS (SELECT doc_id, abstract, {_found(PATTERNS)} AS m FROM d
 WHERE len({_found(PATTERNS)}) > 0) {_HINT_ROWS}""",
)
def hyperparameter_hints(spark, folder):
    return text.hyperparameter_hints(_documents(spark, folder), PATTERNS, HINTS)


_TIP_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, 'Referenced in: ' || substr(title, 1, 80) AS reason, {i} AS position, "
    f"'{n}' AS technique FROM d WHERE {_match(BODY, p)}"
    for i, (n, p) in enumerate(TIPS)
)


@plan("feature_tips", "K4", f"WITH {DOCS} {_TIP_ROWS}")
def feature_tips(spark, folder):
    return text.feature_tips(_documents(spark, folder), TIPS)


@plan(
    "notebook_strategies", "K5",
    f"""WITH {DOCS}, t AS (SELECT doc_id, substr(abstract, 1, 200) AS title FROM d)
 SELECT doc_id, array_to_string({_found(PATTERNS, 'title')}, ', ') || ' approach' AS approach,
 'Kaggle: ' || substr(title, 1, 80) AS source FROM t
 WHERE len({_found(PATTERNS, 'title')}) > 0""",
)
def notebook_strategies(spark, folder):
    docs = _documents(spark, folder).select(
        "doc_id", F.substring("abstract", 1, 200).alias("title")
    )
    return text.notebook_strategies(docs, PATTERNS)


@plan(
    "paper_strategies", "K5",
    f"""WITH {DOCS} SELECT doc_id, array_to_string({_found(PATTERNS)}, ', ') || ' for ' || lang ||
 ', ' || title AS approach, 'PwC: ' || substr(title, 1, 80) AS source FROM d
 WHERE len({_found(PATTERNS)}) > 0""",
)
def paper_strategies(spark, folder):
    docs = _documents(spark, folder).withColumn("tasks", F.array("lang", "title", F.lit("more")))
    return text.paper_strategies(docs, PATTERNS)


@plan(
    "first_hints", "K6",
    f"""WITH {DOCS}, h AS (SELECT doc_id, abstract, {_found(PATTERNS)} AS m FROM d
 WHERE len({_found(PATTERNS)}) > 0), a AS ({_HINT_ROWS})
 SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY model, param ORDER BY doc_id,
 position) = 1""",
)
def first_hints(spark, folder):
    hints = text.hyperparameter_hints(_documents(spark, folder), PATTERNS, HINTS)
    return text.first_per_key(hints, ["model", "param"])


@plan(
    "first_tips", "K6",
    f"""WITH {DOCS}, a AS ({_TIP_ROWS}) SELECT * FROM a QUALIFY row_number() OVER
 (PARTITION BY technique ORDER BY doc_id, position) = 1""",
)
def first_tips(spark, folder):
    return text.first_per_key(
        text.feature_tips(_documents(spark, folder), TIPS), ["technique"]
    )


@plan(
    "model_recommendations", "K7",
    f"""WITH {DOCS}, c AS (SELECT family, sum(n) AS n FROM (SELECT unnest({_found(PATTERNS)})
 AS family, 1 AS n FROM d UNION ALL SELECT unnest(['XGBoost', 'LightGBM', 'CatBoost']), 3)
 GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY n DESC, family) AS INTEGER) AS rank,
 family AS name, CAST(n AS BIGINT) AS score, CASE WHEN concat_ws('; ', a, b) = '' THEN
 'referenced in related research' ELSE concat_ws('; ', a, b) END AS reason,
 CASE WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM
 (SELECT *, CASE WHEN n >= 3 THEN 'mentioned ' || n || 'x in research' END AS a,
 CASE WHEN family IN ('XGBoost', 'LightGBM') THEN 'scales well to large datasets'
 WHEN family = 'CatBoost' THEN 'handles categorical features natively' END AS b FROM c)""",
)
def model_recommendations(spark, folder):
    found = text.document_mentions(
        _documents(spark, folder), text.combined_text(), None, PATTERNS
    )
    return text.model_recommendations(text.mention_counts(found), 50_000, 10, 4)


@plan(
    "readable_sizes", "A6",
    # text formatting of an exact tie goes to the even digit on both sides
    """WITH s AS (SELECT doc_id, n_chars * n_chars * (doc_id % 1000) AS b FROM documents)
 SELECT doc_id, CASE WHEN b <= 0 THEN 'unknown'
 WHEN b >= 1099511627776 THEN printf('%.1f TB', b / 1099511627776.0e0)
 WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0e0)
 WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0e0)
 WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0e0)
 ELSE CAST(b AS VARCHAR) || ' B' END AS size FROM s""",
)
def readable_sizes(spark, folder):
    total = F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 1000)
    return table(spark, folder, "documents").select("doc_id", readable_size(total).alias("size"))


@plan(
    "notebook_feed", "A6",
    """SELECT 'Notebook ' || event_id AS title, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'user ' ||
 user_id END AS author, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'https://www.kaggle.com/code/' ||
 event_type || '/' || event_id END AS url, value AS score, 'unknown' AS language FROM events""",
)
def notebook_feed(spark, folder):
    """JSON lists built from events, with absent keys."""
    e = table(spark, folder, "events")
    item = F.struct(
        F.concat(F.lit("Notebook "), F.col("event_id").cast("string")).alias("title"),
        F.when(
            F.col("event_id") % 3 != 0,
            F.concat(F.lit("user "), F.col("user_id").cast("string")),
        ).alias("author"),
        F.when(
            F.col("event_id") % 5 != 0,
            F.concat_ws("/", "event_type", F.col("event_id").cast("string")),
        ).alias("ref"),
        F.col("value").alias("totalVotes"),
    )
    return feeds.notebook_rows(e.select(F.to_json(F.array(item)).alias("body")))


@plan(
    "dataset_feed", "A6",
    """SELECT CASE WHEN doc_id % 4 = 0 THEN source ELSE 'Set ' || doc_id END AS title,
 lang AS description, 'https://www.kaggle.com/datasets/' || source AS url,
 CASE WHEN n_chars >= 1024 THEN printf('%.1f KB', n_chars / 1024.0e0)
 ELSE n_chars || ' B' END AS size, 0 AS download_count FROM documents""",
)
def dataset_feed(spark, folder):
    d = table(spark, folder, "documents")
    item = F.struct(
        F.when(
            F.col("doc_id") % 4 != 0, F.concat(F.lit("Set "), F.col("doc_id").cast("string"))
        ).alias("title"),
        F.col("source").alias("ref"),
        F.col("lang").alias("description"),
        F.col("n_chars").alias("totalBytes"),
    )
    lists = d.select(F.to_json(F.array(item)).alias("body"))
    return feeds.dataset_rows(lists).withColumn(
        "download_count", F.col("download_count").cast("int")
    )


@plan(
    "paper_feed", "A6",
    """SELECT source AS title, lang AS abstract, CASE WHEN doc_id % 2 = 0 THEN
 'https://paperswithcode.com/paper/' || doc_id ELSE 'http://x/' || doc_id END AS url,
 CAST(NULL AS VARCHAR) AS url_pdf, CAST(NULL AS VARCHAR) AS proceeding,
 lang || ',' || source AS tasks FROM documents""",
)
def paper_feed(spark, folder):
    """Responses with tasks as plain names and as objects."""
    d = table(spark, folder, "documents")
    key = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit('{"count": 1, "results": [{"id": "'), key, F.lit('", "title": "'), "source",
        F.lit('", "abstract": "'), "lang", F.lit('", "url_abs": "'),
        F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("http://x/"), key)),
        F.lit('", "url_pdf": "", "tasks": ["'), "lang", F.lit('", {"name": "'), "source",
        F.lit('"}]}]}'),
    )
    rows = feeds.paper_rows(d.select(body.alias("body")))
    return rows.withColumn("tasks", F.array_join("tasks", ","))


@plan(
    "atom_feed", "A5",
    """SELECT source || ' ' || doc_id AS title, lang AS abstract, 'Ann,Bo ' || doc_id AS authors,
 CASE WHEN doc_id % 2 = 0 THEN 'http://page/' || doc_id ELSE 'http://id/' || doc_id END AS url,
 '2024-01-01' AS published, lang || ',cs.LG' AS categories FROM documents""",
)
def atom_feed(spark, folder):
    """Atom entries built from documents, parsed with from_xml."""
    d = table(spark, folder, "documents")
    key = F.col("doc_id").cast("string")
    xml = F.concat(
        F.lit("<entry><title> "), "source", F.lit("\n"), key, F.lit("</title><summary>"), "lang",
        F.lit("</summary><published>2024-01-01</published><id>http://id/"), key,
        F.lit("</id><author><name>Ann</name></author><author><name> Bo "), key,
        F.lit("</name></author>"),
        F.when(
            F.col("doc_id") % 2 == 0,
            F.concat(
                F.lit('<link href="http://pdf" rel="related" type="application/pdf"/>'
                      '<link href="http://page/'), key, F.lit('" rel="alternate"/>'),
            ),
        ).otherwise(""),
        F.lit('<arxiv:primary_category term="'), "lang",
        F.lit('"/><category term="'), "lang", F.lit('"/><category term="cs.LG"/></entry>'),
    )
    parsed = d.select(F.from_xml(xml, feeds.ATOM_SCHEMA).alias("e")).select("e.*")
    rows = feeds.atom_rows(parsed)
    return rows.withColumn("authors", F.array_join("authors", ",")).withColumn(
        "categories", F.array_join("categories", ",")
    )


