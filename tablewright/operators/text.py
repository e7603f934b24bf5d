"""Mining of research documents: model mentions, hints, tips, strategies, recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.core import col

# fixed values: model families and their patterns, matched without case, in this order
MODEL_PATTERNS = (
    ("TabPFN", r"\bTabPFN\b"),
    ("CatBoost", r"\bCatBoost\b"),
    ("LightGBM", r"\bLightGBM\b"),
    ("XGBoost", r"\bXGBoost\b"),
    ("Random Forest", r"\brandom\s*forest\b"),
    ("Gradient Boosting", r"\bgradient\s*boost(?:ing|ed)?\b"),
    ("Neural Network", r"\bneural\s*net(?:work)?s?\b"),
    ("Transformer", r"\btransformer\b"),
    ("Ensemble", r"\bensemble\b"),
    ("Stacking", r"\bstacking\b"),
)
# The phrases, hints and tips that are searched for.
SOTA_PATTERN = r"\b(?:state[- ]of[- ]the[- ]art|SOTA|benchmark|best[- ]performing)\b"
HINT_PATTERNS = (
    ("learning_rate", r"\blearning[_ ]rate\b.*?(\d+\.?\d*(?:e[+-]?\d+)?)", "0.01-0.3"),
    ("max_depth", r"\bmax[_ ]depth\b.*?(\d+)", "3-10"),
    ("n_estimators", r"\bn[_ ]estimators?\b.*?(\d+)", "100-1000"),
    ("num_leaves", r"\bnum[_ ]leaves\b.*?(\d+)", "31-255"),
)
TIP_PATTERNS = (
    ("feature_engineering", r"\bfeature\s+(?:engineering|selection|importance)\b"),
    ("target_encoding", r"\btarget\s+encoding\b"),
)
POPULAR_VOTES = 10
Patterns = Sequence[tuple[str, str]]


def matches(text: Column, pattern: str) -> Column:
    """Search without case; letters of every script count as word characters."""
    return F.coalesce(text.rlike("(?iU)" + pattern), F.lit(False))


def mentions(text: Column, patterns: Patterns = MODEL_PATTERNS) -> Column:
    """Array of the families found in a text, each once, in pattern order.

    One search for any of the patterns comes first: most texts have none and need no other.
    """
    hits = [F.when(matches(text, p), F.lit(name)) for name, p in patterns]
    some = matches(text, "|".join(f"(?:{p})" for _, p in patterns))
    return F.when(some, F.array_compact(F.array(*hits))).otherwise(
        F.array().cast("array<string>"))


def combined_text() -> Column:
    return F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))


def paper_weight(text: Column, pattern: str = SOTA_PATTERN) -> Column:
    return F.when(matches(text, pattern), 2).otherwise(1)


def notebook_weight(votes: Column) -> Column:
    return F.when(votes >= POPULAR_VOTES, 2).otherwise(1)


def document_mentions(
    docs: DataFrame, text: Column, weight: Column | None = None,
    patterns: Patterns = MODEL_PATTERNS,
) -> DataFrame:
    """Rows ``doc_id, family, weight``, one per family and document; a narrow map over the scan."""
    return docs.select(
        F.col("doc_id"),
        (weight if weight is not None else F.lit(1)).cast("int").alias("weight"),
        F.explode(mentions(text, patterns)).alias("family"),
    )


def mention_counts(found: DataFrame) -> DataFrame:
    """Weighted mentions per family (a handful of groups, combined map-side)."""
    return found.groupBy("family").agg(F.sum("weight").alias("mentions"))


def hyperparameter_hints(
    docs: DataFrame, patterns: Patterns = MODEL_PATTERNS, hints=HINT_PATTERNS
) -> DataFrame:
    """Hints of documents that mention a family; attributed to the first family found."""
    found = docs.select(
        "doc_id", F.col("abstract"), mentions(combined_text(), patterns).alias("_m")
    ).where(F.size("_m") > 0)
    options = F.array_compact(
        F.array(
            *[
                F.when(
                    matches(F.col("abstract"), pattern),
                    F.struct(
                        F.lit(i).alias("position"), F.lit(name).alias("param"),
                        F.lit(scope).alias("suggested_range"),
                    ),
                )
                for i, (name, pattern, scope) in enumerate(hints)
            ]
        )
    )
    return found.select(
        "doc_id", F.element_at("_m", 1).alias("model"), F.inline(options)
    )


def feature_tips(docs: DataFrame, tips: Patterns = TIP_PATTERNS) -> DataFrame:
    """Technique rows with the title as reason."""
    text = combined_text()
    options = F.array_compact(
        F.array(
            *[
                F.when(
                    matches(text, p),
                    F.struct(F.lit(i).alias("position"), F.lit(name).alias("technique")),
                )
                for i, (name, p) in enumerate(tips)
            ]
        )
    )
    reason = F.concat(F.lit("Referenced in: "), F.substring("title", 1, 80))
    return docs.select("doc_id", reason.alias("reason"), F.inline(options))


def notebook_strategies(docs: DataFrame, patterns: Patterns = MODEL_PATTERNS) -> DataFrame:
    """``A, B approach`` per notebook title that names a family."""
    found = docs.withColumn("_m", mentions(F.col("title"), patterns)).where(F.size("_m") > 0)
    return found.select(
        "doc_id",
        F.concat(F.array_join("_m", ", "), F.lit(" approach")).alias("approach"),
        F.concat(F.lit("Kaggle: "), F.substring("title", 1, 80)).alias("source"),
    )


def paper_strategies(docs: DataFrame, patterns: Patterns = MODEL_PATTERNS) -> DataFrame:
    """``A, B for task1, task2`` per paper with families and tasks (``tasks`` is an array)."""
    found = docs.withColumn("_m", mentions(combined_text(), patterns)).where(
        (F.size("_m") > 0) & (F.size("tasks") > 0)
    )
    return found.select(
        "doc_id",
        F.concat(
            F.array_join("_m", ", "), F.lit(" for "), F.array_join(F.slice("tasks", 1, 2), ", ")
        ).alias("approach"),
        F.concat(F.lit("PwC: "), F.substring("title", 1, 80)).alias("source"),
    )


def first_per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First row per key in document order: a smallest-struct aggregate, combined map-side."""
    order = [c for c in ("doc_id", "position") if c in rows.columns]
    others = [c for c in rows.columns if c not in keys]
    rest = [c for c in others if c not in order]
    first = F.min(F.struct(*[col(c) for c in [*order, *rest]]))
    return rows.groupBy(*[col(k) for k in keys]).agg(first.alias("_f")).select(
        *[col(k) for k in keys], *[F.col("_f")[c].alias(c) for c in others]
    )


def model_recommendations(
    counts: DataFrame, n_rows: int | None = None, n_cols: int = 0, n_categorical: int = 0
) -> DataFrame:
    """Ranked families from mention counts and boosts for the size and kind of the dataset."""
    boosts: list[tuple[str, int]] = []
    if n_rows is not None:
        if n_rows < 10_000 and n_cols < 100:
            boosts.append(("TabPFN", 5))
        if n_rows >= 10_000:
            boosts += [("XGBoost", 3), ("LightGBM", 3)]
        if n_categorical > 0 and n_categorical >= n_cols * 0.3:
            boosts.append(("CatBoost", 3))
    total = counts.select("family", F.col("mentions").cast("long"))
    if boosts:
        from tablewright.core import local_rows

        total = total.unionByName(
            local_rows(counts.sparkSession, boosts, "family string, mentions long")
        )
    total = total.groupBy("family").agg(F.sum("mentions").alias("score")).where("score > 0")
    score, family = F.col("score"), F.col("family")
    parts = [
        F.when(
            score >= 3,
            F.concat(F.lit("mentioned "), score.cast("string"), F.lit("x in research")),
        )
    ]
    if n_rows is not None:
        small, large = n_rows < 10_000 and n_cols < 100, n_rows >= 10_000
        parts.append(
            F.when((family == "TabPFN") & F.lit(small), "strong on small tabular datasets")
            .when(
                family.isin("XGBoost", "LightGBM") & F.lit(large),
                "scales well to large datasets",
            )
            .when(
                (family == "CatBoost") & F.lit(n_categorical > 0),
                "handles categorical features natively",
            )
        )
    reason = F.concat_ws("; ", *parts)
    confidence = F.when(score >= 5, "high").when(score >= 2, "medium").otherwise("low")
    w = Window.partitionBy(F.lit(0)).orderBy(score.desc(), family)  # one row per family
    return total.select(
        F.row_number().over(w).alias("rank"),
        family.alias("name"),
        score,
        F.when(reason == "", "referenced in related research").otherwise(reason).alias("reason"),
        confidence.alias("confidence"),
    )
