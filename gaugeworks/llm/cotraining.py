"""Quality classifier by co-training: a view of the text and a view of its page teach each other.

Each view has a logistic regression on features of its own, fitted by Spark on all labelled rows. In every
round each view labels the unlabelled rows it is sure of, and the other view is fitted again on the given
labels and these. A fold of labelled rows that no model sees calibrates each view; the calibrated views are
combined as independent evidence around the share of good texts. Every document is scored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import FeatureHasher
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import SPACE, let, saved

ROUNDS = 2
#: Probability beyond which a view's label is passed to the other view.
SURE = 0.98
#: A text is kept from this probability of being good on.
KEEP = 0.3
#: One labelled document in this many calibrates, chosen by a hash of its id.
FOLDS = 5
#: Labelled rows of each class, in training and in calibration, without which nothing is learnt.
LEAST_LABELS = 5
#: Slots that names of sources and languages are hashed to.
NAME_SLOTS = 64

#: Rows that a task goes through in each step of a fit; fewer would cost more to start than to do.
ROWS_PER_TASK = 20_000

VIEWS = ("content", "page")


def content_features(text: Column) -> Column:
    """Shares that describe how a text is written, as an array of doubles."""
    lines = F.split(text, "\n")

    def shares(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))
        chars = F.greatest(F.length(text), F.lit(1))
        full = F.filter(lines, lambda x: x.rlike(f"[^{SPACE}]"))
        ended = F.filter(full, lambda x: x.rlike(f"[.!?…:;][\")\\]»”']*[{SPACE}]*$"))
        return F.array(
            F.size(F.array_distinct(words)) / n,
            F.sqrt(F.size(F.array_distinct(words)) / n / F.log(n + 1.5)),
            F.length(F.array_join(words, "")) / n,
            F.regexp_count(text, F.lit("[#*$%&<>|]")) / n,
            F.regexp_count(text, F.lit("[!?]{2,}")) / n,
            F.regexp_count(text, F.lit("\\|")) / n,
            F.regexp_count(text, F.lit("\\p{Lu}")) / chars,
            F.regexp_count(text, F.lit("[0-9]")) / chars,
            F.size(ended) / F.greatest(F.size(full), F.lit(1)),
            F.size(F.array_distinct(full)) / F.greatest(F.size(full), F.lit(1)),
            F.log1p(F.size(words).cast("double")),
        )

    return let(F.array_remove(F.split(text, f"[{SPACE}]+"), ""), shares)


def page_features(text: Column, n_chars: Column) -> Column:
    """Extent and layout as the page's metadata tell them."""
    stated = F.coalesce(n_chars.cast("double"), F.length(text).cast("double"))
    lines = F.regexp_count(text, F.lit("\n")) + 1
    return F.array(F.log1p(F.greatest(stated, F.lit(0.0))), F.log1p(lines.cast("double")), F.log1p(F.greatest(stated, F.lit(0.0)) / lines))


def _numbers(docs: DataFrame, *own: str | Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        *own, content_features(text).alias("content"), page_features(text, F.col("n_chars")).alias("numbers"),
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
    )


def _vectors(numbers: DataFrame, *own: str) -> DataFrame:
    hasher = FeatureHasher(inputCols=["source", "lang"], outputCol="names", numFeatures=NAME_SLOTS)
    hashed = hasher.transform(numbers)
    page = F.concat("numbers", vector_to_array(F.col("names")))
    return hashed.select(*own, array_to_vector("content").alias("content"), array_to_vector(page).alias("page"))


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and the feature vectors ``content`` and ``page`` of each document; nulls count as empty."""
    return _vectors(saved(_numbers(docs, "doc_id"), "features"), "doc_id")


def _fit(rows: DataFrame, features: str) -> LogisticRegressionModel:
    """A model whose two classes weigh the same."""
    share, n = rows.agg(F.avg("label"), F.count(F.lit(1))).first()
    rows = rows.coalesce(-(-n // ROWS_PER_TASK))
    weighted = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    learner = LogisticRegression(featuresCol=features, weightCol="weight", regParam=0.001, maxIter=25)
    return learner.fit(weighted)


def _margin(rows: DataFrame, model: LogisticRegressionModel, view: str) -> DataFrame:
    model = model.copy()
    for name in (model.probabilityCol, model.predictionCol):
        model.set(name, "")
    model.set(model.rawPredictionCol, "_raw")
    return model.transform(rows).withColumn(f"{view}_margin", vector_to_array(F.col("_raw"))[1]).drop("_raw")


def _chance(margin: Column | str) -> Column:
    margin = F.col(margin) if isinstance(margin, str) else margin
    return 1 / (1 + F.exp(-margin))


def _scaled(rows: DataFrame, view: str) -> tuple[float, float]:
    """Slope (not below zero) and intercept that turn a view's margins into log odds, from held-out labels."""
    one = rows.select(array_to_vector(F.array(f"{view}_margin")).alias("margin"), "label")
    model = LogisticRegression(featuresCol="margin", regParam=0.001, maxIter=25).fit(one)
    slope = float(model.coefficients[0])
    if slope > 0:
        return slope, float(model.intercept)
    return 0.0, _log_odds(rows.agg(F.avg("label")).first()[0])


def _log_odds(share: float) -> float:
    import math

    return math.log(share / (1 - share))


def _enough(rows: DataFrame) -> bool:
    counts = rows.groupBy("held", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    return len(counts) == 4 and min(r["n"] for r in counts) >= LEAST_LABELS


def _held(known: DataFrame) -> Column:
    """The labelled rows that calibrate: one fold, of a class with few labels as many as leave enough on both sides."""
    mark = F.xxhash64(F.lit("fold"), "doc_id")
    place = F.struct(F.pmod(mark, F.lit(FOLDS)).alias("fold"), mark.alias("mark"))
    held = place["fold"] == 0
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(held).alias("held")).collect()
    for r in counts:
        wanted = min(max(r["held"], LEAST_LABELS), r["n"] - LEAST_LABELS)
        if wanted == r["held"] or wanted < LEAST_LABELS:
            continue
        last = known.filter(F.col("label") == r["label"]).select(place.alias("p")).orderBy("p").limit(wanted).agg(F.max("p")).first()[0]
        upto = place <= F.struct(F.lit(last["fold"]).alias("fold"), F.lit(last["mark"]).alias("mark"))
        held = F.when(F.col("label") == r["label"], upto).otherwise(held)
    return held


def _examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The featured documents, each with its label if it has one."""
    gold = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    )
    return saved(featured(docs).join(gold, "doc_id", "left"), "examples")


def _judge(examples: DataFrame, rounds: int, sure: float, keep: float) -> Callable[[DataFrame], DataFrame] | None:
    """What adds content_score, page_score, score and kept to featured rows; nothing where too few labels are."""
    known, pool = examples.filter("label IS NOT NULL"), examples.filter("label IS NULL")
    known = known.withColumn("held", _held(known))
    if not _enough(known):
        return None
    taught = known.filter("NOT held")
    models = {view: _fit(taught, view) for view in VIEWS}
    for _ in range(rounds):
        judged = reduce(lambda df, view: _margin(df, models[view], view), VIEWS, pool)
        found = {}
        for view, other in (VIEWS, VIEWS[::-1]):
            chance = _chance(f"{other}_margin")
            certain = judged.filter((chance >= sure) | (chance <= 1 - sure))
            lent = certain.select(view, (chance >= 0.5).cast("double").alias("label"))
            found[view] = _fit(taught.select(view, "label").unionByName(lent), view)
        models = found
    check = reduce(lambda df, view: _margin(df, models[view], view), VIEWS, known.filter("held"))
    prior = _log_odds(check.agg(F.avg("label")).first()[0])
    scales = {view: _scaled(check, view) for view in VIEWS}

    def judge(rows: DataFrame) -> DataFrame:
        scored = reduce(lambda df, view: _margin(df, models[view], view), VIEWS, rows)
        evidence = F.lit(prior)
        for view, (slope, start) in scales.items():
            odds = F.col(f"{view}_margin") * slope + start
            scored = scored.withColumn(f"{view}_score", _chance(odds))
            evidence = evidence + odds - prior
        return scored.withColumn("score", _chance(evidence)).withColumn("kept", F.col("score") >= keep)

    return judge


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, sure: float = SURE, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, content_score, page_score (calibrated), score and kept.

    ``docs`` has doc_id, text, lang, source, n_chars; ``labels`` has doc_id and quality (1 good, 0 bad). Of
    differing labels of one id the mean decides, good on a tie; rows without id or label teach nothing. Null
    texts are empty, other nulls a value of their own. Repeated rows are scored alike. Where a class has too
    few labels nothing can be learnt: the scores are null and every document is kept.
    """
    examples = _examples(docs, labels)
    judge = _judge(examples, rounds, sure, keep)
    if judge is None:
        empty = F.lit(None).cast("double")
        return examples.select(
            "doc_id", *[empty.alias(c) for c in ("content_score", "page_score", "score")], F.lit(True).alias("kept")
        )
    return judge(examples).select("doc_id", "content_score", "page_score", "score", "kept")


def keep_good(
    docs: DataFrame, labels: DataFrame, teachers: DataFrame | None = None, rounds: int = ROUNDS, sure: float = SURE, keep: float = KEEP
) -> DataFrame:
    """The documents that the classifier keeps; all columns of ``docs``.

    It learns from ``teachers``, the documents that ``labels`` are of (``docs`` if none are given). Each row is
    judged by itself, so rows that share an id, or have none, change nothing for each other.
    """
    judge = _judge(_examples(docs if teachers is None else teachers, labels), rounds, sure, keep)
    if judge is None:
        return docs
    rows = _vectors(_numbers(docs, F.struct("*").alias("row")), "row")
    return judge(rows).filter("kept").select("row.*")
