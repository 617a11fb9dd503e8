"""Features, folds, classifiers, and training of field weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tf_idf(tf: Column, df: Column, n: Column) -> Column:
    """sqrt(tf) (1 + ln(n / (df + 1))), with 1 for a missing tf and 0 for a missing df."""
    return F.sqrt(F.coalesce(tf, F.lit(1))) * (1 + F.ln(n / (F.coalesce(df, F.lit(0)) + 1)))


def surface(word: Column) -> tuple[Column, Column, Column]:
    """(has_num, caps_num, caps_ratio)"""
    caps = F.regexp_count(word, F.lit("[A-Z]"))
    return word.rlike("[0-9]"), caps, F.when(F.length(word) > 0, caps / F.length(word)).otherwise(0.0)


def scaled(rows: DataFrame, value: str, ctx: str) -> DataFrame:
    """Adds by_max, the value over its context's largest, and min_max, its place between least and largest; 0 where that is 0.

    The extremes of a context are combined before they are exchanged, and come back by a join: no context is brought into one task.
    """
    of = rows.groupBy(F.col(ctx).alias("__c")).agg(F.max(value).alias("__max"), F.min(value).alias("__min"))
    j = rows.join(of, F.col(ctx).eqNullSafe(F.col("__c")))
    v = F.col(value).cast("double")
    top, span = F.coalesce(F.try_divide(v, F.col("__max")), F.lit(0.0)), F.coalesce(F.try_divide(v - F.col("__min"), F.col("__max") - F.col("__min")), F.lit(0.0))
    return j.withColumns({"by_max": top, "min_max": span}).drop("__c", "__max", "__min")


def folds(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """Adds fold: contiguous parts in order, the first n mod k of them one longer."""
    from lectern.operators.ranks import tiles

    return tiles(rows, order, k, "fold").withColumn("fold", F.col("fold") - 1)


def manual_keywords(col: Column | str, stopwords: list[str]) -> Column:
    """Words of a typed list in small letters; stopwords and words of at most two letters are dropped."""
    ws = F.split(F.lower(col), r"\W+")
    return F.array_distinct(F.filter(ws, lambda t: (F.length(t) > 2) & ~t.isin(stopwords)))


def train_classifier(rows: DataFrame, words: str, label: str, buckets: int = 4096, classes: str = "logistic"):  # noqa: ANN201
    """A pipeline on hashed words: logistic regression, random forest or a perceptron by name. Rows without a label are left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import HashingTF, StringIndexer

    n = rows.select(label).where(F.col(label).isNotNull()).distinct().count()
    kinds = {
        "logistic": lambda: LogisticRegression(maxIter=30, regParam=0.01),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=6, seed=1),
        "perceptron": lambda: MultilayerPerceptronClassifier(layers=[buckets, 16, n], maxIter=20, seed=1),
    }
    model = kinds[classes]().setFeaturesCol("__features").setLabelCol("__label")
    steps = [HashingTF(inputCol=words, outputCol="__features", numFeatures=buckets), StringIndexer(inputCol=label, outputCol="__label", handleInvalid="skip"), model]
    return Pipeline(stages=steps).fit(rows.where(F.col(label).isNotNull() & F.col(words).isNotNull()))


def accuracy(model, rows: DataFrame) -> float:  # noqa: ANN001
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    return MulticlassClassificationEvaluator(labelCol="__label", metricName="accuracy").evaluate(model.transform(rows))


def greedy_weights(hits: DataFrame, matches: DataFrame, fields: list[str], moves: tuple[float, ...] = (-1, 6, -2), metric: str = "ndcg", smooth: bool = False) -> tuple[dict[str, float], float]:
    """Field weights by coordinate ascent from 1: each move of each field is tried, the best strictly better one taken, for as many rounds as any
    improves; weights stay at or above 0. All moves of a field are evaluated in one job over per-field partial sums, which are written once.
    """
    from lectern.operators.metrics import measure
    from lectern.plans.session import written

    part = written(hits.groupBy("query_id", "guid", "field").agg(F.sum(F.col("qw") * F.col("fw")).alias("s")), "partial")
    wide = written(part.groupBy("query_id", "guid").pivot("field", fields).agg(F.sum("s")).na.fill(0.0), "wide")

    def value(options: list[dict[str, float]]) -> list[float]:
        scored = None
        for i, w in enumerate(options):
            s = sum((F.col(f"`{f}`") * F.lit(float(w[f])) for f in fields), F.lit(0.0))
            one = wide.select(F.struct(F.lit(i).alias("o"), F.col("query_id").alias("q")).alias("query_id"), "guid", s.alias("score")).where("score > 0")
            scored = one if scored is None else scored.unionByName(one)
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "guid")
        m = None
        for i in range(len(options)):
            one = matches.select(F.struct(F.lit(i).alias("o"), F.col("query_id").alias("q")).alias("query_id"), "guid")
            m = one if m is None else m.unionByName(one)
        got = measure(scored.withColumn("rank", F.row_number().over(w)).where("rank <= 200"), m).groupBy("query_id.o").agg(F.avg(metric).alias("v")).collect()
        by = {r["o"]: r["v"] for r in got}
        return [by.get(i, 0.0) for i in range(len(options))]

    weights = dict.fromkeys(fields, 1.0)
    best = value([weights])[0]
    while True:
        better = False
        for f in fields:
            options = [weights | {f: max(0.0, weights[f] + m)} for m in moves]
            got = value(options)
            k = max(range(len(got)), key=got.__getitem__)
            if got[k] > best:
                weights, best, better = options[k], got[k], True
        if not better:
            break
    if smooth:
        weights = {f: min(1.0, w) / 3 if w < 1 else w for f, w in weights.items()}
    return weights, best


def annotate(model, rows: DataFrame, label: str, out: str = "predicted") -> DataFrame:  # noqa: ANN001
    """Rows with the label that a trained pipeline gives them; for sentences (zones) and for citations (functions) alike."""
    from pyspark.ml.feature import IndexToString

    names = next(s for s in model.stages if hasattr(s, "labels")).labels
    got = model.transform(rows.withColumn("__had", F.col(label) if label in rows.columns else F.lit(None).cast("string")).withColumn(label, F.lit(names[0])))
    got = got.withColumn(label, F.col("__had")) if label in rows.columns else got
    return IndexToString(inputCol="prediction", outputCol=out, labels=names).transform(got).select(*rows.columns, out)


def cross_validated(rows: DataFrame, order: list[str], words: str, label: str, k: int = 3, classes: str = "logistic") -> DataFrame:
    """(fold, n, accuracy): a classifier trained on the other contiguous folds and measured on each."""
    t = folds(rows.where(F.col(label).isNotNull() & F.col(words).isNotNull()), order, k)
    out = []
    for f in range(k):
        test = t.where(F.col("fold") == f)
        out.append((f, test.count(), accuracy(train_classifier(t.where(F.col("fold") != f), words, label, classes=classes), test)))
    return rows.sparkSession.createDataFrame(out, "fold int, n bigint, accuracy double")


def citation_features(citations: DataFrame) -> DataFrame:
    """(doc, cit_id, features): what a classifier of citation functions reads - words of the sentence, place in the document, self-citation, number cited together.

    Needs doc, cit_id, text, ord, last_ord, is_self, multi.
    """
    from lectern.functions import text as X

    place = F.concat(F.lit("place_"), F.least(F.floor(F.try_divide(F.col("ord") * 10, F.col("last_ord"))), F.lit(9)).cast("string"))
    extra = F.array(place, F.when(F.col("is_self"), "self").otherwise("other"), F.when(F.col("multi") > 1, "many").otherwise("one"))
    return citations.select("doc", "cit_id", F.concat(X.without_stopwords(X.tokens("text")), F.filter(extra, lambda x: x.isNotNull())).alias("features"))
