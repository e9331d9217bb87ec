"""Multinomial naive Bayes with cross-validation from one table of counts.

Rows are cut into folds once. One pass counts terms by fold and class; what a fold's model learns from is the whole count
less the fold's own, so every fold and every smoothing comes from that table by subtraction, and no model is fitted twice.
Held-out rows meet the counts of their fold and term in one join, and each gets the scores of all smoothings at once: counts
travel to their row, and logarithms are taken there. A term that only its own fold has weighs alike in every class, so it stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.classifiers import ALPHAS
from quillspark.plans.shared import table

MOST_CLASSES = 1000


def _per_class(classes: list, label: str, value: Column) -> Column:
    return F.array(*[F.coalesce(F.sum(F.when(F.col(label) == c, value)), F.lit(0)) for c in classes])


class Counts:
    """Counts of (id, fold, label, words). Rows without words or label are left out. At most MOST_CLASSES labels; they, and a
    row of totals per fold, come to the driver."""

    def __init__(self, df: DataFrame, id_col: str, words: Column, label: str, fold: Column) -> None:
        # a row's text travels once, and its terms are counted where it arrives; _outer: the plain form would split each text twice
        rows = df.repartition(id_col).select(F.col(id_col).alias("id"), fold.alias("fold"), F.col(label).alias("label"), words.alias("words")).where("label IS NOT NULL")
        terms = rows.select("id", "fold", "label", F.posexplode_outer("words").alias("at", "term")).where("at IS NOT NULL")
        self.terms = table(terms.groupBy("id", "fold", "label", "term").agg(F.count("*").alias("tf")), "terms")
        self.classes = sorted(r[0] for r in self.terms.select("label").distinct().limit(MOST_CLASSES + 1).collect())
        if len(self.classes) > MOST_CLASSES:
            raise ValueError(f"more than {MOST_CLASSES} classes")
        by_fold = self.terms.groupBy("fold", "term").agg(_per_class(self.classes, "label", F.col("tf")).alias("own"))
        self.by_fold = table(by_fold, "fold-terms")
        sums = F.array(*[F.sum(F.get("own", F.lit(i))) for i in range(len(self.classes))])
        self.by_term = self.by_fold.groupBy("term").agg(sums.alias("all"))
        self.docs = table(self.terms.groupBy("fold", "label", "id").agg(F.sum("tf").alias("n")), "term-docs")
        docs = self.docs.groupBy("fold").agg(_per_class(self.classes, "label", F.lit(1)).alias("docs"), _per_class(self.classes, "label", F.col("n")).alias("words"))
        self.folds = {r.fold: (r.docs, r.words) for r in docs.collect()}
        self.vocabulary = self.by_fold.select("term").distinct().count()

    def totals(self, without=None) -> tuple[list[int], list[int]]:
        """Rows and words of each class, but for one fold's."""
        parts = [v for k, v in self.folds.items() if without is None or k != without]
        return tuple([sum(p[i][c] for p in parts) for c in range(len(self.classes))] for i in (0, 1))

    def scores(self, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
        """(id, fold, label, alpha, equal_priors, predicted) of every row, by the model that hasn't seen its fold. Of classes
        that score alike the least is predicted. equal_priors: whether classes count as equally likely, or by their rows."""
        k, n = len(self.classes), len(alphas)
        every = Window.partitionBy("term")  # a row per fold
        seen = F.array(*[F.sum(F.get("own", F.lit(c))).over(every) - F.get("own", F.lit(c)) for c in range(k)])
        seen = self.by_fold.select("fold", "term", seen.alias("seen")).where(F.exists("seen", lambda x: x > 0))
        hits = self.terms.join(seen, ["fold", "term"]).select("id", "fold", "label", "tf", "seen", F.lit(0).cast("long").alias("n"))
        none = F.array_repeat(F.lit(0).cast("long"), k)
        hits = hits.union(self.docs.select("id", "fold", "label", F.lit(0).cast("long"), none, "n")).repartition("id")
        rest = F.sum("n") - F.sum("tf")  # words that the fold's model hasn't seen
        log = lambda x: F.coalesce(F.log(x), F.lit(0.0))
        sums = F.array(*[F.sum(F.col("tf") * log(F.get("seen", F.lit(c)) + F.lit(a))) + rest * log(F.lit(a)) for a in alphas for c in range(k)])
        rows = hits.groupBy("id", "fold", "label").agg(sums.alias("sums"), F.sum("n").alias("size"))
        models = []
        for fold in self.folds:
            docs, words = self.totals(fold)
            for equal in (False, True):
                prior = [1.0 / k] * k if equal else [d / max(1, sum(docs)) for d in docs]
                models.append((fold, equal, prior, [[float(w + a * self.vocabulary) for w in words] for a in alphas]))
        kind = self.terms.schema["fold"].dataType.simpleString()
        models = self.terms.sparkSession.createDataFrame(models, f"fold {kind}, equal_priors boolean, prior array<double>, mass array<array<double>>")
        rows = rows.join(F.broadcast(models), "fold")  # two rows a fold

        def best(i: int) -> Column:
            score = [F.get("sums", F.lit(i * k + c)) - F.col("size") * F.log(F.get(F.get("mass", F.lit(i)), F.lit(c))) + F.coalesce(F.log(F.get("prior", F.lit(c))), F.lit(float("-inf"))) for c in range(k)]
            return F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-c).alias("class")) for c, s in enumerate(score)]))["class"]

        found = rows.select("id", "fold", "label", "equal_priors", F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), best(i).alias("c")) for i, a in enumerate(alphas)])).alias("s"))
        label = F.get(F.array(*map(F.lit, self.classes)), -F.col("s.c"))
        return found.select("id", "fold", "label", "s.alpha", "equal_priors", label.alias("predicted"))

    def search(self, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
        """(alpha, equal_priors, accuracy): the mean of the folds' accuracies."""
        by_fold = self.scores(alphas).groupBy("alpha", "equal_priors", "fold").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a"))
        return by_fold.groupBy("alpha", "equal_priors").agg(F.avg("a").alias("accuracy"))

    def model(self, alpha: float) -> DataFrame:
        """(term, weights): log-likelihoods of a term by class, in the order of classes, learnt from all rows."""
        mass = [float(w + alpha * self.vocabulary) for w in self.totals()[1]]
        return self.by_term.select("term", F.array(*[F.log((F.get("all", F.lit(c)) + F.lit(alpha)) / F.lit(m)) for c, m in enumerate(mass)]).alias("weights"))
