"""Quality by a sparse rule ensemble: paths of small trees over statistics of a text, weighed by lasso.

Every path from a root to a node of a forest is a rule: a conjunction of bounds on statistics. A logistic regression with
an L1 penalty over the rules, each holding or not, leaves a weight to few of them. Those are compiled into one Spark column
expression over the statistics, which are expressions over the text themselves; scoring is a map inside the JVM.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import stored

#: Labelled rows that the ensemble is fitted on, at most: those first by a hash of doc_id.
SAMPLE = 20_000
#: Trees of the forest, their depth, and rows that a node must hold; L1 penalty of the weights.
TREES, DEPTH, LEAST_ROWS, PENALTY = 24, 3, 5, 5e-4
#: Score from which a text counts as good.
GOOD = 0.7

_SPLIT = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


#: Counts in a text (`_text`), its words (`_words`: between white space) and its lines (`_lines`), in SQL.
COUNTS = {
    "chars": "length(_text)",
    "words": "size(_words)",
    "lines": "size(_lines)",
    "letters": r"length(_text) - length(regexp_replace(_text, r'\p{L}+', ''))",
    "capitals": r"length(regexp_replace(_text, r'\P{Lu}+', ''))",
    "digits": r"length(_text) - length(regexp_replace(_text, r'\p{N}+', ''))",
    "white": r"length(_text) - length(regexp_replace(_text, r'\s+', ''))",
    "commas": """length(_text) - length(translate(_text, ',;:()"\\'-', ''))""",
    "ends": "length(_text) - length(translate(_text, '.!?', ''))",
    "shouts": "length(_text) - length(translate(_text, '!', ''))",
    "different": "size(array_distinct(_words))",
    "different_lines": "size(array_distinct(_lines))",
    "echoes": "size(filter(zip_with(_words, slice(_words, 2, greatest(size(_words), 1)), (a, b) -> a = b), same -> same))",
    "letterless": r"size(filter(_words, w -> not w rlike r'\p{L}'))",
}
#: What rules bound, of those counts: a size, and shares of one count in another.
SIZE = "words"
SHARES = {
    "word_length": ("chars - white", "words"),
    "words_a_line": ("words", "lines"),
    "words_a_sentence": ("words", "ends"),
    "letters": ("letters", "chars"),
    "capitals": ("capitals", "letters"),
    "digits": ("digits", "chars"),
    "commas": ("commas", "words"),
    "shouts": ("shouts", "words"),
    "symbols": ("chars - letters - digits - white - commas - ends", "chars"),
    "different": ("different", "words"),
    "different_lines": ("different_lines", "lines"),
    "echoes": ("echoes", "words"),
    "letterless": ("letterless", "words"),
}
STATISTICS = {SIZE: f"double({SIZE})"} | {k: f"double({part}) / greatest({of}, 1)" for k, (part, of) in SHARES.items()}


def measured(df: DataFrame, text: str, *keep: str | Column) -> DataFrame:
    """The kept columns and `stats`, a struct of the statistics of each whole text; a null text is empty."""
    kept = df.select(F.struct(*keep).alias("_kept"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = F.filter(F.split("_text", "[\x20\x09-\x0d]+"), lambda w: w != "")
    cut = kept.select("_kept", "_text", words.alias("_words"), F.split("_text", "\n").alias("_lines"))
    counted = cut.select("_kept", *[F.expr(c).alias(k) for k, c in COUNTS.items()])
    return counted.select("_kept.*", F.struct(*[F.expr(c).alias(k) for k, c in STATISTICS.items()]).alias("stats"))


@dataclass(frozen=True, order=True)
class Bound:
    statistic: str
    above: bool
    value: float

    def column(self) -> Column:
        of = F.col("stats").getField(self.statistic)
        return of > self.value if self.above else of <= self.value

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.value:g}"


#: Bounds that all hold, the tightest of each kind.
Rule = tuple[Bound, ...]


def rule_column(rule: Rule) -> Column:
    out = rule[0].column()
    for bound in rule[1:]:
        out = out & bound.column()
    return out


def _tightest(path: list[Bound]) -> Rule:
    kept: dict[tuple[str, bool], Bound] = {}
    for b in path:
        was = kept.get((b.statistic, b.above))
        if was is None or (b.value > was.value if b.above else b.value < was.value):
            kept[b.statistic, b.above] = b
    return tuple(sorted(kept.values()))


def paths(tree: str, names: list[str]) -> list[Rule]:
    """The rules of all nodes below the root of a printed tree: the bounds on the way to each."""
    open_nodes: list[tuple[int, Bound]] = []
    rules = []
    for m in filter(None, map(_SPLIT.match, tree.splitlines())):
        indent = len(m[1])
        while open_nodes and open_nodes[-1][0] >= indent:
            open_nodes.pop()
        open_nodes.append((indent, Bound(names[int(m[2])], m[3] == ">", float(m[4]))))
        rules.append(_tightest([b for _, b in open_nodes]))
    return rules


@dataclass
class Ensemble:
    """Weighted rules and an intercept; without rules every text scores the intercept alone."""

    intercept: float
    weights: dict[Rule, float] = field(default_factory=dict)

    def column(self) -> Column:
        """Score from the column `stats`: the logistic function of the weights of the rules that hold."""
        total = F.lit(self.intercept)
        for rule, weight in self.weights.items():
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def scored(self, df: DataFrame, text: str, *keep: str | Column) -> DataFrame:
        """The kept columns and `score` of each row."""
        return measured(df, text, F.struct(*keep).alias("_own")).select("_own.*", self.column().alias("score"))


def held_out(doc_id: Column) -> Column:
    """Whether no label of this row may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame) -> Ensemble:
    """Fitted on at most SAMPLE labelled rows, none of them held out. Several labels of one id count as good if all are.

    Without both classes among them every text gets one score, the smoothed share of good rows.
    """
    known = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("known_id"))
        .agg(F.min(F.when(F.col("quality") == 1, 1.0).otherwise(0.0)).alias("label"))
        .orderBy(F.xxhash64("known_id"), "known_id")
        .limit(SAMPLE)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))  # SAMPLE rows of two numbers at most
    sample = stored(measured(rows, "text", "label"), "quality-sample")
    n, good = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < good < n:
        share = (good + 0.5) / (n + 1)
        return Ensemble(_logit(share))

    names = list(STATISTICS)
    sample = sample.coalesce(2)  # SAMPLE rows of numbers at most, read many times over
    table = sample.select("label", "stats.*")
    vectors = VectorAssembler(inputCols=names, outputCol="_stats").transform(table)
    forest = RandomForestClassifier(
        featuresCol="_stats", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_ROWS, featureSubsetStrategy="onethird", seed=7
    ).fit(vectors)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree.toDebugString, names)})
    if not rules:
        return Ensemble(_logit((good + 0.5) / (n + 1)))
    held = sample.select("label", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_rules").transform(held)
    linear = LogisticRegression(featuresCol="_rules", labelCol="label", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(held)
    return Ensemble(float(linear.intercept), {r: float(w) for r, w in zip(rules, linear.coefficients) if w})


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: better), predicted (1 from GOOD on).

    Every whole text is scored by its own statistics; null and empty texts have those of a text without words. Rows with a null
    id count as held out. Repeated rows stay; other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = fit(rows, labels).scored(rows, "text", "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted"))
