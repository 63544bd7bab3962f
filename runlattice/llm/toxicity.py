"""Toxicity by weak supervision: voters, a generative label model over their votes, a linear classifier on its posteriors.

Voters are lists of words (some fixed, most learned from labelled rows) and patterns of writing; each votes toxic, clean, or
not at all. The label model takes the true class as hidden. It estimates by expectation maximisation how each voter votes in
each class, finds voters that go together beyond what the class explains, gives those joint tables instead of counting them
twice, and estimates again. The human label is one more voter, held to be mostly right. A logistic regression over words
is then trained on the posteriors, each row counting for both classes by its share, and scores whole texts. Its terms are
words, and stems that enough of the text's words begin with: a stem that comes now and then by chance in a long text says
nothing, the same number of times in a short one it does.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlattice.llm.common import stored
from runlattice.session import shared_folder

#: Labelled rows that the model is fitted on, at most: those first by a hash of doc_id.
SAMPLE = 20_000
#: Learned words and the lists they are dealt to; learned stems; terms of the classifier, and rows that must hold one.
LEARNED, LISTS, STEMS, VOCABULARY, LEAST_ROWS = 120, 12, 24, 4096, 4
#: Log odds, and standard errors of them, from which a term votes.
VOTES_ODDS, VOTES_Z = 3.0, 3.0
#: Lengths of stems; a stem speaks if so many words of a text, and such a share of them, begin with it.
STEM_LENGTHS, STEM_WORDS, STEM_SHARE = (4, 5), 2, 0.0075
#: Correlation inside a class from which two voters share one table; voters in such a table at most.
TOGETHER, JOINT = 0.25, 4

# Words of abuse by kind, and patterns of writing.
INSULTS = ["idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "imbecile", "pathetic", "worthless"]
CONTEMPT = ["trash", "garbage", "scum", "vermin", "filth", "disgusting", "vile", "subhuman", "parasite", "pig"]
THREATS = ["kill", "hate", "die", "destroy", "hang", "burn", "beat", "shoot"]
SHOUTING = r"(?:\b\p{Lu}{3,}\b\W+){4}"
EXCLAIMING = r"!{3,}|(?:![^!]{1,40}){4}"
MASKED = r"\b\p{L}+[*#@$]{2,}\p{L}*\b"
ADDRESSED = r"(?i)\byou(?:r|'re| are)?\s+(?:\w+\s+){0,2}(?:idiot|moron|fool|loser|clown|scum|trash)"


def words_of(text: Column) -> Column:
    """The lower-case words of a text in order: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _stem(length: int, word: Column) -> Column:
    return F.when(F.length(word) > length, F.concat(F.left(word, F.lit(length)), F.lit("-"))).otherwise("")


def stems_of(words: Column) -> Column:
    """The stems of each word with a dash after them, one a length; empty where the word is no longer than that."""
    return F.concat(*[F.transform(words, partial(_stem, n)) for n in STEM_LENGTHS])


def padded(words: Column) -> Column:
    """The words, with empty ones up to the length at which STEM_WORDS words are the share that speaks."""
    return F.concat(words, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(int(STEM_WORDS / STEM_SHARE)) - F.size(words))))


def held_out(doc_id: Column) -> Column:
    """Whether no label of this row may be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _speaks(n: Column, n_words: Column) -> Column:
    return (n >= STEM_WORDS) & (n >= n_words * STEM_SHARE)


def _begins(stem: str, word: Column) -> Column:
    return word.startswith(stem) & (F.length(word) > len(stem))


def _voters(words: list[str], stems: list[str]) -> dict[str, Column]:
    """Votes by name: 1 toxic, 2 clean, 0 none. Columns `words` (different ones), `in_order` (all) and `text` are theirs to read."""

    def has(some: list[str]) -> Column:
        return F.arrays_overlap("words", F.array(*map(F.lit, some))) if some else F.lit(False)

    def toxic(found: Column) -> Column:
        return F.when(found, 1).otherwise(0)

    lists = {f"learned_{i}": toxic(has(words[i::LISTS])) for i in range(LISTS) if words[i::LISTS]}
    for stem in stems:
        n = F.size(F.filter("in_order", partial(_begins, stem[:-1])))
        lists[f"stem_{stem}"] = toxic(_speaks(n, F.size("in_order")))
    fixed = {"insults": toxic(has(INSULTS)), "contempt": toxic(has(CONTEMPT)), "threats": toxic(has(THREATS))}
    patterns = {n: toxic(F.col("text").rlike(p)) for n, p in (("shouting", SHOUTING), ("exclaiming", EXCLAIMING), ("masked", MASKED), ("addressed", ADDRESSED))}
    hits = F.size(F.array_intersect("words", F.array(*map(F.lit, words)))) if words else F.lit(0)
    clean = {"nothing_learned": F.when(hits == 0, 2).otherwise(0), "nothing_fixed": F.when(has(INSULTS + CONTEMPT), 0).otherwise(2)}
    several = {"several_learned": F.when(hits >= 2, 1).otherwise(0)}
    return lists | fixed | patterns | clean | several


@dataclass
class LabelModel:
    """Groups of voters with their tables: table[g][y, code of the group's votes] is a probability."""

    groups: list[list[int]]
    tables: list[np.ndarray]
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row of votes."""
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for group, t in zip(self.groups, self.tables):
            logs += np.log(t[:, _codes(votes, group)]).T
        logs -= logs.max(1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(1)


def _codes(votes: np.ndarray, group: list[int]) -> np.ndarray:
    code = np.zeros(len(votes), np.int64)
    for j in group:
        code = code * 3 + votes[:, j]
    return code


def _maximised(votes: np.ndarray, p: np.ndarray, groups: list[list[int]]) -> LabelModel:
    tables = []
    for group in groups:
        code, size = _codes(votes, group), 3 ** len(group)
        t = np.stack([np.bincount(code, weights=w, minlength=size) for w in (1 - p, p)]) + 1.0 / size
        tables.append(t / t.sum(1, keepdims=True))
    return LabelModel(groups, tables, float((p.sum() + 1) / (len(p) + 2)))


def _estimated(votes: np.ndarray, p: np.ndarray, groups: list[list[int]], rounds: int = 50) -> tuple[LabelModel, np.ndarray]:
    for _ in range(rounds):
        model = _maximised(votes, p, groups)
        new = model.posterior(votes)
        done = np.abs(new - p).max() < 1e-6
        p = new
        if done:
            break
    return model, p


def correlations(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Correlation of each two voters that is left inside the classes: the larger of the two classes' by size."""
    cast = np.where(votes == 1, 1.0, np.where(votes == 2, -1.0, 0.0))
    out = np.zeros((votes.shape[1],) * 2)
    for w in (1 - p, p):
        if w.sum() < 10:
            continue
        centred = cast - np.average(cast, axis=0, weights=w)
        cov = (centred * w[:, None]).T @ centred / w.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        found = np.where((sd[:, None] > 1e-2) & (sd > 1e-2), cov / sd[:, None] / sd, 0.0)
        out = np.where(np.abs(found) > np.abs(out), found, out)
    return out


def fit_label_model(votes: np.ndarray, labels: np.ndarray) -> tuple[LabelModel, np.ndarray]:
    """Model and posteriors. `votes` (rows, voters); `labels` 0 or 1 are cast as the votes of one more voter, the last."""
    own = np.column_stack([votes, np.where(labels == 1, 1, 2)]).astype(np.int64)
    alone = [[j] for j in range(own.shape[1])]
    model, p = _estimated(own, np.clip(labels.astype(float), 0.02, 0.98), alone)
    strength = np.abs(correlations(own, p))
    groups = {j: [j] for j in range(own.shape[1])}
    for a, b in sorted(zip(*np.nonzero(np.triu(strength[:-1, :-1] > TOGETHER, 1))), key=lambda ab: -strength[ab]):
        if groups[a] is not groups[b] and len(groups[a]) + len(groups[b]) <= JOINT:
            both = groups[a] + groups[b]
            for j in both:
                groups[j] = both
    joint = [g for j, g in groups.items() if g[0] == j]
    return _estimated(own, p, joint)


@dataclass
class Terms:
    """Vectors of terms: which words a text holds, and which stems speak in it."""

    words: CountVectorizerModel
    stems: CountVectorizerModel
    pool: list[str]

    @staticmethod
    def of(chosen: list[str], pool: list[str]) -> Terms:
        """`chosen` terms count each by itself, and those of `pool` all together too."""
        made = [
            # A text holds no term "-"; a vocabulary must not be empty.
            CountVectorizerModel.from_vocabulary([t for t in chosen if t.endswith("-") == stem] or ["-"], inputCol=of, outputCol=to)
            for stem, of, to in ((False, "_words", "_held"), (True, "_stems", "_spoken"))
        ]
        return Terms(made[0].setBinary(True), made[1].setBinary(True).setMinTF(STEM_SHARE / len(STEM_LENGTHS)), pool)

    def transform(self, df: DataFrame, in_order: Column, *keep: str | Column) -> DataFrame:
        """The kept columns and `_counts`."""
        cut = df.select(*keep, in_order.alias("_words")).withColumn("_stems", stems_of(padded(F.col("_words"))))
        words, stems = ([t for t in self.pool if t.endswith("-") == stem] for stem in (False, True))
        hits = F.size(F.array_intersect("_words", F.array(*map(F.lit, words)))) if words else F.lit(0)
        # Of stems that begin with one another the shortest: a word counts once.
        stems = [t for t in stems if not any(f"{t[:n]}-" in stems for n in STEM_LENGTHS if n < len(t) - 1)]
        begun = F.size(F.filter("_stems", lambda s: s.isin(stems)))
        pooled = {"_any": hits >= 1, "_several": hits >= 2, "_begun": _speaks(begun, F.size("_words"))}
        cut = self.stems.transform(self.words.transform(cut)).withColumns({k: v.cast("double") for k, v in pooled.items()})
        both = VectorAssembler(inputCols=["_held", "_spoken", *pooled], outputCol="_counts").transform(cut)
        return both.drop("_words", "_stems", "_held", "_spoken", *pooled)


@dataclass
class Model:
    terms: Terms | None
    linear: LogisticRegressionModel | None
    prior: float

    def scored(self, df: DataFrame, text: str, *keep: str | Column) -> DataFrame:
        """The kept columns and `score` of each row."""
        if self.linear is None:
            return df.select(*keep, F.lit(self.prior).alias("score"))
        counted = self.terms.transform(df, words_of(F.col(text)), *keep)
        names = [c for c in counted.columns if c != "_counts"]
        return self.linear.transform(counted).select(*names, vector_to_array("_chances").getItem(1).alias("score"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fitted on at most SAMPLE labelled rows, none of them held out. Several labels of one id count as toxic if one is.

    Without both classes among them every text gets one score, the smoothed share of toxic rows.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("known_id"))
        .agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("label"))
        .orderBy(F.xxhash64("known_id"), "known_id")
        .limit(SAMPLE)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("known_id"))  # SAMPLE rows of two numbers at most
    sample = stored(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label", words_of(F.col("text")).alias("in_order")), "toxicity-sample")
    sample = sample.withColumn("words", F.array_distinct("in_order"))
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < n_toxic < n:
        return Model(None, None, (n_toxic + 0.5) / (n + 2))

    begun = sample.select("doc_id", "label", F.size("in_order").alias("n_words"), F.explode(stems_of(F.col("in_order"))).alias("term"))
    spoken = begun.filter("term != ''").groupBy("doc_id", "label", "term", "n_words").agg(F.count(F.lit(1)).alias("n"))
    held = sample.select("label", F.explode("words").alias("term")).unionAll(spoken.filter(_speaks(F.col("n"), F.col("n_words"))).select("label", "term"))
    by_term = held.groupBy("term").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).filter(f"t + c >= {LEAST_ROWS}")
    odds = F.log((F.col("t") + 0.5) / (F.lit(n_toxic + 1.0) - F.col("t"))) - F.log((F.col("c") + 0.5) / (F.lit(n - n_toxic + 1.0) - F.col("c")))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    rated = by_term.select("term", odds.alias("odds"), (odds / error).alias("z"))
    strong = stored(rated.orderBy(F.desc(F.abs("z")), "term").limit(VOCABULARY), "toxicity-terms")
    chosen = strong.orderBy(F.desc("z"), "term").collect()
    speaking = [r.term for r in chosen if r.z > VOTES_Z and r.odds > VOTES_ODDS]
    learned, stems = [t for t in speaking if t[-1] != "-"][:LEARNED], [t for t in speaking if t[-1] == "-"][:STEMS]
    voters = _voters(learned, stems)
    cast = sample.select("doc_id", "label", *[v.cast("byte").alias(k) for k, v in voters.items()]).toPandas()  # SAMPLE rows of bytes
    _, p = fit_label_model(cast[list(voters)].to_numpy(), cast["label"].to_numpy())
    spark = docs.sparkSession
    chances = spark.createDataFrame(list({int(i): float(x) for i, x in zip(cast["doc_id"], p)}.items()), "doc_id long, p double")
    both = F.array(F.struct(F.lit(1.0).alias("y"), F.col("p").alias("w")), F.struct(F.lit(0.0).alias("y"), (1 - F.col("p")).alias("w")))
    soft = sample.join(F.broadcast(chances), "doc_id").select("in_order", F.explode(both).alias("x"))
    soft = soft.select("in_order", "x.y", "x.w").filter("w > 1e-6")
    vector = Terms.of([r.term for r in chosen], learned + stems)
    linear = LogisticRegression(
        featuresCol="_counts", labelCol="y", weightCol="w", probabilityCol="_chances", rawPredictionCol="_raw", predictionCol="_class",
        regParam=1e-4, maxIter=60, standardization=False,
    ).fit(vector.transform(soft, F.col("in_order"), "y", "w"))
    # The fitted object holds its training summary, and with it the session, which no task can be sent once anything was observed
    # in it; the object read back holds coefficients alone.
    path = shared_folder(spark, "toxicity-linear")
    linear.write().save(path)
    return Model(vector, LogisticRegressionModel.load(path), n_toxic / n)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted. Every whole text is scored by its words alone; null and empty texts
    have none and get the score of that. Rows with a null id count as held out. Repeated rows stay; other columns are not
    read. An empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = fit(rows, labels).scored(rows, "text", "doc_id")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns, whose score is under 0.5."""
    rows = docs.select(F.col("text").alias("_text"), F.struct("*").alias("_row"))
    found = fit(docs, labels).scored(rows, "_text", "_row").filter("score < 0.5")
    return found.select([F.col("_row").getField(c).alias(c) for c in docs.columns])
