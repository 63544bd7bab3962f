"""Quality rules, conversation repair and hard negatives against brute force, their SQL and odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
from compare import compare
from pyspark.sql import functions as F

from runlattice.llm import conversations, hard_negatives, oracles, queries, rule_quality

# quality rules

TREE = """DecisionTreeClassificationModel: uid=dtc, depth=2, numNodes=5, numClasses=2, numFeatures=3
  If (feature 0 <= 0.5)
   If (feature 2 <= 4.0)
    Predict: 0.0
   Else (feature 2 > 4.0)
    Predict: 1.0
  Else (feature 0 > 0.5)
   If (feature 0 <= 0.75)
    Predict: 1.0
   Else (feature 0 > 0.75)
    Predict: 0.0
"""


def test_paths_of_a_tree():
    low, high = rule_quality.Bound("a", False, 0.5), rule_quality.Bound("a", True, 0.5)
    assert rule_quality.paths(TREE, ["a", "b", "c"]) == [
        (low,), (low, rule_quality.Bound("c", False, 4.0)), (low, rule_quality.Bound("c", True, 4.0)),
        (high,), (rule_quality.Bound("a", False, 0.75), high), (rule_quality.Bound("a", True, 0.75),),
    ]


def counted(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = text.split("\n")
    letters = sum(c.isalpha() for c in text)
    return {
        "words": len(words), "words_a_line": len(words) / len(lines), "letters": letters / max(1, len(text)),
        "capitals": sum(c.isupper() for c in text) / max(1, letters), "different": len(set(words)) / max(1, len(words)),
        "different_lines": len(set(lines)) / len(lines), "echoes": sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)),
        "letterless": sum(not any(c.isalpha() for c in w) for w in words) / max(1, len(words)), "shouts": text.count("!") / max(1, len(words)),
        "words_a_sentence": len(words) / max(1, sum(c in ".!?" for c in text)), "commas": sum(c in ",;:()'\"-" for c in text) / max(1, len(words)),
    }


ODD = ["", " ", "one", "ONE one ONE!!", "a a a b b\nx | y | z\n\nx | y | z", "Größe, été; 12 (3)? 'so' \"on\" - \\.", "word " * 200_000, "\x0b\x0c\t\r\n"]


def test_statistics_of_odd_texts(spark):
    df = spark.createDataFrame(list(enumerate(ODD)) + [(99, None)], "doc_id long, text string")
    for r in rule_quality.measured(df, "text", "doc_id", F.col("text").alias("stats_of")).collect():
        own = counted(ODD[r.doc_id] if r.doc_id < 99 else "")
        assert {k: r.stats[k] for k in own} == {k: float(v) for k, v in own.items()}, r.doc_id


def test_compiled_rules_are_the_weights_that_hold(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = rule_quality.fit(docs, labels)
    assert 0 < len(model.weights) <= rule_quality.TREES * (2 ** (rule_quality.DEPTH + 1) - 2)
    for r in rule_quality.measured(docs, "text", "doc_id").withColumn("score", model.column()).collect():
        held = [w for rule, w in model.weights.items() if all((r.stats[b.statistic] > b.value) == b.above for b in rule)]
        assert math.isclose(r.score, 1 / (1 + math.exp(-model.intercept - sum(held))), rel_tol=1e-9)


def test_quality_of_rows_that_were_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = rule_quality.scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_quality_never_learns_from_held_out_labels(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(rule_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_quality.fit(docs, labels) == rule_quality.fit(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), turned)


def test_quality_of_odd_tables(spark):
    own = spark.createDataFrame([(None, None, 1, 2), (5, "", 1, 2), (5, "", 1, 2), (6, "a b", 1, 2)], "doc_id long, text string, stats int, label int")
    for labels in ([], [(5, 1), (5, None), (None, 0)], [(6, 1), (6, 0)]):
        rows = rule_quality.scores(own, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(rows) == 4 and all(0 < r.score < 1 and r.predicted == (r.score >= rule_quality.GOOD) for r in rows)
        assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert rule_quality.scores(own.limit(0), spark.createDataFrame([(5, 1)], "doc_id long, quality int")).collect() == []


# conversation repair

def brute(symbols):
    """Cost and audit by trying all edits with up to two insertions at each place."""
    best = None
    for inserts in itertools.product(range(3), repeat=len(symbols) + 1):
        for edits in itertools.product("KRD", repeat=len(symbols)):
            roles, cost, audit = "", 0, ""
            for i in range(len(symbols) + 1):
                for _ in range(inserts[i]):
                    roles, cost, audit = roles + "?", cost + 3, audit + "I"
                if i < len(symbols):
                    audit += edits[i]
                    if edits[i] != "D" and symbols[i] == "x":
                        break
                    cost += {"K": 0, "R": 3, "D": 4}[edits[i]] + (3 if edits[i] != "D" and symbols[i].isupper() else 0)
                    roles += {"K": symbols[i].lower(), "R": "?", "D": ""}[edits[i]]
            else:
                # A made role is user or assistant, as the place demands.
                if re.fullmatch("(s?([u?][a?])+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def dawg(symbols):
    path = [conversations.END]
    for s in symbols[::-1]:
        path.append(conversations.node_before(s, path[-1]))
    return path[-1][0] // 256, conversations.audit_of(path, symbols[::-1])


def test_cheapest_edits_of_all_short_signatures():
    for n in range(4):
        for symbols in itertools.product("xsuaoSUAO", repeat=n):
            symbols = "".join(symbols)
            assert dawg(symbols) == brute(symbols), symbols
    own = random.Random(3)
    for _ in range(12):
        symbols = "".join(own.choice("xsuuaaoSUAO") for _ in range(5))
        assert dawg(symbols) == brute(symbols), symbols


def compared(spark, df):
    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    return compare(conversations.digests(df), con, oracles.ORACLES["op12_suffix_dawg"])


def test_repair_of_odd_conversations(spark):
    own = random.Random(11)
    roles = ["user", "assistant", "system", "User", "tool", "", None, "assistants"]
    said = ["Yes.", "No?", "so", "", " \t", None, "a. ", "b!\n", "...", " ", "end\x0b"]
    rows = [
        (own.choice([None, *range(12)]), own.choice([None, None, *range(-3, 30), 9_000_000_000]), own.choice(roles), own.choice(said), "x", 1, b"y", False)
        for _ in range(900)
    ]
    rows += rows[:200] + [(77, t, "user", "dropped", "x", 1, b"y", False) for t in range(400) if zlib.crc32(f"77:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string, copy int, digest binary, dropped boolean").repartition(5)
    assert compared(spark, df) == ""
    empty = [r for r in conversations.digests(df).collect() if r.conv_id == 77]
    assert len(empty) == 1 and tuple(empty[0])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert conversations.digests(df.limit(0)).collect() == []
    assert conversations.repaired(df.limit(0)).collect() == []


def test_repair_of_one_long_conversation(spark):
    """A third of all rows in one conversation, over several Arrow batches, one text very long."""
    own = random.Random(2)
    rows = [(1, t, own.choice(["user", "assistant"]), own.choice(["yes.", f"line {t}.", f"line {t}"])) for t in range(25_000)]
    rows[7] = (1, 7, "user", "long " * 400_000 + ".")
    rows += [(10 + i // 5, i % 5, ["user", "assistant"][i % 2], f"say {i}.") for i in range(50_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16)
    got = {r.conv_id: r for r in conversations.digests(df).collect()}
    assert len(got) == 10_001
    after, seen, symbols = [], set(), ""
    for _, t, role, text in sorted(rows[:25_000]):
        kind = zlib.crc32(f"1:{t}".encode()) % 20
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after += [] if kind == 0 else [(role, text)] * (2 if kind == 3 else 1)
    for role, text in after:
        gone = not text or (role, text) in seen
        symbols += "x" if gone else role[0] if text[-1] == "." else role[0].upper()
        seen.add((role, text))
    cost, audit = dawg(symbols)
    out, place, state = [], 0, "a"
    for edit in audit:
        made = "a" if state == "u" else "u"
        role, text = ("", "") if edit == "I" else after[place]
        place += edit != "I"
        if edit != "D":
            state = role[0] if edit == "K" else made
            out.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[made]}:{text}")
    assert (got[1].cost, got[1].audit) == (cost, audit)
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_repaired_rows_are_legal_and_cheap(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = conversations.repaired(table, conversations.damaged(table)).orderBy("conv_id", "place").collect()
    digests = {r.conv_id: r for r in queries.QUERIES["op12_suffix_dawg"](spark, sf).collect()}
    for conv, part in itertools.groupby(rows, key=lambda r: r.conv_id):
        part = list(part)
        assert [r.place for r in part] == list(range(len(part)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in part))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in part).encode()).hexdigest() == digests[conv].repaired_sha256
        assert "".join(r.edit for r in part) == digests[conv].audit.replace("D", "")


# hard negatives

def mined_by_all_pairs(rows, every):
    taking = []
    for vec_id, v, label in rows:
        if label is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        taking.append((vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, label, v in taking:
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), b, other == label) for b, other, w in taking if b != a and len(w) == len(v)]
        for p, positive, _ in sorted([s for s in scored if s[2]], key=order)[: hard_negatives.POSITIVES]:
            hard = sorted([s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p], key=order)[: hard_negatives.NEGATIVES]
            out += [(a, positive, i + 1, b, p, n) for i, (n, b, _) in enumerate(hard)]
    return sorted(out, key=repr)


def vectors(n, dims, seed, near=0.5):
    own = np.random.default_rng(seed)
    centres = own.normal(size=(10, dims))
    labels = own.integers(0, 10, n)
    x = centres[labels] * near + own.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(int(i), [float(np.float32(c)) for c in v], int(y)) for i, (v, y) in enumerate(zip(x, labels))]


def table_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def test_negatives_over_shards_and_blocks(spark):
    rows = vectors(900, 12, 4)
    want = mined_by_all_pairs(rows, 10)
    assert len(want) > 500
    for shard, block in ((10_000, 10_000), (100, 20), (37, 7)):
        assert found(hard_negatives.mined(table_of(spark, rows), every=10, shard=shard, block=block)) == want


def test_negatives_with_ties_and_odd_rows(spark):
    own = random.Random(8)
    rows = [(own.choice([None, *range(0, 80)]), [own.choice([0.0, 0.25, -0.25, 0.5]) for _ in range(4)], own.choice([None, 1, 2, 9])) for _ in range(260)]
    rows += [(i, [0.0] * 4, 1) for i in range(100, 160)] + [(200, [-1.0] * 4, 1), (201, [1.0] * 4, 1), (202, [-0.5] * 4, 2)]
    rows += [(300 + i, v, 1) for i, v in enumerate([None, [], [None, 1.0, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 0.5], [1.0] * 4, [1.0] * 4])]
    rows += [(350, [0.5, 0.5], 1), (351, [0.5, 0.25], 2), (352, [0.25, 0.25], 3), (353, [0.75, 0.5], 1)]
    want = mined_by_all_pairs(rows, 50)
    for shard in (10_000, 60):
        df = table_of(spark, rows).withColumns({"row": F.lit("x"), "shard": F.lit("y"), "score": F.lit(1)})
        assert found(hard_negatives.mined(df, shard=shard, block=3)) == want
    assert any(r[0] == 350 for r in want) and any(r[0] == 0 for r in want)
    for some in (rows[:0], [(50, [1.0, 2.0], 3)], [(1, [1.0], 3), (2, [1.0], 4)]):
        assert hard_negatives.mined(table_of(spark, some)).collect() == []


def test_reading_stops_before_all_rows_are_scored():
    """Two thirds of the vectors are far off: the threshold rules them out unread, and the answer is that of all rows."""
    own = np.random.default_rng(1)
    x = np.where(np.arange(6000)[:, None] % 3 == 0, 200 + own.integers(0, 50, (6000, 8)), own.integers(-100, 30, (6000, 8)))
    shard = hard_negatives.Shard(np.arange(6000), np.ones(6000, bool), np.zeros(6000, int), x)
    scored = []
    plain = shard._scores
    shard._scores = lambda rows, anchor: scored.append(len(rows)) or plain(rows, anchor)
    anchor = x[0]
    (rows, got), = shard.best(anchor, np.ones(6000, bool), [hard_negatives.EVERYTHING], 5)
    all_scores = x @ anchor
    first = np.lexsort((np.arange(6000), -all_scores))[:5]
    assert rows.tolist() == first.tolist() and got.tolist() == all_scores[first].tolist()
    assert 5 <= sum(scored) < 2000
