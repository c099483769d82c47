import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.operators import textmetrics
from tesserae.operators.cache import with_cache
from tesserae.operators.compaction import compact
from tesserae.operators.conversations import Style, render_conversation
from tesserae.runtime import scratch_path
from tesserae.streaming import jobs


def pairs(spark, *texts):
    return spark.createDataFrame([(str(i), r, h) for i, (r, h) in enumerate(texts)], "row_id string, ref string, hyp string")


def test_bleu(spark):
    same = textmetrics.bleu(pairs(spark, ("the cat sat on the mat", "The cat sat on the mat!"))).first()
    assert all(score == pytest.approx(1.0) for score in same)
    clipped = textmetrics.bleu(pairs(spark, ("the cat", "the the the the"))).first()
    assert clipped.bleu_1 == pytest.approx(0.25)
    short = textmetrics.bleu(pairs(spark, ("a b c d", "a b"))).first()
    assert short.bleu_1 == pytest.approx(2.718281828 ** (1 - 2), rel=1e-6)


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_l_against_brute_force(spark):
    rng = random.Random(3)
    texts = [[" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 90))) for _ in range(2)] for _ in range(40)]
    rows = textmetrics.rouge_l_rows(pairs(spark, *texts)).collect()
    for row in rows:
        ref, hyp = (t.split() for t in texts[int(row.row_id)])
        common = lcs(ref, hyp)
        assert row.lcs == common
        if common:
            p, r = common / len(hyp), common / len(ref)
            assert row.rouge_l == pytest.approx((1 + 1.44) * p * r / (r + 1.44 * p))
        else:
            assert row.rouge_l == 0


def test_cider_prefers_rare_words(spark):
    texts = [("a rare lion here now", "a rare lion here now"), ("a dog runs far away", "x y z"), ("a cat sits down low", "a")]
    score = textmetrics.cider(pairs(spark, *texts)).first()
    assert score.rows == 3 and score.cider == pytest.approx(10 / 3, rel=0.05)


def plain_cider(texts):
    grams = [[Counter(tuple(t.split()[i : i + n]) for n in range(1, 5) for i in range(len(t.split()) - n + 1)) for t in pair] for pair in texts]
    df = Counter(g for ref, _ in grams for g in ref)
    total = 0
    for (ref, hyp), (a, b) in zip(grams, texts, strict=True):
        delta = max(len(b.split()) - 1, 0) - max(len(a.split()) - 1, 0)
        for n in range(1, 5):
            wr, wh = ({g: c * (math.log(len(texts)) - math.log(max(1, df[g]))) for g, c in x.items() if len(g) == n} for x in (ref, hyp))
            dot = sum(min(wh.get(g, 0), w) * w for g, w in wr.items())
            nr, nh = (math.sqrt(sum(w * w for w in x.values())) for x in (wr, wh))
            total += (dot / (nr * nh) if nr and nh else dot) * math.exp(-(delta**2) / 72)
    return total / 4 / len(texts) * 10


def test_cider_shuffles_no_gram_as_text(spark):
    rng = random.Random(7)
    texts = [[" ".join(["all", *(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30)))]) for _ in range(2)] for _ in range(60)]
    texts += [["all", "all all"], ["all", ""], ["all", "other"]]
    for some in (texts, texts[:1], [["all x", "all y"], ["all x", "all x"]]):
        score = textmetrics.cider(pairs(spark, *some))
        assert score.first().cider == pytest.approx(plain_cider(some))
        plan = score._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(" in plan and not re.search(r"hashpartitioning\([^)]*gram", plan)


def evidence(spark, groups):
    return spark.createDataFrame([(k, i, t) for k, texts in groups.items() for i, t in enumerate(texts)], "k string, i int, text string")


def test_compaction(spark):
    groups = {"short": ["one", "two"], "many": ["x" * 5] * 51, "long": ["y" * 100] * 20, "stuck": ["z" * 400]}
    shrink = lambda blocks: blocks.withColumn(
        "text", F.when(F.col("k") == "stuck", F.concat("text", F.lit("!"))).otherwise(F.concat(F.lit("sum "), F.col("n_rows").cast("string"))))
    found = {r.k: r for r in compact(evidence(spark, groups), ["k"], [F.col("i")], 200, shrink).collect()}
    assert found["short"].text == "one\n\ntwo" and found["short"].level == 0
    assert found["many"].text == "\n\n".join(["sum 10"] * 5 + ["sum 1"])
    assert found["long"].text == "sum 10\n\nsum 10" and found["long"].size == 14
    assert found["stuck"].status == "invalid" and found["stuck"].text is None


def test_conversation_pieces(spark):
    turns = spark.createDataFrame([(1, i, "USER" if i % 2 == 0 else "BOT", f"m{i}") for i in range(5)],
                                  "conv_id int, turn int, role string, text string")
    style = Style("TWO", "sys", " ", "</s>")
    whole = render_conversation(turns, style, ["conv_id"]).first().prompt
    assert whole == "sys USER: m0 BOT: m1</s>USER: m2 BOT: m3</s>USER: m4 "
    parts = render_conversation(turns, style, ["conv_id"], piece=2).collect()
    assert [(p.turns, p.prompt) for p in parts] == [(5, whole)]
    llama = render_conversation(turns, Style("LLAMA_2", "s", "<s>", "</s>"), ["conv_id"]).first().prompt
    assert llama.startswith("[INST] <<SYS>>\ns\n<</SYS>>\n\nm0 [/INST] m1 </s><s>[INST] m2 [/INST]")


def test_cache_computes_each_key_once(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "id int, text string")
    empty = spark.createDataFrame([], "cache_key string, value string")
    compute = lambda misses: misses.withColumn("value", F.upper("text"))
    found, fresh = with_cache(inputs, empty, ["text"], compute)
    assert {r.id: r.value for r in found.collect()} == {1: "A", 2: "B", 3: "A", 4: "C"}
    assert fresh.count() == 3
    never = lambda misses: misses.withColumn("value", F.raise_error(F.lit("computed again")).cast("string"))
    again, fresh = with_cache(inputs, fresh, ["text"], never)
    assert again.filter("hit").count() == 4 and fresh.count() == 0


SCHEMA = "k string, n int, payload string"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(path)


def test_upserts_and_replays(spark):
    path, table, state = (scratch_path(spark, n) for n in ("in", "table", "state"))
    def step():
        jobs.stream_upsert(jobs.result_stream(spark, path, SCHEMA), table, state, ["k"], "n").awaitTermination()
        return {r.k: r.payload for r in jobs.read_current(spark, table, ["k"], "n").collect()}
    arrive(spark, path, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    assert step() == {"a": "y", "b": "z"}
    arrive(spark, path, [("b", 0, "later file wins"), ("c", 1, "new")])
    assert step() == {"a": "y", "b": "later file wins", "c": "new"}
    assert step() == {"a": "y", "b": "later file wins", "c": "new"}
    # The same records once more change nothing.
    arrive(spark, path, [("c", 1, "new")])
    assert step()["c"] == "new"


def test_changed_receipt_is_refused(spark):
    path, table, state = (scratch_path(spark, n) for n in ("in", "table", "state"))
    def step():
        jobs.stream_upsert(jobs.result_stream(spark, path, SCHEMA), table, state, ["k"], "n", receipt="payload").awaitTermination()
    arrive(spark, path, [("a", 1, "x")])
    step()
    arrive(spark, path, [("a", 2, "x")])
    step()
    arrive(spark, path, [("a", 3, "other")])
    with pytest.raises(Exception, match="receipt"):
        step()


def test_profile_counts_an_id_once(spark):
    schema = "id string, stage string, seconds double, output_tokens long"
    path, out, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    def step(rows):
        spark.createDataFrame(rows, schema).write.mode("append").json(path)
        jobs.stream_profile(jobs.result_stream(spark, path, schema), "id", "stage", out, state).awaitTermination()
        return {r.stage: (r.calls, r.seconds) for r in jobs.read_latest(spark, out).collect()}
    assert step([("1", "final", 2.0, 5), ("1", "final", 2.0, 5)]) == {"final": (1, 2.0)}
    assert step([("1", "final", 2.0, 5), ("2", "final", 1.0, 5), ("3", "predict", 1.0, 1)]) == {
        "final": (2, 3.0), "predict": (1, 1.0)}
