"""Call logs, request limits and runs that are started again."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import prompts
from tesserae.operators.compaction import fit_requests
from tesserae.operators.joins import check_identity
from tesserae.operators.profiles import profile_calls
from tesserae.plans.agent import AgentParams, run_agent
from tesserae.plans.backend import Limits, ModelBackend
from tesserae.plans.calls import CallLog, Reply, logged_calls, replies_of
from tesserae.plans.run import RunIdentity, open_run, read_locks, run_inference, stored_calls, stored_results
from tesserae.runtime import scratch_path
from tesserae.sources.results import read_results
from tests.test_agent import Rules, Scripted, questions, regions


def seed_of(case, text, seed=5):
    return int(hashlib.sha256(json.dumps([seed, case, text]).encode()).hexdigest()[:8], 16)


class Talking(Scripted):
    """The scripted model with token counts; it can be given requests."""

    takes_requests = True

    def count(self, texts):
        return [len(t.split()) for t in texts]

    def look(self, requests):
        return [Reply(t, 3, 2) for t in super().look([r.text for r in requests])]

    def generate(self, requests):
        said = super().generate([r.text for r in requests])
        return [Reply(t, n, 8) for t, n in zip(said, self.count([r.text for r in requests]), strict=True)]


def options(df):
    return df.withColumn("choices", F.expr("array(struct('A' as label, 'yes' as text), struct('B' as label, 'no' as text))"))


def test_every_call_is_logged_once_with_its_seed(spark):
    log = CallLog(scratch_path(spark, "calls"))
    backend = ModelBackend(Talking, prompts.CONTEXT, seed=5, limits=Limits(tokens={"predict": 8, "final": 20}), log=log)
    run_agent(options(questions(spark, 1, 2)), regions(spark, 12), backend)
    rows = log.read(spark).collect()
    keys = [(r.case_id, r.stage, r.call_index) for r in rows]
    assert len(set(keys)) == len(keys)
    by_stage = {s: sorted((r for r in rows if r.stage == s and r.case_id == "1"), key=lambda r: r.call_index) for s in {r.stage for r in rows}}
    # The first reflection is no JSON object and is asked for again; the zoom is described last.
    assert {s: [r.call_index for r in v] for s, v in by_stage.items()} == {
        "describe": [0, 1, 2], "predict": [0], "reflect": [0, 1], "missing_info": [0], "final": [0]}
    for stage in ("predict", "reflect", "missing_info", "final"):
        assert [r.seed for r in by_stage[stage]] == [seed_of("1", f"{stage}:{r.call_index}") for r in by_stage[stage]]
    looked = by_stage["describe"][0]
    line = json.loads(looked.request)[1]["content"].split("\n")[0]
    assert looked.seed == seed_of("1", f"describe:{line}What is it?None:0")
    assert len(json.loads(by_stage["reflect"][1].request)) == 3
    assert by_stage["predict"][0].at_cap and not by_stage["final"][0].at_cap
    assert all(r.seconds >= 0 and r.input_tokens > 0 and r.response for r in rows)
    total = profile_calls(log.read(spark)).filter("level = 3").first()
    assert total.calls == len(rows) and total.output_tokens == sum(r.output_tokens for r in rows)


class Echo:
    def generate(self, texts):
        return [t.upper() for t in texts]


def test_a_repeated_batch_replaces_itself(spark):
    rows = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "z"), ("b", 1, None)], "case_id string, n int, text string")
    root = scratch_path(spark, "calls")

    def ask(log, batch):
        return logged_calls(rows, log, Echo, "predict", F.col("case_id"), F.col("text"), 5, order=[F.col("n")], batch=batch)

    ask(CallLog(root), "first")
    log = CallLog(root)
    said = ask(log, "first").collect()
    assert {(r.case_id, r.n, r._raw is None) for r in said} == {("a", 1, False), ("a", 2, False), ("b", 1, True)}
    ask(log, "second")
    found = sorted((r.case_id, r.call_index, r.request, r.batch) for r in log.read(spark).collect())
    assert found == [("a", 0, "x y", "first"), ("a", 1, "z", "first"), ("a", 2, "x y", "second"), ("a", 3, "z", "second")]


def test_models_without_counts_are_logged_without_tokens():
    class Plain:
        def generate(self, texts):
            return [t.upper() for t in texts]

    class Short:
        def generate(self, texts):
            return []

    from tesserae.plans.calls import Request

    asked = [Request("a b", 1, None, False)]
    assert replies_of(Plain(), "generate", asked) == [Reply("A B")]
    with pytest.raises(ValueError, match="0 replies to 1"):
        replies_of(Short(), "generate", asked)


def test_evidence_is_shortened_until_the_whole_request_fits(spark):
    tokenizers = pytest.importorskip("tokenizers")
    places = pytest.importorskip("public_tokenizers")
    path = str(places.path("byte_bpe_50k.json"))
    whole = tokenizers.Tokenizer.from_file(path)

    @F.pandas_udf("bigint")
    def count(texts):
        import pandas as pd
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return pd.Series([len(e.ids) for e in own.encode_batch(texts.tolist(), add_special_tokens=False)])

    requests = spark.createDataFrame([(1, "h"), (2, "h"), (3, "history " * 600), (4, "h")], "q long, history string")
    lines = [(q, i, f"region {i} shows cells of kind {i % 3}") for q, n in ((1, 5), (2, 70), (3, 5)) for i in range(n)]
    lines += [(4, i, "many words " * 60) for i in range(25)]
    evidence = spark.createDataFrame(lines, "q long, i int, text string")
    render = lambda text: F.concat(F.lit("Question? "), "history", F.lit("\n"), text, F.lit("\nOnly JSON."))
    shorten = lambda blocks: blocks.withColumn("text", F.concat(F.lit("sum of "), F.substring(F.sha2("text", 256), 1, 6)))
    room = 600
    found = {r.q: r for r in fit_requests(requests, evidence, ["q"], [F.col("i")], render, count, room, shorten, 100).collect()}
    assert {q: (r.status, r.level) for q, r in found.items()} == {1: ("ok", 0), 2: ("ok", 1), 3: ("no_room", None), 4: ("ok", 1)}
    for q in (1, 2, 4):
        text = f"Question? h\n{found[q].text}\nOnly JSON."
        assert len(whole.encode(text, add_special_tokens=False).ids) <= room
    assert found[1].text == "\n\n".join(t for q, _, t in lines if q == 1)
    # Evidence that never gets shorter is invalid, not cut.
    same = fit_requests(requests, evidence, ["q"], [F.col("i")], render, count, 120, lambda b: b, 50).collect()
    assert {r.q: r.status for r in same} == {1: "ok", 2: "invalid", 3: "no_room", 4: "invalid"}


class Wordy(Talking):
    """Summaries are short; every other answer is that of the scripted model."""

    def generate(self, requests):
        said = super().generate(requests)
        is_summary = [json.loads(r.text)[0]["content"].startswith("Summarize") for r in requests]
        return [Reply("short", 1, 1) if s else t for s, t in zip(is_summary, said, strict=True)]


def test_backend_keeps_requests_within_the_context(spark):
    long = regions(spark, 120).withColumn("description", F.repeat(F.lit("cells "), 40))
    log = CallLog()
    limits = Limits(context=420, tokens={"predict": 20, "final": 20}, least_evidence=10)
    backend = ModelBackend(Wordy, prompts.CONTEXT, seed=5, limits=limits, log=log)
    once = AgentParams(max_iterations=1)
    run = run_agent(options(questions(spark, 1)), long, backend, once)
    assert run.results.first().status == "ok"
    calls = log.read(spark).collect()
    assert sum(r.stage == "summary" for r in calls) >= 2
    for r in calls:
        if r.stage not in ("summary", "describe"):
            assert len(r.request.split()) + limits.tokens.get(r.stage, 0) <= limits.context
    none = ModelBackend(Wordy, prompts.CONTEXT, limits=Limits(context=60, least_evidence=10))
    failed = run_agent(options(questions(spark, 1)), long, none, once).results.first()
    assert (failed.status, failed.stop_reason) == ("invalid", "protocol_error")


class Broken(Exception):
    pass


def test_a_run_goes_on_where_it_stopped(spark):
    root, identity = scratch_path(spark, "runs"), RunIdentity("config", "code", "manifest")
    asked = questions(spark, 1, 2, 5).unionByName(questions(spark, 11, 12, image="other"))
    tiles = regions(spark, 3).unionByName(regions(spark, 3, image="other"))
    made = []

    def backend(fail_at=None):
        def make(log):
            made.append(log.root)
            if len(made) == fail_at:
                raise Broken
            return Rules(sufficient=F.lit(True))
        return make

    def start(make, samples=asked, who=identity, protocol=prompts.PAPER):
        return run_inference(spark, samples, tiles, make, root, "r1", who, protocol, AgentParams(max_iterations=1), batches=5)

    with pytest.raises(Broken):
        start(backend(fail_at=2))
    first = {r.query_id for r in stored_results(spark, root, "r1").collect()}
    assert first in ({1, 2, 5}, {11, 12})
    rows = {r.query_id: r for r in start(backend()).collect()}
    assert {q for q, r in rows.items() if r.start == 1} == first and set(rows) == {1, 2, 5, 11, 12}
    assert rows[5].status == "invalid" and rows[1].run_hash == identity.run_hash
    # Nothing is left to do, so nothing is called; under the first protocol invalid ones are asked again.
    done = len(made)
    start(backend())
    assert len(made) == done
    again = {r.query_id: r.start for r in start(backend(), protocol=prompts.LEGACY).collect()}
    assert len(made) == done + 1 and again[5] == 3 and again[1] == rows[1].start
    with pytest.raises(ValueError, match="refused, changed: code_hash"):
        start(backend(), who=RunIdentity("config", "other", "manifest"))
    locks = read_locks(spark, root)
    read = read_results(spark, root, "query_id bigint, run_hash string")
    verdict = check_identity(read.withColumn("sample_id", F.col("query_id").cast("string")), locks).first()
    assert (verdict.run, verdict.results, verdict.mismatched) == ("r1", 6, 0)
    assert stored_calls(spark, root, "r1").count() == 0


def test_a_broken_lock_is_written_again(spark):
    root, identity = scratch_path(spark, "runs"), RunIdentity("a", "b", "c")
    assert open_run(spark, root, "r", identity) == open_run(spark, root, "r", identity) == identity.run_hash
    with pytest.raises(ValueError, match="config_hash, manifest_hash"):
        open_run(spark, root, "r", RunIdentity("x", "b", "y"))
