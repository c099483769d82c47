import json
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import prompts
from tesserae.plans import agent
from tesserae.plans.agent import AgentParams, check_inputs, check_tables, run_agent
from tesserae.plans.backend import ModelBackend

REGION = ("image_id string, region_id string, image_path string, x long, y long, width long, height long, "
          "output_width long, output_height long, scale_kind string, scale double, mpp double, "
          "magnification_source string, parent_id string, description string, vector array<float>")
SIDE = 1000


def regions(spark, n, image="plate"):
    """A strip of ``n`` squares; the vectors turn away from (1, 0) step by step."""
    rows = []
    for i in range(n):
        place = (i * SIDE, 7, SIDE, SIDE, 250, 250)
        turn = [math.cos(i / n), math.sin(i / n)]
        rows.append((image, f"sq{i:02}", "/p", *place, "physical", 5.0, 0.5, "given", None, f"square {i}", turn))
    return spark.createDataFrame(rows, REGION)


def questions(spark, *ids, image="plate"):
    return spark.createDataFrame([(i, image, "What is it?") for i in ids], "query_id long, image_id string, question string")


class Rules:
    """A backend whose verdicts are given as columns of the question id and the round."""

    def __init__(self, sufficient=None, zoom=None, missing=None):
        self.sufficient = F.lit(False) if sufficient is None else sufficient
        self.zoom = F.lit(False) if zoom is None else zoom
        self.missing = F.lit("edges") if missing is None else missing
        self.concluded = None

    def encode_text(self, asked):
        return asked.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>"))

    def encode_regions(self, children):
        # The last child faces the question.
        facing = F.col("cell") == F.max("cell").over(Window.partitionBy("query_id", "parent_id"))
        vector = F.when(facing, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
        return children.withColumn("vector", vector.cast("array<float>"))

    def describe(self, views):
        said = F.concat(F.lit("looked at "), "region_id")
        return views.withColumn("observed", F.when(F.col("query_id") != 5, said).otherwise(" "))

    def evaluate(self, asked, findings):
        yes = lambda test: F.when(test, "Yes").otherwise("No")
        return asked.withColumns({
            "answer": F.lit("B"), "thinking_steps": F.lit("steps"), "sufficient": yes(self.sufficient),
            "missing_info": self.missing, "zoom_recommendation": yes(self.zoom), "zoom_level": F.lit(20)})

    def conclude(self, asked, evidence, trajectory):
        self.concluded = (asked, evidence)
        return asked.withColumns({"pred_answer": F.lit("B"), "explanation": F.lit("so"), "answer_status": F.lit("ok")})


@pytest.mark.parametrize("params", [AgentParams(), AgentParams(region_block=7, query_block=1)])
def test_rounds_take_their_share(spark, params):
    n = 52
    run = run_agent(questions(spark, 8, 9), regions(spark, n), Rules(), params)
    share = [math.ceil(0.10 * n)] + [math.ceil(0.05 * n)] * 4
    rows = run.evidence.filter("query_id = 9").orderBy("iteration", "rk").collect()
    assert [sum(r.iteration == i + 1 for r in rows) for i in range(5)] == share
    # Nearest first, none twice.
    assert [r.region_id for r in rows] == [f"sq{i:02}" for i in range(sum(share))]
    looked = [r for r in rows if "looked at" in r.description]
    assert len(looked) == sum(min(5, s) for s in share)
    for r in run.results.collect():
        assert (r.status, r.stop_reason, r.iterations) == ("ok", "max_iterations", 5)
        assert (r.total_examined_regions, r.initial_region_count) == (sum(share), n)


def test_zoom_shows_the_child(spark):
    backend = Rules(zoom=F.col("query_id") == 2)
    run = run_agent(questions(spark, 1, 2), regions(spark, 20), backend)
    event = run.trajectory.filter("query_id = 2").first()
    assert (event.action, event.stop_reason, event.iteration) == ("zoom", "zoom_completed", 1)
    # Two regions of 4 x 4 children each, of which the last of the first region wins.
    assert (event.zoom_candidates, event.zoom_region) == (32, "sq00/z20.0/3_3")
    shown = backend.concluded[1].filter("query_id = 2 and region_id like '%/z%'").first()
    assert (shown.x, shown.y, shown.width, shown.height, shown.scale) == (750, 757, 250, 250, 20.0)


def test_region_ids_may_look_like_children(spark):
    odd = regions(spark, 10).withColumn("region_id", F.concat(F.lit("a/z1/"), "region_id"))
    backend = Rules()
    run = run_agent(questions(spark, 1), odd, backend)
    assert backend.concluded[1].count() == run.evidence.count() > 0


def test_ends(spark):
    backend = Rules(
        sufficient=(F.col("query_id") == 1) & (F.col("round") == 2),
        missing=F.when(F.col("query_id") == 2, " \t").otherwise("edges"),
    )
    asked = questions(spark, 1, 2, 3, 5).union(questions(spark, 4, image="elsewhere"))
    run = run_agent(asked, regions(spark, 3), backend)
    found = {r.query_id: (r.stop_reason, r.status, r.pred_answer, r.iterations, r.total_examined_regions) for r in run.results.collect()}
    assert found == {
        1: ("sufficient", "ok", "B", 2, 2),
        2: ("protocol_error", "invalid", "", 1, 1),
        3: ("no_unexamined_regions", "ok", "B", 3, 3),
        4: ("no_regions", "invalid", "", 0, 0),
        # Its first region got an empty description.
        5: ("protocol_error", "invalid", "", 1, 1),
    }
    # Failed questions get no final call.
    assert {r.query_id for r in backend.concluded[0].collect()} == {1, 3}


def test_inputs_are_checked(spark):
    r = regions(spark, 2)
    check_inputs(questions(spark, 1), r)
    with pytest.raises(ValueError, match="gold"):
        run_agent(questions(spark, 1).withColumn("ground_truth", F.lit("A")), r, Rules())
    with pytest.raises(ValueError, match="repeated region"):
        check_inputs(questions(spark, 1), r.union(r))
    with pytest.raises(ValueError, match="repeated question"):
        check_inputs(questions(spark, 1, 1), r)
    with pytest.raises(ValueError, match="without regions"):
        check_inputs(questions(spark, 1, image="other"), r)
    with pytest.raises(ValueError, match="mixed"):
        check_inputs(questions(spark, 1), r.withColumn("scale", F.col("x") + 5.0))
    assert check_tables(r, r, r.filter("x > 0")).count() == 1


class Scripted:
    """A tiny chat model: answers by what the system message asks for."""

    def encode_text(self, texts):
        return [[1.0, 0.0] for _ in texts]

    def encode_regions(self, texts):
        return [[1.0, float("4096,0" in t)] for t in texts]

    def look(self, prompts_):
        return [f"<think>hm</think>saw {len(json.loads(p))}" for p in prompts_]

    def generate(self, prompts_):
        out = []
        for prompt in prompts_:
            talk = json.loads(prompt)
            system = talk[0]["content"]
            if "sufficient" in system.split("Output")[-1]:
                out.append('{"sufficient": "No"}' if len(talk) == 3 else "not json")
            elif "missing_info" in system:
                out.append('{"missing_info": "cells", "zoom_recommendation": "Yes", '
                           '"recommended_zoom_level": "10", "zoom_reason": "detail"}')
            elif "thinking_steps" in system:
                out.append('<think>x</think>{"answer": "A", "thinking_steps": "s"}')
            else:
                out.append('{"answer": "A", "explanation": "because"}')
        return out


def test_model_backend(spark):
    backend = ModelBackend(Scripted, prompts.CONTEXT)
    asked = questions(spark, 1, 2).withColumn(
        "choices", F.expr("array(struct('A' as label, 'yes' as text), struct('B' as label, 'no' as text))"))
    run = run_agent(asked, regions(spark, 12), backend)
    for result in run.results.collect():
        assert (result.status, result.pred_answer, result.explanation) == ("ok", "A", "because")
        assert result.stop_reason == "zoom_completed"
    events = run.trajectory.collect()
    assert len(events) == 2 and all(json.loads(e.decision)["zoom_level"] == 10 for e in events)


def test_regions_of_many_questions_are_encoded_once(spark):
    class Counting(Rules):
        def encode_regions(self, children):
            self.made = children
            return super().encode_regions(children)

    backend = Counting(zoom=F.lit(True))
    run = run_agent(questions(spark, 1, 2, 3, 4), regions(spark, 20), backend)
    # All four look at the same two regions of 4 x 4 children each.
    assert backend.made.count() == 32
    events = run.trajectory.collect()
    assert [(e.zoom_candidates, e.zoom_region) for e in events] == [(32, "sq00/z20.0/3_3")] * 4


def test_rounds_store_no_row_per_question_and_region(spark, monkeypatch):
    sizes = []

    def counted(df, keep=agent.stable):
        kept = keep(df)
        sizes.append(kept.count())
        return kept

    monkeypatch.setattr(agent, "stable", counted)
    n = 200
    run = run_agent(questions(spark, *range(10, 40)), regions(spark, n), Rules())
    assert run.evidence.count() == 30 * (20 + 4 * 10)
    # The regions, or five described ones per question.
    assert max(sizes) <= max(n, 30 * 5)


def operators_above(plan, kind):
    """Names of the operators above each operator of a kind, of a plan as text."""
    stack, found = [], []
    for line in plan.splitlines():
        name = line.lstrip(" :+-*()0123456789")
        depth = len(line) - len(line.lstrip(" :+-"))
        stack = [(d, n) for d, n in stack if d < depth]
        if name.startswith(kind):
            found.append([n for _, n in stack])
        stack.append((depth, name))
    return found


@pytest.mark.parametrize("shelf", [1 << 16, 7])
def test_evidence_exchanges_no_row_per_question_and_region(spark, monkeypatch, shelf):
    """Regions of two images whose facts are too many to broadcast, in one shelf and in several."""

    def run():
        backend = Rules(sufficient=F.col("query_id") == 12)
        asked = questions(spark, *range(10, 19)).union(questions(spark, 1, 2, image="other"))
        found = run_agent(asked, regions(spark, 52).union(regions(spark, 11, image="other")), backend)
        located = backend.concluded[1].select("query_id", "region_id", "rk", "iteration", "x", "y", "width", "scale")
        return found.evidence, located

    evidence, located = run()
    wanted = sorted(evidence.collect()), sorted(located.collect())
    monkeypatch.setattr(agent, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(agent, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(agent, "SHELF_REGIONS", shelf, raising=False)
    monkeypatch.setattr(agent, "SHELF_QUESTIONS", 2, raising=False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        evidence, located = run()
        plan = evidence._jdf.queryExecution().executedPlan().toString()
        assert (sorted(evidence.collect()), sorted(located.collect())) == wanted
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The last explosion, into regions, is above every exchange.
    made = [above for kind in ("Generate posexplode", "Generate inline") for above in operators_above(plan, kind)]
    assert len(made) == 5
    assert not [name for above in made for name in above if "Exchange" in name or "Join" in name]


@pytest.mark.parametrize("at_once", [1 << 22, 25])
def test_rows_of_neighbouring_questions_come_by_number(spark, monkeypatch, at_once):
    monkeypatch.setattr(agent, "PICKS_AT_ONCE", at_once)
    rows = [(q, "a" if q < 6 else "b", [(q * 7 + 3 * i) % 11 + 70_000 * (q == 2) + 1 for i in range(10)]) for q in range(9)]
    rows += [(9, "b", []), (10, "b", [4]), (None, None, [5, 2])]
    lists = spark.createDataFrame(rows, "query_id long, image_id string, numbers array<int>").coalesce(1)
    found = [tuple(r) for r in agent._by_number(lists).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(found, key=key) == sorted(((q, m, i, n) for q, m, ns in rows for i, n in enumerate(ns)), key=key)
    if at_once > 100:
        assert [(m or "c", n) for _, m, _, n in found] == sorted((m or "c", n) for _, m, _, n in found)


def test_shelves_that_are_broadcast_hold_any_number_of_regions(spark, monkeypatch):
    wanted = sorted(run_agent(questions(spark, 1, 2, 3), regions(spark, 52), Rules()).evidence.collect())
    monkeypatch.setattr(agent, "SHELF_REGIONS", 7)
    assert sorted(run_agent(questions(spark, 1, 2, 3), regions(spark, 52), Rules()).evidence.collect()) == wanted
