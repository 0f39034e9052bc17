"""Build a small run from layout files with canned model replies, then ask questions."""

import json
import sys

import pytest
from pyspark import cloudpickle

from quire import config
from quire.errors import ConfigError, StageError
from quire.obs import report
from quire.plans.ask import Artifacts, ask
from quire.plans.build import Build
from quire.providers.models import CannedCompletion, FunctionCompletion
from quire.sources.workspace import Workspace, read_questions, write_answers


def _span(text):
    return {"type": "text", "content": text}


def _block(i, kind, text, y):
    return {"index": i, "type": kind, "bbox": [10, y, 200, y + 10], "lines": [{"spans": [_span(text)]}]}


def _reply(nodes, edges):
    return json.dumps({"reason": "r", "ops": {"add_nodes": nodes, "add_edges": edges}})


def _node(name, kind, cite="P1"):
    return {"name": name, "entity_type": kind, "description": f"{name} is described here.", "source_components": [cite]}


cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGES = {
    1: ("Alpha Lab studies rivers.", [_node("Alpha Lab", "organization"), _node("River Study", "work_of_art")],
        [{"src": "Alpha Lab", "tgt": "River Study", "relation": "published", "source_components": ["P1"]}]),
    2: ("The laboratory Alpha hired Ada.", [_node("Laboratory Alpha", "organization"), _node("Ada", "person")],
        [{"src": "Ada", "tgt": "Laboratory Alpha", "relation": "works at", "source_components": ["P1"]}]),
    3: ("Rivers carry sand. Nothing else.", [_node("Sand", "product"), _node("Nowhere", "location", "Z9")],
        [{"src": "Sand", "tgt": "Ghost", "relation": "moved by", "source_components": ["P1"]}]),
}


def answer_model(prompt, images):
    if prompt.startswith("List the entities"):
        page = int(prompt.split("page ")[1].split(" ")[0])
        return "Here you go: " + _reply(*PAGES[page][1:])
    if prompt.startswith("Review"):
        return json.dumps({"summary": "fine", "component_reviews": [{"component_id": "P1", "status": "covered"}], "stop_recommendation": "page 3" not in prompt})
    if prompt.startswith("Revise"):
        assert "Stubs to upgrade (1" in prompt and "Ghost" in prompt
        return json.dumps({"ops": {"replace_nodes": [{"name": "Ghost", "entity_type": "person", "source_components": ["P1"]}]}})
    if prompt.startswith("Which candidates"):
        if "- name: Alpha Lab\n" in prompt.split("Candidates:")[0]:
            return json.dumps([{"candidate": "Laboratory Alpha", "decision": "same_as", "rs": 10, "rationale": "same lab"}])
        return "[]"
    if prompt.startswith("Choose the route"):
        return '{"route": "document_level"}' if "whole" in prompt else '{"route": "nonsense"}'
    if prompt.startswith("Summarise"):
        return "A short summary."
    return json.dumps({"answer": "42", "confidence": "high", "cited_pages": []})


@pytest.fixture(scope="module")
def recipe(tmp_path_factory):
    base = tmp_path_factory.mktemp("run")
    data = base / "data"
    data.mkdir()
    info = [{"page_size": [300, 400], "preproc_blocks": [_block(0, "title", f"Page {n}", 0), _block(1, "text", t[0], 100), _block(2, "page_footer", "x", 390)]} for n, t in PAGES.items()]
    (data / "paper_middle.json").write_text(json.dumps({"pdf_info": info}))
    recipe = base / "recipe.yaml"
    recipe.write_text(
        "extends: [base.yaml, encoder.mock.yaml, llm.mock.yaml]\n"
        f"dataset: {{name: t, data_dir: '{data}', work_dir: '{base / 'work'}'}}\ningest: {{parser: mineru}}\n"
    )
    return base, recipe


@pytest.fixture(scope="module")
def run(spark, recipe):
    base, recipe = recipe
    cfg = config.load(recipe, {"query.qgge.rounds": "2", "kg.extract.max_rounds": "2"})
    llm = FunctionCompletion(answer_model)
    build = Build(spark, cfg, llm=llm)
    build.run(["ingest", "augment", "extract", "align", "cards", "embed", "index", "retrieval_graph"])
    return base, recipe, cfg, llm


def test_tables(spark, run):
    _, _, cfg, _ = run
    ws = Workspace(spark, cfg.dataset.work_dir)
    assert ws.load("pages").count() == 3
    names = {r.name: r for r in ws.load("nodes").collect()}
    # merged pair keeps one name, the ungrounded node is gone, the stub got its type
    assert ("Alpha Lab" in names) != ("Laboratory Alpha" in names)
    assert "Nowhere" not in names
    assert names["Ghost"].entity_type == "person"
    lab = names.get("Alpha Lab") or names["Laboratory Alpha"]
    assert lab.source_pages == [1, 2]
    rel = {(r.relation, r.edge_type) for r in ws.load("edges").collect()}
    assert rel == {("published", "semantic"), ("works at", "semantic"), ("moved by", "semantic")}
    index = ws.load_index(256)
    kinds = {r.evidence_type: r["count"] for r in index.groupBy("evidence_type").count().collect()}
    assert kinds == {"page": 3, "entity": 5, "relation": 3}
    manifest = ws.read_json(cfg.obs.manifest_path)
    assert manifest["status"] == "ok" and manifest["totals"]["llm_calls"] > 0
    snaps = ws.load("snapshots")
    assert snaps.filter("page_id = 3").count() > snaps.filter("page_id = 1").count()
    stages = {r.stage: r.calls for r in report(ws).collect()}
    assert stages["kg.extract.init"] == 1 and stages[None] >= 8


@pytest.mark.parametrize("how", ["qgge", "ppr"])
def test_questions(spark, run, how):
    base, recipe, _, llm = run
    cfg = config.load(recipe, {"query.propagation": how, "query.reranker.enabled": "true"})
    file = base / f"q_{how}.jsonl"
    file.write_text('{"qid": "a", "question": "Who works at the laboratory?"}\n\n{"qid": "b", "question": "the whole story"}\n{"qid": "c"}\n')
    asked = read_questions(spark, str(file))
    out = {r.qid: r for r in ask(spark, cfg, asked, llm=llm).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"].route == "multi" and out["b"].route == "document_level"
    assert out["a"].answer == "42" and out["a"].confidence == "high" and out["a"].answer_mode == "texts"
    assert out["a"].cited_pages


def test_answers_file_and_mock(spark, run):
    base, recipe, _, _ = run
    cfg = config.load(recipe)
    asked = spark.createDataFrame([("x", "Rivers?")], "qid string, question string")
    got = ask(spark, cfg, asked, llm=CannedCompletion({"Question: Rivers?": "plain words"}))
    write_answers(got, str(base / "answers"))
    row = spark.read.json(str(base / "answers")).first()
    assert row.answer == "plain words" and row.confidence == "low"
    assert sorted(row.asDict()) == ["answer", "answer_mode", "cited_pages", "confidence", "qid", "question", "route"]


def test_precomputed_vectors_match(spark, run):
    _, _, cfg, llm = run
    b = Build(spark, cfg, llm=llm)
    b.align_embed()
    assert Workspace(spark, cfg.dataset.work_dir).load("node_vectors").count() == 5


def test_failed_calls_are_recorded(spark, recipe):
    base, recipe = recipe

    def broken(prompt, images):
        if "page 2" in prompt:
            raise ValueError("no answer")
        return answer_model(prompt, images)

    cfg = config.load(recipe, {"dataset.work_dir": str(base / "work2"), "augment.page_summary.enabled": "false", "kg.extract.max_rounds": "1"})
    b = Build(spark, cfg, llm=FunctionCompletion(broken))
    b.run(["ingest", "extract"])
    failures = Workspace(spark, cfg.dataset.work_dir).read_json(cfg.obs.manifest_path)["failures"]
    assert {(f["page_id"], f["stage"]) for f in failures} == {(2, "extract"), (2, "reflect")}
    with pytest.raises(StageError):
        b.run(["nonsense"])
    with pytest.raises(ConfigError):
        config.load(recipe, {"query.nonsense": "1"})


def test_missing_graph(spark, recipe):
    base, recipe = recipe
    cfg = config.load(recipe, {"dataset.work_dir": str(base / "nowhere"), "query.propagation": "ppr"})
    with pytest.raises(StageError):
        Artifacts.load(spark, cfg)
