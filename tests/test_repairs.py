"""Small cases of replies, questions, providers, tables and searches that once went wrong."""

import io
import json
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.errors import ProviderError
from quire.operators import align, graphs, knn
from quire.providers import models
from quire.sources.documents import read_layouts
from quire.sources.workspace import Workspace


def _judged(spark, reply):
    replies = spark.createDataFrame([("s", reply)], "src_id string, reply string")
    shown = spark.createDataFrame([("s", "t", 1)], "src_id string, tgt_id string, rank int")
    nodes = spark.createDataFrame([(i, n, "person", [1]) for i, n in (("s", "Me"), ("t", "Ada"))], "entity_id string, name string, entity_type string, source_pages array<bigint>")
    return align.decode_judgements(replies, shown, nodes, rs_floor=0).select("confidence").collect()


@pytest.mark.parametrize("wrap,n", [
    ('{"pairs": [X], "note": "n"}', 1), ('{"note": "n", "pairs": [X]}', 0), ('{"a": 1, "decisions": [X]}', 1), ('{"b.c d": [X], "a": 0}', 1), ("{}", 0),
])
def test_wrapped_replies(spark, wrap, n):
    item = '{"candidate": "Ada", "decision": "related", "rs": 8, "relation": "knows"}'
    assert len(_judged(spark, wrap.replace("X", item))) == n


@pytest.mark.parametrize("rs,want", [("8", 0.8), ("8.75", 0.8), ('"8"', 0.8), ('" 8 "', 0.8), ('"8.7"', 0.0), ('"high"', 0.0), ("null", 0.0), ("8.12345", 0.8)])
def test_scores_of_replies(spark, rs, want):
    got = _judged(spark, '[{"candidate": "Ada", "decision": "related", "rs": RS, "relation": "knows"}]'.replace("RS", rs))
    assert [r.confidence for r in got] == [want]


def test_only_passing_faults_are_tried_again(monkeypatch):
    calls = []

    def fails(codes):
        left = iter(codes)

        def open_(req, timeout):
            code = next(left)
            calls.append(code)
            if code == 200:
                return io.BytesIO(json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode())
            raise urllib.error.HTTPError(req.full_url, code, "no", {}, None)

        return open_

    monkeypatch.setattr(models.time, "sleep", lambda s: None)
    call = models._http_factory("openai")("m").call
    for codes, tried in (([401], 1), ([400], 1), ([429, 503, 200], 3)):
        calls.clear()
        monkeypatch.setattr(urllib.request, "urlopen", fails(codes))
        if codes[-1] == 200:
            assert call("q", [])["text"] == "yes"
        else:
            with pytest.raises(ProviderError):
                call("q", [])
        assert len(calls) == tried


def test_images_travel_as_data(tmp_path):
    (tmp_path / "p.png").write_bytes(b"\x89PNG")
    assert models.image_url(str(tmp_path / "p.png")) == models.image_url(f"file://{tmp_path}/p.png") == "data:image/png;base64,iVBORw=="
    assert models.image_url("https://x/p.png") == "https://x/p.png"


def test_table_switch_recovers(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    ws.save("t", spark.range(3).toDF("v"))
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if the switch had ended here
    assert ws.load("t").count() == 3
    ws.save("t", ws.load("t").withColumn("v", F.col("v") + 1))
    assert sorted(r.v for r in ws.load("t").collect()) == [1, 2, 3] and not (tmp_path / "t.old").exists()


def test_bad_layouts_are_seen(spark, tmp_path):
    (tmp_path / "good_middle.json").write_text(json.dumps({"pdf_info": [{"page_size": [10, 10], "preproc_blocks": []}]}))
    (tmp_path / "empty_middle.json").write_text(json.dumps({"pdf_info": []}))
    (tmp_path / "broken_middle.json").write_text('{"pdf_info": [')
    got = {(r.doc_id, r.page_id) for r in read_layouts(spark, str(tmp_path)).collect()}
    assert got == {("good", 1), ("empty", None), ("broken", None)}


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("bound", [10, 4096])
def test_search_within(spark, monkeypatch, metric, bound):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 25)
    monkeypatch.setattr(knn, "MAX_SCAN_QUERIES", bound)
    rng = np.random.default_rng(2)
    m, doc = rng.normal(size=(90, 8)), [f"d{i % 4}" for i in range(90)]
    items = spark.createDataFrame([(i, v.tolist(), doc[i]) for i, v in enumerate(m)], "id bigint, vector array<double>, doc string")
    asks = spark.createDataFrame([(i, m[i].tolist(), None if i % 3 else doc[i]) for i in range(30)], "qid bigint, vector array<double>, doc string")
    got = {(r.qid, r.id, r["rank"]) for r in knn.topk(asks, items, 5, metric=metric, within="doc").collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True) if metric == "cosine" else m
    for q in range(30):
        s = np.round(u[q] @ u.T, 6)
        ok = [i for i in range(90) if q % 3 or doc[i] == doc[q]]
        want = sorted(ok, key=lambda i: (-s[i], i))[:5]
        assert {(q, i, n + 1) for n, i in enumerate(want)} == {g for g in got if g[0] == q}


def test_labels_come_to_rest(spark):
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("n000", "n020"), ("n005", "n033")]
    edges = spark.createDataFrame(path, "src string, dst string")
    label = {r.id: r.label for r in graphs.label_propagation(edges).collect()}
    around = {}
    for a, b in path:
        around.setdefault(a, []).append(label[b])
        around.setdefault(b, []).append(label[a])
    assert all(ls.count(label[v]) == max(map(ls.count, ls)) for v, ls in around.items())
