"""Operators against brute force on small random inputs."""

import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire import config
from quire.functions import ids, text
from quire.functions.json import loose_object, strict_json
from quire.operators import align, dedupe, graphs, knn, layout, merge, ordering, patch
from quire.providers.models import CannedCompletion, HashedEncoder
from quire.providers.registry import names
from quire.sources.workspace import Workspace


def test_ids_match_uuid5(spark):
    rows = [("doc %d" % i, "Näme %d é" % i) for i in range(50)]
    df = spark.createDataFrame(rows, "d string, n string").select("d", "n", ids.entity_id(F.col("d"), F.col("n")).alias("e"))
    for r in df.collect():
        assert r.e == "E:" + uuid.uuid5(uuid.NAMESPACE_OID, f"{r.d}::{r.n.lower()}").hex[:12]


def test_relation_names(spark):
    cases = {"applies to": "applies_to", "Is Part Of": "is_part_of", "is-related-to": "is_related_to", "": "", "x" * 81: "", " (a) / b! ": "a_b", "ünder": "ünder"}
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", text.normalize_relation(F.col("r")).alias("n"))
    assert {r.r: r.n for r in df.collect()} == cases


def _relation_tokens(rel):
    out = set()
    for tok in rel.lower().replace("-", " ").replace("_", " ").split():
        if tok in text.RELATION_STOPWORDS:
            continue
        for suffix in sorted(text.RELATION_SUFFIXES, key=len, reverse=True):
            if tok.endswith(suffix) and len(tok) >= len(suffix) + 3:
                tok = tok[: len(tok) - len(suffix)]
                break
        if len(tok) >= 3:
            out.add(tok)
    return out


def test_relation_tokens(spark):
    rels = ["committed to achieving", "is the publisher of", "publishes", "organization_of", "Efficiency-based", "to of", "s", "nations nations"]
    df = spark.createDataFrame([(r,) for r in rels], "r string").select("r", text.relation_tokens(F.col("r")).alias("t"))
    assert {r.r: set(r.t) for r in df.collect()} == {r: _relation_tokens(r) for r in rels}


def _compact_slow(desc):
    frags = [f.strip() for f in text._SPLIT_RE.split(desc) if f.strip()]
    if len(frags) < 2:
        return desc.strip()
    sets = [text.fragment_tokens(f) for f in frags]
    keep = []
    for i, s in enumerate(sets):
        rank = lambda j: (-len(sets[j]), -len(frags[j]), j)
        if s and not any(s <= sets[j] and rank(j) < rank(i) for j in range(len(frags))):
            keep.append(i)
    last = {f: i for i, f in enumerate(frags)}
    return " ".join(frags[i] for i in sorted(keep, key=lambda i: last[frags[i]]))


def test_compact_against_pairs():
    rnd = random.Random(1)
    words = "river sand water stone lab ada study carries moving moved rivers".split()
    for _ in range(500):
        d = " ".join(" ".join(rnd.choices(words, k=rnd.randint(1, 4))) + rnd.choice([".", "!", " <SEP>"]) for _ in range(rnd.randint(1, 8)))
        assert text.compact(d, 10**6) == _compact_slow(d)
        once = text.compact(d, 10**6)
        assert text.compact(once, 10**6) == once or "<SEP>" in d
    assert len(text.compact("abcd efgh. " * 2 + "xyz uvw. " + "many words here. " * 3, 20)) <= 20


@pytest.mark.parametrize("cap", [200, 4000])
def test_fold_in_slices(spark, cap):
    rnd = random.Random(cap)
    words = "river sand water stone lab ada study carries moving moved rivers bridge copper".split()
    said = [" ".join(" ".join(rnd.choices(words, k=rnd.randint(1, 6))) + "." for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    rows = [(k, None if k == "odd" else 1, i, rnd.choice(said)) for k, n in (("hot", 230), ("odd", 40), ("one", 1), ("two", 2)) for i in range(n)] + [("none", 1, 0, "")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, j int, o int, t string")
    want = {}
    for k, _, _, t in sorted(rows, key=lambda r: r[2]):
        if t:
            want[k] = text.appended(want.get(k, ""), t, cap)
    for size in (7, 100, 10**6):
        got = {r.k: r.t for r in ordering.fold_texts(df, ["k", "j"], "o", "t", cap, slice_rows=size).filter("j IS NOT NULL").collect()}
        assert got == {k: t for k, t in want.items() if k != "odd"}, size
    odd = ordering.fold_texts(df.filter("k = 'odd'"), ["k"], "o", "t", cap, slice_rows=7).first()
    assert odd.t == want["odd"]


def test_ordinal_and_large_limits(spark):
    rows = [("a" if i % 3 else "b", (i * 7919) % 1000) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = sorted((r.k, r.v, r.n) for r in ordering.ordinal(df, ["k"], ["v"], "n").collect())
    want = sorted((k, v, n) for k in "ab" for n, v in enumerate(sorted(v for kk, v in rows if kk == k)))
    assert got == want
    top = ordering.top_per_group(spark.range(5000).select(F.lit(1).alias("g"), "id"), ["g"], ["id"], 1500)
    assert sorted(r.id for r in top.collect()) == list(range(1500))


@pytest.fixture(scope="module")
def points():
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 16))
    m = centres[rnd.integers(0, 6, 300)] + 0.3 * rnd.normal(size=(300, 16))
    m[200:] = m[0] + 0.05 * rnd.normal(size=(100, 16))  # one cell holds a third of the rows
    return m


def _brute(m, k, mask):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(m)):
        row = s[i].copy()
        if mask:
            row[[j for j in range(len(m)) if j % 25 == i % 25]] = -np.inf
        for rank, j in enumerate(np.lexsort((np.arange(len(m)), -row))[:k]):
            out.add((i, int(j), rank + 1))
    return out


def test_search_both_forms(spark, points, monkeypatch):
    rows = [(i, [float(x) for x in v], [i % 25]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>, pages array<int>")
    asks = df.select(F.col("id").alias("qid"), "vector")
    scan = {(r.qid, r.id, r["rank"]) for r in knn.topk(asks, df.drop("pages"), 5).collect()}
    assert scan == _brute(points, 5, False)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 30)
    monkeypatch.setattr(knn, "MAX_SCAN_QUERIES", 10)
    cells = {(r.qid, r.id, r["rank"]) for r in knn.topk(asks, df.drop("pages"), 5).collect()}
    assert cells == scan
    near = {(r.qid, r.id, r["rank"]) for r in knn.neighbours(df, 5).collect()}
    assert near == _brute(points, 5, True)


class _Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def test_components(spark):
    rnd = random.Random(5)
    edges = [(f"n{rnd.randint(0, 150):03d}", f"n{rnd.randint(0, 150):03d}") for _ in range(110)] + [("hub", f"n{i:03d}") for i in range(40)]
    sets = _Sets()
    for a, b in edges:
        sets.join(a, b)
    got = {r.id: r.component for r in graphs.connected_components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: sets.find(x) for x in ends}


def _rescue_in_order(judged, nodes, extracted):
    """Plain sequential reading of the tiered rule."""
    pair = lambda e: frozenset((e["src_id"], e["tgt_id"]))
    pairs = {pair(e) for e in extracted}
    sets, kept, deg = _Sets(), {}, {}
    strong = []
    for e in sorted((e for e in judged if e["edge_type"] != "same_as" and e["confidence"] >= 0.9), key=lambda e: (-e["confidence"], e["seq"])):
        if pair(e) not in pairs:
            pairs.add(pair(e))
            strong.append(e)
            kept[e["edge_id"]] = "strong"
    same = [e for e in judged if e["edge_type"] == "same_as"]
    for e in same:
        pairs.add(pair(e))
        kept[e["edge_id"]] = "same_as"
    for e in extracted + strong + same:
        if e["src_id"] in nodes and e["tgt_id"] in nodes:
            sets.join(e["src_id"], e["tgt_id"])
        for x in {e["src_id"], e["tgt_id"]}:
            deg[x] = deg.get(x, 0) + 1
    weak = [e for e in judged if e["edge_type"] != "same_as" and 0.7 <= e["confidence"] < 0.9]
    for e in sorted(weak, key=lambda e: (-max(deg.get(e["src_id"], 0), deg.get(e["tgt_id"], 0)), -e["confidence"], e["seq"])):
        if pair(e) not in pairs and sets.join(e["src_id"], e["tgt_id"]):
            kept[e["edge_id"]] = "bridge"
            pairs.add(pair(e))
    for e in sorted(weak, key=lambda e: (-e["confidence"], e["seq"])):
        s, t = nodes.get(e["src_id"]), nodes.get(e["tgt_id"])
        if e["edge_id"] not in kept and pair(e) not in pairs and s and t and s != t and e["confidence"] >= 0.8:
            kept[e["edge_id"]] = "cross_modality"
            pairs.add(pair(e))
    return kept


def test_rescue_against_sequential(spark):
    rnd = random.Random(11)
    nodes = {f"n{i:02d}": rnd.choice(["text", "visual"]) for i in range(40)}
    pick = lambda: f"n{rnd.randint(0, 42):02d}"  # noqa: E731 - some endpoints are unknown

    def edge(i, kind="semantic", conf=None):
        return {"edge_id": f"e{i:03d}", "src_id": pick(), "tgt_id": pick(), "relation": "r", "edge_type": kind, "confidence": conf or rnd.choice([0.7, 0.8, 0.9, 1.0]), "seq": i}

    judged = [edge(i) for i in range(70)] + [edge(100 + i, "same_as", 0.9) for i in range(4)]
    extracted = [edge(200 + i) for i in range(12)]
    ddl = "edge_id string, src_id string, tgt_id string, relation string, edge_type string, confidence double, seq int"
    table = lambda es: spark.createDataFrame([tuple(e.values()) for e in es], ddl)
    got = align.rescue(table(judged), spark.createDataFrame(list(nodes.items()), "entity_id string, modality string"), table(extracted))
    assert {r.edge_id: r.kept_as for r in got.collect()} == _rescue_in_order(judged, nodes, extracted)


def test_rescue_makes_its_inputs_once(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType

    made = {"nodes": spark.sparkContext.accumulator(0), "extracted": spark.sparkContext.accumulator(0)}

    def seen(name, column):
        count = made[name]

        def same(x):
            count.add(1)
            return x

        return F.udf(same, StringType())(column)

    nodes = spark.createDataFrame([(f"n{i}", "text" if i % 2 else "visual") for i in range(6)], "entity_id string, modality string")
    nodes = nodes.withColumn("entity_id", seen("nodes", "entity_id"))
    extracted = spark.createDataFrame([("x0", "n0", "n1"), ("x1", "n2", "n3")], "edge_id string, src_id string, tgt_id string")
    extracted = extracted.withColumn("src_id", seen("extracted", "src_id"))
    judged = spark.createDataFrame(
        [("e0", "n4", "n5", "r", "semantic", 0.9, 0), ("e1", "n1", "n2", "r", "semantic", 0.7, 1), ("e2", "n0", "n3", "r", "semantic", 0.8, 2)],
        "edge_id string, src_id string, tgt_id string, relation string, edge_type string, confidence double, seq int",
    )
    got = align.rescue(judged, nodes, extracted)
    assert {r.edge_id: r.kept_as for r in got.collect()} == {"e0": "strong", "e2": "bridge"}
    assert {k: v.value for k, v in made.items()} == {"nodes": 6, "extracted": 2}


def test_near_duplicates_against_greedy(spark):
    rnd = random.Random(2)
    words = "part whole linked makes using river".split()
    edges = []
    for i in range(120):
        rel = " ".join(rnd.sample(words, rnd.randint(1, 3))) if rnd.random() > 0.1 else "is of"
        edges.append((f"e{i:03d}", "s", rnd.choice("tu"), rel, rnd.choice([0.5, 0.9]), rnd.choice(["", "one.", "two."]), [i % 7]))
    df = spark.createDataFrame(edges, "edge_id string, src_id string, tgt_id string, relation string, confidence double, description string, source_pages array<bigint>")
    got = {r.edge_id: (r.description, r.source_pages) for r in dedupe.collapse_near_duplicates(df).collect()}
    want = {}
    for tgt in "tu":
        group = sorted((e for e in edges if e[2] == tgt), key=lambda e: (-len(_relation_tokens(e[3])), -e[4], -len(e[3]), e[0]))
        clusters = []
        for e in group:
            toks = _relation_tokens(e[3])
            home = next((c for c in clusters if (toks and toks <= c[0]) or (not toks and not c[0])), None)
            if home:
                home[1].append(e)
            else:
                clusters.append((toks, [e]))
        for _, ms in clusters:
            said = list(dict.fromkeys(m[5] for m in ms if m[5]))
            want[ms[0][0]] = (" ".join(said), sorted({p for m in ms for p in m[6]}))
    assert got == want


def test_merge_rules(spark):
    rows = [
        (0, "E:1", "d", "Lab", "organization", "text", "First fact.", None, None, [2], False),
        (1, "E:1", "d", "LAB", "group", "visual", "Second fact.", "photo", "figure_panel", [1], False),
        (2, "E:1", "d", "The Lab", "person", "text", "First fact.", "", None, [2, 3], True),
    ]
    df = spark.createDataFrame(rows, "o int, entity_id string, doc_id string, name string, entity_type string, modality string, description string, visual_description string, visual_type string, source_pages array<bigint>, newer boolean")
    plain = merge.merge_nodes(df, ["entity_id"], ["o"]).first()
    assert (plain.name, plain.entity_type, plain.modality, plain.visual_type) == ("Lab", "organization", "visual", "figure_panel")
    assert plain.source_pages == [1, 2, 3] and plain.description == "First fact. Second fact."
    newer = merge.merge_nodes(df, ["entity_id"], ["o"], prefer_new="newer").first()
    assert (newer.name, newer.entity_type, newer.modality, newer.visual_description) == ("The Lab", "person", "text", "photo")


def test_json(spark):
    cases = {
        '{"a": 1}': '{"a":1}', 'talk {"a": 1} talk': '{"a":1}', '[{"a": 1}]': '{"a":1}', '[{"a":1},{"b":2}]': "{}", "3": "{}", "nothing": "{}",
        '```json\n{"a": [1]}\n```': "{}", '{"a":1} tail': '{"a":1}', 'x {"a": [1], "b": [2]} y': '{"a":[1],"b":[2]}',
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.to_json(loose_object(F.col("t"))).alias("o"), strict_json(F.col("t")).isNotNull().alias("s"))
    out = {r.t: (r.o, r.s) for r in df.collect()}
    assert {k: v[0] for k, v in out.items()} == cases
    for k, (_, strict) in out.items():
        try:
            json.loads(k)
            assert strict
        except json.JSONDecodeError:
            assert not strict


def test_layout_merge(spark):
    def b(i, kind, x0, y0, x1, y1, t="x"):
        return (i, kind, float(x0), float(y0), float(x1), float(y1), None, t, None, None)

    blocks = [b(5, "image", 0, 221, 100, 300, None), b(0, "text", 0, 0, 100, 20, "a"), b(1, "text", 0, 30, 100, 50, "b"), b(2, "text", 60, 60, 160, 80, "c"), b(3, "text", 0, 180, 100, 200, "far"),
              b(4, "list", 0, 210, 100, 220), b(6, "list", 0, 301, 100, 320), b(7, "list", 0, 317, 100, 330), b(8, "odd", 0, 400, 9, 410), b(9, "text", 0, 500, 100, 510, ""), b(10, "text", 0, 511, 100, 520, None)]
    schema = "raw array<struct<block_id:int,type:string,x0:double,y0:double,x1:double,y1:double,score:double,text_full:string,html:string,image_path:string>>"
    df = spark.createDataFrame([(blocks,), ([],)], schema)
    out, none = [r.c for r in df.select(layout.folded(F.col("raw"), F.lit(30)).alias("c")).collect()]
    assert none == [] and [(p.component_id, p.block_ids) for p in out] == [
        ("P1", [0, 1]), ("P2", [2]), ("P3", [3]), ("L1", [4]), ("IM1", [5]), ("L2", [6]), ("L3", [7]), ("X1", [8]), ("P4", [9, 10])]
    assert out[0].text_full == "a b" and out[0].merged and not out[1].merged and out[8].text_full is None
    assert (out[0].x0, out[0].y0, out[0].x1, out[0].y1) == (0, 0, 100, 50)
    single = df.select(layout.folded(F.col("raw"), F.lit(30), merge=False).alias("c")).first().c
    assert [p.block_ids[0] for p in single] == [r[0] for r in blocks] and [p.component_id for p in single][:3] == ["IM1", "P1", "P2"]
    placed = layout.annotate([p.asDict() for p in out[:8]], 300, 330)
    assert placed[0]["position"] == "upper-left" and placed[0]["neighbours"] == {"below": "P3", "right": "P2"}


def test_encoder_matches_spec(spark):
    import hashlib

    text_in, img = "Hello hello World", "a/b.png"
    v = np.zeros(64)
    for tok in text_in.lower().split():
        h = int(hashlib.md5(tok.encode()).hexdigest()[:16], 16)
        v[h % 64] += 1 if h & 1 else -1
    v[(int(hashlib.sha1(img.encode()).hexdigest()[:16], 16) + 7) % 64] += 0.5
    v[63] += 0.25
    df = spark.createDataFrame([(text_in, img), ("", None)], "t string, i string").select(HashedEncoder(64).vector(F.col("t"), F.col("i")).alias("v"))
    got = [r.v for r in df.collect()]
    assert np.allclose(got[0], v / np.linalg.norm(v), atol=1e-6) and not any(got[1])


def test_config_and_registry(tmp_path):
    (tmp_path / "a.yaml").write_text("extends: [b.yaml]\nquery: {qgge: {rounds: 9}}\n")
    (tmp_path / "b.yaml").write_text("dataset: {name: n, data_dir: d, work_dir: w}\nquery: {qgge: {rounds: 1, page_beam: 5}}\n")
    cfg = config.load(tmp_path / "a.yaml", {"encoder.dim": "8"})
    assert (cfg.query.qgge.rounds, cfg.query.qgge.page_beam, cfg.encoder.dim) == (9, 5, 8)
    assert cfg.hash() == config.load(tmp_path / "a.yaml", {"encoder.dim": "8", "query.qgge.rounds": "2", "dataset.work_dir": "z"}).hash()
    assert [config.coerce(x) for x in ("true", "7", "007", "0.5", "x")] == [True, 7, "007", 0.5, "x"]
    assert config.llm_section(cfg, "vllm:m")["model"] == "m"
    assert "mock" in names("encoder") and "mock" in names("llm")


def test_canned_completion(spark):
    df = spark.range(1).select(CannedCompletion({"abc": "one two three"}).reply(F.lit("say abc now")).alias("r")).first().r
    assert (df.text, df.prompt_tokens, df.completion_tokens) == ("one two three", 3, 3)


def test_streams_equal_batches(spark, tmp_path):
    from quire.operators.stats import rollup_trace
    from quire.schemas import SPAN
    from quire.streaming import views

    ws = Workspace(spark, str(tmp_path / "ws"))
    spans = [dict(span_id=str(i), stage=f"s{i % 3}", elapsed_ms=float(i), ok=i % 4 != 0, total_tokens=i, type="stage_timing") for i in range(20)]
    for half in (spans[:10], spans[10:]):
        ws.append_spans(half)
    q = views.running_rollup(views.trace_stream(spark, ws.path("trace"))).writeStream.outputMode("complete").format("memory").queryName("rollup").trigger(availableNow=True).start()
    q.awaitTermination()
    stream = {r.stage: (r.calls, r.wall_ms, r.total_tokens, r.errors) for r in spark.table("rollup").collect()}
    batch = {r.stage: (r.calls, r.wall_ms, r.total_tokens, r.errors) for r in rollup_trace(ws.spans()).collect() if r.stage}
    assert stream == batch and len(stream) == 3
    assert SPAN

    feed = str(tmp_path / "feed")
    schema = "evidence_id string, payload string, pos bigint"
    for rows in ([("a", "1", 0), ("b", "1", 1)], [("a", "2", 0), ("c", "2", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(feed)
        src = spark.readStream.schema(schema).json(feed)
        views.upsert_stream(src, ws, "cards", str(tmp_path / "cp")).awaitTermination()
    got = {r.evidence_id: (r.payload, r.batch, r.pos) for r in views.stored(ws, "cards").read().collect()}
    assert got == {"a": ("2", 0, 0), "b": ("1", 0, 1), "c": ("2", 1, 1)}


def test_saturation_stream_equals_batch(spark, tmp_path):
    from quire.streaming import views

    rnd = random.Random(4)
    statuses = [*patch.SATURATING, *patch.REOPENING]
    rows = [("d", 1, f"P{rnd.randint(1, 4)}", r, s, rnd.choice(statuses), rnd.randint(0, 5)) for r in range(6) for s in range(5)]
    base = spark.createDataFrame(rows, "doc_id string, page_id bigint, component_id string, round int, seq int, status string, n_nodes bigint")
    comps = spark.createDataFrame([("d", 1, f"P{i}", "paragraph" if i < 3 else "text", "x" * 300, None) for i in range(1, 5)], "doc_id string, page_id bigint, component_id string, type string, text_full string, html string")
    counts = base.groupBy("doc_id", "page_id", "round", "component_id").agg(F.max("n_nodes").alias("n_nodes"))
    effects = patch.judge_reviews(base.drop("n_nodes"), comps, counts)
    state, log = patch.saturation(effects)
    full = base.drop("n_nodes").join(counts, ["doc_id", "page_id", "round", "component_id"]).withColumn("guarded", F.col("component_id").isin("P1", "P2")).withColumn("content_len", F.lit(300))
    feed = str(tmp_path / "reviews")
    full.coalesce(1).write.json(feed)
    src = spark.readStream.schema(full.schema).json(feed)
    q = views.saturation_stream(src).writeStream.outputMode("update").format("memory").queryName("sat").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.component_id, r.decision) for r in spark.table("sat").collect())
    assert got == sorted((r.component_id, r.effect) for r in log.collect())
    assert state.count() <= 4


def test_communities(spark):
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    edges = clique([f"a{i}" for i in range(6)]) + clique([f"b{i}" for i in range(4)]) + [("x", "y")]
    got = {}
    for r in graphs.communities(spark.createDataFrame(edges, "src string, dst string")).collect():
        got.setdefault(r.community_id, set()).add(r.id)
    assert got == {"C0": {f"a{i}" for i in range(6)}, "C1": {f"b{i}" for i in range(4)}}
    with pytest.raises(ValueError):
        graphs.communities(spark.createDataFrame(edges, "src string, dst string"), algorithm="nonsense")
