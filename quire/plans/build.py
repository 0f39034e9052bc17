"""Build stages: ingest, augment, extract, align, cards, embed, index, retrieval_graph."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import config, obs
from quire.config import Config
from quire.errors import StageError
from quire.functions.ids import strip
from quire.functions.json import loose_object
from quire.functions.text import bracket_list
from quire.operators import align, cards, dedupe, knn, layout, merge, patch, render
from quire.operators import retrieval_graph as rg
from quire.operators.canonical import canonicalize
from quire.prompts import render as fill
from quire.prompts import template
from quire.providers import models  # noqa: F401 - registers the built-in providers
from quire.providers.registry import get
from quire.schemas import EDGES, NODES, PAGES, conform
from quire.session import materialize
from quire.sources.documents import drop_empty_pages, ingest
from quire.sources.workspace import Workspace

STAGES = ("ingest", "augment", "extract", "align", "cards", "embed", "index")
OPTIONAL_STAGES = ("retrieval_graph",)
PAGE = ["doc_id", "page_id"]
SUMMARY_CHARS = 6000
CONTEXT_CHARS = 400

_BRIEF = (
    "page_id bigint, summary string, focus_cues array<struct<component_id:string,priority:string,reason:string,requested_input:string>>, "
    "component_reviews array<struct<component_id:string,status:string,notes:array<string>>>, "
    "critiques array<struct<target_kind:string,target_ref:string,issue_type:string,severity:string,comment:string>>, "
    "stop_recommendation boolean"
)
# What a review may say.
LEVELS = ("high", "medium", "low")
INPUTS = ("annotated_page_only", "component_crop", "expanded_manifest", "table_html", "neighbor_context")


def encoder(cfg: Config):
    return get("encoder", cfg.encoder.name)(
        dim=cfg.encoder.dim, normalize=cfg.encoder.normalize, model=cfg.encoder.model, **cfg.encoder.extra.as_dict()
    )


def completion(cfg: Config, spec: str = "default"):
    section = config.llm_section(cfg, spec)
    extra = section.pop("extra") if section["kind"] == "mock" else {}
    return get("llm", section["kind"])(**section, **extra)


class Build:
    """One run of selected stages over one workspace."""

    def __init__(self, spark: SparkSession, cfg: Config, *, llm=None, judge=None):
        self.spark, self.cfg = spark, cfg
        self.ws = Workspace(spark, cfg.dataset.work_dir)
        self.tracer = obs.Tracer(self.ws, enabled=cfg.obs.tracer in ("jsonl", "both"))
        self._llm, self._judge = llm, judge
        self.failures: list[dict] = []

    # ---- control -------------------------------------------------------------------

    def run(self, stages: Iterable[str] | None = None, *, source: str | None = None, resume: bool = False) -> None:
        chosen = tuple(stages) if stages else STAGES
        unknown = [s for s in chosen if s not in STAGES + OPTIONAL_STAGES]
        if unknown:
            raise StageError(f"unknown stages: {', '.join(unknown)}; have {', '.join(STAGES + OPTIONAL_STAGES)}")
        started, status = obs.now(), "failed"
        try:
            with self.tracer.stage("build"):
                if "ingest" in chosen and not (resume and self.ws.exists("pages")):
                    with self.tracer.stage("ingest"):
                        self.ingest(source or self.cfg.dataset.data_dir)
                if "augment" in chosen and self.cfg.augment.page_summary.enabled:
                    with self.tracer.stage("augment.page_summary"):
                        self.augment()
                if "extract" in chosen:
                    with self.tracer.stage("extract"):
                        self.extract()
                if "align" in chosen and self.cfg.cross_page_alignment.enabled:
                    with self.tracer.stage("align"):
                        self.align()
                if {"cards", "embed", "index"} & set(chosen):
                    with self.tracer.stage("cards"):
                        self.index(embed=bool({"embed", "index"} & set(chosen)))
                if "retrieval_graph" in chosen:
                    with self.tracer.stage("retrieval_graph"):
                        self.retrieval_graph()
            status = "ok"
        finally:
            obs.write_manifest(self.ws, self.cfg, self.tracer, started, status=status, failures=self.failures)
            self.tracer.flush()

    def pages(self) -> DataFrame:
        p = self.ws.load("pages", schema=PAGES)
        return drop_empty_pages(p) if self.cfg.kg.extract.skip_empty_pages else p

    def _ask(self, rows: DataFrame, llm, prompt, images=None, label: str = "replies") -> DataFrame:
        """Call the model once per row and keep prompt-free rows; usage goes to the open span."""
        asked = rows.select(*[c for c in rows.columns], llm.reply(prompt, images).alias("r"))
        asked = materialize(asked, label)
        self.tracer.record_usage(asked)
        return asked

    def llm(self, spec: str = "default"):
        return self._llm or completion(self.cfg, spec)

    # ---- stages --------------------------------------------------------------------

    def ingest(self, source: str) -> None:
        rows = materialize(ingest(self.spark, self.cfg.ingest.parser, source), "ingest")
        broken = rows.filter("page_id IS NULL")
        self._record(broken.select(F.lit("ingest").alias("stage"), *PAGE, F.lit("layout file is broken or holds no page").alias("error")))
        rows = rows.filter("page_id IS NOT NULL")
        self.ws.save("pages", conform(rows, PAGES))
        if "blocks" in rows.columns:
            # Without a page size, boxes are scaled to the extent of the page's own blocks.
            parts = layout.page_components(layout.with_page_size(rows))
        else:
            # Without layout the whole page is one paragraph.
            parts = rows.filter(F.coalesce("text", F.lit("")) != "").select(
                *PAGE, F.lit("P1").alias("component_id"), F.array(F.lit(0)).alias("block_ids"), F.lit("paragraph").alias("type"),
                *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 1.0), ("y1", 1.0))],
                F.lit(None).cast("double").alias("score"), F.col("text").alias("text_full"),
                *[F.lit(None).cast("string").alias(c) for c in ("html", "image_path")], F.lit("body text").alias("role_hint"),
                F.lit("middle-center").alias("position"), F.create_map().cast("map<string,string>").alias("neighbours"),
                F.lit(False).alias("merged"), F.lit(0).alias("ord"),
            )
        self.ws.save("components", parts.withColumn("caption", F.lit(None).cast("string")))

    def augment(self) -> None:
        pages = self.pages()
        ask = fill(template("page_summary"), text=F.substring(F.coalesce("text", F.lit("")), 1, SUMMARY_CHARS))
        images = F.when(F.col("page_image_path").isNotNull(), F.array("page_image_path")).otherwise(F.array().cast("array<string>"))
        said = self._ask(pages, self.llm(self.cfg.augment.page_summary.llm), ask, images, "summaries")
        self.ws.save("pages", conform(said.withColumn("page_summary", strip(F.col("r.text"))), PAGES))

    def extract(self) -> None:
        """Rounds of extract, check, apply and review over all pages still active."""
        c, kg = self.cfg.kg.extract, self.cfg.kg
        llm = self.llm(c.llm)
        comps = self.ws.load("components")
        pages = materialize(self.pages().select(*PAGE, "text", "page_image_path"), "active")
        missing = pages.join(comps.select(*PAGE).distinct(), PAGE, "left_anti")
        self._record(missing.select(F.lit("extract").alias("stage"), *PAGE, F.lit("page has no components").alias("error")))
        active = materialize(pages.join(comps.select(*PAGE).distinct(), PAGE, "left_semi").withColumn("idle", F.lit(0)), "active")
        nodes = self.spark.createDataFrame([], "page_id bigint, ord int, " + NODES)
        edges = self.spark.createDataFrame([], "page_id bigint, ord int, " + EDGES)
        reviews: list[DataFrame] = []
        counts: list[DataFrame] = []
        briefs = saturated = None
        body = dict(page=F.col("page_id"), text=F.coalesce("text", F.lit("(no text)")))
        images = F.when(F.col("page_image_path").isNotNull(), F.array("page_image_path")).otherwise(F.array().cast("array<string>"))
        step = 0
        for turn in range(max(1, c.max_rounds)):
            here = comps.join(active.select(*PAGE), PAGE, "left_semi")
            plain = render.manifest_text(here)
            rows = active.join(plain, PAGE, "left")
            if turn == 0:
                with self.tracer.stage("kg.extract.init"):
                    ask = fill(
                        template("extract"), **body, manifest=F.coalesce("manifest", F.lit("(no components)")),
                        types=", ".join(kg.entity_types), visual_types=", ".join(kg.visual_entity_types),
                    )
                    said = self._ask(rows, llm, ask, images, "extract")
            else:
                with self.tracer.stage("kg.extract.revise", round=turn):
                    masked = render.manifest_text(here, saturated, patch.nodes_per_component(nodes))
                    rows = active.join(masked, PAGE, "left").join(self._cards(here, nodes, edges), PAGE, "left").join(
                        render.revision_brief(briefs, nodes), PAGE, "left"
                    )
                    ask = fill(
                        template("revise"), **body, manifest=F.coalesce("manifest", F.lit("(no components)")),
                        scorecard=F.col("scorecard"), brief=F.coalesce("brief_text", F.lit("(empty brief)")),
                    )
                    said = self._ask(rows, llm, ask, images, "revise")
            self._keep_failures(said, "extract")
            said = said.filter("r.ok")
            ops = materialize(patch.parse_replies(said.select(*PAGE, F.col("r.text").alias("reply"))), "parsed-ops")
            valid, tally = patch.validate(ops, nodes.select(*PAGE, "name", "entity_type", "source_components", "ord"), comps)
            resolved = patch.resolve(materialize(valid, "valid-ops"), comps)
            nodes2, edges2 = patch.apply_patch(nodes, edges, resolved, kg.description_max_chars)
            nodes2 = materialize(nodes2.withColumn("ord", F.lit(0)), "page-nodes")
            edges2 = materialize(edges2.withColumn("ord", F.lit(0)), "page-edges")
            grew = self._change(active, ops, nodes, edges, nodes2, edges2, resolved)
            nodes, edges = nodes2, edges2
            self._snapshot(active, nodes, edges, step, "init" if turn == 0 else "revise", tally)
            step += 1

            with self.tracer.stage("kg.extract.reflect", round=turn):
                rows = active.join(plain, PAGE, "left").join(self._cards(here, nodes, edges), PAGE, "left")
                ask = fill(template("reflect"), **body, manifest=F.coalesce("manifest", F.lit("(no components)")), scorecard=F.col("scorecard"))
                said = self._ask(rows, llm, ask, images, "reflect")
            self._keep_failures(said, "reflect")
            briefs = materialize(parse_briefs(said.filter("r.ok").select(*PAGE, F.col("r.text").alias("reply"))), "briefs")
            if c.saturation.enabled:
                seen = briefs.select(*PAGE, F.lit(turn).alias("round"), F.posexplode("component_reviews").alias("seq", "v"))
                reviews.append(seen.select(*PAGE, "round", "seq", "v.component_id", "v.status"))
                counts.append(patch.nodes_per_component(nodes).withColumn("round", F.lit(turn)))
                effects = patch.judge_reviews(
                    reduce(DataFrame.unionByName, reviews), comps, reduce(DataFrame.unionByName, counts),
                    min_chars=c.saturation.density_guard_min_chars, min_nodes=c.saturation.density_guard_min_nodes,
                )
                saturated = materialize(patch.saturation(materialize(effects, "effects"))[0], "saturated")
            else:
                saturated = comps.limit(0).select(*PAGE, "component_id")
            self._snapshot(active, nodes, edges, step, "reflector", None)
            step += 1
            idle = F.when(F.col("grew"), 0).otherwise(F.col("idle") + (1 if turn else 0))
            active = materialize(
                active.join(briefs.select(*PAGE, "stop_recommendation"), PAGE).join(grew, PAGE).withColumn("idle", idle)
                .filter((~F.col("stop_recommendation")) & (F.col("idle") < c.max_empty_revisions))
                .drop("stop_recommendation", "grew"),
                "active",
            )
            if not active.limit(1).count():
                break

        cap = kg.description_max_chars
        merged_n = merge.merge_nodes(nodes, ["entity_id"], ["doc_id", "page_id"], max_chars=cap)
        merged_e = merge.merge_edges(edges, ["edge_id"], ["doc_id", "page_id"], max_chars=cap)
        merged_n = materialize(dedupe.sanitize_types(merged_n, kg.entity_types, kg.visual_entity_types), "nodes")
        merged_e = dedupe.drop_orphan_edges(merged_n, merged_e)
        self.ws.save("nodes", merged_n)
        self.ws.save("edges", dedupe.collapse_near_duplicates(merged_e, cap))

    def _cards(self, comps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        return render.scorecards(comps, nodes, edges)

    def _keep_failures(self, said: DataFrame, stage: str) -> None:
        self._record(said.filter("NOT r.ok").select(F.lit(stage).alias("stage"), *PAGE, F.col("r.error").alias("error")))

    def _record(self, bad: DataFrame) -> None:
        """All failures go to a table; the manifest lists the first ones."""
        some = [r.asDict() for r in bad.limit(1000).collect()]
        if some:
            self.ws.append("failures", bad, ["stage"])
            self.failures += some

    def _change(self, active, ops, nodes, edges, nodes2, edges2, resolved) -> DataFrame:
        """(page, grew): whether the round's operations changed anything on the page."""
        n = lambda df, name: df.groupBy(*PAGE).agg(F.count("*").alias(name))
        new_nodes, new_edges, gone = resolved
        counted = (
            active.select(*PAGE).join(n(nodes, "n0"), PAGE, "left").join(n(nodes2, "n1"), PAGE, "left")
            .join(n(edges, "e0"), PAGE, "left").join(n(edges2, "e1"), PAGE, "left").join(n(ops, "o"), PAGE, "left")
            .join(n(new_nodes.filter("newer"), "rn"), PAGE, "left").join(n(new_edges.filter("newer"), "re"), PAGE, "left")
            .join(n(gone, "d"), PAGE, "left").fillna(0)
        )
        moved = (F.col("n1") > F.col("n0")) | (F.col("e1") > F.col("e0")) | (F.col("rn") + F.col("re") + F.col("d") > 0)
        return materialize(counted.select(*PAGE, ((F.col("o") > 0) & moved).alias("grew")), "grew")

    def _snapshot(self, active: DataFrame, nodes: DataFrame, edges: DataFrame, step: int, kind: str, tally: DataFrame | None) -> None:
        """Append the page state after this step."""
        ids = nodes.groupBy(*PAGE).agg(F.array_sort(F.collect_set("entity_id")).alias("node_ids"))
        keys = edges.groupBy(*PAGE).agg(
            F.array_sort(F.collect_set(F.concat_ws("|", "src_id", "tgt_id", "relation"))).alias("edge_keys")
        )
        rows = active.select(*PAGE).join(ids, PAGE, "left").join(keys, PAGE, "left")
        audit = F.lit(None).cast("string")
        if tally is not None:
            rows = rows.join(tally.select(*PAGE, F.to_json(F.struct(*patch.COUNTERS)).alias("_audit")), PAGE, "left")
            audit = F.col("_audit")
        none = F.array().cast("array<string>")
        self.ws.append(
            "snapshots",
            rows.select(
                *PAGE, F.coalesce("node_ids", none).alias("node_ids"), F.coalesce("edge_keys", none).alias("edge_keys"),
                F.lit(kind).alias("kind"), audit.alias("audit"), F.lit(self.tracer.run_id).alias("run_id"), F.lit(step).alias("round_idx"),
            ),
            ["run_id", "round_idx"],
        )

    def node_vectors(self) -> DataFrame:
        """(id, vector) of every entity, through the same card text the index uses."""
        deck = cards.entity_cards(self.ws.load("nodes"))
        return deck.select(F.expr("graph_refs['entity_id']").alias("id"), encoder(self.cfg).card_vector().alias("vector"))

    def align_embed(self) -> None:
        """Entity vectors ahead of time, so that alignment needs no encoder."""
        with self.tracer.stage("align.embed"):
            self.ws.save("node_vectors", self.node_vectors())
        self.tracer.flush()

    def align(self) -> None:
        c = self.cfg.cross_page_alignment
        nodes = self.ws.load("nodes", schema=NODES)
        edges = self.ws.load("edges", schema=EDGES)
        vectors = self.ws.load("node_vectors") if self.ws.exists("node_vectors") else self.node_vectors()
        where = F.transform("source_pages", lambda p: F.concat_ws("#", F.col("doc_id"), p.cast("string")))
        points = materialize(nodes.select(F.col("entity_id").alias("id"), where.alias("pages")).join(vectors, "id"), "points")
        if points.count() != nodes.count():
            raise StageError("entity vectors do not cover the entities; run align-embed again")
        pairs = materialize(knn.neighbours(points, c.candidate_top_k), "candidates").select(
            F.col("qid").alias("src_id"), F.col("id").alias("tgt_id"), "rank"
        )
        shown = entity_blocks(nodes, self.pages())
        tgt = shown.select(F.col("entity_id").alias("tgt_id"), F.col("block").alias("cand"))
        src = shown.select(F.col("entity_id").alias("src_id"), "block")
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cand"))), lambda x: x["cand"]), "\n\n")
        asks = pairs.join(tgt, "tgt_id").groupBy("src_id").agg(listed.alias("cands")).join(src, "src_id")
        judge = self._judge or self.llm(c.judge_llm)
        said = self._ask(asks, judge, fill(template("judge"), source=F.col("block"), candidates=F.col("cands")), None, "judged")
        judged = align.decode_judgements(
            said.filter("r.ok").select("src_id", F.col("r.text").alias("reply")), pairs, nodes,
            rs_same_as=c.rs_threshold_same_as, rs_floor=c.rs_threshold_rescue,
        )
        judged = align.drop_generic_hub_edges(materialize(judged, "decisions"))
        kept = align.rescue(
            judged, nodes, edges, strong=c.rs_threshold / 10, floor=c.rs_threshold_rescue / 10,
            cross_modality=c.rs_threshold_cross_modality / 10,
        )
        kept = align.first_per_link(kept)
        tag = F.when(F.col("kept_as").isin("bridge", "cross_modality"), F.map_concat("metadata", F.create_map(F.lit("rescue_reason"), "kept_as")))
        added = kept.withColumn("metadata", F.coalesce(tag, "metadata"))
        every = materialize(conform(edges, EDGES).unionByName(conform(added, EDGES)), "all-edges")
        if c.canonicalize_same_as:
            with self.tracer.stage("align.canonicalize"):
                cap = self.cfg.kg.description_max_chars
                nodes, every, _ = canonicalize(nodes, every, threshold=c.rs_threshold_same_as / 10, max_chars=cap)
                every = dedupe.collapse_near_duplicates(every, cap)
                self.ws.save("nodes", nodes)
        self.ws.save("edges", every)

    def index(self, *, embed: bool = True) -> None:
        ec = self.cfg.evidence_cards
        deck = cards.build_cards(
            self.pages(), self.ws.load("nodes", schema=NODES), self.ws.load("edges", schema=EDGES),
            page=ec.emit.page, entity=ec.emit.entity, relation=ec.emit.relation, image_only=ec.page_card.image_only,
        )
        if not embed:
            self.ws.save("cards", deck)
            return
        with self.tracer.stage("embed"):
            enc = encoder(self.cfg)
            self.ws.save_index(deck.withColumn("vector", enc.card_vector()), enc.dim, self.cfg.index.metric)

    def retrieval_graph(self) -> None:
        pages, nodes, edges = self.pages(), self.ws.load("nodes", schema=NODES), self.ws.load("edges", schema=EDGES)
        self.ws.save_graph(rg.graph_nodes(pages, nodes, edges), rg.graph_edges(pages, nodes, edges))


def parse_briefs(replies: DataFrame) -> DataFrame:
    """Review replies; one with a word outside its vocabulary counts as empty."""
    b = F.from_json(F.to_json(loose_object(F.col("reply"))), _BRIEF)
    rows = replies.select(*PAGE, b.alias("b"))
    inside = lambda col, field, words: F.coalesce(F.forall(col, lambda x: F.coalesce(x[field].isin(*words), F.lit(False))), F.lit(True))
    statuses = (*patch.SATURATING, *patch.REOPENING)
    asked = F.transform("b.focus_cues", lambda x: x.withField("requested_input", F.coalesce(x["requested_input"], F.lit(INPUTS[0]))))
    good = (
        inside(F.col("b.component_reviews"), "status", statuses) & inside(F.col("b.focus_cues"), "priority", LEVELS)
        & inside(asked, "requested_input", INPUTS) & inside(F.col("b.critiques"), "severity", LEVELS)
    )
    keep = lambda col: F.when(good, col)
    listed = lambda col, name: F.coalesce(keep(col), F.array().cast(rows.select(f"b.{name}").schema[0].dataType)).alias(name)
    return rows.select(
        *PAGE, F.coalesce(keep(F.col("b.summary")), F.lit("")).alias("summary"), listed(asked, "focus_cues"),
        listed(F.col("b.component_reviews"), "component_reviews"), listed(F.col("b.critiques"), "critiques"),
        F.coalesce(keep(F.col("b.stop_recommendation")), F.lit(False)).alias("stop_recommendation"),
    )


def entity_blocks(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(entity_id, block): how an entity is shown to the judge, with its pages' summaries."""
    flat = F.regexp_replace(strip(F.col("page_summary")), "\n", " ")
    cut = F.when(F.length(flat) > CONTEXT_CHARS, F.concat(F.rtrim(F.substring(flat, 1, CONTEXT_CHARS)), F.lit("..."))).otherwise(flat)
    lines = (
        nodes.select("entity_id", "doc_id", F.explode("source_pages").alias("page_id"))
        .join(pages.filter("page_summary <> ''").select(*PAGE, cut.alias("s")), PAGE)
        .groupBy("entity_id")
        .agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("page_id", "s"))), lambda x: F.concat(F.lit("    p"), x["page_id"].cast("string"), F.lit(": "), x["s"])),
                "\n",
            ).alias("context")
        )
    )
    visual = F.col("modality") == "visual"
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("- name: "), "name"), F.concat(F.lit("  entity_type: "), "entity_type"),
        F.concat(F.lit("  modality: "), "modality"),
        F.when(visual & (F.col("visual_type") != ""), F.concat(F.lit("  visual_type: "), "visual_type")),
        F.when(visual & (F.col("visual_description") != ""), F.concat(F.lit("  visual_description: "), "visual_description")),
        F.concat(F.lit("  description: "), F.coalesce("description", F.lit(""))),
        F.concat(F.lit("  pages: "), bracket_list(F.col("source_pages"))),
        F.concat(F.lit("  page_context:\n"), F.coalesce("context", F.lit("    (no page summaries available)"))),
    )
    return nodes.join(lines, "entity_id", "left").select("entity_id", block.alias("block"))


__all__ = ["Build", "STAGES", "OPTIONAL_STAGES", "completion", "encoder"]
