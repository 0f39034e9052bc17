"""Answer a whole table of questions: anchors, propagation, rerank, context, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import obs
from quire.config import Config
from quire.functions.text import bracket_list
from quire.operators import answer, cards, context, expand, knn, pagerank
from quire.plans.build import completion, encoder
from quire.prompts import render as fill
from quire.prompts import template
from quire.providers.registry import get
from quire.schemas import PAGES
from quire.session import materialize
from quire.sources.workspace import Workspace

PAGE = ["doc_id", "page_id"]
NO_EVIDENCE = "(No evidence.)"
NO_GUIDELINES = "No additional answer guidelines were provided."


@dataclass
class Artifacts:
    """What a query run reads: the card index, the pages, and the graph when asked for."""

    index: DataFrame
    pages: DataFrame
    graph: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def load(cls, spark: SparkSession, cfg: Config) -> Artifacts:
        ws = Workspace(spark, cfg.dataset.work_dir)
        graph = ws.load_graph() if cfg.query.propagation == "ppr" else None
        return cls(ws.load_index(cfg.encoder.dim), ws.load("pages", schema=PAGES), graph)


def retrieve(questions: DataFrame, art: Artifacts, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(ranked pages, node scores) for ``questions(qid, question, vector[, doc_id])``.

    Anchors scan only the page cards' folder. A question without propagated pages keeps
    its anchors.
    """
    q = cfg.query
    page_cards = art.index.filter("evidence_type = 'page'")
    where = page_cards.select(F.col("evidence_id").alias("id"), "doc_id", F.element_at("page_ids", 1).alias("page_id"))
    within = "doc_id" if "doc_id" in questions.columns else None
    carried = [within] if within else []
    hits = knn.topk(
        questions.select("qid", "vector", *carried), page_cards.select(F.col("evidence_id").alias("id"), "vector", *carried),
        q.retrieval.anchor_size, metric=cfg.index.metric, within=within,
    )
    anchors = materialize(hits.join(where, "id").select("qid", *PAGE, "score", "rank"), "anchors")
    pages = page_cards.select(
        "doc_id", F.element_at("page_ids", 1).alias("page_id"), F.col("image_payload").alias("page_image_path")
    )
    if q.propagation == "ppr":
        p = q.ppr
        ranked, scores = pagerank.propagate(
            anchors, art.graph[1], pages, restart=p.restart_probability, max_depth=p.max_depth, max_nodes=p.max_nodes,
            max_iter=p.max_iter, tol=p.tol, weight=p.lambda_page, final_k=p.final_k,
        )
    else:
        g = q.qgge
        ranked, scores = expand.expand(
            anchors, questions, cards.card_incidence(art.index),
            art.index.filter("evidence_type <> 'page'").select("evidence_id", "vector"), pages,
            rounds=g.rounds, beam=g.page_beam, weight=g.lambda_page,
        )
    ranked = materialize(ranked.select("qid", *PAGE, "score", "rank", "page_image_path"), "ranked")
    lost = anchors.join(ranked.select("qid").distinct(), "qid", "left_anti").join(pages, PAGE).select(*ranked.columns)
    ranked = ranked.unionByName(lost)
    if q.reranker.enabled:
        scorer = get("reranker", q.reranker.model)(url=q.reranker.url)
        text = art.pages.select(*PAGE, "text")
        cand = context.image_pages(ranked, q.reranker.candidate_size).join(text, PAGE).join(questions.select("qid", "question"), "qid")
        found = cand.select("qid", *PAGE, scorer.score(F.col("question"), F.col("text")).alias("rerank_score"))
        ranked = context.rerank(ranked, found, candidate_size=q.reranker.candidate_size, top_k=q.reranker.top_k)
    return ranked, scores


def _draft(a: str) -> Column:
    return F.concat(
        F.lit("answer: "), F.col(f"{a}_text"), F.lit("\nreasoning: "), F.coalesce(f"{a}_reasoning", F.lit("")),
        F.lit("\ncited_pages: "), bracket_list(F.col(f"{a}_cited_pages")), F.lit("\nconfidence: "), F.col(f"{a}_confidence"), F.lit("\n"),
    )


def ask(
    spark: SparkSession, cfg: Config, questions: DataFrame, *, llm=None, artifacts: Artifacts | None = None
) -> DataFrame:
    """``questions(qid, question[, answer_guidelines, doc_id])`` -> one answer row per question.

    A question with a ``doc_id`` takes its anchors from that document only. Questions are rows:
    equal ids do not mix.

    Three phases, each over the whole batch: encode all questions; retrieve, propagate and
    rerank; generate. Model calls are the only points where the plan is cut.
    """
    ws = Workspace(spark, cfg.dataset.work_dir)
    tracer = obs.Tracer(ws, enabled=cfg.obs.tracer in ("jsonl", "both"))
    art = artifacts or Artifacts.load(spark, cfg)
    llm = llm or completion(cfg)
    prompts = lambda name: template(name, cfg.query.answer.prompt_set)

    def call(rows: DataFrame, prompt: Column, images: Column | None, stage: str) -> DataFrame:
        with tracer.stage(f"query.{stage}"):
            said = materialize(rows.withColumn("r", llm.reply(prompt, images)), stage)
            tracer.record_usage(said)
        return said

    try:
        guide = "answer_guidelines" if "answer_guidelines" in questions.columns else F.lit(None).cast("string")
        # ids in a question file may repeat, so every row gets a key of its own and carries its id along
        asked = questions.select(
            F.monotonically_increasing_id().alias("qid"), F.col("qid").alias("given"), "question",
            F.col(guide).alias("guide") if isinstance(guide, str) else guide.alias("guide"),
            (F.col("doc_id") if "doc_id" in questions.columns else F.lit(None).cast("string")).alias("doc_id"),
        )
        with tracer.stage("query.encode"):
            asked = materialize(asked.withColumn("vector", encoder(cfg).vector(F.col("question"))), "questions")
        with tracer.stage("query.retrieve"):
            ranked, scores = retrieve(asked, art, cfg)
            ranked, scores = materialize(ranked, "ranked"), materialize(scores, "node-scores")
        routed = call(asked, fill(prompts("route"), question=F.col("question")), None, "analyze")
        routes = routed.select("qid", answer.route(F.col("r.text")).alias("route"))

        knobs = cfg.query.ppr if cfg.query.propagation == "ppr" else cfg.query.qgge
        items = context.text_items(
            ranked, art.pages, cards.card_incidence(art.index), art.index.select("evidence_id", "text_payload", "page_ids"),
            art.index.select("evidence_id", "vector"), scores, asked, graph_weight=knobs.lambda_page, per_page=knobs.max_text_per_page,
        )
        items = materialize(context.within_budget(items, cfg.query.retrieval.token_budget), "items")
        shown = context.image_pages(ranked)
        pics = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("image_rank", "page_id", "page_image_path"))).alias("pics"))
        none = F.array().cast("array<string>")
        state = (
            asked.drop("vector").join(routes, "qid")
            .join(ranked.select("qid").distinct().withColumn("has_pages", F.lit(True)), "qid", "left")
            .join(pics, "qid", "left").join(context.format_evidence(items), "qid", "left").join(context.cited_pages(items), "qid", "left")
            .withColumns(
                {
                    "images": F.coalesce(F.transform("pics", lambda p: p["page_image_path"]), none),
                    "image_pages": F.coalesce(F.transform("pics", lambda p: p["page_id"]), F.array().cast("array<bigint>")),
                    "cited": F.coalesce("cited", F.array().cast("array<bigint>")),
                }
            )
            .withColumn("mode", answer.answer_mode(F.col("route"), F.size("images") > 0, cfg.query.answer.mode))
        )
        state = materialize(state, "state")
        live = state.filter("has_pages")

        def draft(rows: DataFrame, prompt: Column, images: Column | None, default: str, stage: str, tag: str) -> DataFrame:
            said = call(rows, prompt, images, stage).select("qid", F.col("r.text").alias("reply"), F.col(default).alias("default_pages"))
            got = answer.parse_answers(said)
            return got.select("qid", *[F.col(c).alias(f"{tag}_{c}") for c in got.columns if c != "qid"])

        by_image = draft(
            live.filter("mode IN ('images', 'fusion')"),
            fill(prompts("answer_images"), question=F.col("question"), pages=F.array_join(F.col("image_pages").cast("array<string>"), ", ")),
            F.col("images"), "image_pages", "answer_images", "i",
        )
        by_text = draft(
            live.filter("mode IN ('texts', 'fusion')"),
            fill(
                prompts("answer_texts"), question=F.col("question"), guidelines=F.coalesce("guide", F.lit(NO_GUIDELINES)),
                evidence=F.coalesce("evidence", F.lit(NO_EVIDENCE)),
            ),
            None, "cited", "answer_texts", "t",
        )
        both = live.filter("mode = 'fusion'").join(by_image, "qid").join(by_text, "qid").withColumn(
            "union", F.array_sort(F.array_union("i_cited_pages", "t_cited_pages"))
        )
        fused = draft(
            both, fill(prompts("fuse"), question=F.col("question"), image_draft=_draft("i"), text_draft=_draft("t")), None, "union", "fuse", "f"
        )
        pick = lambda c: F.when(F.col("mode") == "fusion", F.col(f"f_{c}")).when(F.col("mode") == "images", F.col(f"i_{c}")).otherwise(F.col(f"t_{c}"))
        final = state.join(by_image, "qid", "left").join(by_text, "qid", "left").join(fused, "qid", "left")
        return final.select(
            F.col("given").alias("qid"), "question", F.coalesce(pick("text"), F.lit("")).alias("answer"),
            F.coalesce(pick("cited_pages"), F.array().cast("array<bigint>")).alias("cited_pages"),
            F.coalesce(pick("confidence"), F.lit("low")).alias("confidence"),
            F.when(F.col("has_pages"), F.col("mode")).alias("answer_mode"), "route",
            F.when(F.col("has_pages").isNull(), "no_anchor").otherwise(pick("failure_reason")).alias("failure_reason"),
        )
    finally:
        tracer.flush()
