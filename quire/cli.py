"""Command line: build, align-embed, show-config, list-plugins, report, query, query-batch."""

from __future__ import annotations

import argparse
import json
import sys

import yaml

from quire import config
from quire.errors import QuireError


def _settings(items: list[str]) -> dict[str, str]:
    out = {}
    for item in items or []:
        key, sep, value = item.partition("=")
        if not sep:
            raise SystemExit(f"--set expects key=value, not {item!r}")
        out[key.strip()] = value.strip()
    return out


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description="Build and query document knowledge graphs on Spark.")
    sub = p.add_subparsers(dest="command", required=True)

    def verb(name: str, text: str, recipe: bool = True) -> argparse.ArgumentParser:
        v = sub.add_parser(name, help=text)
        if recipe:
            v.add_argument("recipe")
            v.add_argument("--set", dest="settings", action="append", metavar="KEY=VALUE")
        return v

    b = verb("build", "run build stages")
    b.add_argument("--input", help="folder or glob of layout JSON or PDF files; default dataset.data_dir")
    b.add_argument("--stages", help="comma-separated stages")
    b.add_argument("--resume", action="store_true", help="reuse ingested pages")
    verb("align-embed", "embed entities ahead of alignment")
    verb("show-config", "print the resolved recipe and its hash")
    verb("list-plugins", "list providers by kind", recipe=False)
    r = verb("report", "roll up the trace")
    r.add_argument("--kind", choices=("totals", "per_stage", "csv"), default="totals")
    q = verb("query", "answer one question")
    q.add_argument("-q", "--question", required=True)
    qb = verb("query-batch", "answer a file of questions")
    qb.add_argument("-i", "--input", required=True)
    qb.add_argument("-o", "--output", required=True)
    qb.add_argument("--question-field", default="question")
    qb.add_argument("--id-field", default="qid")
    return p


def _spark():
    from quire.session import get_session

    return get_session()


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        return _run(a)
    except QuireError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(a: argparse.Namespace) -> int:
    if a.command == "list-plugins":
        from quire.providers import models  # noqa: F401
        from quire.providers.registry import KINDS, names

        for kind in KINDS:
            print(f"{kind}: {', '.join(names(kind)) or '-'}")
        return 0
    cfg = config.load(a.recipe, _settings(a.settings))
    if a.command == "show-config":
        print(yaml.safe_dump(cfg.as_dict(), sort_keys=False, allow_unicode=True))
        print(f"# hash: {cfg.hash()}")
        return 0
    spark = _spark()
    try:
        return _on_spark(a, cfg, spark)
    finally:
        from quire.session import drop_work_tables

        drop_work_tables(spark)


def _on_spark(a: argparse.Namespace, cfg: config.Config, spark) -> int:
    from quire.plans.build import Build

    if a.command == "build":
        stages = [s.strip() for s in a.stages.split(",") if s.strip()] if a.stages else None
        Build(spark, cfg).run(stages, source=a.input, resume=a.resume)
    elif a.command == "align-embed":
        Build(spark, cfg).align_embed()
    elif a.command == "report":
        from quire.obs import report
        from quire.sources.workspace import Workspace

        rows = [r.asDict() for r in report(Workspace(spark, cfg.dataset.work_dir)).orderBy("stage").collect()]
        if a.kind == "totals":
            print(json.dumps({k: v for r in rows if r["stage"] is None for k, v in r.items()}, indent=1))
        elif a.kind == "per_stage":
            print(json.dumps([r for r in rows if r["stage"] is not None], indent=1))
        else:
            print(",".join(rows[0]) if rows else "")
            for r in rows:
                print(",".join("" if v is None else str(v) for v in r.values()))
    elif a.command == "query":
        from quire.plans.ask import ask

        one = spark.createDataFrame([("q", a.question)], "qid string, question string")
        for row in ask(spark, cfg, one).collect():
            print(json.dumps(row.asDict(), ensure_ascii=False, indent=1))
    else:
        from quire.plans.ask import ask
        from quire.sources.workspace import read_questions, write_answers

        write_answers(ask(spark, cfg, read_questions(spark, a.input, a.question_field, a.id_field)), a.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
