"""Command line: python -m loomlake.plans.cli --root DIR ..."""

from __future__ import annotations

import argparse
import json
import re


def parse_selection(text: str, names: list[str]) -> list[str]:
    """`1,2`, `1-3` or names; an exact name comes before a range; any error selects nothing."""
    out = []
    for part in (p.strip() for p in text.split(",")):
        if part in names:
            out.append(part)
        elif m := re.fullmatch(r"(\d+)(?:-(\d+))?", part):
            a, b = int(m[1]), int(m[2] or m[1])
            if not 1 <= a <= b <= len(names):
                return []
            out += names[a - 1 : b]
        else:
            return []
    return list(dict.fromkeys(out))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomlake")
    p.add_argument("--root", required=True)
    p.add_argument("--user", default="user")
    top = p.add_subparsers(dest="command", required=True)

    c = top.add_parser("config").add_subparsers(dest="action", required=True)
    c.add_parser("list")
    for kind in ("provider", "task"):
        x = c.add_parser(kind)
        x.add_argument("op", choices=["create", "remove"])
        x.add_argument("name")
        x.add_argument("--description", default="")
        x.add_argument("--required", nargs="*", default=[])

    u = top.add_parser("upload")
    for name in ("source", "provider", "dataset"):
        u.add_argument(name)
    u.add_argument("--task", default="raw")
    u.add_argument("--variant")
    u.add_argument("--meta", type=json.loads, default={})
    u.add_argument("--overwrite", action="store_true")

    d = top.add_parser("download")
    d.add_argument("output")
    for name in ("providers", "datasets", "tasks", "variants"):
        d.add_argument(f"--{name}", nargs="*")
    d.add_argument("--limit", type=int)
    d.add_argument("--format", default="auto")
    d.add_argument("--as-collection", action="store_true")
    d.add_argument("--version")

    k = top.add_parser("collections").add_subparsers(dest="action", required=True)
    k.add_parser("list")
    for name in ("info", "import", "export", "delete"):
        x = k.add_parser(name)
        x.add_argument("name")
        x.add_argument("--version")
        if name in ("import", "export"):
            x.add_argument("path")

    k = top.add_parser("process").add_subparsers(dest="action", required=True)
    for name in ("start", "list", "status"):
        k.add_parser(name)

    k = top.add_parser("db").add_subparsers(dest="action", required=True)
    for name in ("info", "update", "partitions"):
        k.add_parser(name)
    v = k.add_parser("validate")
    v.add_argument("--fraction", type=float, default=1.0)
    v.add_argument("--report")
    return p


def run(args: argparse.Namespace, spark):
    """The result as something JSON can say."""
    from loomlake.plans.lake import Lake
    from loomlake.sources.sinks import write_json

    lake = Lake(spark, args.root, args.user)
    match (args.command, getattr(args, "action", None)):
        case ("config", "list"):
            return lake.schema.data
        case ("config", kind):
            extra = {"required_fields": args.required} if kind == "task" and args.op == "create" else {}
            call = getattr(lake.schema, f"{'add' if args.op == 'create' else 'remove'}_{kind}")
            return call(args.name, description=args.description, **extra) if args.op == "create" else call(args.name)
        case ("upload", _):
            if args.task == "raw":
                return lake.upload_raw(args.source, args.provider, args.dataset, args.overwrite)
            return lake.upload_task(args.source, args.provider, args.dataset, args.task, args.variant, args.meta, args.overwrite)
        case ("download", _):
            found = lake.search(args.providers, args.datasets, args.tasks, args.variants, limit=args.limit)
            return lake.import_collection(found, args.output, args.version) if args.as_collection else lake.download(found, args.output, args.format)
        case ("collections", "list"):
            return lake.collections.list()
        case ("collections", "info"):
            return lake.collections.info(args.name, args.version)
        case ("collections", "import"):
            return lake.import_collection(args.path, args.name, args.version)
        case ("collections", "export"):
            return lake.collections.export(args.name, args.path, args.version)
        case ("collections", "delete"):
            return lake.collections.delete(args.name, args.version)
        case ("process", "start"):
            return lake.wait_for_job(lake.trigger_processing(background=False))
        case ("process", "list"):
            return [p.name for p in lake.ingest._pending()]
        case ("process", "status"):
            return lake.ingest.status()
        case ("db", "info"):
            return lake.info()
        case ("db", "update"):
            lake.build()
            return lake.info()
        case ("db", "partitions"):
            return [r.asDict() for r in lake.partitions().collect()]
        case ("db", "validate"):
            report = lake.ingest.validate_assets(args.fraction)
            if args.report:
                write_json(spark, args.report, report)
            return report


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    print(json.dumps(run(args, SparkSession.builder.appName("loomlake").getOrCreate()), ensure_ascii=False, indent=2, default=str))


if __name__ == "__main__":
    main()
