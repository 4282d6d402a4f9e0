"""Command line: python -m ebbline --root FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from ebbline.engine import Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ebbline")
    p.add_argument("--root", required=True, help="the folder of files and, by default, of the catalog")
    p.add_argument("--catalog", help="the catalog's file on this machine")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="age all tables, again and again")
    run.add_argument("--cycles", type=int, default=0, help="0: without end")
    run.add_argument("--interval", type=float, default=10.0)
    r = sub.add_parser("register")
    r.add_argument("name")
    r.add_argument("--schema", required=True, help="DDL")
    r.add_argument("--pk", required=True, help="columns, comma-separated")
    r.add_argument("--tier-key", required=True)
    r.add_argument("--mode", default="tiered")
    for option in ("width", "lag", "layout", "lake-retention", "heap-retention", "cut"):
        r.add_argument(f"--{option}")
    for name in ("unregister", "verify", "maintain", "copy"):
        c = sub.add_parser(name)
        c.add_argument("name")
        if name == "copy":
            c.add_argument("--chunk-rows", type=int, default=50_000)
    i = sub.add_parser("ingest")
    i.add_argument("name")
    i.add_argument("paths", nargs="+", help="Parquet files, or one file of JSON lines (.jsonl)")
    pol = sub.add_parser("policy")
    pol.add_argument("name")
    pol.add_argument("settings", nargs="*", help="name=value")
    sub.add_parser("status")
    for name in ("explain", "sql"):
        sub.add_parser(name).add_argument("text")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    e = Engine(spark, a.root, a.catalog)
    if a.command == "run":
        done = 0
        while True:
            print(json.dumps(e.cycle()), flush=True)
            done += 1
            if done == a.cycles:
                return 0
            time.sleep(a.interval)
    elif a.command == "register":
        number = lambda x: int(x) if x and x.lstrip("-").isdigit() else x
        e.register(a.name, a.schema, a.pk.split(","), a.tier_key, a.mode, width=number(a.width) or 0, lag=number(a.lag), layout=number(a.layout), lake_retention=number(a.lake_retention), heap_retention=number(a.heap_retention), cut=a.cut)
    elif a.command == "unregister":
        e.unregister(a.name)
    elif a.command == "verify":
        out = e.verify(a.name)
        print(json.dumps(out))
        return 0 if out["ok"] else 1
    elif a.command == "maintain":
        print(json.dumps(e.maintain(a.name)))
    elif a.command == "copy":
        print(json.dumps(e.initial_copy(a.name, a.chunk_rows)))
    elif a.command == "ingest":
        lines = len(a.paths) == 1 and a.paths[0].endswith(".jsonl")
        print(json.dumps(e.ingest_jsonl(a.name, a.paths[0]) if lines else e.ingest(a.name, a.paths)))
    elif a.command == "policy":
        pairs = dict(x.split("=", 1) for x in a.settings)
        print(e.set_policy(a.name, **{k: json.loads(v) for k, v in pairs.items()}))
    elif a.command == "status":
        for r in e.status().toJSON().collect():
            print(r)
    elif a.command == "explain":
        print("\n".join(e.explain(a.text)))
    else:
        e.sql(a.text).show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
