"""The command line: python -m touchline COMMAND. Settings come from TOUCHLINE_... variables or options."""

from __future__ import annotations

import argparse
import json
import logging
import os
from datetime import datetime, timezone
from logging.handlers import RotatingFileHandler

from touchline.plans import pipelines
from touchline.plans.models import SEEDS, Warehouse
from touchline.plans.pipelines import Config
from touchline.session import build_session
from touchline.sources import landing

log = logging.getLogger("touchline")


def _arguments(given: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="touchline")
    for name in ("root", "warehouse", "base", "folder", "headers", "lanes", "look"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--master", help="where to run, if not as spark-submit says")
    parser.add_argument("--log", default=os.environ.get("TOUCHLINE_LOG"), help="a file on this machine for messages, turned over at 5 MB")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("full-load", help="load league seasons that are pending")
    update = commands.add_parser("update", help="refresh fixtures that should be over and lack goals")
    update.add_argument("--mode", choices=["ids", "batch"], default="ids")
    update.add_argument("--from-date")
    update.add_argument("--to-date")
    correct = commands.add_parser("correct", help="move kickoffs that the service has changed")
    correct.add_argument("--mode", choices=["missed", "changed", "both"], default="both")
    commands.add_parser("standings", help="refresh the standings of current seasons")
    commands.add_parser("metadata", help="countries, leagues, seasons and teams of a config file").add_argument("config")
    commands.add_parser("replay", help="try failed units again and list what is left")
    build = commands.add_parser("build", help="write the models")
    build.add_argument("target")
    build.add_argument("models", nargs="*")
    build.add_argument("--seed", action="append", default=[], metavar="NAME=CSV", help=f"one of {', '.join(SEEDS)}, with a header")
    build.add_argument("--full-refresh", action="store_true")
    build.add_argument("--threads", type=int, default=1, help="models that are written at the same time")
    return parser.parse_args(given)


def main(given: list[str] | None = None) -> int:
    """Run one command and print its outcome as one JSON line; an error is logged and ends with status 1."""
    args = _arguments(given)
    handlers = [logging.StreamHandler()] + ([RotatingFileHandler(args.log, maxBytes=5_000_000, backupCount=3)] if args.log else [])
    logging.basicConfig(level=logging.INFO, handlers=handlers, format="%(asctime)s %(levelname)s %(message)s")
    settings = {n: v for n in ("root", "warehouse", "base", "folder", "headers", "lanes", "look") if (v := getattr(args, n))}
    config = Config.from_environment(**settings)
    spark, now = build_session("touchline", args.master), datetime.now(timezone.utc).replace(tzinfo=None)
    ds = now.strftime("%Y-%m-%d")
    try:
        if args.command == "full-load":
            found = pipelines.full_load(spark, config, ds, now)
        elif args.command == "update":
            found = {"received": pipelines.incremental_load(spark, config, ds, now, args.mode, args.to_date, args.from_date)}
        elif args.command == "correct":
            found = {"moved": pipelines.correct_kickoffs(spark, config, now, args.mode)}
        elif args.command == "standings":
            found = {"rows": pipelines.refresh_standings(spark, config, now)}
        elif args.command == "metadata":
            found = pipelines.refresh_metadata(spark, config, landing.read_config(spark, args.config), now)
        elif args.command == "replay":
            found = pipelines.replay_dead_letters(spark, config, ds, now)
            for unit in landing.residual(spark, config.root).toLocalIterator():
                log.warning("still failing: %s", unit.asDict())
        else:
            tables = {n: landing.current(spark, config.warehouse, n) for n in pipelines.SOURCES}
            for name, _, path in (text.partition("=") for text in args.seed):
                kind = "int" if name == "threshold_multipliers" else "string"
                tables[name] = landing.read_seed(spark, path, f"key {kind}, value double, version string")
            w = Warehouse(spark, config.warehouse, now, **tables)
            found = {"built": w.build(args.target, args.models or None, args.full_refresh, args.threads)}
    except Exception:
        log.exception("%s failed", args.command)
        return 1
    log.info("%s: %s", args.command, found)
    print(json.dumps({"command": args.command} | found, default=str))
    return 0
