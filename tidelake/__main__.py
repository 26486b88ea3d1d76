"""``python -m tidelake --data DIR --config FILE ping|stats|flush|schema|shutdown|send SERIES LINES``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config import Config
from .engine import Engine
from .errors import LakeError
from .sources.ndjson import read_ndjson


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidelake")
    parser.add_argument("--data", help="data directory, in place of the config's")
    parser.add_argument("--config", help="configuration; config.json in the data directory, or in ./data, unless given")
    parser.add_argument("--force-unlock", action="store_true")
    commands = parser.add_subparsers(dest="op", required=True)
    for op in ("ping", "stats", "flush", "schema", "shutdown"):
        commands.add_parser(op)
    send = commands.add_parser("send", help="append lines of JSON")
    send.add_argument("series")
    send.add_argument("lines")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidelake").getOrCreate()
    try:
        config = Config.load(given.config or str(Path(given.data or "data") / "config.json"))
        config.data_dir = given.data or config.data_dir
        with Engine(spark, config, given.force_unlock) as engine:
            if given.op != "send":
                reply = engine.control(given.op)
            else:
                engine.series(given.series)
                good, bad = read_ndjson(spark, given.lines, given.series, engine.manifest.current(given.series).epoch)
                done = engine.append_raw(good)
                reply = {"status": "sent", "accepted": done.accepted, "rejected": done.rejected, "unreadable": bad.count()}
    except LakeError as e:
        reply = {"status": "error", "message": str(e)}
    print(json.dumps(reply, indent=1))
    return int(reply["status"] == "error")


if __name__ == "__main__":
    sys.exit(main())
