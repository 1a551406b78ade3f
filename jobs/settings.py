"""A job's settings: a small JSON file, each of whose entries the command line can override."""

from __future__ import annotations

import argparse
import json
from pathlib import Path


def read(defaults: dict, path: str | None = None, **given) -> dict:
    """defaults, under the entries of the JSON file at path, under those given that are not None; unknown entries are an error."""
    held = json.loads(Path(path).read_text()) if path else {}
    out = defaults | held | {k: v for k, v in given.items() if v is not None}
    if unknown := sorted(set(out) - set(defaults)):
        raise ValueError(f"unknown settings {unknown}")
    if missing := sorted(k for k, v in out.items() if v is None):
        raise ValueError(f"settings {missing} have no value")
    return out


def from_command_line(doc: str, defaults: dict, argv: list[str] | None = None) -> tuple[dict, str | None]:
    """(settings, Spark master) of a command line: a config file, and --name value for any entry; lists and numbers as JSON."""
    parser = argparse.ArgumentParser(description=doc)
    parser.add_argument("config", nargs="?", help="JSON file of settings")
    parser.add_argument("--master", help="Spark master; left to spark-submit where it is not given")
    for name, value in defaults.items():
        parser.add_argument(f"--{name}", type=str if value is None or isinstance(value, str) else json.loads)
    args = vars(parser.parse_args(argv))
    config, master = args.pop("config"), args.pop("master")
    return read(defaults, config, **args), master
