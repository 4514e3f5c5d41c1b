"""python -m twofold run CONFIG | validate DATASET | projections DATASET, with --root for each."""

from __future__ import annotations

import argparse

from twofold.plans import run as runs
from twofold.session import session
from twofold.sources.artifacts import Store
from twofold.specs import load_config


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="twofold")
    parser.add_argument("--root", action="append", default=[], help="folder of artifacts; the first is written to")
    commands = parser.add_subparsers(dest="command", required=True)
    go = commands.add_parser("run", help="the stages of a configuration")
    go.add_argument("config")
    go.add_argument("--from", dest="start")
    go.add_argument("--only")
    go.add_argument("--dry-run", action="store_true")
    check = commands.add_parser("validate", help="all layers of a dataset")
    check.add_argument("dataset")
    listed = commands.add_parser("projections", help="the projections of a dataset")
    listed.add_argument("dataset")
    a = parser.parse_args(argv)
    store = Store(session(), *(a.root or ["./data"]))
    if a.command == "run":
        print(*runs.run(store, load_config(a.config), a.start, a.only, a.dry_run), sep="\n")
    elif a.command == "validate":
        print(*runs.validate_all(store, a.dataset), sep="\n")
    else:
        print(*store.listing(a.dataset, "projections"), sep="\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
