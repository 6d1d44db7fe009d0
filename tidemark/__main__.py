"""Command line: validate and plan registries, publish bundles, promote them and roll back."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from .plans import promotion, registry


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tidemark")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("validate", "plan", "publish"):
        sub.add_parser(name).add_argument("registry")
    sub.choices["plan"].add_argument("view")
    sub.choices["plan"].add_argument("features", nargs="+")
    sub.choices["publish"].add_argument("store")
    for name in ("promote", "rollback"):
        p = sub.add_parser(name)
        p.add_argument("store")
        if name == "promote":
            p.add_argument("bundle")
        p.add_argument("env")
        p.add_argument("stage")
        p.add_argument("--actor", required=True)
        p.add_argument("--reason", required=True)
    sub.choices["promote"].add_argument("--profile")
    sub.choices["promote"].add_argument("--approved-by", action="append", default=[])
    sub.choices["promote"].add_argument("--override")
    sub.choices["rollback"].add_argument("--to")
    a = top.parse_args(args)
    try:
        if a.command == "validate":
            r = registry.load(a.registry)
            print(f"ok: {sum(len(v.features) for v in r.views.values())} features, {registry.digest(r)}")
        elif a.command == "plan":
            print(", ".join(registry.plan(registry.load(a.registry).views[a.view], a.features).compute))
        elif a.command == "publish":
            print(registry.BundleStore(a.store).publish(registry.load(a.registry)))
        else:
            stages, now = promotion.Stages(registry.BundleStore(a.store), f"{a.store}/stages"), datetime.now(timezone.utc)
            if a.command == "promote":
                print(stages.promote(a.bundle, a.env, a.stage, a.actor, a.reason, now, a.profile, a.approved_by, a.override))
            else:
                print(stages.rollback(a.env, a.stage, a.actor, a.reason, now, a.to))
    except (registry.RegistryError, promotion.PromotionError, KeyError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
