"""Promotion of published bundles through the stages shadow and live, and back, with an append-only record."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta
from pathlib import Path

STAGES = ("shadow", "live")
#: Approvers and days in shadow that each profile asks for.
PROFILES = {"bank": (2, 7), "energy": (1, 0)}


class PromotionError(ValueError):
    pass


@dataclass(frozen=True)
class Pointer:
    bundle: str
    since: datetime
    shadow_since: datetime | None
    previous: str | None


@dataclass(frozen=True)
class Record:
    action: str
    env: str
    stage: str
    bundle: str
    previous: str | None
    actor: str
    reason: str
    at: datetime
    approvers: tuple[str, ...] = ()
    profile: str | None = None
    override: str | None = None


class Stages:
    """Which bundle each (environment, stage) points to; kept in memory, or in a folder as one line per move.

    The record is the state: pointers are what its lines lead to, so a pointer and its record cannot disagree."""

    def __init__(self, bundles, folder: str | None = None):
        self.bundles, self.pointers, self.records = bundles, {}, []
        self.file = Path(folder) / "moves.jsonl" if folder else None
        if self.file and self.file.exists():
            for line in self.file.read_text().splitlines():
                row = json.loads(line)
                since = row.pop("shadow_since")
                row |= {"at": datetime.fromisoformat(row["at"]), "approvers": tuple(row["approvers"])}
                self._point(Record(**row), since and datetime.fromisoformat(since))

    def current(self, env: str, stage: str) -> Pointer | None:
        return self.pointers.get((env, stage))

    def _point(self, record: Record, shadow_since: datetime | None) -> Record:
        self.pointers[record.env, record.stage] = Pointer(record.bundle, record.at, shadow_since, record.previous)
        self.records.append(record)
        return record

    def _move(self, record: Record, shadow_since: datetime | None) -> Record:
        if self.file:
            self.file.parent.mkdir(parents=True, exist_ok=True)
            row = asdict(record) | {"at": record.at.isoformat(), "shadow_since": shadow_since and shadow_since.isoformat()}
            with self.file.open("a") as out:
                out.write(json.dumps(row) + "\n")
        return self._point(record, shadow_since)

    def _checked(self, bundle: str, stage: str, reason: str) -> None:
        if self.bundles.get(bundle) is None:
            raise PromotionError(f"bundle {bundle!r} is not published")
        if stage not in STAGES:
            raise PromotionError(f"unknown stage {stage!r}")
        if not (reason or "").strip():
            raise PromotionError("a reason is needed")

    def promote(self, bundle: str, env: str, stage: str, actor: str, reason: str, now: datetime, profile: str | None = None, approved_by=(), override: str | None = None) -> Record:
        """Point a stage to a bundle.  Live asks for the profile's unique approvers and its time in shadow; an
        override of the latter needs a reason of its own, which the record keeps."""
        self._checked(bundle, stage, reason)
        before = self.current(env, stage)
        record = Record("promote", env, stage, bundle, before and before.bundle, actor, reason, now)
        if stage == "shadow":
            return self._move(record, now)
        if profile not in PROFILES:
            raise PromotionError(f"unknown profile {profile!r}")
        people, days = PROFILES[profile]
        approvers = tuple(dict.fromkeys(a.strip() for a in approved_by if a.strip()))
        if len(approvers) < people:
            raise PromotionError(f"{profile} asks for {people} approvers, {len(approvers)} given")
        shadow = self.current(env, "shadow")
        since = shadow.shadow_since if shadow and shadow.bundle == bundle else None
        if override is not None:
            if not override.strip():
                raise PromotionError("an override needs a reason")
        elif since is None or now - since < timedelta(days=days):
            raise PromotionError(f"{profile} asks for {days} days in shadow")
        return self._move(replace(record, approvers=approvers, profile=profile, override=override), since)

    def rollback(self, env: str, stage: str, actor: str, reason: str, now: datetime, to: str | None = None) -> Record:
        """Back to the previous bundle, or to a given one that was published."""
        here = self.current(env, stage)
        if here is None:
            raise PromotionError(f"{env}/{stage} points to nothing")
        target = to or here.previous
        if target is None:
            raise PromotionError("there is no previous bundle")
        self._checked(target, stage, reason)
        return self._move(Record("rollback", env, stage, target, here.bundle, actor, reason, now), here.shadow_since)


def satisfies(installed: str, constraint: str) -> bool:
    """Whether a numeric release meets all clauses, like `>=1.2,<2`; anything else in either is a ValueError."""
    import operator
    import re

    compare = {"==": operator.eq, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}

    def number(text: str) -> list[int]:
        if not re.fullmatch(r"[0-9]+(\.[0-9]+)*", text):
            raise ValueError(f"not a numeric release: {text!r}")
        out = [int(x) for x in text.split(".")]
        while len(out) > 1 and out[-1] == 0:
            out.pop()
        return out

    mine = number(installed.strip())
    for clause in constraint.split(","):
        found = re.fullmatch(r"\s*(==|>=|<=|>|<)\s*(\S+)\s*", clause)
        if not found:
            raise ValueError(f"not a version clause: {clause!r}")
        if not compare[found[1]](mine, number(found[2])):
            return False
    return True
