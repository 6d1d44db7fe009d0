"""The registry of entities, sources, views and features: a plan that the driver holds, checked when it is built."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

# Lifecycles with their older names, what each may depend on, propagation policies, depth caps.
LIFECYCLES = ("draft", "shadow", "live", "deprecated")
ALIASES = {"active": "live", "inactive": "deprecated", "disabled": "deprecated"}
MAY_USE = {"live": {"live"}, "shadow": {"live", "shadow"}, "draft": {"live", "shadow", "draft"}, "deprecated": set(LIFECYCLES)}
POLICIES = ("lazy", "reactive", "scheduled", "none")
DEPTH, MAX_DEPTH = 3, 5
KINDS = ("udf", "model_score", "model")


class RegistryError(ValueError):
    pass


def _need(ok, message: str) -> None:
    if not ok:
        raise RegistryError(message)


def _text(value, what: str) -> str:
    _need(isinstance(value, str) and value.strip(), f"{what} must be a non-empty string")
    return value


@dataclass(frozen=True)
class Entity:
    name: str
    key_fields: tuple[str, ...]


@dataclass(frozen=True)
class Source:
    name: str
    type: str
    report_type: str
    ts_field: str


@dataclass(frozen=True)
class Edge:
    """A feature's dependency on another of its view, pinned to a version."""

    feature: str
    version: int | None = None
    required: bool = True
    max_input_age_seconds: int | None = None
    propagation: str = "lazy"


@dataclass(frozen=True)
class Model:
    uri: str
    digest: str
    output_name: str
    runner: str | None = None
    batch_only: bool = True


@dataclass(frozen=True)
class Feature:
    name: str
    kind: str
    feature_version: int
    dtype: str
    lifecycle: str
    udf: str = ""
    inputs: tuple[str, ...] = ()
    deps: tuple[Edge, ...] = ()
    model: Model | None = None
    description: str | None = None


@dataclass(frozen=True)
class View:
    name: str
    entity: str
    key_fields: tuple[str, ...]
    view_version: int
    owner: str
    status: str
    features: Mapping[str, Feature]
    feature_groups: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    max_dependency_depth: int | None = None

    def order(self, names: Sequence[str] | None = None) -> list[str]:
        """Names in an order that puts dependencies first; with all transitive dependencies if `names` are given."""
        wanted, stack = set(), list(self.features if names is None else names)
        while stack:
            n = stack.pop()
            if n not in wanted:
                wanted.add(n)
                stack += [e.feature for e in self.features[n].deps]
        graph = {n: sorted(e.feature for e in self.features[n].deps) for n in sorted(wanted)}
        return list(TopologicalSorter(graph).static_order())

    def reactive(self, feature: str, version: int) -> list[tuple[str, int]]:
        """Features that a new value of this one triggers: over reactive edges whose pin is that very version."""
        out = []
        for f in self.features.values():
            for e in f.deps:
                pin = e.version if e.version is not None else self.features[e.feature].feature_version
                if e.feature == feature and e.propagation == "reactive" and pin == version:
                    out.append((f.name, f.feature_version))
        return sorted(out)


@dataclass(frozen=True)
class Registry:
    registry_version: str
    entities: Mapping[str, Entity]
    sources: Mapping[str, Source]
    views: Mapping[str, View]


def _closed(body, required: str, optional: str, what: str) -> Mapping:
    _need(isinstance(body, Mapping), f"{what} must be a mapping")
    need, may = set(required.split()), set(optional.split())
    _need(not set(body) - need - may, f"{what} has unknown keys {sorted(set(body) - need - may)}")
    _need(not need - set(body), f"{what} lacks keys {sorted(need - set(body))}")
    return body


def _names(values, what: str, some: bool = True) -> tuple[str, ...]:
    _need(isinstance(values, (list, tuple)), f"{what} must be a list")
    out = tuple(_text(v, f"an entry of {what}") for v in values)
    _need(len(set(out)) == len(out), f"{what} has duplicates")
    _need(out or not some, f"{what} must not be empty")
    return out


def _count(value, what: str) -> int:
    _need(isinstance(value, int) and not isinstance(value, bool) and value >= 1, f"{what} must be a whole number from 1")
    return value


def _edge(body, what: str) -> Edge:
    if isinstance(body, str):
        return Edge(_text(body, what))
    b = _closed(body, "feature", "version required max_input_age_seconds propagation", what)
    version, age = b.get("version"), b.get("max_input_age_seconds")
    policy = b.get("propagation", "lazy")
    _need(policy in POLICIES, f"{what} has the unknown propagation {policy!r}")
    _need(age is None or age >= 0, f"{what} has a negative age")
    return Edge(_text(b["feature"], what), None if version is None else _count(version, what), bool(b.get("required", True)), age, policy)


def _feature(name: str, body) -> Feature:
    what = f"feature {name!r}"
    b = _closed(body, "kind feature_version dtype status", "udf inputs deps model description", what)
    kind, status = b["kind"], _text(b["status"], f"{what} status").strip().lower()
    _need(kind in KINDS, f"{what} has the unknown kind {kind!r}")
    lifecycle = status if status in LIFECYCLES else ALIASES.get(status)
    _need(lifecycle, f"{what} has the unknown status {status!r}")
    deps = tuple(_edge(e, f"a dependency of {what}") for e in b.get("deps", ()))
    inputs = _names(b.get("inputs", ()), f"inputs of {what}", some=False)
    udf, model = b.get("udf") or "", None
    if b.get("model") is not None:
        m = _closed(b["model"], "uri digest output_name", "runner batch_only", f"the model of {what}")
        model = Model(*(_text(m[k], f"{k} of {what}") for k in ("uri", "digest", "output_name")), m.get("runner"), m.get("batch_only", True))
        _need(model.batch_only, f"{what}: models are for batches only")
    if kind == "udf":
        _need(udf.strip() and (inputs or deps) and model is None, f"{what} needs a udf and an input or dependency, and no model")
    elif kind == "model":
        _need(model and deps and not inputs and not udf.strip(), f"{what} needs a model and dependencies only")
    else:
        _need(not inputs and not deps and model is None, f"{what} is written from outside and takes no inputs")
    return Feature(_text(name, "a feature's name"), kind, _count(b["feature_version"], f"{what} version"), _text(b["dtype"], f"{what} dtype"), lifecycle, udf, inputs, deps, model, b.get("description"))


def _view(name: str, body) -> View:
    what = f"view {name!r}"
    b = _closed(body, "entity key_fields view_version owner status features", "feature_groups max_dependency_depth", what)
    features = {n: _feature(n, f) for n, f in _closed(b["features"], "", " ".join(b["features"]), f"features of {what}").items()}
    _need(features, f"{what} has no features")
    groups = {g: _names(m, f"group {g!r} of {what}") for g, m in (b.get("feature_groups") or {}).items()}
    cap = b.get("max_dependency_depth")
    _need(cap is None or 1 <= cap <= MAX_DEPTH, f"{what}: the depth cap must be 1..{MAX_DEPTH}")
    return View(name, _text(b["entity"], what), _names(b["key_fields"], f"key_fields of {what}"), _count(b["view_version"], what), _text(b["owner"], what), _text(b["status"], what), features, groups, cap)


def _check(r: Registry) -> None:
    for v in r.views.values():
        what = f"view {v.name!r}"
        _need(v.entity in r.entities, f"{what} is of the unknown entity {v.entity!r}")
        _need(v.key_fields == r.entities[v.entity].key_fields, f"{what}: key_fields differ from its entity's")
        for f in v.features.values():
            for s in f.inputs:
                _need(s in r.sources, f"feature {f.name!r} reads the unknown source {s!r}")
            for e in f.deps:
                _need(e.feature in v.features, f"feature {f.name!r} depends on the unknown feature {e.feature!r}")
                target = v.features[e.feature]
                _need(e.version in (None, target.feature_version), f"feature {f.name!r} pins {e.feature!r} v{e.version}, which is v{target.feature_version}")
                _need(target.lifecycle in MAY_USE[f.lifecycle], f"feature {f.name!r} ({f.lifecycle}) may not depend on {e.feature!r} ({target.lifecycle})")
        try:
            order = v.order()
        except CycleError as cycle:
            raise RegistryError(f"{what} has a dependency cycle: {' -> '.join(cycle.args[1])}") from None
        depth: dict[str, int] = {}
        for n in order:
            depth[n] = max((depth[e.feature] + 1 for e in v.features[n].deps), default=0)
            _need(depth[n] <= (v.max_dependency_depth or DEPTH), f"feature {n!r} of {what} is {depth[n]} levels deep")
        for g, members in v.feature_groups.items():
            for m in members:
                _need(m in v.features, f"group {g!r} of {what} names the unknown feature {m!r}")


def build(data: Mapping) -> Registry:
    b = _closed(data, "registry_version entities sources feature_views", "", "the registry")
    for part in ("entities", "sources", "feature_views"):
        _need(isinstance(b[part], Mapping), f"{part} must be a mapping")
    entities = {n: Entity(_text(n, "an entity's name"), _names(_closed(e, "key_fields", "", f"entity {n!r}")["key_fields"], f"key_fields of {n!r}")) for n, e in b["entities"].items()}
    sources = {}
    for n, s in b["sources"].items():
        _closed(s, "type report_type ts_field", "", f"source {n!r}")
        _need(s["type"] == "raw_report", f"source {n!r} has the unknown type {s['type']!r}")
        sources[n] = Source(_text(n, "a source's name"), s["type"], _text(s["report_type"], f"source {n!r}"), _text(s["ts_field"], f"source {n!r}"))
    out = Registry(b["registry_version"], entities, sources, {n: _view(n, v) for n, v in b["feature_views"].items()})
    _check(out)
    return out


def load(path: str) -> Registry:
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text())
    except yaml.YAMLError as error:
        raise RegistryError(f"{path} is not YAML: {error}") from error
    return build(data)


@dataclass(frozen=True)
class Plan:
    view: View
    outputs: tuple[str, ...]
    groups: Mapping[str, tuple[str, ...]]
    shadow: tuple[str, ...]

    @property
    def compute(self) -> list[str]:
        """The outputs and all they need, dependencies first; what is not asked for stays internal."""
        return self.view.order(self.outputs)

    @property
    def sources(self) -> list[str]:
        return sorted({s for n in self.compute for s in self.view.features[n].inputs})


def plan(view: View, features: Sequence[str] = (), groups: Sequence[str] = (), allow_shadow: bool = False) -> Plan:
    """Features first, then the members of groups, each once; only computable ones in a servable lifecycle."""
    expanded = {}
    for g in groups:
        _need(g in view.feature_groups, f"unknown feature group {g!r}")
        expanded[g] = view.feature_groups[g]
    names = list(dict.fromkeys([*features, *(m for g in groups for m in expanded[g])]))
    _need(names, "the request names no features")
    for n in names:
        _need(n in view.features, f"unknown feature {n!r}")
        f = view.features[n]
        _need(f.kind == "udf", f"feature {n!r} of kind {f.kind!r} is not computed here")
        _need(f.lifecycle == "live" or (f.lifecycle == "shadow" and allow_shadow), f"feature {n!r} is {f.lifecycle}")
    return Plan(view, tuple(names), expanded, tuple(n for n in names if view.features[n].lifecycle == "shadow"))


def _digest(content) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def definition(r: Registry) -> dict:
    """The registry's definitions without regard to order; the order of key fields has a meaning and stays."""

    def feature(v: View, f: Feature):
        deps = [{"feature": e.feature, "version": e.version or v.features[e.feature].feature_version, "required": e.required, "max_input_age_seconds": e.max_input_age_seconds, "propagation": e.propagation} for e in f.deps]
        return {"name": f.name, "kind": f.kind, "feature_version": f.feature_version, "dtype": f.dtype, "lifecycle": f.lifecycle, "udf": f.udf, "inputs": sorted(f.inputs), "deps": sorted(deps, key=lambda d: (d["feature"], d["version"])), "model": vars(f.model) if f.model else None}

    return {
        "entities": {e.name: list(e.key_fields) for e in r.entities.values()},
        "sources": {s.name: [s.type, s.report_type, s.ts_field] for s in r.sources.values()},
        "views": {v.name: {"entity": v.entity, "key_fields": list(v.key_fields), "view_version": v.view_version, "owner": v.owner, "status": v.status, "depth": v.max_dependency_depth, "groups": {g: sorted(m) for g, m in v.feature_groups.items()}, "features": sorted((feature(v, f) for f in v.features.values()), key=lambda d: d["name"])} for v in r.views.values()},
    }


def digest(r: Registry, artifact: Mapping[str, str] | None = None) -> str:
    """Identity of the definitions; with an artifact, of the definitions and the exact code."""
    own = _digest(definition(r))
    return own if artifact is None else _digest({"registry": own, "artifact": dict(artifact)})


class BundleStore:
    """Published bundles by digest, never changed: in memory, or as files of a folder."""

    def __init__(self, folder: str | None = None):
        self.folder, self.held = folder and Path(folder), {}

    def _file(self, key: str) -> Path:
        return self.folder / f"{key.replace(':', '_')}.json"

    def get(self, key: str):
        if self.folder is None:
            return self.held.get(key)
        return json.loads(self._file(key).read_text()) if self._file(key).exists() else None

    def put(self, key: str, content) -> str:
        known = self.get(key)
        _need(known is None or known == content, f"bundle {key} exists with other content")
        if known is None and self.folder is None:
            self.held[key] = content
        elif known is None:
            self.folder.mkdir(parents=True, exist_ok=True)
            self._file(key).write_text(json.dumps(content, sort_keys=True))
        return key

    def publish(self, r: Registry, artifact: Mapping[str, str] | None = None) -> str:
        return self.put(digest(r, artifact), {"definition": definition(r), "artifact": dict(artifact or {})})
