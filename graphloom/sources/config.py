"""Configuration read on the driver: packs, axes, options; and names for paths."""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Documents sent to extraction at once, least and most.
WAVE, LEAST_WAVE, MOST_WAVE = 6, 1, 10


@dataclass(frozen=True)
class Pack:
    """A vocabulary: node and edge types, a glossary, specificities of terms, and the
    axes of the divergence section if it has any."""

    domain: str
    node_types: tuple[str, ...]
    edge_types: tuple[str, ...]
    version: str = "0.1.0"
    glossary: dict[str, str] = field(default_factory=dict)
    specificity_seeds: dict[str, float] = field(default_factory=dict)
    divergence: dict | None = None

    def seeds(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, float(s)) for t, s in sorted(self.specificity_seeds.items())], "term string, seed double")

    def terms(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.glossary.items()), "term string, definition string")


def _types(names: object, what: str) -> tuple[str, ...]:
    if not isinstance(names, list) or not names:
        raise ValueError(f"{what} must be a list with a type at least")
    out = tuple(str(n).strip() for n in names)
    if "" in out:
        raise ValueError(f"{what} has a blank type")
    if len(set(out)) < len(out):
        raise ValueError(f"{what} has a type twice")
    return out


def load_pack(text: str) -> Pack:
    """A pack from JSON or the YAML that an installed parser reads; unknown keys, shared
    types and numbers that are not finite are errors."""
    try:
        raw = json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the pack is no JSON and no YAML parser is installed") from e
        raw = yaml.safe_load(text)
    if not isinstance(raw, dict):
        raise ValueError("a pack is a mapping")
    extra = sorted(set(raw) - set(Pack.__dataclass_fields__))
    if extra:
        raise ValueError(f"unknown keys in the pack: {extra}")
    nodes, edges = _types(raw.get("node_types"), "node_types"), _types(raw.get("edge_types"), "edge_types")
    if set(nodes) & set(edges):
        raise ValueError(f"types of nodes and of edges: {sorted(set(nodes) & set(edges))}")
    domain = str(raw.get("domain") or "").strip()
    if not domain:
        raise ValueError("a pack has a domain")
    seeds = {str(t): float(s) for t, s in (raw.get("specificity_seeds") or {}).items()}
    odd = sorted(t for t, s in seeds.items() if not math.isfinite(s))
    if odd:
        raise ValueError(f"specificities that are no finite numbers: {odd}")
    section = raw.get("divergence")
    if section is not None:
        axes(section)
    return Pack(domain, nodes, edges, str(raw.get("version", "0.1.0")), dict(raw.get("glossary") or {}), seeds, section)


@dataclass(frozen=True)
class Axis:
    """A behaviour axis: ``categorical`` with values, ``continuous`` with bounds and bins, or ``open``."""

    name: str
    kind: str = "categorical"
    values: tuple[str, ...] = ()
    low: float = 0.0
    high: float = 1.0
    bins: int = 5

    @property
    def cells(self) -> int:
        return {"categorical": len(self.values), "continuous": self.bins}.get(self.kind, 0)


def axes(section: dict) -> list[Axis]:
    """The axes of a divergence section; names are unique, kinds known, bounds in order."""
    if not isinstance(section, dict):
        raise ValueError("the divergence section is a mapping")
    if "dpp" in section and not isinstance(section["dpp"], bool):
        raise ValueError("dpp is true or false")
    rows = section.get("axes", [])
    if "axes" in section and (not isinstance(rows, list) or not rows):
        raise ValueError("axes is a list with an axis at least")
    out = []
    for r in rows:
        extra = sorted(set(r) - set(Axis.__dataclass_fields__)) if isinstance(r, dict) else ["?"]
        if extra or not str(r.get("name", "")).strip():
            raise ValueError(f"an axis has a name and known keys, not {extra}")
        a = Axis(**(r | {"name": str(r["name"]).strip(), "values": tuple(r.get("values", ()))}))
        if a.kind not in ("categorical", "continuous", "open") or a.kind == "continuous" and not (a.low < a.high and a.bins > 0):
            raise ValueError(f"the axis {a.name} is out of shape")
        out.append(a)
    if len({a.name for a in out}) < len(out):
        raise ValueError("two axes have one name")
    return out


def wave_size(given: object = None, option: object = None) -> int:
    """Digits alone count; the first that isn't empty decides; too few mean the default."""
    raw = next((str(x) for x in (given, option) if x is not None and str(x) != ""), "")
    if not re.fullmatch("[0-9]+", raw) or int(raw) < LEAST_WAVE:
        return WAVE
    return min(int(raw), MOST_WAVE)


def cleaned(value: str | None) -> str:
    """An option's value without quotes around it; blank where nobody filled it in."""
    v = (value or "").strip()
    while len(v) > 1 and v[0] in "'\"" and v[-1] == v[0]:
        v = v[1:-1].strip()
    return "" if v.startswith("${") or v in ("/.venv", "/venv") else v


def path_name(name: str, blank: str = "default") -> str:
    """A name for a folder; what had to change gets a hash, so two names never share one."""
    safe = re.sub(r"[^A-Za-z0-9_.-]+", "-", name.strip()).strip("-_.")
    return safe if safe == name else f"{safe or blank}-{hashlib.sha1(name.encode()).hexdigest()[:8]}"
