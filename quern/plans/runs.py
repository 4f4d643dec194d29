"""Run folders: frozen configuration, completion markers, the iteration loop. Driver-side and small."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


def content_hash(value) -> str:
    """Sixteen hex digits over sorted JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_json(path: Path, value) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w") as f:
        json.dump(value, f, indent=1, sort_keys=True, default=str)
    os.replace(tmp, path)


def read_json(path: Path):
    return json.loads(path.read_text())


@dataclass
class SourceConfig:
    adapter: str = "general"
    args: dict = field(default_factory=dict)
    n_holdout: int = 0


@dataclass
class FilterConfig:
    gates: list = field(default_factory=lambda: ["correctness", "no_external_context", "length", "dedup", "leakage_rules"])
    max_total_len: int = 16384
    per_question: int = 4
    selection: str = "shortest"


@dataclass
class Config:
    seed: int = 0
    samples: int = 16
    iterations: int = 1
    frontier_min: int = 1
    solved_min: int = 3
    cliff_max_correct: int = 0
    source: SourceConfig = field(default_factory=SourceConfig)
    filter: FilterConfig = field(default_factory=FilterConfig)

    def check(self) -> Config:
        if not 0 < self.frontier_min <= self.solved_min:
            raise ValueError("0 < frontier_min <= solved_min is needed")
        if self.filter.selection not in ("shortest", "min_c", "random"):
            raise ValueError(f"unknown selection {self.filter.selection!r}")
        if self.samples < 1 or self.iterations < 1:
            raise ValueError("samples and iterations must be positive")
        return self

    def hash(self) -> str:
        return content_hash(asdict(self))


def build(cls, raw: dict, where: str = ""):
    """A configuration object; unknown keys are an error, numbers in text are read as numbers."""
    known = {f.name: f for f in fields(cls)}
    if extra := set(raw) - set(known):
        raise ValueError(f"unknown keys {sorted(extra)} in {where or cls.__name__}")
    out = cls()
    for k, v in raw.items():
        old = getattr(out, k)
        if is_dataclass(old):
            v = build(type(old), v, f"{where}.{k}".strip("."))
        elif isinstance(v, str) and isinstance(old, (int, float)) and not isinstance(old, bool):
            v = type(old)(float(v)) if isinstance(old, int) else float(v)
        setattr(out, k, v)
    return out


def load_config(raw: dict, overrides: dict[str, object] | None = None) -> Config:
    """A nested mapping, with dotted overrides on top."""
    raw = json.loads(json.dumps(raw))
    for dotted, value in (overrides or {}).items():
        at = raw
        *path, last = dotted.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return build(Config, raw).check()


def freeze(config: Config, run_dir: Path) -> None:
    """Writes the configuration once; a resumed run must have the same."""
    at = run_dir / "config.json"
    if at.exists():
        if content_hash(read_json(at)) != config.hash():
            raise ValueError(f"{at} has another configuration")
        return
    write_json(at, asdict(config))


def marker(artifact: Path) -> Path:
    return artifact.parent / f"_{artifact.name}.done.json"


def mark_done(artifact: Path, config_hash: str, count: int | None = None, **extra) -> None:
    write_json(marker(artifact), {"config_hash": config_hash, "count": count, **extra})


def is_done(artifact: Path, config_hash: str) -> bool:
    """Only with the artifact, its marker and the same hash."""
    return artifact.exists() and marker(artifact).exists() and read_json(marker(artifact))["config_hash"] == config_hash


def memoized(artifact: Path, config_hash: str, make: Callable[[Path], int | None]) -> Path:
    if not is_done(artifact, config_hash):
        mark_done(artifact, config_hash, make(artifact))
    return artifact


def point_latest(run_dir: Path, name: str) -> None:
    tmp = run_dir / f".latest-{os.getpid()}"
    tmp.symlink_to(name)
    os.replace(tmp, run_dir / "latest")


def loop(config: Config, run_dir: Path, stages: list[tuple[str, Callable[[Path, int], int | None]]]) -> list[str]:
    """Runs each stage of each iteration once; finished ones are skipped. Returns what was run."""
    freeze(config, run_dir)
    ran = []
    for k in range(config.iterations):
        at = run_dir / f"iter_{k}"
        at.mkdir(parents=True, exist_ok=True)
        for name, stage in stages:
            if not is_done(at / name, config.hash()):
                memoized(at / name, config.hash(), lambda p, s=stage: s(p, k))
                ran.append(f"{k}/{name}")
        point_latest(run_dir, at.name)
    return ran


def batch_shape(group_size: int, micro_batch: int, accumulation: int, world: int) -> dict:
    """Sizes of a training step; a group must not be split over steps."""
    total = micro_batch * accumulation * world
    if total % group_size:
        raise ValueError(f"a step of {total} can't hold whole groups of {group_size}")
    return {"samples_per_step": total, "groups_per_step": total // group_size}


def exactly_one(**budgets) -> tuple[str, object]:
    given = {k: v for k, v in budgets.items() if v is not None}
    if len(given) != 1:
        raise ValueError(f"exactly one of {sorted(budgets)} is needed")
    return next(iter(given.items()))


def route_metrics(metrics: dict) -> dict[str, dict]:
    """Numbers to charts, lists of numbers to histograms, the rest to the summary; booleans are summary."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    out: dict[str, dict] = {"chart": {}, "histogram": {}, "summary": {}}
    for k, v in metrics.items():
        out["chart" if number(v) else "histogram" if isinstance(v, list) and v and all(map(number, v)) else "summary"][k] = v
    return out


def fingerprint(paths: list[Path]) -> str:
    return content_hash([[p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()] for p in sorted(paths)])
