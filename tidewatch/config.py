"""Settings as plain data: read from YAML or JSON, unknown keys ignored, written back."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path


@dataclass
class Features:
    groups: list[str] = field(default_factory=list)
    identity: bool = True


@dataclass
class Model:
    detectors: list[str] = field(default_factory=lambda: ["isolation_forest", "lof"])
    contamination: float = 0.05
    seed: int = 42


@dataclass
class Engine:
    strategy: str = "trimmed_mean"
    normalisation: str = "minmax"
    floor_enabled: bool = True
    floor: float = 0.58
    support: float = 0.55


@dataclass
class Cases:
    window_minutes: int = 30


@dataclass
class Evaluation:
    injection_window: int = 50
    train_share: float = 0.7


@dataclass
class Config:
    features: Features = field(default_factory=Features)
    model: Model = field(default_factory=Model)
    engine: Engine = field(default_factory=Engine)
    cases: Cases = field(default_factory=Cases)
    evaluation: Evaluation = field(default_factory=Evaluation)
    rules: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Config:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            import yaml

            return cls.of(yaml.safe_load(text) or {})
        return cls.of(json.loads(text))

    @classmethod
    def of(cls, raw: dict) -> Config:
        out = cls()
        for f in fields(cls):
            value, own = raw.get(f.name), getattr(out, f.name)
            if is_dataclass(own) and isinstance(value, dict):
                for k, v in value.items():
                    if hasattr(own, k):
                        setattr(own, k, v)
            elif value is not None and not is_dataclass(own):
                setattr(out, f.name, value)
        return out

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))
