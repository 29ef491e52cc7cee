"""Settings, checked when they are made."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace


STRATEGIES = ("fedavg", "fedprox", "fedmed", "fednova", "fedavgm", "fedadam", "fedyogi", "fedadagrad", "scaffold", "async")


@dataclass(frozen=True)
class Client:
    client: str
    enabled: bool = True
    weight: float = 1.0
    epochs: int = 1
    learning_rate: float = 0.01


@dataclass(frozen=True)
class Rounds:
    rounds: int = 100
    clients_per_round: int = 10
    min_clients: int = 3
    sampling: str = "uniform"
    strategy: str = "fedavg"
    early_stopping: int = 0
    min_delta: float = 0.001
    checkpoint_every: int = 10

    def __post_init__(self):
        if self.rounds <= 0:
            raise ValueError("rounds must be positive")
        if self.clients_per_round < self.min_clients:
            raise ValueError(f"clients_per_round ({self.clients_per_round}) is less than min_clients ({self.min_clients})")
        if self.sampling not in ("uniform", "weighted"):
            raise ValueError(f"unknown sampling {self.sampling}")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"rounds don't support the strategy {self.strategy}")


@dataclass(frozen=True)
class Privacy:
    epsilon: float = 8.0
    delta: float = 1e-5
    max_norm: float = 1.0
    noise_multiplier: float = 0.1
    accounting: str = "simple"

    def __post_init__(self):
        if self.accounting not in ("simple", "standard"):
            raise ValueError(f"unknown accounting {self.accounting}")
        if self.epsilon <= 0 or self.max_norm <= 0 or self.noise_multiplier < 0 or not 0 < self.delta < 1:
            raise ValueError("epsilon and max_norm must be positive, delta within 0 and 1, noise_multiplier not negative")


@dataclass(frozen=True)
class Defense:
    faulty: int = 0
    method: str = "none"

    def __post_init__(self):
        if self.faulty < 0 or self.method not in ("none", "krum", "multi_krum", "trimmed_mean", "median", "geometric_median"):
            raise ValueError("faulty can't be negative and the method must be known")


@dataclass(frozen=True)
class Compression:
    method: str = "top_k"
    share: float = 0.1
    levels: int = 256

    def __post_init__(self):
        if not 0 < self.share <= 1 or self.levels < 2:
            raise ValueError("share must be within 0 and 1, and levels 2 at least")


@dataclass(frozen=True)
class Settings:
    rounds: Rounds = field(default_factory=Rounds)
    privacy: Privacy | None = None
    defense: Defense = field(default_factory=Defense)
    compression: Compression | None = None

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Settings:
        return cls(Rounds(**d["rounds"]), Privacy(**d["privacy"]) if d.get("privacy") else None, Defense(**d["defense"]), Compression(**d["compression"]) if d.get("compression") else None)

    def changed(self, **parts) -> Settings:
        return replace(self, **parts)
