"""Job parameters. All of them have an effect in train() or test() (jobs.py); unknown names in a file are an error."""

from __future__ import annotations

from dataclasses import dataclass, fields


@dataclass
class Config:
    training_path: str = ""
    testing_path: str = ""
    store: str = ""
    num_features: int = 0
    positive: str = "1"
    max_sample_size: int = 1_000_000
    max_bin_size: int = 32
    default_gamma: float = 0.25
    min_gamma: float = 0.001
    min_ess: float = 0.1
    num_trees: int = 10
    num_splits: int = 4
    batch_size: int = 1_000
    sample_size: int = 100_000
    last_outcomes: int = 5
    resume_training: bool = False
    models_list: str = ""
    incremental_testing: bool = True
    testing_scores_only: bool = False
    seed: int = 1

    def __post_init__(self):
        if not 2 <= self.max_bin_size <= 256:
            raise ValueError("max_bin_size is 2 to 256")
        if not 0 < self.min_gamma <= self.default_gamma < 0.5:
            raise ValueError("0 < min_gamma <= default_gamma < 0.5")


def read_config(text: str) -> Config:
    """From `name: value` lines (flat YAML); # begins a comment."""
    kinds = {f.name: type(f.default) for f in fields(Config)}
    values = {}
    for line in text.splitlines():
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        name, _, value = (x.strip() for x in line.partition(":"))
        if name not in kinds:
            raise KeyError(name)
        value = value.strip("\"'")
        values[name] = value.lower() in ("true", "yes", "1") if kinds[name] is bool else kinds[name](value)
    return Config(**values)
