"""Settings of the pipelines, as frozen values that are checked when made."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    """What preparation, pairing and scoring need to know."""

    seed: int = 42
    revision: str = "main"
    row_tag: str = "row_v1"
    split_tag: str = "split_v1"
    id_prefix: str = "stepmath"
    schema_version: str = "2.0"
    system_prompt: str = "You are a careful math tutor."
    blank_lines: int = 2
    max_length: int = 2048
    max_prompt_length: int = 1024
    max_pair_length: int = 2048
    train: int = 8000
    validation: int = 1000
    evaluation: int = 1000
    mini_train: int = 256
    mini_validation: int = 32
    mini_evaluation: int = 50

    def __post_init__(self) -> None:
        sizes = (self.train, self.validation, self.evaluation, self.mini_train, self.mini_validation, self.mini_evaluation)
        if min(sizes) < 0 or min(self.max_length, self.max_prompt_length, self.max_pair_length) <= 0:
            raise ValueError("sizes must not be negative, lengths must be positive")
        if self.max_prompt_length >= self.max_pair_length:
            raise ValueError("max_prompt_length must be below max_pair_length")
        if self.mini_train > self.train or self.mini_validation > self.validation or self.mini_evaluation > self.evaluation:
            raise ValueError("the mini sets must not exceed the full ones")

    def scaled(self, rows: int, per: int) -> Settings:
        """The same with targets that grow with the table: as given for `per` raw rows, in proportion for `rows`."""
        names = ("train", "validation", "evaluation", "mini_train", "mini_validation", "mini_evaluation")
        return replace(self, **{n: getattr(self, n) * rows // per for n in names})

    def smoke(self, train: int, validation: int, evaluation: int) -> Settings:
        """The same with the small counts of a trial run."""
        fit = {"mini_train": min(self.mini_train, train), "mini_validation": min(self.mini_validation, validation), "mini_evaluation": min(self.mini_evaluation, evaluation)}
        return replace(self, train=train, validation=validation, evaluation=evaluation, **fit)

    @property
    def mini(self) -> dict[str, int]:
        return {"train": self.mini_train, "validation": self.mini_validation, "evaluation": self.mini_evaluation}


def load(path: str) -> Settings:
    """Settings from a YAML or JSON mapping; unknown keys are an error."""
    with open(path, encoding="utf-8") as text:
        if path.endswith(".json"):
            import json

            given = json.load(text)
        else:
            import yaml

            given = yaml.safe_load(text)
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no mapping")
    return Settings(**given)
