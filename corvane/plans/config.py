"""Settings of the plans, as plain data classes."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, is_dataclass


@dataclass(frozen=True)
class ExtractionConfig:
    """Extraction of triples: token limits of the two models, batches and retries, and the quality filter."""

    primary_limit: int = 4000
    fallback_limit: int = 8000
    batch_size: int = 5
    retries: int = 3
    least_length: int = 2
    most_length: int = 100
    dropped: tuple[str, ...] = ("mentions", "says", "talks about")

    @classmethod
    def of(cls, values: dict) -> ExtractionConfig:
        """From a dictionary, as a parsed file gives it; unknown keys are an error."""
        unknown = {*values} - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    @classmethod
    def from_yaml(cls, path: str) -> ExtractionConfig:
        """From a YAML file with the settings at its top or under `extraction`."""
        import yaml

        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f) or {}
        values = values.get("extraction", values)
        return cls.of({k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def describe(self) -> dict:
        return asdict(self)


def describe(component: object) -> dict:
    """What a chunker, embedder or other component says of itself: its class, its settings, and its dimension and longest input where it has them."""
    settings = asdict(component) if is_dataclass(component) else {k: v for k, v in vars(component).items() if not k.startswith("_")} if hasattr(component, "__dict__") else {}
    known = {k: getattr(component, k) for k in ("dimension", "most_tokens") if hasattr(component, k)}
    return {"kind": getattr(component, "__name__", type(component).__name__), **settings, **known}
