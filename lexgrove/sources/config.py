"""Typed configuration of an experiment, and what providers can do."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

# The names of request adapters, and the adapter of a provider that names none.
ADAPTERS = (
    "aliyun_enable_thinking", "deepseek_reasoning_effort", "mock", "nvidia_gemma_chat_template", "openai_reasoning_effort", "plain_openai", "vllm_gemma_chat_template",
    "zhipu_thinking_body",
)
EFFORTS = ("low", "medium", "high", "max")


@dataclass(frozen=True)
class Matrix:
    a_count: tuple[int, ...] = (1, 2, 3, 4, 5)
    b_count: tuple[int, ...] = (0, 1, 2, 3, 4, 5)
    information: tuple[str, ...] = ("I0", "I1", "I2")


@dataclass(frozen=True)
class Budgets:
    """Caps on reuse; 0 or less does not bind."""

    max_seed_reuse: int = 2
    max_a1_reuse: int = 2
    max_candidate_reuse: int = 2
    max_constraint_reuse: int = 2
    max_pool_reuse: int = 1
    seed: int = 13

    def caps(self) -> dict[str, int]:
        return {"seed": self.max_seed_reuse, "A1": self.max_a1_reuse, "constraint": self.max_constraint_reuse, "candidate": self.max_candidate_reuse, "pool": self.max_pool_reuse}


@dataclass(frozen=True)
class Resources:
    dataset_families: tuple[str, ...] = ("wordnet", "babelnet")
    wordnet_enabled: bool = True
    babelnet_enabled: bool = True
    babelnet_path: str = ""
    min_final_positive_count: int = 5
    max_seed_per_family: int = 0

    def families(self) -> list[str]:
        """Families that are listed and not switched off."""
        on = {"wordnet": self.wordnet_enabled, "babelnet": self.babelnet_enabled}
        return [f for f in self.dataset_families if on.get(f, False)]


@dataclass(frozen=True)
class Product:
    product_id: str = "test"
    tier: str = "test"
    wordnet_quota_per_stratum: int = 3
    babelnet_quota_per_stratum: int = 1
    candidate_scheduler: str = "reuse_aware_mixed_negatives"
    candidate_window_limit: int = 64
    shard_size: int = 100_000

    def quotas(self) -> dict[str, int]:
        return {"wordnet": self.wordnet_quota_per_stratum, "babelnet": self.babelnet_quota_per_stratum}


@dataclass(frozen=True)
class Capability:
    """What a provider can do, from a file of providers."""

    protocol: str = "openai_compatible"
    base_url: str = ""
    api_key_env: str = ""
    default_model: str = ""
    supports_streaming: bool = False
    supports_reasoning_channel: bool = True
    request_adapter: str = ""
    thinking_mapping: str = ""
    recommended_max_concurrency: int = 1


@dataclass(frozen=True)
class ProviderSettings:
    name: str = "mock"
    protocol: str = "openai_compatible"
    base_url: str = ""
    api_key_env: str = ""
    model: str = ""
    timeout_seconds: float = 60.0
    max_concurrency: int = 1
    concurrency_mode: str = "fixed"
    max_retries: int = 1
    request_interval_seconds: float = 0.0
    retry_backoff_seconds: float = 0.0
    retryable_cooldown_seconds: float = 0.0
    temperature: float = 0.0
    top_p: float = 1.0
    max_answer_tokens: int = 128
    thinking: str = "off"
    reasoning_effort: str | None = None
    save_reasoning: bool = True
    reasoning_char_limit: int = 4000
    supports_streaming: bool = False
    supports_reasoning_channel: bool = True
    request_adapter: str = ""
    thinking_mapping: str = ""
    recommended_max_concurrency: int = 1


@dataclass(frozen=True)
class Experiment:
    name: str = "experiment"
    tasks: tuple[str, ...] = ("T1", "T2", "T3")
    matrix: Matrix = field(default_factory=Matrix)
    resources: Resources = field(default_factory=Resources)
    budgets: Budgets = field(default_factory=Budgets)
    product: Product = field(default_factory=Product)
    provider: ProviderSettings = field(default_factory=ProviderSettings)
    answer_parse_char_limit: int = 2000
    capabilities: dict[str, Capability] = field(default_factory=dict)


def _typed(kind: type, raw: dict[str, Any], **known: Any):
    """An instance of ``kind`` from a table: values take their default's type, unknown keys are left out."""
    base, out = kind(**known), {}
    for f in fields(kind):
        if f.name in raw:
            like = getattr(base, f.name)
            value = raw[f.name]
            out[f.name] = tuple(value) if isinstance(like, tuple) else type(like)(value) if like is not None and value is not None else value
    return replace(base, **out)


def load_capabilities(path: str | Path | None) -> dict[str, Capability]:
    """Providers by name; none where there is no file."""
    if path is None or not Path(path).exists():
        return {}
    with open(path, "rb") as f:
        return {name: _typed(Capability, raw) for name, raw in tomllib.load(f).items()}


def _from_capability(name: str, c: Capability) -> dict[str, Any]:
    own = {k: v for k, v in asdict(c).items() if k != "default_model"}
    return {**own, "name": name, "model": c.default_model, "request_adapter": c.request_adapter or ("mock" if name == "mock" else "")}


def load_experiment(path: str | Path, providers: str | Path | None = None) -> Experiment:
    """A TOML file over typed defaults; a provider's capability gives the defaults of its settings.

    ``providers`` is the file of capabilities, else providers.toml beside the file or one folder above. Relative
    resource paths are relative to the file.
    """
    path = Path(path)
    with path.open("rb") as f:
        raw = tomllib.load(f)
    beside = [p for p in (path.parent / "providers.toml", path.parent.parent / "providers.toml") if p.exists()]
    able = load_capabilities(providers or (beside[0] if beside else None))
    name = str(raw.get("provider", {}).get("name", ProviderSettings().name))
    resources = _typed(Resources, raw.get("resources", {}))
    if resources.babelnet_path and not Path(resources.babelnet_path).is_absolute():
        resources = replace(resources, babelnet_path=str((path.parent / resources.babelnet_path).resolve()))
    # What a provider supports is not for an experiment to say.
    asked = {k: v for k, v in raw.get("provider", {}).items() if k not in ("supports_streaming", "supports_reasoning_channel", "recommended_max_concurrency")}
    return Experiment(
        str(raw.get("name", path.stem)), tuple(raw.get("tasks", Experiment().tasks)), _typed(Matrix, raw.get("matrix", {})), resources, _typed(Budgets, raw.get("budgets", {})),
        _typed(Product, raw.get("product", {})), _typed(ProviderSettings, asked, **_from_capability(name, able.get(name, Capability()))),
        int(raw.get("answer_parse_char_limit", 2000)), able,
    )


def settings_for_run(config: Experiment, name: str) -> ProviderSettings:
    """The configured settings, or for another provider its capability with the experiment's limits and sampling."""
    if name == config.provider.name:
        return config.provider
    able = config.capabilities.get(name)
    if able is None:
        able = Capability(protocol="local_mock", default_model="mock", request_adapter="mock", recommended_max_concurrency=config.provider.max_concurrency) if name == "mock" else Capability()
    return replace(config.provider, **_from_capability(name, able))


def may_run(configured: str, name: str) -> bool:
    """Only the configured provider or the mock may take a run."""
    return name in (configured, "mock")


def setting_faults(config: Experiment, name: str) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a provider's settings."""
    s, errors, warnings = settings_for_run(config, name), [], []
    if not may_run(config.provider.name, name):
        errors.append(f"provider {name!r} must be the configured {config.provider.name!r} or mock")
    if name != "mock" and name not in config.capabilities:
        errors.append(f"provider {name!r} is not among the known providers")
    if s.thinking not in ("on", "off"):
        errors.append(f"thinking must be on or off, not {s.thinking!r}")
    if s.thinking == "on" and not s.supports_reasoning_channel:
        errors.append(f"provider {name!r} has no reasoning channel")
    if s.reasoning_effort and s.reasoning_effort not in EFFORTS:
        errors.append(f"reasoning_effort must be one of {', '.join(EFFORTS)}, not {s.reasoning_effort!r}")
    if s.reasoning_effort and s.thinking != "on":
        errors.append("reasoning_effort needs thinking = on")
    if name != "mock" and s.request_adapter not in ADAPTERS:
        errors.append(f"unknown request_adapter {s.request_adapter!r}")
    if s.max_concurrency < 1:
        errors.append("max_concurrency must be at least 1")
    if s.concurrency_mode not in ("fixed", "adaptive"):
        errors.append(f"concurrency_mode must be fixed or adaptive, not {s.concurrency_mode!r}")
    if s.max_concurrency > s.recommended_max_concurrency:
        warnings.append(f"max_concurrency {s.max_concurrency} is over the recommended {s.recommended_max_concurrency}")
    return errors, warnings


def dataset_snapshot(config: Experiment) -> dict[str, Any]:
    """The configuration without its provider: what a dataset depends on."""
    return {k: v for k, v in asdict(config).items() if k not in ("provider", "capabilities")}
