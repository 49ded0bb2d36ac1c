"""Presets: a mapping of sections, kept on the driver."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

#: Default limits and markers.
DEFAULT: dict[str, Any] = {
    "version": 0,
    "debug_mode": False,
    "model_metadata_cache_dir": ".matchloom_cache/model_metadata",
    "local": {"trial": {"max_model_len": 30000}, "patient": {"max_model_len": 100000}, "llm_match_quality": {"max_model_len": 50000}, "llm_exclusion_criteria": {"max_model_len": 50000}},
    "remote": {"enabled": False, "server_urls": ["http://localhost:8000/v1"], "max_concurrent_requests": 16, "request_timeout": 600, "max_retries": 6, "batch_size": 1000, "retry_backoff_base": 1.0, "send_extra_body": True},
    "trial": {"model_name": "offline", "reasoning_parser": "none", "boilerplate_marker": "Boilerplate exclusions", "sampling_params": {"max_tokens": 20000}},
    "patient": {"model_name": "offline", "reasoning_parser": "none", "chunk_size": 50000, "chunk_overlap": 500, "prompt_margin_tokens": 5000, "boilerplate_marker": "Boilerplate conditions:", "sampling_params": {"max_tokens": 20000}},
    "embedding": {"model_path": "offline", "max_seq_length": 2500, "query_prompt": ""},
    "match_quality": {"model_name": "offline", "max_length": 4096, "score_cutoff": 0.2},
    "exclusion_criteria": {"model_name": "offline", "max_length": 3192},
    "llm_match_quality": {"model_name": "offline", "sampling_params": {"max_tokens": 15000}},
    "llm_exclusion_criteria": {"model_name": "offline", "sampling_params": {"max_tokens": 20000}},
}


@dataclass
class Config:
    trial: dict[str, Any]
    patient: dict[str, Any]
    embedding: dict[str, Any]
    version: int = 0
    debug_mode: bool = False
    local: dict[str, Any] = field(default_factory=dict)
    remote: dict[str, Any] = field(default_factory=dict)
    raw: dict[str, Any] = field(default_factory=dict)

    def snapshot(self) -> dict[str, Any]:
        """All settings as they are now, for a run's metadata."""
        out = copy.deepcopy(self.raw)
        live = {k: copy.deepcopy(getattr(self, k)) for k in ("version", "debug_mode", "trial", "patient", "embedding", "local", "remote")}
        return out | live

    def section(self, name: str) -> dict[str, Any]:
        return dict(getattr(self, name, None) or self.raw[name])

    def runtime(self, task: str) -> dict[str, Any]:
        """The task's settings, then those for local or else remote runs, later ones winning."""
        remote = {k: v for k, v in self.remote.items() if k != "enabled"} if self.remote.get("enabled") else {}
        return self.section(task) | self.local.get(task, {}) | remote


def from_mapping(data: Any) -> Config:
    if not isinstance(data, dict):
        raise ValueError("a preset must be a mapping")
    data = copy.deepcopy(data)
    named = {k: data[k] for k in ("trial", "patient", "embedding")}
    more = {k: data[k] for k in ("version", "debug_mode", "local", "remote") if k in data}
    return Config(**named, **more, raw=data)


def load_preset(name: str = "default") -> Config:
    """The built-in preset, or one from a JSON or YAML file."""
    if name == "default":
        return from_mapping(DEFAULT)
    text = Path(name).read_text(encoding="utf-8")
    if name.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML presets need PyYAML; use JSON") from e
        return from_mapping(yaml.safe_load(text))
    return from_mapping(json.loads(text))
