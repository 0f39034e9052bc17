"""Recipes: YAML with ``extends``, dotted overrides, a closed schema and a stable hash."""

from __future__ import annotations

import copy
import hashlib
import json
from pathlib import Path
from typing import Any

import yaml

from quire.errors import ConfigError
from quire.operators.dedupe import ENTITY_TYPES, VISUAL_TYPES

# ---- Fixed values: the public tuning surface and its defaults --------------------
DEFAULTS: dict[str, Any] = {
    "recipe": {"name": "", "description": "", "extends": []},
    "dataset": {"name": "", "data_dir": "", "work_dir": ""},
    "ingest": {
        "parser": "pypdfium", "dpi": 300, "jpeg_quality": 90, "max_image_long_side": 2048, "output_subdir": "dumps",
    },
    "augment": {"page_summary": {"enabled": True, "llm": "default", "max_tokens": 1024, "temperature": 0.0}},
    "kg": {
        "entity_types": ENTITY_TYPES,
        "visual_entity_types": VISUAL_TYPES,
        "extract": {
            "llm": "default", "max_tokens": 8192, "skip_empty_pages": True, "max_rounds": 5, "max_empty_revisions": 2,
            "saturation": {"enabled": True, "density_guard_min_chars": 200, "density_guard_min_nodes": 3},
        },
        "description_merge": "concat_sep",
        "description_max_chars": 4000,
    },
    "cross_page_alignment": {
        "enabled": True, "candidate_top_k": 20, "rs_threshold": 9.0, "rs_threshold_same_as": 9.0,
        "rs_threshold_rescue": 7.0, "rs_threshold_cross_modality": 8.0, "judge_llm": "default",
        "canonicalize_same_as": True,
    },
    "evidence_cards": {
        "emit": {"page": True, "entity": True, "relation": True},
        "page_card": {"image_only": True},
        "entity_card": {
            "use_visual_crop": False, "crop_padding_frac": 0.06, "crop_min_area_px": 3600, "crop_max_long_side": 768,
        },
    },
    "encoder": {"name": "mock", "model": None, "dim": 512, "normalize": True, "extra": {}},
    "index": {"backend": "nano", "metric": "cosine"},
    "generator": {
        "llm": {
            "kind": "openrouter", "model": "openai/gpt-4o-mini", "base_url": None, "api_key_env": "OPENROUTER_API_KEY",
            "timeout_s": 300, "max_retries": 5, "extra": {},
        }
    },
    "obs": {"tracer": "both", "trace_path": "trace", "manifest_path": "run_manifest.json", "rich_progress": True},
    "runtime": {"max_async": {"extract": 12, "align": 12, "embed": 16}},
    "query": {
        "propagation": "qgge",
        "retrieval": {"anchor_size": 30, "token_budget": 8000},
        "qgge": {"rounds": 4, "page_beam": 100, "lambda_page": 0.7, "max_text_per_page": 4},
        "ppr": {
            "restart_probability": 0.15, "max_depth": 4, "max_nodes": 2000, "max_iter": 50, "tol": 1e-6,
            "lambda_page": 0.7, "final_k": 100, "max_text_per_page": 4,
        },
        "answer": {"mode": "auto", "prompt_set": "default"},
        "reranker": {"enabled": False, "candidate_size": 20, "top_k": 10, "url": "", "model": "overlap"},
    },
    "prompt_set_version": "1",
}
CHOICES: dict[str, tuple[str, ...]] = {
    "ingest.parser": ("mineru", "pypdfium"),
    "kg.description_merge": ("concat_sep", "llm_summarize"),
    "index.backend": ("nano",),
    "index.metric": ("cosine", "dot"),
    "generator.llm.kind": ("openai", "openrouter", "vllm", "sglang", "hf_local", "mock"),
    "obs.tracer": ("jsonl", "rich", "both", "none"),
    "query.propagation": ("qgge", "ppr"),
    "query.answer.mode": ("auto", "images", "texts", "fusion"),
}
FREE_MAPS = ("encoder.extra", "generator.llm.extra", "runtime.max_async")
REQUIRED = ("dataset.name", "dataset.data_dir", "dataset.work_dir")
# ------------------------------------------------------------------------------------

PRESETS = Path(__file__).parent / "presets"


class Section:
    """Read-only attribute access to one mapping of the resolved recipe."""

    def __init__(self, data: dict[str, Any]):
        object.__setattr__(self, "_data", data)

    def __getattr__(self, name: str) -> Any:
        try:
            value = self._data[name]
        except KeyError as e:
            raise AttributeError(name) from e
        return Section(value) if isinstance(value, dict) else value

    def __setattr__(self, name: str, value: Any) -> None:
        raise AttributeError("a resolved recipe cannot be changed")

    def as_dict(self) -> dict[str, Any]:
        return copy.deepcopy(self._data)


class Config(Section):
    def hash(self) -> str:
        """Build identity: query knobs and folders do not count."""
        data = self.as_dict()
        data.pop("query")
        for key in ("data_dir", "work_dir"):
            data["dataset"].pop(key)
        return hashlib.sha256(json.dumps(data, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Mappings merge key by key, everything else is replaced."""
    both = {k: deep_merge(base[k], v) for k, v in over.items() if isinstance(v, dict) and isinstance(base.get(k), dict)}
    return copy.deepcopy({**base, **over}) | both


def coerce(value: Any) -> Any:
    """Scalars given as text: booleans, whole numbers unless zero-padded, decimals."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    padded = len(text) > 1 and text[0] == "0" and text[1] != "."
    for kind in () if padded else (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text if padded else value


def apply_overrides(data: dict[str, Any], overrides: dict[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(data)
    for key, value in overrides.items():
        if isinstance(value, dict) and "." not in key:
            out = deep_merge(out, {key: value})
            continue
        *path, leaf = key.split(".")
        node = out
        for part in path:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ConfigError(f"override {key!r} passes through {part!r}, which is not a mapping")
        node[leaf] = coerce(value)
    return out


def _read(path: Path, chain: tuple[Path, ...] = ()) -> dict[str, Any]:
    if path in chain:
        raise ConfigError(f"recipe extends itself through {path}")
    if not path.is_file():
        raise ConfigError(f"recipe not found: {path}")
    data = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    if not isinstance(data, dict):
        raise ConfigError(f"top level of {path} must be a mapping")
    parents = data.pop("extends", None) or []
    if not isinstance(parents, list):
        raise ConfigError(f"extends must be a list in {path}")
    merged: dict[str, Any] = {}
    for ref in parents:
        near, packaged = (path.parent / ref).resolve(), PRESETS / Path(ref).name
        found = next((p for p in (near, packaged) if p.is_file()), None)
        if found is None:
            raise ConfigError(f"cannot find {ref!r} named in {path}")
        merged = deep_merge(merged, _read(found, (*chain, path)))
    return deep_merge(merged, data)


def _check(data: dict[str, Any], schema: dict[str, Any], at: str = "") -> dict[str, Any]:
    unknown = set(data) - set(schema)
    if unknown:
        raise ConfigError(f"unknown keys under {at or 'the top level'}: {', '.join(sorted(map(str, unknown)))}")
    out: dict[str, Any] = {}
    for key, default in schema.items():
        where = f"{at}.{key}" if at else key
        value = copy.deepcopy(data.get(key, default))
        if isinstance(default, dict):
            if not isinstance(value, dict):
                raise ConfigError(f"{where} must be a mapping")
            out[key] = value if where in FREE_MAPS else _check(value, default, where)
            continue
        number = isinstance(default, (int, float)) and not isinstance(default, bool)
        fits = (
            default is None
            or (number and isinstance(value, (int, float)) and not isinstance(value, bool))
            or (not number and isinstance(value, type(default)))
        )
        if not fits:
            raise ConfigError(f"{where} must be {type(default).__name__}, not {value!r}")
        if where in CHOICES and value not in CHOICES[where]:
            raise ConfigError(f"{where} must be one of {', '.join(CHOICES[where])}, not {value!r}")
        if where in REQUIRED and not value:
            raise ConfigError(f"{where} is required")
        out[key] = float(value) if isinstance(default, float) else value
    return out


def from_dict(data: dict[str, Any], overrides: dict[str, Any] | None = None) -> Config:
    return Config(_check(apply_overrides(data, overrides or {}), DEFAULTS))


def load(path: str | Path, overrides: dict[str, Any] | None = None) -> Config:
    return from_dict(_read(Path(path).resolve()), overrides)


def llm_section(cfg: Config, spec: str) -> dict[str, Any]:
    """``default`` or ``kind:model`` -> completion settings."""
    base = cfg.generator.llm.as_dict()
    if spec == "default":
        return base
    kind, sep, model = spec.partition(":")
    if not sep or kind not in CHOICES["generator.llm.kind"]:
        raise ConfigError(f"model spec must be default or kind:model, not {spec!r}")
    return {**base, "kind": kind, "model": model}
