"""Settings: a YAML file (or JSON, which is YAML too) checked into a dictionary, one run's part of it merged in."""

from __future__ import annotations

import json
from pathlib import Path

RUN_MODES = {"baseline": "baseline", "engineered": "source_filter", "question_filter": "question_filter"}
RUN_KEYS = {"output_dir", "metadata_enabled"}
REQUIRED = ["data_dir", "csv_path", "selected_years", "vector_db_type", "chunk_size", "chunk_overlap", "top_k"]
VECTOR_DB_TYPES = {"faiss", "parquet"}
EMBEDDING_BACKENDS = {"deepinfra", "remote", "hash", "keyword"}
GENERATION_BACKENDS = {"deepinfra", "openai", "remote", "extractive"}
POSITIVE, NONNEGATIVE = ["batch_size", "timeout_seconds", "max_tokens", "max_context_chars", "num_ctx", "slice_questions", "requests_in_flight"], ["request_sleep_seconds", "retry_sleep_seconds", "max_retries"]
GENERATION_DEFAULTS = {
    "backend": "extractive", "max_context_chars": 10_000, "max_tokens": 512, "temperature": 0.0, "timeout_seconds": 90,
    "allow_extractive_fallback": False, "require_citations": True, "fallback_on_ungrounded_answer": True,
    "request_sleep_seconds": 2.0, "retry_sleep_seconds": 10.0, "max_retries": 3, "slice_questions": 1000, "requests_in_flight": 8,
}
EMBEDDING_DEFAULTS = {"backend": "hash", "normalize": True, "batch_size": 32, "timeout_seconds": 300, "request_sleep_seconds": 0.0, "retry_sleep_seconds": 5.0, "max_retries": 3}


class ConfigError(ValueError):
    """A setting that can't be used."""


def read(path: str | Path) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise ConfigError(f"{path} must hold a mapping")
    return found


def _years(value, name: str) -> list[int]:
    if not isinstance(value, list) or not value:
        raise ConfigError(f"{name} must be a list of years")
    return [int(y) for y in value]


def _section(raw, defaults: dict, backends: set[str], name: str) -> dict:
    if raw is not None and not isinstance(raw, dict):
        raise ConfigError(f"{name} must be a mapping")
    out = defaults | (raw or {})
    out["backend"] = str(out["backend"]).lower()
    if out["backend"] not in backends:
        raise ConfigError(f"{name}.backend must be one of {', '.join(sorted(backends))}")
    for key, least in [(k, 1) for k in POSITIVE] + [(k, 0) for k in NONNEGATIVE]:
        if out.get(key) is not None:
            out[key] = float(out[key]) if key.endswith("sleep_seconds") else int(out[key])
            if out[key] < least:
                raise ConfigError(f"{name}.{key} must be at least {least}")
    if "temperature" in out:
        out["temperature"] = float(out["temperature"])
    out["model"] = out.get("model") or out.get("model_name")
    return out


def shared(raw: dict, base: str | Path = ".") -> dict:
    """Settings that all runs have in common, checked and completed; paths are taken from base."""
    if missing := [k for k in REQUIRED if k not in raw]:
        raise ConfigError(f"settings are missing: {', '.join(missing)}")
    if raw["vector_db_type"] not in VECTOR_DB_TYPES:
        raise ConfigError(f"vector_db_type must be one of {', '.join(sorted(VECTOR_DB_TYPES))}")
    out = {k: v for k, v in raw.items() if k != "runs"}
    out["selected_years"] = _years(raw["selected_years"], "selected_years")
    out["document_years"] = _years(raw.get("document_years", raw["selected_years"]), "document_years")
    for k in ("chunk_size", "chunk_overlap", "top_k"):
        out[k] = int(raw[k])
    if out["chunk_size"] <= 0 or not 0 <= out["chunk_overlap"] < out["chunk_size"]:
        raise ConfigError("chunk_size must be positive, chunk_overlap at least 0 and less")
    if out["top_k"] <= 0:
        raise ConfigError("top_k must be positive")
    out["embedding"] = _section(raw.get("embedding"), EMBEDDING_DEFAULTS, EMBEDDING_BACKENDS, "embedding")
    out["generation"] = _section(raw.get("generation"), GENERATION_DEFAULTS, GENERATION_BACKENDS, "generation")
    out.setdefault("index_dir", "outputs/index")
    for k in ("data_dir", "csv_path", "index_dir"):
        out[k] = resolve(base, out[k])
    return out


def resolve(base: str | Path, path: str) -> str:
    return path if "://" in str(path) or Path(path).is_absolute() else str(Path(base) / path)


def run(raw: dict, mode: str, base: str | Path = ".") -> dict:
    """shared() with one run's output_dir and metadata_enabled; a run may set nothing else, so runs can't drift apart."""
    if mode not in RUN_MODES:
        raise ConfigError(f"mode must be one of {', '.join(RUN_MODES)}")
    out = shared(raw, base)
    runs = raw.get("runs")
    if runs is None:
        own = {"output_dir": raw.get("output_dir"), "metadata_enabled": raw.get("metadata_enabled", mode != "baseline")}
        out["index_dir"] = resolve(base, raw.get("index_dir", raw.get("output_dir") or out["index_dir"]))
    else:
        own = runs.get(mode) if isinstance(runs, dict) else None
        if not isinstance(own, dict):
            raise ConfigError(f"runs.{mode} must be a mapping")
        if extra := sorted(set(own) - RUN_KEYS):
            raise ConfigError(f"runs.{mode} may not set {', '.join(extra)}")
    if not own.get("output_dir"):
        raise ConfigError(f"no output_dir for {mode}")
    return out | {"mode": mode, "output_dir": resolve(base, own["output_dir"]), "metadata_enabled": bool(own.get("metadata_enabled", mode != "baseline"))}


def evaluation(raw: dict, mode: str, base: str | Path = ".") -> dict:
    """For evaluating: a full configuration, or just csv_path and output_dir."""
    if "runs" in raw:
        return run(raw, mode, base)
    if missing := [k for k in ("csv_path", "output_dir") if k not in raw]:
        raise ConfigError(f"settings are missing: {', '.join(missing)}")
    out = {k: resolve(base, raw[k]) for k in ("csv_path", "output_dir")}
    return out | {"index_dir": resolve(base, raw.get("index_dir", raw["output_dir"])), "generation": _section(raw.get("generation"), GENERATION_DEFAULTS, GENERATION_BACKENDS, "generation"), "mode": mode}
