"""Declaration documents: YAML files to typed models, with profile paths resolved beside their task."""

from __future__ import annotations

from pathlib import Path
from typing import TypeVar

import yaml

from ..declarations import Declared, DeclarationRegister, EvidenceManifest, InstrumentProfile, SetupProfile, TaskBundle, TaskConfig

Document = TypeVar("Document", bound=Declared)


class ConfigurationError(ValueError):
    """A document that cannot be read or does not validate: a configuration error, not a scientific outcome."""


def located(path: str | Path, beside: Path | None = None) -> Path:
    path = Path(path).expanduser()
    return (beside / path if beside else path).resolve()


def load(path: Path, kind: type[Document]) -> Document:
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigurationError(f"cannot read configuration {path}: {e}") from e
    except (yaml.YAMLError, UnicodeDecodeError) as e:
        raise ConfigurationError(f"invalid YAML in {path}: {e}") from e
    if not isinstance(raw, dict):
        raise ConfigurationError(f"configuration {path} must contain a mapping")
    try:
        return kind.model_validate(raw)
    except ValueError as e:
        raise ConfigurationError(f"invalid configuration {path}: {e}") from e


def load_task_bundle(task_path: str | Path) -> TaskBundle:
    """A task and the profiles it names."""
    at = located(task_path)
    task = load(at, TaskConfig)
    parts = {}
    for kind in ("sensor", "reference"):
        path = located(getattr(task.profiles, kind), at.parent)
        parts[kind] = load(path, InstrumentProfile)
        if parts[kind].kind != kind:
            raise ConfigurationError(f"{path} is not a {kind} profile")
    parts["setup"] = load(located(task.profiles.setup, at.parent), SetupProfile)
    return TaskBundle(task_path=at, task=task, **parts)


def load_evidence_manifest(path: str | Path) -> EvidenceManifest:
    return load(located(path), EvidenceManifest)


def load_declaration_register(path: str | Path) -> DeclarationRegister:
    return load(located(path), DeclarationRegister)
