"""Stages by name.  A stage is any object with ``config()``; implementations register lazily."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from ..config import fingerprint
from ..errors import ConfigurationError
from ..operators import encode, extract, framing, inference

_STAGES: dict[str, dict[str, Callable[..., Any]]] = {}


def register(kind: str, name: str, make: Callable[..., Any]) -> None:
    _STAGES.setdefault(kind, {})[name] = make


def build(kind: str, name: str, **options: Any) -> Any:
    """A stage by kind and name; an unknown one is a ConfigurationError."""
    try:
        make = _STAGES[kind][name]
    except KeyError:
        raise ConfigurationError(f"no {kind} named {name}; there are {sorted(_STAGES.get(kind, {}))}") from None
    return make(**options)


def names(kind: str) -> list[str]:
    return sorted(_STAGES.get(kind, {}))


register("claim_scorer", "distinct_tokens", lambda: extract.claim_score)
register("evidence_scorer", "overlap", lambda: extract.overlap)
register("inference", "lexical", lambda: inference.lexical)
register("framer", "hashed", lambda: framing.hashed)
register("encoder", "projection", lambda outputs=None: lambda x: encode.projection(x, outputs))
register("encoder", "network", lambda net: lambda x: encode.network(x, net))


@dataclass
class ModelStore:
    """Fitted models by fingerprint: found in the store, else fetched, else trained.

    ``fetch`` may return None; a model is taken only if its fingerprint is the wanted one."""

    load: Callable[[str], Any]
    save: Callable[[str, Any], None]
    fetch: Callable[[str], tuple[str, Any] | None] = lambda _: None
    found: dict[str, str] = field(default_factory=dict)

    def resolve(self, settings: Any, train: Callable[[], Any]) -> Any:
        want = fingerprint(settings)
        model = self.load(want)
        if model is not None:
            self.found[want] = "store"
            return model
        got = self.fetch(want)
        if got is not None and got[0] == want:
            self.found[want] = "hub"
            self.save(want, got[1])
            return got[1]
        self.found[want] = "trained"
        model = train()
        self.save(want, model)
        return model


class ModelFolder:
    """Fitted models in folders of a shared store, each with a manifest of what it was fitted with.

    A model is written under a name of its own, its manifest last, and renamed into place: what is half
    written has no place and is never found."""

    MANIFEST = "manifest.json"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.refused: list[str] = []

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commit(self, settings: Any, data_version: str, metrics: dict[str, float], write: Callable[[str], None], files: tuple[str, ...] = ()) -> str:
        """Have ``write`` fill a folder, and put it in place of what these settings had before; returns it.

        ``files``: names that must be there for the model to count."""
        name = fingerprint(settings)
        held, fs = self._at(f".{name}-{uuid.uuid4().hex}")
        fs.mkdirs(held)
        write(str(held))
        manifest = {"fingerprint": name, "data_version": data_version, "metrics": metrics, "files": list(files)}
        out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(held, self.MANIFEST))
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        place, _ = self._at(name)
        fs.delete(place, True)
        if not fs.rename(held, place):
            raise ConfigurationError(f"cannot put {held} in place")
        return str(place)

    def find(self, settings: Any, data_version: str, least: dict[str, float] | None = None) -> str | None:
        """The folder of a whole model of these settings and data that has every metric of ``least`` or more;
        None, with the reason in ``refused``, where there is no such one."""
        name = fingerprint(settings)
        place, fs = self._at(name)
        mark = self.spark._jvm.org.apache.hadoop.fs.Path

        def no(why: str) -> None:
            self.refused.append(why)

        if not fs.exists(mark(place, self.MANIFEST)):
            return no("no manifest")
        try:
            manifest = json.loads("".join(r.value for r in self.spark.read.text(str(mark(place, self.MANIFEST))).collect()))
            found, version, metrics, files = (manifest[k] for k in ("fingerprint", "data_version", "metrics", "files"))
        except (ValueError, KeyError, TypeError):
            return no("unreadable manifest")
        if found != name:
            return no("other settings")
        if version != data_version:
            return no(f"data version {version}")
        if missing := [f for f in files if not fs.exists(mark(place, f))]:
            return no(f"missing {missing[0]}")
        for metric, value in (least or {}).items():
            if not isinstance(metrics.get(metric), (int, float)) or not metrics[metric] >= value:
                return no(f"{metric} is {metrics.get(metric)}")
        return str(place)

    def resolve(self, settings: Any, data_version: str, fit: Callable[[], tuple[dict[str, float], Callable[[str], None]]], least: dict[str, float] | None = None, files: tuple[str, ...] = ()) -> str:
        """The folder found, else that of a model newly fitted: ``fit`` gives its metrics and how to write it."""
        found = self.find(settings, data_version, least)
        if found is None:
            metrics, write = fit()
            found = self.commit(settings, data_version, metrics, write, files)
        return found
