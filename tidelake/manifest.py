"""The manifest: schema epochs and how far the log has been flushed. Committing it is the commit point."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from .errors import ManifestError
from .files import Files
from .model import EpochSchema, KeyDef, SeriesSpec

FORMAT = 1
NAME = "manifest.json"


@dataclass
class Manifest:
    series: dict[str, list[EpochSchema]] = field(default_factory=dict)
    last_flushed_segment: int = 0  # 0: never flushed
    last_flush_at: int | None = None

    @classmethod
    def load(cls, files: Files) -> Manifest | None:
        if not files.exists(NAME):
            return None
        try:
            raw = json.loads(files.read(NAME))
            if raw.get("format", FORMAT) != FORMAT:
                raise ManifestError(f"the manifest has format {raw['format']}; this version reads {FORMAT}")
            series = {name: [EpochSchema(e["epoch"], tuple(KeyDef(k["name"], k["type"], k.get("nullable", False)) for k in e["keys"])) for e in epochs] for name, epochs in raw["series"].items()}
            return cls(series, raw["last_flushed_segment"], raw.get("last_flush_at"))
        except (ValueError, KeyError, TypeError) as e:
            raise ManifestError(f"the manifest cannot be read: {e}") from e

    def commit(self, files: Files) -> None:
        """Replaces the manifest as a whole."""
        raw = {
            "format": FORMAT,
            "last_flushed_segment": self.last_flushed_segment,
            "last_flush_at": self.last_flush_at,
            "series": {name: [{"epoch": e.epoch, "keys": [k.to_json() for k in e.keys]} for e in epochs] for name, epochs in self.series.items()},
        }
        files.replace(NAME, json.dumps(raw, indent=1))

    def current(self, name: str) -> EpochSchema:
        return self.series[name][-1]

    def schemas(self) -> dict[tuple[str, int], tuple[KeyDef, ...]]:
        return {(name, e.epoch): e.keys for name, epochs in self.series.items() for e in epochs}

    def reconcile(self, declared: list[SeriesSpec]) -> bool:
        """Adopts declared schemas; whether anything changed.

        Another layout than the latest is a new epoch, even one that was there
        before; a change of ``nullable`` alone updates the latest. A key may not
        have another type than in any epoch of its series: if one does, nothing
        is adopted. Series that are no longer declared keep their history.
        """
        for spec in declared:
            types = {k.name: k.type for epoch in self.series.get(spec.name, []) for k in epoch.keys}
            for key in spec.keys:
                if types.get(key.name, key.type) != key.type:
                    raise ManifestError(f"series {spec.name!r}: key {key.name!r} was {types[key.name]} in an earlier epoch and cannot become {key.type}")
        changed = False
        for spec in declared:
            history = self.series.setdefault(spec.name, [])
            new = EpochSchema(history[-1].epoch + 1 if history else 0, spec.keys)
            if not history or history[-1].layout != new.layout:
                history.append(new)
                changed = True
            elif history[-1].keys != spec.keys:
                history[-1] = EpochSchema(history[-1].epoch, spec.keys)
                changed = True
        return changed
