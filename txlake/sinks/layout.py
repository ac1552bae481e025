"""Paths of the lake layers."""

from __future__ import annotations

from dataclasses import dataclass

# Layers, their default entity, and older names of the layers.
DEFAULT_ENTITY = {"bronze": "transactions", "silver": "transactions", "gold": "transactions_ml"}
LAYER_ALIASES = {"raw": "bronze", "landing": "bronze", "processed": "silver", "curated": "gold"}


@dataclass(frozen=True)
class LakeLayout:
    """``{base}/{layer}/{entity}`` on any file system Spark can reach."""

    base_uri: str

    @staticmethod
    def layer(name: str) -> str:
        lowered = name.lower()
        resolved = LAYER_ALIASES.get(lowered, lowered)
        if resolved not in DEFAULT_ENTITY:
            raise ValueError(f"unknown layer: {name}")
        return resolved

    def path(self, layer: str, entity: str | None = None) -> str:
        layer = self.layer(layer)
        return f"{self.base_uri.rstrip('/')}/{layer}/{(entity or DEFAULT_ENTITY[layer]).strip('/')}"

    def bronze(self, entity: str | None = None) -> str:
        return self.path("bronze", entity)

    def silver(self, entity: str | None = None) -> str:
        return self.path("silver", entity)

    def gold(self, entity: str | None = None) -> str:
        return self.path("gold", entity)

    def reports(self, name: str) -> str:
        return f"{self.base_uri.rstrip('/')}/reports/{name}"
