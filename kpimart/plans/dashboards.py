"""Named dashboard datasets (REG-2).

A dashboard dataset has a config and a name (default "Unnamed Dashboard")
and answers ``get_data(filters)`` with a lazy DataFrame. Two concrete kinds:

* ``PipelineDashboard``: runs its pipeline config over a source frame, with
  global filters applied to the source rows first (only the filters its view
  permits);
* ``StoredDashboard``: reads its latest saved aggregate and filters that.

``DashboardRegistry`` maps names to dashboard classes (last one wins).
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from kpimart.config import DashboardConfig
from kpimart.operators.charts import chart_dataset
from kpimart.operators.filters import apply_row_filters, check_permitted, to_specs
from kpimart.plans.processing import run
from kpimart.sinks.store import SnapshotStore

DEFAULT_NAME = "Unnamed Dashboard"


class DashboardDataset(ABC):
    def __init__(self, config: Mapping[str, Any] | None = None):
        self.config: dict[str, Any] = dict(config or {})
        self.name = self.config.get("name", DEFAULT_NAME)

    @abstractmethod
    def get_data(self, filters: Mapping[str, Any] | None = None) -> DataFrame | None:
        """The dashboard's data through ``filters``, as a lazy DataFrame."""

    def get_config(self) -> dict[str, Any]:
        return self.config

    def update_config(self, new_config: Mapping[str, Any]) -> None:
        """Shallow merge: top-level keys of ``new_config`` replace ours."""
        self.config.update(new_config)

    @property
    def parsed(self) -> DashboardConfig:
        return DashboardConfig.from_dict(self.config)

    def chart_data(self, filters: Mapping[str, Any] | None = None) -> list[DataFrame]:
        """One dataset per chart of the view, all from the same filtered data."""
        data = self.get_data(filters)
        if data is None:
            return []
        return [chart_dataset(data, c) for c in self.parsed.view.charts]


class PipelineDashboard(DashboardDataset):
    def __init__(self, config: Mapping[str, Any], source: DataFrame):
        super().__init__(config)
        self.source = source

    def get_data(self, filters: Mapping[str, Any] | None = None) -> DataFrame:
        cfg = self.parsed
        specs = to_specs(filters)
        check_permitted(cfg.view, specs)
        return run(apply_row_filters(self.source, specs), cfg.pipeline)


class StoredDashboard(DashboardDataset):
    def __init__(self, config: Mapping[str, Any], store: SnapshotStore, dashboard_id: int):
        super().__init__(config)
        self.store = store
        self.dashboard_id = int(dashboard_id)

    def get_data(self, filters: Mapping[str, Any] | None = None) -> DataFrame | None:
        specs = to_specs(filters)
        check_permitted(self.parsed.view, specs)
        agg = self.store.get(self.dashboard_id)
        return None if agg is None else apply_row_filters(agg, specs)


class DashboardRegistry:
    """Name -> dashboard class."""

    def __init__(self) -> None:
        self._registry: dict[str, type] = {}

    def register(self, name: str, dashboard_class: type) -> None:
        self._registry[name] = dashboard_class

    def get(self, name: str) -> type | None:
        return self._registry.get(name)

    def list_all(self) -> list[str]:
        return list(self._registry)

    def unregister(self, name: str) -> bool:
        return self._registry.pop(name, None) is not None


registry = DashboardRegistry()


def register_dashboard(name: str, dashboard_class: type) -> None:
    registry.register(name, dashboard_class)


def get_dashboard(name: str) -> type | None:
    return registry.get(name)
