"""Promotion of rated groups and of a learned route: small versioned states, and verdicts as a table, kept below a folder."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from loglattice.operators.ranking import binomial_tail
from loglattice.session import created_alone, listed, read_text

MOST_PROMOTED = 16


class NotAllowed(ValueError):
    """The state machine doesn't allow this step."""


@dataclass
class Promotions:
    """Versions of a task's promoted groups, each with its parent; the last active one counts."""

    versions: list[tuple[int | None, tuple[int, ...]]] = field(default_factory=list)
    active: int | None = None

    def members(self) -> tuple[int, ...]:
        return () if self.active is None else self.versions[self.active][1]

    def promote(self, eligible: Sequence[int]) -> int:
        if not eligible or len(set(eligible)) > MOST_PROMOTED:
            raise NotAllowed("nothing eligible, or too much")
        self.versions.append((self.active, tuple(sorted(set(eligible)))))
        self.active = len(self.versions) - 1
        return self.active

    def demote(self, group: int) -> None:
        """A negative verdict takes a group out of what is active."""
        if group in self.members():
            self.versions.append((self.active, tuple(g for g in self.members() if g != group)))
            self.active = len(self.versions) - 1

    def rollback(self) -> None:
        if self.active is None:
            raise NotAllowed("nothing is promoted")
        self.active = self.versions[self.active][0]


@dataclass(frozen=True)
class Trial:
    """Held-out comparison of a challenger with the current route."""

    cases: int
    projects: int
    families: int
    challenger_passed: int
    current_passed: int
    challenger_only: int
    current_only: int
    p95_ratio: float
    calls_ratio: float
    cost_ratio: float | None = None
    ablation_passed: bool = True

    def passes(self) -> bool:
        enough = self.cases >= 10 and self.projects >= 3 and self.families >= 3
        better = self.challenger_passed > self.current_passed and self.current_only == 0 and binomial_tail(self.challenger_only, self.current_only) <= 0.01
        cheap = self.p95_ratio <= 1.25 and self.calls_ratio <= 1.25 and (self.cost_ratio is None or self.cost_ratio <= 1.25)
        return enough and better and cheap and self.ablation_passed


@dataclass
class Routes:
    """shadow -> active -> retired, one active at a time; a promotion needs a passed trial on unchanged labels and its parent active."""

    routes: list[dict] = field(default_factory=list)

    def active(self) -> int | None:
        return next((i for i, r in enumerate(self.routes) if r["status"] == "active"), None)

    def register(self, labels_digest: str) -> int:
        self.routes.append({"status": "shadow", "parent": self.active(), "digest": labels_digest})
        return len(self.routes) - 1

    def promote(self, route: int, trial: Trial, labels_digest: str) -> None:
        r = self.routes[route]
        if r["status"] != "shadow" or not trial.passes() or r["digest"] != labels_digest or r["parent"] != self.active():
            raise NotAllowed("not ready")
        if r["parent"] is not None:
            self.routes[r["parent"]]["status"] = "retired"
        r["status"] = "active"

    def rollback(self) -> None:
        now = self.active()
        if now is None:
            raise NotAllowed("no active route")
        self.routes[now]["status"] = "retired"
        if self.routes[now]["parent"] is not None:
            self.routes[self.routes[now]["parent"]]["status"] = "active"


VERDICTS = "task string, native_id string, nonce string, verdict int"


class Store:
    """Verdicts, promotions by task and routes below ``path``; a change is a numbered file that one writer creates, or none."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _numbers(self, what: str) -> list[int]:
        return sorted(int(n) for n in listed(self.spark, f"{self.path}/{what}") if n.isdigit())

    def _last(self, what: str) -> tuple[int, dict | None]:
        numbers = self._numbers(what)
        return (numbers[-1], json.loads(read_text(self.spark, f"{self.path}/{what}/{numbers[-1]}"))) if numbers else (-1, None)

    def _change(self, what: str, number: int, state: dict) -> None:
        if not created_alone(self.spark, f"{self.path}/{what}/{number + 1}", json.dumps(state)):
            raise NotAllowed("another writer was first; read again")

    def add_verdicts(self, verdicts: DataFrame, number: int) -> None:
        """Adds a batch of verdicts; a batch that was added before changes nothing."""
        if number not in self._numbers("committed"):
            verdicts.select(*[f.split()[0] for f in VERDICTS.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/verdicts/batch={number}")
            created_alone(self.spark, f"{self.path}/committed/{number}", "")

    def verdicts(self) -> DataFrame:
        """The last verdict of each task, record and nonce."""
        done = self._numbers("committed")
        if not done:
            return self.spark.createDataFrame([], VERDICTS)
        rows = self.spark.read.schema(f"{VERDICTS}, batch int").parquet(f"{self.path}/verdicts").where(F.col("batch").isin(done))
        return rows.groupBy("task", "native_id", "nonce").agg(F.max(F.struct("batch", "verdict"))["verdict"].alias("verdict"))

    def promotions(self, task: str) -> Promotions:
        _, state = self._last("promotions")
        held = (state or {}).get(task)
        return Promotions([(p, tuple(m)) for p, m in held["versions"]], held["active"]) if held else Promotions()

    def change_promotions(self, task: str, change: Callable[[Promotions], object]) -> Promotions:
        number, state = self._last("promotions")
        now = self.promotions(task)
        change(now)
        self._change("promotions", number, (state or {}) | {task: {"versions": now.versions, "active": now.active}})
        return now

    def routes(self) -> Routes:
        _, state = self._last("routes")
        return Routes(state["routes"]) if state else Routes()

    def change_routes(self, change: Callable[[Routes], object]) -> Routes:
        number, _ = self._last("routes")
        now = self.routes()
        change(now)
        self._change("routes", number, {"routes": now.routes})
        return now
