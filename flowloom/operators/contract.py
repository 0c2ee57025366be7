"""The feature contract: what a capture can tell, by feature, and which consumers may read it; checked when a plan is made.

The contract that ships is flowloom/contract.toml. Reads are the columns that a plan refers to (columns_of()), so that a rule cannot
read what its consumer does not declare without the check telling.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable
from dataclasses import dataclass
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession

STATES = ("computable", "degraded", "reverse_dependent", "unavailable")


class UnavailableFeature(LookupError):
    """The capture cannot support this feature."""


@dataclass(frozen=True)
class Feature:
    name: str
    state: str
    tier: str
    approx: str = "exact"
    reason: str = ""
    substitutes: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()


def columns_of(*expressions: Column) -> set[str]:
    """Names that occur in column expressions."""
    return {w for e in expressions for w in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", str(e))}


@dataclass(frozen=True)
class Contract:
    features: dict[str, Feature]
    consumers: dict[str, dict]
    version: str = ""

    @classmethod
    def parse(cls, text: str) -> Contract:
        """features: a table each, or groups of names that share the rest. Names twice, and what problems() finds, are an error."""
        spec = tomllib.loads(text)
        each = [*spec.get("features", []), *({**g, "name": n} for g in spec.get("group", []) for n in g["names"])]
        rows = [Feature(f["name"], f["state"], f["tier"], f.get("approx", "exact"), f.get("reason", ""), tuple(f.get("substitutes", ())), tuple(f.get("sources", ()))) for f in each]
        if len({f.name for f in rows}) != len(rows):
            raise ValueError("a feature is named twice")
        made = cls({f.name: f for f in rows}, spec.get("consumers", {}), spec.get("version", ""))
        if problems := made.problems():
            raise ValueError("; ".join(problems))
        return made

    @classmethod
    def load(cls) -> Contract:
        return cls.parse(resources.files("flowloom").joinpath("contract.toml").read_text())

    def problems(self) -> list[str]:
        """What the contract says against itself: unknown states and substitutes, consumers above their own tier."""
        out = [f"{f.name}: unknown state {f.state}" for f in self.features.values() if f.state not in STATES]
        out += [f"{f.name}: unknown substitute {s}" for f in self.features.values() for s in f.substitutes if s not in self.features]
        for name, spec in self.consumers.items():
            if spec.get("max_state", "computable") not in STATES[:-1]:
                out.append(f"{name}: no such highest state {spec['max_state']}")
            elif not out:
                out += [f"{name}: {why}" for why in self.violations(name, spec.get("reads", []))]
        return out

    def require(self, name: str) -> Feature:
        if name not in self.features:
            raise KeyError(name)
        if self.features[name].state == "unavailable":
            raise UnavailableFeature(f"{name}: {self.features[name].reason}")
        return self.features[name]

    def violations(self, consumer: str, reads: Iterable[str]) -> list[str]:
        """What a consumer reads without declaring it, that is no feature, or that is above its highest state."""
        if consumer not in self.consumers:
            return [f"{consumer} is no consumer"]
        spec, out = self.consumers[consumer], []
        top = STATES.index(spec.get("max_state", "computable"))
        for c in dict.fromkeys(reads):
            if c not in self.features:
                out.append(f"{c} is no feature")
                continue
            if c not in spec.get("reads", []):
                out.append(f"{c} is not declared")
            if STATES.index(self.features[c].state) > top:
                out.append(f"{c} is {self.features[c].state}")
        return out

    def select(self, flows: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
        """keep and features by name: unknown ones are a KeyError, unavailable ones refused, before anything runs."""
        for n in names:
            self.require(n)
        return flows.select(*keep, *names)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.name, f.state, f.tier, f.approx, f.reason) for f in self.features.values()], "name string, state string, tier string, approx string, reason string")
