"""Settings of the report pipeline, from the session or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from plinth.operators import incidents


def env_of(path: str) -> dict[str, str]:
    """NAME=value lines of a file; blank ones and those that begin with # say nothing, quotes around a value go."""
    out = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            name, mark, value = line.strip().removeprefix("export ").partition("=")
            if mark and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("\"'")
    return out


@dataclass(frozen=True)
class Settings:
    """Of the model only what a stage with a model needs is required; ``most_reports`` None takes all."""

    endpoint: str | None = None
    model: str | None = None
    most_reports: int | None = 100
    cache: str | None = None

    @classmethod
    def of(cls, spark: SparkSession | None = None, env_file: str | None = None) -> "Settings":
        """spark.plinth.<name> of the session first, then PLINTH_<NAME> of the environment, then of ``env_file``."""
        filed = env_of(env_file) if env_file else {}
        get = lambda name: (spark.conf.get(f"spark.plinth.{name}", None) if spark else None) or os.environ.get(f"PLINTH_{name.upper()}") or filed.get(f"PLINTH_{name.upper()}") or None
        most = get("most_reports")
        return cls(get("endpoint"), get("model"), None if most == "all" else int(most or 100), get("cache"))

    def client(self):
        """Maker of the HTTP client; an error where endpoint or model is unset."""
        missing = [n for n in ("endpoint", "model") if not getattr(self, n)]
        if missing:
            raise ValueError(f"not set: {', '.join(missing)}")
        endpoint, model = self.endpoint, self.model
        return lambda: incidents.http_client(endpoint, model)
