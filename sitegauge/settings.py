"""What a deployment sets: site targets, the site's own domain, limits."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.sitegauge."


@dataclass(frozen=True)
class Settings:
    #: ``[pattern, target]`` pairs, the first match decides
    targets: tuple[tuple[str, str], ...] = (("^https?://(?:m|media)[.]", "mobile"), ("/(?:product|item)", "product"), ("^https?://dir[.]", "directory"))
    default_target: str = "default"
    domain: str = "example"
    chunk_bytes: int = 30 * 1024
    job_keep_ms: int = 30 * 60 * 1000

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The settings named in the session's configuration, defaults for the others.

        Numbers and texts stand as they are, targets as JSON; a value that does not parse is an error.
        """
        given = {}
        for f in fields(cls):
            text = spark.conf.get(PREFIX + f.name, None)
            if text is None:
                continue
            if f.name == "targets":
                given[f.name] = tuple((str(p), str(t)) for p, t in json.loads(text))
            else:
                given[f.name] = int(text) if isinstance(f.default, int) else text
        return cls(**given)
