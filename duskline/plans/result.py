"""The envelope that every statement is answered with."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Result:
    """executed: the statement was understood and done. df: its rows, lazily. explain: how, in words or as a plan."""

    query: str
    executed: bool = False
    error: str | None = None
    df: DataFrame | None = None
    explain: str | None = None
    runtime_ms: int = 0
    details: dict = field(default_factory=dict)
    #: The last call of rows() or to_json() left rows out.
    truncated: bool = False

    def rows(self, limit: int | None = 10_000) -> list[dict]:
        """Rows on the driver, at most `limit` (None: all); `truncated` says whether there are more. Large results belong in a sink."""
        self.truncated = False
        if self.df is None:
            return []
        found = (self.df if limit is None else self.df.limit(limit + 1)).toJSON().collect()
        self.truncated = limit is not None and len(found) > limit
        return [json.loads(x) for x in (found[:limit] if self.truncated else found)]

    def measured(self) -> dict:
        """Run the query to its end, keep nothing, and say how many rows it made and how long that took."""
        if self.df is None:
            return {"rows": 0, "runtime_ms": self.runtime_ms}
        seen, began = Observation(), time.monotonic()
        self.df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        return {"rows": seen.get["rows"], "runtime_ms": int(1000 * (time.monotonic() - began))}

    def to_json(self, limit: int | None = 10_000) -> str:
        made = {"query": self.query, "executed": self.executed, "runtime": self.runtime_ms, "list": []}
        try:
            made["list"] = self.rows(limit)
        except Exception as e:  # rows are read here, so errors of reading belong to the statement
            self.error = str(e).splitlines()[0] if str(e) else type(e).__name__
        if self.truncated:
            made["truncated"] = True
        if self.error:
            made["error"] = self.error
        if self.explain:
            made["explain"] = self.explain
        return json.dumps(made, default=str)
