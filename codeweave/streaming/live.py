"""Live re-index: changes of a source tree become file events, and every burst of them brings its stored graph up to date.

Events come from any stream of :data:`codeweave.streaming.watch.EVENT` rows. Where there is no such stream,
:class:`Poller` compares the tree with what it was and spools the differences as files for one.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeweave.plans.build import build_index
from codeweave.sources.tree import walk
from codeweave.streaming.watch import EVENT, GAP, watch


class Poller:
    """Spools the changes of a tree on this machine: a JSON file of events for each look that finds any."""

    def __init__(self, root: str, spool: str):
        self.root, self.spool = os.path.realpath(root), spool
        os.makedirs(spool, exist_ok=True)
        self.seen = self._state()

    def _state(self) -> dict[str, tuple]:
        state = {}
        for path in [*(os.path.join(self.root, r) for _, r in walk(self.root)), os.path.join(self.root, ".git", "HEAD")]:
            try:
                s = os.stat(path)
            except OSError:  # gone meanwhile, or no repository
                continue
            state[path] = (s.st_mtime_ns, s.st_size)
        return state

    def look(self) -> int:
        """Spools what changed since the last look; how much that was."""
        now = self._state()
        changed = sorted(p for p in now.keys() | self.seen.keys() if now.get(p) != self.seen.get(p))
        self.seen = now
        if changed:
            at = dt.datetime.now(dt.timezone.utc).isoformat()
            name = uuid.uuid4().hex
            with open(os.path.join(self.spool, f".{name}"), "w", encoding="utf-8") as f:
                f.writelines(json.dumps({"src_path": p, "dest_path": None, "is_directory": False, "ts": at}) + "\n" for p in changed)
            os.rename(os.path.join(self.spool, f".{name}"), os.path.join(self.spool, f"{name}.json"))
        return len(changed)

    def run(self, stop: threading.Event, interval: float = 0.5) -> None:
        while not stop.wait(interval):
            self.look()


def spooled(spark: SparkSession, spool: str) -> DataFrame:
    """The stream of events that a :class:`Poller` spools."""
    return spark.readStream.schema(EVENT).option("cleanSource", "delete").json(spool)


def live(
    spark: SparkSession, root: str, home: str, events: DataFrame, checkpoint: str, done: Callable[[str, dict[str, int]], None] | None = None, gap: str = GAP, trigger: dict | None = None
) -> StreamingQuery:
    """Brings the stored graph of ``root`` up to date after each burst; ``done`` gets the reason and the new counts.

    Readers open the graph anew (``open_graph``); what they hold stays readable until the build after the next.
    """
    root = os.path.realpath(root)

    def refresh(reason: str) -> None:
        stats = build_index(spark, root, home)
        if done:
            done(reason, stats)

    return watch(events, root, refresh, checkpoint, gap, trigger)
