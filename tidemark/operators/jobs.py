"""A small ledger of research jobs on the driver: submit, claim, finish, retry, cancel, with a journal."""

from __future__ import annotations

import json
import sqlite3
import time
from collections.abc import Callable


class Jobs:
    def __init__(self, path: str = ":memory:"):
        self.db = sqlite3.connect(path, isolation_level=None)
        self.db.executescript("""
            CREATE TABLE IF NOT EXISTS jobs (id INTEGER PRIMARY KEY, kind TEXT, request TEXT, state TEXT, attempts INTEGER DEFAULT 0, result TEXT);
            CREATE TABLE IF NOT EXISTS journal (at REAL, job INTEGER, event TEXT);
        """)

    def note(self, job: int, event: str) -> None:
        self.db.execute("INSERT INTO journal VALUES (?, ?, ?)", (time.time(), job, event))

    def submit(self, kind: str, request: dict) -> int:
        job = self.db.execute("INSERT INTO jobs (kind, request, state) VALUES (?, ?, 'queued')", (kind, json.dumps(request, sort_keys=True))).lastrowid
        self.note(job, "submitted")
        return job

    def claim(self) -> tuple[int, str, dict] | None:
        row = self.db.execute("UPDATE jobs SET state = 'running', attempts = attempts + 1 WHERE id = (SELECT min(id) FROM jobs WHERE state = 'queued') RETURNING id, kind, request").fetchone()
        if row is None:
            return None
        self.note(row[0], "claimed")
        return row[0], row[1], json.loads(row[2])

    def close(self, job: int, state: str, result: object = None) -> None:
        self.db.execute("UPDATE jobs SET state = ?, result = ? WHERE id = ?", (state, json.dumps(result, default=str), job))
        self.note(job, state)

    def cancel(self, job: int) -> bool:
        done = self.db.execute("UPDATE jobs SET state = 'cancelled' WHERE id = ? AND state = 'queued'", (job,)).rowcount == 1
        if done:
            self.note(job, "cancelled")
        return done

    def retry(self, job: int) -> bool:
        done = self.db.execute("UPDATE jobs SET state = 'queued' WHERE id = ? AND state = 'failed'", (job,)).rowcount == 1
        if done:
            self.note(job, "retried")
        return done

    def state(self, job: int) -> str:
        return self.db.execute("SELECT state FROM jobs WHERE id = ?", (job,)).fetchone()[0]

    def history(self, job: int) -> list[str]:
        return [e for (e,) in self.db.execute("SELECT event FROM journal WHERE job = ? ORDER BY rowid", (job,))]


def run_one(jobs: Jobs, handlers: dict[str, Callable[[dict], object]]) -> int | None:
    """Claims a job and runs its handler; a failure is recorded, not raised."""
    claimed = jobs.claim()
    if claimed is None:
        return None
    job, kind, request = claimed
    try:
        jobs.close(job, "done", handlers[kind](request))
    except Exception as e:  # the ledger keeps the reason
        jobs.close(job, "failed", f"{type(e).__name__}: {e}")
    return job
