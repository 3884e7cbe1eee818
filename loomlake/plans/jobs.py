"""Jobs of the driver process."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import datetime


class JobRegistry:
    """Jobs by id with their states: pending, running, completed, failed."""

    def __init__(self):
        self._jobs: dict[str, dict] = {}
        self._lock = threading.Lock()

    @staticmethod
    def new_id(kind: str) -> str:
        return f"{kind}_{datetime.now().strftime('%Y%m%d_%H%M%S_%f')[:19]}"

    def running(self, kind: str | None = None) -> list[str]:
        return [i for i, j in self._jobs.items() if j["status"] in ("pending", "running") and (kind is None or j["kind"] == kind)]

    def start(self, kind: str, fn: Callable, exclusive: bool = False, background: bool = True) -> str:
        """exclusive: refused while any job runs; else only while one of its kind does."""
        with self._lock:
            if self.running(None if exclusive else kind):
                raise RuntimeError("a job is running")
            ident = base = self.new_id(kind)
            n = 1
            while ident in self._jobs:
                ident, n = f"{base}_{n}", n + 1
            self._jobs[ident] = {"job_id": ident, "kind": kind, "status": "pending", "started_at": datetime.now().isoformat(), "completed_at": None, "result": None, "error": None}
        if background:
            threading.Thread(target=self._run, args=(ident, fn), daemon=True).start()
        else:
            self._run(ident, fn)
        return ident

    def _run(self, ident: str, fn: Callable) -> None:
        job = self._jobs[ident]
        job["status"] = "running"
        try:
            job["result"], status = fn(), "completed"
        except Exception as e:
            job["error"], status = str(e), "failed"
        job["completed_at"], job["status"] = datetime.now().isoformat(), status

    def get(self, ident: str) -> dict:
        return dict(self._jobs[ident])

    def list(self) -> list[dict]:
        return sorted((dict(j) for j in self._jobs.values()), key=lambda j: j["started_at"], reverse=True)

    def delete(self, ident: str) -> None:
        if ident not in self._jobs:
            raise KeyError(ident)
        if ident in self.running():
            raise RuntimeError("a running job can't be deleted")
        del self._jobs[ident]

    def wait(self, ident: str, timeout: float = 3600, poll: float = 0.1) -> dict:
        end = time.monotonic() + timeout
        while ident in self.running():
            if time.monotonic() > end:
                raise TimeoutError(ident)
            time.sleep(poll)
        return self.get(ident)
