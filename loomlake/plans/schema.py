"""Providers, tasks and the fields tasks require."""

from __future__ import annotations

import copy
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default tasks, fields and allowed values.
LANG, SRC, MOD = ["ko", "en", "ja", "multi"], ["real", "synthetic"], ["page", "table", "chart"]
DEFAULT = {
    "providers": {p: {"description": ""} for p in ("aihub", "huggingface", "opensource", "inhouse", "test")},
    "tasks": {
        **{t: {"description": "", "required_fields": ["lang", "src"], "allowed_values": {"lang": LANG, "src": SRC}} for t in ("ocr", "kie", "vqa", "layout")},
        "document_conversion": {"description": "", "required_fields": ["lang", "src", "mod"], "allowed_values": {"lang": LANG, "src": SRC, "mod": MOD}},
    },
}


class SchemaRegistry:
    """The task contract, kept in a YAML file if a path is given."""

    def __init__(self, path: str | None = None):
        self.path = Path(path) if path else None
        if self.path and self.path.exists():
            import yaml

            self.data = yaml.safe_load(self.path.read_text(encoding="utf-8")) or {"providers": {}, "tasks": {}}
        else:
            self.data = copy.deepcopy(DEFAULT)
            self.save()

    def save(self) -> None:
        if self.path:
            import yaml

            self.path.parent.mkdir(parents=True, exist_ok=True)
            self.path.write_text(yaml.safe_dump(self.data, allow_unicode=True, sort_keys=False), encoding="utf-8")

    def _add(self, kind: str, name: str, value: dict) -> bool:
        if name in self.data[kind]:
            return False
        self.data[kind][name] = value
        self.save()
        return True

    def _remove(self, kind: str, name: str) -> bool:
        if self.data[kind].pop(name, None) is None:
            return False
        self.save()
        return True

    def add_provider(self, name: str, description: str = "") -> bool:
        return self._add("providers", name, {"description": description})

    def remove_provider(self, name: str) -> bool:
        return self._remove("providers", name)

    def add_task(self, name: str, required_fields=(), allowed_values=None, description: str = "") -> bool:
        return self._add("tasks", name, {"description": description, "required_fields": list(required_fields), "allowed_values": dict(allowed_values or {})})

    def update_task(self, name: str, **changes) -> bool:
        if name not in self.data["tasks"]:
            return False
        self.data["tasks"][name] |= changes
        self.save()
        return True

    def remove_task(self, name: str) -> bool:
        return self._remove("tasks", name)

    def providers(self) -> list[str]:
        return list(self.data["providers"])

    def tasks(self) -> list[str]:
        return list(self.data["tasks"])

    def task(self, name: str) -> dict:
        return self.data["tasks"].get(name, {})

    def validate(self, task: str, meta) -> tuple[bool, str]:
        """The task, then unknown fields, then each required field and its value."""
        if task not in self.data["tasks"]:
            return False, f"unknown task: {task}"
        required, allowed = self.task(task).get("required_fields", []), self.task(task).get("allowed_values", {})
        if not isinstance(meta, dict):
            return False, f"meta must be an object with {required}"
        for f in meta:
            if f not in required:
                return False, f"field not allowed: {f}"
        for f in required:
            if f not in meta:
                return False, f"field missing: {f}"
            if f in allowed and meta[f] not in allowed[f]:
                return False, f"value not allowed: {f}"
        return True, "ok"


def check_rows(df: DataFrame, task: dict) -> DataFrame:
    """df with error: the first required field that is null or has a value not allowed, else null."""
    error = F.lit(None).cast("string")
    for f in reversed(task["required_fields"]):
        allowed = task.get("allowed_values", {}).get(f)
        error = F.when(F.col(f).isNull(), f"missing {f}").when(~F.col(f).isin(allowed) if allowed else F.lit(False), f"value {f}").otherwise(error)
    return df.withColumn("error", error)
