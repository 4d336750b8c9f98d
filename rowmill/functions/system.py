"""Run variables and parameters as literals, so they fold into the plan."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    """What a job knows about its own run."""

    job_name: str = ""
    project_name: str = ""
    context: str = "dev"
    job_version: str = "1.0"
    is_child_job: bool = False
    root_dir: str = ""
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    def variable(self, name: str) -> Column:
        """Run variable by name; every process id name is the run id."""
        values = {
            "pid": self.run_id, "Pid": self.run_id, "rootPid": self.run_id, "root_pid": self.run_id,
            "fatherPid": self.run_id, "father_pid": self.run_id,
            "jobName": self.job_name, "projectName": self.project_name, "contextStr": self.context,
            "jobVersion": self.job_version, "isChildJob": self.is_child_job, "rootDir": self.root_dir,
        }
        if name == "currentDate":
            return F.current_date()
        if name == "startTime":
            return F.current_timestamp()
        return F.lit(values[name])


def os_name() -> Column:
    return F.lit("Linux")


def param(params: Mapping[str, object], key: str, kind: str | None = None) -> Column:
    """A parameter as a literal, the empty text when it is not set."""
    value = F.lit(params.get(key, ""))
    return value.cast(kind) if kind else value


def has_param(params: Mapping[str, object], key: str) -> Column:
    return F.lit(key in params)
