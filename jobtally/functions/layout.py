"""Job-id templates such as ``%e.%u.%H`` and the columns they describe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Template code and the component it stands for.
COMPONENT_CODES = {
    "%e": "exe",
    "%g": "group",
    "%u": "user",
    "%p": "proc",
    "%j": "job",
    "%H": "host_short",
    "%h": "host",
}

# Fixed value: separator of a template that shows none.
DEFAULT_SEPARATOR = "."


@dataclass(frozen=True)
class JobIdLayout:
    """Component names in template order and the one-character separator."""

    components: tuple[str, ...]
    separator: str = DEFAULT_SEPARATOR

    @classmethod
    def parse(cls, template: str) -> JobIdLayout:
        """Read a template from left to right; the first character of no code separates."""
        names: dict[str, None] = {}
        separator, rest = "", template
        while rest:
            name = COMPONENT_CODES.get(rest[:2])
            if name:
                names.setdefault(name)
            else:
                separator = separator or rest[0]
            rest = rest[2 if name else 1 :]
        return cls(tuple(names), separator or DEFAULT_SEPARATOR)

    def position(self, component: str) -> int:
        if component not in self.components:
            raise ValueError(
                f"component {component!r} is not in the job-id template; it has {', '.join(self.components)}"
            )
        return self.components.index(component)

    def parts(self, job_id: Column) -> Column:
        """The id cut at the separator, as an array."""
        pattern = self.separator if self.separator.isalnum() else "\\" + self.separator
        return F.split(job_id, pattern, -1)

    def group_key(self, job_id: Column, component: str, quote: bool = True) -> Column:
        """One component of the id, quoted; ids that lack it stay as they are."""
        if component == "none":
            return job_id
        bare = F.btrim(job_id, F.lit('"'))
        part = F.get(self.parts(bare), F.lit(self.position(component)))
        key = F.concat(F.lit('"'), part, F.lit('"')) if quote else part
        return F.when(bare.contains(self.separator) & part.isNotNull(), key).otherwise(job_id)

    def columns(self, job_id: Column) -> list[Column]:
        """One column per component, null where the id is too short."""
        parts = self.parts(F.btrim(job_id, F.lit('"')))
        return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(self.components)]
