"""See ``memspark.sources.memory``."""

from memspark.sources.memory import give_back, tidy  # noqa: F401
