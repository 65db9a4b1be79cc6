"""Settings of searches, downloads and answers, with the ranges they must keep."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """D9. Values come from arguments, or from the environment by from_env()."""

    arxiv_max_results: int = 10
    request_delay: float = 3.0
    context_papers: int = 10
    data_dir: str = "data"

    def __post_init__(self) -> None:
        if not 1 <= self.arxiv_max_results <= 100:
            raise ValueError("arxiv_max_results must be from 1 to 100")
        if self.request_delay < 0.5:
            raise ValueError("request_delay must be 0.5 or more")
        if self.context_papers < 1:
            raise ValueError("context_papers must be 1 or more")

    @classmethod
    def from_env(cls, prefix: str = "QUILLGRAPH_") -> Settings:
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[f.type](os.environ[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in os.environ})
