"""Session settings and JSON documents with comments."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass, fields, replace
from typing import Any

#: Names of the settings in documents.
NAMES = {"threads": "Threads", "verbose": "Verbose", "bin_summary": "Bin Summary Statistics", "zoom_levels": "BigWig Zoom Levels", "bin_size": "Bin Size", "bin_overlap": "Bin Overlap", "track_init": "Track Initial Value"}


def parse_json(text: str) -> Any:
    """JSON in which everything from the first # of a line on is a comment, also inside a string."""
    return json.loads("".join(line.split("#", 1)[0] for line in text.splitlines()))


def dump_json(doc: Any) -> str:
    return json.dumps(doc, indent=2)


@dataclass(frozen=True)
class SessionConfig:
    threads: int = 1
    verbose: int = 0
    bin_summary: str = "mean"
    zoom_levels: tuple[int, ...] | None = None
    bin_size: int = 0  # that of the file
    bin_overlap: int = 0
    track_init: float = 0.0

    def merged(self, text: str) -> "SessionConfig":
        """With the settings that a document has in place of these."""
        doc = parse_json(text)
        got = {k: doc[name] for k, name in NAMES.items() if name in doc}
        if isinstance(got.get("zoom_levels"), list):
            got["zoom_levels"] = tuple(got["zoom_levels"])
        out = replace(self, **got)
        if out.bin_size < 0 or out.threads < 1:
            raise ValueError("bin size must not be negative, and threads at least 1")
        return out

    def to_json(self) -> str:
        return dump_json({NAMES[f.name]: getattr(self, f.name) for f in fields(self)})

    def say(self, level: int, text: str, *args: object) -> None:
        """Log a text if the session is verbose enough."""
        if self.verbose >= level:
            logging.getLogger("trackengine").warning(text, *args)
