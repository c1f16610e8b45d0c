"""Pages of bars in files, as a venue would answer them: the option folder names where, a file for each hundred bars."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

PER_FILE = 100


def write(folder: Path, bars: int, step: int) -> None:
    for k in range(0, bars, PER_FILE):
        (folder / f"{k * step}.json").write_text(json.dumps([[t * step, 100.0 + t % 7] for t in range(k, min(bars, k + PER_FILE))]))


def fetch(start: int, end: int, options: dict) -> Iterator[tuple]:
    width = PER_FILE * int(options["step"])
    for at in range(start // width * width, end, width):
        file = Path(options["folder"]) / f"{at}.json"
        for t, close in json.loads(file.read_text()) if file.exists() else []:
            if start <= t < end:
                yield t, close
