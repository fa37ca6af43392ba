"""Options of a run, with their defaults and ranges."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Options:
    input_path: str
    api_key: str
    output_dir: str | None = None
    output: str | None = None
    network_concurrency: int = 40
    frames_per_mile: float = 100.0
    max_frames: int | None = None
    offset_frames: int = 0
    dry_run: bool = False
    print_metadata: bool = False
    use_metadata: bool = False
    interp: int | None = None
    minterp: str = "good"
    json: bool = False
    progress: bool = False
    optimizer: str | None = None
    optimizer_arg: str | None = None
    minimap: str = "off"
    minimap_position: str = "br"
    minimap_size: int = 40
    minimap_margin: int = 12
    minimap_zoom: int = 16
    no_cache: bool = False


def _between(low: int, high: int):
    def parse(text: str) -> int:
        value = int(text)
        if not low <= value <= high:
            raise argparse.ArgumentTypeError(f"{value} is not in {low}..{high}")
        return value

    return parse


def _natural(text: str) -> int:
    if (value := int(text)) < 0:
        raise argparse.ArgumentTypeError(f"{value} is negative")
    return value


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="waymark", description="From recorded tracks to evenly spaced, looked-up frames.")
    p.add_argument("input_path", help="GPX files, or summaries with --use-metadata")
    p.add_argument("--api-key", default=os.environ.get("GOOGLE_API_KEY"), help="key of the imagery and map services; else from GOOGLE_API_KEY")
    p.add_argument("--output-dir", help="folder of the single frames")
    p.add_argument("-o", "--output", help="name of the video; with several tracks their videos lie in their folders")
    p.add_argument("--network-concurrency", type=_natural, default=40, help="requests at once in each task")
    p.add_argument("-f", "--frames-per-mile", type=float, default=100.0)
    p.add_argument("--max-frames", type=_natural, help="frames at most; 0 keeps none")
    p.add_argument("--offset-frames", type=_natural, default=0)
    p.add_argument("-d", "--dry-run", action="store_true", help="only the summary and gaps")
    p.add_argument("--print-metadata", action="store_true")
    p.add_argument("--use-metadata", action="store_true", help="the input is a summary")
    p.add_argument("--interp", type=_natural, help="how finely steps are cut; else by frames per mile")
    p.add_argument("--minterp", default="good", help="motion: skip, fast, good")
    p.add_argument("--json", action="store_true")
    p.add_argument("--progress", action="store_true")
    p.add_argument("--optimizer", help="executable that chooses frames, or: path, for the cheapest path through them")
    p.add_argument("--optimizer-arg", help="handed to the executable; for path a JSON object of ratio_test, n_features, velocity_factor")
    p.add_argument("--minimap", choices=["off", "overview", "follow"], default="off")
    p.add_argument("--minimap-position", choices=["tl", "tr", "bl", "br"], default="br")
    p.add_argument("--minimap-size", type=_between(1, 100), default=40, help="percent of the video's shorter side")
    p.add_argument("--minimap-margin", type=_natural, default=12)
    p.add_argument("--minimap-zoom", type=_between(0, 21), default=16)
    p.add_argument("--no-cache", action="store_true")
    return p


def parse(arguments: list[str] | None = None) -> Options:
    p = parser()
    found = p.parse_args(arguments)
    if not found.api_key:
        p.error("--api-key, or GOOGLE_API_KEY in the environment, is needed")
    return Options(**{f.name: getattr(found, f.name) for f in fields(Options)})
