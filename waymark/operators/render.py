"""Frames of the map overlay, and the encoder's arguments."""

from __future__ import annotations

import json
import os
import shutil
import subprocess
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, images
from waymark.session import ship

# The video, and the encoder's settings.
FPS, WIDTH, HEIGHT = 24, 640, 480
SUFFIX = "map.png"
CHAINS = {"skip": "null", "fast": "minterpolate=fps=48,tblend=all_mode=average,framestep=2", "good": "minterpolate='mi_mode=mci:mc_mode=aobmc:vsbmc=1:fps=72'"}
PROGRESS = {"skip": 100.0, "fast": 100.0, "good": 33.3}
ENCODE = ["-c:v", "libx264", "-crf", "22", "-pix_fmt", "yuv420p", "-preset", "faster", "-movflags", "faststart", "-progress", "pipe:1", "-y"]


def frame_filename(index: int) -> str:
    return f"{index}.{SUFFIX}"


def frame_pattern() -> str:
    return f"%d.{SUFFIX}"


def motion(name: str | None) -> str:
    """skip, fast or good; anything else, or nothing, is good."""
    return name if name in ("skip", "fast") else "good"


def motion_column(name: Column) -> Column:
    return F.when(name.isin("skip", "fast"), name).otherwise("good")


def filter_graph(mode: Column, x: Column, y: Column, size: Column) -> Column:
    """The encoder's filter graph: motion first, then the map over it if there is one (size not null)."""
    chain = F.when(mode == "skip", CHAINS["skip"]).when(mode == "fast", CHAINS["fast"]).otherwise(CHAINS["good"])
    over = F.concat(F.lit("[0:v]"), chain, F.lit("[base];[1:v]scale="), size.cast("string"), F.lit(":"), size.cast("string"), F.lit("[map];[base][map]overlay="), x.cast("string"), F.lit(":"), y.cast("string"), F.lit("[out]"))
    return F.when(size.isNull(), F.concat(F.lit("[0:v]"), chain, F.lit("[out]"))).otherwise(over)


def progress_percent(mode: Column, frame: Column, frames: Column) -> Column:
    return F.when(mode.isin("skip", "fast"), PROGRESS["fast"]).otherwise(PROGRESS["good"]) * frame / frames


@dataclass(frozen=True)
class Overlay:
    x: int
    y: int
    size: int


def graph_text(mode: str, overlay: Overlay | None) -> str:
    if overlay is None:
        return f"[0:v]{CHAINS[mode]}[out]"
    return f"[0:v]{CHAINS[mode]}[base];[1:v]scale={overlay.size}:{overlay.size}[map];[base][map]overlay={overlay.x}:{overlay.y}[out]"


def join_arguments(optimized: bool, out: str) -> list[str]:
    """Arguments by which the encoder joins the images to a video."""
    return ["-framerate", str(FPS), "-pattern_type", "sequence", "-i", "%d.opt.jpg" if optimized else "%d.jpg", "-s:v", f"{WIDTH}x{HEIGHT}", *ENCODE, out]


def finish_arguments(mode: str, overlay: Overlay | None, source: str, out: str) -> list[str] | None:
    """Arguments of the final pass; None if the video only needs another name."""
    if mode == "skip" and overlay is None:
        return None
    maps = ["-framerate", str(FPS), "-pattern_type", "sequence", "-start_number", "0", "-i", frame_pattern()] if overlay else []
    return ["-i", source, *maps, "-filter_complex", graph_text(mode, overlay), "-map", "[out]", *ENCODE, out]


def run_encoder(folder: str, arguments: list[str], percent: Callable[[int], float], tell: Callable[[str], None], command: str = "ffmpeg") -> None:
    """Runs the encoder in a folder and tells how far it is from its frame= lines; RuntimeError if it fails."""
    with subprocess.Popen([command, *arguments], cwd=folder, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) as run:
        for line in run.stdout:
            name, _, value = line.strip().partition("=")
            if name == "frame" and value.strip().isdigit():
                tell(f"{percent(int(value)):.1f}%")
    if run.returncode:
        raise RuntimeError(f"the encoder ended with {run.returncode}")


VIDEO_SCHEMA = "track_id string, video string, bytes long"


def make_video(folder: str, count: int, mode: str, overlay: Overlay | None, out: str, optimized: bool = False, tell: Callable[[str], None] = lambda _: None, command: str = "ffmpeg") -> str:
    """Joins the count images of a folder to a video at out, in a second pass with motion and maps; without either it is only moved there."""
    first = out.removesuffix(".mp4") + "-original.mp4"
    run_encoder(folder, join_arguments(optimized, first), lambda frame: 100.0 * frame / count, tell, command)
    again = finish_arguments(mode, overlay, first, out)
    if again is None:
        os.replace(os.path.join(folder, first), os.path.join(folder, out))
    else:
        run_encoder(folder, again, lambda frame: PROGRESS[mode] * frame / count, tell, command)
    return out


def videos(tracks: DataFrame, mode: str, overlay: Overlay | None, out: str, optimized: bool = False, command: str = "ffmpeg") -> DataFrame:
    """track_id, video, bytes: make_video() for each row (track_id, folder, frames) with frames, tracks side by side."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [os.path.join(f, make_video(f, n, mode, overlay, out, optimized, command=command)) for f, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string()), pa.array([os.path.getsize(x) for x in made], pa.int64())], names=["track_id", "video", "bytes"])

    ship(tracks.sparkSession)
    kind = tracks.schema["track_id"].dataType.simpleString()
    return tracks.filter("frames > 0").select("track_id", "folder", "frames").repartition("track_id").mapInArrow(run, f"track_id {kind}, video string, bytes long")


@lru_cache(maxsize=4)
def _decoded(data: bytes):
    return images.from_png(data)


def check_counts(maps: DataFrame, frames: DataFrame) -> None:
    """In follow mode every frame has its own map; ValueError with both counts if not."""
    a, b = maps.groupBy("track_id").agg(F.count(F.lit(1)).alias("maps")), frames.groupBy("track_id").agg(F.count(F.lit(1)).alias("frames"))
    bad = a.join(b, "track_id", "full").filter(~F.coalesce(F.col("maps") == F.col("frames"), F.lit(False))).first()
    if bad:
        raise ValueError(f"{bad['maps'] or 0} maps for {bad['frames'] or 0} frames of {bad['track_id']}")


def overlay_frames(frames: DataFrame, maps: DataFrame, mode: str, framing: DataFrame | None = None, size: int = 192) -> DataFrame:
    """track_id, seq, name, body: a PNG for each frame, the map with a dot where the frame is.

    maps: track_id, body, in follow mode also seq.  overview: one map for a
    track, framed as framing (track_id, center_lat, center_lng, zoom) says.
    follow: the dot is in the middle.  A map that can't be decoded is an error.
    """
    if mode == "follow":
        check_counts(maps, frames)
        df = frames.select("track_id", "seq").join(maps.select("track_id", "seq", "body"), ["track_id", "seq"]).select("track_id", "seq", F.lit(-1.0).alias("x"), F.lit(-1.0).alias("y"), "body")
    else:
        x, y = geo.image_pixel("lat", "lng", "center_lat", "center_lng", "zoom", size)
        df = frames.join(framing, "track_id").select("track_id", "seq", x.alias("x"), y.alias("y")).join(maps.select("track_id", "body"), "track_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                image = _decoded(r["body"])
                h, w = image.shape[:2]
                at = (w / 2, h / 2) if mode == "follow" else (r["x"], r["y"])
                out.append(images.to_png(images.compose(image, *at)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([frame_filename(s) for s in batch.column(1).to_pylist()], pa.string()), pa.array(out, pa.binary())], names=["track_id", "seq", "name", "body"])

    ship(df.sparkSession)
    kind = frames.schema["track_id"].dataType.simpleString()
    return df.mapInArrow(run, f"track_id {kind}, seq long, name string, body binary")


def renamed(folder: str, kept: list[int]) -> None:
    """Renames the kept images of a folder to {n}.opt.jpg in their order; one that is kept twice is copied, one that a repeated task finds renamed is left."""
    for to, own in enumerate(kept):
        source, target = os.path.join(folder, f"{own}.jpg"), os.path.join(folder, f"{to}.opt.jpg")
        if os.path.exists(target) and not os.path.exists(source):
            continue
        (shutil.copyfile if own in kept[to + 1 :] else os.replace)(source, target)


def optimizer(command: str, folder: str, argument: str | None = None) -> list[int]:
    """Runs an external chooser of frames and renames what it keeps to {n}.opt.jpg; no frames if it fails.

    It gets the folder and an optional argument, and prints a JSON array of the
    numbers of the frames to keep.
    """
    done = subprocess.run([command, folder, *([argument] if argument is not None else [])], capture_output=True, text=True)
    if done.returncode:
        return []
    kept = json.loads(done.stdout)
    renamed(folder, kept)
    return kept


def optimized(tracks: DataFrame, command: str, argument: str | None = None) -> DataFrame:
    """track_id, kept: optimizer() for each row (track_id, folder), tracks side by side."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [optimizer(command, f, argument) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.list_(pa.int64()))], names=["track_id", "kept"])

    ship(tracks.sparkSession)
    kind = tracks.schema["track_id"].dataType.simpleString()
    return tracks.select("track_id", "folder").repartition("track_id").mapInArrow(run, f"track_id {kind}, kept array<long>")


def rename_kept(tracks: DataFrame) -> None:
    """renamed() for each row (folder, kept)."""

    def run(rows) -> None:
        for row in rows:
            renamed(row["folder"], row["kept"])

    ship(tracks.sparkSession)
    tracks.select("folder", "kept").foreachPartition(run)
