"""Command line: summaries and gaps of track files, rendered frames and videos."""

from __future__ import annotations

import sys

from waymark import options as opts
from waymark.plans import route
from waymark.progress import Progress
from waymark.session import local_path, new_path, session
from waymark.sources import fetch, summary


def main(arguments: list[str] | None = None, fetcher: fetch.Fetcher | None = None, cache: str | None = None, encoder: str = "ffmpeg") -> int:
    o = opts.parse(arguments)
    tell = Progress(o.progress)
    spark = session()
    fetcher = fetcher or fetch.http()
    cache = None if o.no_cache else cache or fetch.default_cache(spark)
    tell.stage("Reading tracks")
    found, jumps = route.dry_run(spark, o, fetcher, cache)
    found = found.persist()
    if o.dry_run or o.print_metadata:
        for row in (summary.to_json if o.json else summary.to_text)(found).toLocalIterator():
            print(row["value"])
    for row in jumps.orderBy("track_id", "frame").toLocalIterator():
        print(row["line"], file=sys.stderr)
    if not o.dry_run:
        tell.stage("Fetching frames")
        folder = o.output_dir or local_path(new_path(spark, "frames"))
        tracks = route.rendered(spark, o, found, fetcher, folder, cache).persist()
        for row in tracks.toLocalIterator():
            tell.message(f"{row['frames']} frames of {row['track_id']} in {row['folder']}")
        tell.stage("Joining images to videos")
        for row in route.filmed(o, tracks, tell.message, encoder).toLocalIterator():
            tell.message(f"{row['video']}: {row['bytes'] / 1e6:.2f} MB")
    return 0


if __name__ == "__main__":
    sys.exit(main())
