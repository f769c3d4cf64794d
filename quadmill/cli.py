"""Command line: quadmill INPUT OUTPUT."""

from __future__ import annotations

import argparse
import os
import sys
import time

from .api import convert


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadmill", description="Convert GeoParquet to PMTiles vector tiles")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--min-zoom", type=int, default=0)
    p.add_argument("--max-zoom", type=int, default=14)
    p.add_argument("--drop-density", default="medium", help="low, medium or high; see --apply-density")
    p.add_argument("--apply-density", action="store_true", help="limit features per grid cell as --drop-density says")
    p.add_argument("--layer-name")
    p.add_argument("-y", "--include", action="append", default=[], metavar="FIELD")
    p.add_argument("-x", "--exclude", action="append", default=[], metavar="FIELD")
    p.add_argument("-X", "--exclude-all", action="store_true")
    p.add_argument("--compression", default="zstd", help="zstd, gzip, brotli or none")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--deterministic", action="store_true", help="accepted; output always is")
    return p


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB"):
        if n < 1024 or unit == "GiB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    began = time.time()

    def show(event: dict) -> None:
        print(f"[{time.time() - began:7.1f} s] " + ", ".join(f"{k} {v:,}" if isinstance(v, int) else f"{k} {v}" for k, v in event.items()), file=sys.stderr)

    try:
        r = convert(a.input, a.output, a.min_zoom, a.max_zoom, a.drop_density, a.compression, a.include or None, a.exclude or None, a.exclude_all, a.layer_name, a.deterministic, show if a.verbose else None, a.apply_density)
    except (ValueError, RuntimeError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    took = max(time.time() - began, 1e-9)
    print(f"Converted {os.path.basename(a.input)} to {os.path.basename(a.output)}")
    print(f"  {r['total_tiles']:>12,} tiles in {took:.1f} s ({r['total_tiles'] / took:,.0f} tiles/s)")
    if a.verbose:
        print(f"  Unique tiles: {r['unique_tiles']:,} ({100 * r['dedup_ratio']:.1f} % dedup)\n  Output size:  {human_bytes(r['bytes_written'])}\n  Dedup saved:  {human_bytes(r['bytes_saved_dedup'])}")
    return 0
