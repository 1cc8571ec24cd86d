"""Committing plans to the file system: dry by default, journalled, safe to run twice.

A plan is a table of actions. It is applied on the driver, in the order of its rows, streamed to it part by part; a
retried task can therefore never move a file twice. What was done already, as the journal or the file system shows, is
left as it is.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame


class Unsafe(RuntimeError):
    """A change that would leave its device or touch what is protected."""


def protected(path: str, roots: Iterable[str], staging: str | None = None) -> bool:
    """Whether a path lies in a protected tree; its staging folder does not count."""
    here = os.path.abspath(path)
    for root in map(os.path.abspath, roots):
        inside = here == root or here.startswith(root + os.sep)
        if inside and not (staging and (here + os.sep).startswith(os.path.join(root, staging) + os.sep)):
            return True
    return False


def device_of(path: str) -> int:
    """The device of a path, or of the nearest folder above it that exists."""
    while not os.path.exists(path):
        path = os.path.dirname(path) or "/"
    return os.stat(path).st_dev


def move_one(src: str, dst: str, dry_run: bool) -> str:
    """Move a file or folder: moved, would move, done already, missing, dest exists, cross-device."""
    if not os.path.exists(src):
        return "done already" if os.path.exists(dst) else "missing"
    if os.path.exists(dst):
        return "dest exists"
    if device_of(src) != device_of(dst):
        return "cross-device"
    if dry_run:
        return "would move"
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    shutil.move(src, dst)
    return "moved"


def apply_moves(plan: DataFrame, base: str, manifest: str | None = None, dry_run: bool = True, prune: bool = True) -> dict[str, int]:
    """Apply rows (src, dst, issue) below a folder; those with an issue or without a destination are left alone.

    Each move is written to the manifest as soon as it is made. Folders that it emptied are removed, never the base.
    Gives the number of rows by outcome.
    """
    counts: dict[str, int] = {}
    journal = open(manifest, "a", encoding="utf-8") if manifest and not dry_run else None
    try:
        for row in plan.where("issue is null and dst is not null").orderBy("src").select("src", "dst").toLocalIterator():
            src, dst = os.path.join(base, row["src"]), os.path.join(base, row["dst"])
            outcome = move_one(src, dst, dry_run)
            counts[outcome] = counts.get(outcome, 0) + 1
            if outcome == "moved":
                if journal:
                    journal.write(f"{src}\t{dst}\t{datetime.now().isoformat(timespec='seconds')}\n")
                    journal.flush()
                if prune:
                    prune_up(os.path.dirname(src), base)
    finally:
        if journal:
            journal.close()
    return counts


def prune_up(folder: str, base: str) -> int:
    """Remove a folder and those above it as long as they are empty and below the base; how many were removed."""
    gone, base = 0, os.path.abspath(base)
    folder = os.path.abspath(folder)
    while folder.startswith(base + os.sep) and os.path.isdir(folder) and not os.listdir(folder):
        os.rmdir(folder)
        gone, folder = gone + 1, os.path.dirname(folder)
    return gone


def revert_moves(manifest: str, dry_run: bool = True) -> dict[str, int]:
    """Undo the moves of a manifest, the last first, journalled beside it."""
    with open(manifest, encoding="utf-8") as file:
        lines = [ln.rstrip("\n").split("\t") for ln in file if ln.strip() and not ln.startswith("#")]
    counts: dict[str, int] = {}
    for src, dst, *_ in reversed(lines):
        outcome = "missing" if not os.path.exists(dst) else "src exists" if os.path.exists(src) else move_one(dst, src, dry_run)
        counts[outcome] = counts.get(outcome, 0) + 1
        if outcome == "moved":
            with open(f"{manifest}.revert.tsv", "a", encoding="utf-8") as journal:
                journal.write(f"{dst}\t{src}\t{datetime.now().isoformat(timespec='seconds')}\n")
    return counts


def apply_actions(plan: DataFrame, act: Callable[[dict], str], order: list[str], dry_run: bool = True, guard: Callable[[dict], bool] | None = None) -> dict[str, int]:
    """Apply any plan row by row with a function that gives an outcome; rows that the guard refuses raise Unsafe first.

    For tag writers, sidecars and the like, which bring their own way of changing a file.
    """
    counts: dict[str, int] = {}
    for row in plan.orderBy(*order).toLocalIterator():
        action = row.asDict(recursive=True)
        if guard and not guard(action):
            raise Unsafe(str(action))
        outcome = "would change" if dry_run else act(action)
        counts[outcome] = counts.get(outcome, 0) + 1
    return counts


def write_sidecar(path: str, text: str) -> str:
    """Write a text beside a file, whole or not at all; an existing one stays."""
    if os.path.exists(path):
        return "exists"
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as file:
        file.write(text)
        file.flush()
        os.fsync(file.fileno())
    os.replace(part, path)
    return "written"


def virtual_listing(listing: DataFrame, plan: DataFrame) -> DataFrame:
    """What a listing (path) would be after a plan of moves (src, dst): less what is removed, with what is created."""
    moves = plan.where("dst is not null").select("src", "dst")
    stays = listing.join(moves.select("src"), listing["path"] == moves["src"], "left_anti").select("path")
    return stays.unionByName(moves.join(listing, moves["src"] == listing["path"], "left_semi").selectExpr("dst as path")).distinct()
