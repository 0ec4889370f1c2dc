"""Finished files take their places: all of a job's outputs or none.

Outputs are written beside their targets first. ``place`` then swaps them in:

1. A target that is an input of the job stops everything before a file is touched.
2. A journal with all moves goes into every output folder.
3. What stands at a target is set aside under a hidden name, the finished file
   takes its place, and chunks that an earlier run left behind are set aside too.
4. The ledger of the folder is renewed, the journals go (from here on the
   job counts as done), then the files set aside.

If a step fails, the moves made are undone. If the driver dies between 2 and 4, the
next job that writes to the folder finds the journal and undoes them first.

The ledger (``.ferry-ledger``, a JSON line per chunk file) says which files of the
folder are chunks that a job wrote, of which input, with length and time. A longer
earlier run's chunks are removed only if the ledger names them and they are still
the files it describes; no other file is ever removed.
"""

from __future__ import annotations

import json
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from ferry.sinks.fs import HadoopFS

# a job's per-file queries place their outputs one after the other: a journal found
# in a folder is then always one that nobody works on (one job a folder at a time)
_PLACING = threading.Lock()
LEDGER = ".ferry-ledger"
JOURNAL = ".ferry-journal-"
ASIDE = ".ferry-old-"


class OutputError(ValueError):
    pass


def _split(path: str) -> tuple[str, str]:
    folder, _, name = path.rpartition("/")
    return folder or ".", name


def _each(fn, items: list, threads: int = 16) -> None:
    if len(items) < 2:
        for item in items:
            fn(item)
        return
    with ThreadPoolExecutor(max_workers=min(threads, len(items))) as pool:
        list(pool.map(fn, items))


def guard(fs: HadoopFS, inputs: list[str], targets: list[str]) -> None:
    """Refuse any output that would overwrite an input, or another output."""
    taken = {fs.qualify(p) for p in inputs}
    hit = sorted(t for t in targets if fs.qualify(t) in taken)
    if hit:
        raise OutputError(f"{hit[0]} is an input of this job and cannot be its output")
    if len(set(targets)) != len(targets):
        raise OutputError("several outputs would get the same name")


def read_ledger(fs: HadoopFS, folder: str) -> dict[str, dict]:
    """name -> its line, of the chunk files that jobs wrote to ``folder``."""
    path = f"{folder}/{LEDGER}"
    if not fs.exists(path):
        return {}
    lines = [json.loads(line) for line in fs.read_text(path).splitlines() if line]
    return {entry["name"]: entry for entry in lines}


def recover(fs: HadoopFS, folder: str) -> None:
    """Undo what a job that died while it placed its outputs has left in ``folder``."""
    if not fs.exists(folder):
        return
    names = [_split(f.path)[1] for f in fs.list(folder)]
    for name in sorted(n for n in names if n.startswith(JOURNAL)):
        path = f"{folder}/{name}"
        _undo(fs, json.loads(fs.read_text(path)))
        fs.delete(path, recursive=False)
    for name in names:
        # set aside by a job that was done, or by one that is undone by now
        if name.startswith(ASIDE) and fs.exists(f"{folder}/{name}"):
            fs.delete(f"{folder}/{name}", recursive=False)


def _undo(fs: HadoopFS, moves: list[dict]) -> None:
    def one(move):
        if move["aside"] is None:
            # nothing stood there: what does now is ours, once it has left its staging place
            if fs.exists(move["target"]) and not fs.exists(move["ready"]):
                fs.delete(move["target"], recursive=False)
        elif fs.exists(move["aside"]):
            if fs.exists(move["target"]):
                fs.delete(move["target"], recursive=False)
            fs.rename(move["aside"], move["target"])
    _each(one, moves)


def place(fs: HadoopFS, swaps: list[tuple[str, str]], inputs: list[str] = (),
          chunks: dict[str, tuple[str, int]] | None = None, sources: list[str] = (),
          also: list[str] = ()) -> None:
    """Move each finished file to its target: ``swaps`` of (finished file, target).

    ``chunks``: (source, number) of targets that are chunks; ``sources``: the inputs
    whose earlier chunks beyond these are stale, looked for in the folders ``also``, too.
    """
    guard(fs, inputs, [t for _, t in swaps])
    with _PLACING:
        _place(fs, swaps, inputs, chunks, sources, also)


def _place(fs, swaps, inputs, chunks, sources, also) -> None:
    run = uuid.uuid4().hex[:12]
    chunked = chunks is not None
    folders = sorted({_split(t)[0] for _, t in swaps} | set(also))
    ledgers, moves = {}, {f: [] for f in folders}
    for folder in folders:
        fs.mkdirs(folder)
        recover(fs, folder)
        ledgers[folder] = read_ledger(fs, folder) if chunked else {}
    standing = {f: {_split(x.path)[1]: x for x in fs.list(f)} for f in folders}
    targets = set()
    for ready, target in swaps:
        folder, name = _split(target)
        targets.add((folder, name))
        if name in standing[folder] and standing[folder][name].is_dir:
            raise OutputError(f"{target} is a folder and cannot be replaced by an output")
        aside = f"{folder}/{ASIDE}{run}-{name}" if name in standing[folder] else None
        moves[folder].append({"ready": ready, "target": target, "aside": aside})
    of = {fs.qualify(s) for s in sources}
    protected = {fs.qualify(p) for p in inputs}
    for folder in folders:
        for name, entry in list(ledgers[folder].items()):
            now = standing[folder].get(name)
            if (folder, name) in targets or entry["source"] not in of:
                continue
            if now and (now.length, now.modified) == (entry["length"], entry["modified"]) \
                    and fs.qualify(now.path) not in protected:
                moves[folder].append({"ready": None, "target": f"{folder}/{name}", "aside": f"{folder}/{ASIDE}{run}-{name}"})
            del ledgers[folder][name]
    every = [m for f in folders for m in moves[f]]
    journals = []

    def swap(move):
        if move["aside"]:
            fs.rename(move["target"], move["aside"])
        if move["ready"]:
            fs.rename(move["ready"], move["target"])

    try:
        for folder in folders:
            journal = f"{folder}/{JOURNAL}{run}"
            fs.write_text(journal, json.dumps(moves[folder]))
            journals.append(journal)
        _each(swap, every)
        if chunked:
            _renew_ledgers(fs, folders, ledgers, chunks)
    except BaseException:
        _undo(fs, every)
        for journal in journals:
            fs.delete(journal, recursive=False)
        raise
    for journal in journals:
        fs.delete(journal, recursive=False)
    _each(lambda m: fs.delete(m["aside"], recursive=False), [m for m in every if m["aside"]])


def _renew_ledgers(fs: HadoopFS, folders: list[str], ledgers: dict, chunks: dict[str, tuple[str, int]]) -> None:
    mine: dict[str, dict[str, tuple]] = {f: {} for f in folders}
    for target, own in chunks.items():
        folder, name = _split(target)
        mine[folder][name] = own
    for folder in folders:
        for f in fs.list(folder):
            name = _split(f.path)[1]
            if name in mine[folder]:
                source, number = mine[folder][name]
                ledgers[folder][name] = {"name": name, "source": fs.qualify(source), "chunk": number,
                                         "length": f.length, "modified": f.modified}
        lines = [json.dumps(ledgers[folder][n]) for n in sorted(ledgers[folder])]
        fresh = f"{folder}/{LEDGER}.new"
        fs.write_text(fresh, "\n".join(lines) + "\n")
        if fs.exists(f"{folder}/{LEDGER}"):
            fs.delete(f"{folder}/{LEDGER}", recursive=False)
        fs.rename(fresh, f"{folder}/{LEDGER}")
