"""``python -m trailhead init|sync|commit|ask|trace`` in a repository's folder."""

from __future__ import annotations

import argparse
import os
import shlex
import subprocess
import sys
import time

STORE = ".trailhead"


MARK = "# trailhead: begins an update of the store and returns"
#: Attempts, and seconds between them, of an update that meets another writer.
TRIES, WAIT = 120, 5


def hook_text(python: str, package: str) -> str:
    """A pre-commit hook that writes down the staged paths (git alone, no interpreter) and starts the update in a
    session of its own, whose output goes to the store's log.  TRAILHEAD_HOLD in the environment: only written down."""
    return f"""#!/bin/sh
{MARK}
top=$(git rev-parse --show-toplevel) || exit 0
queue="$top/{STORE}/queue"
mkdir -p "$queue" || exit 0
entry="$queue/$(date +%s%N)-$$"
git rev-parse -q --verify HEAD >"$entry.head" || echo LIVE >"$entry.head"
git diff --cached --name-only -z --diff-filter=ACMR >"$entry.changed"
git diff --cached --name-only -z --diff-filter=D >"$entry.deleted"
mv "$entry.head" "$entry.ready"
[ -n "$TRAILHEAD_HOLD" ] && exit 0
PYTHONPATH={shlex.quote(package)}${{PYTHONPATH:+:$PYTHONPATH}} nohup setsid env -u GIT_DIR -u GIT_INDEX_FILE {shlex.quote(python)} -m trailhead --repo "$top" commit --staged >>"$top/{STORE}/index.log" 2>&1 </dev/null &
exit 0
"""


def install_hook(repo: str) -> str:
    """Write the hook into the repository's hook folder; a hook of somebody else stays.  Returns what was done."""
    found = subprocess.run(["git", "-C", repo, "rev-parse", "--git-path", "hooks"], capture_output=True, text=True)
    if found.returncode:
        return "no git repository, no hook"
    path = os.path.join(repo, found.stdout.strip(), "pre-commit")
    if os.path.exists(path) and MARK not in open(path, errors="replace").read():
        return f"{path} is not ours and stays"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(hook_text(sys.executable, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    os.chmod(path, 0o755)
    return f"hook at {path}"


def take(spark, repo: str, st) -> int:
    """Apply the hook's queue in order, exactly once; returns how many entries."""
    from .operators.store import Conflict
    from .plans import sync

    folder = os.path.join(repo, STORE, "queue")
    os.makedirs(folder, exist_ok=True)
    for left in reversed(range(TRIES)):
        try:
            return sync.drain(spark, repo, st, folder, f"file://{repo}/{STORE}/queue-checkpoint")
        except Exception as e:
            if not left or Conflict.__name__ not in str(e):
                raise
            time.sleep(WAIT)
    return 0


def init(repo: str) -> None:
    """Make the store's folder and keep it out of git."""
    os.makedirs(os.path.join(repo, STORE), exist_ok=True)
    path = os.path.join(repo, ".gitignore")
    have = open(path).read().splitlines() if os.path.exists(path) else []
    if f"{STORE}/" not in have:
        with open(path, "a") as f:
            f.write(f"{STORE}/\n")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="trailhead")
    p.add_argument("--repo", default=".")
    p.add_argument("--master", default=None)
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("init").add_argument("--no-hook", action="store_true")
    verbs.add_parser("sync")
    verbs.add_parser("commit").add_argument("--staged", action="store_true", help="take what the hook has written down, in order")
    verbs.add_parser("ask").add_argument("question")
    verbs.add_parser("trace").add_argument("trace_id")
    a = p.parse_args(argv)
    repo = os.path.abspath(a.repo)
    init(repo)
    if a.verb == "init":
        if not a.no_hook:
            print(install_hook(repo))
        return 0
    from pyspark.sql import functions as F

    from . import session
    from .operators.store import Store
    from .plans import retrieve, sync
    from .sources import files, git

    spark = session.session(master=a.master)
    st = Store(spark, f"file://{repo}/{STORE}")
    if a.verb == "sync":
        row = sync.full(spark, repo, st).first()
        if os.path.isdir(os.path.join(repo, ".git")):
            sync.history(spark, repo, st)
        print(" ".join(f"{k}={v}" for k, v in row.asDict().items()))
        return 0
    if a.verb == "commit" and a.staged:
        take(spark, repo, st)
        return 0
    if a.verb == "commit":
        changed, deleted = git.staged(repo)
        if changed or deleted:
            sync.increment(spark, repo, st, git.head(repo), changed, deleted)
        return 0
    now = files.scan(spark, repo)
    if a.verb == "trace":
        nodes, edges = retrieve.replay(st.read("traces"), a.trace_id, st.read("nodes"), st.read("edges"))
        if st.read("traces").where(F.col("trace_id") == a.trace_id).isEmpty():
            print("no such trace", file=sys.stderr)
            return 1
        print(retrieve.render(retrieve.snippets(nodes, now), edges).first().text)
        return 0
    tables = {t: st.read(t) for t in ("nodes", "edges", "alias", "vectors", "traces")}
    built = retrieve.build(tables, now, a.question, version=st.version())
    if not built.ok:
        print(built.reason)
        return 1
    st.upsert({"traces": built.traces.where(F.col("trace_id") == built.trace_id)})
    print(retrieve.render(retrieve.snippets(built.nodes, now), built.edges).first().text)
    print(f"trace {built.trace_id}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
