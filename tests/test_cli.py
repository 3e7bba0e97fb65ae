import os
import subprocess
import time

import pytest
from test_store_and_ingest import CPP, PY

from trailhead.__main__ import main
from trailhead.operators.store import Store
from trailhead.plans import sync
from trailhead.sources import git


def test_a_repository_from_init_to_trace(spark, tmp_path, capsys):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.py").write_bytes(PY)
    (repo / "c.cpp").write_bytes(CPP)
    assert main(["--repo", str(repo), "init", "--no-hook"]) == 0 and main(["--repo", str(repo), "init", "--no-hook"]) == 0
    assert (repo / ".gitignore").read_text() == ".trailhead/\n"
    assert git.head(str(repo)) == "LIVE"
    run("add", "-A"), run("commit", "-qm", "first")
    assert main(["--repo", str(repo), "sync"]) == 0
    assert "files_processed=2" in capsys.readouterr().out
    st = Store(spark, f"file://{repo}/.trailhead")
    assert st.read("history").count() == 5 and st.read("annotations").first().path == "a.py"
    assert main(["--repo", str(repo), "ask", "How does the auth payload move through the system?"]) == 0
    said = capsys.readouterr().out
    assert "def payload_move" in said
    trace = said.strip().splitlines()[-1].removeprefix("trace ")
    assert main(["--repo", str(repo), "trace", trace]) == 0 and "def payload_move" in capsys.readouterr().out
    assert main(["--repo", str(repo), "trace", "none"]) == 1
    assert main(["--repo", str(repo), "ask", "zzzz"]) == 1
    (repo / "c.cpp").unlink()
    (repo / "n.py").write_text("def fresh(x):\n    return x + 1\n")
    run("add", "-A")
    assert git.staged(str(repo)) == (["n.py"], ["c.cpp"])
    assert main(["--repo", str(repo), "commit"]) == 0
    assert {r.file_path for r in st.read("nodes").where("is_active").collect()} == {"a.py", "n.py"}
    old = sync.as_of(st.read("history"), 2**40).count()
    assert old == 5 and sync.as_of(st.read("history"), 0).isEmpty()


def test_the_hook_returns_at_once_and_its_queue_is_taken(spark, tmp_path, capsys):
    repo = tmp_path / "r"
    repo.mkdir()
    env = os.environ | {"TRAILHEAD_HOLD": "1"}
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, env=env)
    run("init", "-q")
    assert main(["--repo", str(repo), "init"]) == 0 and main(["--repo", str(repo), "init"]) == 0
    assert "hook at" in capsys.readouterr().out
    (repo / "a b.py").write_bytes(PY)
    (repo / "c.cpp").write_bytes(CPP)
    (repo / "notes.txt").write_text("x")
    run("add", "-A")
    t = time.time()
    run("commit", "-qm", "first")
    assert time.time() - t < 2
    (repo / "c.cpp").unlink()
    run("add", "-A")
    run("commit", "-qm", "second")
    assert main(["--repo", str(repo), "commit", "--staged"]) == 0
    assert os.listdir(repo / ".trailhead" / "queue") == ["taken"]
    st = Store(spark, f"file://{repo}/.trailhead")
    assert st.version() == 2 and {r.file_path for r in st.read("nodes").where("is_active").collect()} == {"a b.py"}
    other = tmp_path / "o"
    other.mkdir()
    subprocess.run(["git", "-C", str(other), "init", "-q"], check=True)
    (other / ".git" / "hooks").mkdir(exist_ok=True)
    (other / ".git" / "hooks" / "pre-commit").write_text("#!/bin/sh\nexit 0\n")
    assert main(["--repo", str(other), "init"]) == 0 and "stays" in capsys.readouterr().out
    assert (other / ".git" / "hooks" / "pre-commit").read_text() == "#!/bin/sh\nexit 0\n"


def test_the_queue_is_taken_exactly_once(spark, tmp_path):
    """Killed after the second entry's version and before the stream commits; what comes later is taken too."""
    from trailhead.plans import sync
    from trailhead.sources import queue

    repo, folder = tmp_path / "r", tmp_path / "r" / "q"
    folder.mkdir(parents=True)
    (repo / "a.py").write_bytes(PY)
    (repo / "c.cpp").write_bytes(CPP)

    def entry(name, changed, deleted):
        (folder / f"{name}.changed").write_text("".join(f"{p}\0" for p in changed))
        (folder / f"{name}.deleted").write_text("".join(f"{p}\0" for p in deleted))
        (folder / f"{name}.ready").write_text(f"commit-{name}\n")

    st = Store(spark, f"file://{tmp_path}/store")
    drain = lambda after=lambda e: None: sync.drain(spark, str(repo), st, str(folder), f"file://{tmp_path}/check", after)
    assert drain() == 0 and st.version() == 0
    entry("1-1", ["a.py"], [])
    entry("2-1", ["c.cpp", "notes.txt"], [])

    def killed(name):
        if name == "2-1":
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        drain(killed)
    assert st.version() == 2 and queue.entries(str(folder)) == ["1-1", "2-1"]
    (repo / "a.py").unlink()
    entry("3-1", [], ["a.py"])
    assert drain() >= 1 and queue.entries(str(folder)) in ([], ["3-1"])
    drain()
    assert queue.entries(str(folder)) == [] and queue.taken(str(folder)) == "3-1"
    assert st.version() == 3 and {r.file_path for r in st.read("nodes").where("is_active").collect()} == {"c.cpp"}
    assert drain() == 0 and st.version() == 3


def test_interrupt_and_idle_stop(spark):
    import threading

    from trailhead import session

    slow = lambda x: (time.sleep(20), x)[1]
    said = []

    def ask():
        try:
            with session.tagged(spark, "question"):
                spark.sparkContext.parallelize(range(4), 4).map(slow).count()
        except Exception as e:
            said.append(str(e))

    t = threading.Thread(target=ask)
    idle = session.IdleStop(spark, after=0.5, poll=0.1, stop=lambda: said.append("stopped"))
    t.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.05)
    idle.start()
    time.sleep(1)
    assert said == []  # a job runs
    session.interrupt(spark, "question")
    t.join(15)
    idle.join(15)
    assert len(said) == 2 and "cancel" in said[0].lower() and said[1] == "stopped"
    assert spark.range(3).count() == 3
