"""Leases: one holder at a time, over processes; expiry; loss."""

from __future__ import annotations

import subprocess
import sys
import time
from pathlib import Path

import pytest

from factloom.sources.leases import Busy, Lease, local_path

ROOT = str(Path(__file__).resolve().parents[1])
CONTENDER = """
import sys, time
sys.path.insert(0, {root!r})
from factloom.sources.leases import Busy, Lease
lease = Lease({folder!r}, holds=float(sys.argv[1]))
while time.time() < float(sys.argv[2]):
    pass
try:
    lease.acquire()
    print("held", flush=True)
    time.sleep(float(sys.argv[3]))
    if sys.argv[4] == "release":
        lease.release()
except Busy:
    print("busy", flush=True)
"""


def contend(folder, count, holds, keep, end="release"):
    at = str(time.time() + 1)
    code = CONTENDER.format(root=ROOT, folder=str(folder))
    started = [subprocess.Popen([sys.executable, "-c", code, str(holds), at, str(keep), end], stdout=subprocess.PIPE, text=True) for _ in range(count)]
    return sorted(p.communicate(timeout=60)[0].strip() for p in started)


def test_one_of_several_processes_holds_it(tmp_path):
    assert contend(tmp_path, 6, 60, 2) == ["busy"] * 5 + ["held"]
    with Lease(str(tmp_path)):
        assert contend(tmp_path, 1, 60, 0) == ["busy"]
    assert contend(tmp_path, 1, 60, 0) == ["held"]


def test_an_expired_lease_is_taken_over_once(tmp_path):
    dead = Lease(str(tmp_path), holds=0.2)
    dead.acquire()
    time.sleep(0.3)
    assert contend(tmp_path, 6, 60, 2, "stay").count("held") == 1
    with pytest.raises(Busy):
        dead.renew()
    dead.release()  # not its own any more
    with pytest.raises(Busy):
        Lease(str(tmp_path)).acquire()


def test_renewal(tmp_path):
    with Lease(str(tmp_path), holds=0.5) as lease:
        for _ in range(4):
            time.sleep(0.2)
            lease.renew()
        with pytest.raises(Busy):
            Lease(str(tmp_path)).acquire()
    assert local_path("file:///a/b") == "/a/b" and local_path("/a") == "/a" and local_path("hdfs://x/a") is None
