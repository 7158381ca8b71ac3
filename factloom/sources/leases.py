"""One run at a time over all drivers: a lease file in a folder that they share, made atomically, that expires."""

from __future__ import annotations

import json
import os
import time
from dataclasses import dataclass, field
from urllib.parse import urlparse
from uuid import uuid4

#: Seconds that a lease holds after it was last renewed.
HOLDS = 3600.0


class Busy(RuntimeError):
    """Another holder's lease has not expired."""


def local_path(folder: str) -> str | None:
    """The folder as a path of the (shared) file system, if it is one."""
    address = urlparse(folder)
    return address.path if address.scheme in ("", "file") else None


@dataclass
class Lease:
    """A lease on ``folder``; ``with Lease(folder):`` holds it, ``renew`` prolongs it.

    The file is made by linking a complete one to its name, which fails if the name is there.  An expired lease is
    taken over by the one contender that makes the file named after it, so that two can't both replace it.
    """

    folder: str
    holds: float = HOLDS
    token: str = field(default_factory=lambda: uuid4().hex)

    @property
    def path(self) -> str:
        return os.path.join(self.folder, "lease.json")

    def _write(self) -> str:
        os.makedirs(self.folder, exist_ok=True)
        own = f"{self.path}.{self.token}.{uuid4().hex}"
        with open(own, "w") as out:
            json.dump({"token": self.token, "until": time.time() + self.holds}, out)
        return own

    def _read(self) -> dict | None:
        try:
            with open(self.path) as file:
                return json.load(file)
        except FileNotFoundError:
            return None

    def acquire(self) -> None:
        own = self._write()
        try:
            while True:
                try:
                    os.link(own, self.path)
                    return
                except FileExistsError:
                    held = self._read()
                if held is None:
                    continue
                if held["until"] > time.time():
                    raise Busy("a run is going on")
                try:
                    os.close(os.open(f"{self.path}.after-{held['token']}", os.O_CREAT | os.O_EXCL))
                except FileExistsError:
                    raise Busy("a run is going on") from None
                os.replace(own, self.path)
                return
        finally:
            if os.path.exists(own):
                os.remove(own)

    def renew(self) -> None:
        """Hold the lease for longer; ``Busy`` if it expired and another holder took it over."""
        held = self._read()
        if held is None or held["token"] != self.token:
            raise Busy("the lease was lost")
        os.replace(self._write(), self.path)

    def release(self) -> None:
        held = self._read()
        if held is not None and held["token"] == self.token:
            os.remove(self.path)

    def __enter__(self) -> Lease:
        self.acquire()
        return self

    def __exit__(self, *_) -> None:
        self.release()
