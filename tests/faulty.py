"""A port that marks in a text make fail, and that notes each call in a folder, whatever process calls it."""

import os
import uuid


class Refused(Exception):
    def __init__(self, kind, retry_after_ms=None):
        self.kind, self.retry_after_ms = kind, retry_after_ms


class FaultyPort:
    """[[401]] is refused for good, [[429]] and [[500]] twice, [[EMPTY]] comes back empty, [[ABORT]] is cancelled, [[BUG]]
    is a fault of the program, [[DIE]] takes the worker down the first time, [[SLOW]] takes a while."""

    def __init__(self, folder):
        self.folder = folder

    def calls(self, source=None):
        seen = []
        for name in os.listdir(self.folder):
            with open(f"{self.folder}/{name}") as f:
                seen.append(f.read())
        return len(seen) if source is None else seen.count(source)

    def translate(self, source):
        n = self.calls(source)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(source)
        if "[[401]]" in source:
            raise Refused("auth")
        if "[[429]]" in source and n < 2:
            raise Refused("rate-limit", 5.0)
        if "[[500]]" in source and n < 2:
            raise Refused("server")
        if "[[EMPTY]]" in source:
            raise Refused("empty")
        if "[[ABORT]]" in source:
            raise Refused("aborted")
        if "[[LOST]]" in source:
            raise ConnectionError("reset")
        if "[[BUG]]" in source:
            raise ValueError("a fault of the program")
        if "[[DIE]]" in source and n == 0:
            os._exit(1)
        if "[[SLOW]]" in source:
            import time

            time.sleep(60)
        return "译" * max(1, len(source) // 2)
