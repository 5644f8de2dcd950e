"""Texts of reports on the driver."""

from __future__ import annotations

from tessera.sources.xml import SPACES

WIDTH = 80


def words(line: str) -> list[str]:
    """A line's words between Unicode's white space."""
    for c in SPACES:
        line = line.replace(c, " ")
    return [w for w in line.split(" ") if w]


def wrap(text: str, width: int = WIDTH, indent: str = "") -> str:
    """Each line folded to `width` characters, the indent counted; words stay whole and blank lines stay blank."""
    out = []
    for line in text.split("\n"):
        rows: list[str] = []
        for w in words(line):
            if rows and len(rows[-1]) + 1 + len(w) <= width:
                rows[-1] += f" {w}"
            else:
                rows.append(indent + w)
        out += rows or [""]
    return "\n".join(out)


def paragraph(text: str) -> str:
    return f"{wrap(text)}\n\n"


def clock(seconds: float) -> str:
    """mm:ss, or h:mm:ss from an hour on; what isn't a time is ??:??."""
    if not 0 <= seconds < float("inf"):
        return "??:??"
    s = int(seconds)
    return (f"{s // 3600}:" if s >= 3600 else "") + f"{s // 60 % 60:02d}:{s % 60:02d}"


class Progress:
    """A line of progress on a terminal: what is done, and how long the rest may take."""

    def __init__(self, title: str, total: int, stream=None, now=None):
        import sys
        import time

        self.title, self.total, self.done = title, total, 0
        self.stream, self.now = stream or sys.stderr, now or time.monotonic
        self.begun = self.now()

    def line(self) -> str:
        taken = self.now() - self.begun
        rest = taken / self.done * (self.total - self.done) if self.done else float("inf")
        return f"{self.title}: {self.done}/{self.total}, {clock(taken)} so far, {clock(rest)} left"

    def tick(self) -> None:
        self.done += 1
        if self.stream.isatty():
            self.stream.write("\r" + self.line() + ("\n" if self.done == self.total else ""))
            self.stream.flush()
