"""Typing sessions as state machines: committed words, corrections that were taken back, and the ledger of expected edits."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The ledger holds so many edits, each for so many observations.
CAPACITY, EXPIRES = 32, 3
_LAST = re.compile(r"(\S*)$")


def current_word(text: str) -> str:
    return _LAST.search(text)[1]


@dataclass
class Ledger:
    """Edits that an app made itself and will see again as text: first in, first out, each for EXPIRES observations."""

    waiting: list[list] = field(default_factory=list)  # text after the edit, observations left

    def expect(self, text: str) -> None:
        self.waiting = [*self.waiting, [text, EXPIRES]][-CAPACITY:]

    def observe(self, text: str) -> bool:
        """Whether a text is one that was expected; it and those before it are done with."""
        for i, (expected, _) in enumerate(self.waiting):
            if expected == text:
                self.waiting = self.waiting[i + 1 :]
                return True
        self.waiting = [[t, n - 1] for t, n in self.waiting if n > 1]
        return False


@dataclass
class Typist:
    """What a session has come to: its text, and the words that were committed. observe() gives events (code, word, before)."""

    text: str = ""
    words: list[str] = field(default_factory=list)

    def observe(self, text: str) -> list[tuple[str, str, str | None]]:
        events: list[tuple[str, str, str | None]] = []
        if text == self.text:
            return events
        if text.startswith(self.text):
            kind = "grown"
        elif self.text.startswith(text):
            kind = "erased"
        else:
            kind = "replaced"
        old, new = self.text.split(), text.split()
        if kind == "grown":
            done = len(old) - (1 if old and not self.text[-1:].isspace() else 0)
            ready = len(new) - (1 if new and not text[-1:].isspace() else 0)
            for i in range(done, ready):
                events.append(("wc", new[i], new[i - 1] if i else None))
                self.words = [*self.words, new[i]][-8:]
        elif kind == "replaced" and old and new and len(old) == len(new) and old[:-1] == new[:-1]:
            events.append(("cr", new[-1], old[-1]))  # the last word became another one
        elif not new:
            self.words = []
        self.text = text
        return events


def replay(texts: Iterable[str]) -> list[tuple[int, str, str, str | None]]:
    """(place, code, word, before) of a whole session."""
    typist, out = Typist(), []
    for i, text in enumerate(texts):
        out += [(i, *event) for event in typist.observe(text or "")]
    return out


OUT = "sid string, t double, code string, word string, before string"


def _rows(sid: str, t: list[float], found: list[tuple[int, str, str, str | None]]) -> pd.DataFrame:
    return pd.DataFrame([(sid, t[i], code, word, before) for i, code, word, before in found], columns=["sid", "t", "code", "word", "before"])


def commits(snapshots: DataFrame) -> DataFrame:
    """sid, t, code (wc committed, cr corrected), word, before, of whole sessions (sid, t, text)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t", kind="stable")
        return _rows(key[0], rows["t"].tolist(), replay(rows["text"].tolist()))

    return snapshots.select("sid", "t", "text").groupBy("sid").applyInPandas(run, OUT)


def commits_stream(snapshots: DataFrame) -> DataFrame:
    """The same of a stream whose batches bring each session's snapshots in order; state is a session's text and last words."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, words = state.get if state.exists else ("", [])
        typist = Typist(text, list(words))
        rows = pd.concat(list(parts)).sort_values("t", kind="stable")
        found = [(i, *event) for i, seen in enumerate(rows["text"].tolist()) for event in typist.observe(seen or "")]
        state.update((typist.text, typist.words))
        yield _rows(key[0], rows["t"].tolist(), found)

    return snapshots.select("sid", "t", "text").groupBy("sid").applyInPandasWithState(step, OUT, "text string, words array<string>", "append", GroupStateTimeout.NoTimeout)
