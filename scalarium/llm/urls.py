"""URL filters by a bit-parallel wildcard automaton.

A URL's canonical form is a dot, its host and its path, in an alphabet that tells the host's bytes from the
path's.  Rules are globs over it: `*` stands for any host bytes before a dot, or for any path bytes at the end.
All globs are packed into one Shift-And automaton of as many 64-bit words as they need: a bit is a position of
a glob, a byte moves all globs of all URLs of a batch one step, and a star is a bit that stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scalarium.llm.text import U64, raw_text

HOST, PATH = 0, 256  # where the two alphabets begin
PARTS = re.compile(rb"://([^/?#]*)([^?#]*)", re.DOTALL)


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]


def parts(url: bytes | None) -> tuple[bytes, bytes]:
    """Host, with A to Z in lower case, and path; both empty without `://`."""
    found = PARTS.search(url or b"")
    return (found[1].lower(), found[2]) if found else (b"", b"")


class Automaton:
    """Shift-And masks of rules: each fits its host and the hosts under it, and paths that begin with its own."""

    def __init__(self, rules: list[Rule]):
        #: The longest come first; of equally long ones that fit, the first given holds.
        self.rules = sorted(rules, key=lambda r: -len(r.host.encode()) - len(r.path.encode()))
        globs = [[HOST + b for b in b"." + r.host.lower().encode()] + [PATH + b for b in r.path.encode()] for r in self.rules]
        bits = sum(len(g) + 1 for g in globs)
        self.words = -(-max(bits, 1) // 64)
        self.step = np.zeros((512, self.words), U64)
        self.stay = np.zeros((512, self.words), U64)
        self.start = np.zeros(self.words, U64)
        self.accept = np.zeros((len(globs), self.words), U64)
        at = 0
        for k, glob in enumerate(globs):
            self._set(self.start, at)
            for b in range(256):  # the leading star
                self._set(self.stay[HOST + b], at)
            for symbol in glob:
                at += 1
                self._set(self.step[symbol], at)
            for b in range(256):  # the trailing star
                self._set(self.stay[PATH + b], at)
            self._set(self.accept[k], at)
            at += 1
        self.final = np.bitwise_or.reduce(self.accept, axis=0) if globs else np.zeros(self.words, U64)

    @staticmethod
    def _set(mask: np.ndarray, bit: int) -> None:
        mask[bit >> 6] |= U64(1 << (bit & 63))

    def fitting(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        """The index of the longest rule that fits each URL, -1 for none."""
        n = len(hosts)
        symbols = [np.frombuffer(b"." + h, np.uint8).astype(np.int16) for h in hosts]
        tails = [np.frombuffer(p, np.uint8).astype(np.int16) + PATH for p in paths]
        size = np.array([len(a) + len(b) for a, b in zip(symbols, tails, strict=True)], np.int64)
        flat = np.concatenate([x for pair in zip(symbols, tails, strict=True) for x in pair]) if n else np.zeros(0, np.int16)
        place = np.cumsum(size) - size
        host_size = np.array([len(x) for x in symbols], np.int64)
        end = np.tile(self.start, (n, 1))
        live = np.argsort(-size, kind="stable")  # those not yet at their end come first
        state = end[live].copy()
        left = size[live]
        t = 0
        while len(live):
            running = int(np.searchsorted(-left, -t, side="left"))  # of size over t
            end[live[running:]] = state[running:]
            live, state, left = live[:running], state[:running], left[:running]
            if not running:
                break
            symbol = flat[place[live] + t]
            moved = state << U64(1)
            if self.words > 1:
                moved[:, 1:] |= state[:, :-1] >> U64(63)
            state = (moved & self.step[symbol]) | (state & self.stay[symbol])
            t += 1
            if t % 16 == 0:  # in the path, nothing changes once no glob is under way
                settled = ((state & ~self.final) == 0).all(axis=1) & (t > host_size[live])
                if settled.any():
                    end[live[settled]] = state[settled]
                    live, state, left = live[~settled], state[~settled], left[~settled]
        best = np.full(n, -1)
        for k in range(len(self.rules) - 1, -1, -1):
            best[(end & self.accept[k]).any(axis=1)] = k
        return best


def judge(pages: DataFrame, rules: list[Rule] = RULES, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (its host and path as one string, null if none fits), verdict.

    The longest rule that fits decides; the method's verdict without one is `otherwise`.  The host is what follows
    the first `://` up to `/`, `?`, `#` or the end, the path what follows up to `?`, `#` or the end; without `://` or
    with a null url both are empty.  One row per row; other columns are left out.  Nothing is shuffled.
    """
    automaton = Automaton(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [r.host + r.path for r in automaton.rules] + [None]
        verdicts = [r.verdict for r in automaton.rules] + [otherwise]
        for batch in batches:
            off, buf = raw_text(batch.column(1))
            data, edges = buf.tobytes(), off.tolist()
            found = [parts(data[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            hosts, paths = [x[0] for x in found], [x[1] for x in found]
            best = automaton.fitting(hosts, paths).tolist()
            text = lambda values: pa.array([v.decode("utf-8", "replace") for v in values], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text(hosts), text(paths), pa.array([names[k] for k in best], pa.string()), pa.array([verdicts[k] for k in best], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
