"""URL rules as globs, all of them simulated at once by a bit-parallel automaton."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 20  # characters of URLs that one step of the simulation holds


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, with paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def host_globs(self) -> tuple[str, str]:
        return self.host, f"*.{self.host}"

    def path_glob(self) -> str:
        return f"{self.path}*"


# The rules of the query, and the globs that decide where none of them fits.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
BLOCKED = (
    "*ads-track*", "ads.*", "*.ads.*", "ad?.*", "*.doubleclick.*", "*/ads/*", "*/adserver/*", "*/track/*", "*/pixel.gif",
    "*casino*", "*viagra*", "*/wp-login.php*", "*/cgi-bin/*", "*.exe",
)


class Automaton:
    """Globs (``*``: any run of characters, ``?``: any one character) packed into 64-bit words.

    Each glob owns a stretch of bits: a start state and one state per character. Reading a character
    shifts all states by one, carries from word to word, keeps those that the character allows and adds
    the states that a ``*`` holds; a glob fits if its last state is on after the last character.
    """

    def __init__(self, globs: Sequence[str]):
        letters = sorted({c for g in globs for c in g if c not in "*?"})
        self.codes = np.array([ord(c) for c in letters], dtype=np.uint32)
        starts, finals, loops = [], [], []
        steps: list[tuple[int, str]] = []
        bit = 0
        for glob in globs:
            starts.append(bit)
            for c in glob:
                if c == "*":
                    loops.append(bit)
                else:
                    bit += 1
                    steps.append((bit, c))
            finals.append(bit)
            bit += 1
        self.words = bit // 64 + 1
        self.finals = finals
        self.start, self.loop = self._mask(starts), self._mask(loops)
        anything = self._mask([b for b, c in steps if c == "?"])
        self.allowed = np.stack(
            [self._mask([b for b, c in steps if c == letter]) | anything for letter in letters] + [anything]
        )

    def _mask(self, bits: list[int]) -> np.ndarray:
        mask = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            mask[b // 64] |= np.uint64(1) << np.uint64(b % 64)
        return mask

    def _letters(self, texts: list[str], width: int) -> np.ndarray:
        """Index of each character in the alphabet (the last index: none of it), one row per text."""
        points = np.array(texts, dtype=f"<U{max(1, width)}").view(np.uint32).reshape(len(texts), -1)
        if not len(self.codes):
            return np.zeros(points.shape, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, points), len(self.codes) - 1)
        return np.where(self.codes[at] == points, at, len(self.codes))

    def fits(self, texts: list[str]) -> np.ndarray:
        """For each text (rows) whether each glob (columns) fits the whole of it."""
        found = np.zeros((len(texts), len(self.finals)), dtype=bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(texts[order[end]]) <= CELLS:
                end += 1
            rows = order[at:end]
            found[rows] = self._run([texts[i] for i in rows])
            at = end
        return found

    def _run(self, texts: list[str]) -> np.ndarray:
        lengths = np.array([len(t) for t in texts])
        letters = self._letters(texts, int(lengths.max()))
        state = np.tile(self.start, (len(texts), 1))
        for k in range(int(lengths.max())):
            live = slice(int(np.searchsorted(lengths, k, side="right")), None)  # texts come by length
            now = state[live]
            shifted = now << np.uint64(1)
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[live] = (shifted & self.allowed[letters[live, k]]) | (now & self.loop)
        bits = np.array(self.finals, dtype=np.int64)
        return (state[:, bits // 64] >> (bits % 64).astype(np.uint64)) & np.uint64(1) == 1


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or URL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``.

    A rule fits by its host on the host and by its path on the path. The longest rule that fits decides (of
    equally long ones the last of their names); where none fits ``rule`` is null, and a glob of ``blocked``
    that fits host and path together blocks, else the verdict is ``allow``. A URL that is null or has no ``://`` is the empty text. Characters are
    code points. Rows are independent, so repeated rows, other columns and order change nothing; very long
    URLs are simulated by themselves.
    """
    ordered = sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)
    of_hosts = Automaton([g for r in ordered for g in r.host_globs()])
    of_paths, of_urls = Automaton([r.path_glob() for r in ordered]), Automaton(list(blocked))
    names = np.array([r.name for r in ordered] + [None], dtype=object)
    verdicts = np.array([r.verdict for r in ordered] + ["allow"], dtype=object)
    many = len(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            named = of_hosts.fits(hosts)
            ruled = (named[:, 0::2] | named[:, 1::2]) & of_paths.fits(paths)
            banned = of_urls.fits([h + p for h, p in zip(hosts, paths)]).any(axis=1)
            first = np.where(ruled.any(axis=1), ruled.argmax(axis=1) if many else 0, many)
            verdict = np.where((first == many) & banned, "block", verdicts[first])
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["host"], batch["path"], pa.array(names[first], pa.string()),
                 pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = split.schema["page_id"].dataType.simpleString()
    return split.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
