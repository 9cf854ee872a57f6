"""URL filters as one bit-parallel wildcard automaton.

All glob rules are packed one after the other into a row of bits: a start bit
and a bit for each literal or `?`. A step over one character of a URL shifts
all bits at once, keeps those whose pattern has that character next (a mask
per character), and keeps bits that stand at a wildcard (a mask for self-loops).
The bits are spread over as many 64-bit words as the rules need, with a carry
between words, and a batch of URLs steps together.

Globs: `*` is any run without `/`, `**` any run, `?` any character but `/`; all
else is literal. A glob must cover the whole canonical URL: host (A-Z lowered)
and path, without scheme, query and fragment.

A null URL, or one without `://`, has an empty host and path; it fits no rule
and gets the default verdict. Equal URLs get equal verdicts; an empty table
gives an empty result. Very long URLs step alone once shorter ones have ended.
Only the named column is read; the verdict column takes a free name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import LOWER, UPPER, fresh

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class UrlRule:
    """A host with all its subdomains and the start of a path, such as `example.com/en/`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


#: The host and path rules.
RULES = (
    UrlRule(ALLOW, "com", "/"),
    UrlRule(BLOCK, "example.com", "/en/"),
    UrlRule(ALLOW, "www.example.com", "/en/"),
    UrlRule(BLOCK, "net", "/es/"),
    UrlRule(BLOCK, "net", "/fr/"),
)
#: Globs that block a URL which no rule fits.
BLOCK_GLOBS = (
    "*casino*/**", "*free-bets*/**", "*cheap-pills*/**", "*ads-track*/**", "*poker*/**", "*viagra*/**",
    "**/login/**", "**/cart/**", "**.exe", "**.zip", "**/ads/**",
)


@dataclass(frozen=True)
class Automaton:
    """Masks of packed globs, as rows of 64-bit words."""

    start: np.ndarray
    final: np.ndarray
    loop_any: np.ndarray
    loop_segment: np.ndarray
    step: np.ndarray
    letters: np.ndarray
    final_at: tuple[int, ...]

    @classmethod
    def packed(cls, globs: Sequence[str]) -> Automaton:
        start = final = loop_any = loop_segment = any_step = at = 0
        steps: dict[int, int] = {ord("/"): 0}
        ends = []
        for glob in globs:
            start |= 1 << at
            k = 0
            while k < len(glob):
                if glob.startswith("**", k):
                    loop_any |= 1 << at
                    k += 2
                    continue
                if glob[k] == "*":
                    loop_segment |= 1 << at
                else:
                    at += 1
                    if glob[k] == "?":
                        any_step |= 1 << at
                    else:
                        steps[ord(glob[k])] = steps.get(ord(glob[k]), 0) | 1 << at
                k += 1
            final |= 1 << at
            ends.append(at)
            at += 1
        letters = sorted(steps)
        n = max(1, -(-at // 64))

        def words(bits: int) -> np.ndarray:
            return np.array([bits >> 64 * w & (1 << 64) - 1 for w in range(n)], np.uint64)

        # Row 0 is for characters that no glob names.
        table = [words(any_step)] + [words(steps[c] | (0 if c == ord("/") else any_step)) for c in letters]
        return cls(words(start), words(final), words(loop_any), words(loop_segment), np.stack(table),
                   np.array(letters, np.uint32), tuple(ends))

    def matches(self, urls: Sequence[str]) -> np.ndarray:
        """Rows of URLs, columns of globs: whether the glob covers the URL."""
        codes = [np.frombuffer(u.encode("utf-32-le", "surrogatepass"), np.uint32) for u in urls]
        lengths = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate([codes[k] for k in order]) if len(urls) else np.zeros(0, np.uint32)
        place = np.searchsorted(self.letters, flat)
        known = place < len(self.letters)
        known[known] = self.letters[place[known]] == flat[known]
        row = np.where(known, place + 1, 0)
        slash = flat == ord("/")
        ends = np.cumsum(lengths[order])
        begins = ends - lengths[order]
        state = np.repeat(self.start[None, :], len(urls), axis=0)
        sorted_lengths = lengths[order]
        for t in range(int(sorted_lengths[0]) if len(urls) else 0):
            live = int(np.searchsorted(-sorted_lengths, -t, side="left"))
            at = begins[:live] + t
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            moved &= self.step[row[at]]
            stay = np.where(slash[at][:, None], self.loop_any, self.loop_any | self.loop_segment)
            state[:live] = moved | now & stay
        found = np.zeros((len(urls), len(self.final_at)), bool)
        for k, bit in enumerate(self.final_at):
            found[order, k] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1) == 1
        return found


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lowered."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def judged(pages: DataFrame, url: str = "url", rules: Sequence[UrlRule] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS,
           name: str = "judged") -> tuple[DataFrame, str]:
    """`pages` with a struct: `host`, `path`, `rule`, `verdict`, `globs` (places of the block globs that fit). Returns its name as well.

    The longest rule that fits decides, of equally long ones the first; without a rule, any block glob blocks.
    """
    rules, block_globs = tuple(rules), tuple(block_globs)
    globs = [g for rule in rules for g in rule.globs] + list(block_globs)
    machine = Automaton.packed(globs)
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), k))

    def verdicts(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = machine.matches((hosts + paths).tolist())
        n = len(rules)
        fits = found[:, 0:2 * n:2] | found[:, 1:2 * n:2]
        out = []
        for row, own in zip(fits, found[:, 2 * n:]):
            best = next((k for k in ranked if row[k]), None)
            hits = np.flatnonzero(own).tolist()
            verdict = rules[best].verdict if best is not None else BLOCK if hits else ALLOW
            out.append((rules[best].name if best is not None else None, verdict, hits))
        return pd.DataFrame(out, columns=["rule", "verdict", "globs"])

    judge = F.pandas_udf(verdicts, "rule string, verdict string, globs array<int>").asNondeterministic()
    raw, name = fresh(pages, "found"), fresh(pages, name)
    h, p = fresh(pages, "host"), fresh(pages, "path")
    out = pages.withColumn(h, host(F.col(f"`{url}`"))).withColumn(p, path(F.col(f"`{url}`")))
    out = out.withColumn(raw, judge(F.col(h), F.col(p)))
    return out.withColumn(name, F.struct(F.col(h).alias("host"), F.col(p).alias("path"), f"{raw}.*")).drop(raw, h, p), name
