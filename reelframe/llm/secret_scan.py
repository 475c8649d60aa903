"""Secrets in texts: three patterns, and windows of high entropy in strings of one character class.

The entropy of a window of W characters is log2 W - (sum of c log2 c over its counts c) / W. That sum is kept in whole
numbers while a window slides: a character that comes in or goes out changes one count each, so a step costs the same
whatever W is, and the result doesn't depend on where a task's batch starts.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reelframe.llm.common import by_size, lean, read_table

#: Kinds by pattern, in the order in which spans of one start are listed: name, pattern, group that is measured, least length.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: The runs that are long enough for the pattern of the same kind: what it matches besides is dropped anyhow.
LONG = {"access": re.compile(r"AKIA[A-Z0-9]{16,}"), "hex": re.compile(r"[0-9a-f]{24,}")}
ENTROPY = "entropy"


@dataclass(frozen=True)
class CharClass:
    """Candidate strings are the longest runs of these characters (a regular expression's set); a window of so many of them
    is a secret from so many bits a character on, if it has a digit and a letter."""

    name: str
    chars: str
    window: int
    bits: float


#: Random strings reach these bits in nearly all windows; words, numbers and repeated characters don't.
CLASSES = (
    CharClass("hex", "0-9a-f", 32, 3.2),
    CharClass("HEX", "0-9A-F", 32, 3.2),
    CharClass("base32", "A-Z2-7", 24, 3.6),
    CharClass("base64", r"A-Za-z0-9+/_=-", 24, 3.9),
)

#: What is no secret, though it looks like one: matches suppress the entropy spans that they overlap.
ALLOWED = (
    r"(?i)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b",  # UUIDs
    r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]*",  # links
    r"[A-Za-z0-9+/_=-]*(?:EXAMPLE|example|placeholder|PLACEHOLDER)[A-Za-z0-9+/_=-]*",
    r"(?i)[0-9a-z+/_=-]*(?:0123456789|abcdefghij)[0-9a-z+/_=-]*",  # alphabets
    r"\bsha(?:1|256|384|512)-[A-Za-z0-9+/]+=*",  # checksums of pages' resources
)

#: c log2 c in whole units of 2 ** -32, for the counts of a window.
UNIT = 1 << 32


def _cost(window: int) -> np.ndarray:
    return np.array([0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))], np.int64)


def window_costs(codes: np.ndarray, window: int) -> np.ndarray:
    """The sum of c log2 c (in UNITs) over the counts of each window of codes, by incremental counts.

    A window starts empty and takes in its characters one after the other; from then on each step takes one in and lets
    one out. A character's count in the window before it comes in is how many of its own places lie in that window.
    """
    n, f = len(codes), _cost(window)
    if n < window:
        return np.zeros(0, np.int64)
    at = np.arange(n)
    by_char = np.argsort(codes, kind="stable")
    group = np.r_[True, codes[by_char][1:] != codes[by_char][:-1]]
    places = np.cumsum(group)[np.argsort(by_char, kind="stable")] * np.int64(n + 1)  # keeps characters apart
    keys = np.sort(places + at)
    before = np.searchsorted(keys, places + at) - np.searchsorted(keys, places + np.maximum(at - window, 0))
    # of the window [i - W, i) before character i comes in: its count, and then that of the one which goes out
    step = f[np.minimum(before + 1, window)] - f[np.minimum(before, window)]
    out_at = at[window:] - window
    held = np.searchsorted(keys, places[out_at] + at[window:] + 1) - np.searchsorted(keys, places[out_at] + out_at)
    same = codes[out_at] == codes[window:]
    step[window:] = np.where(same, 0, step[window:] + f[np.minimum(held, window) - 1] - f[np.minimum(held, window)])
    return np.cumsum(step)[window - 1 :]


def entropy_windows(codes: np.ndarray, kind: CharClass) -> np.ndarray:
    """Which windows of codes have enough bits, a digit and a letter."""
    w = kind.window
    most = round((math.log2(w) - kind.bits) * w * UNIT)
    costs = window_costs(codes, w)
    within = lambda flags: (lambda c: c[w:] - c[:-w])(np.r_[0, np.cumsum(flags)]) > 0
    return (costs <= most) & within((codes >= 48) & (codes <= 57)) & within((codes >= 65) & (codes != 95))


def entropy_spans(text: str, classes: tuple[CharClass, ...] = CLASSES) -> list[tuple[int, int]]:
    """The places (start, end) that windows of enough entropy cover, over all classes, overlapping ones as one."""
    found = []
    for kind in classes:
        for m in re.finditer(rf"[{kind.chars}]{{{kind.window},}}", text):
            hits = np.flatnonzero(entropy_windows(np.frombuffer(m.group().encode("ascii"), np.uint8).astype(np.int64), kind))
            if len(hits):
                cut = np.flatnonzero(np.diff(hits) > kind.window) + 1
                found += [(m.start() + int(run[0]), m.start() + int(run[-1]) + kind.window) for run in np.split(hits, cut)]
    return merged(found)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches that are long enough, whole matches, by start and then kind as listed."""
    found = []
    for k, (name, pattern, group, least) in enumerate(PATTERNS):
        for m in LONG.get(name, pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end(), name))
    return [(a, b, name) for a, _, b, name in sorted(found)]


def _overlap(a: int, b: int, spans: list[tuple[int, int]]) -> bool:
    return any(x < b and a < y for x, y in spans)


def secret_spans(text: str, allowed: re.Pattern, classes: tuple[CharClass, ...] = CLASSES) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, added): pattern_spans(), and entropy spans that overlap neither these nor what is allowed."""
    base, added = pattern_spans(text), []
    if spans := entropy_spans(text, classes):
        fine = merged([(a, b) for a, b, _ in base]) + [m.span() for m in allowed.finditer(text)]
        fine.sort()
        ends = np.maximum.accumulate([b for _, b in fine]) if fine else np.zeros(0, int)
        starts = np.array([a for a, _ in fine])
        for a, b in spans:
            # those that start before b, and of them the furthest end
            k = int(np.searchsorted(starts, b, "left"))
            if not (k and ends[k - 1] > a):
                added.append((a, b, ENTROPY))
    return base, added


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, allow_list: tuple[str, ...] = ALLOWED, classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """doc_id, spans (start, end, kind), n_base of each row of docs (doc_id, text): places in code points, end exclusive.

    spans are by start, then kind: the patterns' matches and, of kind "entropy", what windows of high entropy cover beside
    them and beside matches of allow_list. n_base is how many are the patterns'. Null and empty texts have none; repeated
    rows are scanned each; other columns are ignored; an empty table gives an empty result. A text is scanned whole, in
    memory that grows with its length.
    """
    order = {name: k for k, name in enumerate([*(p[0] for p in PATTERNS), ENTROPY])}

    def run(batches):
        allowed = re.compile("|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in allow_list) or r"(?!)")
        for batch in batches:
            for part in by_size(batch):
                ends, starts, stops, kinds, n_base = [0], [], [], [], []
                for text in part.column("text").to_pylist():
                    base, added = secret_spans(text or "", allowed, classes)
                    every = sorted(base + added, key=lambda s: (s[0], order[s[2]]))
                    starts += [s[0] for s in every]
                    stops += [s[1] for s in every]
                    kinds += [s[2] for s in every]
                    ends.append(len(starts))
                    n_base.append(len(base))
                flat = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(stops, pa.int64()), pa.array(kinds, pa.string())], names=["start", "end", "kind"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(n_base, pa.int64())], names=["doc_id", "spans", "n_base"])

    slim = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
    return slim.mapInArrow(lean(run), "doc_id long, spans array<struct<start: long, end: long, kind: string>>, n_base long")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != ENTROPY)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(name).alias(f"n_{name}") for name, *_ in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"), count(ENTROPY).alias("n_entropy"))
