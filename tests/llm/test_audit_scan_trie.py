import hashlib
import itertools
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import filter_audit, prefix_trie, secret_scan
from reelframe.llm.queries import QUERIES
from tests.llm.test_operators import ODD, docs, words

LABELS = "doc_id long, quality int, toxic int"


def brute_audit(rows, marks):
    """The rows of the audit by applying all filters in turn to all documents, for each order."""
    good, toxic, seen = {d for d, q, _ in marks if q == 1}, {d for d, _, t in marks if t == 1}, defaultdict(list)
    for d, text, source in rows:
        if d is not None:
            seen[text or ""].append(d)

    def fails(f, d, text):
        ws = words(text)
        return {
            "A": len(ws) < 200,
            "B": 100 * len(set(ws)) < 50 * len(ws),
            "C": 100 * sum(c in string.ascii_uppercase for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and any(x < d for x in seen[text]),
        }[f]

    out, by_filter = {}, Counter()
    judged = [(s or "", d, {f for f in "ABCDE" if fails(f, d, t or "")}) for d, t, s in rows]
    for part in {p for p, _, _ in judged}:
        for order in itertools.permutations("ABCDE"):
            left = [x for x in judged if x[0] == part]
            everyone = left
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                by_filter[part, f] += len(gone)
                failing = sum(f in x[2] for x in everyone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), failing - len(gone), sum(x[2] == {f} for x in everyone), sum(x[1] in good for x in gone), sum(x[1] in toxic for x in gone))
    return {k: v + (by_filter[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def test_audit_is_that_of_all_orders_applied_in_turn(spark):
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["low", "UP", "a#b", "Mixed", f"w{rng.randrange(400)}"]) if rng.random() < p else f"w{k}" for k in range(n)) for p in (0, 0.1, 0.9) for n in (5, 199, 200, 300)]
    rows = [(rng.choice([None, *range(60)]), rng.choice([*pool, None, ""]), rng.choice(["a", "b", None, ""])) for _ in range(150)] + [(d, t, s) for d, t, _, s, _ in ODD]
    marks = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in [*range(0, 60, 2), 7, 7, None]]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"part": F.lit("x"), "mask": F.lit(1), "key": F.lit("k")}).repartition(3)
    cells = filter_audit.mask_cells(filter_audit.failure_masks(d, spark.createDataFrame(marks, LABELS)))
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filter_audit.audit(cells).collect()}
    assert got == brute_audit(rows, marks)
    assert len(got) == 120 * 5 * len({s or "" for _, _, s in rows})


def test_audit_of_nothing(spark):
    cells = filter_audit.mask_cells(filter_audit.failure_masks(docs(spark, []), spark.createDataFrame([], LABELS)))
    assert filter_audit.audit(cells).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_orders_come_from_each_other_by_one_swap_of_neighbours(n):
    found = list(filter_audit.adjacent_orders(n))
    assert len({o for o, _ in found}) == len(found) == math.factorial(n)
    for (a, _), (b, at) in zip(found, found[1:]):
        assert b == a[:at] + (a[at + 1], a[at]) + a[at + 2 :]


def test_audit_of_many_parts_at_once(spark):
    rows = [(f"s{k}", k % 32, k % 2, k % 3 == 0) for k in range(300)]
    cells = filter_audit.mask_cells(spark.createDataFrame(rows, "part string, mask int, good int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int")).coalesce(1))
    got = filter_audit.audit(cells)
    assert got.count() == 300 * 600
    assert got.filter("removed + redundant > 1 OR kept + removed > 1 OR shapley > 120").count() == 0


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def brute_entropy_spans(text):
    """Places covered by windows that have enough entropy, each window counted anew."""
    covered = [set(), set()]
    hit = set()
    for kind in secret_scan.CLASSES:
        for a in range(len(text) - kind.window + 1):
            w = text[a : a + kind.window]
            if re.fullmatch(f"[{kind.chars}]+", w) and entropy(w) >= kind.bits - 1e-9 and re.search("[0-9]", w) and re.search("[A-Za-z]", w):
                hit.add((a, a + kind.window))
    out = []
    for a, b in sorted(hit):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def brute_patterns(text):
    found = []
    for k, (name, p, g, n) in enumerate((("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))):
        found += [(m.start(), k, m.end(), name) for m in re.finditer(p, text) if len(m.group(g)) >= n]
    return [(a, b, name) for a, k, b, name in sorted(found)]


def random_texts(rng, n):
    alphabets = [string.ascii_letters + string.digits + "+/_=-", "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", "ab", string.ascii_lowercase, "0123456789"]
    names = ["token", "Secret", "API_KEY", "apikey", "passwd", "PASSWORD", "https://x.org/", "AKIA", "é", "\U0001f600", "user_id", "ſecret"]
    glue = ["=", ": ", " = '", '":"', " ", "\n", "::", "-"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts += [rng.choice(names), rng.choice(glue), "".join(rng.choices(rng.choice(alphabets), k=rng.choice([1, 5, 6, 16, 20, 23, 24, 25, 32, 60]))), rng.choice(["", " ", "\n"])]
        out.append("".join(parts))
    return out


def test_spans_are_those_of_whole_windows_and_plain_patterns(spark):
    texts = random_texts(random.Random(8), 400)
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, texts[1]), (None, texts[2]), (900, None), (901, ""), (902, "x" * 300_000 + " token=abcdef1")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(0), "n_base": F.lit("a")}).repartition(5)
    got = Counter((r["doc_id"], tuple(map(tuple, r["spans"])), r["n_base"]) for r in secret_scan.scan(d, allow_list=()).collect())
    want, added = Counter(), 0
    for k, t in rows:
        base = brute_patterns(t or "")
        more = [(a, b, "entropy") for a, b in brute_entropy_spans(t if t and len(t) < 10_000 else "") if not any(x < b and a < y for x, y, _ in base)]
        added += len(more)
        want[k, tuple(sorted(base + more, key=lambda s: (s[0], ["assign", "access", "hex", "entropy"].index(s[2])))), len(base)] += 1
    assert got == want and added > 50


def test_allowed_strings_are_no_secrets_and_random_ones_are(spark):
    rng = random.Random(2)
    fine = ["https://host.org/a/Zk3Jq9Xv7LmQ2rT8wYb5NcD1", "123e4567-e89b-42d3-a456-426614174000", "abcdefghijklmnopqrstuvwxyz0123456789", "getUserAccountSettingsFromDatabaseConnection2", "EXAMPLEzk3Jq9Xv7LmQ2rT8wYb5NcD1"]
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(40)]
    d = spark.createDataFrame([(k, f"words before {t} and after") for k, t in enumerate(fine + keys)], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secret_scan.scan(d).collect()}
    assert all(not got[k] for k in range(len(fine)))
    assert sum(got[k + len(fine)][:1] == [(13, 53, "entropy")] for k in range(40)) >= 38


def test_window_costs_are_those_of_each_window():
    rng = random.Random(4)
    for n in (0, 23, 24, 25, 400):
        codes = np.array([rng.randrange(9) for _ in range(n)], np.int64)
        want = [sum(round(c * math.log2(c) * secret_scan.UNIT) for c in Counter(codes[i : i + 24].tolist()).values()) for i in range(max(0, n - 23))]
        assert secret_scan.window_costs(codes, 24).tolist() == want


def test_scan_digests(spark, tmp_path):
    texts = dict(enumerate([*random_texts(random.Random(9), 60), None, ""]))
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_secret_scan"](spark, str(tmp_path)).collect()
    assert len(got) == len(texts) and any(r["spans"] for r in got)
    for r in got:
        base = brute_patterns(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, k in base) for x in ("assign", "access", "hex"))
        assert [x for x in r["spans"].split(",") if x and not x.startswith("entropy")] == [f"{k}:{a}:{b}" for a, b, k in base]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    out = set()
    for path, who in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if len(members[p]) and not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in under)]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in under)
        ids = ",".join(map(str, sorted(ends[path])))
        out.add((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string"


def trie(spark, rows):
    d = spark.createDataFrame(rows, TURNS).withColumns({"pos": F.lit(1), "name": F.lit("n"), "key": F.lit("k")}).repartition(3)
    found = prefix_trie.prefix_trie(d).collect()
    assert len(found) == len(set(map(tuple, found)))
    return set(map(tuple, found))


def test_trie_is_that_of_all_prefixes(spark):
    rng = random.Random(12)
    rows = []
    for c in rng.sample(range(420), 90):
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, 17])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None, ""]) if rng.random() < 0.2 else "user", rng.choice(["a", "a", "a", "", None, "bb", "ü\U0001f600"])))
    rows += [(None, 0, "user", "a"), (100, 5, "user", "a"), (100, 5, "user", "a"), (5, 1, "x" * 9, "long " * 50_000)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_one_long_conversation_and_of_many_equal_ones(spark):
    rows = [(0, t, "user", str(t % 3)) for t in range(67)] + [(700 + k, t, "user", f"same {t}") for k in range(90) for t in range(9)]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_turnless_conversations_and_of_nothing(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]
    assert trie(spark, rows) == brute_trie(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_digests_of_many_ids_are_those_of_all_at_once(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    ends = spark.range(1000).select((F.col("id") % 3 * F.col("id") % 2).alias("node"), (F.col("id") * 7919 % 1000).alias("conv_id")).repartition(9)
    got = {r["node"]: r["ends_sha256"] for r in prefix_trie.end_digests(ends).collect()}
    ids = defaultdict(list)
    for r in ends.collect():
        ids[r["node"]].append(r["conv_id"])
    assert got == {n: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for n, c in ids.items()}
