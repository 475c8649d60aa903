import hashlib
import random
import re
import zlib
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelframe.llm import language_id, media_columns, mixing, packing, quality_rules, simhash, suffix_dedup, token_store, tokens, toxicity, url_filters
from reelframe.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import SF, compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and very long texts, ties, repeated rows, marks and characters of several bytes.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", "b", 3),
    (5, "One", "en", "b", 3),
    (6, "the same words again and again " * 40, "en", "a", 1240),
    (6, "the same words again and again " * 40, "en", "a", 1240),
    (7, "ünïcödé 漢字 \U0001f600 #*$%&|<> " * 9, "de", None, 9),
    (8, "word " * 30_000, "en", "c", 150_000),
    (None, "no id here, but a text of more than ten words it is indeed", "en", "a", 1),
    (9, "x" * 5000, "en", "b", 5000),
    (10, "line one\nline two is here\nline one\nline one\n\n\n", "fr", "c", 44),
]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(text):
    return WORD.findall(text or "")


def own_tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    compare(spark, QUERIES[name], ORACLE_SQL[name])


def test_parts_give_the_ids_of_whole_texts():
    rng = random.Random(1)
    letters = [*"abc DEF  \n\t'stévelÀß§½²³ 1 2 .,!?-_#$%\x00\x1c\x1f\x85\xa0İıŁǅJΣσςЖß漢字Ⱥ", "\u030c", "\u0301", "\u200b", "\u2003", "\u3000", "\U0001f600", "'s", "'re", "'LL", "the ", "of "]
    for name, kind in (("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "bytes")):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            model = f.read()
        for as_text in (False, True):
            whole = own_tokenizer(name)
            whole.encode_special_tokens = as_text
            enc = tokens.encoder(model, kind, as_text)
            for k in range(100):
                texts = ["".join(rng.choices([*letters, *["<|endoftext|>", "<|endoftext"] * (k % 4 == 0)], k=rng.randint(0, 25))) for _ in range(50)]
                for text, ids in zip(texts, enc.encode(texts), strict=True):
                    assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_special_tokens_in_a_text_are_the_librarys(spark):
    rows = [(1, "a <|endoftext|> b"), (2, "<|startoftext|><|endoftext|>"), (3, "none")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for name, end, made in (("word_bpe_49k.json", 0, lambda f: packing.pieces(d, f, with_ids=True)), ("byte_bpe_50k.json", 2, lambda f: token_store.tokenize(d, f).filter("ids IS NOT NULL"))):
        whole, width = own_tokenizer(name), "<u4" if end == 0 else "<u2"
        got = {r["doc_id"]: np.frombuffer(r["ids"], width).tolist() for r in made(public_tokenizers.path(name)).collect()}
        assert got == {k: [*whole.encode(t, add_special_tokens=False).ids, end] for k, t in rows}


def test_parts_of_an_older_generation_are_remembered():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = tokens.PartEncoder(f.read(), "bytes", keep=4)
    first = enc.encode(["aa bb cc"])
    for text in ("dd ee ff", "aa bb cc", "gg hh ii", "jj kk", "aa bb cc"):
        got = enc.encode([text])
        assert len(enc.recent) <= 4 + len(text.split())
    assert got == first


def first_fit_two(lengths, capacity):
    """Best-two-fit, one bin at a time."""
    left, bins = Counter(lengths), []
    while sum(left.values()):
        gap, own = capacity, []
        for n in sorted(left, reverse=True):
            while left[n] and n <= gap:
                own.append(n)
                left[n] -= 1
                gap -= n
        if gap:
            small = own[-1]
            free = sorted(left.elements())
            best = max(((a + b, -min(a, b)) for i, a in enumerate(free) for b in free[:i] if small < a + b <= gap + small), default=None)
            if best:
                total, a = best[0], -best[1]
                own.remove(small)
                own += [a, total - a]
                left[small] += 1
                left[a] -= 1
                left[total - a] -= 1
        bins.append(tuple(sorted(own, reverse=True)))
    return bins


def test_bins_planned_at_once_are_those_of_one_at_a_time():
    rng = random.Random(2)
    for _ in range(150):
        cap = rng.choice([10, 17, 30])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 60))] + [rng.randint(1, cap)] * rng.randint(0, 30)
        plan = packing.plan_bins(Counter(lengths), cap)
        got = [tuple(n for n, u in parts for _ in range(u)) for bins, parts in plan for _ in range(bins)]
        assert Counter(n for b in got for n in b) == Counter(lengths)
        assert all(sum(b) <= cap for b in got)
        assert [sum(b) for b in got] == [sum(b) for b in first_fit_two(lengths, cap)]


def test_packing_places_each_piece_once_without_gaps(spark):
    packed = packing.pack_documents(docs(spark), public_tokenizers.path("word_bpe_49k.json"), with_ids=True).cache()
    got = packed.toPandas()
    whole = own_tokenizer("word_bpe_49k.json")
    want = []
    for d, text, *_ in ODD:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want.append((d, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(None if x != x else int(x) for x in r) for r in got[cols].values.tolist()) == Counter(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        assert own["length"].sum() <= 2048
    assert packing.sequences(packed).agg(F.sum(F.length("ids"))).first()[0] == 4 * got["length"].sum()


def test_packing_nothing(spark):
    assert packing.pack_documents(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_token_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs(spark), public_tokenizers.path("byte_bpe_50k.json"), path)
    got = token_store.read_store(spark, path, with_ids=True).toPandas().sort_values("start")
    whole, at = own_tokenizer("byte_bpe_50k.json"), 0
    by = {}
    for d, text, *_ in ODD:
        by.setdefault(d, []).append(np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    for d, start, n, crc, ids in got[["doc_id", "start", "n_tokens", "ids_crc32", "ids"]].values.tolist():
        assert start == at and zlib.crc32(ids) == crc and len(ids) == 4 * n
        by[None if d != d else int(d)].remove(ids)
        at += n
    assert not any(by.values())
    ordered = [-1 if d != d else d for d in got["doc_id"]]
    assert ordered == sorted(ordered)


def test_segments_decode_from_their_checkpoints_and_checksums_hold():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.002, 300_000), 5000).astype("<u2")
    symbols, n = np.unique(ids, return_counts=True)
    model = token_store.Model(symbols.astype(np.int64), token_store.scale_frequencies(n))
    raw = token_store.encode_block([(5, ids[:1]), (None, ids[1:])], model)
    block = token_store.Block(raw)
    assert block.segments > 1 and block.doc_ids == [5, None]
    for k in reversed(range(block.segments)):
        first = k * token_store.SEGMENT_STEPS * block.lanes
        assert (block.decode(k, model) == ids[first : first + token_store.SEGMENT_STEPS * block.lanes]).all()
    broken = bytearray(raw)
    broken[-3] ^= 1
    with pytest.raises(ValueError):
        token_store.Block(bytes(broken)).decode_all(model)


def test_store_of_nothing(spark, tmp_path):
    token_store.write_store(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "s"))
    assert token_store.read_store(spark, str(tmp_path / "s")).count() == 0


def brute_removal(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(raw[i : i + length])
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        out[d] = (len(raw), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_dedup_is_that_of_all_windows(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}é" for k in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = [text(n) for n in (20, 25, 40, 90)]
    rows = [(r[0], r[1]) for r in ODD if r[0] != 8]
    for k in range(60):
        parts = [rng.choice([*shared, text(rng.randint(1, 50)), "ab" * rng.randint(1, 150)]) for _ in range(rng.randint(1, 4))]
        rows.append((100 + k, " ".join(parts)))
    rows += [(200 + k, rows[20 + k][1]) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.removal_report(df).collect()
    want = brute_removal(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def test_merging_runs_keeps_order_and_shared_bytes():
    rng = random.Random(5)
    for _ in range(40):
        runs = []
        for _ in range(rng.randint(1, 6)):
            own = sorted(bytes(rng.choices(b"ab\0", k=8)) for _ in range(rng.randint(1, 12)))
            lcp = [0] + [next((i for i in range(8) if a[i] != b[i]), 8) for a, b in zip(own, own[1:])]
            runs.append((own, lcp))
        order, shared = suffix_dedup.merge_runs(runs, 8)
        merged = [runs[r][0][i] for r, i in order]
        assert merged == sorted(s for r in runs for s in r[0])
        assert shared[1:] == [next((i for i in range(8) if a[i] != b[i]), 8) for a, b in zip(merged, merged[1:])]


def test_cut_texts_have_no_repeats_left(spark):
    rows = [(50 + k, "start " + str(k) + " " + "shared passage of many words " * 6 + str(k) + " end", "en", "a", 1) for k in range(5)]
    out = suffix_dedup.remove_repeats(docs(spark, rows + ODD)).toPandas()
    assert list(out.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum("shared passage" in (t or "") for t in out["text"]) == 1
    kept = out[out["doc_id"] == 4]
    assert kept["text"].tolist() == ["one"] and kept["n_chars"].tolist() == [3]


def test_media_round_trip():
    rng = random.Random(6)
    payloads = [media_columns.payload(t) for t in (None, "", "a", "x" * 64, "x" * 65, "é" * 700)]
    payloads += [bytes(rng.choices(range(256), k=64 * rng.randint(1, 70))) for _ in range(20)] + [b"\xff" * 64 * 33, b"\0\xff" * 512]
    files = media_columns.encode(payloads)
    assert [p for p, _ in media_columns.decode(files)] == payloads
    assert all(f[:4] == b"RIFF" and f[8:12] == b"AVI " and len(f) % 2 == 0 for f in files)
    with pytest.raises(ValueError):
        media_columns.decode([b"RIFF\0\0\0\0AVI "])


def test_media_digest_and_clips(spark):
    stored = media_columns.store(docs(spark))
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media_columns.digest(stored).collect()}
    for d, text, *_ in ODD:
        p = media_columns.payload(text)
        r = got[(d, hashlib.sha256(p).hexdigest())]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len((text or "").encode()), len(p), zlib.crc32(p[-64:]))
    clips = media_columns.clips(stored).filter("doc_id = 8").orderBy("clip").collect()
    assert clips[0]["start_s"] == 0 and all(a["end_s"] == b["start_s"] for a, b in zip(clips, clips[1:]))


def other_jpeg(spark, pixels, colour=False):
    """(a JPEG image of grey pixels by Java's writer, its own reader's pixels)."""
    jvm = spark._jvm
    high, wide = pixels.shape
    image = jvm.java.awt.image.BufferedImage(wide, high, 1 if colour else 10)
    for y in range(high):
        for x in range(wide):
            image.setRGB(x, y, int(pixels[y, x]) * 0x010101) if colour else image.getRaster().setSample(x, y, 0, int(pixels[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(out.toByteArray()))
    return data, np.array([[back.getRaster().getSample(x, y, 0) for x in range(wide)] for y in range(high)])


def test_frames_of_another_writer_are_decoded(spark):
    rng = np.random.default_rng(3)
    smooth = np.clip(128 + 60 * np.sin(np.arange(37)[:, None] / 5) + 50 * np.cos(np.arange(29) / 3) + rng.normal(0, 9, (37, 29)), 0, 255).astype(np.uint8)
    for colour in (False, True):
        data, want = other_jpeg(spark, smooth, colour)
        got = media_columns.decode_jpeg(data)
        assert len(got) == (3 if colour else 1) and got[0].shape == (37, 29)
        assert np.abs(got[0].astype(int) - want).max() <= (4 if colour else 1)
    dark, light = (other_jpeg(spark, np.full((16, 24), v) + rng.integers(0, 9, (16, 24)))[0] for v in (20, 200))
    file = media_columns.avi([dark] * 3 + [light] * 4, 2, 0).replace(b"strd\x08\0\0\0", b"JUNK\x08\0\0\0")
    made = spark.createDataFrame([(1, file), (2, None)], "doc_id long, media binary")
    assert [(r["doc_id"], r["clip"], r["start_s"], r["end_s"], r["n_frames"]) for r in media_columns.clips(made).orderBy("clip").collect()] == [(1, 0, 0.0, 3 / 25, 3), (1, 1, 3 / 25, 7 / 25, 4)]
    own = media_columns.encode([media_columns.payload("level " * 300)])[0]
    at, size = media_columns.read_index(own)[1][0]
    blocks = media_columns.decode([own])[0][1][0]
    assert (media_columns.decode_jpeg(own[at : at + size])[0][::8, ::8] == blocks).all()


def test_media_of_an_empty_table(spark):
    stored = media_columns.store(docs(spark, []))
    assert stored.count() == media_columns.digest(stored).count() == media_columns.clips(stored).count() == 0


def test_shots_are_cut_where_levels_jump():
    frames = np.concatenate([np.full((5, 2, 64), 10), np.full((4, 2, 64), 200), np.full((3, 2, 64), 90)])
    assert media_columns.shots(frames) == [(0, 5), (5, 9), (9, 12)]


def test_language_of_held_out_documents(spark):
    got = QUERIES["op5_language_id"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").toPandas(), on="doc_id")
    assert ((got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 3 == 1)) == got["held_out"]).all()
    assert (got[got["held_out"]]["lang_pred"] == got[got["held_out"]]["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_of_odd_texts(spark):
    found = language_id.identify(docs(spark), language_id.learn(docs(spark))).collect()
    assert len(found) == len(ODD)
    assert {r["lang_pred"] for r in found if r["doc_id"] in (1, 2, 3)} == {"und"}
    nothing = language_id.identify(docs(spark), language_id.learn(docs(spark, []))).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def test_distance_of_a_document_to_a_profile():
    rows = [("aa", k + 1, c) for k, c in enumerate((97, 98, 99))] + [("bb", k + 1, c) for k, c in enumerate((99, 98, 97))]
    p = language_id.Profiles(rows, ranks=3)
    lang, score = p.predict("a a a b b c")
    assert lang == "aa" and 0 <= score <= 1


def brute_grams(text):
    """Letters and the 2- and 3-grams of words with a blank at their borders, by characters."""
    found = []
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    joined = " " + " ".join(words) + " "
    for n in (1, 2, 3):
        found += [joined[i : i + n] for i in range(len(joined) - n + 1)]
    return [g for g in found if (g != " " if len(g) == 1 else g[1] != " " if len(g) == 3 else True)]


def test_languages_are_those_of_plain_profiles(spark):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(60).collect()
    profile, top = {}, lambda grams: [g for g, _ in sorted(Counter(grams).items(), key=lambda x: (-x[1], code(x[0])))][: language_id.RANKS]
    for r in d[:40]:
        if r["text"] and r["lang"]:
            profile.setdefault(r["lang"], []).extend(brute_grams(r["text"]))
    profile = {lang: {g: k for k, g in enumerate(top(grams))} for lang, grams in profile.items()}
    learned = language_id.learn(spark.createDataFrame([(r["text"], r["lang"]) for r in d[:40]], "text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame([(r["doc_id"], r["text"]) for r in d], "doc_id long, text string"), learned).collect()}
    for r in d:
        own = top(brute_grams(r["text"] or ""))
        if not own:
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        far = {lang: sum(abs(p[g] - k) if g in p else language_id.RANKS for k, g in enumerate(own)) for lang, p in profile.items()}
        best = min(sorted(far), key=far.get)
        assert got[r["doc_id"]] == (best, pytest.approx(1 - far[best] / (language_id.RANKS * len(own))))


def water_level(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / share for s in order}
        over = {s for s in order if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_are_shared_again_until_none_is_above(spark):
    sizes = {"a": 1, "b": 50, "Z": 2, None: 7, "é": 1000, "ž": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(water_level(sizes))


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 100):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(9), F.lit("key")).alias("y"))
        assert sorted(r["y"] for r in x.collect()) == list(range(n))


def test_mix_of_all_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op6_mixing"](spark, SF).toPandas()
    again = QUERIES["op6_mixing"](spark, SF).toPandas()
    key = lambda g: sorted(map(tuple, g.values.tolist()))
    assert key(got) == key(again)
    rows = d.toPandas()
    assert dict(zip(got["doc_id"], got["size"])) == {i: len(words(t)) for i, t in zip(rows["doc_id"], rows["text"])}
    assert (got["taken"] <= 3 * got["size"]).all()
    both = got.merge(rows[["doc_id", "source"]], on="doc_id").groupby("source").agg(t=("target", "first"), n=("taken", "sum"))
    assert ((both["n"] - both["t"]).abs() <= 200 + 0.05 * both["t"]).all()


def test_mix_of_odd_documents(spark):
    got = mixing.mix_report(docs(spark)).collect()
    assert sorted(r["size"] for r in got) == sorted(len(words(r[1])) for r in ODD)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    made = mixing.mix_documents(docs(spark)).collect()
    assert sum(len(words(r["text"])) for r in made) == sum(r["taken"] for r in got)
    assert mixing.mix_report(docs(spark, [])).count() == 0


def spark_hash(*values):
    """Spark's xxhash64; numbers given as (value, bytes)."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), h)
    return h - (h >> 63 << 64)


def brute_mix(rows, block=mixing.BLOCK_WORDS, slots=mixing.SHARD_SLOTS, seed=mixing.SEED):
    """doc_id -> words taken, slot by slot."""
    by = {}
    for d, text, source in sorted(((d, t, s) for d, t, s in rows), key=lambda r: (r[0], spark_hash(r[1]) if r[1] is not None else 42)):
        by.setdefault(source, []).append((d, len(words(text))))
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(n for _, n in by[s]) for s in order}
    targets = water_level(sizes)
    n_blocks = {s: -(-sizes[s] // block) for s in order}
    want = {s: targets[s] / sizes[s] * n_blocks[s] for s in order if sizes[s]}
    n, before = {}, Decimal(0)
    near = lambda x: int(x.quantize(Decimal(1), ROUND_HALF_UP))
    for s in order:
        if s in want:
            w = Decimal(repr(want[s])).quantize(Decimal("0.000001"), ROUND_HALF_UP)
            n[s], before = near(before + w) - near(before), before + w
    total = sum(n.values())
    shards = -(-total // slots)
    sizes_of = [slots] * (shards - 1) + [total - (shards - 1) * slots]
    count = [Counter({s: n[s] * own // total for s in n}) for own in sizes_of]
    left = [s for s in n for _ in range(n[s] - sum(c[s] for c in count))]
    open_ = sizes_of[0] - sum(count[0].values()) if shards > 1 else 0
    for g, s in enumerate(left):
        x = g
        for r in range(1, mixing.ROUNDS + 1):
            other = (spark_hash((seed, 4), "slots", (r, 4)) % len(left) - x) % len(left)
            x = other if spark_hash((seed, 4), "slots", (r, 4), (max(x, other), 8), (1, 4)) & 1 else x
        count[min(x // open_, shards - 1) if open_ else shards - 1][s] += 1
    assert [sum(c.values()) for c in count] == sizes_of
    draws, taken = Counter(), Counter()
    for count in count:
        for s in order:
            for j in range(draws[s], min(draws[s] + count[s], 3 * n_blocks[s])) if s in want else ():
                epoch, x = divmod(j, n_blocks[s])
                key = [(seed, 4), (order.index(s), 8), (epoch, 8)]
                for r in range(1, mixing.ROUNDS + 1):
                    other = (spark_hash(*key, (r, 4)) % n_blocks[s] - x) % n_blocks[s]
                    x = other if spark_hash(*key, (r, 4), (max(x, other), 8), (1, 4)) & 1 else x
                start = 0
                for d, n in by[s]:
                    taken[d] += max(0, min(start + n, (x + 1) * block) - max(start, x * block))
                    start += n
            draws[s] += count[s]
    return taken


def test_mix_takes_what_a_plain_mix_takes(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(10_000 + k, "some more words " * (40 * k), s) for k, s in enumerate([None, "\0null", "", "a", "b", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r["doc_id"]: r["taken"] for r in mixing.mix_report(df).collect()}
    want = brute_mix(rows)
    assert got == {d: want[d] for d, _, _ in rows}


def test_many_small_sources_meet_their_targets(spark):
    """A shard has half a slot for each of them."""
    rows = spark.range(2000).select("id", (F.lit(900) + F.col("id") % 150).alias("n"))
    d = rows.select(F.col("id").alias("doc_id"), F.format_string("s%05d", "id").alias("source"), F.array_join(F.array_repeat(F.lit("w"), F.col("n").cast("int")), " ").alias("text"))
    got = mixing.mix_report(d).collect()
    assert len(got) == 2000
    off = [abs(r["taken"] - r["target"]) for r in got]
    assert max(off) <= 1.5 * mixing.BLOCK_WORDS and sum(off) / 2000 <= mixing.BLOCK_WORDS / 2
    assert sum(r["taken"] for r in got) == pytest.approx(sum(r["target"] for r in got), rel=0.002)


@pytest.mark.parametrize("shard_slots", [3, 50])
def test_shards_are_full_and_totals_fixed(spark, shard_slots):
    targets = mixing.source_targets(spark.createDataFrame([(f"s{k}", 10 + 37 * k * k) for k in range(25)], "source string, source_size long"))
    got = mixing.shard_counts(targets, block_words=16, shard_slots=shard_slots).toPandas()
    of_shard = got.groupby("shard")["count"].sum().sort_index()
    assert (of_shard.iloc[:-1] == shard_slots).all() and 0 < of_shard.iloc[-1] <= shard_slots and list(of_shard.index) == list(range(len(of_shard)))
    t = {r["source_no"]: r["target"] / r["source_size"] * -(-r["source_size"] // 16) for r in targets.collect()}
    totals = got.groupby("source_no")["count"].sum()
    assert all(abs(totals.get(s, 0) - want) < 1 for s, want in t.items())


def test_a_null_source_is_not_one_named_like_it(spark):
    d = spark.createDataFrame([(1, "a b " * 320, None), (2, "c d " * 320, "\0null")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix_report(d).collect()}
    assert got[2][0] == pytest.approx(1280 / 3) and got[1][0] == pytest.approx(2560 / 3)
    assert all(abs(taken - target) <= 64 for target, taken in got.values())


def clashing(spark, rows):
    """Documents with more columns, named like what the operators use inside."""
    names = ["size", "start", "doc", "th", "spans", "_k", "_no", "row", "id", "n_words", "runs", "source_no", "kept", "fail_bits", "component"]
    return docs(spark, rows).withColumns({c: F.lit(f"own {c}") for c in names}), names


def test_columns_with_clashing_names_stay_as_they_are(spark):
    rows = [(1, "one two three four five six seven eight nine ten eleven " * 3 + "x" * 120, "en", "a", 5), (2, "z" + "x" * 130 + " other words of a second text, more than ten of them to be kept", "en", "b", 6)]
    d, names = clashing(spark, rows)
    for made in (simhash.keep_first(d), suffix_dedup.remove_repeats(d), mixing.mix_documents(d)):
        got = made.collect()
        assert got and made.columns == d.columns
        assert all(r[c] == f"own {c}" for r in got for c in names)
    for made in (mixing.mix_report(d), suffix_dedup.removal_report(d), simhash.near_duplicates(d)):
        assert made.count() == 2


def brute_rules(text):
    ws = words(text)
    grams = [" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_of_odd_texts(spark):
    got = quality_rules.apply_policy(quality_rules.ledger(docs(spark)), 2).collect()
    want = Counter((r[0], *brute_rules(r[1])) for r in ODD)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert Counter(tuple(r[c] for c in cols) for r in got) == want
    assert all(not r["kept"] for r in got if r["n_words"] < 10 or 5 * r["n_repeat_words"] > r["n_words"])


def test_ablations_count_documents_by_their_bits(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "fail_bits long")
    got = {r["rule"]: tuple(r)[2:] for r in quality_rules.ablations(df, 1).collect()}
    assert got == {"few_words": (3, 2, 4), "repeated_windows": (1, 0, 2)}


def brute_simhash(rows, distance=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = []
    for d, t in rows:
        w = words((t or "").translate(low))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = {d: d for d, _ in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, f) in enumerate(prints):
        for e, g in prints[:i]:
            if (f ^ g).bit_count() <= distance:
                a, b = sorted((top(d), top(e)))
                root[b] = a
    return {d: (f"{f:016x}", top(d)) for d, f in prints}


def near_rows():
    rng = random.Random(7)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", f"w{k}"]) for k in range(200)]
    rows = [(k, " ".join(rng.choices([f"v{i}" for i in range(500)], k=rng.randint(1, 60)))) for k in range(100)]
    for k in range(250):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{k % 40}"
        rows.append((1000 + k, " ".join(w)))
    return rows + [(2000, None), (2001, ""), (2002, "One"), (2003, "one"), (2004, "one two")]


def test_simhash_components_are_those_of_all_pairs(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r[0]: (f"{r[1] & (1 << 64) - 1:016x}", r[2]) for r in simhash.near_duplicates(df).collect()}
    assert got == brute_simhash(rows)


@pytest.mark.parametrize("bucket", [4, 16])
def test_full_probes_are_split_without_loss(spark, bucket):
    want = brute_simhash(near_rows())
    first = {}
    for d, (f, _) in sorted(want.items()):
        first.setdefault(f, d)
    signed = lambda f: int(f, 16) - (1 << 64 if int(f, 16) >> 63 else 0)
    df = spark.createDataFrame([(d, signed(f)) for f, d in first.items()], "id long, fp long")
    got = {r["node"]: r["component"] for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
    assert {d: got.get(d, d) for d in first.values()} == {d: want[d][1] for d in first.values()}


def test_thresholds_come_from_the_cheapest_split():
    assert simhash.allocate([[0, 5, 9], [0, 1, 2], [0, 7, 8]], 3) == [0, 1, -1]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(300))
    copy = base.split()
    copy[100:102] = ["new", "words"]
    rows = [(50, base, "en", "a", 1), (30, " ".join(copy), "en", "b", 1), (90, base, "en", "c", 1), (None, base, "en", "a", 1), *ODD]
    kept = simhash.keep_first(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter([30, 1, 2, 3, 4, 6, 7, 8, None, 9, 10])
    assert set(kept[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"}
    assert simhash.keep_first(docs(spark, [])).count() == 0 and simhash.near_duplicates(docs(spark, [])).count() == 0


def test_shingles_are_those_of_a_plain_cut():
    rng, seen = random.Random(1), {}
    texts = [None, "", "  \n", "a", "A b", "a b c d e", "x\ty\nz w v u t", " lead a b c d e", "ä Ä b c d e"]
    texts += [" ".join(rng.choice("abcAB") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    for group in (texts, [None], [], ["a b c d e f"]):
        values, offsets = simhash.shingle_lists(pa.array(group, pa.string()), 5)
        for t, a, b in zip(group, offsets, offsets[1:], strict=False):
            w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
            want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * (len(w) > 0)
            assert [seen.setdefault(x, h) for x, h in zip(want, values[a:b], strict=True)] == list(values[a:b])
    assert len(set(seen.values())) == len(seen)


URLS = [
    (1, "http://a.example.net/en/1", "a.example.net", "/en/1", "example.net/en/", "allow"),
    (2, "https://B.Example.NET/fr/x?q#f", "b.example.net", "/fr/x", "net/", "block"),
    (3, "http://net", "net", "", None, None),
    (4, "http://example.com/de/?x", "example.com", "/de/", "example.com/de/", "block"),
    (5, "http://notexample.com/de/", "notexample.com", "/de/", None, None),
    (6, "ftp://x.org/fr/a", "x.org", "/fr/a", "org/fr/", "allow"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme", "", "", None, "allow"),
    (9, "http://a.net?x://b.com/de/", "a.net", "", None, None),
    (10, "", "", "", None, "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(u[0], u[1], "h") for u in URLS], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filters.judge(df).collect()}
    for i, _, host, path, rule, verdict in URLS:
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert verdict is None or got[i]["verdict"] == verdict
    assert url_filters.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("wide", [0, 12])
def test_mined_rules_are_those_of_all_combinations(spark, wide):
    """By FP-growth, and level by level where rows are wider than that."""
    rng = random.Random(9)
    rows = []
    for k in range(240):
        own = sorted(rng.sample("abcde", rng.randint(1, 4)))
        rows.append((k, own, "block" if {"a", "b"} <= set(own) or "e" in own or {"b", "c", "d"} <= set(own) else "allow"))
    df = spark.createDataFrame(rows, "id long, tokens array<string>, verdict string")
    found = url_filters.mine(df.select("tokens", "verdict"), 0.02, 0.97, wide).collect()
    got = {tuple(r["antecedent"]) for r in found}
    for r in found:
        has = [x for x in rows if set(r["antecedent"]) <= set(x[1])]
        assert r["confidence"] == pytest.approx(sum(x[2] == "block" for x in has) / len(has)) and r["support"] == pytest.approx(sum(x[2] == "block" for x in has) / len(rows))
    from itertools import combinations

    least = max(0.02 * 240, url_filters.MIN_COUNT)
    rules = []
    for size in (1, 2, 3):
        for c in combinations("abcde", size):
            has = [r for r in rows if set(c) <= set(r[1])]
            hit = sum(r[2] == "block" for r in has)
            if hit >= least and hit / len(has) >= 0.97 and not any(set(x) < set(c) for x in rules):
                rules.append(c)
    assert got == set(rules) and {len(c) for c in rules} == {1, 2, 3}


def test_long_urls_that_repeat_are_mined_in_no_time(spark):
    """30 segments that always come together, and 30 that come in a chain, blocked in part: no subsets are listed."""
    rows = [([f"path:{k}" for k in range(30)], "block")] * 1000
    rows += [([f"half:{k}" for k in range(30)], v) for v in ("block", "allow")] * 300
    rows += [([f"chain:{k}" for k in range(n + 1)], v) for n in range(30) for v in ("block", "allow")] * 20
    rows += [(["half:3", "chain:2"], "block")] * 900
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {tuple(r["antecedent"]) for r in url_filters.mine(df).collect()}
    assert got == {(f"path:{k}",) for k in range(30)} | {("chain:2", "half:3")}


def test_tokens_that_define_the_list_are_in_no_rule(spark):
    urls = [(k, f"https://{'spam' if k % 3 else 'shop'}{k % 7}.example.{'net' if k % 2 else 'com'}/{'de' if k % 4 else 'en'}/x{k % 2}") for k in range(400)]
    got = url_filters.judge(spark.createDataFrame(urls, "page_id long, url string")).collect()
    used = {t for r in got for x in r["mined_rules"].split("; ") for t in x.split(" ")}
    assert not used & set(url_filters.defining()) and "path:x0" in used


def dense_fit(x, earlier, y):
    """fit_linear() on a dense matrix of terms that are there or not."""
    n, size, k = *x.shape, earlier.shape[1]
    scale = np.log((x[y == 1].sum(axis=0) + 1) / (y.sum() + 2)) - np.log((x[y == 0].sum(axis=0) + 1) / (n - y.sum() + 2))
    scale[np.abs(scale) < 0.5] = 0
    v = x * scale
    unit = np.sqrt(max((v * v).sum(axis=1).mean(), 1e-9))
    full = np.column_stack([v / unit, earlier, np.ones(n)])
    w = ahead = np.zeros(size + k + 1)
    for t in range(toxicity.STEPS):
        grad = full.T @ (1 / (1 + np.exp(-full @ ahead)) - y) / n + toxicity.PENALTY * ahead
        last, w = w, ahead - toxicity.RATE * grad
        ahead = w + t / (t + 3) * (w - last)
    return np.concatenate([w[:size] * scale / unit, w[size:]])


def brute_chain(texts, marks):
    """[(weights, threshold)] of each category, model after model."""
    docs = sorted(marks)
    found = {d: toxicity.terms(texts[d]) for d in docs}
    n = Counter(t for d in docs for t in found[d])
    vocabulary = sorted(t for t, c in n.items() if c >= toxicity.LEAST_DOCUMENTS)
    x = np.array([[t in found[d] for t in vocabulary] for d in docs], float)
    fold = np.array([spark_hash((d, 8), (1, 4)) % toxicity.FOLDS for d in docs])
    earlier, out = np.zeros((len(docs), 0)), []
    for k in range(len(toxicity.CATEGORIES)):
        y = np.array([marks[d][k] for d in docs], float)
        held = np.zeros(len(docs))
        for f in range(toxicity.FOLDS):
            w = dense_fit(x[fold != f], earlier[fold != f], y[fold != f])
            held[fold == f] = 1 / (1 + np.exp(-(np.column_stack([x, earlier, np.ones(len(docs))])[fold == f] @ w)))
        best = [(2 * y[held >= t / 100].sum() / max((held >= t / 100).sum() + y.sum(), 1), t) for t in range(1, 100)]
        top = [t for s, t in best if s == max(best)[0]]
        out.append((dense_fit(x, earlier, y), top[len(top) // 2] / 100))
        earlier = np.column_stack([earlier, held])
    return out


def test_toxicity_of_labelled_documents(spark):
    rng = random.Random(10)
    plain = [f"word{k}" for k in range(200)]
    rows, marks = [], []
    for k in range(400):
        bad = k % 4 == 0
        text = rng.choices(plain, k=30) + (rng.choices(["grob1", "grob2", "grob3"], k=2) if bad else [])
        rows.append((k, " ".join(text)))
        marks.append((k, 0 if k % 8 == 0 else 1, int(bad)))
    marks += [(1000, None, 1)]
    d = spark.createDataFrame([*rows, (500, None), (501, "")], "doc_id long, text string")
    labels = lambda m: toxicity.known_labels(spark.createDataFrame(m, "doc_id long, quality int, toxic int"))
    chain = toxicity.fit_chain(toxicity.label_documents(d, labels(marks + marks[:50])))
    plain_chain = brute_chain({k: t for k, t in rows}, {k: (1 - q, t) for k, q, t in marks if q is not None})
    for w, t, (want, threshold) in zip(chain.weights, chain.thresholds, plain_chain, strict=True):
        assert np.allclose(w, want, rtol=1e-5, atol=1e-7) and t == threshold
    got = {r["doc_id"]: r for r in toxicity.score(d, chain).collect()}
    assert len(got) == 402
    assert sum(got[k]["toxic"] == (k % 4 == 0) for k in range(400)) >= 396
    assert not got[500]["toxic"] and not got[501]["toxic"]
    assert toxicity.fit_chain(toxicity.label_documents(d, labels([]))) is None
    long = spark.createDataFrame([(1, "grob1 grob2 " + "word1 word2 " * 100_000), (1, "grob1 grob2 grob3"), (1, "grob1 grob2 grob3"), (2, None)], "doc_id long, text string")
    assert [r["toxic"] for r in toxicity.score(long, chain).orderBy("doc_id").collect()] == [True, True, True, False]
    assert toxicity.score(long.limit(0), chain).count() == 0
