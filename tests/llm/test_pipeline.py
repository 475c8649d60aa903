import random

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from reelframe.llm import quality_rules, simhash, suffix_dedup
from reelframe.llm.common import materialize
from tests.oracle import SF

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = materialize(stage(spark, docs, SF), name)
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(stages[n].columns == COLUMNS for n, _ in corpus_pipeline.STAGES[:-1])


def test_clean_documents_stay_and_rejected_ones_go(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    by = lambda df: {r["quality"]: r["count"] for r in df.join(labels, "doc_id").groupBy("quality").count().collect()}
    judged = quality_rules.ledger(stages["documents"]).filter(F.col("fail_bits").bitwiseAND(F.lit(quality_rules.BASE)) == 0)
    every, kept, sound = by(stages["documents"]), by(stages["quality_rules"]), by(judged)
    assert kept[1] == sound[1] and kept.get(0, 0) <= 0.2 * every[0]


ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "a text without an id but with more than ten words in it so that it is kept", "en", None, 1),
    (4, " ".join(f"word{k}" for k in range(60_000)), "en", "b", 1),
    (5, " ".join(f"word{k}" for k in range(59_000)), "en", "b", 1),
]


def test_stages_keep_clashing_columns_and_long_and_odd_texts(spark):
    names = ["n_words", "fail_bits", "kept", "row", "id", "size", "spans", "runs"]
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"own {c}") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = materialize(stage(spark, d, SF), name)
        assert d.columns == COLUMNS + names
        assert all(r[c] == f"own {c}" for r in d.select(*names).collect() for c in names)
        if name == "near_duplicates":
            assert sorted((r["doc_id"] for r in d.collect()), key=str) == [1, 4, None]
    assert d.count() > 0


def test_stages_of_an_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, d, SF).count() == 0


def test_no_copies_are_left(stages):
    texts = stages["near_duplicates"].select("text")
    assert texts.count() == texts.distinct().count()


def test_mix_takes_what_all_sources_have(stages):
    n = lambda df: df.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert n(stages["mixing"]) == pytest.approx(n(stages["suffix_dedup"]), rel=0.05)


def test_run_is_the_stages_in_turn(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == stages["packing"].count()


def _groups(texts):
    """By brute force: the least index of the group of near copies of each text."""
    def shingles(text):
        w = text.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                p, q = sorted((top(i), top(j)))
                root[q] = p
    return [top(i) for i in range(len(texts))]


def _kept(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())


def _words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def test_copies_of_one_text_are_a_group_though_they_are_far_from_each_other(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(3):
        base = _words(rng, 300)
        texts.append(base)
        for _ in range(60):
            copy = list(base)
            for at in rng.sample(range(300), 5):
                copy[at] = f"new{rng.random()}"
            texts.append(copy)
    rng.shuffle(texts)
    texts = [" ".join(t) for t in texts]
    assert _kept(spark, texts) == sorted(set(_groups(texts)))


def test_reordered_texts_in_a_group_above_the_bucket_size_are_one_group(spark):
    rng = random.Random(6)
    parts = [" ".join(_words(rng, 50)) for _ in range(8)]
    texts = [" ".join(rng.sample(parts, 8)) for _ in range(300)]
    assert _kept(spark, texts) == sorted(set(_groups(texts)))


def test_appended_and_cut_passages_are_found(spark):
    rng = random.Random(7)
    texts = []
    for n in (100, 300, 900):
        for part in (0.1, 0.15, 0.2, 0.24):
            for _ in range(8):
                base = _words(rng, n)
                texts += [base, base + _words(rng, int(n * part))] if rng.random() < 0.5 else [base, base[int(n * part * 0.8) :]]
    texts = [" ".join(t) for t in texts]
    assert _kept(spark, texts) == sorted(set(_groups(texts)))


def test_a_group_of_many_near_copies_keeps_one(spark):
    rng = random.Random(9)
    base = _words(rng, 300)
    texts = []
    for _ in range(700):
        copy = list(base)
        for at in rng.sample(range(300), rng.randint(2, 5)):
            copy[at] = f"new{rng.random()}"
        texts.append(" ".join(copy))
    assert _kept(spark, texts) == sorted(set(_groups(texts)))


def test_a_passage_that_many_texts_share_links_none_of_them(spark):
    rng = random.Random(10)
    passage = _words(rng, 60)
    texts = [" ".join([*_words(rng, rng.randint(20, 80)), *passage]) for _ in range(250)]
    assert _kept(spark, texts) == sorted(set(_groups(texts)))


def _passage_rows(rng, n, passage):
    return [" ".join([*_words(rng, 150), *(passage if k % 10 == 0 else _words(rng, 30)), *_words(rng, 120)]) for k in range(n)]


@pytest.mark.parametrize("n", [1000, 2000])
def test_rows_that_share_a_passage_do_not_all_meet(spark, monkeypatch, n):
    """A passage in every tenth row, rare in the sample that guides the first order of shingles."""
    rng, met = random.Random(11), []
    monkeypatch.setattr(simhash, "SAMPLE", n // 100)

    def written(df, name):
        out = materialize(df, name)
        if name == "met":
            met.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", written)
    texts = _passage_rows(rng, n, _words(rng, 30))
    texts += [texts[0] + " one more word", texts[5] + " and here another"]
    assert _kept(spark, texts) == list(range(n))
    assert sum(met) <= n // 10


def test_rows_of_a_crowded_passage_are_still_compared(spark, monkeypatch):
    rng = random.Random(12)
    passage = _words(rng, 60)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    monkeypatch.setattr(simhash, "CROWD", 3)
    texts = []
    for _ in range(60):
        base = [*_words(rng, 30), *passage, *_words(rng, 60)]
        texts += [base, base + _words(rng, 20), base[15:]][: rng.randint(1, 3)]
    texts = [" ".join(t) for t in texts]
    want = sorted(set(_groups(texts)))
    assert _kept(spark, texts) == want and len(want) < len(texts)


def _colliding_texts():
    """Two texts of different words with equal XXH64 of seed 42: the second stripe makes up for the first one."""
    mask, p2 = (1 << 64) - 1, 14029467366897019727
    p1 = 11400714785074694791
    rotate = lambda x: (x << 31 | x >> 33) & mask
    rng = random.Random(13)
    letters = b"abcdefghijklmnopqrstuvwxyz"
    start = (42 + p1 + p2) & mask
    after = lambda s, x: rotate((s + int.from_bytes(x, "little") * p2) & mask) * p1 & mask
    first, second = b"abcdefgh", b"ijklmnop"
    tail = bytes(rng.choices(letters, k=24))
    goal = after(start, first)
    while True:
        other = bytes(rng.choices(letters, k=8))
        made = (int.from_bytes(second, "little") + (goal - after(start, other)) * pow(p2, -1, 1 << 64)) & mask
        found = made.to_bytes(8, "little")
        if other != first and all(0x20 <= b < 0x7F for b in found):
            return [(a + tail + b + tail).decode() for a, b in ((first, second), (other, found))]


def test_texts_whose_64_bit_hashes_collide_are_two(spark):
    a, b = _colliding_texts()
    assert a != b and xxhash.xxh64_intdigest(a, 42) == xxhash.xxh64_intdigest(b, 42)
    assert _kept(spark, [a, b, a]) == [0, 1]


def test_passages_of_texts_whose_64_bit_hashes_collide_are_their_own(spark):
    a, b = _colliding_texts()
    rng = random.Random(14)
    tail = "".join(rng.choices("klmnopqrst", k=300))
    assert xxhash.xxh64_intdigest(a + tail, 42) == xxhash.xxh64_intdigest(b + tail, 42)
    docs = spark.createDataFrame([(1, a + tail), (1, b + tail)], "doc_id long, text string")
    cut = sorted((r["text"] for r in suffix_dedup.remove_repeats(docs).collect()), key=len)
    # two documents: the tail, and what both share before it, stays in one of them
    assert cut[1] in (a + tail, b + tail) and tail not in cut[0]
    assert cut[0][:8] in (a[:8], b[:8]) and cut[0][:8] != cut[1][:8]
