"""Base counts and the language model against plain Python, and the defined cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelftally.llm import common, perplexity

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, half int, n_words long, value double"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    return spark.createDataFrame([(*r, 9, 0.5) for r in rows], DOCS)


def counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_of_all_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r["doc_id"]: counts(r["text"]) for r in rows.collect()}
    got = perplexity.quality(rows).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in got} == want
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["lowest"] <= r["perplexity"] <= r["highest"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r["kept"] for r in got if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(clean) >= 0.97 * len(clean)


def test_counts_of_odd_texts():
    rng = random.Random(2)
    texts = ["", None, " \n\t", "a", "a\na\n\n a\na", "x y z u v x y z u v w", "é # é\n# \n#", "\x0ba\x0cb\rc", "a" * 100_000, "r " * 9]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "d|", "é ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    got = []
    for part in common.slices(iter([batch]), "text", 3000):
        got += list(zip(*(v.tolist() for v in perplexity.base_counts(part).values()), strict=True))
    assert got == [counts(t) for t in texts]


class Plain:
    """Modified Kneser-Ney over the same padded bytes, with dictionaries."""

    def __init__(self, texts, order=perplexity.ORDER):
        self.order, self.count = order, {order: Counter()}
        for text in texts:
            for gram in self.grams(text):
                self.count[order][gram] += 1
        for n in range(order - 1, 0, -1):
            self.count[n] = Counter(g[1:] for g in self.count[n + 1])
        self.less, self.all, self.rest = {}, {}, {}
        for n, table in self.count.items():
            how_many = Counter(table.values())
            self.less[n] = perplexity.discounts([how_many[k] for k in (1, 2, 3, 4)])
            self.all[n], self.rest[n] = Counter(), defaultdict(float)
            for g, c in table.items():
                self.all[n][g[:-1]] += c
                self.rest[n][g[:-1]] += self.less[n][min(c, 3) - 1]

    def grams(self, text):
        data = bytes(4) + re.sub(rb"[\x09-\x0d]", b" ", (text or "").encode())
        return [data[i : i + 5] for i in range(len(data) - 4)]

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        h = gram[:-1]
        if not self.all[n][h]:
            return self.p(gram[1:])
        c = self.count[n][gram]
        own = max(c - self.less[n][min(c, 3) - 1], 0) if c else 0
        return (own + self.rest[n][h] * self.p(gram[1:])) / self.all[n][h]

    def log_probability(self, text):
        return sum(math.log(self.p(g)) for g in self.grams(text))


def test_model_against_dictionaries(spark):
    rng = random.Random(7)
    syllables = ["ta", "re", "mi", "no ", "lu", "s. ", "é", "\n"]
    rows = [(i, "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 60))), "x", i % 2) for i in range(60)] + [(99, "zq#zq", "x", 0), (98, None, "x", 1)]
    frame = docs(spark, rows)
    models = perplexity.train(frame)
    plain = [Plain([t for _, t, _, half in rows if half != h]) for h in (0, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string())], ["text"])
    half = np.array([r[3] for r in rows])
    for part in common.slices(iter([batch]), "text"):
        got = perplexity.log_probabilities(part, half, models)
    want = [plain[h].log_probability(t) for _, t, _, h in rows]
    assert got.tolist() == pytest.approx(want, rel=1e-3, abs=1e-3)


def test_scores_from_shards_are_exact(spark, monkeypatch):
    """Every n-gram has its own value, in whichever shard and chunk, with the model left in Spark."""
    monkeypatch.setattr(perplexity, "CHUNK_BYTES", 700)
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([*range(32, 127), 0xE9, 0x65E5])) for _ in range(rng.randrange(400))) for _ in range(120)] + ["", None, "a" * 5000]
    rows = [(7, t, "x", i % 2) for i, t in enumerate(texts)]
    frame = docs(spark, rows).repartition(3)
    plain = [Plain([t for _, t, _, half in rows if half != h]) for h in (0, 1)]
    got = perplexity.score(frame, perplexity.kneser_ney(common.cut(perplexity.count_grams(frame)))).collect()
    want = sorted((len((t or "").encode()), plain[h].log_probability(t)) for _, t, _, h in rows)
    found = sorted((r["n_bytes"], r["log_probability"]) for r in got)
    assert [n for n, _ in found] == [n for n, _ in want]
    assert [p for _, p in found] == pytest.approx([p for _, p in want], rel=1e-6, abs=1e-4)


def test_no_two_grams_share_a_value():
    """Keys that fell into one of 2**25 slots before: a known n-gram does not answer for an unknown one."""
    rng = np.random.default_rng(4)
    known = np.unique(rng.integers(1 << 32, 1 << 40, 200_000, dtype=np.uint64))
    model = perplexity.Model(known | np.uint64(perplexity.ORDER << 56), np.full(len(known), -1.0))
    other = np.setdiff1d(rng.integers(1 << 32, 1 << 40, 50_000, dtype=np.uint64), known)
    assert (model.log_probability(other) == math.log(1 / 256)).all() and (model.log_probability(known) == -1).all()


def test_probabilities_of_a_context_sum_to_one(spark):
    frame = docs(spark, [(i, f"some text {i} and more of it", "x", i % 2) for i in range(40)])
    model = perplexity.train(frame)[0]
    for context in (b"text", b"\0\0\0\0", b"and ", b"qqqq"):
        keys = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert np.exp(model.log_probability(keys)).sum() == pytest.approx(1, abs=0.02)


def test_counts_do_not_depend_on_partitions(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("text", F.lit(0).alias("half"))
    one = perplexity.count_grams(frame.coalesce(1)).agg(F.sum("c"), F.count("*"), F.bit_xor(F.xxhash64("gram", "c"))).first()
    many = perplexity.count_grams(frame.repartition(9)).agg(F.sum("c"), F.count("*"), F.bit_xor(F.xxhash64("gram", "c"))).first()
    assert tuple(one) == tuple(many)
    assert one[0] == sum(len((r["text"] or "").encode()) for r in frame.collect())


def test_defined_cases(spark):
    prose = "these are some words of a text that is long enough to pass"
    rows = [(1, None, "en", 0), (2, "", None, 0), (3, prose, None, 0), (3, prose, None, 0), (None, prose, "en", 0), (5, "word " * 100_000, "en", 0)]
    got = perplexity.quality(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got}
    assert found[1]["base_failed"] and found[2]["base_failed"] and not found[2]["kept"]
    assert found[5]["n_repeat_words"] == 100_000 and found[5]["base_failed"]
    assert found[3]["kept"] and found[None]["n_words"] == 13
    assert perplexity.quality(docs(spark, [])).count() == 0


def test_a_band_of_one_bin_holds_its_texts(spark):
    rows = [(7, f"{' '.join(f'{w}{i}' for w in ('some', 'words', 'of', 'a', 'text'))} and the other words of it", str(i), 0) for i in range(20)]
    assert all(r["kept"] for r in perplexity.quality(docs(spark, rows)).collect())


def test_documents_are_dealt_in_fewer_bytes_than_they_have(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", (F.col("doc_id") % 2).cast("int").alias("half"))
    size = frame.agg(F.sum(F.octet_length("text"))).first()[0]
    dealt = frame.coalesce(1).mapInArrow(perplexity._deal(12), perplexity._DEALT)
    assert dealt.agg(F.sum(F.octet_length("block"))).first()[0] < 0.85 * size


def test_outlier_is_rejected(spark):
    rng = random.Random(1)
    words = ["hello", "there", "general", "of", "the", "old", "republic", "we", "meet"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)), "en", 0) for i in range(200)]
    junk = " ".join("".join(rng.choice("0123456789abcdefghijkXYZ") for _ in range(12)) for _ in range(100))
    kept = {r["doc_id"]: r["kept"] for r in perplexity.quality(docs(spark, [*rows, (1000, junk, "en", 0)])).collect()}
    assert not kept[1000] and sum(kept.values()) >= 198


def test_low_orders_are_kept_in_one_partition(spark, monkeypatch):
    kept, cut = [], perplexity.common.cut

    def seen(df):
        kept.append(cut(df))
        return kept[-1]

    counts = spark.createDataFrame([(i % 2, i * 7919, 1) for i in range(500)], "model int, gram long, c long").repartition(3)
    monkeypatch.setattr(perplexity.common, "cut", seen)
    values = perplexity.kneser_ney(counts)
    low = [df for df in kept if df.columns == ["model", "gram", "c"]]
    assert len(low) == perplexity.ORDER - 1
    assert [df.rdd.getNumPartitions() for df in low[-perplexity.LOW :]] == [1] * perplexity.LOW
    assert values.where("kind = 1").count() > 0
