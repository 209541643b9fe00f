"""Quality and language: held-out accuracy, the parts of training, and the defined cases."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shelftally.llm import common, language, quality_classifier

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, score double, label string, place long"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 0.1, "clash", 3) for r in rows], DOCS)


def texts(values):
    batch = pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["text"])
    return next(common.slices(iter([batch]), "text", 1 << 30))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# -- quality ----------------------------------------------------------------------------


def test_quality_on_held_out_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    got = quality_classifier.classify(rows, labels).collect()
    assert len(got) == rows.count()
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    good, bad = (np.array([s for s, y in held if y == k]) for k in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert (good >= 0.5).mean() > 0.99 and (bad < 0.5).mean() > 0.75


def test_features_by_hand():
    values = ["the cat the cat", "", None, "a%%% b", "é-é é"]
    part = texts(values)
    begin, at, value = quality_classifier.features(part)
    for i, text in enumerate(values):
        tokens = re.findall(r"\w+|[^\w\s]+", text or "")
        distinct = len(set(tokens)) + len(set(zip(tokens, tokens[1:], strict=False)))
        own = value[begin[i] : begin[i + 1]]
        assert len(own) == distinct
        if distinct:
            assert math.isclose(float((own.astype(float) ** 2).sum()), quality_classifier.NORM**2, rel_tol=1e-5)
    assert len(set(at[begin[0] : begin[1]].tolist())) == 4


def test_updates_against_the_formula():
    leader = quality_classifier.Leader(4)
    at, x = np.array([0, 2, 4]), np.array([0.5, 2.0, 1.0])
    z, n = np.zeros(5), np.zeros(5)
    a, b, l1, l2 = (getattr(quality_classifier, k) for k in ("ALPHA", "BETA", "L1", "L2"))
    for label in (1, 0, 1, 1, 1):
        w = [0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2) for i in range(5)]
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
        for i, v in zip(at, x, strict=True):
            g = (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
            n[i] += g * g
        leader.learn(at, x, label)
    assert leader.z == pytest.approx(z) and leader.n == pytest.approx(n)


def test_quality_defined_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "good words here", "x"), (3, "good words here", "x"), (None, "bad %%% words", "x"), (5, "w " * 200_000, "x")]
    frame = docs(spark, rows)
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (77, 0), (5, None)], "doc_id long, quality int")
    got = quality_classifier.classify(frame, labels).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r["score"] for r in got}
    assert found[1] == found[2]
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_classifier.classify(frame, nothing).collect()} == {0.5}
    assert quality_classifier.classify(docs(spark, []), labels).count() == 0


# -- language ---------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in rows.select("doc_id", "lang").collect()}
    got = language.identify(rows).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert sum(held) > 0.99 * len(held)


def test_windows_cover_whole_texts():
    rng = np.random.default_rng(0)
    for size in [0, 1, 2, 124, 125, 126, 127, 128, 129, 250, 251, 253, 254, 1000]:
        data = rng.integers(1, 255, size, dtype=np.uint8)
        starts, row = language.windows(data, np.array([0, size]))
        block = language.cut_windows(data, starts, np.full(len(starts), size))
        pairs = {(data[i], data[i + 1], data[i + 2], data[i + 3]) for i in range(size - 3)}
        seen = {tuple(b[i : i + 4]) for b in block for i in range(language.STEP)}
        assert pairs <= seen and len(starts) == (0 if size == 0 else max(1, -(-(size - 3) // language.STEP)))
        assert not size or (data[:, None] == block.ravel()[None]).any(axis=1).all()


def test_compiled_network_and_gradients():
    rng = np.random.default_rng(1)
    network = language.Network.new(["a", "b", "c"])
    block = rng.integers(0, 256, (5, language.LENGTH), dtype=np.uint8)
    label = np.array([0, 1, 2, 1, 0])
    plain = network.log_softmax(network.pooled(block)[0])
    assert network.compiled().log_probabilities(block) == pytest.approx(plain, abs=1e-4)

    def loss():
        return -network.log_softmax(network.pooled(block)[0])[np.arange(5), label].mean()

    for i in range(len(network.parameters())):  # in double precision, against finite differences
        network.filters = [f.astype(float) for f in network.filters]
        network.bias, network.out, network.out_bias = (x.astype(float) for x in (network.bias, network.out, network.out_bias))
        p = network.parameters()[i]
        grad = network.gradients(block, label)[i]
        place = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        before = p[place]
        p[place] = before + 1e-6
        up = loss()
        p[place] = before - 1e-6
        down = loss()
        p[place] = before
        assert (up - down) / 2e-6 == pytest.approx(grad[place], rel=1e-3)


def test_language_defined_cases(spark):
    english, german = "the cat and the other dog of this house ", "der Hund und die Katze über diesem Haus "
    rows = [(i, english * 4, "en") for i in range(30)] + [(100 + i, german * 4, "de") for i in range(30)]
    odd = [(201, None, "en"), (202, "", None), (203, "123 ... !!", "de"), (None, german, "de"), (205, english * 20_000, "en"), (206, "日本", None), (206, "日本", None)]
    got = [r for r in language.identify(docs(spark, rows + odd)).collect() if r["doc_id"] is None or r["doc_id"] > 200]
    assert len(got) == len(odd)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert found[201] == found[202] == found[203] == ("und", 0.0)
    assert found[None][0] == "de" and found[205][0] == "en" and found[206][0] in ("en", "de")
    unlearned = language.identify(docs(spark, [(1, english, None)])).collect()
    assert [tuple(r)[2:] for r in unlearned] == [("und", 0.0)]
    assert language.identify(docs(spark, [])).count() == 0


def test_training_agrees_between_runs(spark):
    rows = [(i, f"words of text number {i} and more", "en" if i % 2 else "xx") for i in range(40)]
    frame = docs(spark, rows)
    marks = {hashlib.sha256(b"".join(p.tobytes() for p in language.train(f).parameters())).hexdigest() for f in (frame, frame.repartition(5))}
    assert len(marks) == 1
