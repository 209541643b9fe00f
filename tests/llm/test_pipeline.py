"""Each stage of the pipeline against brute force on its own input, and the chain of all."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from shelftally.llm import language, mixing

from test_dedup import bits_of, plain, reachable
from test_mixing import by_hand

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage got and kept, read back as the next one reads them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "docs")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def test_names_and_columns(stages):
    assert list(stages) == ["language_id", "exact_dedup", "simhash_near_dedup", "mix_sources", "sentencepiece"]
    for name, (_, after) in list(stages.items())[:-1]:
        assert after.columns == COLUMNS, name


def test_language(stages):
    before, after = stages["language_id"]
    kept = {r["doc_id"] for r in after.collect()}
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(before).collect()}
    assert kept == {i for i, (lang, score) in found.items() if lang != "und" and score >= 0.5}
    assert len(kept) >= 0.99 * before.count()


def test_exact(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before.collect():
        rank = (-len(r["text"]), r["doc_id"])
        best[plain(r["text"])] = min(best.get(plain(r["text"]), rank), rank)
    assert {r["doc_id"] for r in after.collect()} == {i for _, i in best.values()} and after.count() == len(best)


def test_near(stages):
    before, after = stages["simhash_near_dedup"]
    want = reachable({r["doc_id"]: bits_of(r["text"]) for r in before.collect()})
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(want.values()))


def test_mix(stages):
    before, after = stages["mix_sources"]
    rows = {r["doc_id"]: r for r in before.collect()}
    size, longest, taken, copies = {}, {}, {}, {}
    for r in rows.values():
        n = len(r["text"].split())
        size[r["source"]] = size.get(r["source"], 0) + n
        longest[r["source"]] = max(longest.get(r["source"], 0), n)
    for r in after.collect():
        assert r == rows[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
        taken[r["source"]] = taken.get(r["source"], 0) + len(r["text"].split())
    want = by_hand(size)
    assert max(copies.values()) <= mixing.MOST_COPIES
    for s in size:
        rate = want[s] / size[s]
        assert abs(taken.get(s, 0) - want[s]) <= longest[s]
        assert {copies.get(i, 0) for i, r in rows.items() if r["source"] == s} <= {int(rate), int(rate) + 1}


def test_tokens(stages):
    before, after = stages["sentencepiece"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def expected(r):
        ids = library.encode(r["text"])
        return r["doc_id"], tuple(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    got = sorted((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in after.collect())
    assert got == sorted(map(expected, before.collect()))


def test_whole_run(spark, stages):
    got = sorted((r["doc_id"], len(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r["doc_id"], len(r["ids"])) for r in stages["sentencepiece"][1].collect())


def test_each_stage_is_computed_once(spark, monkeypatch):
    """A later stage that reads its rows twice finds the same ones, not rows computed again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def first(spark, docs, sf_dir):
        return docs.select("doc_id").mapInArrow(counted, "doc_id long")

    def second(spark, docs, sf_dir):
        docs.agg({"doc_id": "max"}).collect()
        return docs.agg({"doc_id": "min"})

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", first), ("second", second)])
    corpus_pipeline.run(spark, SF).collect()
    assert seen.value == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_nulls_and_nothing(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the same words of a text " * 9, "en", "a", 1), (2, "the same words of a text " * 9, None, None, None), (None, None, None, None, None), (None, "andere Worte " * 9, "de", "a", 2), (5, "", "en", "b", 0)]
    for frame in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SF).count() >= 0


CLASHING = ["lang_pred", "Score", "print", "LEAST", "none", "taken_id", "taken_size", "turn", "digest", "possible", "__id", "__print", "__lang_pred", "label", "place"]


def test_other_columns_may_have_any_name(spark):
    """Columns with the names that a stage might choose for itself go through, and change nothing."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    words = ["the same plain words of a text", "andere Worte in einem Satz hier", "quelques mots de plus pour le texte"]
    rows = [(10 * i + k, f"{w} {'abcdefgh'[i]} " * 9, ("en", "de", "fr")[k], "ab"[i % 2], i) for i in range(8) for k, w in enumerate(words)]
    rows += [(100, rows[0][1], "en", "a", 1), (101, None, None, None, None), (101, None, None, None, None)]
    plainly = spark.createDataFrame(rows, kinds)
    clashing = spark.createDataFrame([(*r, *(f"{c} of {r[0]}" for c in CLASHING)) for r in rows], f"{kinds}, {', '.join(f'{c} string' for c in CLASHING)}")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want, got = stage(spark, plainly, SF), stage(spark, clashing, SF)
        assert got.columns == clashing.columns, name
        assert sorted(map(repr, got.select(*COLUMNS).collect())) == sorted(map(repr, want.collect())), name
        for r in got.collect():
            assert [r[c] for c in CLASHING] == [f"{c} of {r['doc_id']}" for c in CLASHING], name
        kept.append(got.count())
    assert kept[1] < len(rows) and all(kept)
