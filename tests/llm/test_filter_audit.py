"""The matrix against counters of words, the audit against every document walked through every order."""

import re
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from shelftally.llm import common, filter_audit, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, shard string, bucket long, n long, part string"
LABELS = "doc_id long, quality int, toxic int, part string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", 1, 1, "clash") for i, t, lang in rows], DOCS)


def marks(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


def failing(text):
    words = WORD.findall(text)
    out = {"A"} if len(words) < 100 else set()
    if 100 * len(set(words)) < 80 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
        out.add("C")
    return out | ({"D"} if re.search("[#$%&*|]", text) else set())


def expected(docs, labels):
    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    ids = defaultdict(set)
    for i, text, _ in docs:
        ids[text].add(i)
    walked = []
    for i, text, part in docs:
        smaller = any(j is not None and (i is None or j < i) for j in ids[text])
        mine = [r for r in labels if i is not None and r[0] == i]
        fails = failing(text) | ({"E"} if smaller else set())
        walked.append((part, fails, any(q == 1 for _, q, _ in mine), any(x == 1 for *_, x in mine)))
    out, sums = {}, Counter()
    for order in permutations("ABCDE"):
        for part in {d[2] for d in docs}:
            standing = [w for w in walked if w[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [w for w in standing if letter in w[1]]
                all_failing = sum(w[0] == part and letter in w[1] for w in walked)
                standing = [w for w in standing if letter not in w[1]]
                alone = sum(w[0] == part and w[1] == {letter} for w in walked)
                sums[part, letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(standing), len(gone), all_failing - len(gone), alone, sum(w[2] for w in gone), sum(w[3] for w in gone),
                ]
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(frame):
    measures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in measures) for r in frame.collect()}


LONG = " ".join(f"word{i}" for i in range(120))
TEXTS = [None, "", " \t\x0b", "A", "AB cd", LONG, LONG + " #", LONG.upper(), "the same " * 80, "ça\x1fva là", "x" * 300_000, "a b\x0cc\x0dd"]
document = st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from(TEXTS), st.sampled_from(["en", "de", None, ""]))
label = st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from([0, 1, None]), st.sampled_from([0, 1, None]))


@settings(max_examples=6, deadline=None)
@given(st.lists(document, max_size=20), st.lists(label, max_size=8))
def test_audit(spark, docs, labels):
    assert got(filter_audit.audit(documents(spark, docs), marks(spark, labels))) == expected(docs, labels)


def test_one_dictionary_for_all_shards(spark):
    """A word is one column in every shard, and rows of the matrix are the counts of the words."""
    rows = [(i, " ".join(f"w{(i * k) % 97} é{k % 5}" for k in range(i % 40)), "en") for i in range(300)] + [(300, None, None)]
    with common.Scratch(spark) as scratch:
        shards = filter_audit.term_matrix(documents(spark, rows).repartition(5), scratch).collect()
    texts = {i: t or "" for i, t, _ in rows}
    seen = []
    for shard in shards:
        begins, columns, counts = (common.unpacked(shard[n]) for n in ("rows", "columns", "counts"))
        for at, doc in enumerate(shard["doc_id"]):
            cells = dict(zip(columns[begins[at] : begins[at + 1]].tolist(), counts[begins[at] : begins[at + 1]].tolist(), strict=True))
            words = Counter(WORD.findall(texts[doc]))
            assert sorted(cells.values()) == sorted(words.values()) and shard["print"][at] == sha256(texts[doc].encode()).digest()
            seen.append((doc, cells, words))
    assert len(shards) > 1 and len(seen) == len(rows)
    # columns are told apart by the documents that have them
    by_column, by_word = defaultdict(set), defaultdict(set)
    for doc, cells, words in seen:
        for c in cells:
            by_column[c].add((doc, cells[c]))
        for w in words:
            by_word[w].add((doc, words[w]))
    assert Counter(map(frozenset, by_column.values())) == Counter(map(frozenset, by_word.values()))


def test_term_counts_of_nothing():
    begins, columns, counts, words = filter_audit.term_counts(np.zeros(0, np.uint8), np.zeros(3, np.int64))
    assert begins.tolist() == [0, 0, 0] and not len(columns) and not len(counts) and not len(words)


def test_copies_of_one_text(spark):
    docs = [(i, "one text of a large group", "en") for i in range(4000)] + [(None, "one text of a large group", "de"), (0, "one text of a large group", "de")]
    assert got(filter_audit.audit(documents(spark, docs), marks(spark, [(0, 1, 0), (1, 1, 1), (1, 0, None)]))) == expected(docs, [(0, 1, 0), (1, 1, 1)])


def test_query_writes_nothing_that_stays(spark):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(common.shared_folder(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    tables = lambda: {str(s.getPath()) for s in files.listStatus(folder) if s.getPath().getName().startswith("table-")}
    before = tables() if files.exists(folder) else set()
    assert queries.op12_filter_audit(spark, SF).count() % 600 == 0
    assert tables() == before
