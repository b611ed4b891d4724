import os
import random

import pytest
from pyspark.sql import functions as F

from quietlines.llm import packing, subjects, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Vocabulary(f.read())


@pytest.fixture(scope="module")
def at_once(vocabulary):
    """The public library's encoder for whole texts; the operator itself does not use it."""
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("public", pat_str=tokens.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={}).encode_ordinary


BITS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "é", "漢字", "ह", "ि", "!", "--", "====", "　", "‍", "😀", "ll", "'re", "Z", "<|endoftext|>"]


def test_streaming_equals_encoding_at_once(vocabulary, at_once, monkeypatch):
    monkeypatch.setattr(tokens, "RUN", 5)
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(BITS) * rng.choice([1, 1, 1, 2, 9]) for _ in range(rng.randint(0, 14)))
        stream, size = tokens.Transducer(vocabulary), rng.randint(1, 9)
        ids = [i for at in range(0, len(text), size) for i in stream.feed(text[at : at + size])] + stream.finish()
        assert ids == at_once(text), repr(text)
        stream, last = tokens.Transducer(vocabulary), len(text) // size * size
        ids = [i for at in range(0, last, size) for i in stream.feed(text[at : at + size])] + stream.finish(text[last:])
        assert ids == at_once(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 60_000, "漢字仮名" * 9_000, " " * 40_000 + "x", "=" * 40_000, "x " * 50_000, "\n" * 30_000, "1234567890" * 4_000])
def test_long_runs(vocabulary, at_once, text):
    ids = vocabulary.encode(text)
    assert ids == at_once(text)
    decoder = tokens.Decoder(vocabulary)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == text


def test_memory_of_a_run_is_bounded(vocabulary):
    run, held = tokens.Machine(vocabulary), 0
    for _ in range(200):
        run.feed(b"abcdefghijklmnop" * 16)
        held = max(held, len(run.data))
    assert held <= 4 * vocabulary.lookahead + 256


def test_the_ascii_pattern_splits_alike(vocabulary):
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choice([*map(chr, range(128)), *"  '  \n\nabll"]) for _ in range(rng.randint(0, 12)))
        assert vocabulary.ascii.findall(text) == vocabulary.pattern.findall(text), repr(text)


def test_every_token_is_what_the_merges_make_of_it(vocabulary):
    assert all(vocabulary.merged(b) == [i] for b, i in vocabulary.ranks.items())


def test_the_lookahead_follows_from_the_merge_list():
    import base64

    listed = b"\n".join(base64.b64encode(b) + b" %d" % i for i, b in enumerate([b"a", b"b", b"c", b"ab", b"abc"]))
    small = tokens.Vocabulary(listed)
    assert small.begun == {b"a", b"ab"} and small.lookahead == 3
    machine = tokens.Machine(small)
    # `a` and `ab` may grow, `b` after a finished `abc` may not.
    assert [machine.feed(x) for x in (b"a", b"b", b"c", b"b", b"a")] == [[], [], [4], [1], []] and machine.finish() == [0]


def test_whole_test_tables_equal_the_library(at_once, vocabulary):
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    import pyarrow.parquet as pq

    for text in pq.read_table(path, columns=["text"]).column(0).to_pylist():
        assert vocabulary.encode(text) == at_once(text or "")


def test_against_the_reference_library(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.join(os.path.dirname(tokens.VOCABULARY), "byte_bpe_50k.json")
    other = tokenizers.Tokenizer.from_file(path)
    other.encode_special_tokens = True
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(BITS) for _ in range(30))
        assert vocabulary.encode(text) == other.encode(text, add_special_tokens=False).ids


def test_ids_as_table(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "a b"), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.with_ids(df, "doc_id", "text").collect()}
    assert got[2] == got[3] == [] and got[1] == got[4] == vocabulary.encode("a b") and 50256 not in got[5]
    assert tokens.with_ids(df.limit(0), "doc_id", "text").count() == 0
    assert tokens.round_trip(df, "doc_id", "text").where("NOT same").count() == 0


def test_packing_keeps_everything_within_capacity(spark, vocabulary):
    rng = random.Random(4)
    texts = {i: "word " * rng.choice([0, 3, 30, 90, 200, 700]) for i in range(400)}
    texts |= {400: None, 401: "", 402: "word " * 512}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    limits = spark.createDataFrame([(1, 128), (2, 512), (3, None), (4, 0)], "limit_id long, capacity_tokens long")
    packed = packing.pack(docs, limits)
    rows = packed.collect()
    assert {r["limit_id"] for r in rows} == {1, 2}
    for limit, capacity in ((1, 128), (2, 512)):
        fill, per_doc = {}, {}
        for r in (r for r in rows if r["limit_id"] == limit):
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n_tokens"]
            per_doc.setdefault(r["doc_id"], []).append(r)
        assert max(fill.values()) <= capacity and set(per_doc) == set(texts)
        for doc, parts in per_doc.items():
            size = len(vocabulary.encode(texts[doc]))
            parts.sort(key=lambda r: r["piece_no"])
            assert [r["start_token"] for r in parts] == [k * capacity for k in range(len(parts))] and sum(r["n_tokens"] for r in parts) == size
            assert len(parts) == max(1, -(-size // capacity))
    used = {r["limit_id"]: r["used"] for r in packing.summary(packed).collect()}
    assert used[1] > 0.9 and used[2] > 0.9
    assert packing.pack(docs.limit(0), limits).count() == 0


def test_closing_the_fullest_window():
    windows = packing.Windows(10, 0, limit=2)
    assert [windows.place(n) for n in (6, 7, 9)] == [0, 1, 2] and windows.place(4) == 0 and windows.place(1) == 2


def test_documents_without_tokens_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(packing, "MOST_HELD", 5)
    windows = packing.Windows(10, 0)
    for n in range(23):
        windows.place(0, n)
    assert len(windows.done) == 4 and sum(map(len, windows.held.values())) == 23 and max(map(len, windows.held.values())) == 5


LAW, SEA = ["court", "statute", "verdict"], ["harbour", "sailor", "anchor"]


def _document(rng, words, share):
    about = [f"We looked at the {rng.choice(words)} {rng.choice(['again', 'today', 'twice'])}." for _ in range(int(10 * share))]
    return " ".join(about + [f"The run took {rng.randint(1, 99)} seconds." for _ in range(10 - len(about))])


def test_subjects(spark):
    rng = random.Random(5)
    shares = [0.8, 0.1, 0.5]
    docs = [(i, _document(rng, LAW if i % 2 else SEA, shares[i % 3])) for i in range(240)]
    docs += [(900, None), (901, ""), (902, "court"), (903, "# court\n## verdict")]
    labels = [(i, i, (" Law" if i % 4 == 1 else "legal") if i % 2 else "sea", None) for i in range(160) if i % 3 != 1] + [(700, 1, "nonsense", "x"), (701, 2, None, "x"), (702, 4, "law", "x")]
    documents = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subjects", F.lit(1))
    marked = spark.createDataFrame(labels, "label_id long, doc_id long, subject_label string, annotator string")
    areas = spark.createDataFrame([("law", "courts, statutes"), ("sea", "ships")], "subject string, covers string")
    got = {(r["doc_id"], r["subject"]) for r in subjects.find_subjects(documents, marked, areas).collect()}
    want = {(i, "law" if i % 2 else "sea") for i in range(240) if i % 3 != 1}
    assert got - {(902, "law")} == want and (902, "law") in got
    assert subjects.find_subjects(documents, marked.limit(0), areas).count() == 0
    assert subjects.find_subjects(documents.limit(0), marked, areas).count() == 0


def test_held_out_accuracy_on_the_test_tables(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    from quietlines.plans.tables import table

    documents, labels, areas = (table(spark, folder, t) for t in ("documents", "doc_labels", "subject_areas"))
    names = {r["subject"]: r["covers"].lower() for r in areas.collect()}
    sample = subjects.labelled(documents, labels, names).persist()
    rules = subjects.mine_rules(sample, len(names))
    held = sample.where("held_out")
    shares = subjects.subject_shares(held, rules, subjects.calibrate(sample, rules)).where(F.col("n_about") >= subjects.SHARE * F.col("n_units"))
    hit = shares.join(held.select("doc_id", F.explode("subjects").alias("subject")), ["doc_id", "subject"], "left_semi").select("doc_id").distinct().count()
    assert hit >= 0.75 * held.count()  # a tenth of the hand labels is wrong


def test_units_and_labels():
    assert len(subjects.units("# Title\n\n- First one. Second one!\n## More\n3. Third")) == 3
    assert len(subjects.units("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+tie_break = 1\n # note")) == 2
    assert subjects.units(None) == [] and subjects.units("12 34") == []
    areas = {"law": "contracts, courts", "sport": "matches"}
    assert [subjects.normal_label(x, areas) for x in (" LAW ", "legal", "courts", "zzz", None)] == ["law", "law", "law", None, None]
