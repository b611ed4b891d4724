import random

from quietlines.llm import pii


def test_the_classifier_keeps_its_sample():
    assert pii.TRAIN_ROWS == 8000


SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "vas", "ze", "dor", "fi", "gal", "nu", "pri", "sto", "wen", "xa", "yor"]
LABELLED = ["Author: {n} <{m}>", "Signed-off-by: {n} <{m}>", "name: {n}\nmail: {m}", "Dear Ms. {n}, your order is on its way.", "{{'owner': '{n}', 'lane': 4}}", "| {n} | {m} |"]
PROSE = ["Yesterday we met {n} about the ledger.", "The keys of {n} were lost again.", "Please send it to {n} before noon.", "A letter from {n} arrived."]
NONE = ["The Copper Gateway release depends on Basalt Viewer, version 3.", "Visual Studio and Apache Spark both fail.", "See Section 4 and Release Notes.", "We read the Quick Start twice.", "Job 12 ended on Friday Morning.", "Amber Engine and Slate Editor share a queue."]


def _names(rng, known):
    family = "".join(rng.sample(SYLLABLES, 1)).capitalize() + rng.choice(["sen", "mann", "akis", "escu", "ford", "enko"])
    given = rng.choice(sorted(pii.GIVEN)) if known else "".join(rng.sample(SYLLABLES, 2))
    name = f"{given.capitalize()} {family}"
    return name if rng.random() < 0.85 else name.lower() if rng.random() < 0.5 else name.upper()


def test_names_no_list_has_are_found_like_those_it_has(spark):
    rng = random.Random(11)
    unseen = [_names(rng, False) for _ in range(60)]
    rows, want = [], {}
    for i in range(3000):
        known = rng.random() < 0.4
        name = _names(rng, True) if known else rng.choice(unseen)
        frame = rng.choice(LABELLED + PROSE)
        if i % 3:
            mail = f"{name.split()[0].lower()}{i}@post.example"
            rows.append(frame.format(n=name, m=mail))
            want[i] = (known, frame in PROSE, name)
        else:
            rows.append(rng.choice(NONE))
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(rows)], "tbl string, row_id long, text string")
    got = {r["row_id"]: {rows[r["row_id"]][s["start_pos"] : s["end_pos"]] for s in r["spans"] if s["pii_kind"] == "name"} for r in pii.find_pii(df, keep=("tbl", "row_id", "text")).collect()}
    for known in (True, False):
        for prose in (True, False):
            mine = [i for i, (k, p, _) in want.items() if k == known and p == prose]
            recall = sum(want[i][2] in got.get(i, ()) for i in mine) / len(mine)
            assert recall >= 0.95, (known, prose, recall)
    wrong = sum(len(found - ({want[i][2]} if i in want else set())) for i, found in got.items())
    assert wrong <= 0.02 * len(want)


def test_an_apostrophe_is_a_quote_outside_words():
    text = "VALUES ('Karen Ostsen', 'karen@post.example') and Karen O'Dolsen's desk"
    found = {text[s:e] for k, s, e, *_ in pii.candidates(text)}
    assert {"Karen Ostsen", "karen@post.example", "Karen O'Dolsen"} <= found


def test_an_abstention_says_little():
    """Mentions outside labelled contexts are not taken for false because most stand inside."""
    patterns = {"+++": 500, "+00": 60, "-00": 300, "-+0": 40, "000": 50}
    posterior, _ = pii.estimate(patterns)
    assert posterior["+00"] > 0.8 and posterior["-+0"] < 0.5 and posterior["000"] < 0.1
