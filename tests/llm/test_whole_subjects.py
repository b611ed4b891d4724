import random
import time
from itertools import combinations

from quietlines.llm import subjects

SAMPLE = "text string, subjects array<string>, held_out boolean"


def test_three_documents_make_a_rule_at_every_size(spark):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyz"]
    common = " ".join(f"{w}." for w in words)
    rows = [(common, ["sea"], False)] * 2600 + [("zeta.", ["law"], False)] * 3
    rules = subjects.mine_rules(spark.createDataFrame(rows, SAMPLE), 2)
    assert [s for s, _ in rules[frozenset(["zeta"])]] == ["law"]


def test_the_labelled_sample_keeps_its_bound():
    assert subjects.TRAIN_DOCS == 20_000


def test_words_far_apart_in_a_wordy_unit_share_a_rule(spark):
    middle = " ".join(f"m{chr(97 + i)}" for i in range(10))
    rows = [(f"aa {middle} zz.", ["law"], False)] * 3 + [("aa.", ["sea"], False), ("zz.", ["sea"], False)] * 4
    rules = subjects.mine_rules(spark.createDataFrame(rows, SAMPLE), 2)
    assert [s for s, _ in rules[frozenset(["aa", "zz"])]] == ["law"]


def brute_rules(rows, n_subjects):
    """Every set of up to MAX_WORDS telling words that stand in one unit, counted by document."""
    docs = [(subjects.units(t), s) for t, s, held in rows if not held]
    counts, by = {}, {}

    def count(only):
        for found, labels in docs:
            for c in {frozenset(c) for u in found for n in range(1, subjects.MAX_WORDS + 1) for c in combinations(sorted(u & only), n)}:
                counts[c] = counts.get(c, 0) + 1
                for s in labels:
                    by.setdefault(c, {}).setdefault(s, 0)
                    by[c][s] += 1

    sure = lambda c, s: (by.get(c, {}).get(s, 0) + subjects.SHRINK / n_subjects) / (counts[c] + subjects.SHRINK)
    count(frozenset(w for found, _ in docs for u in found for w in u))
    telling = frozenset(w for c in counts if len(c) == 1 for w in c if counts[c] >= subjects.MIN_DOCS and max(sure(c, s) for s in by[c]) >= subjects.WORD_CONFIDENCE)
    counts.clear(), by.clear()
    count(telling)
    usual = {s: sum(s in labels for _, labels in docs) / len(docs) for _, labels in docs for s in labels}
    rules = {}
    for c, n in counts.items():
        if n < subjects.MIN_DOCS:
            continue
        for s in by[c]:
            shorter = [sure(frozenset(x), s) for k in range(1, len(c)) for x in combinations(c, k) if by[frozenset(x)].get(s)]
            if sure(c, s) >= max(subjects.RULE_CONFIDENCE, subjects.LIFT * usual[s]) and sure(c, s) > max(shorter, default=0.0) + subjects.GAIN:
                rules.setdefault(c, {})[s] = round(sure(c, s), 9)
    return rules


def test_grown_sets_equal_brute_force(spark):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "pqrstu" for b in "xyz"]
    rows = []
    for i in range(150):
        label = rng.choice(["law", "sea", "art"])
        text = " ".join(" ".join(rng.sample(words, rng.randint(1, 6))) + (f" {label[0]}mark" if rng.random() < 0.3 else "") + "." for _ in range(rng.randint(1, 4)))
        rows.append((text, sorted({label} | ({"art"} if rng.random() < 0.2 else set())), i % 5 == 0))
    got = subjects.mine_rules(spark.createDataFrame(rows, SAMPLE), 3)
    assert {w: {s: round(c, 9) for s, c in found} for w, found in got.items()} == brute_rules(rows, 3)
    assert any(len(w) == 3 for w in got)


def test_the_index_finds_the_strongest_rule_in_bounded_time():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    rules = {frozenset(rng.sample(words, rng.randint(1, 3))): [(rng.choice("abc"), rng.random())] for _ in range(4000)}
    index = subjects.RuleIndex(rules)
    for _ in range(200):
        unit = frozenset(rng.sample(words, rng.randint(0, 60)))
        want = max((c for r, found in rules.items() if r <= unit for _, c in found), default=None)
        got = index.best(unit)
        assert (got[1] if got else None) == want
    began = time.perf_counter()
    index.best(frozenset(words))
    assert time.perf_counter() - began < 0.05


def test_a_diff_is_known_wherever_it_begins():
    text = "x" * 1000 + "\ndiff --git a/b b/b\n--- a/b\n+++ b/b\n# heading like code. Another one"
    assert len(subjects.units(text)) == 2
