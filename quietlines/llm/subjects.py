"""Problem 8: the subject areas a document's text is about.

Method: class-association rules. Hand-labelled documents are cut into units
(sentences, log lines, code lines); frequent word sets together with subjects are
mined with parallel frequent-pattern growth: words are ranked by frequency, each unit
is sent to the tasks of its words as far as they need it, and every task grows the sets
that end in its words over projected units. Support counts documents, not units; each
rule `words -> subject` gets its confidence from it, shrunk towards the base rate. A
rule that a more general rule equals is pruned, and no set is grown further once no
rule of its supersets could say more. A unit's evidence is its strongest matching rule, calibrated on held-out labelled documents; a document has
a subject if the units that are about it make up at least a quarter of its units.

Labels are a bounded sample (`TRAIN_DOCS` documents, by hash); scoring covers every
unit of every document. Words are whole, case and underscores folded; headings and
diff headers are no units.

Defined results: null, empty and wordless texts have no subject; repeated rows are
scored each on their own; without usable labels there are no rules and no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that rules are mined from, at most; every fifth calibrates.
TRAIN_DOCS = 20_000
#: Documents that must support a rule, words in a rule, and the least share of units.
MIN_DOCS, MAX_WORDS, SHARE = 3, 3, 0.25
#: Tasks that share the growing of word sets.
GROUPS = 64
#: Confidence under which a word or a rule says nothing.
WORD_CONFIDENCE, RULE_CONFIDENCE = 0.22, 0.35
#: What a longer rule must have more than the shorter ones inside it.
GAIN = 0.02
#: How many times its subject's usual share a rule's confidence must be.
LIFT = 1.5
#: Weight of the uncalibrated line in the calibration, in cases.
PRIOR = 100.0
#: Weight of the base rate in a rule's confidence, in documents.
SHRINK = 2.0

# Other spellings of subjects found in hand labels.
ALIASES = {
    "food": "cooking", "cookery": "cooking", "culinary": "cooking", "sciences": "science", "scientific": "science", "medicine": "health", "medical": "health", "healthcare": "health",
    "legal": "law", "laws": "law", "farming": "agriculture", "agricultural": "agriculture", "sports": "sport", "athletics": "sport", "computing": "software", "programming": "software",
    "tourism": "travel", "travelling": "travel", "financial": "finance", "money": "finance", "musical": "music",
}

_HEADING = re.compile(r"\s*(?:#{1,6}\s+\S|diff --git |index [0-9a-f]+\.\.|--- |\+\+\+ |@@ |[=~_*-]{3,}\s*$)")
_ROLE = re.compile(r"</?(?:user|assistant|tool|system)>|\{\"role\": ?\"\w+\", ?\"content\": ?\"|\"\}\s*$|<\|\w+\|>")
_SENTENCE = re.compile(r"[.!?。！？][\"')\]]*\s+(?=\S)|[。！？]")  # what is consumed holds no word
_DIFF = re.compile(r"^diff --git ", re.M)
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[list[str]]:
    """The words of every sentence, log line or code line of a text that has some."""
    if not text:
        return []
    code = bool(_DIFF.search(text))
    found = []
    for line in text.splitlines():
        if (line.startswith(("diff --git ", "index ", "--- ", "+++ ", "@@ ")) if code else _HEADING.match(line)):
            continue
        # A role mark has one of these signs.
        for part in _ROLE.split(line) if "<" in line or '"' in line else (line,):
            for sentence in (part,) if code else _SENTENCE.split(part):
                if words := _WORD.findall(sentence.lower()):
                    found.append(words)
    return found


def units(text: str | None) -> list[frozenset[str]]:
    """The word sets of the sentences of a text."""
    return [frozenset(words) for words in sentences(text)]


Rules = dict[frozenset[str], list[tuple[str, float]]]


class RuleIndex:
    """Rules by the word that the fewest rules have, the strongest first.

    A unit is compared only with rules one of whose words it holds, and of those only
    with such as are stronger than what already matched.
    """

    def __init__(self, rules: Rules):
        ranked = sorted(((-c, len(words), sorted(words), subject) for words, found in rules.items() for subject, c in found))
        uses = Counter(w for *_, words, _ in ranked for w in words)
        self.known = frozenset(uses)
        self.rules = [(subject, -c) for c, _, _, subject in ranked]
        self.by_word: dict[str, list[tuple[int, frozenset[str]]]] = defaultdict(list)
        for rank, (_, _, words, _) in enumerate(ranked):
            self.by_word[min(words, key=lambda w: (uses[w], w))].append((rank, frozenset(words)))

    def best(self, words: frozenset[str]) -> tuple[str, float] | None:
        """The subject and confidence of the strongest rule that matches a unit."""
        found = len(self.rules)
        for word in words:
            for rank, needed in self.by_word.get(word, ()):
                if rank >= found:
                    break
                if needed <= words:
                    found = rank
                    break
        return self.rules[found] if found < len(self.rules) else None


def normal_label(label: str | None, subjects: dict[str, str]) -> str | None:
    """The subject a hand label means: itself, an alias, or the one whose cover names it."""
    folded = (label or "").strip().lower()
    if folded in subjects:
        return folded
    if ALIASES.get(folded) in subjects:
        return ALIASES[folded]
    covering = [s for s, covers in subjects.items() if folded and re.search(rf"\b{re.escape(folded)}\b", covers)]
    return covering[0] if len(covering) == 1 else None


def labelled(documents: DataFrame, labels: DataFrame, subjects: dict[str, str], limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, text, subjects, held_out) of the labelled sample."""
    @F.pandas_udf("string")
    def meant(spellings: pd.Series) -> pd.Series:
        return pd.Series([normal_label(x, subjects) for x in spellings], dtype=object)

    spelled = labels.where("subject_label IS NOT NULL").select(F.lower(F.trim("subject_label")).alias("label")).distinct().withColumn("subject", meant("label")).where("subject IS NOT NULL")
    marked = labels.withColumn("label", F.lower(F.trim("subject_label"))).join(spelled, "label").groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return documents.select("doc_id", "text").where("text IS NOT NULL").join(sample, "doc_id").withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0)


def _sure(n: int, docs: int, n_subjects: int) -> float:
    """Confidence of a rule that `n` of `docs` documents bear out."""
    return (n + SHRINK / n_subjects) / (docs + SHRINK)


def may_gain(docs: int, by: dict[str, int], n_subjects: int) -> bool:
    """Whether some superset of a word set could still be a rule; its documents are at most those of the set."""
    best = {s: _sure(n, n, n_subjects) for s, n in by.items()}
    return any(best[s] >= RULE_CONFIDENCE and best[s] > _sure(n, docs, n_subjects) + GAIN for s, n in by.items())


def _grown(suffix: tuple[int, ...], projected: list[tuple[int, tuple[int, ...], int]], subjects: list[list[str]], n_subjects: int) -> Iterator[tuple[tuple[int, ...], int, Counter]]:
    """Word sets that end in `suffix`, from (document, ranked words, how many of them stand before the suffix)."""
    bases: dict[int, list[tuple[int, tuple[int, ...], int]]] = defaultdict(list)
    for doc, words, end in projected:
        for at in range(end):
            bases[words[at]].append((doc, words, at))
    for word, base in bases.items():
        docs = {doc for doc, _, _ in base}
        if len(docs) < MIN_DOCS:
            continue
        by = Counter(s for doc in docs for s in subjects[doc])
        found = (word, *suffix)
        yield found, len(docs), by
        if len(found) < MAX_WORDS and may_gain(len(docs), by, n_subjects):
            yield from _grown(found, base, subjects, n_subjects)


def shards(units_of: list[tuple[int, ...]]) -> dict[int, list[tuple[int, ...]]]:
    """Per group of words the beginnings of ranked units up to their last word of that group."""
    out: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for words in units_of:
        sent = set()
        for at in range(len(words) - 1, 0, -1):
            group = words[at] % GROUPS
            if group not in sent:
                sent.add(group)
                out[group].append(words[: at + 1])
    return out


def mine_rules(sample: DataFrame, n_subjects: int) -> Rules:
    """Rules from the part of the sample that is not held out."""
    mining = sample.where("NOT held_out")

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            counts: Counter = Counter()
            for text, subjects in zip(rows["text"], rows["subjects"], strict=True):
                for word in frozenset([""]).union(*units(text)):  # the empty word counts documents
                    counts[word, ""] += 1
                    counts.update((word, s) for s in subjects)
            yield pd.DataFrame([(w, s, n) for (w, s), n in counts.items()], columns=["word", "subject", "n"])

    counted = mining.mapInPandas(words_of, "word string, subject string, n bigint").groupBy("word", "subject").agg(F.sum("n").alias("n"))
    mark = F.col("subject") == ""
    per_word = counted.groupBy("word").agg(F.max(F.when(mark, F.col("n"))).alias("docs"), F.max(F.when(~mark, F.col("n"))).alias("most"), F.map_from_entries(F.collect_list(F.when(~mark, F.struct("subject", "n")))).alias("by"))
    telling = (F.col("docs") >= MIN_DOCS) & ((F.col("most") + SHRINK / n_subjects) / (F.col("docs") + SHRINK) >= WORD_CONFIDENCE)
    support = {r["word"]: (r["docs"], dict(r["by"])) for r in per_word.where(telling | (F.col("word") == "")).collect()}  # words of a bounded sample
    if len(support) < 2:
        return {}
    total, per_subject = support.pop("")
    usual = {s: n / total for s, n in per_subject.items()}
    ranked = sorted((w for w, (docs, by) in support.items() if may_gain(docs, by, n_subjects)), key=lambda w: (-support[w][0], w))
    rank = {w: i for i, w in enumerate(ranked)}

    def projections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for text, subjects in zip(rows["text"], rows["subjects"], strict=True):
                found = {tuple(sorted(rank[w] for w in u if w in rank)) for u in units(text)}
                out += [(group, list(subjects), [list(w) for w in words]) for group, words in shards(sorted(found)).items()]
            yield pd.DataFrame(out, columns=["group", "subjects", "units"])

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        own, subjects = int(group["group"].iloc[0]), [list(s) for s in group["subjects"]]
        bases: dict[int, list] = defaultdict(list)
        for doc, of_doc in enumerate(group["units"]):
            for words in (tuple(int(w) for w in u) for u in of_doc):
                for at in range(1, len(words)):
                    if words[at] % GROUPS == own:
                        bases[words[at]].append((doc, words, at))
        out = [(list(w), n, dict(by)) for last, base in bases.items() for w, n, by in _grown((last,), base, subjects, n_subjects)]
        return pd.DataFrame(out, columns=["words", "docs", "by"])

    sent = mining.mapInPandas(projections, "group int, subjects array<string>, units array<array<int>>")
    sets = sent.groupBy("group").applyInPandas(grow, "words array<int>, docs bigint, by map<string,bigint>").toArrow()  # sets of a bounded sample
    known = {frozenset([w]): held for w, held in support.items()}
    for words, docs, by in zip(*(sets.column(c).to_pylist() for c in ("words", "docs", "by")), strict=True):
        known[frozenset(ranked[w] for w in words)] = (docs, dict(by))
    confidence = {words: {s: _sure(n, docs, n_subjects) for s, n in by.items()} for words, (docs, by) in known.items()}
    rules: Rules = {}
    for words, by_subject in confidence.items():
        shorter = [confidence.get(frozenset(sub), {}) for size in range(1, len(words)) for sub in combinations(sorted(words), size)]
        for subject, c in by_subject.items():
            general = max((held.get(subject, 0.0) for held in shorter), default=0.0)
            if c >= max(RULE_CONFIDENCE, LIFT * usual.get(subject, 0.0)) and c > general + GAIN:
                rules.setdefault(words, []).append((subject, c))
    return rules


def calibrate(sample: DataFrame, rules: Rules) -> tuple[float, float]:
    """Slope and offset of P(unit is about the subject) over the rule's log-odds, on held-out documents."""
    index = RuleIndex(rules)

    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            counts: Counter = Counter()
            for text, subjects in zip(rows["text"], rows["subjects"], strict=True):
                seen = {index.best(u & index.known) for u in units(text)} - {None}
                counts.update((round(c, 2), s in set(subjects)) for s, c in seen)
            yield pd.DataFrame([(c, y, n) for (c, y), n in counts.items()], columns=["c", "y", "n"])

    got = sample.where("held_out").mapInPandas(outcomes, "c double, y boolean, n bigint").groupBy("c", "y").agg(F.sum("n").alias("n")).collect()
    points = [(math.log(min(max(r["c"], 0.01), 0.99) / (1 - min(max(r["c"], 0.01), 0.99))), float(r["y"]), r["n"]) for r in got]
    slope, offset = 1.0, 0.0
    if sum(n for *_, n in points) < 50:
        return slope, offset
    for _ in range(200):  # gradient steps with a prior of PRIOR cases at the uncalibrated line
        gs, go, total = PRIOR * (slope - 1.0), PRIOR * offset, PRIOR
        for x, y, n in points:
            p = 1 / (1 + math.exp(-(slope * x + offset)))
            gs, go, total = gs + n * (p - y) * x, go + n * (p - y), total + n
        slope, offset = slope - gs / total, offset - go / total
    return max(slope, 0.2), offset


def subject_shares(documents: DataFrame, rules: Rules, line: tuple[float, float]) -> DataFrame:
    """(doc_id, subject, n_units, n_about) of every subject that some unit is about. No shuffle."""
    index = RuleIndex(rules)
    known = index.known
    slope, offset = line

    def subject_of(words: frozenset[str]) -> str | None:
        best = index.best(words)
        return best[0] if best and slope * math.log(best[1] / (1 - min(best[1], 0.999))) + offset >= 0 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recall = lru_cache(1 << 16)(subject_of)  # units repeat the same telling words
        for rows in batches:
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"], strict=True):
                found = sentences(text)
                about: Counter = Counter(recall(known.intersection(words)) for words in found)
                del about[None]
                out += [(doc, s, len(found), n) for s, n in about.items()]
            yield pd.DataFrame(out, columns=["doc_id", "subject", "n_units", "n_about"])

    return documents.select("doc_id", "text").where("text <> ''").mapInPandas(run, "doc_id bigint, subject string, n_units bigint, n_about bigint")


def learn(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> tuple[Rules, tuple[float, float]]:
    """Rules and their calibration from the labelled sample."""
    subjects = {r["subject"]: (r["covers"] or "").lower() for r in areas.where("subject IS NOT NULL").collect()}  # a fixed table of ten rows
    sample = labelled(documents, labels, subjects).persist()
    try:
        rules = mine_rules(sample, max(len(subjects), 1))
        return rules, calibrate(sample, rules) if rules else (1.0, 0.0)
    finally:
        sample.unpersist()


def find_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject, share) for every document and subject it is about."""
    shares = subject_shares(documents, *learn(documents, labels, areas))
    return shares.where(F.col("n_about") >= SHARE * F.col("n_units")).select("doc_id", "subject", (F.col("n_about") / F.col("n_units")).alias("share"))
