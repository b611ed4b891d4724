"""Problem 3: personal information inside free text.

Method: patterns propose candidate spans of five kinds; several weak labelers per
kind (format rules, gazetteers, word endings, left and right context, neighbouring
characters) vote for, against or abstain. The gazetteers hold common given names, endings
of family names and common words of several languages, the contexts are headers, titles,
greetings and delimiters: general knowledge, nothing of a particular corpus. The vote patterns of the whole corpus are
counted, expectation maximisation estimates how reliable each labeler is and how
likely each vote pattern marks a true mention, and a logistic span classifier over
votes, shapes, the words of the span and those around it is trained on those
probabilities; so it learns names, places and turns of phrase no list has. It decides every
candidate; overlapping candidates of a text go to the most probable, then the longest.

Counts cover all candidates. Only the classifier is fitted on a bounded sample
(`TRAIN_ROWS` candidates per kind, chosen by hash); its size never grows with the data.

Defined results: null and empty texts have no spans; each repeated row is a case of
its own; offsets are 0-based code points; a corpus without candidates gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietlines.plans.tables import durable, plain

KINDS = ("email", "phone", "national_id", "address", "name")
#: Candidates per kind, about, on which the span classifier is fitted.
TRAIN_ROWS = 8000
#: Length of the classifier's weight vector; features are hashed into it.
BUCKETS = 1 << 15
#: Rounds of expectation maximisation at most.
EM_ROUNDS = 60
#: Share of an abstention's log-odds that counts, and the unopposed votes that settle a pattern.
ABSTAIN, SURE = 0.25, 3

# Common given names of several languages (gazetteer), in lower case.
GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark paul steven andrew george edward henry peter mary patricia jennifer linda elizabeth barbara susan sarah karen nancy lisa emily emma olivia sophia alice grace rose helen "
    "hans klaus jürgen stefan karl wolfgang heike sabine monika petra ingrid ursula lukas felix jonas jean pierre michel philippe louis hugo lucas camille marie claire sophie isabelle nathalie josé juan carlos luis antonio javier miguel pablo maría carmen ana lucía elena isabel sofía "
    "giuseppe giovanni marco luca francesco giulia francesca chiara joão pedro paulo beatriz jan piet johan willem anneke lars erik björn anders olaf astrid freya ingrid mikko antti aino ivan dmitri sergei alexei olga natasha anna tatiana piotr krzysztof agnieszka katarzyna "
    "mehmet mustafa ahmed mohammed omar ali hassan fatima aisha layla yusuf ibrahim raj arjun priya rahul anjali wei ming li fang yuki kenji hiroshi sakura hana haruto minh linh kofi kwame amina chinedu ngozi thandi sipho".split()
)
# Endings of family names, by language.
ENDINGS = (
    "son sson sen strom ström quist qvist berg lund holm gren dahl dottir dóttir nen "
    "mann stein feld bauer mayer meyer meier maier huber schmidt bach "
    "ford ton ham worth hurst wick well ley field land wood man smith "
    "stra sma inga ema eau ault ez elli etti ini otti ucci "
    "ski sky ska cki enko chuk icz wicz vich vić ović ovic ević evic ić ova ov eva ev "
    "escu eanu akis idis poulos oglu oğlu ian yan dze shvili moto yama mura take saki gawa kawa shima"
).split()
FAMILY_ENDING = re.compile(rf"(?i)\w\w(?:{'|'.join(ENDINGS)})$")
PARTICLE = r"(?:von|van der|van den|van|de la|de los|de|del|della|di|da|dos|du|le|la|bin|ibn|al|el|ter|zu|VON|VAN DER|VAN|DE LA|DE|DEL|DI|DA)"
# Words that stand beside names or open sentences but belong to no name.
NOT_NAME = frozenset(
    "the a an this that these those and or but if in on at by with of for from to as into over under between once is are was were be been has have had do does did not no new old all any each every both some such see next let please could would should cannot must "
    "he she it we they you i his her its our their your who whom what when where why how der die das ein eine und oder mit von zu im am ich wir sie le la les un une et ou avec je nous el los las uno una y con yo merci bitte por para "
    "ask hi hello dear thanks thank cheers regards best kind attn author cc reviewed signed owner name user customer patient passport record mail tel phone fax port subject date change row line file table column build job run route version release checksum matrix "
    "mr mrs ms miss dr prof sir madam herr frau señor señora monsieur madame "
    "monday tuesday wednesday thursday friday saturday sunday january february march july september october november december morning evening today tomorrow yesterday "
    "road street avenue lane court terrace drive close mews square place boulevard calle rue straße flat apt suite floor north south east west st ave blvd rd "
    "main branch notes quick start begin end section page chapter figure read write open data base code review visual error warn info debug traceback found set insert values select update delete "
    "google microsoft amazon apple apache linux windows android python java".split()
)
# What software, services and their parts are called.
PRODUCT = frozenset(
    "engine gateway viewer scheduler editor studio server client service manager browser compiler console dashboard pipeline runner worker queue cluster node index builder loader parser proxy monitor tracker router cloud platform framework library toolkit desktop mobile pro spark "
    "test branch notes start section report record release layer".split()
)

_CAP = r"(?:(?:O|D|Ó)['’]|Mc|Mac)?[A-ZÀ-ÖØ-ÞĀŐŠŽČŁ][a-zß-öø-ÿāćčłőšžǻ]+(?:[A-Z][a-zß-öø-ÿāćčłőšž]+)?"
_CAPS = rf"{_CAP}(?:[-‑]{_CAP})?"
_UP = r"(?:(?:O|D)['’]|MC)?[A-ZÀ-ÖØ-ÞĀĆČŁŐŠŽ]{2,}(?:[-‑](?:O['’])?[A-ZÀ-ÖØ-ÞĆČŁŐŠŽ]{2,})?"
_LOW = r"(?:o['’])?[a-zß-öø-ÿāćčłőšž]{3,}(?:[-‑](?:o['’])?[a-zß-öø-ÿāćčłőšž]{3,})?"
_FAMILY, _FAMILY_UP, _FAMILY_LOW = rf"(?:(?:[AaEe]l|[Bb]en|[Bb]in)-)?{_CAPS}", rf"(?:(?:[AaEe]l|AL|EL)-)?{_UP}", rf"(?:(?:al|el|bin)-)?{_LOW}"
_INIT = r"[A-ZÀ-ÖØ-Þ]\."
_HAN = r"[々㐀-䶿一-鿿]"
# An apostrophe is part of a word only between letters; elsewhere it is a quote.
_EDGE, _SIDE = r"(?<![\w@./-])(?<!\w['’])", r"(?![\w@/]|['’](?!s\b)\w|-\w|\.\w)"
NAME_FORMS = (
    ("mixed", re.compile(rf"{_EDGE}(?=((?:{_INIT}|{_CAPS})(?: {_INIT}){{0,2}}(?: {PARTICLE})? {_FAMILY}){_SIDE})")),
    ("three", re.compile(rf"{_EDGE}(?=({_CAPS} {_CAPS} {_CAPS}){_SIDE})")),
    ("upper", re.compile(rf"{_EDGE}(?=((?:{_INIT}|{_UP})(?: {_INIT}){{0,2}}(?: {PARTICLE})? {_FAMILY_UP}){_SIDE})")),
    ("reversed", re.compile(rf"{_EDGE}(?=((?:{PARTICLE} )?{_FAMILY}, (?:{_CAPS}|{_INIT})(?: {_INIT})?){_SIDE})")),
    ("han", re.compile(rf"(?<!{_HAN})(?=({_HAN}{{2,7}})(?!{_HAN}))")),
)
# Lower-case names are looked up from the ending of the family name back.
_LOW_WORD = re.compile(r"[a-zß-öø-ÿāćčłőšžǻ]{4,}(?!\w)")
_LOW_ENDINGS = tuple(ENDINGS)
_LOW_BACK = re.compile(rf"{_EDGE}(?P<name>(?P<first>{_LOW})(?: [a-z]\.)?(?: {PARTICLE})? {_FAMILY_LOW})$")
# What stands before a name: labels, headers, titles, greetings, delimiters.
NAME_LEFT = re.compile(
    r"(?i)(?:\b(?:\w*name|fn|author|from|to|cc|by|reviewed-by|signed-off-by|co-authored-by|who|holder|owner|assignee|contact|attn\.?|customer|client|patient|employee|user|person|sender|recipient)[\"']?\s*[:=]\s*[\"']?"
    r"|\b(?:mr|mrs|ms|miss|dr|prof|herr|frau|señora?|monsieur|madame)\.? |\b(?:attn\.|hi|hello|dear|thanks,?|regards,) |<\w*name>|[\"']?>|^|\n|\| |[(,] ?[\"']|\d,)$"
)
NAME_LINK = re.compile(r"(?i)\b(?:by|of|from|to|with|for|as|and|von|bei|mit|de|du|par|à|con|por|para)\s$")
NAME_RIGHT = re.compile(r"^(?:\s*<[^>\s]*@|</|[\"']|\s*$|\s*\n|,(?=\S)|, (?:who|born|your|the|aged)\b| \||;)")

_LOCAL = r"[^\W_](?:[\w.+%-]*[\w+-])?(?:['’][^\W_](?:[\w.+-]*[\w+-])?)*"
_LABEL = r"[^\W_](?:[^\W_]|-(?=[^\W_]))*"
_AT = r"(?<![\w.+@-])(?<!\w['’])"
EMAIL_FORMS = (
    ("plain", re.compile(rf"{_AT}{_LOCAL}@{_LABEL}(?:\.{_LABEL})+(?![\w@]|-\w)")),
    ("escaped", re.compile(rf"{_AT}(?:(?!%40)[\w.+'’-])+%40{_LABEL}(?:\.{_LABEL})+(?![\w@]|-\w)")),
    ("bracketed", re.compile(rf"{_AT}{_LOCAL} ?[\[({{<] ?(?:at|@|AT) ?[\])}}>] ?{_LABEL}(?:(?:\.| ?[\[(] ?(?:dot|DOT) ?[\])] ?){_LABEL})+(?![\w@]|-\w)")),
    ("spelled", re.compile(rf"{_AT}{_LOCAL} (?:at|AT) {_LABEL}(?: (?:dot|DOT) {_LABEL})+(?![\w@]|-\w)")),
)
EMAIL_LEFT = re.compile(r"(?i)(?:<|mailto:|\b(?:to|from|cc|bcc|reply-to)[:=]? ?|mail[:=\"' ]*|contact\"?[:= \"']*|user=|\b(?:à|a|an|and|at) |\| |[(,] ?[\"']|,)$")
FILE_ENDING = re.compile(r"(?i)\.(?:png|jpg|jpeg|gif|svg|py|js|ts|rs|go|md|sql|sh|java|toml|yaml|json|csv|txt)$")

PHONE_FORMS = (
    ("international", re.compile(r"(?<![\w+.])\+\d{1,3}(?:[  .\-‐‑]?\(0\))?(?:[  .\-‐‑/]?\(?\d{1,5}\)?){2,6}")),
    ("international_area", re.compile(r"(?<![\w+.])\+\d{1,3}[  ]?\(\d{1,4}\)(?:[  .\-‐‑]?\d{2,5}){2,4}")),
    ("area", re.compile(r"(?<![\w.+-])\(\d{2,5}\)[  ]?\d{3,4}[  .\-‐‑]\d{3,5}")),
    ("dotted", re.compile(r"(?<![\w.+-])\d{3}[.\-‐‑  ]\d{3}[.\-‐‑  ]\d{4}")),
    ("french", re.compile(r"(?<![\w.+-])0\d(?:[.  ]\d\d){4}")),
    ("slashed", re.compile(r"(?<![\w.+/-])0\d{2,4}[/ ]\d{4,6}(?:-\d{1,4})?")),
    ("mobile", re.compile(r"(?<![\w.+-])0\d{4}[  ]\d{6}|(?<![\w.+-])0\d{3}[  ]\d{3}[  ]\d{4}|(?<![\w.+-])020[ ]\d{4}[ ]\d{4}")),
    ("solid", re.compile(r"(?<![\w.+/-])(?<!\d:)\d{10,11}")),
)
WIDE_DIGITS = {0xFF10 + i: 0x30 + i for i in range(10)}
EXTENSION = re.compile(r"(?i)[ ,]{0,2}(?:x|ext\.?|extension|durchwahl|poste)[ .:]{0,2}\d{1,6}")
PHONE_LEFT = re.compile(r"(?i)(?:tel|telephone|phone|telefon|teléfono|téléphone|call|ring|dial|reach|under|unter|callback|cell|fax|mobile|handy|\b(?:on|at|al|au|or|and)|,|<tel>|\n)\W{0,4}$")
PHONE_AGAINST = re.compile(r"(?i)(?:job|build|sha|epoch|timestamp|ports?|version|line|rows?|lines|id|ssn|checksum|commit|run|ip|order|size|bytes)[=:# ]{0,2}$")

ID_FORMS = (
    ("ssn", re.compile(r"(?<![\w.+-])\d{3}([- ])\d{2}\1\d{4}(?![\w-]|[ .]\d)")),
    ("cpf", re.compile(r"(?<![\w.+-])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\w-])")),
    ("nino", re.compile(r"(?<![\w.+-])[A-Z]{2}( ?)\d{2}\1\d{2}\1\d{2}\1[A-D](?![\w-])")),
    ("dni", re.compile(r"(?<![\w.+-])\d{8}-?[A-Z](?![\w-])")),
    ("nie", re.compile(r"(?<![\w.+-])[XYZ]-?\d{7}-?[A-Z](?![\w-])")),
    ("passport", re.compile(r"(?<![\w.+-])[A-Z]{1,2}\d{7,8}(?![\w-])")),
    ("tax", re.compile(r"(?<![\w.+-])\d{2} \d{3} \d{3} \d{3}(?![\w-]|[ .]\d)")),
    ("chinese", re.compile(r"(?<![\w.+-])\d{17}[\dX](?![\w-])")),
)
ID_LEFT = re.compile(r"(?i)(?:ssn|social security|tax id|tin|passport|dni|nie|cpf|nino|identity (?:number|card)|steuernummer|ausweis|national id|insurance|personal id|\bid|[(,] ?['\"])\W{0,4}$")
ID_AGAINST = re.compile(r"(?i)(?:sha|commit|checksum|run id|job|build|order|version|epoch|phone|tel|call|ring|under)\W{0,3}$")

_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Terrace|Ter|Close|Mews|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Crescent|Row|Gardens|Grove|Hill|Parade|Walk)\.?"
_WORD = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_GAP = r"(?:,?[ \t]*\n[ \t]*|, ?| )"
_TOWN = rf"{_WORD}(?:[ -]{_WORD})?"
_LOWTOWN = r"(?!(?:and|between|is|for|in|at|to|comme|once|if)\b)[a-zß-ÿ][a-zß-ÿ'’-]+"
ADDRESS_FORMS = (
    ("us", re.compile(rf"(?<![\w.,-])\d{{1,5}}[a-z]?(?: (?:[NSEW]|North|South|East|West|NE|NW|SE|SW)\.?)?(?: {_WORD}){{1,4}}? {_STREET}(?:,? (?:Apt|Apartment|Unit|Suite|Ste|#)\.? ?\w+)?{_GAP}{_TOWN},? (?:[A-Z]{{2}} )?\d{{5}}(?:-\d{{4}})?(?!\w)")),
    ("uk", re.compile(rf"(?<![\w.,-])(?:Flat \d+\w?, )?\d{{1,5}}[a-z]?(?: {_WORD}){{1,4}}? {_STREET}{_GAP}{_TOWN}{_GAP}[A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}}(?!\w)")),
    ("german", re.compile(rf"(?<![\w.,-])(?:(?:Am|An der|Im|Zum|Zur|Auf der) )?{_WORD}(?: (?:Straße|Strasse|Weg|Platz|Allee|Gasse|Ring|Damm|Ufer))? \d{{1,4}} ?[a-z]?(?:,[ \n]|\n)\d{{5}} {_TOWN}(?!\w)")),
    ("french", re.compile(rf"(?<![\w.,-])\d{{1,5}}(?: (?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|impasse|chemin|allée|quai|route|cours)(?: (?:de la|de l['’]|du|des|de|d['’]))?(?: ?{_WORD}){{1,4}}{_GAP}\d{{5}} {_TOWN}(?!\w)")),
    ("spanish", re.compile(rf"(?<![\w.,-])(?:Calle|C/|Avenida|Av\.|Plaza|Paseo|Camino|Ronda)(?: (?:de la|del|de los|de las|de|la|las|los))?(?: {_WORD}){{1,4}},? (?:n[.º°] ?)?\d{{1,5}}(?:, ?\d{{1,2}}[º°ª] ?[A-Z]?)?{_GAP}\d{{5}} {_TOWN}(?!\w)")),
    ("short", re.compile(rf"(?<![\w.,-])\d{{1,5}}[a-z]?(?: (?!St |Ave |Rd ){_WORD}){{1,4}}? {_STREET}{_GAP}{_TOWN}(?!\w)")),
    ("lower", re.compile(rf"(?<![\w.,:-])\d{{1,5}}(?: [a-z'’]+){{1,3}}? (?:street|st|road|rd|avenue|ave|lane|drive|court|terrace|close|mews|blvd|way|place)\.?,? {_LOWTOWN}(?: {_LOWTOWN})?(?!\w)")),
)
ADDRESS_LEFT = re.compile(r"(?i)(?:\b(?:address|adresse|anschrift|dirección|domicil\w*|residence|home|street|location|ship(?:ped)? to|deliver(?:ed)? to|lives? at|located at|at|to|an|in|is)\b[\"']?\s*:?\s*[\"']?|\n)\s*$")
ADDRESS_RIGHT = re.compile(r"^(?:\s*$|\n|[.;,\"')<]|\s(?:and|or|between|is|for|as|et|comme|und)\b)")
ADDRESS_AGAINST = re.compile(r"(?i)\b(?:tests?|layers?|tiles|traceback|version|rows|lines|ports?|error)\b")


def _folded(word: str) -> str:
    return word.lower().strip(".,'’")


def _name_votes(text: str, s: int, e: int, form: str) -> list[int]:
    span, left, right = text[s:e], text[max(0, s - 24) : s], text[e : e + 24]
    cue, after, link = (1 if NAME_LEFT.search(left) else 0), (1 if NAME_RIGHT.search(right) else 0), (1 if NAME_LINK.search(left) else 0)
    if form == "han":
        share = sum(1 for c in text[max(0, s - 40) : e + 40] if "　" < c < "ꀀ") - (e - s)
        return [0, 0, cue, after, 0, 1 if 3 <= e - s <= 6 else -1, 1 if share == 0 else -1, link]
    parts = span.replace(",", "").split()
    first, last = (parts[-1], parts[0]) if form == "reversed" else (parts[0], parts[-1])
    if form == "reversed" and len(parts) > 2 and len(parts[-1]) == 2:
        first = parts[-2]
    given = all(_folded(p) in GIVEN for p in re.split(r"[-‑]", first))
    initial = bool(re.fullmatch(r"\w\.", first))
    ending = bool(FAMILY_ENDING.search(_folded(last)))
    v_given = 1 if given else -1 if not initial and (_folded(first) in NOT_NAME or _folded(first) in PRODUCT) else 0
    v_family = -1 if _folded(last) in PRODUCT or _folded(last) in NOT_NAME else 1 if ending else -1 if form == "lower" else 0
    v_place = -1 if _folded(last) in GIVEN and not ending or form != "reversed" and any(_folded(p) in NOT_NAME for p in parts[1:-1] if not re.fullmatch(PARTICLE, p)) else 0
    # A capital word right before or after makes the span a piece of a longer one.
    before = re.search(r"(\S+) $", left)
    longer = before and re.fullmatch(r"[A-ZÀ-Þ][\w'’-]*", before[1]) and _folded(before[1]) not in NOT_NAME
    beyond = re.match(rf" (?:{PARTICLE} )?[A-ZÀ-Þ][\wß-ÿ]", right) and bool(re.fullmatch(r"\w\.", parts[-1]) or not ending)
    v_edge = -1 if longer or beyond else 0
    v_shape = 1 if initial and ending or given and ending else 0
    return [v_given, v_family, cue, after, v_place, v_edge, v_shape, link]


def _votes(kind: str, text: str, s: int, e: int, form: str) -> list[int]:
    if kind == "name":
        return _name_votes(text, s, e, form)
    span, left, right = text[s:e], text[max(0, s - 24) : s], text[e : e + 16]
    if kind == "email":
        domain = re.split(r"@|%40|[\[({<] ?(?:at|AT|@) ?[\])}>]| at | AT ", span)[-1].strip()
        letters = bool(re.search(r"(?:\.|dot |DOT )[^\W\d_]{2,}$", domain)) and not FILE_ENDING.search(domain)
        return [
            1 if letters else -1,
            -1 if re.match(r":[\w~/]", right) and re.match(r"(?i)git|hg|svn", span) or re.search(r"://[^\s]*$", left) and "?" not in left else 0,
            1 if EMAIL_LEFT.search(left) else 0,
            -1 if re.fullmatch(r"[\d.]+[\w.-]*", domain) else 1,
            1 if form in ("plain", "escaped") else 0,
            -1 if left.endswith(("{", "%", "$")) or right.startswith(("}", "%")) else 0,
        ]
    if kind == "phone":
        span = span.translate(WIDE_DIGITS)
        digits = len(re.sub(r"\D", "", EXTENSION.sub("", span)))
        return [
            1 if form not in ("solid", "dotted") else 0,
            1 if PHONE_LEFT.search(left) else 0,
            -1 if PHONE_AGAINST.search(left) else 0,
            -1 if re.match(r"[\w.:/-]*[\w]", right) and not re.match(r"\.(?:\s|$)", right) else 1,
            -1 if any(p.fullmatch(span) for _, p in ID_FORMS) or re.fullmatch(r"\d{4}[-.]\d\d[-.]\d\d.*", span) else 0,
            1 if 9 <= digits <= 15 else -1,
            1 if re.search(r"555.?01\d\d$|^\+|^0", re.sub(r"[^\d+]", "", EXTENSION.sub("", span))) else 0,
        ]
    if kind == "national_id":
        return [
            1 if form in ("nino", "cpf", "dni", "ssn") else 0,
            1 if ID_LEFT.search(left) else 0,
            -1 if ID_AGAINST.search(left) else 0,
            1 if re.match(r"[\s.,;:'\")}]|$", right) and not re.match(r"\.\d", right) else -1,
            1 if not re.search(r"[\w./:-]$", left) else -1,
        ]
    return [
        1 if form != "short" else 0,
        1 if ADDRESS_LEFT.search(left) else 0,
        1 if ADDRESS_RIGHT.search(right) else 0,
        -1 if ADDRESS_AGAINST.search(span) or ADDRESS_AGAINST.search(left) else 0,
        1 if re.search(r"\d{5}|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}$", span) else 0,
        1 if re.search(rf"(?i)\b{_STREET}(?:\W|$)|rue |calle |straße|str\.|weg\b|am ", span) else 0,
    ]


FORMS = {"email": EMAIL_FORMS, "phone": PHONE_FORMS, "national_id": ID_FORMS, "address": ADDRESS_FORMS, "name": NAME_FORMS}
LABELERS = {"email": 6, "phone": 7, "national_id": 5, "address": 6, "name": 8}
# Stretches of digits and separators long enough for a number of a person; dates are left out.
_DIGITS = re.compile(r"(?<![\d])(?!\d{4}-\d\d-\d\d)\d(?:[ ()./\-‐‑\xa0]{0,3}\d){5,}")
_NUMBERED = ("phone", "national_id")
_TOWN_CODE = re.compile(r"\d{5} [^\W\d_a-z]")
# What each form of address cannot do without: street words in the case it reads them, or a post code before a town.
_STREET_LOW = tuple(f" {w}" for w in "street st road rd avenue ave lane drive court terrace close mews blvd way place".split())
_STREET_CAP = tuple(f" {w}" for w in "Street St Road Rd Avenue Ave Lane Ln Drive Dr Court Ct Terrace Ter Close Mews Boulevard Blvd Way Place Pl Square Sq Crescent Row Gardens Grove Hill Parade Walk".split())
_STREET_FRENCH = tuple(" rue, avenue, boulevard, place, impasse, chemin, allée, quai, route, cours".split(","))
_STREET_SPANISH = ("Calle ", "C/", "Avenida ", "Av.", "Plaza ", "Paseo ", "Camino ", "Ronda ")
_CAPITALS = re.compile(rf"[A-ZÀ-ÖØ-ÞĀŐŠŽČŁ][\w.'’‑-]*,? (?:{PARTICLE} )?(?:[A-Za-z]{{2,3}}-)?[A-ZÀ-ÖØ-ÞĀŐŠŽČŁ]")


def _matches(kind: str, text: str) -> Iterator[tuple[str, int, int]]:
    """(form, start, end) of a kind; cheap conditions come before the patterns."""
    if kind in _NUMBERED:
        for stretch in _DIGITS.finditer(text):
            low, high = max(0, stretch.start() - 6), min(len(text), stretch.end() + 24)
            for form, pattern in FORMS[kind]:
                for m in pattern.finditer(text, low, high):
                    yield form, *m.span()
        return
    if kind == "address":
        code = bool(_TOWN_CODE.search(text))
        cap = any(map(text.__contains__, _STREET_CAP))
        held = {"us": cap, "uk": cap, "short": cap, "lower": any(map(text.__contains__, _STREET_LOW)), "german": code, "french": code and any(map(text.__contains__, _STREET_FRENCH)), "spanish": code and any(map(text.__contains__, _STREET_SPANISH))}
        open_forms = [f for f in FORMS[kind] if held[f[0]]]
    elif kind == "email":
        held = {"plain": "@" in text, "escaped": "%40" in text, "spelled": " dot " in text or " DOT " in text, "bracketed": any(b in text for b in ("at]", "at)", "at}", "at>", "AT", "at ]", "at )", "@]", "@)", "@ "))}
        open_forms = [f for f in FORMS[kind] if held[f[0]]]
    else:
        capitals = bool(_CAPITALS.search(text))
        han = not text.isascii()
        held = {"mixed": capitals, "three": capitals, "upper": capitals, "reversed": capitals and ", " in text, "han": han}
        open_forms = [f for f in FORMS[kind] if held[f[0]]]
        for word in _LOW_WORD.finditer(text):
            if not word.group().endswith(_LOW_ENDINGS):
                continue
            low = max(0, word.end() - 80)
            if (name := _LOW_BACK.search(text, low, word.end())) and name["first"] not in NOT_NAME and name["name"].rpartition(" ")[2] not in NOT_NAME:
                yield "lower", *name.span("name")
    group = 1 if kind == "name" else 0
    for form, pattern in open_forms:
        for m in pattern.finditer(text):
            if kind != "name" or form in ("han", "reversed") or m[1][1] == "." or _folded(m[1].partition(" ")[0]) not in NOT_NAME:
                yield form, *m.span(group)


@lru_cache(1 << 16)
def _hashed(*parts: object) -> int:
    return zlib.crc32("\x1f".join(map(str, parts)).encode()) % BUCKETS


_PIECES, _REPEATED = re.compile(r"\w+|[^\w\s]"), re.compile(r"(.)\1+")


def _features(kind: str, text: str, s: int, e: int, form: str, votes: list[int]) -> list[int]:
    before = _PIECES.findall(text, max(0, s - 30), s)[-2:]
    after = _PIECES.findall(text, e, e + 20)[:2]
    span = text[s:e]
    shape = _REPEATED.sub(r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in span))[:16]
    words = span.split()
    first, last = _folded(words[0]), _folded(words[-1])
    if kind == "name" and form == "reversed":
        first, last = last, first
    found = [_hashed(kind, "bias"), _hashed(kind, form), _hashed(kind, "shape", shape), _hashed(kind, "end", last[-4:])]
    if kind == "name":
        found += [_hashed(kind, "first", first), _hashed(kind, "last", last), _hashed(kind, "begin", last[:4])]
    found += [_hashed(kind, "vote", i, v) for i, v in enumerate(votes)]
    found += [_hashed(kind, "before", i, w.lower()) for i, w in enumerate(reversed(before))]
    found += [_hashed(kind, "after", i, w.lower()) for i, w in enumerate(after)]
    return found


def candidates(text: str | None) -> list[tuple[int, int, int, str, list[int]]]:
    """(kind number, start, end, votes as text, hashed features) of every candidate span."""
    if not text:
        return []
    found = []
    for k, kind in enumerate(KINDS):
        seen: dict[tuple[int, int], str] = {}
        for form, s, e in _matches(kind, text):
            if kind == "phone" and (more := EXTENSION.match(text, e)):
                e = more.end()
            seen.setdefault((s, e), form)
        if kind == "address":  # a span inside a longer one is the same mention cut short
            seen = {(s, e): f for (s, e), f in seen.items() if not any((a, b) != (s, e) and a <= s and e <= b for a, b in seen)}
        if kind == "email":  # clone addresses of repositories are none by definition
            seen = {(s, e): f for (s, e), f in seen.items() if not re.match(r":[\w~/.-]*/", text[e : e + 80])}
        for (s, e), form in seen.items():
            votes = _votes(kind, text, s, e, form)
            found.append((k, s, e, "".join("-0+"[v + 1] for v in votes), _features(kind, text, s, e, form, votes)))
    return found


CANDIDATES = "kinds array<int>, starts array<int>, ends array<int>, votes array<string>, features array<array<int>>"


def propose(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """One row per text that has candidates, with them as parallel arrays. No shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [candidates(t) for t in rows["_text"]]
            has = [bool(f) for f in found]
            out = plain(rows[keep]).loc[has].reset_index(drop=True)
            some = [f for f in found if f]
            for i, name in enumerate(("kinds", "starts", "ends", "votes", "features")):
                out[name] = pd.Series([[c[i] for c in f] for f in some], dtype=object)
            yield out

    return df.where(F.col(text) != "").select(*keep, F.col(text).alias("_text")).mapInPandas(run, f"{schema}, {CANDIDATES}")


def estimate(patterns: dict[str, int]) -> tuple[dict[str, float], np.ndarray]:
    """Expectation maximisation over counted vote patterns of one kind.

    Returns the probability of a true mention for each pattern and, per labeler,
    P(vote | true) and P(vote | false) with votes in the order against, abstain, for.
    The start is the sign of the summed votes; counts are smoothed by one. A labeler that
    abstains says little of a candidate (`ABSTAIN` of its log-odds), else the contexts in
    which mentions often stand would pass for the mentions themselves. Patterns without a
    vote for stay false, those with at least `SURE` votes for and none against stay true;
    they keep the two classes apart.
    """
    keys = sorted(patterns)
    votes = np.array([["-0+".index(c) for c in k] for k in keys])
    weight = np.array([patterns[k] for k in keys], float)
    total = (votes - 1).sum(axis=1)
    true = np.where(total > 1, 0.9, np.where(total > 0, 0.6, 0.1))
    lost, sure = ~(votes == 2).any(axis=1), ((votes == 2).sum(axis=1) >= SURE) & ~(votes == 0).any(axis=1)
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(EM_ROUNDS):
        prior = (weight @ true + 1) / (weight.sum() + 2)
        for c, p in enumerate((true, 1 - true)):
            for j in range(votes.shape[1]):
                table[c, j] = np.bincount(votes[:, j], weight * p, minlength=3) + 1
            table[c] /= table[c].sum(axis=1, keepdims=True)
        logs = np.log(table)
        logs[:, :, 1] *= ABSTAIN
        gap = np.log(prior) - np.log1p(-prior) + sum(logs[0, j, votes[:, j]] - logs[1, j, votes[:, j]] for j in range(votes.shape[1]))
        new = np.where(lost, 0.02, np.where(sure, 0.98, 1 / (1 + np.exp(-np.clip(gap, -30, 30)))))
        if np.abs(new - true).max() < 1e-5:
            true = new
            break
        true = new
    return dict(zip(keys, true.tolist(), strict=True)), table


def fit_classifier(features: list[list[int]], targets: list[float], rounds: int = 120) -> np.ndarray:
    """Logistic regression with soft targets over hashed features, full-batch, L2."""
    weights, speed = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    if not targets:
        return weights
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    columns = np.concatenate([np.asarray(f) for f in features])
    y = np.asarray(targets)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(rows, weights[columns], len(y))))
        slope = np.bincount(columns, (p - y)[rows], BUCKETS) / len(y) + 1e-5 * weights
        speed += slope**2
        weights -= 0.3 * slope / np.sqrt(speed)
    return weights


def train(found: DataFrame) -> np.ndarray:
    """Weights of the span classifier for a materialised table of `propose`."""
    spans = found.select(F.explode(F.arrays_zip("kinds", "votes", "features", "starts")).alias("c"), F.xxhash64("tbl", "row_id").alias("h")).select("h", "c.*")
    counted = spans.groupBy("kinds", "votes").count().collect()  # at most 3^labelers patterns per kind
    posterior: dict[int, dict[str, float]] = {}
    for k in range(len(KINDS)):
        patterns = {r["votes"]: r["count"] for r in counted if r["kinds"] == k}
        posterior[k] = estimate(patterns)[0] if patterns else {}
    # About TRAIN_ROWS of each kind by hash, however many there are.
    total = {k: sum(r["count"] for r in counted if r["kinds"] == k) for k in range(len(KINDS))}
    chance = F.pmod(F.xxhash64("h", "starts"), F.lit(1_000_000))
    wanted = F.lit(False)
    for k, n in total.items():
        if n:
            wanted = wanted | ((F.col("kinds") == k) & (chance < int(min(1.0, TRAIN_ROWS / n) * 1_000_000)))
    sample = spans.where(wanted).select("kinds", "votes", "features").toArrow()
    rows = list(zip(*(sample.column(c).to_pylist() for c in ("kinds", "votes", "features")), strict=True))
    return fit_classifier([f for *_, f in rows], [posterior[k][v] for k, v, _ in rows])


def choose(kinds: list[int], starts: list[int], ends: list[int], features: list[list[int]], weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans the classifier accepts, without overlaps within or across kinds."""
    scored = []
    for k, s, e, f in zip(kinds, starts, ends, features, strict=True):
        score = float(weights[np.asarray(f)].sum())
        if score > 0:
            # Of the accepted spans that overlap, addresses go first, then the longest, then the surest.
            scored.append((KINDS[k] != "address", s - e, -score, s, e, k))
    taken: list[tuple[int, int, int]] = []
    for _, _, _, s, e, k in sorted(scored):
        if all(e <= a or s >= b for _, a, b in taken):
            taken.append((k, s, e))
    return sorted(taken, key=lambda t: t[1:])


FOUND = "array<struct<pii_kind:string,start_pos:bigint,end_pos:bigint>>"


def decide(found: DataFrame, weights: np.ndarray) -> DataFrame:
    """Replace the candidate arrays of `propose` by `spans`, the accepted mentions."""

    @F.pandas_udf(FOUND)
    def accepted(kinds: pd.Series, starts: pd.Series, ends: pd.Series, features: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"pii_kind": KINDS[k], "start_pos": s, "end_pos": e} for k, s, e in choose(*row, weights)] for row in zip(kinds, starts, ends, features, strict=True)]
        )

    return found.withColumn("spans", accepted("kinds", "starts", "ends", "features")).drop("kinds", "starts", "ends", "votes", "features")


def find_pii(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("tbl", "row_id")) -> DataFrame:
    """`keep` columns (which must hold `tbl` and `row_id`) and `spans` for every text with a mention."""
    found = durable(propose(df, text, list(keep)))
    return decide(found, train(found)).where(F.size("spans") > 0)


def replace_spans(text: str, spans: str = "spans"):
    """Column: `text` with every span replaced by `<REDACTED:kind>`, from the right."""
    return F.aggregate(
        F.reverse(F.col(spans)),
        F.col(text),
        lambda t, s: F.concat(F.substr(t, F.lit(1), s["start_pos"].cast("int")), F.lit("<REDACTED:"), s["pii_kind"], F.lit(">"), F.substr(t, (s["end_pos"] + 1).cast("int"))),
    )
