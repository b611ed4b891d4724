"""Problem 1: literal credentials in shell and code text.

Method: the text is cut into lexical tokens (private-key blocks, references, options,
identifiers, the `://` of a URL, everything else). Every finding starts from a token: an
identifier or option whose words name a credential is followed to the literal that is
assigned or passed to it; a command opens a scope in which one of its short options is
followed by the password; a scheme word, the `://` of a URL, an issuer's prefix at the
start of an identifier or a private-key block mark the literal that comes with them.
The literal is a finding unless it is a reference, a template or a placeholder. What
follows a token is matched from there on and not beyond its line or its URL, so that
the work grows with the text and not with its square.

Only the literal's content is replaced: quotes, escapes before them, names, user
names, hosts and scheme words stay, so the code around it still parses.

Defined results: null text gives null text and no spans; empty text gives empty
text and no spans; every repeated row is scanned on its own; offsets are 0-based
code points. Extra columns pass through untouched.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACEHOLDER = "<REDACTED:credential>"

SPANS = T.ArrayType(T.StructType([T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())]))

# Words that name a credential, alone or after a qualifying word.
CREDENTIAL_WORDS = frozenset(
    "password passwd passphrase passwort kennwort contraseña contrasena pass pwd secret token credential credentials "
    "apikey authtoken accesstoken secretkey accesskey privatekey senha 密码 密钥 口令 令牌 パスワード пароль".split()
)
KEY_QUALIFIERS = frozenset("api access secret private signing account auth encryption master shared service client storage subscription deploy webhook session".split())
CREDENTIAL_ENDING = re.compile(r"(?:password|passwd|passphrase|passwort|secret|apikey|secretkey|accesskey|privatekey|authtoken|accesstoken|(?:db|user|admin|root|smtp|my|login)(?:pass|pwd)|密码|密钥)$")

# Issuer prefixes of credentials that mark themselves.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_-])(?:"
    r"sk-(?:ant-|proj-|service-account-)?[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,}|hf_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{20,}|[srp]k_(?:live|test)_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}"
    r"|A(?:KIA|SIA)[A-Z0-9]{16}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|pypi-[A-Za-z0-9_-]{20,}|dop_v1_[a-f0-9]{32,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r")(?![A-Za-z0-9_])"
)

# Texts that stand where a secret would stand.
NOT_A_SECRET = re.compile(
    r"(?is)(?:[x*.•#?_-]+|0+|1234\d*|null|none|nil|true|false|undefined|string|str|required|optional|text|secret|password|passwd|token|key|value|empty|unset"
    r"|hidden|masked|foo|bar|changeme|change[-_ ]me|todo|tbd|n/a|env|file|stdin|prompt|default|your[-_ ].*|my[-_ ].*|.*[-_]here|<.*|\[.*\]|\{.*\}|%\w+%|.*\*{3,}.*|.*x{6,}.*"
    r"|.*(?:example|sample|dummy|placeholder|redacted|insert[-_ ]).*)"
)
REFERENCE = re.compile(r"\$|.*\$\{|.*\$\(|.*\{\{|.*<REDACTED:|.*<HASHED:|.*<REPLACED:|(?:self|this|os|process|config|settings|args|env|ENV|request|req|secrets|options|opts|ctx|var|local|data)[.\[]", re.S)
LOWER_PATH = re.compile(r"(?:~|\.{1,2})?(?:/[A-Z]?[a-z._-]*[0-9]{0,4})+|(?:~|\.{1,2})?(?:/[a-z0-9._-]*)+|[a-z][\w-]*(?:/[a-z][\w.-]*)+|[A-Za-z]:\\.*")
NAME_PATH = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")

LEXER = re.compile(
    r"(?P<pem>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"
    r"|(?P<open>\$\{\{|\$\{|\$\(|\{\{)"
    r"|(?P<ref>\$\w+)"
    r"|(?P<flag>(?<![\w-])--?[A-Za-z][\w-]*)"
    r"|(?P<word>[^\W\d]\w*(?:-\w+)*)"
    r"|(?P<url>://)"
    r"|(?P<end>[;|&\n])"
    r"|(?P<colon>:)"
)
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
CLOSING = {"${{": "}}", "{{": "}}", "${": "}", "$(": ")"}
WORDS = re.compile(r"[A-Z]+(?![a-zà-ÿ])|[A-Z]?[a-zà-ÿ]+|[^\W\d_A-Za-zà-ÿ]+")
AFTER_NAME = re.compile(
    r"(?P<close>\\*[\"'`]?\]?)(?:"
    r"[^\S\n]*(?:[^\W\d]\w*[^\S\n]*)?(?P<typed>(?<=[^\S\n])=(?![=~>]))[^\S\n]*"
    r"|[^\S\n]*(?P<op>:=|=>|=(?![=~])|:(?![:=/]))[^\S\n]*(?:(?:string|str|String)[^\S\n]*=[^\S\n]*)?"
    r")"
)
IN_CALL = re.compile(r"(?P<close>\\*[\"'])\s*,\s*(?=\\*[\"'])|\(\s*(?=\\*[\"'])")
BARE = re.compile(r"[^\s'\"`;,|<>(){}\[\]\\&$]+")
BARE_CONFIG = re.compile(r"[^\s'\"`;,|<>(){}\[\]\\$]+")
BLANKS = re.compile(r"[^\S\n]+")
QUOTED = re.compile(r"(?P<slash>\\*)(?P<quote>[\"'`])")
# What may follow a word that opens it; matched from the end of that word.
SCHEMES = frozenset("bearer basic token apikey bot".split())
AFTER_SCHEME = re.compile(r"[^\S\n]+(?P<value>[A-Za-z0-9._~+/-]{6,}=*)")
AFTER_AUTHORISATION = re.compile(r"(?i)\\*[\"']?\s*[:=]\s*\\*[\"']?\s*(?:(?:bearer|basic|token|apikey|bot)\b[^\S\n]*)?(?!(?:bearer|basic|token|digest|apikey|bot)\b)(?P<value>[A-Za-z0-9._~+/-]{6,}=*)")
AFTER_ECHO = re.compile(r"\s+(?:-n\s+)?(?P<quote>['\"]?)(?P<value>[^\s|'\"]+)(?P=quote)\s*\|\s*[^|;\n]*?(?:--(?:password|token|secret)-stdin|--with-token|\bsudo\s+-S)")
AFTER_PASSWORD_COMMAND = re.compile(r"[ =](?P<quote>['\"])(?:echo|printf)\s+(?P<value>[^\s'\"]+)(?P=quote)")
AFTER_SECURE_STRING = re.compile(r"\s+(?:-String\s+)?(?P<quote>['\"])(?P<value>[^'\"\n]+)(?P=quote)")
AFTER_IDENTIFIED_BY = re.compile(r"\s+(?:password\s+)?(?P<quote>\\*['\"])(?P<value>[^'\"\\\n]+)(?P=quote)", re.I)
IDENTIFIED = re.compile(r"(?i)\bidentified\s+(?:with\s+[\w'\"]+\s+)?$")
# The user part after the `://` of a URL, and the letters before it.
URL_USER = re.compile(r"[^\s/@:'\"<>]*:(?P<value>[^\s/@'\"<>]+)@")
URL_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
# A line of a password file from the colon before its port on.
COLON_FILE = re.compile(r"(?<=[\w.*-]):(?:\d{2,5}|\*):[\w.*-]+:[\w.*-]+:(?P<value>[^\s:'\"\\]+)")
PROSE = re.compile(r"[^\S\n]+(?:is|was|ist|lautet|es|est|:)[^\S\n]+(?:now[^\S\n]+)?[\"'`]?(?P<value>[^\s'\"`,;]+)")
SPACED = re.compile(r"\\*[\"']?[^\S\n]+(?P<value>[^\s'\"`;,|<>(){}\[\]\\&$]+)(?![^\S\n]*[=:(])")
SQL_QUOTED = re.compile(r"[^\S\n]+(?:by[^\S\n]+)?(?P<quote>['\"])(?P<value>[^'\"\n]+)(?P=quote)", re.I)
# Commands and how the short option that takes their password goes on.
_VALUE = r"(?P<quote>['\"]?)(?P<value>[^\s'\"]+)(?P=quote)"
_USER = re.compile(rf"(?:-u|-a|--user|--auth)[ =]?(?P<quote>['\"]?)[^\s:'\"/]+:(?P<value>[^\s'\"]+)(?P=quote)")
SHORT_OPTIONS = (
    {"sshpass": re.compile(rf"-p\s*{_VALUE}"), "docker login": re.compile(rf"-p[ =]?{_VALUE}"), "redis-cli": re.compile(rf"-a\s+{_VALUE}")}
    | dict.fromkeys(("mysql", "mysqldump", "mysqladmin", "mariadb"), re.compile(rf"-p{_VALUE}"))
    | dict.fromkeys(("curl", "http", "https", "wget"), _USER)
)

#: A condition that every text with a finding fulfils; it keeps most rows inside the JVM.
GATE = r"(?i)pass|identified|pwd|passwor|contrase|kennwort|senha|secret|token|key|cred|auth|bearer|basic|private|://|curl|wget|mysql|mariadb|docker|sudo|redis-cli|http|sshpass|sk[-_]|gh[pousr]_|glpat|xox|hf_|npm_|[rp]k_|AIza|A[KS]IA|eyJ|pypi-|dop_v1|SG\.|密|口令|令牌|パスワード|пароль|pgpass|SecureString"


@lru_cache(1 << 14)
def names_credential(name: str) -> bool:
    words = [w.lower() for w in WORDS.findall(name)]
    if not words:
        return False
    last = words[-1]
    if last in CREDENTIAL_WORDS or CREDENTIAL_ENDING.search(last):
        return True
    if last == "key":
        return len(words) > 1 and words[-2] in KEY_QUALIFIERS
    return words[-3:] == ["access", "key", "id"] or "".join(words[-2:]) in ("accesskeyid",)


def is_path(value: str) -> bool:
    """A path of words; not a key whose alphabet has the slash, which shows in a long part of mixed letters and digits."""
    if not LOWER_PATH.fullmatch(value):
        return False
    return not any(len(p) >= 10 and re.search(r"\d[A-Za-z]", p) and re.search(r"[a-z]", p) and re.search(r"[A-Z]", p) for p in value.split("/"))


def looks_random(value: str) -> bool:
    """Letters and digits mixed as people's words and paths seldom mix them."""
    return len(value) >= 8 and bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value)) and not is_path(value)


def is_wordy(value: str) -> bool:
    """Words joined by separators, as in file, style or function names."""
    return bool(re.fullmatch(r"[a-z]+(?:[-_][a-z]+)*", value))


def is_literal(value: str, quoted: bool, follows: str, name: str) -> bool:
    """Whether the text given to a credential-named identifier is a secret written out."""
    if len(value) < 4 or NOT_A_SECRET.fullmatch(value) or REFERENCE.match(value):
        return False
    if re.fullmatch(r"[\d.,:]+", value) or is_path(value) or "://" in value:
        return False
    if value.startswith(("-----BEGIN", "sha256:", "sha512-", "ssh-")) or re.search(r"[.\]})][*+?]|\\[dws]|\[[^\[\]-]*-[^\[\]]*\]", value):
        return False
    if " " in value:
        return quoted and "pass" in name.lower() and len(value.split()) <= 12 and not re.search(r"[.:!?]\s|\b(?:must|should|the|is)\b", value)
    if quoted:
        return not names_credential(value) or bool(re.search(r"\d", value))
    if follows[:1] in ("(", "[") or names_credential(value) and not re.search(r"\d", value) and "." not in value.strip("."):
        return False
    if NAME_PATH.fullmatch(value) and "." in value and names_credential(value.rpartition(".")[2]):
        return False
    return True


def _value_at(text: str, at: int, name: str, query: bool = False, plain: bool = False) -> tuple[int, int] | None:
    """The literal that begins at `at`, quoted or bare; None if there is none."""
    if opening := QUOTED.match(text, at):
        delimiter = opening.group()
        start, line = opening.end(), text.find("\n", opening.end())
        line = len(text) if line < 0 else line
        end = text.find(delimiter, start, line)
        while end > 0 and not opening["slash"] and text[end - 1] == "\\":
            end = text.find(delimiter, end + 1, line)
        if end < 0:
            return None
        return (start, end) if is_literal(text[start:end], True, "", name) else None
    found = (BARE if query else BARE_CONFIG).match(text, at)
    if not found:
        return None
    start, end = found.span()
    value = text[start:end]
    if "&&" in value:
        end = start + value.index("&&")
        value = text[start:end]
    if value.endswith("&"):
        value, end = value[:-1], end - 1
    if plain and re.fullmatch(r"[a-z]+", value) and not (len(value) >= 9):
        return None
    return (start, end) if is_literal(value, False, text[end : end + 1], name) else None


class Scan:
    """One pass over the tokens of a text; collects (rank, start, end)."""

    def __init__(self, text: str):
        self.text = text
        self.found: list[tuple[int, int, int]] = []
        self.next: dict[str, int] = {}  # the next place of a closing mark, once looked up
        self.password_file = "pgpass" in text
        self.keys_end = True

    def add(self, start: int, end: int, rank: int) -> None:
        if end > start:
            self.found.append((rank, start, end))

    def after(self, mark: str, at: int) -> int:
        """The first place of `mark` from `at` on; the length of the text if there is none."""
        if self.next.get(mark, -1) < at:
            place = self.text.find(mark, at)
            self.next[mark] = len(self.text) if place < 0 else place
        return self.next[mark]

    def run(self, begin: int, stop: int, names: bool = True) -> None:
        """Follow the tokens between two places; without `names` only literals that mark themselves."""
        text, at, command = self.text, begin, ""
        tokens = LEXER.finditer(text, at, stop)
        while True:
            token = next(tokens, None)
            if token is None:
                return
            kind, (start, end) = token.lastgroup, token.span()
            if kind == "pem":
                closing = PEM_END.search(text, end, stop) if self.keys_end else None
                self.keys_end = closing is not None or stop < len(text)
                if closing:
                    self.key_block(start, closing.end())
                    tokens = LEXER.finditer(text, closing.end(), stop)
            elif kind == "open":
                mark = CLOSING[token.group()]
                close = self.after(mark, end)
                if close < stop and (len(mark) == 2 or self.after("\n", end) > close):
                    self.run(end, close, names=False)
                    tokens = LEXER.finditer(text, close + len(mark), stop)
            elif kind == "url":
                if URL_SCHEME.search(text[max(begin, start - 40) : start]) and (user := URL_USER.match(text, end)):
                    self.marked(user, 1)
            elif kind == "end":
                command = ""
            elif kind == "colon":
                if self.password_file and (line := COLON_FILE.match(text, start)):
                    self.marked(line, 2)
            elif kind in ("flag", "word"):
                if command and kind == "flag" and text[start - 1 : start].isspace() and (option := SHORT_OPTIONS[command].match(text, start)):
                    self.marked(option, 2)
                    command = ""
                command = self.command(token.group(), start, command)
                self.signalled(token.group(), start, end, kind)
                if names and names_credential(name := token.group().lstrip("-")):
                    self.named(name, start, end, kind)

    def key_block(self, start: int, end: int) -> None:
        body = re.sub(r"-----[A-Z0-9 ]+-----|\\[nr]|\s", "", self.text[start:end])
        if len(body) >= 16 and not NOT_A_SECRET.fullmatch(body):
            self.add(start, end, 0)

    def command(self, word: str, start: int, before: str) -> str:
        """The command whose options may follow."""
        if word == "login" and re.search(r"\bdocker\s+$", self.text[max(0, start - 24) : start]):
            return "docker login"
        for part in (word, *(word.split("-") if "-" in word else ())):
            if part in SHORT_OPTIONS:
                return part
        return before

    def marked(self, m: re.Match, rank: int, long: bool = False) -> None:
        """A literal whose place alone says that it is a secret."""
        value = m["value"]
        if is_literal(value, True, "", "password") and (not long or looks_random(value) and len(value) >= 16):
            self.add(*m.span("value"), rank)

    def signalled(self, word: str, start: int, end: int, kind: str) -> None:
        """What a word says of the literal after it, or of itself by an issuer's prefix."""
        text, low = self.text, word.lower()
        if low.rpartition("-")[2] in SCHEMES and (m := AFTER_SCHEME.match(text, end)):
            self.marked(m, 3, long=True)
        if low.endswith("authorization") and (m := AFTER_AUTHORISATION.match(text, end)):
            self.marked(m, 2)
        elif low in ("echo", "printf") and (m := AFTER_ECHO.match(text, end)):
            self.marked(m, 2)
        elif low == "by" and IDENTIFIED.search(text[max(0, start - 64) : start]) and (m := AFTER_IDENTIFIED_BY.match(text, end)):
            self.marked(m, 2)
        elif low in ("--password-command", "--passphrase-command") and (m := AFTER_PASSWORD_COMMAND.match(text, end)):
            self.marked(m, 2)
        elif word == "ConvertTo-SecureString" and (m := AFTER_SECURE_STRING.match(text, end)):
            self.marked(m, 2)
        if kind == "word" and (m := ISSUED.match(text, start) if word.isascii() else ISSUED.search(text, start, end)):
            bare = re.split(r"[-_]", m.group(), maxsplit=1)[-1]
            if not is_wordy(bare) and re.search(r"\d|[A-Z]", bare) and not NOT_A_SECRET.fullmatch(m.group()) and not REFERENCE.match(m.group()):
                self.add(*m.span(), 4)

    def opens_call(self, start: int) -> bool:
        """Whether only quotes stand between `(` and the place."""
        at = start - 1
        while at >= 0 and self.text[at] in "\\\"'":
            at -= 1
        return at >= 0 and self.text[at] == "("

    def named(self, name: str, start: int, end: int, kind: str) -> None:
        """The literal that is assigned or passed to a credential's name."""
        text = self.text
        before = text[start - 1 : start]
        query = before in ("?", "&")
        if bound := AFTER_NAME.match(text, end):
            if span := _value_at(text, bound.end(), name, query, bound["op"] == ":" or name.islower()):
                return self.add(*span, 2)
        if (call := IN_CALL.match(text, end)) and (call["close"] is None or self.opens_call(start)):
            if span := _value_at(text, call.end(), name):
                return self.add(*span, 2)
        if before == "<" and text[end : end + 1] == ">":
            close = self.after("<", end + 1)
            if close < len(text) and is_literal(text[end + 1 : close], True, "", name):
                self.add(end + 1, close, 2)
            return None
        if kind == "flag":
            blank = BLANKS.match(text, end)
            if blank and text[blank.end() : blank.end() + 1] != "-" and (span := _value_at(text, blank.end(), name)):
                self.add(*span, 2)
            return None
        if (said := PROSE.match(text, end)) and looks_random(said["value"].rstrip(".!?)")) and is_literal(said["value"], True, "", name):
            return self.add(said.start("value"), said.start("value") + len(said["value"].rstrip(".!?)")), 3)
        if (sql := SQL_QUOTED.match(text, end)) and before not in ("'", '"', "`") and is_literal(sql["value"], True, "", name):
            return self.add(*sql.span("value"), 3)
        if (spaced := SPACED.match(text, end)) and is_literal(spaced["value"], False, text[spaced.end() : spaced.end() + 1], name):
            if looks_random(spaced["value"]) or re.search(r"\b(?:ENV|set|login\s+\S+|user\s+\S+)\s+\S*$", text[max(0, start - 80) : start]) and not is_wordy(spaced["value"]):
                self.add(*spaced.span("value"), 3)
        return None


def find_credentials(text: str | None) -> list[tuple[int, int]]:
    """Code-point spans of the literal credentials in `text`, in order, without overlaps."""
    if not text:
        return []
    scan = Scan(text)
    scan.run(0, len(text))
    kept: list[tuple[int, int]] = []
    for _, start, end in sorted(set(scan.found)):
        at = bisect_left(kept, (start, end))
        if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
            kept.insert(at, (start, end))
    return kept


def redact(text: str | None, spans: list[tuple[int, int]], placeholder: str = PLACEHOLDER) -> str | None:
    """`text` with the content of each span replaced and everything else unchanged."""
    if text is None:
        return None
    parts, at = [], 0
    for start, end in spans:
        parts += [text[at:start], placeholder]
        at = end
    return "".join([*parts, text[at:]])


def with_credentials(df: DataFrame, column: str, redacted: str | None = None) -> DataFrame:
    """Add `credential_spans` (and the redacted text, if a name is given) for a text column.

    Rows that cannot hold a credential get an empty array inside the JVM; only
    the rest crosses into Python, in Arrow batches. No shuffle.
    """

    @F.pandas_udf(SPANS)
    def spans_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"start_pos": s, "end_pos": e} for s, e in find_credentials(t)] for t in texts])

    text = F.col(column)
    empty = F.array().cast(SPANS)
    out = df.withColumn("_gated", F.when(text.rlike(GATE), text)).withColumn("credential_spans", F.coalesce(spans_of("_gated"), empty)).drop("_gated")
    if redacted:
        # Right to left, so that earlier offsets stay valid.
        out = out.withColumn(
            redacted,
            F.when(
                text.isNotNull(),
                F.aggregate(
                    F.reverse("credential_spans"),
                    text,
                    lambda t, s: F.concat(F.substr(t, F.lit(1), s["start_pos"].cast("int")), F.lit(PLACEHOLDER), F.substr(t, (s["end_pos"] + 1).cast("int"))),
                ),
            ),
        )
    return out
