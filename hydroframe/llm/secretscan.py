"""Secret scans (operator 10): candidates of a text, judged by a random forest.

A candidate is a run of at least SHORTEST bytes out of letters, digits and
+ / = _ - . (each part of it between = signs), the value of any length and any
characters that a name with a key word is given (password = "..."), a password in
an address (scheme://user:password@host), or a private-key block's head.  Most
candidates are no secrets, so a forest removes false positives.  It looks at the
candidate's length, its transitions between kinds of characters and between
letters, how much of it a dictionary covers, the path that the text came from, and
the words before and after.  It is fitted on labelled findings, by default on
`labelled`, which draws them from a seed: real forms of keys and tokens, and what
is mistaken for them (plain words, numbers and code given to names, hashes of commits and files, identifiers, placeholders,
encoded pictures, long words, paths).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm import textkit

SHORTEST, NEAR = 16, 48
#: Features of a longer candidate are those of so many bytes at its start; it is masked as a whole.
MOST_READ = 1 << 14
MARK = "[SECRET]"

# Words that stand beside secrets, beside look-alikes, in placeholders and in paths, and common word parts.
KEY_WORDS = ["token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "api-key", "access_key", "private_key", "auth", "bearer", "credential", "key", "passphrase", "pass"]
PASS_WORDS = ["password", "passwd", "pwd", "passphrase", "pass"]
OTHER_WORDS = ["commit", "sha256", "sha1", "md5", "checksum", "integrity", "uuid", "guid", "hash", "digest", "etag", "revision", "image", "base64", "id", "version", "http", "www", "href", "src", "file", "path", "doi", "isbn"]
PLACEHOLDERS = ["example", "your", "xxxx", "placeholder", "changeme", "dummy", "sample", "test", "foobar", "12345678", "abcdef", "insert", "redacted", "0000"]
TEST_PATHS = ["test", "example", "sample", "doc", "fixture", "mock", "readme"]
CODE_PATHS = [".env", ".py", ".js", ".yml", ".yaml", ".json", ".conf", ".ini", "config", "settings", "secret"]
PARTS = "the and ing ion tion ent ter for that with have from this not are was all one out use you can has her his they will would there their what about which when make like time just know take into year good some could them see other than then now look only come over think also back after work first well way even new want because any these give day most er re on an in en es st nt ed nd to or ea ti at te it is he ha of ou le la de des les que une dans pour par sur avec est ment eau aux oi ai tre der die das und ein sch ich ung keit lich heit ver be ge el los las una con ción mente ado ara".split()
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "rk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "ya29", "eyJ", "npm_", "pypi-", "SG."]

#: Bytes of candidates.
INSIDE = np.zeros(256, bool)
INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/=_-."]] = True
HEAD = re.compile(rb"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")

#: A name with a key word and what gives it a value, the value (quoted, or up to the next name's), and a password in an address.
_NAME = r"(?:passphrase|password|passwd|pass|pwd|secret|token|api[_-]?key|auth|bearer|credential|key)[\w-]{0,40}[\"'`\])]{0,3}[ \t]*(?::[ \t]*[A-Za-z_][\w.<>\[\]]{0,40}[ \t]*=(?!=)|:=|=>|={1,3}|:(?!//))[ \t]*"
NAMED = re.compile(_NAME.encode(), re.I)
VALUE = re.compile(rb"""\"((?:[^"\\\r\n]|\\.)+)"|'((?:[^'\\\r\n]|\\.)+)'|`([^`\r\n]+)`|["'`]?((?:(?![&,;|][\w.-]+[=:])[^\s"'`<>])+)""")
LOGIN = re.compile(rb"""://[^\s/:@"'<>]*:([^\s/"'<>]+)@""")

_KIND = np.full(256, 4, np.int64)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 0, 1, 2
_KIND[[ord(c) for c in "+/=_-."]] = 3

FEATURES = [
    "length", "log_length", "digits", "upper", "lower", "marks", "changes", "digit_letter", "case_changes", "letter_pairs", "vowel_share", "distinct", "entropy",
    "hex_only", "longest_letters", "longest_same", "covered", "prefix", "placeholder", "uuid", "key_word", "other_word", "assigned", "quoted", "path_test", "path_code", "slashes", "dots",
    "others", "named", "pass_word", "login",
]


def _pair_logs() -> np.ndarray:
    """Logarithms of how likely one lower-case letter follows another, by the word parts."""
    n = np.full((26, 26), 0.3)
    for word in PARTS:
        low = [ord(c) - 97 for c in word if "a" <= c <= "z"]
        for a, b in zip(low, low[1:], strict=False):
            n[a, b] += 1
    return np.log(n / n.sum(axis=1, keepdims=True))


_PAIRS = _pair_logs()
_COVER = re.compile("|".join(sorted((re.escape(w) for w in PARTS if len(w) > 1), key=len, reverse=True)))
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_NAMED_BEFORE = re.compile(_NAME + r"[\"'`]?\Z", re.I)
_ASSIGN = re.compile(r"[:=]\s*[\"'`]?$|\bbearer\s+$")


def _beside(words: list[str], text: str) -> int:
    return int(any(re.search(rf"(?:^|[^a-z]){re.escape(w)}(?:$|[^a-z])", text) for w in words))


def describe(candidate: str, before: str, after: str, path: str) -> list[float]:
    """The features of a candidate, in the order of FEATURES."""
    raw = np.frombuffer(candidate.encode("latin-1", "replace"), np.uint8)
    n = len(raw)
    kind = _KIND[raw]
    share = np.bincount(kind, minlength=5) / n
    change = kind[1:] != kind[:-1]
    mixed = change & (np.minimum(kind[1:], kind[:-1]) == 0) & (np.maximum(kind[1:], kind[:-1]) < 3)
    cases = change & (kind[1:] + kind[:-1] == 3) & (np.minimum(kind[1:], kind[:-1]) == 1)
    low = raw | 0x20
    letter = (kind == 1) | (kind == 2)
    both = letter[1:] & letter[:-1]
    pairs = _PAIRS[low[:-1][both] - 97, low[1:][both] - 97].mean() if both.any() else -6.0
    vowels = np.isin(low[letter], np.frombuffer(b"aeiou", np.uint8)).mean() if letter.any() else 0.0
    n_each = np.bincount(raw, minlength=1)
    p = n_each[n_each > 0] / n
    small = candidate.lower()
    same = max((len(m[0]) for m in re.finditer(r"(.)\1*", small)), default=0)
    letters = max((len(m[0]) for m in re.finditer(r"[a-z]+", small)), default=0)
    covered = sum(len(m[0]) for m in _COVER.finditer(small)) / n
    close, left, where = before.lower(), before.lower()[-32:], path.lower()
    return [
        min(n, 300), np.log(n), share[0], share[1], share[2], share[3], change.sum() / n, mixed.sum() / n, cases.sum() / n, pairs, vowels, len(p) / min(n, 64), float(-(p * np.log2(p)).sum()),
        float(re.fullmatch(r"[0-9a-f]+", small) is not None), letters, same, covered, float(candidate.startswith(tuple(PREFIXES))), float(any(w in small for w in PLACEHOLDERS)), float(_UUID.fullmatch(small) is not None),
        _beside(KEY_WORDS, left), _beside(OTHER_WORDS, close[-24:]), float(_ASSIGN.search(close[-12:]) is not None), float(before[-1:] in "\"'`" and before[-1:] != "" and after[:1] == before[-1:]), float(any(w in where for w in TEST_PATHS)), float(any(w in where for w in CODE_PATHS)), candidate.count("/") / n, candidate.count(".") / n,
        share[4], float(_NAMED_BEFORE.search(before) is not None), float(any(w in left for w in PASS_WORDS)), float(before[-1:] == ":" and after[:1] == "@"),
    ]


# --- labelled findings ------------------------------------------------------------------------------


def labelled(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(candidate, before, after, path, is a secret): n findings of either kind, drawn from a seed."""
    draw = np.random.default_rng(seed)
    pick = lambda xs: xs[int(draw.integers(len(xs)))]
    string = lambda letters, size: "".join(letters[i] for i in draw.integers(len(letters), size=size))
    hexa, digits, lower = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    upper, word = lower.upper(), lower + lower.upper() + digits
    prose = lambda k: " ".join("".join(pick(PARTS) for _ in range(int(draw.integers(1, 4)))) for _ in range(k))
    out = []
    for i in range(2 * n):
        secret = i % 2
        path = pick(["src0", "src7", "config/settings.py", ".env", "app/deploy.yml", "web", "", "notes.txt", "src12", "data/export.json"])
        left, right = prose(int(draw.integers(0, 4))) + pick([" ", "\n", ". "]), pick([" ", "\n", ", ", ". "]) + prose(int(draw.integers(0, 3)))

        def named(left=left, right=right) -> tuple[str, str]:
            name = pick(KEY_WORDS)
            name = pick([name, name.upper(), pick(["db_", "my", "service_", "client_"]) + name, f'"{name}"'])
            quote = pick(['"', "'", '"', ""])
            return left + name + pick([" = ", "=", ": ", ":", " := "]) + quote, quote + pick(["", ";", ",", "!!"] if quote else ["", "", ";", ","]) + right

        def login(left=left, right=right) -> tuple[str, str]:
            user = pick(["user", "root", "admin", "", "app_" + pick(PARTS)])
            return left + pick(["postgres", "mysql", "https", "redis", "amqp", "ftp", "mongodb+srv"]) + "://" + user + ":", "@" + pick(["localhost", "db", "10.0.0.7", "host.example.com"]) + pick(["", ":5432/db", "/"]) + right

        if secret:
            form = pick(["hex", "hex", "hex", "HEX", "base64", "word", "aws", "prefix", "jwt", "dashed", "short", "short", "short", "login"])
            if form in ("hex", "HEX"):
                value = string(hexa, pick([32, 40, 40, 48, 64]))
                value = value.upper() if form == "HEX" else value
            elif form == "base64":
                value = string(word + "+/", pick([24, 40, 43, 64])) + pick(["", "=", "=="])
            elif form == "word":
                value = string(word, int(draw.integers(20, 48)))
            elif form == "aws":
                value = pick(["AKIA", "ASIA"]) + string(upper + "234567", 16)
            elif form == "prefix":
                value = pick(PREFIXES[2:]) + string(word, int(draw.integers(24, 44)))
            elif form == "jwt":
                value = "eyJ" + string(word, int(draw.integers(15, 40))) + ".eyJ" + string(word, int(draw.integers(20, 80))) + "." + string(word + "-_", 43)
            elif form in ("short", "login"):
                value = pick([
                    string(word, int(draw.integers(6, 16))),
                    "".join(pick(PARTS) for _ in range(int(draw.integers(1, 4)))).capitalize() + string(digits, int(draw.integers(2, 5))) + pick(["", "!", "#", "$", "?"]),
                    string(word + "!@#$%^&*-_.", int(draw.integers(7, 20))),
                    string(lower, int(draw.integers(9, 24))),
                    string(word, int(draw.integers(6, 16))),
                ])
            else:
                value = "-".join(string(word, 8) for _ in range(int(draw.integers(3, 6))))
            if form in ("aws", "prefix", "jwt") and draw.random() < 0.3:
                before, after = left, right
            elif form == "login":
                before, after = login()
            else:
                before, after = named()
                if form != "short" and draw.random() < 0.1:
                    before = left + pick(["Bearer ", "bearer "])
        else:
            form = pick(["long", "long", "word-chain", "commit", "checksum", "uuid", "placeholder", "url", "digits", "picture", "camel", "rule", "junk", "mixed", "plain", "plain", "plain", "code", "number"])
            before, after = left, right
            if form == "long":
                value = "".join(pick(PARTS) for _ in range(int(draw.integers(6, 16))))
                value = pick([value, value.capitalize(), value.upper()])
                value = (value + "eatherington")[: max(SHORTEST, len(value))]
            elif form == "word-chain":
                value = pick(["-", "_", "/", "."]).join("".join(pick(PARTS) for _ in range(2)) for _ in range(int(draw.integers(3, 8))))
            elif form == "commit":
                value, before = string(hexa, 40), left + pick(["commit ", "revision ", "merge commit ", "commit: ", "see commit "])
            elif form == "checksum":
                value, before = string(hexa, pick([32, 40, 64])), left + pick(["sha256:", "md5: ", "sha1=", "checksum ", "digest: ", "integrity sha256-", "etag: ", "hash = "])
            elif form == "uuid":
                value = "-".join(string(hexa, k) for k in (8, 4, 4, 4, 12))
                before = left + pick(["", "id: ", "uuid=", "id = "])
            elif form == "placeholder":
                value = pick(["your_api_key_goes_here", "xxxxxxxxxxxxxxxxxxxxxxxx", "example_secret_token_value", "changeme-changeme-changeme", "INSERT_YOUR_TOKEN_HERE", "0000000000000000000000000000", "test_password_placeholder", "dummy_access_key_for_test", "REDACTED_REDACTED_REDACTED", "1234567890abcdef1234567890abcdef"])
                before = left + pick(KEY_WORDS) + pick([" = ", ": "]) + pick(['"', "'", ""])
            elif form == "url":
                value = "www." + "".join(pick(PARTS) for _ in range(3)) + ".com/" + "".join(pick(PARTS) for _ in range(3)) + "/" + string(digits, 4) + ".html"
                before = left + pick(["http://", "https://", "href=\"", ""])
            elif form == "digits":
                value, before = string(digits, int(draw.integers(16, 24))), left + pick(["", "isbn ", "order ", "id ", "tel "])
            elif form == "picture":
                value, before = string(word + "+/", int(draw.integers(100, 280))), left + "src=\"data:image/png;base64,"
            elif form == "plain":
                value = pick(["".join(pick(PARTS) for _ in range(int(draw.integers(1, 5)))), pick(PARTS), pick(["none", "null", "true", "false", "string", "str", "int", "required", "optional", "value", "name", "undefined", "nil", "bytes", "yes", "no", "see", "C", "user", *KEY_WORDS])])
                value, (before, after) = pick([value, value, value.capitalize(), value.upper()]), named()
            elif form == "code":
                name = pick(KEY_WORDS).replace("-", "_")
                value = pick([f"os.environ['{name.upper()}']", f"get_{name}()", f"request.{name}", f"${{{name.upper()}}}", f"${name.upper()}", f"self.{name}", f"settings.{name.upper()}", f"getenv('{name}')", f"config.{name}", f"{{{{{name}}}}}", f"<{name}>", f"process.env.{name.upper()}", f"%({name})s", "*" * int(draw.integers(3, 12)), "x" * int(draw.integers(3, 12)), "...", "lambda", f"your_{name}", f"my_{name}", f"{name}_here"])
                before, after = login() if draw.random() < 0.3 else named()
            elif form == "number":
                value, name = string(digits, int(draw.integers(1, 6))), pick(["tokens", "n_tokens", "max_tokens", "key", "token_id", "keys", "auth_level"])
                before = left + name + pick([" = ", "=", ": ", ":"])
            elif form == "camel":
                value = "".join("".join(pick(PARTS) for _ in range(2)).capitalize() for _ in range(int(draw.integers(3, 7))))
            elif form == "rule":
                value = pick(["=", "-", "_", ".", "-="]) * int(draw.integers(16, 60))
            elif form == "junk":
                value = string(pick(["ab", "xyz", "01", "-_", "ha"]), int(draw.integers(16, 40)))
            else:
                value = "".join(pick(PARTS) for _ in range(4)) + string(digits, int(draw.integers(1, 5))) + pick(["", "_final", "-v2", ".txt"])
                value = value if len(value) >= SHORTEST else value + "-" + value
        out.append((value, before[-NEAR:], after[:NEAR], path, secret))
    return out


# --- the forest -------------------------------------------------------------------------------------


class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), threshold, children, share of secrets."""

    def __init__(self, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.trees = trees

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 5) -> Forest:
        """Bootstrapped trees by Gini impurity, over a random square root of the features at each split."""
        draw = np.random.default_rng(seed)
        width = max(1, int(np.sqrt(x.shape[1])) + 1)
        made = []
        for _ in range(trees):
            rows = draw.integers(len(x), size=len(x))
            nodes: list[list[float]] = []

            def grow(some: np.ndarray, level: int, nodes=nodes) -> int:
                place = len(nodes)
                share = float(y[some].mean())
                nodes.append([-1, 0.0, 0, 0, share])
                if level == depth or len(some) < 2 * least or share in (0.0, 1.0):
                    return place
                best = (np.inf, 0, 0.0)
                for f in draw.choice(x.shape[1], width, replace=False).tolist():
                    order = np.argsort(x[some, f], kind="stable")
                    v, t = x[some[order], f], np.cumsum(y[some[order]])
                    k = np.arange(1, len(some))
                    ok = (v[1:] > v[:-1]) & (k >= least) & (len(some) - k >= least)
                    if not ok.any():
                        continue
                    a, b = t[:-1], t[-1] - t[:-1]
                    impurity = np.where(ok, a - a * a / k + b - b * b / (len(some) - k), np.inf)
                    i = int(impurity.argmin())
                    if impurity[i] < best[0]:
                        middle = float((v[i] + v[i + 1]) / 2)
                        best = (float(impurity[i]), f, middle if middle < v[i + 1] else float(v[i]))
                if best[0] == np.inf:
                    return place
                left = x[some, best[1]] <= best[2]
                nodes[place][0], nodes[place][1] = best[1], best[2]
                nodes[place][2] = grow(some[left], level + 1)
                nodes[place][3] = grow(some[~left], level + 1)
                return place

            grow(rows, 0)
            table = np.array(nodes)
            made.append((table[:, 0].astype(np.int64), table[:, 1], table[:, 2].astype(np.int64), table[:, 3].astype(np.int64), table[:, 4]))
        return cls(made)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The mean share of secrets over the trees."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                some = np.flatnonzero(inner)
                here = at[some]
                at[some] = np.where(x[some, feature[here]] <= threshold[here], left[here], right[here])
            total += share[at]
        return total / max(1, len(self.trees))


def train(findings: list[tuple[str, str, str, str, int]] | None = None, seed: int = 5) -> Forest:
    findings = labelled() if findings is None else findings
    x = np.array([describe(*f[:4]) for f in findings])
    return Forest.fit(x, np.array([f[4] for f in findings], float), seed=seed)


# --- scanning ---------------------------------------------------------------------------------------


def candidates(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the candidates of rows that lie one after another, in order and each once; they may overlap.

    Marks at the end of a run's part, and a dot or = at its start, aren't part of it.
    """
    starts, ends = textkit.runs(INSIDE[data], at)
    long = ends - starts >= SHORTEST
    spans: set[tuple[int, int]] = set()
    for first, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):  # few runs are long
        cut = np.flatnonzero(data[first:end] == 0x3D)
        edges = [first, *(first + cut[(cut > 0) & (cut < end - first - 3)] + 1).tolist(), end]
        for s, e in zip(edges, edges[1:], strict=False):
            while s < e and data[s] in b".=-_/+":
                s += 1
            while e > s and data[e - 1] in (b".-_/" if e == end or e == s + 1 else b"=.-_/"):
                e -= 1
            if e - s >= SHORTEST:
                spans.add((s, e))
    raw = data.tobytes()
    for first, end in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        free = (0, 0)  # the last value without quotes; a value that starts within it ends with it
        for m in NAMED.finditer(raw, first, end):
            if free[0] <= m.end() < free[1]:
                spans.add((m.end(), free[1]))
            elif v := VALUE.match(raw, m.end(), end):
                s, e = v.span(v.lastindex)
                if v.lastindex == 4:
                    while e > s + 1 and raw[e - 1] in b".,;:)]}":
                        e -= 1
                    free = (s, e)
                spans.add((s, e))
        spans.update(m.span(1) for m in LOGIN.finditer(raw, first, end))
    both = np.array(sorted(spans), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def united(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Spans of a row in order, those that overlap as one with the higher score."""
    out: list[tuple[int, int, float]] = []
    for s, e, p in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), max(p, out[-1][2]))
        else:
            out.append((s, e, p))
    return out


def findings(data: np.ndarray, at: np.ndarray, paths: list[str], forest: Forest, least: float) -> list[list[tuple[int, int, float]]]:
    """Of every row: (start, end, score) in bytes of what is taken for a secret."""
    starts, ends = candidates(data, at)
    rows = textkit.rows_of(starts, at)
    raw, described = data.tobytes(), []
    for s, e, r in zip(starts.tolist(), ends.tolist(), rows.tolist(), strict=True):
        before = raw[max(int(at[r]), s - NEAR) : s].decode("utf-8", "replace")
        after = raw[e : min(int(at[r + 1]), e + NEAR)].decode("utf-8", "replace")
        described.append(describe(raw[s : min(e, s + MOST_READ)].decode("latin-1"), before, after, paths[r]))
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(at) - 1)]
    if described:
        for s, e, r, p in zip(starts.tolist(), ends.tolist(), rows.tolist(), forest.score(np.array(described)).tolist(), strict=True):
            if p >= least:
                out[r].append((s - int(at[r]), e - int(at[r]), p))
    if b"PRIVATE KEY-----" in raw:
        for m in HEAD.finditer(raw):
            r = int(np.searchsorted(at, m.start(), "right")) - 1
            if m.end() <= at[r + 1]:
                end = raw.find(b"-----END", m.end(), int(at[r + 1]))
                stop = raw.find(b"\n", end) if end >= 0 else -1
                e = int(at[r + 1]) if end < 0 or stop < 0 or stop > at[r + 1] else stop
                out[r].append((m.start() - int(at[r]), e - int(at[r]), 1.0))
    return [united(x) for x in out]


def scan(docs: DataFrame, forest: Forest, least: float = 0.5, text: str = "text", path: str | None = "source") -> DataFrame:
    """Every row with secrets (an array of start, end in bytes of UTF-8 and score), n_secrets, and clean_text.

    clean_text has MARK in place of every secret, and is the text itself where
    there is none.  A null text has no secrets and a null clean_text; where path is
    null or None, features of the path are 0.  Rows that repeat stay repeated;
    columns of docs named like the new ones are replaced.
    """
    textkit.bounded_batches(docs.sparkSession)
    names = ["secrets", "n_secrets", "clean_text"]
    keep = [c for c in docs.columns if c not in names]
    with_path = docs.select(*keep, (F.coalesce(F.col(path).cast("string"), F.lit("")) if path in keep else F.lit("")).alias(textkit.fresh("path", keep)))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema), "secrets array<struct<start: bigint, end: bigint, score: double>>", "n_secrets bigint", "clean_text string"])
    place = keep.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            column = batch.column(place)
            data, at = textkit.buffers(column)
            paths = batch.column(len(keep)).to_pylist()
            for first, end, part, edges in textkit.chunks(data, at):
                found = findings(part, edges, paths[first:end], trees, least)
                clean = column.slice(first, end - first)
                touched = [i for i, x in enumerate(found) if x]
                if touched:
                    texts = clean.to_pylist()
                    for i in touched:
                        raw, done, pieces = part[edges[i] : edges[i + 1]].tobytes(), 0, []
                        for s, e, _ in found[i]:
                            pieces += [raw[done:s], MARK.encode()]
                            done = e
                        texts[i] = b"".join([*pieces, raw[done:]]).decode("utf-8", "replace")
                    clean = pa.array(texts, pa.string())
                spans = pa.array([[{"start": s, "end": e, "score": p} for s, e, p in x] for x in found], pa.list_(span))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[: len(keep)], spans, pa.array(map(len, found), pa.int64()), clean], [*keep, *names])

    return with_path.mapInArrow(textkit.trimming(run), schema)
