"""Secret scans (operator 7): long tokens and named values are candidates, a random forest removes the
false ones.

There are two kinds of candidates. Anywhere in a text, a run of at least ``SHORTEST`` characters that
keys and passwords are made of, with a digit, or with letters of both cases after the first one. And
whatever its characters, a value of at least ``SHORTEST_VALUE`` that follows a credential word and = or
:, quoted or without a space, or that stands between : and @ in an address. A value without quotes
ends before a separator and the next name, as in ``password=..;server=..``.

Each is described by its length, its character transitions, how much of it known word pieces cover,
its path marks, the marks of placeholders and prose, and the words beside it. A forest of decision
trees, trained in numpy from labelled findings, tells how many trees call it a secret. Secrets that
overlap are one finding. Scanning and masking are one narrow pass: nothing is shuffled, and every text
is read whole.

Labelled findings are rows (before, candidate, after, label). ``example_findings`` draws some from
rules with a seed; findings that reviewers have labelled can be given instead, or added.

Defined cases: a null text has no candidates and stays null; equal rows get equal findings; a
candidate of any length is one finding; a candidate that repeats in a text is found each time; an empty
table gives an empty result; without findings of both labels every candidate scores their share.
``scan`` reads two columns; ``mask`` keeps all the columns it is given.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SHORTEST = 16
SHORTEST_VALUE = 6
NEAR = 40
SECRET_FROM = 0.5
MASK = "[SECRET]"
SEED = 11
TREES = 40
N_FEATURES = 23
DEEPEST = 10
EXAMPLES = 400

# Words beside secrets, words beside look-alikes, and common syllables of plain words.
CREDENTIAL_WORDS = """
access_key api_key apikey api-key auth authorization bearer client_secret credential passphrase passwd
password private_key pwd secret secret_key token
""".split()
HARMLESS_WORDS = """
build checksum commit digest etag file hash href http https image md5 page path phone build_id request revision
sha sha1 sha256 src trace url uuid version www
""".split()
SYLLABLES = """
able age al an and ance ant ar ate ation be ber car ch con de del den der dis ed el en ence ent er es est
ex for ge gen ght heit ica ich ie ight in ing ion ist ity ive ize keit la le less lich ly man ment mo na ness
ning nt o on one oo or os ou our out ous over per pre pro que ra re ress ro sch se sh sion so sta str su
ta te ten ter th the ti tion to tra tre un ung up ure us ver vi wh with wor
""".split()

_RUN = re.compile(r"[A-Za-z0-9+/_.~-]{%d,}={0,2}" % (SHORTEST - 2))
_DIGIT = re.compile(r"[0-9]")
_MIXED = re.compile(r".[A-Za-z0-9+/_.~-]*(?:[a-z][A-Z]|[A-Z]{2,}[a-z]|[A-Z][0-9])")
_NAMES = "(?:" + "|".join(sorted(CREDENTIAL_WORDS, key=len, reverse=True)) + ")"
_CREDENTIAL = re.compile(_NAMES, re.I)
# A value is looked for behind each sign, if a credential word stands before the sign.
_SIGN = re.compile(r"=>|:=|=+|:(?![:/=])")
_NAMED = re.compile(_NAMES + r"[\w.-]{0,24}\\*[\"'`\])]{0,2}\s{0,8}\Z", re.I)
_OPENING = re.compile(r"[ \t]{0,8}(?:(?:bearer|basic)[ \t]+)?(\\*[\"'`])?", re.I)
_VALUE_END = re.compile(r"\s|[;&,|](?=[\w.-]{1,40}[=:])|</|\Z")
_NAME_FIRST = re.compile(r"[\w.-]{0,24}" + _NAMES + r"[\w.-]{0,24}[=:]", re.I)
_ADDRESS = re.compile(r"(?<![^\s/])[^\s/@]++@[^\s/]*+")
_HOST = re.compile(r"@(?=[\w\[(])")
_PLACEHOLDER = re.compile(r"[$<{%\[(]|.*[)>}]\Z|.*(?:your|example|env\b|config|placeholder)|[*xX.]+\Z", re.I | re.S)
_PROSE = re.compile(r"\b(?:a|an|and|are|at|be|by|can|characters?|contains?|enter|for|has|is|must|no|not|of|or|please|the|this|to|with|you|your)\b", re.I)
_GOES_ON = re.compile(r"(?!s\b)[a-z]")
_IN_ADDRESS = re.compile(r"//[^\s/@]*:\Z")
_HARMLESS = re.compile(r"\b(?:" + "|".join(HARMLESS_WORDS) + r")\b", re.I)
_PIECES = re.compile("|".join(sorted(SYLLABLES, key=len, reverse=True)))
_HEX = re.compile(r"[0-9a-fA-F]+")
_PREFIX = re.compile(r"(?:AKIA|ASIA|AIza|eyJ|gh[pousr]_|glpat-|sk[-_]|pk_|xox[abpr]-|SG\.|ya29\.)")


def candidates(text: str) -> list[tuple[int, int]]:
    """The spans of both kinds in order; spans of different kinds may overlap."""
    return sorted({*_runs(text), *_values(text), *_address_values(text)})


def _runs(text: str) -> Iterator[tuple[int, int]]:
    for run in _RUN.finditer(text):
        start, end = run.span()
        while end > start and text[end - 1] == ".":  # the stop after a sentence
            end -= 1
        token = text[start:end]
        if len(token) >= SHORTEST and (_DIGIT.search(token) or _MIXED.match(token)):
            yield start, end


def _values(text: str) -> Iterator[tuple[int, int]]:
    """The values of credential words. What a value takes is not searched again."""
    done, line_end = 0, -1
    for sign in _SIGN.finditer(text):
        if sign.start() < done:
            continue
        lead = text[max(0, sign.start() - 64):sign.start()].lower()
        if not any(word in lead for word in CREDENTIAL_WORDS) or not _NAMED.search(lead):
            continue
        opening = _OPENING.match(text, sign.end())
        start, quote = opening.end(), opening.group(1)
        if line_end < start:
            line_end = text.find("\n", start) % (len(text) + 1)
        end = _closing(text, quote, start, line_end) if quote else -1
        if end < 0:
            end = _unquoted_end(text, start)
        if end - start >= SHORTEST_VALUE:
            done = end
            yield start, end


def _closing(text: str, quote: str, start: int, line_end: int) -> int:
    """Where the quoted value ends, or -1 if not in this line."""
    end = text.find(quote, start, line_end)
    while end > 0 and len(quote) == 1 and text[end - 1] == "\\":
        end = text.find(quote, end + 1, line_end)
    return end


def _unquoted_end(text: str, start: int) -> int:
    if _NAME_FIRST.match(text, start):
        return start
    end = _VALUE_END.search(text, start).start()
    closers = "" if any(c in text[start:end] for c in "([{") else ")]}"
    while end > start and text[end - 1] in "\"'`,;" + closers:
        end -= 1
    return end - (end > start and text[end - 1] == ".")


def _address_values(text: str) -> Iterator[tuple[int, int]]:
    """What stands between the first : and the last @ before a host, as in //user:value@host."""
    if "@" not in text:
        return
    for run in _ADDRESS.finditer(text):
        hosts = [at.start() for at in _HOST.finditer(text, run.start(), run.end())]
        start = text.find(":", run.start(), hosts[-1]) + 1 if hosts else 0
        if start and hosts[-1] - start >= SHORTEST_VALUE:
            yield start, hosts[-1]


def _classes(token: str) -> np.ndarray:
    codes = np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8)
    kinds = np.full(len(codes), 3)
    kinds[(codes >= 48) & (codes <= 57)] = 0
    kinds[(codes >= 65) & (codes <= 90)] = 1
    kinds[(codes >= 97) & (codes <= 122)] = 2
    return kinds


def features(before: str, token: str, after: str) -> list[float]:
    kinds, size = _classes(token), len(token)
    counts = np.unique(np.frombuffer(token.encode("ascii", "replace"), dtype=np.uint8), return_counts=True)[1] / size
    shares = [float((kinds == k).mean()) for k in range(4)]
    covered = sum(len(m.group(0)) for m in _PIECES.finditer(token.lower())) / size
    lead = before[-NEAR:]
    credential = [m.end() for m in _CREDENTIAL.finditer(lead)]
    return [
        float(np.log2(size)), *shares, float((kinds[1:] != kinds[:-1]).mean()), float(-(counts * np.log2(counts)).sum()),
        covered, float(_HEX.fullmatch(token) is not None), float(_PREFIX.match(token) is not None),
        float(token.count("/") / size), float(token.count(".")), float(token.startswith("/") or lead.endswith(("/", "@", "."))),
        float(len(lead) - credential[-1] if credential else NEAR + 1), float(bool(re.search(r"[=:]\s*[\"']?$", lead))),
        float(lead.endswith(("\"", "'")) and after.startswith(("\"", "'"))), float(_HARMLESS.search(lead) is not None),
        float(after.startswith("@")), float(_PLACEHOLDER.match(token) is not None), float(len(_PROSE.findall(token))),
        float(token.count(" ")), float(bool(credential and _GOES_ON.match(lead, credential[-1]))),
        float(_IN_ADDRESS.search(lead) is not None),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 for a leaf), threshold, left and right child, share of secrets."""
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for feature, threshold, left, right, share in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEEPEST + 1):
                inner = feature[node] >= 0
                if not inner.any():
                    break
                lower = rows[np.arange(len(rows)), np.maximum(feature[node], 0)] <= threshold[node]
                node = np.where(inner, np.where(lower, left[node], right[node]), node)
            total += share[node]
        return total / max(1, len(self.trees))


def train_forest(rows: np.ndarray, labels: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    grown = []
    for _ in range(trees):
        drawn = rng.integers(0, len(rows), len(rows)) if len(rows) else np.zeros(0, int)
        nodes: list[list] = []
        _grow(rows[drawn], labels[drawn].astype(float), 0, nodes, rng)
        grown.append(tuple(np.array([n[i] for n in nodes]) for i in range(5)))
    return Forest(grown)


def _grow(rows: np.ndarray, labels: np.ndarray, depth: int, nodes: list[list], rng) -> int:
    at = len(nodes)
    share = float(labels.mean()) if len(labels) else 0.5
    nodes.append([-1, 0.0, at, at, share])
    if depth >= DEEPEST or len(labels) < 4 or share in (0.0, 1.0):
        return at
    best = (share * (1 - share) * len(labels) - 1e-9, -1, 0.0)
    for f in rng.choice(rows.shape[1], max(1, int(np.sqrt(rows.shape[1])) + 1), replace=False):
        order = np.argsort(rows[:, f], kind="stable")
        values, seen = rows[order, f], np.cumsum(labels[order])
        cuts = np.flatnonzero(values[1:] > values[:-1]) + 1
        if not len(cuts):
            continue
        low, high = seen[cuts - 1], seen[-1] - seen[cuts - 1]
        impurity = low * (1 - low / cuts) + high * (1 - high / (len(labels) - cuts))
        k = int(impurity.argmin())
        if impurity[k] < best[0]:
            best = (float(impurity[k]), int(f), float((values[cuts[k] - 1] + values[cuts[k]]) / 2))
    if best[1] < 0:
        return at
    lower = rows[:, best[1]] <= best[2]
    nodes[at][:2] = [best[1], best[2]]
    nodes[at][2] = _grow(rows[lower], labels[lower], depth + 1, nodes, rng)
    nodes[at][3] = _grow(rows[~lower], labels[~lower], depth + 1, nodes, rng)
    return at


def example_findings(each: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """Labelled findings drawn from rules: kinds of secrets, and what is mistaken for them."""
    rng = random.Random(seed)
    of = lambda alphabet, *sizes: "".join(rng.choices(alphabet, k=rng.choice(sizes)))
    word = lambda: "".join(rng.choices(SYLLABLES, k=rng.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    hexes, alnum, base64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    secrets = [
        lambda: of(hexes, 32, 40, 64), lambda: of(hexes.upper(), 32, 40), lambda: of(alnum, 20, 24, 32, 40),
        lambda: of(base64, 32, 40, 64) + rng.choice(["", "=", "=="]), lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16),
        lambda: "ghp_" + of(alnum, 36), lambda: "sk-" + of(alnum, 32, 48), lambda: "eyJ" + of(alnum, 30) + "." + of(alnum, 40)]
    mistaken = [
        lambda: of(string.digits, 16, 17, 19), lambda: word() + word() + word() + of(string.digits, 1, 2, 3),
        lambda: "/".join(word() for _ in range(4)) + rng.choice(["", ".html", ".py"]), lambda: word().title() + word().title() + word().title() + word().title(),
        lambda: "_".join(word() for _ in range(4)) + rng.choice(["", "_1", "_v2"]), lambda: rng.choice("ax0_-=") * rng.choice([16, 24, 32]) + rng.choice(["", "1"]),
        lambda: ".".join([word(), word() + of(string.digits, 1, 2), "example", "com"]), lambda: "your_" + word() + "_key_here_1",
        lambda: "2024-01-" + of(string.digits, 2) + "T" + of(string.digits, 2) + "-" + of(string.digits, 4),
        lambda: (word() + word() + word() + word()).upper() + of(string.digits, 1)]
    leet = str.maketrans("aeios", "43105")
    long_enough = lambda value: value + of(string.digits, max(0, SHORTEST_VALUE - len(value)))
    passwords = [
        lambda: of(alnum + "!@#$%&*?-_+", 8, 10, 12, 16, 20), lambda: of(alnum, 6, 8, 10, 12), lambda: long_enough(natural() + of(string.digits, 1, 2, 3, 4)), lambda: plain()[:rng.choice([5, 6, 8, 10])] + of(string.digits, 1, 1, 2, 3, 4),
        lambda: long_enough((natural() + natural()).title().translate(leet)) + rng.choice(["", "", "!", "x", "#1"]),
        lambda: long_enough(natural().title() + rng.choice("!@#$%&*") + of(string.digits, 2, 3, 4)) + rng.choice(["", "!"])]
    phrase = lambda mark: mark.join(natural() for _ in range(rng.choice([3, 4, 4, 5, 6])))
    spelled = lambda: "".join(rng.choices("bcdfghklmnprstwy", k=1)[0] + rng.choice("aeiouaeo") + rng.choice(["", "", *"lnrstck"])
                              for _ in range(rng.randint(2, 4)))[:rng.choice([4, 5, 6, 7, 9])]
    natural = lambda: rng.choice([word, spelled, spelled])()
    plain = lambda: (natural() + rng.choice(["", "", word()]))[:14].ljust(SHORTEST_VALUE, "e")
    placeholders = [
        lambda: f"<{plain()}>", lambda: "${%s}" % plain().upper(), lambda: "$" + plain().upper(), lambda: "{{ %s }}" % plain(), lambda: f"%({plain()})s",
        lambda: rng.choice("*xX.") * rng.choice([6, 8, 10, 16]), lambda: f"your_{word()}_here", lambda: f"YOUR_{word().upper()}_KEY", lambda: f"your-{word()}",
        lambda: f"os.environ[\"{plain().upper()}\"]", lambda: f"process.env.{plain().upper()}", lambda: f"{plain()}.{plain()}()", lambda: f"{plain()}({word()})",
        lambda: f"config.{plain()}", lambda: f"self.{plain()}", lambda: f"{plain()}_{word()}", lambda: f"{word()}.{plain()}@example.com",
        lambda: f"https://{plain()}.com/{word()}", lambda: f"/{word()}/{plain()}/{word()}"]
    notices = [
        lambda: f"Please enter your {plain()}", lambda: f"Enter the {plain()} {plain()}", lambda: f"must not be {plain()}", lambda: f"must contain {plain()} characters", lambda: f"{plain()} is not {plain()}",
        lambda: f"The {plain()} has {plain()}", lambda: f"{plain().title()} {plain()} for {plain()}"]
    found = []
    for _ in range(each):
        name, mark = rng.choice(CREDENTIAL_WORDS), rng.choice([" = \"", "=", ": ", "='", "=\"", " "])
        close = {"\"": "\"", "'": "'"}.get(mark[-1], "")
        found.append((f"{words(3)} {rng.choice([name, name.upper(), name.title()])}{mark}", rng.choice(secrets)(), f"{close} {words(2)}", 1))
        unnamed = rng.choice(secrets[4:])()
        found.append((f"{words(4)} ", unnamed, f" {words(2)}", 1))
        found.append((f"{words(4)} ", rng.choice(mistaken)(), f" {words(2)}", 0))
        found.append((f"{words(2)} {rng.choice(HARMLESS_WORDS)}{rng.choice([' ', ': ', '='])}",
                      rng.choice([*mistaken, secrets[0]])(), f" {words(2)}", 0))
        # Behind a sign, words in one run may be a pass phrase, so they are not mistaken for one there.
        alike = mistaken if mark == " " else [mistaken[i] for i in (0, 2, 4, 5, 6, 7, 8)]
        found.append((f"{words(2)} {name}{mark}", rng.choice(alike)(), f"{close} {words(1)}", int(rng.random() < 0.1)))
        # Named values, and what stands before @: the secrets and their look-alikes.
        sign = rng.choice([" = ", "=", ": ", ":", "\": ", " = ", "="])
        quote = rng.choice(["\"", "'", "", ""])
        lead = f"{words(2)} {rng.choice(['', '', 'db_', 'my'])}{rng.choice([name, name.upper(), name.title()])}{sign}{quote}"
        found.append((lead, rng.choice(passwords)(), f"{quote} {words(2)}", 1))
        found.append((lead, phrase(rng.choice(["", "", "-", *([" "] if quote else [])])), f"{quote} {words(2)}", 1))
        found.append((lead, rng.choice([plain, lambda: plain().title(), lambda: plain().upper()])(), f"{quote} {words(2)}", 0))
        found.append((lead, rng.choice([*placeholders, *(notices if quote else [])])(), f"{quote} {words(2)}", 0))
        found.append((f"{words(2)} {rng.choice(['secretary', 'author', 'tokenizer', 'authority', 'tokenization'])}{sign}{quote}",
                      rng.choice([plain, lambda: plain().title(), lambda: plain() + of(string.digits, 1), lambda: f"{plain()}-{plain()}"])(), f"{quote} {words(2)}", 0))
        host = f"@{word()}.{rng.choice(['com', 'org', 'example.net', 'local:5432/' + word()])} {words(1)}"
        found.append((f"{words(2)} {rng.choice(['postgres', 'https', 'ftp', 'amqp', 'mysql', 'redis', 'http'])}://{rng.choice([word(), ''])}:",
                      rng.choice([*passwords, lambda: phrase("")])(), host, 1))
        found.append((f"{words(2)} {rng.choice(['root', 'admin', word()])}:", rng.choice(passwords)(), host, 1))
        found.append((f"{words(2)} {rng.choice(['mailto', 'email', 'from', 'to', 'contact', 'by', 'cc'])}:",
                      rng.choice([plain, lambda: f"{word()}.{plain()}", lambda: f"{plain()}_{word()}", lambda: f"{plain()}" + of(string.digits, 1, 2)])(), host, 0))
        found.append((f"{words(2)} {word()}:", rng.choice([plain, lambda: f"v{of(string.digits, 1)}.{of(string.digits, 1)}.{of(string.digits, 1, 2)}"])(),
                      f"@sha256:{of(hexes, 64)}", 0))
    return found


def train(findings: list[tuple[str, str, str, int]]) -> Forest:
    rows = np.array([features(before, token, after) for before, token, after, _ in findings]).reshape(len(findings), N_FEATURES)
    return train_forest(rows, np.array([label for *_, label in findings]))


@lru_cache(maxsize=1)
def trained() -> Forest:
    """The forest of the example findings."""
    return train(example_findings())


def _findings(texts: list[str | None], forest: Forest) -> Iterator[list[tuple[int, int, float]]]:
    for text in texts:
        spans = list(candidates(text)) if text else []
        if not spans:
            yield []
            continue
        rows = np.array([features(text[max(0, s - NEAR):s], text[s:e], text[e:e + NEAR]) for s, e in spans])
        yield [(s, e, float(p)) for (s, e), p in zip(spans, forest.score(rows))]


def _secrets(found: list[tuple[int, int, float]], secret_from: float) -> list[tuple[int, int, float]]:
    """The findings from this score on; those that overlap are one."""
    sure = []
    for start, end, score in found:
        if score < secret_from:
            continue
        if sure and start < sure[-1][1]:
            sure[-1] = (sure[-1][0], max(end, sure[-1][1]), max(score, sure[-1][2]))
        else:
            sure.append((start, end, score))
    return sure


def scan(df: DataFrame, key: str, text: str, forest: Forest, secret_from: float = SECRET_FROM) -> DataFrame:
    """key, ``n_candidates``, ``n_secrets``, ``starts`` and ``ends`` of the secrets (in characters) and
    their ``scores``, a row per row."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_findings((t.as_py() for t in batch.column(text)), shared.value))
            sure = [_secrets(one, secret_from) for one in found]
            ints, doubles = pa.list_(pa.int32()), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array([len(x) for x in found], pa.int64()), pa.array([len(x) for x in sure], pa.int64()),
                 pa.array([[f[0] for f in x] for x in sure], ints), pa.array([[f[1] for f in x] for x in sure], ints),
                 pa.array([[f[2] for f in x] for x in sure], doubles)],
                names=[key, "n_candidates", "n_secrets", "starts", "ends", "scores"])

    numbers = T.ArrayType(T.IntegerType())
    return df.select(key, text).mapInArrow(find, T.StructType([
        df.schema[key], T.StructField("n_candidates", T.LongType()), T.StructField("n_secrets", T.LongType()),
        T.StructField("starts", numbers), T.StructField("ends", numbers), T.StructField("scores", T.ArrayType(T.DoubleType()))]))


def mask(df: DataFrame, text: str, forest: Forest, secret_from: float = SECRET_FROM, by: str = MASK) -> DataFrame:
    """``df`` with every secret of ``text`` replaced."""
    shared = df.sparkSession.sparkContext.broadcast(forest)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cleaned = batch.schema.get_field_index(text), []
            values = batch.column(at).to_pylist()
            for value, found in zip(values, _findings(values, shared.value)):
                for start, end, _ in reversed(_secrets(found, secret_from)):
                    value = value[:start] + by + value[end:]
                cleaned.append(value)
            columns = list(batch.columns)
            columns[at] = pa.array(cleaned, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(replace, df.schema)
