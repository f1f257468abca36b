"""Secret scan: patterns propose strings, a random forest removes the false positives.

Proposals are long strings with digits or mixed case, and values assigned to words such as password. A random forest, trained here in numpy
from labelled findings, judges each by its length, its transitions between kinds of characters, its entropy, how much of it words of a
dictionary cover, what the path of its document says, and the words beside it. The labelled findings are written by rule, with a fixed seed:
keys and tokens of usual formats in usual places, against hashes, ids, placeholders, words and numbers in theirs (``labelled``). Runs without
a digit have a forest of their own: keys of letters alone, against capitalised words and names of several words (``lettered``).

Documents are scanned where they are; no shuffle. The forest, some hundred kB, goes to the workers in the function's closure. A document's cost
is its own length.

Defined results: a null text is empty and has no findings; a null path (``source``) says nothing; repeated rows are scanned alike; extra columns
are ignored by ``findings`` and kept by ``redacted``, which replaces each secret by MASK; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .workers import trimmed

TREES, DEPTH, LEAST_LEAF, CUTS, SEED = 25, 7, 4, 16, 5
EXAMPLES = 2500
SECRET_FROM = 0.5
MASK = "[SECRET]"
BESIDE = 40
#: Texts that are Python strings at once.
SLICE = 128
#: A run of key characters that starts where one may start. What makes it a proposal is tested on the run.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-][A-Za-z0-9+/_=.-]{15,}")
#: Each name that ASSIGNED takes holds one of these once its case is folded (its long s and Kelvin sign too, which (?i) takes for s and k).
NAMES = ("passw", "pwd", "secret", "token", "key", "auth")
ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,200})")
#: What is left of a value that ASSIGNED takes the first part of.
REST = re.compile(r"[^\s\"']*")
DICTIONARY = frozenset(
    "about access account admin after alpha answer apple auth base before beta block blue board book build call center change check city class client cloud code commit "
    "common config connect content control count create cross data date default delete demo device document domain door down dummy east edit error event example "
    "fake field file first floor form foo bar baz frame free from front game gate general global green group hash head hello help here home host house http image index "
    "info input internal item join json key label lane large last level light line link list local lock login long lorem ipsum main manager market master message meta "
    "model module month name network new next node none north note null number object office open order other output page part pass password path person phone place "
    "placeholder plan point post power press price print private process product profile project public query read record red release remote report request reset "
    "response river road role root sample save scan school search second secret section server service session set shop show side site size small social some sort source "
    "south space start state static status store stream street string style system table target task team temp template test text that the this time title todo token top "
    "total town track type under unit update upload user value version video view water web week welcome west when white width window with word work world write www year your zone".split()
)
LONGEST = max(map(len, DICTIONARY))
CALLED = re.compile(r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|auth)")
HARMLESS = re.compile(r"(?i)(?:sha-?\d*|md5|checksum|hash|commit|revision|digest|etag|uuid|guid|example|dummy|sample|placeholder|integrity|id)\W{0,4}$")
PREFIX = re.compile(r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abp]-|AIza|eyJ|npm_|pypi-|SG\.)")
TEST_PATH = re.compile(r"(?i)(?:test|spec|example|sample|fixture|mock|doc)")
UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
HEX = re.compile(r"^[0-9a-fA-F]+$")


def coverage(s: str) -> float:
    """The share of characters that dictionary words cover, longest first from the left."""
    low, at, covered = s.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(LONGEST, len(low) - at), 2, -1) if low[at : at + n] in DICTIONARY), 0)
        covered += n
        at += n or 1
    return covered / max(1, len(low))


def features(s: str, before: str, after: str, path: str | None) -> list[float]:
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in s]
    n = len(s)
    count, chars = Counter(kinds), Counter(s)
    entropy = -sum(v / n * math.log2(v / n) for v in chars.values())
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    return [
        math.log2(n), turns, entropy, count["d"] / n, count["u"] / n, count["l"] / n, count["o"] / n, coverage(s), float(bool(HEX.match(s))), float(bool(UUID.match(s))),
        float(bool(PREFIX.match(s))), float(bool(CALLED.search(before))), float(bool(HARMLESS.search(before))), float(bool(re.search(r"[=:]\s{0,3}[\"']?$", before))),
        float(after[:1] in "\"'" and after != ""), float(bool(TEST_PATH.search(path or ""))), max(chars.values()) / n, len(chars) / n,
    ]


def assigned(text: str) -> list[tuple[int, int]]:
    """Spans of assigned values, by start; of a value of over 200 characters its first part, and each later part that is assigned within it."""
    low = text.casefold()
    return [m.span(1) for m in ASSIGNED.finditer(text)] if any(n in low for n in NAMES) else []


def wholes(text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of assigned values that go on after their part, the spans to their ends."""
    out = []
    for a, b in parts:
        if (not out or a >= out[-1][1]) and (end := REST.match(text, b).end()) > b:
            out.append((a, end))
    return out


def proposals(text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, by start, not overlapping: assigned values win over runs, and take in all of a run that they end in."""
    out, taken, at = [], list(parts), 0
    for m in RUN.finditer(text):
        s = m[0].rstrip(".=-")
        end = m.start() + len(s)
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            while at + 1 < len(taken) and taken[at + 1][0] < m.end():
                at += 1
            a, b = taken[at]
            taken[at] = (a, max(b, m.end()))
        elif len(s) >= 16 and (any(c.isdigit() for c in s) or any(c.isupper() for c in s) and any(c.islower() for c in s)):
            out.append((m.start(), end))
    return sorted(out + taken)


@dataclass
class Forest:
    """Each tree: node -> (feature, cut, left, right, share of secrets); feature -1 is a leaf. letters judges runs without a digit, if it is there."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    letters: Forest | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                f = feature[at]
                down = f >= 0
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(down, np.where(goes, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> Forest:
    """Bootstrapped trees; at each node the best Gini cut among the square root of the features, at quantiles."""
    rnd = np.random.default_rng(seed)
    tries = max(1, round(math.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int, nodes: list = nodes) -> int:
            k = len(nodes)
            nodes.append([-1, 0.0, k, k, float(y[rows].mean())])
            if depth == DEPTH or len(rows) < 2 * LEAST_LEAF or y[rows].min() == y[rows].max():
                return k
            best = (2.0, -1, 0.0)
            for f in rnd.choice(x.shape[1], tries, replace=False):
                v = x[rows, f]
                for c in np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS))):
                    low = v <= c
                    a = int(low.sum())
                    if LEAST_LEAF <= a <= len(rows) - LEAST_LEAF:
                        p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                        gini = (a * p * (1 - p) + (len(rows) - a) * q * (1 - q)) / len(rows)
                        if gini < best[0]:
                            best = (gini, int(f), float(c))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[k][:2] = best[1:]
                nodes[k][2] = split(rows[low], depth + 1)
                nodes[k][3] = split(rows[~low], depth + 1)
            return k

        split(rnd.integers(0, len(x), len(x)), 0)
        cols = list(zip(*nodes, strict=True))
        out.append((np.array(cols[0], int), np.array(cols[1]), np.array(cols[2], int), np.array(cols[3], int), np.array(cols[4])))
    return Forest(out)


def labelled(n: int = EXAMPLES, seed: int = SEED) -> tuple[list[tuple[str, str, str, str]], list[int]]:
    """n findings (hit, before, after, path), about half of them secrets."""
    rnd = np.random.default_rng(seed)
    words = sorted(DICTIONARY)
    pick = lambda xs: xs[int(rnd.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    hexa, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    noise = lambda: " ".join(chars("abcdefghijklmnoprstu", int(rnd.integers(2, 9))) for _ in range(4))
    name = lambda: pick(["token", "TOKEN", "secret", "password", "api_key", "apiKey", "ACCESS_KEY", "auth_token", "client_secret", "passwd"])
    paths = ["src0", "src7", "app/settings.py", "config/prod.yaml", "deploy/main.tf", None]
    tests = ["tests/test_login.py", "docs/example.md", "spec/fixtures/a.json"]
    rows, marks = [], []
    for _ in range(n):
        if rnd.random() < 0.5:
            hit = pick([lambda: chars(hexa, pick([32, 40, 64])), lambda: "AKIA" + chars(upper, 16), lambda: "ghp_" + chars(mixed, 36), lambda: "sk_live_" + chars(mixed, 24), lambda: chars(mixed + "+/", pick([40, 44, 64])),
                        lambda: "xoxb-" + chars("0123456789", 12) + "-" + chars(mixed, 24), lambda: "eyJ" + chars(mixed, 30) + "." + chars(mixed, 60), lambda: chars(mixed + "!#%&*", int(rnd.integers(9, 20)))])()
            quote = pick(['"', "'", ""])
            own = bool(PREFIX.match(hit)) and rnd.random() < 0.4
            before = noise() + " " if own else f"{noise()} {name()}{pick([' = ', '=', ': '])}{quote}"
            rows.append((hit, before[-BESIDE:], "" if own else quote + " ", pick(paths + tests[:1])))
            marks.append(1)
        else:
            kind = int(rnd.integers(7))
            hit, before, quote = "", noise() + " ", ""
            if kind == 0:
                hit, before = chars(hexa, pick([32, 40, 64])), f"{noise()} {pick(['sha256:', 'commit ', 'md5 = ', 'checksum: ', 'revision ', 'etag: ', 'hash=', 'digest '])}"
            elif kind == 1:
                hit, before = "-".join(chars(hexa, k) for k in (8, 4, 4, 4, 12)), f"{noise()} {pick(['id: ', 'uuid=', 'guid ', ''])}"
            elif kind == 2:
                hit, quote = pick(["your", "my", "example", "test", "dummy", "sample"]) + pick("-_") + pick(["token", "secret", "password", "key"]) + pick(["", "_here", "-1234", "_value"]), pick(['"', ""])
                before = f"{noise()} {name()} = {quote}"
            elif kind == 3:
                hit = pick("-_/").join(pick(words) for _ in range(int(rnd.integers(3, 7)))) + pick(["", str(int(rnd.integers(1000)))])
                before = f"{noise()} {pick(['path: ', 'see ', 'name = ', 'url='])}"
            elif kind == 4:
                hit, before = chars("0123456789", int(rnd.integers(8, 20))), f"{noise()} {pick(['order ', 'count = ', 'phone ', 'token = '])}"
            elif kind == 5:
                hit, quote = pick([lambda: pick("x*0") * int(rnd.integers(8, 32)), lambda: "<" + pick(words) + ">", lambda: "${" + pick(words).upper() + "}", lambda: f"get_{pick(words)}({pick(words)})"])(), pick(['"', ""])
                before = f"{noise()} {name()}={quote}"
            else:
                hit = chars("abcdefghijklmnoprstu", int(rnd.integers(9, 26))) + pick(["", "9", "2024"])
                before = f"{noise()} {pick(['', 'word ', 'auth: '])}"
            rows.append((hit, before[-BESIDE:], quote + " ", pick(paths + tests)))
            marks.append(0)
    return rows, marks


def lettered(n: int, seed: int = SEED) -> tuple[list[tuple[str, str, str, str]], list[int]]:
    """n findings of mixed case without a digit, about half of them keys, against capitalised words and names of several words."""
    rnd = np.random.default_rng([seed, 1])
    words = sorted(DICTIONARY)
    pick = lambda xs: xs[int(rnd.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(pick(alphabet) for _ in range(k))
    low = "abcdefghijklmnopqrstuvwxyz"
    made = lambda: "".join(pick("bcdfghklmnprstvw") + pick("aeiou") + pick(["", "", "n", "r", "s", "t", "l"]) for _ in range(int(rnd.integers(1, 5))))
    word = lambda: pick([pick(words), made()])
    rows, marks = [], []
    for _ in range(n):
        before, quote = f"{made()} {made()} ", ""
        key = rnd.random() < 0.5
        if key:
            hit = chars(low + low.upper(), pick([16, 20, 24, 32, 40, 64]))
            if rnd.random() < 0.5:
                quote = pick(['"', "'", ""])
                before += f"{pick(['token', 'secret', 'password', 'api_key', 'auth_token'])}{pick([' = ', '=', ': '])}{quote}"
        else:
            sep, hit, least = pick(["", "", "", "_", "-", ".", "/"]), "", int(rnd.integers(16, 40))
            if rnd.random() < 0.4:
                while len(hit) < 16:
                    hit += made()
                hit = hit.capitalize()
            else:
                first = pick([str.lower, str.capitalize])
                while len(hit) < least:
                    hit += (sep + word().capitalize()) if hit else first(word())
            before += pick(["", "", "see ", "name = ", "class ", "(", "import "])
        rows.append((hit, before[-BESIDE:], quote + " ", pick(["src0", "src7", "app/settings.py", None])))
        marks.append(int(key))
    return rows, marks


def trained(n: int = EXAMPLES) -> Forest:
    grown = lambda rows, marks: grow(np.array([features(*r) for r in rows]), np.array(marks))
    forest = grown(*labelled(n))
    forest.letters = grown(*lettered(n))
    return forest


def judged(forest: Forest, text: str, path: str | None, spans: list[tuple[int, int]], parts: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    if not spans:
        return []
    x = np.array([features(text[a:b], text[max(0, a - BESIDE) : a], text[b : b + BESIDE], path) for a, b in spans])
    scores, starts = forest.predict(x), {a for a, _ in parts}
    if forest.letters:
        runs = np.array([a not in starts and not any(c.isdigit() for c in text[a:b]) for a, b in spans])
        if runs.any():
            scores[runs] = forest.letters.predict(x[runs])
    return [(a, b, float(s)) for (a, b), s in zip(spans, scores, strict=True)]


def scan(forest: Forest, text: str | None, path: str | None) -> list[tuple[int, int, float]]:
    """(start, end, score) of each proposal in a whole text. A long assigned value is one if it is a secret as a whole, else its parts are."""
    if not text:
        return []
    parts = assigned(text)
    long = [r for r in judged(forest, text, path, wholes(text, parts), parts) if r[2] >= SECRET_FROM]
    spans = proposals(text, parts)
    if long:
        spans = [(a, b) for a, b in spans if not any(c < b and a < d for c, d, _ in long)]
    return sorted(long + judged(forest, text, path, spans, parts))


def redact(forest: Forest, text: str | None, path: str | None) -> str | None:
    out, at = [], 0
    for a, b, score in scan(forest, text, path):
        if score >= SECRET_FROM:
            out += [text[at:a], MASK]
            at = b
    return "".join([*out, text[at:]]) if out else text


SCHEMA = "doc_id long, start long, end long, score double, secret boolean"


def findings(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs (doc_id, text, source) -> one row for each proposal: its span in code points, its score, and whether it is a secret."""
    forest = forest or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b, s, s >= SECRET_FROM) for i, t, p in zip(*batch.columns, strict=True) for a, b, s in scan(forest, t.as_py(), p.as_py())]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            ids = pa.array([x.as_py() for x in cols[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.bool_())], ["doc_id", "start", "end", "score", "secret"])

    return docs.select(F.col("doc_id").cast("long"), "text", "source").mapInArrow(trimmed(run), SCHEMA)


def redacted(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs with each secret in text replaced by MASK, and n_chars, where there is one, counted anew in rows that changed."""
    forest = forest or trained()
    names = docs.columns
    text, path = names.index("text"), names.index("source") if "source" in names else None
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            cols = list(batch.columns)
            old = [t.as_py() for t in cols[text]]
            paths = [None] * len(old) if path is None else cols[path].to_pylist()
            new = [redact(forest, t, p) for t, p in zip(old, paths, strict=True)]
            cols[text] = pa.array(new, cols[text].type)
            if size is not None:
                counts = cols[size].to_pylist()
                cols[size] = pa.array([n if a is b or a == b else len(b) for a, b, n in zip(old, new, counts, strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents")).filter("secret").drop("secret")
