"""Secret scans: patterns find candidates in whole texts, a random forest removes false findings.

A candidate is the value of an assignment to a telling name (password, token, key ...), the password of a login in a url, a long run of characters that keys
are written in, or a private key from its opening line to its END line (without one, to the end of its base64 lines). The forest's inputs are the candidate's length and mix of characters, its
character transitions (how likely they are in dictionary words, and how often letters and digits alternate), how much of it
dictionary words cover, words of the document's path, and the neighbouring words. It is trained from labelled findings: a table
of (candidate, before, after, path, label), of which a bounded sample is used, or generated ones where no table is at hand.

The dictionary holds the letter pieces of a public vocabulary. Scanning is a map over the texts, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of context before and after a candidate that its neighbouring words are taken from.
CONTEXT = 60
#: Labelled findings that a forest is fitted on, at most; generated findings if there are none.
TRAINING_ROWS, GENERATED = 20_000, 3_000
TREES, TREE_DEPTH, LEAST_LEAF = 30, 9, 4
FINDING = T.StructType([T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("kind", T.StringType()), ("score", T.DoubleType()), ("secret", T.BooleanType()))])

_ASSIGNED = re.compile(r"""(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth)[\w-]{0,20}["']?[ \t]*(?:=>|:=|=|:)[ \t]*["']?([^\s"'<>,;]{6,})""")
_LOGIN = re.compile(r"""(?i)\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@"'<>]{0,100}:([^\s/@"'<>]{3,200})@""")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_BLOCK = re.compile(r"-----(BEGIN|END) [A-Z ]{0,30}PRIVATE KEY-----")
# after an opening line without an END line: header lines, if base64 lines follow, then these and a last, shorter one
_GAP = r"""(?:\s|\\[rn]|["'>#*,;])+"""
_BODY = re.compile(rf"""(?:(?:{_GAP}[A-Za-z][A-Za-z-]{{1,30}}: [^\n\\]{{0,200}}){{0,9}}(?:{_GAP}[A-Za-z0-9+/]{{32,}}={{0,2}})+(?:{_GAP}[A-Za-z0-9+/]{{1,80}}={{0,2}}(?=[ \t"'\\,;]*(?:[\r\n\\]|$)))?)?""")
_WORD = re.compile(r"[a-z]+")

# How issuers' keys begin.
_ISSUED = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|AKIA|ASIA|xox[abprs]-|AIza|ya29\.|npm_|SG\.|eyJ)")
# Words that speak for and against a secret, by where they stand.
_FOR = frozenset("token secret password passwd pwd key apikey api auth bearer credential credentials private access authorization login".split())
_AGAINST = frozenset("commit sha hash checksum digest md5 uuid guid revision etag fingerprint integrity build version image id file example sample placeholder dummy fake changeme your test mock xxx".split())
_PATHS = frozenset("test tests example examples sample samples doc docs fixture fixtures mock mocks demo lock vendor".split())


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all candidates of a text, in order; a place that several patterns find is reported once."""
    found: dict[tuple[int, int], str] = {}
    lines = list(_BLOCK.finditer(text))
    for m, following in zip(lines, [*lines[1:], None], strict=False):
        if m.group(1) == "BEGIN":
            ended = following is not None and following.group(1) == "END"
            found[m.start(), following.end() if ended else _BODY.match(text, m.end()).end()] = "key block"
    blocks = sorted(found)
    for m, kind in ((m, kind) for pattern, kind in ((_LOGIN, "login"), (_ASSIGNED, "assigned")) for m in pattern.finditer(text)):
        a, b = m.span(1)
        k = bisect_left(blocks, (a + 1,))
        if k and blocks[k - 1][1] > a:
            continue  # inside a block
        if k < len(blocks) and blocks[k][0] < b:
            b = blocks[k][0]
            if b < a + 6:
                continue
        while kind == "assigned" and b > a + 6 and text[b - 1] in ".)]}":
            b -= 1
        found.setdefault((a, b), kind)
    inside = _apart(found)
    found = {(a, b): found[a, b] for a, b in inside}
    k = 0
    for m in _RUN.finditer(text):
        a, b = m.span()
        while k < len(inside) and inside[k][1] <= a:
            k += 1
        value = m.group()
        if (k == len(inside) or inside[k][0] >= b) and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            found.setdefault((a, b), "run")
    return sorted((a, b, kind) for (a, b), kind in found.items())


def _apart(found: dict[tuple[int, int], str]) -> list[tuple[int, int]]:
    """Places in order, without those that begin inside an earlier one: of a url assigned to a name, say, the name's value stays."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


class Lexicon:
    """Dictionary words and the character transitions in them."""

    def __init__(self, words: Sequence[str]):
        self.words = frozenset(w for w in words if len(w) >= 4 and w.isascii() and w.isalpha())
        self.longest = max((len(w) for w in self.words), default=0)
        counts = np.full((27, 27), 0.5)
        for w in sorted(self.words):
            codes = [26, *(ord(c) - 97 for c in w), 26]
            for a, b in zip(codes[:-1], codes[1:], strict=True):
                counts[a, b] += 1
        self.log_chance = np.log(counts / counts.sum(axis=1, keepdims=True))

    @staticmethod
    def from_pieces(file: str) -> Lexicon:
        """The lower-cased word-initial pieces of a sentencepiece vocabulary."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        pieces = (model.id_to_piece(i) for i in range(model.vocab_size()))
        return Lexicon(sorted({p[1:].lower() for p in pieces if p.startswith("▁")}))

    def covered(self, value: str) -> float:
        """Share of the characters that dictionary words cover, longest first from the left."""
        low, at, n = value.lower(), 0, 0
        while at < len(low):
            size = next((k for k in range(min(self.longest, len(low) - at), 3, -1) if low[at : at + k] in self.words), 0)
            n += size
            at += size or 1
        return n / max(1, len(low))

    def transitions(self, value: str) -> float:
        """Mean log chance of the letter transitions; other characters count as word borders."""
        codes = np.frombuffer(value.lower().encode("ascii", "replace"), np.uint8).astype(np.int64) - 97
        codes[(codes < 0) | (codes > 25)] = 26
        return float(self.log_chance[codes[:-1], codes[1:]].mean()) if len(codes) > 1 else 0.0


FEATURES = ["length", "digits", "upper", "lower", "signs", "distinct", "entropy", "alternation", "transitions", "coverage", "hex", "assigned", "block", "word_for", "word_against", "near_for", "near_against", "value_against", "path_against", "quoted", "issued", "login"]


def features(value: str, before: str, after: str, path: str, kind: str, lexicon: Lexicon) -> list[float]:
    """The forest's inputs, in the order of FEATURES."""
    n = max(1, len(value))
    counts = np.unique(np.frombuffer(value.encode("utf-32-le"), np.uint32), return_counts=True)[1] / n if value else np.ones(1)
    classes = ["d" if c.isdigit() else "a" if c.isalpha() else "s" for c in value]
    words_before, words_after = _WORD.findall(before.lower()), _WORD.findall(after.lower())
    last = words_before[-2:]
    near = words_before[:-2] + words_after
    in_value = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
    return [
        float(len(value)),
        classes.count("d") / n,
        sum(c.isupper() for c in value) / n,
        sum(c.islower() for c in value) / n,
        classes.count("s") / n,
        len(counts) / n,
        float(-(counts * np.log2(counts)).sum()),
        sum(a != b for a, b in zip(classes[:-1], classes[1:], strict=True)) / n,
        lexicon.transitions(value),
        lexicon.covered(value),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(kind == "assigned"),
        float(kind == "key block"),
        float(sum(w in _FOR for w in last)),
        float(sum(w in _AGAINST for w in last)),
        float(sum(w in _FOR for w in near)),
        float(sum(w in _AGAINST for w in near)),
        float(len(in_value & _AGAINST)),
        float(len(set(_WORD.findall(path.lower())) & _PATHS)),
        float(before[-1:] in ("'", '"')),
        float(_ISSUED.match(value) is not None),
        float(kind == "login"),
    ]


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at leaves), threshold, left and right child, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(feature[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])
            total += share[at]
        return total / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, share = [], [], [], [], []

    def grow(rows: np.ndarray, depth: int) -> int:
        node = len(feature)
        mean = float(y[rows].mean())
        for part, value in zip((feature, threshold, left, right, share), (-1, 0.0, -1, -1, mean), strict=True):
            part.append(value)
        if depth == 0 or len(rows) < 2 * LEAST_LEAF or mean in (0.0, 1.0):
            return node
        best = (1e-9, 0, 0.0)
        for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, ones = x[rows, f][order], np.cumsum(y[rows][order])
            k = np.arange(1, len(rows))
            a, b = ones[:-1] / k, (ones[-1] - ones[:-1]) / (len(rows) - k)
            gain = mean * (1 - mean) * len(rows) - (k * a * (1 - a) + (len(rows) - k) * b * (1 - b))
            gain[(v[1:] == v[:-1]) | (k < LEAST_LEAF) | (len(rows) - k < LEAST_LEAF)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(f), float((v[i] + v[i + 1]) / 2))
        if best[0] <= 1e-9:
            return node
        _, f, cut = best
        side = x[rows, f] <= cut
        feature[node], threshold[node] = f, cut
        left[node] = grow(rows[side], depth - 1)
        right[node] = grow(rows[~side], depth - 1)
        return node

    rows = rng.integers(0, len(x), len(x))
    grow(rows, TREE_DEPTH)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Forest:
    """Bootstrapped trees that look at a random few inputs per node. Deterministic."""
    rng = np.random.default_rng(seed)
    return Forest([_tree(x, y.astype(float), rng) for _ in range(TREES)])


@dataclass
class Scanner:
    lexicon: Lexicon
    forest: Forest


def _key_block(rng: np.random.Generator, draw: Callable[[str, int], str], letters: str) -> str:
    """A generated private key: whole, without its END line, or its opening line alone."""
    name = ("RSA ", "EC ", "OPENSSH ", "")[rng.integers(4)]
    lines = [draw(letters, 64) for _ in range(int(rng.integers(1, 26)))] + [draw(letters, int(rng.integers(4, 60))) + "="]
    part = rng.random()
    body = "" if part < 0.1 else "\n" + "\n".join(lines)
    return f"-----BEGIN {name}PRIVATE KEY-----{body}" + (f"\n-----END {name}PRIVATE KEY-----" if part >= 0.3 else "")


def labelled_findings(n: int = GENERATED, seed: int = 11) -> list[tuple[str, str, str, str, str, int]]:
    """Generated findings (candidate, before, after, path, kind, label): keys of several alphabets and passwords in assignments
    against digests, ids, paths, placeholders and long identifiers."""
    rng = np.random.default_rng(seed)
    hexa, base62 = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    draw = lambda letters, size: "".join(rng.choice(list(letters), size))
    one = lambda *options: options[rng.integers(len(options))]
    prose = lambda k: " ".join(draw("aeiounrstlmd", int(rng.integers(2, 9))) for _ in range(k))
    out = []
    for _ in range(n):
        quote, sign = one('"', "'", ""), one(" = ", "=", ": ", ":")
        path = one("src/app.py", "config/prod.env", "src3", "web", "crawl/part-7", "deploy.yaml", "settings")
        word = lambda: draw("aeiou", 1) + draw("bcdfglmnprst", 2) + draw("aeiou", 1) + draw("mnrst", 1)
        if rng.random() < 0.5:
            kind, label = "assigned", 1
            name = one("token", "secret", "api_key", "password", "ACCESS_KEY", "client_secret", "auth_token", "apikey")
            value = [
                lambda: draw(hexa, one(32, 40, 64)),
                lambda: draw(base62, int(rng.integers(16, 48))),
                lambda: draw(base62 + "+/", one(40, 64, 88)) + one("", "=", "=="),
                lambda: one("ghp_", "gho_", "glpat-", "sk-", "sk_live_", "AKIA", "xoxb-", "AIza", "npm_") + draw(base62, int(rng.integers(16, 40))),
                lambda: draw(base62 + "!$%&#@", int(rng.integers(8, 16))),
                lambda: one(str.title, str)(word() + one("", word())) + draw("0123456789", int(rng.integers(2, 5))) + one("", "!", "#", "$", "?"),
                lambda: "eyJ" + draw(base62, 20) + ".eyJ" + draw(base62, 40) + "." + draw(base62 + "-_", 43),
            ][rng.integers(7)]()
            before = f"{prose(3)} {name}{sign}{quote}"
            if rng.random() < 0.1:
                kind, value, before = "key block", _key_block(rng, draw, base62 + "+/"), prose(3) + "\n"
            elif rng.random() < 0.08:
                kind, before, quote = "login", f"{prose(2)} {word()}://{word()}:", "@" + word()
            elif len(value) >= 20 and (_ISSUED.match(value) or rng.random() < 0.15):
                kind, before = "run", f"{prose(2)} {prose(1) if _ISSUED.match(value) else one('bearer', 'authorization', 'key', 'login')} "
        else:
            kind, label = "run", 0
            before = f"{prose(3)} {one('commit', 'sha', 'checksum', 'md5', 'uuid', 'revision', 'digest', 'id', prose(1), prose(1))}{one(' ', ': ', '=')}{quote}"
            value = [
                lambda: draw(hexa, one(32, 40, 64)),
                lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)),
                lambda: "/".join(word() + word() for _ in range(4)) + "/" + draw("0123456789", 4),
                lambda: "_".join(word() for _ in range(5)) + "_v2",
                lambda: draw("0123456789", 12) + "-" + word() + "-" + word() + "-" + word(),
                lambda: draw("=-_ab1", 1) * 30 + "a1",
            ][rng.integers(6)]()
            if rng.random() < 0.45:
                kind = "assigned"
                before = f"{prose(3)} {one('token', 'password', 'secret', 'api_key', 'auth')}{sign}{quote}"
                if rng.random() < 0.1:
                    kind, before, quote = "login", f"{prose(2)} {word()}://{word()}:", "@" + word()
                value = one("pass", "password", "xxxx", "****", "$PASSWORD", "{password}", "changeme", "your_token_here", "example", "placeholder", "XXXXXXXXXXXX", "<password>", "${SECRET_TOKEN}", "process.env.TOKEN", "os.environ", "required", "getpass()", "test1234test", "None", "string", word() + word(), word() + word() + word())
            if rng.random() < 0.3:
                path = one("tests/test_app.py", "docs/example.md", "examples/demo.py", "package.lock", "fixtures/mock.json")
        out.append((value, before, quote + " " + prose(3), path, kind, label))
    return out


def train(lexicon: Lexicon, findings: DataFrame | None = None, rows: int = TRAINING_ROWS) -> Scanner:
    """A scanner from labelled findings (candidate, before, after, path, label; rows without a label or candidate don't count),
    at most ``rows`` of them by hash; from generated ones if there are none."""
    if findings is not None:
        drawn = findings.filter("candidate is not null and label is not null")
        drawn = drawn.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after", "path", "label").limit(rows)
        table = [(r[0], r[1] or "", r[2] or "", r[3] or "", _kind(r[0], r[1] or "", r[2] or ""), int(r[4])) for r in drawn.select("candidate", "before", "after", "path", "label").collect()]
    else:
        table = labelled_findings()
    if not table:
        table = labelled_findings()
    x = np.array([features(*r[:5], lexicon) for r in table])
    return Scanner(lexicon, fit(x, np.array([r[5] for r in table])))


def _kind(candidate: str, before: str, after: str) -> str:
    found = candidates(before + candidate + after)
    return next((k for a, _, k in found if a == len(before)), "run")


def scan_text(text: str, path: str, scanner: Scanner) -> list[dict]:
    """The findings of one text, with scores; positions count code points."""
    found = candidates(text)
    if not found:
        return []
    x = np.array([features(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], path, kind, scanner.lexicon) for a, b, kind in found])
    return [{"start": a, "length": b - a, "kind": kind, "score": float(p), "secret": bool(p >= 0.5)} for (a, b, kind), p in zip(found, scanner.forest.predict(x), strict=True)]


def scan(docs: DataFrame, scanner: Scanner, *, text: str = "text", path: str | None = "source") -> DataFrame:
    """docs with findings, an array of (start, length, kind, score, secret); the name replaces a column of the same name.

    Null and empty texts have no findings; a null path is the empty one. Rows are scanned one by one, so copies agree; long texts are
    scanned whole. An empty table gives an empty table.
    """
    keep = [c for c in docs.columns if c != "findings"]
    shared = docs.sparkSession.sparkContext.broadcast(scanner)  # a fixed vocabulary and TREES trees
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("score", pa.float64()), ("secret", pa.bool_())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = (batch.column(batch.num_columns - k).to_pylist() for k in (2, 1))
            found = [scan_text(t, p or "", shared.value) if t else [] for t, p in zip(texts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, arrow)], [*keep, "findings"])

    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("findings", T.ArrayType(FINDING))])
    where = F.lit("") if path is None else docs[path].cast("string")
    return docs.select(*keep, docs[text].alias("_text"), where.alias("_path")).mapInArrow(find, schema)


def redact(docs: DataFrame, scanner: Scanner, *, text: str = "text", path: str | None = "source", mark: str = "[secret]") -> DataFrame:
    """docs with every secret of its texts replaced by ``mark``."""
    own = docs.withColumnsRenamed({"findings": "_own_findings"})
    found = scan(own, scanner, text=text, path=path)
    secrets = F.filter("findings", lambda f: f["secret"])
    # cut from the end, so that earlier positions stay right
    cut = F.aggregate(F.reverse(F.array_sort(secrets)), F.col(text), lambda t, f: F.concat(F.substring(t, F.lit(1), f["start"].cast("int")), F.lit(mark), F.substring(t, (f["start"] + f["length"] + 1).cast("int"), F.length(t))))
    return found.withColumn(text, F.when(F.size(secrets) > 0, cut).otherwise(F.col(text))).drop("findings").withColumnsRenamed({"_own_findings": "findings"}).select(*docs.columns)
