"""Secret scans whose false positives a random forest removes, in DataFrame operations alone.

Candidates are private keys, passwords in URLs, web tokens, whatever is assigned to a name like password or token (four
characters or more of any kind), and runs of twelve or more letters, digits and ``+/_-`` with a digit among them that aren't
themselves assigned to. Each is described by built-in expressions: its length, how often its kinds of character change, how many
of its letter pairs are usual in words, how much of it words of a dictionary cover, its alphabet, the path it lies in, and the
words before and after it. A forest trained on labelled findings gives the share of its trees that call it a secret; its
trees are nested ``CASE WHEN`` columns, so scoring is a projection. Training runs on the driver over at most FINDINGS
labelled findings (the first by a hash); their statistics come from the same expressions.

The dictionary is the corpus's own: the DICTIONARY most frequent words of four letters or more, counted over all documents,
and the words of PLACEHOLDERS. No table of labelled findings exists here. ``default_findings`` makes findings from templates of real
secrets and of what is taken for them (checksums, commit ids, UUIDs, placeholders, versions, identifiers, card numbers, prose), and
``corpus_findings`` labels candidates of the corpus by a rule on what the forest isn't told: their exact format, and in how many
documents they are found. Any table with those columns can replace both.

Defined results: a null or empty text has no candidates; a null path counts as empty; a finding without a label is passed
over; without findings of both kinds every candidate counts as a secret. Other columns play no part.
"""

from __future__ import annotations

import json
import random
import string
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_of, words_of, written

_NAME = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[ _-]?key|access[ _-]?key|credentials?|auth|bearer|private[ _-]?key)"
#: What stands before a candidate and isn't part of it: a name and what assigns to it, or the user of a URL.
PREFIX = r"^(?:" + _NAME + r"[A-Za-z0-9_]{0,20}[\"']?[ \t]{0,3}(?:=>|[=:])[ \t]{0,3}|://[^\x00-\x20:/@]{0,64}:)"
CANDIDATE = "|".join(
    (
        r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\x09-\x0D\x20]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?",
        r"://[^\x00-\x20:/@]{0,64}:[^\x00-\x20/@]{3,}(?=@)",
        r"(?=[PpSsTtAaCcBb])" + _NAME + r"[A-Za-z0-9_]{0,20}[\"']?[ \t]{0,3}(?:=>|[=:])[ \t]{0,3}(?:\"[^\"\n]{4,200}\"|'[^'\n]{4,200}'|[^\x00-\x20\"']{4,})",
        r"(?<![A-Za-z0-9+/_\-])eyJ[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]{4,}){1,2}",
        r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]{0,200}[0-9])[A-Za-z0-9+/_\-]{12,}+(?:={1,2}(?![A-Za-z0-9]))?(?![\"']?[ \t]{0,3}(?:=>|[=:][ \t]{0,3}[\"'A-Za-z0-9]))",
    )
)
#: Characters before and after a candidate that count as its neighbours, and pieces of text that surely hold as many.
NEAR, PIECES = 40, 24
#: Labelled findings to learn from at most, and of the corpus; trees, their depth, and the fewest findings of a leaf.
FINDINGS, CORPUS_FINDINGS, TREES, DEPTH, LEAF = 8000, 2000, 25, 8, 3
#: Words of the dictionary; documents from which on a candidate isn't one's own.
DICTIONARY, SHARED = 1000, 20
PLACEHOLDERS = ("password", "passwd", "secret", "token", "example", "sample", "dummy", "test", "change", "your", "here", "user", "admin", "name", "value", "config", "default", "version", "release", "build", "section", "page", "image", "file", "index", "main", "data", "profile", "settings", "placeholder", "insert", "redacted", "hidden", "required", "none", "null", "true", "false", "getenv", "environ", "process", "string", "xxxx", "abcd", "1234", "0000", "qwerty", "****")
PAIRS = ("th", "he", "in", "er", "an", "re", "nd", "on", "en", "at", "ou", "ed", "ha", "to", "or", "it", "is", "hi", "es", "ng", "ar", "te", "se", "st", "io", "le", "as", "ti", "me", "al", "ro", "se", "ra", "ce", "li", "ch", "ma", "co", "de", "ge")
KEY_WORDS, URL_USER = _NAME, r"://[^\s:/@]*:$"
HARMLESS = r"(?i)(?:sha-?(?:1|256|512)|md5|checksum|digest|commit|revision|hash|uuid|guid|etag|integrity|version|example|sample|dummy|placeholder|card|order|invoice|isbn|phone|build|release|page|image|file)"
HARMLESS_PATH = r"(?i)(?:test|example|sample|mock|fixture|doc|readme|\.md$|\.lock$|\.min\.)"
KNOWN = r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|xox[abp]-[0-9A-Za-z\-]{10,}|sk_(?:live|test)_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[0-9A-Za-z_\-]{8,}\.|-----BEGIN )"


def _share(c: Column, others: str) -> Column:
    return F.char_length(F.regexp_replace(c, others, "")) / F.char_length(c)


def any_of(words: tuple[str, ...]) -> str:
    """A regular expression of all words, those with a common beginning together, longer words first."""
    tree: dict = {}
    for w in words:
        node = tree
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def text(node: dict) -> str:
        parts = [("\\" + ch if ch in ".*+?()[]{}|^$\\-" else ch) + text(below) for ch, below in sorted(node.items()) if ch]
        if not parts:
            return ""
        whole = parts[0] if len(parts) == 1 and "" not in node else f"(?:{'|'.join(parts)})"
        return whole + "?" if "" in node else whole

    return text(tree) or "(?!)"


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> tuple[str, ...]:
    """The most frequent words of four lower-case letters or more, ties by code point, and PLACEHOLDERS.

    All words of all documents are counted; only the first few come to the driver."""
    word = F.explode(words_of(F.lower(text_of()))).alias("w")
    counted = docs.select(word).where(F.col("w").rlike("^[a-z]{4,20}$")).groupBy("w").count()
    found = counted.orderBy(F.col("count").desc(), "w").limit(most).collect()
    return tuple(sorted({r["w"] for r in found} | set(PLACEHOLDERS)))


def statistics(words: tuple[str, ...] = PLACEHOLDERS) -> dict[str, Column]:
    """What describes a finding, of its columns candidate, before, after and path."""
    c, before, after, path = (F.coalesce(F.col(k), F.lit("")) for k in ("candidate", "before", "after", "path"))
    n = F.char_length(c)
    runs = F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"))
    flag = lambda b: F.when(b, 1.0).otherwise(0.0)
    return {
        "length": n.cast("double"),
        "transitions": (runs - 1) / n,
        "usual_pairs": F.regexp_count(F.lower(c), F.lit(f"(?=(?:{'|'.join(PAIRS)}))")) / n,
        "dictionary": 1 - F.char_length(F.regexp_replace(F.lower(c), any_of(words), "")) / n,
        "digits": _share(c, "[^0-9]+"),
        "upper": _share(c, "[^A-Z]+"),
        "lower": _share(c, "[^a-z]+"),
        "vowels": _share(c, "[^aeiouAEIOU]+"),
        "hex": flag(c.rlike("^[0-9a-fA-F]+$")),
        "uuid": flag(c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-")),
        "symbols": _share(c, "[A-Za-z0-9]+"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "known": flag(c.rlike(KNOWN)),
        "code": flag(c.rlike(r"^[$<{(*\[]|[({]\S*[)}]")),
        "key_before": flag(before.rlike(KEY_WORDS + r"\W*(?:\w+\W+)?$|" + URL_USER)),
        "assigned": flag(before.rlike("[=:>]\\s*[\"']?$")),
        "user_before": flag(before.rlike(URL_USER)),
        "harmless_near": flag(before.rlike(HARMLESS) | after.rlike(HARMLESS)),
        "harmless_path": flag(path.rlike(HARMLESS_PATH)),
    }


@dataclass(frozen=True)
class Node:
    """A test "name < cut", or a leaf that says how likely a secret is."""

    share: float
    name: str = ""
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def column(self) -> Column:
        if self.low is None:
            return F.lit(self.share)
        return F.when(F.col(self.name) < self.cut, self.low.column()).otherwise(self.high.column())

    def of(self, row: dict) -> float:
        node = self
        while node.low is not None:
            node = node.low if row[node.name] < node.cut else node.high
        return node.share


def _best(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The cut of one statistic that leaves the least Gini impurity, and that impurity."""
    order = np.argsort(x, kind="stable")
    v, t = x[order], np.cumsum(y[order])
    n = len(y)
    k = np.flatnonzero(v[1:] > v[:-1]) + 1
    k = k[(k >= LEAF) & (k <= n - LEAF)]
    if not len(k):
        return 0.0, np.inf
    p, q = t[k - 1] / k, (t[-1] - t[k - 1]) / (n - k)
    impurity = (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
    b = int(np.argmin(impurity))
    return float((v[k[b] - 1] + v[k[b]]) / 2), float(impurity[b])


def _tree(x: np.ndarray, y: np.ndarray, names: list[str], rng: np.random.Generator, depth: int) -> Node:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAF or share in (0.0, 1.0):
        return Node(share)
    tried = rng.choice(len(names), max(1, len(names) // 3), replace=False)
    found = [(*_best(x[:, f], y), f) for f in tried]
    cut, impurity, f = min(found, key=lambda b: b[1])
    if impurity >= share * (1 - share):
        return Node(share)
    low = x[:, f] < cut
    return Node(share, names[f], cut, _tree(x[low], y[low], names, rng, depth - 1), _tree(x[~low], y[~low], names, rng, depth - 1))


def trained(findings: DataFrame, words: tuple[str, ...] = PLACEHOLDERS, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Node]:
    """A forest from findings (candidate, before, after, path, label 0 or 1)."""
    names = list(statistics())
    own = findings.where("label in (0, 1) and length(candidate) > 0").select(*(s.alias(k) for k, s in statistics(words).items()), "label", F.xxhash64("candidate", "before", "after", "path").alias("o"))
    rows = own.orderBy("o", "label").limit(FINDINGS).collect()
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return []
    x = np.array([[r[k] for k in names] for r in rows], float)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        out.append(_tree(x[pick], y[pick], names, rng, depth))
    return out


def templates(r: random.Random) -> tuple[list, list]:
    """Makers of secrets and of harmless findings: each gives a candidate and what stands before it."""
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    hexes, alnum, digits = "0123456789abcdef", string.ascii_letters + string.digits, string.digits
    mixed = alnum + "!@#$%&*?._~^"
    plain = ("correct horse battery staple river mountain window garden purple monkey silver thunder coffee planet dragon winter summer rocket falcon").split()

    def named(key: str) -> str:
        return r.choice([f"{key}=", f"{key} = ", f'{key} = "', f"{key}: ", f'"{key}": "', f"{key.upper()}=", f"{key} => '"])

    secret_name = lambda: named(r.choice(["password", "passwd", "pwd", "db_password", "secret", "user_password", "passphrase"]))
    token_name = lambda: named(r.choice(["token", "api_key", "secret_key", "auth_token", "access_key", "api-key", "client_secret"]))
    secrets = [
        lambda: ("AKIA" + some(string.ascii_uppercase + digits, 16), r.choice(["", named("aws_access_key_id")])),
        lambda: (some(hexes, r.choice([16, 18, 20, 24, 32])), secret_name()),
        lambda: (some(hexes, r.choice([32, 40, 64])), token_name()),
        lambda: (some(hexes.upper(), r.choice([32, 40])), token_name()),
        lambda: (some(alnum + "+/", 40), token_name()),
        lambda: ("ghp_" + some(alnum, 36), r.choice(["", token_name()])),
        lambda: ("sk_live_" + some(alnum, 24), r.choice(["", token_name()])),
        lambda: ("xoxb-" + some(digits, 11) + "-" + some(alnum, 24), r.choice(["", "Bearer "])),
        lambda: ("eyJ" + some(alnum, 20) + ".eyJ" + some(alnum, 40) + "." + some(alnum + "-_", 43), r.choice(["", "Authorization: Bearer ", token_name()])),
        lambda: (some(alnum, r.randint(14, 22)) + r.choice(digits), secret_name()),
        lambda: (some(mixed, r.randint(8, 16)), secret_name()),
        lambda: (r.choice(plain) + r.choice(["", some(digits, 1)]) + some(digits, 1) + r.choice("!#$@?"), secret_name()),
        lambda: (r.choice(plain).capitalize() + some(digits, r.randint(2, 4)) + r.choice(["", "!"]), secret_name()),
        lambda: (r.choice("-_. ").join(r.choice(plain) for _ in range(4)), secret_name()),
        lambda: (some(mixed.replace("@", "").replace("/", ""), r.randint(6, 14)), f"{r.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{r.choice(['app', 'root', 'svc', ''])}:"),
        lambda: ("-----BEGIN " + r.choice(["", "RSA ", "EC "]) + "PRIVATE KEY-----\n" + "\n".join(some(alnum + "+/", 64) for _ in range(3)) + "\n", r.choice(["", "key: "])),
        lambda: (some(string.ascii_lowercase, r.randint(24, 32)), token_name()),
    ]

    def invented(n: int) -> str:
        return "".join(r.choice(PAIRS) for _ in range(n))

    harmless = [
        lambda: (some(hexes, r.choice([32, 40, 64])), r.choice(["sha256: ", "sha1=", "md5 ", "checksum = ", "integrity: "])),
        lambda: (some(hexes, r.choice([12, 40])), r.choice(["commit ", "revision ", "at commit ", "merged "])),
        lambda: (str(uuid.UUID(int=r.getrandbits(128))), r.choice(["uuid: ", "id=", "request ", ""])),
        lambda: (r.choice(["your-api-key-here-1234", "xxxxxxxxxxxx1234", "changeme123456", "example-token-123", "test-secret-0000", "placeholder12345", "changeme", "your_password", "REDACTED", "example", "xxxxxxxx", "secret", "password"]), r.choice([secret_name, token_name])()),
        lambda: (r.choice(["${DB_PASSWORD}", "$TOKEN", "os.getenv('TOKEN')", "process.env.SECRET", "<your token>", "{{ password }}", "********", "%(password)s", "getenv(SECRET)", "config.password", "null,", "None", "true,", "false", "undefined;", "string,", "required"]), r.choice([secret_name, token_name])()),
        lambda: (r.choice(["the", "that", "this", "which", "your", "must", "with", "from"]) if r.random() < 0.3 else invented(r.randint(2, 6)), r.choice(["token: ", "password: ", "Secret: ", "credentials: ", "auth: "])),
        lambda: (f"release-{r.randint(2000, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}-build{r.randint(1, 99)}", r.choice(["version ", "tag ", ""])),
        lambda: (f"{invented(r.randint(3, 8))}_{r.choice(['settings', 'profile', 'index', 'section'])}_v{r.randint(1, 30)}", r.choice(["", "see ", "import "])),
        lambda: (some(digits, r.choice([13, 16, 19])), r.choice(["", "card ", "order ", "invoice ", "phone "])),
        lambda: (f"assets/{invented(4)}/image-{r.randint(1, 999)}", r.choice(["src=", "file ", ""])),
        lambda: (f"{invented(6)}{r.randint(1, 9999)}", ""),
        lambda: (f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", r.choice(["on ", "date: "])),
        lambda: (some(digits, r.randint(4, 8)), r.choice(["token: ", "auth: ", "token = "])),
    ]
    return secrets, harmless


def default_findings(spark: SparkSession, each: int = 2400, seed: int = 11) -> DataFrame:
    """Labelled findings from templates: candidate, before, after, path, label, template (its number)."""
    r = random.Random(seed)
    words = "the of and der die les que para with this that from una dans und are was for".split()

    def prose(n: int) -> str:
        return " ".join(r.choice(words) if r.random() < 0.5 else "".join(r.choice(PAIRS) for _ in range(r.randint(1, 5))) for _ in range(n))

    rows = []
    for label, kinds in zip((1, 0), templates(r), strict=True):
        for k in range(each):
            candidate, before = kinds[k % len(kinds)]()
            near = prose(4) + " " + before
            path = r.choice(["src0", "src7", "config/app.env", "deploy/prod.yml", "lib/client.py"] if label or r.random() < 0.5 else ["tests/test_auth.py", "docs/guide.md", "yarn.lock", "src3", "examples/run.sh"])
            after = "@db.internal/" if before.startswith(("postgres", "mysql", "https", "redis", "amqp")) else r.choice(['" ', " ", ". ", "\n"]) + prose(3)
            rows.append({"candidate": candidate, "before": near[-NEAR:], "after": after[:NEAR], "path": path, "label": label, "template": k % len(kinds)})
    kind = "array<struct<candidate: string, before: string, after: string, path: string, label: int, template: int>>"
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), kind)).alias("r")).select("r.*")


def corpus_findings(candidates: DataFrame, most: int = CORPUS_FINDINGS) -> DataFrame:
    """At most ``most`` findings of each label among candidates, the first by a hash: candidate, before, after, path, label.

    By rule, a secret has the exact format of a service or is 20 characters or more of a random alphabet assigned to a name of
    KEY_WORDS, and is found in fewer than SHARED documents; what has neither is harmless."""
    found = candidates.where("candidate is not null")
    c = F.col("candidate")
    random_ = c.rlike("^(?=.*[0-9].*[0-9])(?:[0-9a-f]{20,}|[0-9A-F]{20,}|[0-9A-Za-z+/_]{20,})$") & ~F.lower(c).rlike(any_of(PLACEHOLDERS))
    likely = c.rlike(KNOWN) | random_ & F.col("before").rlike(KEY_WORDS + r"[\w]*[\"']?\s*[=:]\s*[\"']?$")
    spread = found.where(likely).groupBy(F.col("candidate").alias("other")).agg(F.count_distinct("row").alias("docs")).where(F.col("docs") >= SHARED)
    order = F.xxhash64("candidate", "before", "after", "path")
    named = ["candidate", "before", "after", "path"]
    yes = found.where(likely).join(spread, c == F.col("other"), "left_anti").orderBy(order, *named).limit(most).select(*named, F.lit(1).alias("label"))
    no = found.where(~likely & ~F.col("before").rlike(KEY_WORDS)).orderBy(order, *named).limit(most).select(*named, F.lit(0).alias("label"))
    return yes.union(no)


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """row (a number of each row of docs), doc_id, path, and for each candidate in it candidate, before, after, start (in
    characters, from 0).

    A row without candidates has one row with nulls."""
    t = F.col("t")
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("t"), where.alias("path")).withColumn("row", F.monotonically_increasing_id())
    d = d.withColumn("hits", F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))
    d = d.withColumn("gaps", F.when(F.size("hits") > 0, F.split(t, CANDIDATE, -1)))
    # Gaps and hits in turn, of long ones just the ends, which are all that neighbours can be.
    short = lambda x: F.when(F.char_length(x) > 2 * NEAR, F.concat(F.left(x, F.lit(NEAR)), F.right(x, F.lit(NEAR)))).otherwise(x)
    turns = F.flatten(F.transform("gaps", lambda g, k: F.array(short(g), short(F.coalesce(F.get("hits", k), F.lit(""))))))
    d = d.withColumn("turns", turns)
    before = lambda k: F.right(F.array_join(F.slice("turns", F.greatest(2 * k + 2 - PIECES, F.lit(1)), F.least(2 * k + 1, F.lit(PIECES))), ""), F.lit(NEAR))
    after = lambda k: F.left(F.array_join(F.slice("turns", 2 * k + 3, F.lit(PIECES)), ""), F.lit(NEAR))
    found = F.transform("hits", lambda h, k: F.struct(k.alias("k"), h.alias("hit"), before(k).alias("before"), after(k).alias("after"), F.char_length(F.get("gaps", k)).alias("gap")))
    d = d.select("row", "doc_id", "path", F.explode_outer(F.when(F.size("hits") > 0, found)).alias("x"))
    prefix = F.regexp_extract("x.hit", PREFIX, 0)
    d = d.select("row", "doc_id", "path", "x.*", prefix.alias("prefix"))
    quote = F.when((F.col("prefix") != "") & F.col("hit").rlike(PREFIX + "[\"']"), F.substr("hit", F.char_length("prefix") + 1, F.lit(1))).otherwise("")
    own = F.substr("hit", F.char_length("prefix") + F.char_length(quote) + 1)
    own = F.when(quote != "", F.left(own, F.char_length(own) - 1)).otherwise(own)
    upto = F.sum(F.col("gap") + F.char_length("hit")).over(W.partitionBy("row").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    start = upto - F.char_length("hit") + F.char_length("prefix") + F.char_length(quote)
    return d.select("row", "doc_id", "path", own.alias("candidate"), F.right(F.concat("before", "prefix", quote), F.lit(NEAR)).alias("before"), "after", start.alias("start"))


def findings(candidates: DataFrame, forest: list[Node], words: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """row, doc_id, candidate, start, score (the mean over the trees) and kind; nulls where a row has none."""
    found = candidates.select("*", *(F.when(F.col("candidate").isNotNull(), s).alias(k) for k, s in statistics(words).items()))
    votes = found.select("row", "doc_id", "candidate", "before", "start", *(t.column().alias(f"t{k}") for k, t in enumerate(forest)))
    score = sum((F.col(f"t{k}") for k in range(len(forest))), F.lit(0.0)) / len(forest) if forest else F.lit(1.0)
    kinds = (("aws", F.col("candidate").rlike("^AKIA[0-9A-Z]{16}$")), ("private-key", F.startswith("candidate", F.lit("-----BEGIN "))), ("service", F.col("candidate").rlike(KNOWN)), ("password", F.col("before").rlike(r"(?i)passw|passphrase|pwd|://")), ("token", F.col("before").rlike(KEY_WORDS)))
    kind = F.coalesce(*(F.when(test, name) for name, test in kinds), F.lit("other"))
    return votes.select("row", "doc_id", "candidate", "start", F.when(F.col("candidate").isNotNull(), F.round(score, 6)).alias("score"), F.when(F.col("candidate").isNotNull(), kind).alias("kind"))


def scanned(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_secrets, kinds (sorted, comma-joined), secrets (distinct, sorted), score (highest, 0 without) of
    each row of docs."""
    words = dictionary(docs)
    # Texts are searched once; labels and scores start from what was found.
    found = written(candidates(docs, path).drop("start"), "candidates").withColumn("start", F.lit(None).cast("long"))
    if labelled is None:
        labelled = default_findings(docs.sparkSession).drop("template").union(corpus_findings(found))
    forest = trained(labelled, words)
    secret = F.col("score") >= threshold
    per_row = findings(found, forest, words).groupBy("row", "doc_id").agg(
        F.count("candidate").alias("n_candidates"),
        F.count_if(secret).alias("n_secrets"),
        F.array_join(F.array_sort(F.collect_set(F.when(secret, F.col("kind")))), ",").alias("kinds"),
        F.array_sort(F.collect_set(F.when(secret, F.col("candidate")))).alias("secrets"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    return per_row.drop("row")
