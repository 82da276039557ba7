"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least SHORTEST letters, digits and ``+ / = _ -`` with a digit in it; a run is cut behind each
``=`` that more follows (NAME=value), so that the name stands before the value, not in it.  The value assigned to one of
NAMES is a candidate too, from ASSIGNED characters of any kind on: quoted, or up to white space.  So are the password in ``scheme://user:password@``, what follows
the name of a scheme (Basic, Bearer, Token), and such runs joined by dots.  Candidates may overlap;
``redact`` replaces what secrets cover together.  The forest sees its
length, its transitions between kinds of characters, its entropy, how much of it dictionary words cover, whether it
lies in a path or address, and its neighbouring words.  It is trained on labelled findings: any table of text,
start, length and label; by default those that ``default_findings`` makes from the corpus itself (candidates
of a bounded sample of documents, labelled by what they are assigned to, and the same candidates set into harmless surroundings).

Defined cases: null and empty texts have no candidates; a very long text is searched whole; candidates that touch or overlap each give a finding, in order of start and then of end; repeated rows each
give their findings; a row without id keeps a null id, and is not drawn from for default findings; an empty table gives no findings; other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import trees

SHORTEST = 16
CANDIDATE = rf"[A-Za-z0-9+/=_\-]{{{SHORTEST},}}"
_CANDIDATE = re.compile(CANDIDATE, re.ASCII)
_DIGIT = re.compile("[0-9]")
#: The parts of a run: ``=`` at its end is padding, any other one assigns.
_PART = re.compile("[^=]+(?:=+$)?|=+$")
#: Documents that default findings are drawn from, words of the dictionary (the most frequent of all documents), and findings.
SAMPLE_DOCS = 20000
DICTIONARY = 4096
FINDINGS = 4000
#: Least length of a value that is assigned to one of NAMES.
ASSIGNED = 6
THRESHOLD = 0.5
AROUND = 48
REPLACEMENT = "[SECRET]"
#: Names that secrets are assigned to, words of pass phrases, beginnings that issuers of keys give them, and words beside harmless identifiers.
NAMES = ("token", "secret", "password", "passwd", "passphrase", "pwd", "apikey", "api_key", "access_key", "private_key", "auth", "bearer", "credential", "signature", "key")
SHORT_NAMES = ("sig", "pass", "pin")
SCHEMES = ("basic", "bearer", "token")
HOOKS = ("hook", "hooks", "webhook", "webhooks", "services")
PLAIN = ("correct", "required", "battery", "missing", "copper", "window", "unknown", "planet", "optional", "garden", "string", "yellow", "invalid", "river", "changed", "purple", "monkey", "expired", "silver", "market")
KNOWN_FORMS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "npm_", "xoxb-", "xoxp-", "sk_live_", "sk_test_", "rk_live_", "eyJ")
HARMLESS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "uuid", "guid", "id", "revision", "build", "version", "example", "etag", "isbn", "phone", "card")
_NAMED = rf"(?:(?:{'|'.join(NAMES)})[A-Za-z0-9_\-]{{0,32}}|\b(?:{'|'.join(SHORT_NAMES)}))"
_TO = r"[\"'`]?[ \t]*(?::=|=>|[:=])"
_ASSIGN = _NAMED + _TO
#: Quoted, from a quote to white space, or bare up to white space, the next ``&name=``, a quote that closes, or a comma or semicolon at its end.
_QUOTED = "|".join(rf"{q}((?:\\.|[^{q}\\\n]){{{ASSIGNED},}}){q}|{q}([^\s{q}]{{{ASSIGNED},}})" for q in "\"'`")
_BARE = rf"""((?:(?![&;,][A-Za-z0-9_.\-]{{1,64}}=|["'`](?:[\s>,;)\]}}]|$)|[,;](?:\s|$))\S){{{ASSIGNED},}})"""
_VALUE = re.compile(rf"{_NAMED}(?={_TO}[ \t]*(?:{_QUOTED}|(?![\"'`]){_BARE}))", re.ASCII | re.IGNORECASE)
#: Passwords in addresses, what schemes are followed by, and runs joined by dots.
_LOGIN = rf"://[^\s/:@\"'<>]{{1,64}}:([^\s/@\"'<>]{{{ASSIGNED},128}})@"
_SCHEME = r"\b(?:Basic|Bearer|Token)[ \t]+([A-Za-z0-9+/=_\-.~]{8,})"
_DOTTED = r"[A-Za-z0-9_\-]{2,}(?:\.[A-Za-z0-9_\-]{8,}){1,3}"
_OTHERS = [re.compile(_LOGIN, re.ASCII), re.compile(_SCHEME, re.ASCII | re.IGNORECASE), re.compile(f"({_DOTTED})", re.ASCII)]
#: Texts that may have a candidate, for Arrow.
ANY = rf"{CANDIDATE}|(?i:{_ASSIGN}|{_SCHEME})|{_LOGIN}|{_DOTTED}"
_PLAIN = re.compile(r"[^\W\d_]+(?:[ ._-]+[^\W\d_]+)*\W?")
_WORD = re.compile(r"[A-Za-z]+(?:_[A-Za-z]+)*")
_BEFORE = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\W{0,8}$")

FEATURES = (
    "length", "transitions", "digits", "upper", "lower", "other", "hex", "entropy", "longest_run", "distinct", "vowels", "dictionary",
    "in_path", "in_address", "file_ending", "quoted", "assigned", "named", "name_near", "harmless", "harmless_near", "only_digits", "dashes", "known_form",
    "dots", "mixed", "in_login", "scheme", "hook", "longest_part",
)


_IN_LOGIN = re.compile(r"://[^\s/:@]{1,64}:$")


def _names(word: str) -> bool:
    """Whether a word names a secret."""
    return any(k in word for k in NAMES) or word in SHORT_NAMES


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def coverage(s: str, dictionary: frozenset[str]) -> float:
    """Share of characters that dictionary words of 4 to 10 letters cover, longest first from the left."""
    low, i, n = s.lower(), 0, 0
    while i < len(low):
        for k in range(10, 3, -1):
            if low[i : i + k] in dictionary and i + k <= len(low):
                n, i = n + k, i + k
                break
        else:
            i += 1
    return n / max(1, len(s))


def features(text: str, start: int, end: int, dictionary: frozenset[str]) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - AROUND) : start], text[end : end + AROUND]
    kinds = [_kind(c) for c in s]
    n, counts = len(s), Counter(s)
    runs = [i for i in range(1, n) if kinds[i] != kinds[i - 1]]
    p = np.array(list(counts.values())) / n
    near = [w.lower() for w in _WORD.findall(before)[-4:] + _WORD.findall(after)[:2]]
    m = _BEFORE.search(before)
    name = m.group(1).lower() if m else ""
    left = before.rstrip()
    return [
        float(n), len(runs) / n, kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        float(-(p * np.log2(p)).sum()), max(np.diff([0, *runs, n])) / n, len(counts) / n, sum(c in "aeiouAEIOU" for c in s) / n, coverage(s, dictionary),
        float(s.count("/") > 1 or before.endswith(("/", "\\", "."))), float("://" in before[-24:] or "@" in before[-2:] or after.startswith("@")), float(bool(re.match(r"\.[a-z]{2,4}\b", after))),
        float(before.endswith(('"', "'", "`"))), float(left.endswith(("=", ":")) or left.rstrip("\"'`").rstrip().endswith(("=", ":"))),
        float(_names(name)), float(any(_names(w) for w in near)), float(name in HARMLESS), float(any(w in HARMLESS for w in near)), float(s.isdigit()), float(s.count("-")), float(s.startswith(KNOWN_FORMS)),
        float(s.count(".")), float(0 < kinds.count(0) and 0 < kinds.count(1) and 0 < kinds.count(2)), float(bool(_IN_LOGIN.search(before)) and after.startswith("@")), float(name in SCHEMES and before.endswith((" ", "\t"))),
        float(any(w.lower() in HOOKS for w in _WORD.findall(before)[-6:])), float(max(map(len, re.split(r"[^A-Za-z0-9]", s)))),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end, in order.  Where the last part of a run is too short, or has no digit, the whole run stays a candidate."""
    out = [m.span(m.lastindex) for m in _VALUE.finditer(text)]
    for pattern in _OTHERS:
        out += [m.span(1) for m in pattern.finditer(text) if pattern is not _OTHERS[2] or (len(m.group()) >= SHORTEST and _DIGIT.search(m.group()))]
    for m in _CANDIDATE.finditer(text):
        if _DIGIT.search(m.group()):
            parts = [(m.start() + p.start(), m.start() + p.end()) for p in _PART.finditer(m.group())]
            long = [(a, b) for a, b in parts if b - a >= SHORTEST and _DIGIT.search(text, a, b)]
            out += long if long and long[-1] == parts[-1] else [m.span()]
    return sorted(set(out))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@dataclass
class Scanner:
    model: trees.Model
    dictionary: frozenset[str]

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, float]]]:
        """Start, end (code points) and score of each text's candidates."""
        found: list[list] = [[] for _ in range(len(texts))]
        rows, where = [], []
        hit = pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(hit).tolist():
            t = texts[i].as_py()
            for a, b in candidates(t):
                rows.append(features(t, a, b, self.dictionary))
                where.append((i, a, b))
        if rows:
            for (i, a, b), p in zip(where, self.model.total(np.array(rows)).tolist(), strict=True):
                found[i].append((a, b, p))
        return found


def _label(before: str, s: str) -> int | None:
    """1 if of a known form, or assigned to the name of a secret; words there may be a pass phrase or prose, so only short ones are taken, as prose."""
    if s.startswith(KNOWN_FORMS) and _CANDIDATE.fullmatch(s):
        return 1
    m = _BEFORE.search(before)
    if not m or not _names(m.group(1).lower()) or s.isdigit():
        return 0
    if _PLAIN.fullmatch(s):
        return 0 if len(s) < SHORTEST else None
    return 1


def _made(pick, draw, i: int) -> list[tuple[str, str, str, str, int]]:
    """Kind, text before, candidate, text after, label: secrets that are told by their form or place rather than a name, each with what looks like it."""
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    mixed, word = letters + "0123456789", PLAIN[int(draw.integers(0, len(PLAIN)))]
    some = lambda a, b, of=mixed: pick(of, int(draw.integers(a, b)))
    scheme, end = ("postgres", "mysql", "amqp", "redis", "ftp", "https")[i % 6], ("\n", " then", '"', "'", "")[i % 5]
    password = (some(8, 20), some(6, 12) + pick("!#$%&*+-", 2), word + pick("0123456789", 3))[i % 3]
    hexed = pick("0123456789abcdef", (32, 40, 64)[i % 3])
    parts = [some(8, 14, letters.lower()) for _ in range(3)]
    return [
        ("login", f"{scheme}://{('app', 'root', 'svc_user')[i % 3]}:", password, "@db.internal:5432/main", 1),
        ("login", f"{scheme}://host{i}.example/", f"{word}/{hexed}", "/index", 0),
        ("scheme", ("Authorization: ", "-H 'authorization: ", '"Authorization": "')[i % 3] + ("Basic ", "Bearer ", "Token ")[i // 3 % 3], some(20, 60) + ("==", "=", "")[i % 3], end, 1),
        ("scheme", ("a basic ", "this token ", "the bearer ")[i % 3], parts[0] + parts[1], " of it", 0),
        ("dotted", ("", "use ", "sent ", "with ")[i % 4], f"{pick(letters.upper(), 2)}.{some(16, 24)}.{some(30, 46)}", end, 1),
        ("dotted", ("", "is ", "> ")[i % 3], ".".join(some(20, 80) for _ in range(3)), end, 1),
        ("dotted", ("import ", "see ", "in ")[i % 3], ".".join([("com", "org", "lib")[i % 3], parts[0], parts[1] + str(i % 10), parts[2].title()]), end, 0),
        ("dotted", ("file ", "at https://", "")[i % 3], f"{parts[0]}-{i}.{parts[1]}.{parts[2]}{i % 7}", ("/x", ".html", "\n")[i % 3], 0),
        ("hook", f"https://hooks.{parts[0]}.example/" + ("services", "webhooks", "hook")[i % 3] + f"/T{pick(letters.upper() + '0123456789', 8)}/B{pick(letters.upper() + '0123456789', 8)}/", some(20, 32), end, 1),
        ("hook", f"https://cdn.{parts[0]}.example/assets/{word}/", (hexed, some(20, 32))[i % 2], (".js", ".png", "/full")[i % 3], 0),
        ("asset", (f"https://{parts[0]}.example/", "src=/", "url(../", "img https://cdn.example/")[i % 4] + ("static/", "dist/", "img/", "js/")[i // 4 % 4], (hexed, some(16, 44))[i % 2], (".js", ".css", ".png", ".min.js", ".jpeg")[i % 5], 0),
        ("asset", f"{('at', 'in', 'from')[i % 3]} /{parts[1]}/{parts[2]}/", some(16, 30), ("/data", ".txt", ".bin")[i % 3], 0),
        ("base64", NAMES[i % len(NAMES)] + (": ", "=", ' = "')[i % 3], some(30, 88, mixed + "+/") + ("", "=", "==")[i // 3 % 3], end, 1),
        ("query", f"https://store.example/{word}?sv=2024&" + ("sig=", "signature=", "sas=", "Signature=")[i % 4], some(30, 50) + ("%3D", "")[i % 2], ("&se=2026", "\n")[i % 2], 1),
        ("query", f"https://shop.example/{word}?" + ("q=", "page=", "ref=", "session_start=")[i % 4], (hexed, parts[0] + str(1000 + i) + parts[1])[i % 2], ("&x=1", "\n")[i % 2], 0),
        ("bare", ("it is ", "use ", "- ", "now ")[i % 4], pick(mixed, int(draw.integers(30, 48))), (" for this", "\n", ".")[i % 3], 1),
        ("bare", ("it is ", "use ", "- ", "now ")[i % 4], hexed, (" for this", "\n", ".")[i % 3], 0),
        ("phrase", ("passphrase: ", "pass: ", "Passphrase = ", "backup passphrase: ")[i % 4], (*[("-", "_", ".")[i % 3].join((PLAIN[int(j)], some(4, 8, letters.lower()))[i % 2] for j in draw.integers(0, len(PLAIN), 3 + i % 4))] * 2, some(10, 18) + "!")[i % 3], ("\n", " for it", " (old)")[i // 3 % 3], 1),
        ("phrase", ("key: ", "token: ", "auth: ", "pin: ")[i % 4], pick("0123456789", int(draw.integers(6, 18))), ("\n", " was sent")[i % 2], 0),
    ]


#: Kinds of ``_made`` by their names.
MADE = ("login", "scheme", "dotted", "hook", "asset", "base64", "query", "bare", "phrase")


def default_findings(texts: pd.Series, without: tuple[str, ...] = ()) -> pd.DataFrame:
    """text, start, length, label: candidates assigned to the name of a secret are secrets; in other surroundings, and as commit ids, paths or numbers, not.
    ``without`` leaves kinds of MADE out, so that what the rest teaches about them can be measured."""
    out, draw = [], np.random.default_rng(11)
    add = lambda before, s, after, label: out.append((before + s + after, len(before), len(s), label))
    for t in texts:
        for a, b in candidates(t):
            s = t[a:b]
            label = _label(t[max(0, a - AROUND) : a], s)
            if label is not None:
                add(t[max(0, a - AROUND) : a], s, t[b : b + AROUND], label)
            k = int(draw.integers(0, 6))
            if not s.isdigit() and _CANDIDATE.fullmatch(s):
                hexed = "".join("0123456789abcdef"[i] for i in draw.integers(0, 16, 40))
                add(*[("see commit ", s, " for details", 0), ("files at /var/lib/", s, "/data.bin", 0), ("https://host.example/static/", s, ".js", 0), ('api_key: "', s, '"\n', 1), ("sha256: ", hexed, "", 0), ("password = '", hexed[:24], "'", 1)][k])
    # the same kinds of candidates where a corpus shows none
    for i in range(400):
        raw = "".join("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"[j] for j in draw.integers(0, 62, int(draw.integers(20, 44))))
        hexed = "".join("0123456789abcdef"[j] for j in draw.integers(0, 16, (32, 40, 64)[i % 3]))
        digits = "".join(map(str, draw.integers(0, 10, 16)))
        name, other = NAMES[i % len(NAMES)], HARMLESS[i % len(HARMLESS)]
        add(f'{name} = "', (raw, hexed)[i % 2], '"\n', 1)
        add(f"{name}: ", (hexed, raw)[i % 2], "\n", 1)
        add(f"the {other} ", (hexed, raw)[i % 2], " of it", 0)
        for kind, before, s, after, label in _made(lambda of, n: "".join(of[j] for j in draw.integers(0, len(of), n)), draw, i):
            if kind not in without:
                add(before, s, after, label)
        add(f"{other}: ", hexed, "\n", 0)
        add(("", "export ", "--", "?", "&")[i % 5] + (name, name.upper())[i // 5 % 2] + "=", (raw, hexed)[i // 2 % 2], ("\n", " ", "&page=2")[i % 3], 1)
        add(("", "?", "&")[i % 3] + (other, other.upper())[i // 3 % 2] + "=", (hexed, raw)[i // 2 % 2], ("\n", " ", "&page=2")[i % 3], 0)
        add("/usr/share/", "-".join(["module", "chapter", "section"][: 2 + i % 2]) + f"-{i}-readable-name", "/index.html", 0)
        add(("", "using ", "see ", "- ")[i % 4], KNOWN_FORMS[i % len(KNOWN_FORMS)] + raw, ("\n", " then", ", and")[i % 3], 1)
        dashed = "-".join(hexed[a:b] for a, b in ((0, 8), (8, 12), (12, 16), (16, 20), (20, 32)))
        add(("id ", "uuid: ", "item ", "")[i % 4], dashed, (" of", "\n")[i % 2], 0)
        add(("", "see ", "at ", "in ")[i % 4], hexed, (" of it", "\n", ", too")[i % 3], 0)
        add(("card ", "call ", "order no. ")[i % 3], digits, " by then", 0)
        add("as in ", f"section{i}andfollowingpages"[: 16 + i % 10], " of this", 0)
        # passwords of people: short with signs, or words without a space; and what else is assigned to such names
        pick = lambda letters, n: "".join(letters[j] for j in draw.integers(0, len(letters), n))
        signs = pick("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ", int(draw.integers(3, 9))) + pick("0123456789", int(draw.integers(1, 4))) + pick("!@#$%&*.?+-", int(draw.integers(1, 4)))
        signs = "".join(signs[j] for j in draw.permutation(len(signs)))
        phrase = "".join(PLAIN[j] for j in draw.integers(0, len(PLAIN), int(draw.integers(3, 6))))
        word = PLAIN[int(draw.integers(0, len(PLAIN)))]
        q = ('"', "'", "")[i % 3]
        to = (" = ", ": ", "=")[i // 3 % 3]
        for s in (signs, phrase):
            if len(s) >= ASSIGNED:
                add(f"{name}{to}{q}", s, f"{q}\n", 1)
        if len(word) >= ASSIGNED:
            add(f"the {name}: ", word, " is " + PLAIN[i % len(PLAIN)], 0)
            add(f"{name}{to}{q}", word, f"{q}\n", 0)
        add(f"{name}{to}", ("${%s}", "os.environ.get('%s')", "get_%s()", "<%s>", "{{ %s }}", "request.%s")[i % 6] % name, "\n", 0)
    return pd.DataFrame(out, columns=["text", "start", "length", "label"])


def _surroundings(batches):
    """Each candidate with AROUND characters on both sides."""
    for part in T.slices(batches):
        text = pc.fill_null(part.column("text"), "")
        hits = text.filter(pc.match_substring_regex(text, ANY)).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([t[max(0, a - AROUND) : b + AROUND] for t in hits for a, b in candidates(t)], pa.string())], names=["text"])


def _word_counts(batches):
    for part in T.slices(batches):
        low = pc.utf8_lower(pc.fill_null(part.column("text"), ""))
        words = pc.split_pattern(pc.replace_substring_regex(low, "[^a-z0-9]+", " "), " ").flatten()
        c = pc.value_counts(words)
        c = c.filter(pc.match_substring_regex(c.field("values"), "^[a-z]{4,10}$"))
        yield pa.RecordBatch.from_arrays([c.field("values").cast(pa.string()), c.field("counts").cast(pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame) -> frozenset[str]:
    """The DICTIONARY most frequent words of 4 to 10 letters, counted over all texts, of those met more than twice."""
    T.bounded_batches(docs.sparkSession)
    counted = T.id_and_text(docs).select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in counted.where("n > 2").orderBy(F.desc("n"), "word").limit(DICTIONARY).collect())


def train(docs: DataFrame, findings: pd.DataFrame | None = None) -> Scanner:
    """At most SAMPLE_DOCS documents (of least hashes) are searched for findings; the dictionary is of all documents. FINDINGS and DICTIONARY bound what comes to the driver."""
    T.bounded_batches(docs.sparkSession)
    rows = T.id_and_text(docs).where("text is not null")
    chosen = rows.select("doc_id", F.xxhash64("doc_id").alias("h")).where("doc_id is not null").orderBy("h").limit(SAMPLE_DOCS).select("doc_id").distinct()
    some = rows.join(F.broadcast(chosen), "doc_id")
    around = some.select("text").mapInArrow(_surroundings, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(FINDINGS).toPandas()["text"]
    dictionary = frequent_words(docs)
    if findings is None:
        findings = default_findings(around)
    x = np.array([features(t, s, s + n, dictionary) for t, s, n in zip(findings["text"], findings["start"], findings["length"], strict=True)], float).reshape(len(findings), len(FEATURES))
    return Scanner(trees.forest(x, findings["label"].to_numpy(float)), dictionary)


def findings(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, start and length (code points), score and ``secret`` of each candidate in each whole text."""
    scanner = scanner or train(docs)
    T.bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<start: long, length: long, score: double>>")
    def found(text: pa.Array) -> pa.Array:
        return pa.array([[{"start": a, "length": b - a, "score": p} for a, b, p in x] for part in T.array_slices(text) for x in scanner.scan(part)], kind)

    rows = T.id_and_text(docs).select("doc_id", F.explode(found("text")).alias("f")).select("doc_id", "f.*")
    return rows.withColumn("secret", F.col("score") >= THRESHOLD)


def redact(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """The documents with each secret replaced; n_chars, if there, follows the text."""
    scanner = scanner or train(docs)
    T.bounded_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def cleaned(text: pa.Array) -> pa.Array:
        out: list[pa.Array] = []
        for part in T.array_slices(text):
            found = scanner.scan(part)
            if not any(p >= THRESHOLD for x in found for _, _, p in x):
                out.append(part)
                continue
            new = part.to_pylist()
            for i, x in enumerate(found):
                for a, b in reversed(_merged([(a, b) for a, b, p in x if p >= THRESHOLD])):
                    new[i] = new[i][:a] + REPLACEMENT + new[i][b:]
            out.append(pa.array(new, pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    names = docs.columns
    text = F.when(F.col("row.text").isNotNull(), F.col("new")).cast(docs.schema["text"].dataType)
    after = {"text": text} | ({"n_chars": F.when(F.col("row.n_chars").isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    packed = docs.select(F.struct("*").alias("row"), cleaned(F.col("text").cast("string")).alias("new"))
    return packed.select(*[after.get(c, F.col("row").getField(c)).alias(c) for c in names])
