"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier decides.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Candidates for further spans, outside base spans and each
other, are of three kinds. ``iban``: a country and two digits, then groups of four. ``secret``: runs of letters and digits, also with single -, _, / or + between, of
16 characters or more with a part that has both, or of 12 or more digits alone. ``name``: a title or a given name of the gazetteer with a capitalised word. Three groups of
labelers vote on each candidate for, against or not at all: regex (shape: hex run, mixed run, checksum, capitals), gazetteer (countries, titles, given names, names that stand
before credentials or accounts) and context (assignment, quotes, what stands around). Their votes and a few features of
the span make a pattern; patterns are few (under 3 * 2^12), and their counts over all documents are all that the driver reads.
For each kind, expectation-maximisation (Dawid and Skene, two classes) estimates the labelers' reliabilities and each pattern's posterior from the
counts; a logistic span classifier is trained on the features with these posteriors, and decides.

Defined cases: null or empty text has no spans; repeated rows are treated alike; spans never overlap base spans; an empty
table gives an empty result, and with no candidate of a kind no span of it is added; extra columns are not carried by ``spans`` and all are by
``redact``. Whole texts are searched, in time linear in their length.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, cut, text_slices

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "name")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+-]{12})[_/+-]*([A-Za-z0-9]+(?:[-_/+][A-Za-z0-9]+)*)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
# Names that stand before credentials and account numbers.
GAZETTEER = frozenset(
    "account apikey auth bearer card credential iban id key konto passphrase passwd password pin pwd secret token user username".split()
)
# What published kinds of keys begin with.
PREFIXES = ("AIza", "AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "npm_", "pk_live_", "rk_live_", "sk-", "sk_live_", "xoxb-", "xoxp-")
# Countries of account numbers, titles, and given names.
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split())
TITLES = "Dr Frau Herr Madame Miss Mme Monsieur Mr Mrs Ms Prof Señor Señora Sr Sra".split()
GIVEN = (
    "Alice Andreas Anna Antonio Barbara Carlos Carmen Charles Christine Christopher Claire Daniel David Elena Elizabeth Emily Emma Eva Francisco Hans Helen "
    "Isabel Isabelle Jacques James Javier Jean Jennifer Jessica Johannes John José Juan Julia Karen Karl Katharina Klaus Laura Linda Lucas Lukas Manuel Marco Maria "
    "María Marie Mark Martin Mary Matthew Michael Michel Monika Nancy Nicolas Pablo Patricia Paul Pedro Peter Philippe Pierre Richard Robert Sabine Sandra Sarah Sophie Stefan "
    "Steven Susan Thomas Ursula William Wolfgang"
).split()
_CAPITAL = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_FIRST = re.compile("([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)\\.?\x20(?=[A-ZÀ-ÖØ-Þ])")
_NAME = re.compile(rf"{_CAPITAL}\.?\x20{_CAPITAL}(?:[\x20-]{_CAPITAL})?")
_NAMES = frozenset(TITLES + GIVEN)
_BEFORE_NAME = re.compile(r"(?:author|by|contact|dear|from|name|regards|signed)[:,]?\s*\Z", re.IGNORECASE)
_NAME_BEFORE = re.compile(r"([A-Za-z_]+)[\x20\t]*[=:]?[\x20\t]*[\"']?\Z")
#: Numbers of patterns of a kind are so many.
OF_KIND = 3**5 * 2**4
#: Votes are 0 against, 1 for, 2 none.
LABELERS = 5
FEATURES = 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, by the at signs: the name before one is the whole run of its characters since the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    cards, ips = [], []
    for m in _IP.finditer(text):
        # leading zeros first: a part may have any number of digits, a number to convert has three at most
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m.group().split("."))):
            ips.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append((2, *m.span()))
    phones = []
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                phones.append((3, *m.span()))
    return out + ips + cards + phones


def _named(before: str) -> bool:
    """Does a name for credentials or accounts end the text before a span?"""
    name = _NAME_BEFORE.search(before)
    return bool(name and GAZETTEER.intersection(name.group(1).lower().split("_")))


def _assigned(before: str) -> bool:
    return re.search(r"[=:][\x20\t]*[\"']?\Z", before) is not None


def _code(kind: int, votes: list[int], features: list[bool]) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v
    for f in features:
        code = code * 2 + f
    return code


def pattern_of(text: str, a: int, b: int) -> int:
    """A secret's votes (base 3) and features (bits) as one number."""
    run = text[a:b]
    digits = sum(c in "0123456789" for c in run)
    hexes = digits + sum(c in "abcdefABCDEF" for c in run)
    before = text[max(0, a - 40) : a]
    quoted = text[a - 1 : a] in ('"', "'") and text[b : b + 1] == text[a - 1 : a]
    assigned, prefixed = _assigned(before), run.startswith(PREFIXES)
    votes = [
        1 if hexes == len(run) and digits < len(run) and len(run) >= 32 else 2 if digits == len(run) else 0,  # regex: hex run
        1 if 0 < digits < len(run) else 0 if digits == 0 else 2,  # regex: letters and digits
        1 if prefixed or _named(before) else 0,  # gazetteer
        1 if assigned else 2 if prefixed else 0,  # context: assignment
        1 if quoted else 2 if assigned or prefixed else 0,  # context: quotes
    ]
    return _code(0, votes, [len(run) >= 24, hexes == len(run), digits == len(run), len(set(run.lower())) >= 8])


def iban_checks(run: str) -> bool:
    """The checksum of an account number: its rearranged digits leave 1 over 97."""
    plain = run.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def iban_pattern(text: str, a: int, b: int) -> int:
    run, before = text[a:b], text[max(0, a - 40) : a]
    checks, known = iban_checks(run), run[:2] in COUNTRIES
    votes = [
        1 if checks else 0,  # regex: checksum
        1 if run[4:5] == " " and " " in run[9:10] else 2,  # regex: groups of four
        1 if known else 0,  # gazetteer: country
        1 if _named(before) else 2,  # gazetteer: a name before
        1 if _assigned(before) else 2,  # context
    ]
    return _code(1, votes, [checks, known, len(run) >= 18, sum(c.isdigit() for c in run) * 2 >= len(run)])


def name_pattern(text: str, a: int, b: int) -> int:
    parts = text[a:b].replace(".", "").split()
    title, given = parts[0] in TITLES, parts[0] in GIVEN or parts[1] in GIVEN
    near = _BEFORE_NAME.search(text[max(0, a - 20) : a]) is not None
    behind = text[b : b + 40]
    votes = [
        1 if len(parts) >= 2 else 0,  # regex: capitalised words
        1 if title else 2,  # gazetteer: title
        1 if given else 2,  # gazetteer: given name
        1 if near else 2,  # context: before
        1 if "@" in behind or "+" in behind else 2,  # context: an address or number behind
    ]
    return _code(2, votes, [title, given, near, len(parts) >= 3])


def votes_of(code: int) -> tuple[list[int], list[int]]:
    features, votes = [], []
    for _ in range(FEATURES):
        code, bit = divmod(code, 2)
        features.append(bit)
    for _ in range(LABELERS):
        code, v = divmod(code, 3)
        votes.append(v)
    return votes[::-1], features[::-1]


def _is_secret(run: str) -> bool:
    """A part of letters and digits in a run of 16 or more, three parts of hex digits, or 12 digits alone."""
    if run.isdigit():
        return len(run) >= 12
    if len(run) < 16 or not any(c in "0123456789" for c in run):
        return False
    parts = re.split("[-_/+]", run)
    if len(parts) == 1:
        return True
    mixed = [p for p in parts if len(p) >= 4 and any(c.isdigit() for c in p) and any(c.isalpha() for c in p)]
    return sum(map(len, mixed)) * 3 >= len(run) or len(parts) >= 3 and all(re.fullmatch("[0-9a-fA-F]{4,}", p) for p in parts)


def person_names(text: str) -> Iterator[tuple[int, int]]:
    """A title with one or two capitalised words, or a given name with one."""
    for m in _FIRST.finditer(text):
        word = m.group(1)
        if word not in _NAMES or text[m.start() - 1 : m.start()].isalnum():
            continue
        whole = _NAME.match(text, m.start())
        if whole:
            end, last = whole.end(), whole.group().rfind(" ")
            if word in GIVEN and last > len(word) + 1:  # the third word may begin a sentence
                end = whole.start() + last
            yield whole.start(), end


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """(start, end, pattern) of candidates outside base spans and earlier kinds' candidates, by kind and start."""
    taken = [(a, b) for _, a, b in base]

    def outside(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        held = sorted(taken)
        starts, ends = [a for a, _ in held], np.maximum.accumulate([b for _, b in held]).tolist() if held else []
        kept = []
        for a, b in found:
            k = bisect_right(starts, b - 1)
            if not (k and ends[k - 1] > a):
                kept.append((a, b))
        taken.extend(kept)
        return kept

    ibans = outside([m.span() for m in _IBAN.finditer(text) if m.group()[:2] in COUNTRIES or iban_checks(m.group())])
    secrets = outside([m.span(1) for m in _SECRET.finditer(text) if _is_secret(m.group(1))])
    names = outside(list(person_names(text)))
    for spans_of, pattern in ((secrets, pattern_of), (ibans, iban_pattern), (names, name_pattern)):
        for a, b in spans_of:
            yield a, b, pattern(text, a, b)


def expectation_maximisation(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Posterior of each pattern, from vote counts alone; starts from the majority of the votes."""
    votes = np.array([votes_of(c)[0] for c in counts])
    n = np.array(list(counts.values()), float)
    q = ((votes == 1).sum(1) + 0.5) / ((votes != 2).sum(1) + 1.0)
    for _ in range(rounds):
        prior = np.clip((n * q).sum() / n.sum(), 1e-3, 1 - 1e-3)
        log = np.tile([np.log(1 - prior), np.log(prior)], (len(n), 1))
        for k in range(votes.shape[1]):
            for c, weight in ((0, n * (1 - q)), (1, n * q)):
                rate = np.array([weight[votes[:, k] == v].sum() + 1.0 for v in range(2)])
                log[:, c] += np.append(np.log(rate / rate.sum()), 0.0)[votes[:, k]]  # a labeler that does not vote says nothing
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - q).max() < 1e-9:
            break
        q = new
    return dict(zip(counts, q.tolist()))


def span_classifier(counts: dict[int, int], posterior: dict[int, float], steps: int = 100) -> dict[int, float]:
    """Logistic regression on votes and features, trained with the posteriors as soft labels."""
    rows = []
    for c in counts:
        votes, features = votes_of(c)
        rows.append([*[v == 1 for v in votes], *[v == 0 for v in votes], *features, 1])
    x = np.array(rows, float)
    n, y = np.array(list(counts.values()), float), np.array([posterior[c] for c in counts])
    n = n / max(1.0, n.max() / 1000)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (n * (y - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return dict(zip(counts, (1 / (1 + np.exp(-x @ w))).tolist()))


def accepted(counts: dict[int, int]) -> list[int]:
    """Patterns whose spans are added, each kind by its own model."""
    out: list[int] = []
    for kind in {c // OF_KIND for c in counts}:
        some = {c: n for c, n in counts.items() if c // OF_KIND == kind}
        p = span_classifier(some, expectation_maximisation(some))
        out += [c for c, v in p.items() if v >= 0.5]
    return sorted(out)


def found(docs: DataFrame) -> DataFrame:
    """doc_id and all base spans and candidates: array of (kind, start, end, pattern), by kind and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("pattern", pa.int32())]))
        for batch in text_slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                more = [{"kind": 4 + c // OF_KIND, "a": a, "b": b, "pattern": c} for a, b, c in candidates(text, base)]
                out.append([{"kind": k, "a": a, "b": b, "pattern": -1} for k, a, b in base] + more)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "found"])

    schema = "doc_id long, found array<struct<kind:int,a:long,b:long,pattern:int>>"
    return docs.select("doc_id", blank("text").alias("text")).mapInArrow(run, schema)


def fit(table: DataFrame) -> list[int]:
    """Accepted patterns, from the counts of all candidates of ``found``."""
    counted = table.select(F.explode("found").alias("s")).filter("s.kind >= 4").groupBy("s.pattern").count()
    return accepted({int(r[0]): int(r[1]) for r in counted.collect()})  # under 3 * 2^12 patterns


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added, n_spans."""
    table = cut(found(docs), "spans")
    good = F.array(*[F.lit(c) for c in fit(table)]).cast("array<int>")
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["a"], s["b"])
    base = F.filter("found", lambda s: s["kind"] < 4)
    kept = F.filter("found", lambda s: (s["kind"] < 4) | F.array_contains(good, s["pattern"]))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return table.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(F.array_join(F.transform(base, shown), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(kept, shown), ",").alias("spans"),
        (F.size(kept) - F.size(base)).cast("long").alias("n_added"),
        F.size(kept).cast("long").alias("n_spans"),
    )


def mask(text: str, marks: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in marks):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with all spans masked in ``text``; null stays null. All columns stay."""
    counts = found(docs).select(F.explode("found").alias("s")).filter("s.kind >= 4").groupBy("s.pattern").count()
    good = set(accepted({int(r[0]): int(r[1]) for r in counts.collect()}))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = []
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    text = mask(text, base + [(4 + c // OF_KIND, a, b) for a, b, c in candidates(text, base) if c in good])
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)
