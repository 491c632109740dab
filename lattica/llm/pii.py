r"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans,
expectation-maximisation estimates how reliable each labeler is, and its posteriors train a span classifier.

Base kinds (email, ip, card, phone) are matched leftmost and non-overlapping; their spans always stay. All base matches,
failing ones too, and looser candidates (spelled-out addresses, national phone numbers, account numbers, identity numbers,
named persons) get a vote of each labeler: for, against or none. The counts of vote patterns of the whole corpus are a table
of at most 3^6 rows a kind; EM on it finds the share of true spans of each kind and P(vote | true or false) of
each labeler. The classifier, a logistic regression over hashed features of the span, its neighbours and the votes, learns the
posteriors on a bounded sample of about `most` candidates. Loose candidates that it takes (score 0.5 or more) are added.

Positions are code points, ends exclusive. Defined cases: a null text is empty and has no spans; ties of start cannot
occur in a kind; loose candidates that touch a base span are left out, of two that overlap the one that begins first stays
(the longer one, if both do); repeated rows get the same result each; a very long text is read whole, in time
that grows with it; without candidates nothing is learned and nothing added; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, record_batch, small_slices, table, texts

PARAMETERS = dict(most=20_000, bits=14)
BASE = ["email", "ip", "card", "phone"]
LOOSE = ["email_spelled", "phone_national", "iban", "id_number", "person"]
KINDS = BASE + LOOSE

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
#: A match begins where a run of its first characters begins, or where the match before it ended; so no run is read twice.
EMAIL_AT, EMAIL = re.compile(f"{_LOCAL}@{_DOMAIN}"), re.compile(f"(?<![A-Za-z0-9._%+-]){_LOCAL}@{_DOMAIN}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_OPEN, _SHUT = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
LOOSE_FORMS = {
    "email_spelled": re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}(?:{_OPEN}(?:at|@){_SHUT}|\s(?:at|AT)\s)[A-Za-z0-9-]{{1,63}}(?:(?:{_OPEN}(?:dot|\.){_SHUT}|\s(?:dot|DOT)\s|\.)[A-Za-z0-9-]{{2,63}}){{1,3}}(?![\w-])"),
    "phone_national": re.compile(r"(?<![\w.+/=-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){1,4}(?![\w/-])"),
    "iban": re.compile(r"(?<![\w-])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\w-])"),
    "id_number": re.compile(r"(?<![\w.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "person": re.compile(r"(?<!\w)(?:[^\W\d_]{1,12}\.?\x20)(?:[A-Z][^\W\d_]{1,20}[-\x20]){0,2}[A-Z][^\W\d_]{1,20}(?!\w)"),
}
#: Words that stand before personal data, and words that tell other numbers.
FOR_WORDS = {
    "email": "email e-mail mail mailto contact kontakt courriel correo reach write".split(),
    "ip": "ip address host server client login adresse".split(),
    "card": "card visa mastercard amex credit karte carte tarjeta payment".split(),
    "phone": "phone tel telephone call mobile cell fax telefon anruf handy appelez téléphone teléfono llame".split(),
    "iban": "iban account bank konto compte cuenta".split(),
    "id_number": "ssn social security insurance versicherung sécurité seguridad passport".split(),
    "person": "name by from dear signed author contact sincerely von par de".split(),
}
AGAINST_WORDS = "order invoice version isbn serial token key hash commit build chapter page section law article model part sku ticket".split()
#: Titles, common given names, mail hosts and endings, calling codes, lengths of account numbers.
TITLES = "mr mrs ms miss dr prof sir herr frau monsieur madame mme mlle señor señora sr sra don doña".split()
NAMES = "anna maria peter john james robert michael william david richard thomas mary patricia jennifer linda elizabeth susan hans klaus wolfgang jürgen ursula monika sabine jean pierre michel marie isabelle nathalie josé juan carlos antonio carmen ana isabel".split()
ENDINGS = "com org net edu gov info io de fr es uk eu ch at it nl".split()
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 64 65 81 82 86 90 91 351 352 353 358 420".split()
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FR": 27, "GB": 22, "IT": 27, "LU": 20, "NL": 18, "PL": 28, "PT": 25, "SE": 24}

WORD = re.compile(r"[^\W\d_]+")
DIGITS = re.compile("[0-9]")
LABELERS = ("form", "checksum", "gazetteer", "context", "against", "edges")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def _matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it holds) of all matches of the base forms."""
    if "@" in text:
        at = 0
        while m := (at and EMAIL_AT.match(text, at)) or EMAIL.search(text, at):
            yield 0, m.start(), m.end(), True
            at = m.end()
    if not DIGITS.search(text):
        return
    for m in IP.finditer(text):
        yield 1, m.start(), m.end(), all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split("."))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            yield 2, m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield 3, m.start(), m.end(), 8 <= len(DIGITS.findall(m[0])) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return sorted((k, s, e) for k, s, e, holds in _matches(text) if holds)


def _loose(text: str) -> Iterator[tuple[int, int, int]]:
    low = text.lower() if "at" in text or "AT" in text else ""
    if "dot" in low or "(at" in low or "[at" in low or "(@" in low or "[@" in low:
        yield from ((4, *m.span()) for m in LOOSE_FORMS["email_spelled"].finditer(text))
    if DIGITS.search(text):
        for kind in ("phone_national", "iban", "id_number"):
            yield from ((KINDS.index(kind), *m.span()) for m in LOOSE_FORMS[kind].finditer(text))
    for m in LOOSE_FORMS["person"].finditer(text):
        first, *rest = re.split(r"[.\x20-]+", m[0].lower())
        if first in TITLES or m[0][0].isupper() and first in NAMES:
            yield 8, m.start(), m.end()


def _votes(text: str, kind: int, start: int, end: int, holds: bool) -> tuple[int, ...]:
    """A vote of each labeler, 1 for, -1 against, 0 none."""
    name, span = KINDS[kind], text[start:end]
    digits = "".join(DIGITS.findall(span))
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    near = [w.lower() for w in WORD.findall(before)[-5:] + WORD.findall(after)[:2]]
    family = {"email_spelled": "email", "phone_national": "phone"}.get(name, name)
    form = checksum = gazetteer = 0
    if name in BASE:
        form = 1 if holds else -1
    if family == "email":
        gazetteer = 1 if re.split(r"\W+", span.strip(" )]}>").lower())[-1] in ENDINGS else 0
        form = form or (1 if re.search(r"[\[({<]|\s(?:dot|DOT)\s", span) else -1)
    elif name == "ip":
        checksum = 1 if holds and digits[0] != "0" else -1
    elif name == "card":
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif name == "phone":
        gazetteer = 1 if any(digits.startswith(c) for c in CODES) else -1
    elif name == "phone_national":
        form = 1 if 9 <= len(digits) <= 12 else -1
        gazetteer = 1 if span[0] in "(0" else -1
    elif name == "iban":
        code = span.replace(" ", "")
        form = 1 if IBAN_LENGTHS.get(code[:2], len(code)) == len(code) else -1
        checksum = 1 if int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1 else -1
        gazetteer = 1 if code[:2] in IBAN_LENGTHS else -1
    elif name == "id_number":
        form = 1
        checksum = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    else:
        words = [w.lower() for w in WORD.findall(span)]
        form = 1 if words[0] in TITLES else 0
        gazetteer = 1 if any(w in NAMES for w in words) else 0
    context = 1 if any(w in FOR_WORDS[family] for w in near) else 0
    against = -1 if any(w in AGAINST_WORDS for w in near) else 0
    left, right = before[-1:], after[:1]
    edges = -1 if left.isalnum() or right.isalnum() or left in "=/\\_#" and left or right in "=/\\_" and right else 1
    return form, checksum, gazetteer, context, against, edges


def candidates(text: str) -> list[tuple[int, int, int, tuple[int, ...], bool]]:
    """(kind, start, end, votes, whether the span is a base span) of a whole text, by kind and start."""
    base = sorted(_matches(text))
    taken = sorted((s, e) for _, s, e, holds in base if holds)
    out = [(k, s, e, _votes(text, k, s, e, holds), holds) for k, s, e, holds in base]
    upto = at = 0
    for s, _, k, e in sorted((s, -e, k, e) for k, s, e in _loose(text)):
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s >= upto and not (at < len(taken) and taken[at][0] < e):
            out.append((k, s, e, _votes(text, k, s, e, True), False))
            upto = e
    return sorted(out)


def span_features(text: str, kind: int, start: int, end: int, votes: tuple[int, ...], bits: int) -> list[int]:
    """Hashed features: kind, shape of the span, words and signs around it, votes."""
    span, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 24]
    shape = re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", span[:80])))
    runs = re.sub(r"(.)\1+", r"\1", shape)
    name = KINDS[kind]
    found = [name, f"{name} runs {runs[:12]}", f"{name} digits {len(DIGITS.findall(span))}", f"left {before[-1:]}", f"right {after[:1]}"]
    found += [f"near {w.lower()}" for w in WORD.findall(before)[-3:] + WORD.findall(after)[:2]]
    found += [f"{labeler} {vote}" for labeler, vote in zip(LABELERS, votes, strict=True)]
    return sorted({zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for x in found})


def em(kind: np.ndarray, votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, prior of each kind, P(vote | class) as [class, labeler, vote + 1]) from the counts n of
    vote patterns. Labelers are independent given the class; pseudo-counts say that a vote is likelier right than wrong.
    The rounds end when no posterior moves by more than 10^-6."""
    pseudo = np.array([[2.0, 2.0, 0.5], [0.5, 2.0, 2.0]])
    q = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    many = len(KINDS)
    while True:
        prior = (np.bincount(kind, n * q, many) + 1) / (np.bincount(kind, n, many) + 2)
        rate = np.empty((2, votes.shape[1], 3))
        for c, w in enumerate((n * (1 - q), n * q)):
            for j in range(votes.shape[1]):
                rate[c, j] = np.bincount(votes[:, j] + 1, w, 3) + pseudo[c]
        rate /= rate.sum(2, keepdims=True)
        score = np.log(prior[kind]) - np.log1p(-prior[kind])
        for j in range(votes.shape[1]):
            score = score + np.log(rate[1, j, votes[:, j] + 1]) - np.log(rate[0, j, votes[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        if np.abs(new - q).max(initial=0) <= 1e-6:
            return new, prior, rate
        q = new


def fit(rows: list[list[int]], label: np.ndarray, bits: int, rounds: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression on soft labels; the last one is the bias."""
    owner, at = np.repeat(np.arange(len(rows)), [len(x) for x in rows]), np.array([i for x in rows for i in x], np.int64)
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(owner, w[at], len(rows)), -60, 60)))
        g = (label - p) / max(len(rows), 1)
        w += 2.0 * (np.bincount(at, g[owner], 1 << bits) - penalty * w)
        b += 2.0 * g.sum()
    return np.append(w, b)


def _code(votes: tuple[int, ...]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


def train(docs: DataFrame, most: int, bits: int) -> np.ndarray:
    """Weights of the span classifier from docs(text)."""
    schema = pa.schema([("kind", pa.int32()), ("votes", pa.int32()), ("place", pa.int64()), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            out = []
            for text in texts(batch):
                for kind, start, end, votes, _ in candidates(text):
                    place = zlib.crc32(f"{start} {text[max(0, start - 30) : end + 30]}".encode("utf-8", "surrogatepass"))
                    out.append((kind, _code(votes), place, span_features(text, kind, start, end, votes, bits)))
            if out:
                yield record_batch(schema, *zip(*out))

    found = Scratch(docs.sparkSession, "pii").save(arrow_map(docs.select("text"), run, "kind int, votes int, place long, at array<int>"), "candidates")
    patterns = found.groupBy("kind", "votes").count().toArrow()  # at most 3^6 rows a kind
    if not patterns.num_rows:
        return np.zeros((1 << bits) + 1)
    order = np.lexsort((patterns.column("votes").to_numpy(), patterns.column("kind").to_numpy()))
    kind, code, n = (patterns.column(c).to_numpy()[order] for c in ("kind", "votes", "count"))
    votes = np.stack([code // 3**k % 3 - 1 for k in range(len(LABELERS))], 1)
    posterior, _, _ = em(kind, votes, n)
    of = dict(zip(zip(kind.tolist(), code.tolist()), posterior.tolist()))
    # about `most` candidates of each kind
    total = np.bincount(kind, n, len(KINDS))
    share = F.element_at(F.array(*[F.lit(float(min(1.0, most / len(KINDS) / max(t, 1)))) for t in total]), F.col("kind") + 1)
    few = found.where(F.pmod("place", F.lit(1_000_003)) / 1_000_003 < share).select("kind", "votes", "at").collect()
    few = sorted((r["kind"], r["votes"], r["at"]) for r in few)
    return fit([x[2] for x in few], np.array([of[x[:2]] for x in few]), bits)


def _named(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def report(docs: DataFrame, weights: np.ndarray, bits: int) -> DataFrame:
    """Counts, digest and spans for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [f"n_{k}" for k in BASE]
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in names), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in small_slices(batches):
            out = []
            for text in texts(batch):
                base, added = [], []
                for kind, start, end, votes, holds in candidates(text):
                    if kind < len(BASE):
                        base += [(kind, start, end)] * holds
                    elif w[-1] + w[span_features(text, kind, start, end, votes, bits)].sum() > 0:
                        added.append((kind, start, end))
                count = [sum(k == kind for k, *_ in base) for kind in range(len(BASE))]
                out.append((*count, hashlib.sha256(_named(base).encode()).hexdigest(), _named(base + added), len(added)))
            yield record_batch(schema, batch.column(1), *zip(*out))

    return arrow_map(docs.select("text", F.col("doc_id").cast("long")), run, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_sha256 string, spans string, n_added long")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(docs, train(docs, **PARAMETERS), PARAMETERS["bits"])
