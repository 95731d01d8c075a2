"""Personal data by weak supervision.

1. Base patterns find their spans exactly as stated. Looser patterns add candidates: other spellings of the base kinds, matches
   that the base dropped, account numbers, social security numbers and secrets (keys, tokens, passwords).
2. Labelers vote on every candidate, base matches included: for it (+), against it (-) or not at all. There are regex labelers
   (strict shape, isolation), checksum and range labelers (for secrets: how random it looks), gazetteers (issuer prefixes, calling
   codes, top-level domains, countries, prefixes of keys) and context labelers (words nearby).
3. Vote patterns are counted over the whole corpus in Spark; there are at most 3^6 of them for each kind, so the counts that reach
   the driver don't grow with the corpus. Expectation-maximisation on the counts estimates for each kind how reliable each labeler
   is and how likely each pattern is real. Base matches are given as real. Beliefs held beforehand weigh as much as BELIEF spans, so
   that a kind that is hardly seen is judged by them.
4. A logistic classifier is trained on these soft labels of a bounded sample of spans (SAMPLE of each kind). It sees the votes by
   kind and what the labelers don't: the span's length, letters and separators, and what stands around it. Candidates that it
   accepts, that no checksum contradicts and that don't overlap a base span are added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, written

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
N_BASE = 4
LABELERS = ("shape", "isolation", "checksum", "gazetteer", "context", "contrary")
CHECKSUM = LABELERS.index("checksum")
#: Least probability of an added span, spans that the beliefs weigh as much as, most training spans of a kind.
THRESHOLD, BELIEF, SAMPLE = 0.9, 20.0, 3000

# The base patterns of the contract. Where a run can't match from its middle, the search starts at its start only.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Candidates beyond the base.
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[ ]?(?:\(at\)|\[at\])[ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\.|\(dot\)|\[dot\])[ ]?[A-Za-z0-9-]{1,63}){1,4}", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[./][0-9]{4}){3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\+[0-9]{1,3} ?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
)
#: Secrets: what is assigned to a telling name, and keys with a public prefix. Group 1 is the span.
_SECRETS = (
    re.compile(r"(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret(?:[_-]key)?|auth[_-]?token|token|password|passwd|pwd)[\"']?[ ]{0,3}(?::|:?=)[ ]{0,3}[\"']?([A-Za-z0-9+/_.=~!@#$%^&*-]{8,512})", re.I),
    re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9-]{10,255}|sk-[A-Za-z0-9_-]{20,255}|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9])"),
    re.compile(r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)"),
)
_HINTS = ("key", "token", "secret", "pass", "pwd", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza", "PRIVATE")

# Gazetteers, small and public: issuer prefixes, calling codes, country codes of accounts, top-level domains.
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65")
_CALLING = ("1", "33", "34", "39", "41", "43", "44", "49", "52", "54", "55", "56", "61", "81", "86", "91")
_COUNTRIES = ("AT", "BE", "CH", "DE", "ES", "FR", "GB", "IE", "IT", "LU", "NL", "PL", "PT", "SE")
_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "ch", "at", "eu")
_KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza", "-----BEGIN")
_NEAR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|correo|courriel|write to)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|address|server|adresse|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|credit|debit|tarjeta|carte|karte)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|fax|mobile|telefon|t[ée]l[ée]phone|tel[ée]fono)\b", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|konto|compte|cuenta)\b", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security)\b", re.I),
    "secret": re.compile(r"(?:key|token|secret|password|passwd|pwd|credential)", re.I),
}
_AGAINST = re.compile(r"\b(?:version|v|release|isbn|issn|order|invoice|section|chapter|token|key|sha|commit|build|figure|part no)\b\W*$", re.I)
_PLACEHOLDER = re.compile(r"(?i)your|example|changeme|xxxx|\*\*\*\*|\.\.\.|none|null|true|false")
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    "card": re.compile(r"[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "secret": re.compile(r"[0-9a-f]{32,128}|[0-9A-F]{32,128}|[A-Za-z0-9+/]{24,}={0,2}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|-----BEGIN .*"),
}


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _mod97(account: str) -> bool:
    s = account.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _random_looking(s: str) -> int:
    """1 for many different characters of at least two kinds, -1 for a plain word or a placeholder."""
    if s.startswith("-----BEGIN"):
        return 1
    kinds = sum(any(f(c) for c in s) for f in (str.isdigit, str.islower, str.isupper))
    if _PLACEHOLDER.search(s) or kinds < 2 and not s.isdigit() or len(set(s)) < 5:
        return -1
    return 1 if len(s) >= 16 and len(set(s)) >= 8 else 0


def _octets(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the base e-mail pattern, found from their @ signs in linear time."""
    pos, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            pos = m.end()
            at = text.find("@", pos)
        else:
            pos = at + 1 if start == at else max(pos, start)
            at = text.find("@", at + 1)


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of the base, and matches that its checks dropped."""
    good, bad = [], []
    if "@" in text:
        good += [(a, b, "email") for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            (good if _octets(m[0]) else bad).append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = _digits(m[0])
                if 14 <= len(d) <= 19:
                    (good if luhn(d) else bad).append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (good if 10 <= len(_digits(m[0])) <= 15 else bad).append((m.start(), m.end(), "phone"))
    good.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return good, bad


def votes(text: str, start: int, end: int, kind: str) -> list[int]:
    """One vote of -1, 0 or 1 for each of LABELERS."""
    s = text[start:end]
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    shape = 1 if _STRICT[kind].fullmatch(s) else 0
    sides = "_/" if kind == "secret" else "_\"'/="  # a secret is quoted or assigned as a rule
    glued = (before[-1:].isalnum() or before[-1:] in sides) and before != "" or after[:1].isalnum() or after[:1] != "" and after[:1] in sides.replace("/", "").replace("=", "")
    if kind == "card":
        d = _digits(s)
        check, known = (1 if luhn(d) else -1), (1 if d.startswith(_ISSUERS) else 0)
    elif kind == "ip":
        check = (1 if _octets(s) else -1) if "." in s else 0
        known = -1 if s.startswith(("0.", "127.", "255.")) else 0
    elif kind == "phone":
        d = _digits(s).removeprefix("00")
        check, known = (1 if 10 <= len(d) <= 15 else -1), (1 if d.startswith(_CALLING) and s[0] in "+0" else 0)
    elif kind == "iban":
        check, known = (1 if _mod97(s) else -1), (1 if s[:2] in _COUNTRIES else -1)
    elif kind == "ssn":
        check, known = 0, 0
    elif kind == "secret":
        check, known = _random_looking(s), (1 if s.startswith(_KEYS) else 0)
    else:
        check, known = 0, 1 if re.split(r"\.|dot\W", s)[-1].strip(" )]").lower() in _DOMAINS else 0
    near = 1 if _NEAR[kind].search(before) or kind != "secret" and _NEAR[kind].search(after) else 0
    against = _PLACEHOLDER.search(s) if kind == "secret" else _AGAINST.search(before)
    return [shape, -1 if glued else 1, check, known, near, -1 if against else 0]


#: What the classifier sees besides the votes.
FEATURES = ("length", "digits", "upper", "separators", "left_space", "left_letter", "left_mark", "right_space", "right_letter", "right_mark", "line_start", "hint_near")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """Values between 0 and 1 of FEATURES."""
    s, n = text[start:end], end - start
    left, right = text[start - 1 : start] if start else "\n", text[end : end + 1] or "\n"
    side = lambda c: [float(c.isspace()), float(c.isalnum()), float(not c.isspace() and not c.isalnum())]
    line = text.rfind("\n", max(0, start - 200), start) + 1
    hints = [m.end() for m in _NEAR[kind].finditer(text, max(0, start - 48), start)]
    share = lambda f: sum(map(f, s)) / n
    return [
        min(n, 64) / 64, share(str.isdigit), share(str.isupper), share(lambda c: not c.isalnum()), *side(left), *side(right),
        float(not text[line:start].strip()), 1 - (start - hints[-1]) / 48 if hints else 0.0,
    ]

def _code(kind: str, v: list[int], base: bool) -> int:
    out = 2 * KINDS.index(kind) + base
    for x in v:
        out = 3 * out + x + 1
    return out


def _decode(code: int) -> tuple[int, bool, list[int]]:
    v = []
    for _ in LABELERS:
        v.insert(0, code % 3 - 1)
        code //= 3
    return code // 2, bool(code % 2), v


def find(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int, list[float]]]]:
    """Base spans; and candidates (start, end, kind, code of kind and votes, features), the base spans among them."""
    text = text or ""
    good, bad = base_spans(text)
    spans = dict.fromkeys([*good, *bad])
    if _DIGIT.search(text) or "(at)" in text.lower() or "[at]" in text.lower():
        for kind, pattern in _LOOSE:
            spans |= dict.fromkeys((m.start(), m.end(), kind) for m in pattern.finditer(text))
    low = text.lower()
    if any(h.lower() in low for h in _HINTS):
        for pattern in _SECRETS:
            spans |= dict.fromkeys((*m.span(1), "secret") for m in pattern.finditer(text))
    own = set(good)
    return good, [(a, b, k, _code(k, votes(text, a, b, k), (a, b, k) in own), features(text, a, b, k)) for a, b, k in spans]


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


_FOUND = "struct<base: array<struct<start: int, end: int, kind: string>>, seen: array<struct<start: int, end: int, kind: string, code: int, traits: array<float>>>>"


def candidates(text: Column) -> Column:
    """struct of _FOUND for a text."""
    span = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]

    @F.arrow_udf(_FOUND)
    def f(texts: pa.Array) -> pa.Array:
        rows = [find(t) for t in texts.to_pylist()]
        base = pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in b] for b, _ in rows], pa.list_(pa.struct(span)))
        seen = pa.array([[dict(zip(("start", "end", "kind", "code", "traits"), s, strict=True)) for s in c] for _, c in rows], pa.list_(pa.struct([*span, ("code", pa.int32()), ("traits", pa.list_(pa.float32()))])))
        return pa.StructArray.from_arrays([base, seen], ["base", "seen"])

    return f(text)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Reliabilities:
    """For each kind how likely a candidate beyond the base is real (prior), and how often each labeler votes -, 0 or + on real ones
    and on others (given_real and given_not: kind, vote, labeler)."""

    #: Beliefs: a labeler's votes on real spans and on others.
    REAL, NOT = np.array([[0.05], [0.35], [0.6]]), np.array([[0.35], [0.55], [0.1]])

    def __init__(self, counts: dict[int, int], rounds: int = 60):
        codes = sorted(counts)
        weight = np.array([counts[c] for c in codes], float)
        kind, sure, vote = zip(*map(_decode, codes), strict=True) if codes else ((), (), ())
        kind, sure, vote = np.array(kind, int), np.array(sure, bool), np.array(vote, int).reshape(len(codes), len(LABELERS))
        picks = np.stack([vote == v for v in (-1, 0, 1)]).astype(float)  # vote, pattern, labeler
        of = np.eye(len(KINDS))[kind].reshape(len(codes), len(KINDS))
        real = _sigmoid(vote.sum(axis=1).astype(float))  # to begin with, by majority
        for _ in range(rounds):  # EM: labelers err independently, given the truth
            real = np.where(sure, 1.0, real)  # what the base holds is given
            w1, w0, unsure = weight * real, weight * (1 - real), weight * ~sure
            self.prior = ((unsure * real) @ of + BELIEF / 2) / (unsure @ of + BELIEF)
            seen = lambda w: np.einsum("p,pk,vpl->kvl", w, of, picks)
            self.given_real = (seen(w1) + BELIEF * self.REAL) / ((w1 @ of)[:, None, None] + BELIEF)
            self.given_not = (seen(w0) + BELIEF * self.NOT) / ((w0 @ of)[:, None, None] + BELIEF)
            odds = np.log(self.prior / (1 - self.prior))[kind] + np.einsum("vpl,pvl->p", picks, np.log(self.given_real / self.given_not)[kind])
            real = np.where(sure, 1.0, _sigmoid(odds))
        self.posterior = dict(zip(codes, real.tolist(), strict=True))


class Classifier:
    """Logistic regression on soft labels, by Newton's method with a ridge."""

    def __init__(self, codes: list[int], traits: list[list[float]], soft: np.ndarray, ridge: float = 1.0):
        x = self._design(codes, traits)
        self.weights = b = np.zeros(x.shape[1])
        for _ in range(50):
            p = _sigmoid(x @ b)
            gradient = x.T @ (soft - p) - ridge * b
            hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
            step = np.linalg.solve(hessian, gradient)
            b += step * min(1.0, 4.0 / max(4.0, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break

    @staticmethod
    def _design(codes: list[int], traits: list[list[float]]) -> np.ndarray:
        """Kind, votes for and against, votes by kind, and the traits."""
        n = len(codes)
        if not n:
            return np.zeros((0, len(KINDS) + 2 * len(LABELERS) * (1 + len(KINDS)) + len(FEATURES)))
        kind, _, vote = zip(*map(_decode, codes), strict=True)
        of, vote = np.eye(len(KINDS))[list(kind)], np.array(vote)
        votes = np.hstack([vote > 0, vote < 0]).astype(float)
        by_kind = (of[:, :, None] * votes[:, None, :]).reshape(n, -1)
        return np.hstack([of, votes, by_kind, np.array(traits, float).reshape(n, len(FEATURES))])

    def score(self, codes: list[int], traits: list[list[float]]) -> np.ndarray:
        return _sigmoid(self._design(codes, traits) @ self.weights)


def contradicted(code: int) -> bool:
    """Whether a checksum or range says no."""
    return _decode(code)[2][CHECKSUM] < 0


def accepted(base: list[tuple[int, int, str]], seen: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str]]:
    """Base spans and, from left to right, candidates that passed (the last value) and overlap no span taken before."""
    starts, ends = [], []  # of the base, where overlapping spans are one
    for a, b, _ in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out, last = list(base), 0
    for a, b, k, passed in sorted(seen, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        i = bisect_left(starts, b) - 1
        if passed and a >= last and (i < 0 or ends[i] <= a):
            out.append((a, b, k))
            last = b
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all, as kind:start:end), n_secret,
    n_spans (all).

    Texts are scanned once; what is found is stored and labelled afterwards. Edge cases: a null text counts as empty and has no
    spans; repeated rows, ties and null ids stay as they are; an empty table gives an empty one; other columns are left out
    whatever their names; patterns take linear time on texts of any length."""
    small_batches(docs.sparkSession)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    found = written(rows.select("doc_id", candidates(F.col("text")).alias("x")).select("doc_id", "x.base", "x.seen"), "pii")
    counts = found.select(F.explode("seen.code").alias("code")).groupBy("code").count().collect()
    truth = Reliabilities({r["code"]: r["count"] for r in counts})
    spans = found.select("doc_id", F.explode("seen").alias("s")).select("s.kind", "s.code", "s.traits", F.xxhash64("doc_id", "s.start", "s.end", "s.kind").alias("at"))
    sample = [r for k in KINDS for r in spans.where(F.col("kind") == k).orderBy("at", "code").limit(SAMPLE).collect()]
    codes = [r["code"] for r in sample]
    judge = Classifier(codes, [r["traits"] for r in sample], np.array([truth.posterior[c] for c in codes]))

    @F.arrow_udf("struct<base_sha256: string, spans: string, n_secret: long, n_spans: long>")
    def digest(base: pa.Array, seen: pa.Array) -> pa.Array:
        base, seen = base.to_pylist(), seen.to_pylist()
        every = [x for s in seen for x in s]
        codes = [x["code"] for x in every]
        passed = iter(((judge.score(codes, [x["traits"] for x in every]) >= threshold) & ~np.array([contradicted(c) for c in codes], bool)).tolist())
        out = []
        for b, s in zip(base, seen, strict=True):
            own = [(x["start"], x["end"], x["kind"]) for x in b]
            kept = accepted(own, [(x["start"], x["end"], x["kind"], next(passed)) for x in s])
            out.append((hashlib.sha256(spans_text(own).encode()).hexdigest(), spans_text(kept), sum(k == "secret" for *_, k in kept), len(kept)))
        columns = zip(*out, strict=True) if out else ([],) * 4
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["base_sha256", "spans", "n_secret", "n_spans"])

    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = found.select("doc_id", *map(number, KINDS[:N_BASE]), digest(F.col("base"), F.col("seen")).alias("d"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS[:N_BASE]], "d.base_sha256", "d.spans", "d.n_secret", "d.n_spans")
