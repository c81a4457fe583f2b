"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

1. Candidates are wide: whatever could be an address, an IP address or a number of seven digits or more, in published or
   disguised form ("ann (at) example dot org", "10[.]0[.]0[.]1"), under each kind that its letters allow and whose check
   digits and ranges it passes: a number may be a candidate for card and for phone. The base matches of each kind (always
   kept) are candidates as well.
2. Labelers each vote yes, no or nothing on a candidate from its text and surroundings alone: regexes for the published
   pattern and the usual groupings, gazetteers (domain endings, mail hosts, card issuers, country codes, special address
   ranges), context words before it that speak for or against its kind, a broken boundary, and placeholders.
3. The votes of all texts are counted by pattern; expectation-maximisation over these counts estimates, for each kind, how
   common personal data is among its candidates and how often each labeler is right where it votes, and with that how
   likely each pattern marks personal data. A labeler that never votes in these texts is taken to be right as often as
   RIGHT says beforehand.
4. A logistic classifier on kind, votes, size and neighbours is fitted on the counted patterns with those likelihoods as
   soft labels, beginning at the labelers' estimated weights and held near them, so that votes which hardly occur keep
   theirs; candidates at KEEP or more that overlap no base span become spans, the likeliest first.

Counting and training see every candidate of every whole text; only counted patterns, which are bounded by the number of
vote patterns, reach the driver. Null text is read as empty; a text without candidates has no spans, and the SHA-256 of
the empty string. Of equally likely candidates that overlap, the earlier in the text, then the kind listed first is taken.
Texts are read whole, in linear time. Repeated rows give repeated results, an empty table none. Other columns pass unread.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import textstats as ts
from .common import map_columns, texts, tune

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: A candidate at this probability or more is a span.
KEEP = 0.8
#: A text in which this doesn't occur has no candidate: all have a digit, an "@", two colons with hex letters at most between, or
#: a written-out "at".
MAY_HOLD = r"[0-9@]|:[A-Fa-f]{0,4}:|(?i:[\[({]at[\])}]| at [a-z0-9-]{1,63} dot )"

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Wide forms: what stands for "@" and what follows it, four groups of digits, groups of hex digits, long numbers.
_AT = re.compile(r"@| ?[\[({]at[\])}] ?| at (?=[A-Za-z0-9-]{1,63} dot )", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[({]dot[\])}] ?| dot )[A-Za-z0-9-]{1,63}){1,6}", re.I)
_DISGUISE = ((re.compile(r" ?[\[({]at[\])}] ?| at ", re.I), "@"), (re.compile(r" ?[\[({]dot[\])}] ?| dot |[\[(]\.[\])]", re.I), "."))
_FOUR = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.,+])[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,18}(?![0-9A-Za-z])")
# Usual groupings.
_CARD_GROUPS = re.compile(r"[0-9]{13,16}|[0-9]{19}|[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}(?:\1[0-9]{3})?|[0-9]{4}([ .-])[0-9]{6}\2[0-9]{4,5}")
_PHONE_GROUPS = re.compile(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\+|00)[1-9][0-9]{0,2}[ ().\-/]+[0-9(][0-9 ().\-/]{5,16}[0-9]|\(?0[1-9][0-9]{1,4}\)?[ /-][0-9][0-9 -]{3,10}[0-9]")
_BASE = (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(?:\.[0-9]+){3}"), re.compile(r"[0-9](?:[ -]?[0-9])+"), re.compile(r"\+[0-9][ ().0-9-]+[0-9]"))
# Gazetteers: fixed public values. Endings of domains, hosts of mailboxes, names that stand for nobody.
_ENDINGS = frozenset(
    "com org net edu gov mil int info biz name pro app dev io ai co me tv cc eu us uk ca au nz ie za in pk bd lk sg my th vn id ph hk tw cn jp kr ru ua by pl cz sk hu ro bg rs hr si at ch li de nl be lu fr mc es pt it mt gr "
    "cy tr il ae sa eg ma tn ng ke gh br ar cl pe uy ve mx cr do pr se no dk fi is ee lv lt".split()
)
_MAIL_HOSTS = frozenset("gmail googlemail outlook hotmail live msn yahoo ymail aol icloud me mac protonmail proton gmx web t-online mail yandex rambler orange free laposte wanadoo libero virgilio terra zoho fastmail qq 163 126".split())
_NOBODY = frozenset("foo bar foobar test user username name you your someone somebody abc xyz xxx noreply no-reply".split())
#: Card issuers: first digits from, to, and how many digits such numbers have.
_ISSUERS = ((4, 4, (13, 16, 19)), (51, 55, (16,)), (2221, 2720, (16,)), (34, 34, (15,)), (37, 37, (15,)), (300, 305, (14,)), (36, 36, (14,)), (38, 39, (14, 16)), (6011, 6011, (16, 19)), (644, 649, (16, 19)), (65, 65, (16, 19)), (3528, 3589, (16, 19)), (62, 62, (16, 17, 18, 19)), (50, 50, (12, 13, 16, 19)), (56, 58, (12, 13, 16, 19)))
#: Country codes of one and of two digits; all others have three and begin with 2, 3, 4, 5, 6, 8 or 9.
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_CODES_OF_THREE = re.compile(r"2[1-69]|3[578]|42|5[09]|6[789]|8[058]|9[679]")
_NEAR = (
    re.compile(r"e-?mail|contact|write|reach|courriel|correo|schreib|kontakt|mailto", re.I),
    re.compile(r"\bips?\b|\bhost|server|address|adresse|client|login|logged|from", re.I),
    re.compile(r"card|visa|credit|karte|carte|tarjeta|mastercard|amex|payment|paid", re.I),
    re.compile(r"phone|\btel\b|\bcall|fax|mobil|t[ée]l[ée]f|anruf|ruf|llam|appel|whatsapp|\bsms\b|\bcell", re.I),
)
_AGAINST = re.compile(r"version|\bv$|isbn|issn|order|\bid\b|\bref\b|page|\bsha|hash|doi|rfc|chapter|invoice|serial|section|total|\$ ?$|€ ?$|date|time|\bno\b", re.I)


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each "@": its local part is the run before it, back to the previous match at most."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind as listed."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def wide(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all that could be personal data, whatever the base patterns say."""
    out, done = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > max(done, m.start() - 64) and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (host := _HOST.match(text, m.end())):
            done = host.end()
            out.append((start, EMAIL, done))
    out += [(m.start(), IP, m.end()) for form in (_FOUR, _COLONS) for m in form.finditer(text) if _address(m[0])]
    for m in _NUMBER.finditer(text):
        num = digits(m[0])
        if 12 <= len(num) <= 19 and luhn(num):
            out.append((m.start(), CARD, m.end()))
        if 7 <= len(num) <= 15:
            out.append((m.start(), PHONE, m.end()))
    return out


def _address(body: str):
    """The IP address that is written so, or None; leading zeros are taken as such."""
    plain = _plain(body)
    try:
        return ipaddress.ip_address(plain if ":" in plain else ".".join(x.lstrip("0") or "0" for x in plain.split(".")))
    except ValueError:
        return None


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, int, int]]:
    """All different candidates, the base spans among them, in order."""
    return sorted({(s, KINDS.index(k), e) for s, k, e in base} | set(wide(text)))


def _sign(yes: bool) -> int:
    return 1 if yes else -1


def _plain(body: str) -> str:
    for form, mark in _DISGUISE:
        body = form.sub(mark, body)
    return body


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    """Published pattern, grouping, gazetteer, words before for and against, boundary, placeholder: 1 yes, -1 no, 0 nothing."""
    body, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 12]
    num, pattern_, known = digits(body), int(bool(_BASE[kind].fullmatch(body))), 0
    if kind == EMAIL:
        local, _, host = _plain(body).lower().rpartition("@")
        labels = host.split(".")
        good = all(x and x[0] != "-" and x[-1] != "-" for x in labels) and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24
        group, known = _sign(good and "@" not in local and ".." not in local and local[:1] not in (".", "")), _sign(labels[-1] in _ENDINGS or labels[0] in _MAIL_HOSTS)
        real = local not in _NOBODY
    elif kind == IP:
        address, parts = _address(body), [x for x in re.split("[.:]", _plain(body)) if x]
        group = _sign(all(len(x) == 1 or x[0] != "0" for x in parts) if ":" not in body else len(parts) > 2 or "::" in body)
        known = _sign(address is not None and (address.is_global or address.is_private) and not (address.is_multicast or address.is_unspecified))
        real = len(set(parts)) > 1 and (":" in body or not all(len(x) == 1 for x in parts))
    elif kind == CARD:
        group, real = _sign(bool(_CARD_GROUPS.fullmatch(body))), len(set(num)) > 2
        known = _sign(any(len(num) in sizes and low <= int(num[: len(str(low))]) <= high for low, high, sizes in _ISSUERS))
    else:
        abroad = num if body[0] == "+" else num[2:] if body.startswith("00") else ""
        home = num[1:] if len(num) == 11 and num[0] == "1" else num
        group = _sign(bool(_PHONE_GROUPS.fullmatch(body)) and (bool(abroad) or home[0] == "0" or len(home) == 10 and home[0] > "1" and home[3] > "1"))
        if abroad:
            known = _sign(8 <= len(abroad) <= 15 and (bool({abroad[:1], abroad[:2]} & _CODES) or bool(_CODES_OF_THREE.match(abroad))))
        real = len(set(num)) > 3 and num not in "01234567890123456789"
    near, against = int(bool(_NEAR[kind].search(before))), -int(bool(_AGAINST.search(before[-16:])))
    if not near and any(_NEAR[k].search(before[-16:]) for k in range(4) if k != kind):
        against = -1
    left, right = text[start - 1 : start], after[:1]
    broken = left.isalnum() or left in ("/", "_", "-", "=") or right.isalnum() or right in ("/", "_", "=")
    return pattern_, group, known, near, against, -int(broken), -int(not real)


def pattern(text: str, start: int, kind: int, end: int) -> tuple:
    """What the classifier sees: kind, votes, size, and the sort of letter on either side."""
    def sort(c: str) -> int:
        return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3

    return (kind, *votes(text, start, kind, end), min(5, (end - start) // 6), sort(text[start - 1 : start]), sort(text[end : end + 1]))


N_VOTES = 7
#: How often a labeler is taken to have been right and wrong beforehand, and a candidate to be personal data or not.
RIGHT, WRONG, PERSONAL, OTHER = 4.0, 1.0, 2.0, 2.0


def _logit(p):
    return np.log(p) - np.log1p(-p)


def reliabilities(votes_: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for one kind. votes_ [patterns, labelers] in -1..1, count [patterns]; gives the share of personal data, how often
    each labeler is right where it votes, and the posterior of each pattern. Starts from the majority; a labeler is held to
    be right between half of the time and 99 times in a hundred."""
    post, cast = 1 / (1 + np.exp(-1.5 * votes_.sum(1))), (np.abs(votes_) * count[:, None]).sum(0)
    for _ in range(rounds):
        share = ((post * count).sum() + PERSONAL) / (count.sum() + PERSONAL + OTHER)
        right = ((votes_ > 0) * (post * count)[:, None] + (votes_ < 0) * ((1 - post) * count)[:, None]).sum(0)
        right = np.clip((right + RIGHT) / (cast + RIGHT + WRONG), 0.5, 0.99)
        post = 1 / (1 + np.exp(-np.clip(_logit(share) + votes_ @ _logit(right), -50, 50)))
    return float(share), right, post


class SpanModel:
    """Logistic classifier over a pattern's kind, votes by kind, size and neighbours by kind, and what EM has estimated for
    each kind: (share of personal data, how often each labeler is right)."""

    SIZES = (6, 4, 4)

    def __init__(self, bias: np.ndarray, vote: np.ndarray, form: np.ndarray, reliability: dict[str, tuple[float, np.ndarray]]):
        self.bias, self.vote, self.form, self.reliability = bias, vote, form, reliability

    @classmethod
    def _forms(cls, rows: np.ndarray) -> np.ndarray:
        """Numbers of size and neighbours, apart for each kind."""
        return rows[:, 1 + N_VOTES :] + np.cumsum((0, *cls.SIZES[:-1])) + rows[:, :1] * sum(cls.SIZES)

    @classmethod
    def fit(cls, rows: np.ndarray, count: np.ndarray, steps: int = 300, hold: float = 1e-2) -> SpanModel:
        kind, vote, form = rows[:, 0], rows[:, 1 : 1 + N_VOTES].astype(float), cls._forms(rows)
        post, reliability = np.zeros(len(rows)), {}
        bias0, vote0 = np.full(len(KINDS), _logit(PERSONAL / (PERSONAL + OTHER))), np.full((len(KINDS), N_VOTES), _logit(RIGHT / (RIGHT + WRONG)))
        for k, name in enumerate(KINDS):
            if (of := kind == k).any():
                share, right, post[of] = reliabilities(vote[of], count[of])
                reliability[name], bias0[k], vote0[k] = (share, right), _logit(share), _logit(right)
        # Patterns that come again and again count as their root: the classifier is to tell patterns apart, not to repeat the commonest.
        weight = np.sqrt(count) / np.sqrt(count).sum()
        sizes = (len(KINDS), len(KINDS) * N_VOTES, len(KINDS) * sum(cls.SIZES))
        middle = np.concatenate([bias0, vote0.ravel(), np.zeros(sizes[2])])
        p = middle.copy()
        m, v = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, steps + 1):
            b, w, f = np.split(p, np.cumsum(sizes)[:2])
            model = cls(b, w.reshape(len(KINDS), N_VOTES), f, reliability)
            off = (model.probability(rows) - post) * weight
            by_vote = np.zeros((len(KINDS), N_VOTES))
            np.add.at(by_vote, kind, off[:, None] * vote)
            g = np.concatenate([np.bincount(kind, off, sizes[0]), by_vote.ravel(), np.bincount(form.ravel(), np.repeat(off, form.shape[1]), sizes[2])]) + hold * (p - middle)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        b, w, f = np.split(p, np.cumsum(sizes)[:2])
        return cls(b, w.reshape(len(KINDS), N_VOTES), f, reliability)

    def probability(self, rows: np.ndarray) -> np.ndarray:
        kind = rows[:, 0]
        score = self.bias[kind] + (self.vote[kind] * rows[:, 1 : 1 + N_VOTES]).sum(1) + self.form[self._forms(rows)].sum(1)
        return 1 / (1 + np.exp(-score))


def _holding(docs: DataFrame) -> DataFrame:
    """texts(), with an empty text where no candidate can be: such texts needn't reach Python."""
    return texts(docs).withColumn("text", F.when(F.col("text").rlike(MAY_HOLD), F.col("text")).otherwise(F.lit("")))


def train(docs: DataFrame) -> SpanModel | None:
    """None if no text holds a candidate."""

    def make():
        seen: Counter = Counter()

        def f(text):
            for t in text:
                for c in candidates(t, base_spans(t)):
                    seen[",".join(map(str, pattern(t, *c)))] += 1

        f.close = lambda: [[list(seen), list(seen.values())]] if seen else []
        return f

    held = _holding(docs).where("text <> ''").select("text")
    rows = map_columns(held, "pattern string, n long", make).groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not rows:
        return None
    return SpanModel.fit(np.array([list(map(int, r.pattern.split(","))) for r in rows]), np.array([r.n for r in rows], float))


def all_spans(text: str, base: list[tuple[int, str, int]], model: SpanModel | None, keep: float = KEEP) -> list[tuple[int, str, int]]:
    """Base spans and the other candidates that the model takes, in order."""
    taken = ts.Taken([(s, e) for s, _, e in base])
    free = [c for c in wide(text) if taken.free(c[0], c[2])] if text and model else []
    if not free:
        return base
    p = model.probability(np.array([pattern(text, *c) for c in free]))
    out = list(base)
    for (s, k, e), _ in sorted((x for x in zip(free, p, strict=True) if x[1] >= keep), key=lambda x: (-x[1], x[0])):
        if taken.free(s, e):
            taken.add(s, e)
            out.append((s, KINDS[k], e))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: SpanModel | None, keep: float = KEEP) -> DataFrame:
    """One row per document; the counts and the digest are those of the base spans."""

    def make():
        def f(ids, text):
            rows = []
            for t in text:
                base = base_spans(t) if t else []
                n = Counter(k for _, k, _ in base)
                rows.append((*map(n.__getitem__, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(all_spans(t, base, model, keep))))
            return [ids, *map(list, zip(*rows, strict=True))]

        return f

    return map_columns(_holding(docs), SCHEMA, make)


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first's kind."""
    out, done, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def mask(docs: DataFrame, model: SpanModel | None, keep: float = KEEP) -> DataFrame:
    """The same rows and columns in one pass, with personal data masked in text; n_chars, where there is one, is counted anew
    in the rows that were changed."""
    tune(docs.sparkSession)
    arrow, may = to_arrow_schema(docs.schema), re.compile(MAY_HOLD)
    at, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            text = batch.column(at).to_pylist()
            new = [masked(t, all_spans(t, base_spans(t), model, keep)) if t and may.search(t) else t for t in text]
            columns = list(batch.columns)
            columns[at] = pa.array(new, arrow.types[at])
            if n is not None:
                columns[n] = pa.array([c if t == u else len(u) for c, t, u in zip(columns[n].to_pylist(), text, new, strict=True)], arrow.types[n])
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


def weak_supervision(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    return find(docs, train(docs), keep)
