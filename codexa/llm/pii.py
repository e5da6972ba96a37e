"""Personal data and secrets by weak supervision: labelers vote on spans, a classifier learns from what they agree on.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; their
spans always stay. Wider patterns propose further spans: spelled-out addresses,
national phone numbers, cards of other lengths, IPv6, bank accounts, social
security numbers, keys and tokens. They are wide on purpose, so that they meet
order numbers, versions and checksums as well.

1.  On every span six labelers vote for or against or abstain: a strict regex, a
    checksum, a gazetteer (top-level domains, calling codes, card issuers, bank
    countries), the words around it for each kind, its shape and its neighbours.
2.  Only counts of (kind, votes) leave the executors, a bounded number whatever
    the corpus; expectation-maximisation on them estimates each labeler's
    reliability and each kind's share of personal data.
3.  A logistic regression over the span's own characters, the words around it
    and the votes is trained on the probabilities of a bounded sample of spans
    (SAMPLE for each kind and votes, by hash) and decides on all proposed ones.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexa.llm.common import part, pieces, settle

# The base patterns. Local parts are found from their @, numbers from the first digit of a run,
# which gives the same matches in time that grows with the text only.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Order of kinds in a list of spans; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")

# Wider patterns, by kind; each stands alone between characters that are no part of a word. All repeats are bounded.
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\}|<at>| at )", r"(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot |\.)"
WIDE = {
    "email": re.compile(rf"(?<![\w.+@-])[\w.+-]{{1,64}} ?{_AT} ?[\w-]{{1,63}}(?: ?{_DOT} ?[A-Za-z]{{2,20}}){{1,4}}(?!\w)", re.I),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),
    "card": re.compile(r"(?<![\w.+-])[0-9]{4}(?:[ -]?[0-9]{2,6}){2,4}(?![\w-]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![\w-]|\.[0-9])"),
    "ssn": re.compile(r"(?<![\w.+-])[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}(?![\w-]|\.[0-9])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "secret": re.compile(r"(?<![\w+/-])[A-Za-z0-9_+/-]{16,512}={0,2}(?![\w+/=-])"),
}
# Gazetteers.
DOMAINS = frozenset("com org net edu gov mil int info biz io co me de fr es it nl uk us eu ch at be pl se no fi dk pt gr cz ru cn jp in br mx ca au nz za example test".split())
ISSUERS = {"4": (13, 16, 19), "34": (15,), "37": (15,), "36": (14,), "38": (14,), "30": (14,), "5": (16,), "2": (16,), "35": (16,), "60": (16,), "62": (16, 17, 18, 19), "64": (16,), "65": (16,)}
ACCOUNTS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15,
    "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
PREFIXES = ("ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "glpat-", "sk_live_", "sk-", "eyJ", "ya29")
STRICT = {
    "email": re.compile(r"[\w.+-]+ ?[(\[{]at[)\]}] ?.*|[\w.+-]+ at [\w-]+ dot [a-z]+( dot [a-z]+)*", re.I),
    "ip": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=.*[0-9]).*::.*"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}([ .-]))[0-9]{3}[ .-][0-9]{4}|\(?0[0-9]{1,4}\)?[ /-][0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}|0[1-9](?:[ .][0-9]{2}){4}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?|[A-Z]{2}[0-9A-Z]{13,32}"),
    "secret": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|[A-Za-z0-9_+/-]{24,512}={0,2})"),
}
# Words near a span that speak for and against personal data, by kind; `any` for all.
FOR = {
    "email": "mail email e-mail contact write reach address sender",
    "ip": "ip ipv6 host server client login address gateway peer connection connected",
    "card": "card visa mastercard amex credit debit pay payment cvv expires charged",
    "phone": "phone tel telephone telefon téléphone teléfono mobile cell call fax whatsapp ring dial text sms hotline",
    "ssn": "ssn social security taxpayer",
    "iban": "iban account bank konto compte cuenta transfer wire bic swift",
    "secret": "token secret password passwd pwd key apikey api_key access_token auth authorization bearer credential credentials private",
}
AGAINST = {
    "any": "version release isbn issn doi order invoice sku part model serial page line figure table section chapter score ratio total price ticket tracking reference nr number build revision",
    "email": "meet met arrive arrived sit stood",
    "ip": "time mac genesis verse",
    "card": "timestamp id account iban",
    "phone": "date years since between result results",
    "ssn": "date phone",
    "iban": "plate",
    "secret": "commit checksum sha sha1 sha256 md5 digest integrity revision hash etag uuid guid file path url image class function",
}
_FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
_AGAINST = {k: frozenset(f"{v} {AGAINST['any']}".split()) for k, v in AGAINST.items() if k != "any"}
_WORD = re.compile(r"[\w-]+")
#: Characters read before and after a span.
CONTEXT = 40
LABELERS = ("regex", "checksum", "gazetteer", "context", "shape", "neighbours")
#: What is believed of the labelers' accuracy before any span is seen.
ACCURACY = (0.8, 0.995, 0.85, 0.9, 0.75, 0.7)
#: Weight of that belief: so many spans and this share of all, by labeler. What a checksum says is arithmetic, and hardly moves.
BELIEF = (4.0, np.array([0.1, 2.0, 0.1, 0.2, 0.1, 0.1]))
#: Spans of each kind and votes that the classifier is trained on, at most, and the size of its table of features.
SAMPLE, HASHED = 64, 4096


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Base addresses: each @ with the local characters before it, back to the last match, and a domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns by kind and start, in code points."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := part_.lstrip("0") or "0") <= 3 and int(p) <= 255 for part_ in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def wide_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the wider patterns that meet no taken one nor each other, by kind and start."""
    out: list[tuple[str, int, int]] = []
    held: list[list[int]] = []  # what is taken, as stretches that do not overlap
    for _, a, b in sorted(taken, key=lambda s: s[1:]):
        if held and a < held[-1][1]:
            held[-1][1] = max(held[-1][1], b)
        else:
            held.append([a, b])
    low = text.casefold()
    for kind in ("email", "ip", "iban", "card", "ssn", "phone", "secret"):
        if kind == "email":
            if not any(x in low for x in ("at)", "at]", "at}", "at>", " dot ")):
                continue
        elif not DIGIT.search(text) or (kind == "ip" and ":" not in text):
            continue
        fresh = []
        for m in WIDE[kind].finditer(text):
            a, b = m.span()
            if kind == "email" and "dot" not in m[0].casefold() and not any(c + "at" in m[0].casefold() for c in "([{<"):
                continue  # " at " in a sentence alone is no address
            if kind == "ip" and m[0].count(":") < 3 and "::" not in m[0]:
                continue
            if kind in ("card", "phone") and not (13 if kind == "card" else 8) <= len(digits_of(m[0])) <= (19 if kind == "card" else 15):
                continue
            if kind == "secret" and not (DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0])):
                continue
            i = bisect.bisect_left(held, [b])
            if not i or held[i - 1][1] <= a:
                fresh.append((kind, a, b))
        out += fresh
        held = sorted([*held, *([a, b] for _, a, b in fresh)]) if fresh else held
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _checksum(kind: str, value: str) -> int:
    if kind == "card":
        return 1 if luhn(digits_of(value)) else -1
    if kind == "iban":
        plain = value.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    if kind == "ip" and ":" in value:
        try:
            ipaddress.ip_address(value)
            return 1
        except ValueError:
            return -1
    return 0


def _gazetteer(kind: str, value: str) -> int:
    digits = digits_of(value)
    if kind == "email":
        return 1 if re.split(r"[^A-Za-z]+", value)[-1].lower() in DOMAINS else -1
    if kind == "card":
        return 1 if any(digits.startswith(p) and len(digits) in sizes for p, sizes in ISSUERS.items()) else -1
    if kind == "phone":
        return 0 if value[0] in "+(" else 1 if digits[0] == "0" and digits[1:2] != "0" else -1 if len(digits) == 10 and digits[0] == "1" else 0
    if kind == "ssn":
        return -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 0
    if kind == "iban":
        return 1 if ACCOUNTS.get(value[:2]) == len(value.replace(" ", "")) else -1
    if kind == "ip" and ":" not in value:
        return -1 if digits.startswith("0") or value.startswith(("127.", "255.")) else 1
    if kind == "secret":
        return 1 if value.startswith(PREFIXES) else 0
    return 0


def _entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _shape(kind: str, value: str) -> int:
    """Whether the characters look drawn, not written or counted."""
    digits = digits_of(value)
    if kind in ("card", "phone", "ssn"):
        steps = {(int(b) - int(a)) % 10 for a, b in zip(digits, digits[1:], strict=False)}
        if len(steps) < 2 or len(set(digits)) < 3:
            return -1
        return 0 if kind == "phone" and re.fullmatch(r"(?:19|20)[0-9]{2}[ ./-].*", value) else 1
    if kind == "secret":
        if re.search(r"[A-Za-z]{12}|/.*/|-.*-.*-|__", value) or _entropy(value) < 3:
            return -1  # words, a path, a uuid or a name
        return 1 if len(re.findall("[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]|[A-Z][a-z]", value)) * 6 >= len(value) else -1
    return 0


def votes(kind: str, text: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes on a span: 1 personal, -1 not, 0 abstains."""
    value, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    near = [w.lower() for w in _WORD.findall(before)][-3:]
    near += [w.lower() for w in _WORD.findall(after)][:1]
    said = len(_FOR[kind].intersection(near)) - len(_AGAINST[kind].intersection(near))
    context = (said > 0) - (said < 0)
    glued = (before[-1:].isalnum() or after[:1].isalnum()) or before.endswith(tuple("#$€£/\\"))
    assigned = kind == "secret" and re.search(r"[:=]\s*[\"']?$", before)
    neighbours = -1 if glued else 1 if assigned or before.rstrip().endswith(":") else 0
    strict = 1 if base or STRICT[kind].fullmatch(value) else -1
    return (strict, _checksum(kind, value), _gazetteer(kind, value), context, _shape(kind, value), neighbours)


SPAN = "struct<kind:string,start:int,stop:int,base:boolean,votes:string,features:array<int>>"


def _slot(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode()) % HASHED


def features(kind: str, text: str, start: int, end: int, voted: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: its kind, length and shape, the words and characters around it, the votes."""
    value, before, after = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]", "9", value[:48])))
    short = re.sub(r"(.)\1+", r"\1", shape)
    own = [("kind",), ("size", str(min(64, end - start))), ("shape", shape), ("short", short), ("first", value[:1]), ("last", value[-3:].lower() if kind == "email" else "")]
    own += [("left", before[-1:]), ("right", after[:1])]
    own += [("before", w.lower()) for w in _WORD.findall(before)[-3:]] + [("after", w.lower()) for w in _WORD.findall(after)[:2]]
    own += [(name, str(v)) for name, v in zip(LABELERS, voted, strict=True) if v]
    return sorted({_slot(kind, *x) for x in own} | {_slot(name, str(v)) for name, v in zip(LABELERS, voted, strict=True) if v})


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])
    for batch in pieces(batches, "text"):
        found = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            own = []
            for k, a, b, x in [(*s, True) for s in base] + [(*s, False) for s in wide_spans(text, base)]:
                voted = votes(k, text, a, b, x)
                own.append({"kind": k, "start": a, "stop": b, "base": x, "votes": ",".join(map(str, voted)), "features": features(k, text, a, b, voted)})
            found.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"])


def candidates(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, spans): base and proposed spans with votes and features; null texts have none."""
    return docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<{SPAN}>")


def reliabilities(seen: list[tuple[str, tuple[int, ...], int]], rounds: int = 200) -> tuple[dict[str, float], np.ndarray]:
    """(kind, votes, count) of all spans -> each kind's share of personal data; P(votes for | votes) of each labeler, given not and given personal.

    Expectation-maximisation, by kind only in the share; to abstain says nothing. The belief holds
    the labelers' meaning where a corpus has few spans or none of one sort.
    """
    belief = np.array([[1 - a, a] for a in ACCURACY])  # P(vote for | not), P(vote for | personal)
    share = dict.fromkeys(KINDS, 0.5)
    if not seen:
        return share, belief
    counts = np.array([n for _, _, n in seen], float)
    cast = np.array([v for _, v, _ in seen])
    strength = BELIEF[0] + BELIEF[1] * counts.sum()
    rate = belief.copy()
    for _ in range(rounds):
        p = _posterior([k for k, _, _ in seen], cast, share, rate)
        new = np.empty_like(rate)
        for side, weight in ((0, counts * (1 - p)), (1, counts * p)):
            ayes = (weight[:, None] * (cast > 0)).sum(axis=0) + strength * belief[:, side]
            new[:, side] = ayes / ((weight[:, None] * (cast != 0)).sum(axis=0) + strength)
        for kind in KINDS:
            own = np.array([k == kind for k, _, _ in seen])
            share[kind] = float(((counts * p)[own].sum() + 2) / (counts[own].sum() + 4))
        moved = np.abs(new - rate).max()
        rate = new
        if moved < 1e-9:
            break
    return share, rate


def _posterior(kinds: list[str], cast: np.ndarray, share: dict[str, float], rate: np.ndarray) -> np.ndarray:
    logs = np.log(rate), np.log(1 - rate)
    odds = np.where(cast > 0, logs[0][:, 1] - logs[0][:, 0], 0) + np.where(cast < 0, logs[1][:, 1] - logs[1][:, 0], 0)
    prior = np.array([math.log(share[k] / (1 - share[k])) for k in kinds])
    return 1 / (1 + np.exp(-np.clip(prior + odds.sum(axis=1), -30, 30)))


def train(seen: list[tuple[str, tuple[int, ...], int]], sample: list[tuple[str, tuple[int, ...], list[int]]], rounds: int = 300) -> np.ndarray:
    """Counts of (kind, votes) over all spans, and (kind, votes, features) of some -> weights of the features, the bias last.

    A sampled span stands for its share of the spans of its kind and votes; it counts by the logarithm,
    so that a common pattern does not drown the rest. The target is the probability that the estimated
    reliabilities give.
    """
    weights = np.zeros(HASHED + 1)
    if not sample:
        return weights
    share, rate = reliabilities(seen)
    y = _posterior([k for k, _, _ in sample], np.array([v for _, v, _ in sample]), share, rate)
    total = {(k, v): n for k, v, n in seen}
    held = Counter((k, v) for k, v, _ in sample)
    w = np.array([math.log1p(total.get((k, v), 1)) / held[k, v] for k, v, _ in sample])
    w /= w.sum()
    owner = np.repeat(np.arange(len(sample)), [len(f) for _, _, f in sample])
    flat = np.concatenate([np.array(f, np.int64) for _, _, f in sample])
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        p = _probability(weights, flat, owner, len(sample))
        pull = w * (p - y)
        gradient = np.append(np.bincount(flat, weights=pull[owner], minlength=HASHED), pull.sum()) + 1e-5 * weights
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        weights = weights - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return weights


def _probability(weights: np.ndarray, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    z = np.bincount(owner, weights=weights[flat], minlength=n) + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def chance(weights: np.ndarray, own: list[int]) -> float:
    """The classifier's probability that a span with these features is personal."""
    return float(_probability(weights, np.array(own, np.int64), np.zeros(len(own), np.int64), 1)[0])


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _finish(batches: Iterator[pa.RecordBatch], weights: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for spans in batch.column("spans").to_pylist():
            base = [(s["kind"], s["start"], s["stop"]) for s in spans if s["base"]]
            more = [(s["kind"], s["start"], s["stop"]) for s in spans if not s["base"] and chance(weights, s["features"]) >= least]
            counts = (sum(k == kind for k, _, _ in base) for kind in KINDS[:4])
            rows.append((*counts, hashlib.sha256(_line(base).encode()).hexdigest(), _line(base + more), len(more), len(base) + len(more)))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"],
        )


def personal_data(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans), a row for each input row.

    The counts and base_sha256 are of base spans; spans has these and the added ones as kind:start:stop,
    by kind and start, in code points. Null and empty texts have none; repeated rows each have their own;
    no rows give no rows. The driver gets counts of (kind, votes), at most 7 times 3 to the 6th, and the
    features of at most `sample` spans of each; every proposed span of all documents is judged.
    """
    found = settle(candidates(docs))
    spans = found.select(F.explode("spans").alias("s")).select("s.*")
    counts = spans.groupBy("kind", "votes").count().collect()
    cast = lambda line: tuple(map(int, line.split(",")))
    seen = sorted((r["kind"], cast(r["votes"]), r["count"]) for r in counts)
    total = {(r["kind"], r["votes"]): r["count"] for r in counts}
    rows = []
    if total:
        # a hash of the features thins common patterns out before any are ranked; spans of equal features count once
        every = F.create_map(*[F.lit(x) for (k, v), n in sorted(total.items()) for x in (f"{k} {v}", max(1, n // (4 * sample)))])
        marked = spans.select("kind", "votes", "features", F.xxhash64("features").alias("hash"))
        thin = marked.where(F.pmod("hash", every[F.concat_ws(" ", "kind", "votes")]) == 0).dropDuplicates(["kind", "votes", "features"])
        rank = F.row_number().over(Window.partitionBy("kind", "votes").orderBy("hash", "features"))
        rows = thin.withColumn("rank", rank).where(F.col("rank") <= sample).select("kind", "votes", "features").collect()
    weights = train(seen, sorted((r["kind"], cast(r["votes"]), list(r["features"])) for r in rows))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return found.mapInArrow(part(_finish, weights=weights, least=least), schema)


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            cuts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in (spans or "").split(",") if s))
            at, parts = 0, []
            for a, b, k in cuts:
                if a >= at:
                    parts += [text[at:a], f"<{k}>"]
                at = max(at, b)
            out.append(None if text is None else "".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) -> (doc_id, text) with each span replaced by <kind>; of overlapping ones the first shows."""
    return docs.select("doc_id", "text", "spans").mapInArrow(_mask, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data and secrets in every document."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
