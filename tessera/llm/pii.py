"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and
a span classifier trained on the outcome decides.

Spans of four base kinds are fixed by pattern and checksum and always stay. Looser candidates (of those kinds, and of
accounts, secrets and names) get votes of five labelers: two by pattern, one by gazetteer, two by context. What
leaves the executors is counts only: of vote patterns (at most 3**5 for each kind), for the reliabilities, then
of hashed features weighed by the outcome (at most ``BUCKETS`` for each kind), for the classifier.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import materialize, small_batches, table

KINDS = ["email", "ip", "card", "phone", "account", "secret", "name"]
BASE_KINDS = 4
EMAIL, IP, CARD, PHONE, ACCOUNT, SECRET, NAME = range(7)
LABELERS = 5
NO, YES, ABSTAIN = 0, 1, 2
BUCKETS = 1 << 12
#: Characters on each side that context labelers and features see.
NEAR = 32
#: Probability from which a candidate that isn't a base span is added.
LEAST = 0.5

# Gazetteers: top-level domains, calling codes, card prefixes, key prefixes, titles, given names, cue words.
DOMAINS = set("com org net edu gov info io co uk de fr es it nl at ch be eu us ca au jp cn in br ru pl se no dk fi pt".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "421")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "35", "36", "38")
KEYS = ("sk_", "pk_", "sk-", "ghp_", "gho_", "AKIA", "ASIA", "AIza", "xox", "eyJ", "glpat-")
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Monsieur Madame Sr Sra Don Doña".split()
NAMES = set("James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Anna Peter Hans Klaus Ursula Sabine Jean Marie Pierre Claire José María Juan Carmen Luis Ana Paul Laura Thomas Julia Martin Eva Daniel Sofia".split())
CUES = {
    EMAIL: "mail contact write reach correo courriel", IP: "ip host server address addr from client", CARD: "card visa mastercard credit karte carte tarjeta pay",
    PHONE: "phone tel call fax mobile cell tél telefon teléfono", ACCOUNT: "account iban konto compte cuenta ssn passport id number no", SECRET: "token key secret password passwd api auth bearer", NAME: "name signed dear by author contact",
}
_CUES = {k: re.compile("|".join(map(re.escape, v.split())), re.IGNORECASE) for k, v in CUES.items()}

# Base patterns, each written so that a search is linear however long a run is: where one can't match at the start
# of a run it can't inside it. An address is found at its @ and then extended to the left.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OTHER_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,64}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,64})+")
_OTHER_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{20,}+")
_NAME = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? [^\W\d_][\w'-]{1,40}(?: [^\W\d_][\w'-]{1,40})?")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, end = [], 0
    for m in _AT.finditer(text):
        start = at = m.start()
        while start > end and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            end = m.end()
    return found


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (kind, start, end) by kind, then start; and digit runs that are no card."""
    spans = [(EMAIL, *s) for s in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            spans.append((IP, *m.span()))
    other = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 9:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                spans.append((CARD, *m.span()))
            elif 9 <= len(digits) <= 34:
                other.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                spans.append((PHONE, *m.span()))
    return spans, other


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the other candidates that overlap no base span nor an earlier candidate."""
    base, runs = base_spans(text)
    loose = [(ACCOUNT, *s) for s in runs]
    if "[" in text or "(" in text:
        loose += [(EMAIL, *m.span()) for m in _OTHER_AT.finditer(text)]
    loose += [(PHONE, *m.span()) for m in _OTHER_PHONE.finditer(text)]
    loose += [(SECRET, *m.span()) for m in _SECRET.finditer(text)]
    loose += [(NAME, *m.span()) for m in _NAME.finditer(text)]
    if not loose:
        return base, []
    taken = sorted((s, e) for _, s, e in base)
    kept, order = [], sorted(loose, key=lambda c: (c[1], -c[2], c[0]))
    at, end = 0, 0
    for kind, s, e in order:
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        # spans of different base kinds may overlap each other, so the few that begin before e are looked at
        if s >= end and not any(a < e and s < b for a, b in taken[max(0, at - BASE_KINDS) : at + BASE_KINDS + 1]):
            kept.append((kind, s, e))
            end = e
    return base, sorted(kept)


def votes(text: str, kind: int, s: int, e: int) -> tuple[list[int], list[int]]:
    """Votes of the five labelers on a span, and its hashed features."""
    span, left, right = text[s:e], text[max(0, s - NEAR) : s], text[e : e + NEAR]
    digits = _DIGITS.sub("", span)
    tell = lambda x: YES if x else NO
    if kind == EMAIL:
        last = re.split(r"[^A-Za-z0-9-]", span)[-1]
        shape, sound, known = "@" in span, last.isalpha() and 2 <= len(last) <= 24, last.lower() in DOMAINS
    elif kind == IP:
        shape, sound, known = span.count(".") == 3, not any(p != "0" and p.startswith("0") for p in span.split(".")), not span.startswith(("0.", "255."))
    elif kind in (CARD, ACCOUNT):
        shape, sound, known = 13 <= len(digits) <= 19, luhn(digits), digits.startswith(ISSUERS)
    elif kind == PHONE:
        shape, sound, known = span.startswith("+"), 9 <= len(digits) <= 15, digits.startswith(CALLING) if span.startswith("+") else None
    elif kind == SECRET:
        shape, sound, known = any(c.isalpha() for c in span) and len(digits) >= 3, len(set(span)) >= 10, span.startswith(KEYS) or None
    else:
        words = span.split(" ")[1:]
        shape, sound, known = all(w[:1].isupper() for w in words), len(words) == 2, True if any(w in NAMES for w in words) else None
    whole = not (left[-1:].isalnum() or right[:1].isalnum())
    cue = True if _CUES[kind].search(left) else None
    vote = [ABSTAIN if x is None else tell(x) for x in (shape, sound, known, cue, whole)]
    before, after = left.split()[-1:] or [""], right.split()[:1] or [""]
    look = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", span)))[:24]
    features = (f"l{min(len(span), 40) // 4}", f"b{before[0].lower()}", f"a{after[0].lower()[:8]}", f"k{look}", f"d{10 * len(digits) // max(1, len(span))}", "v" + "".join(map(str, vote)))
    return vote, sorted({zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in features})


def span_list(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_CANDIDATE = T.StructType().add("kind", T.IntegerType()).add("start", T.IntegerType()).add("end", T.IntegerType()).add("base", T.BooleanType()).add("votes", T.IntegerType()).add("features", T.ArrayType(T.IntegerType()))
_ARROW_CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])


def scan(text: str) -> list[dict]:
    base, loose = candidates(text)
    found = []
    for is_base, spans in ((True, base), (False, loose)):
        for kind, s, e in spans:
            vote, features = votes(text, kind, s, e)
            found.append({"kind": kind, "start": s, "end": e, "base": is_base, "votes": sum(v * 3**i for i, v in enumerate(vote)), "features": features})
    return found


@F.arrow_udf(T.ArrayType(_CANDIDATE))
def scan_udf(texts: pa.Array) -> pa.Array:
    return pa.array([scan(t.as_py() or "") for t in texts], pa.list_(_ARROW_CANDIDATE))


def reliabilities(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Probability that a span of each vote pattern is personal data, by expectation-maximisation.

    Each labeler has a rate of YES among true spans and among others; votes are independent given the truth;
    a labeler that abstains says nothing. It begins from the share of YES votes.
    """
    patterns = sorted(counts)
    vote = np.array([[p // 3**i % 3 for i in range(LABELERS)] for p in patterns]).reshape(-1, LABELERS)
    n = np.array([counts[p] for p in patterns], float)
    yes, cast = vote == YES, vote != ABSTAIN
    truth = np.clip((yes.sum(1) + 0.5) / (cast.sum(1) + 1), 0.05, 0.95)
    for _ in range(rounds):
        log = np.zeros((2, len(n)))
        for side, weight in enumerate((n * truth, n * (1 - truth))):
            prior = (weight.sum() + 1) / (n.sum() + 2)
            # a labeler is held to be right more often than not before it has shown itself
            rate = (yes.T @ weight + (3 if side == 0 else 1)) / (cast.T @ weight + 4)
            log[side] = math.log(prior) + yes @ np.log(rate) + (cast & ~yes) @ np.log(1 - rate)
        truth = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
    return dict(zip(patterns, truth.tolist()))


class Classifier:
    """Naive Bayes over hashed features, fitted on soft labels: log odds by kind and feature."""

    def __init__(self, weights: np.ndarray, prior: np.ndarray):
        self.weights, self.prior = weights, prior

    def accepts(self, kind: int, features: list[int]) -> bool:
        odds = self.prior[kind] + float(self.weights[kind, features].sum())
        return odds >= math.log(LEAST / (1 - LEAST))


def train(found: DataFrame) -> Classifier:
    """The classifier from a table of ``found`` candidate arrays. Without candidates it accepts by even odds."""
    spark = found.sparkSession
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    rows = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most 3**LABELERS for each kind
    by_kind: dict[int, dict[int, int]] = {}
    for r in rows:
        by_kind.setdefault(r["kind"], {})[r["votes"]] = r["n"]
    truth = [(k, v, p) for k, counts in by_kind.items() for v, p in reliabilities(counts).items()]
    known = F.broadcast(spark.createDataFrame(truth, "kind int, votes int, truth double"))  # as many rows
    sums = each.join(known, ["kind", "votes"]).select("kind", "truth", F.explode(F.concat("features", F.array(F.lit(-1)))).alias("feature"))
    # in whole millionths, so that the sums don't depend on their order
    part = F.round(F.col("truth") * 1_000_000).cast("long")
    weights, total = np.zeros((len(KINDS), BUCKETS, 2)), np.zeros((len(KINDS), 2))
    for r in sums.groupBy("kind", "feature").agg(F.sum(part).alias("yes"), F.sum(1_000_000 - part).alias("no")).collect():
        (total[r["kind"]] if r["feature"] < 0 else weights[r["kind"], r["feature"]])[:] = r["yes"] / 1e6, r["no"] / 1e6
    smooth = (weights + 0.5) / (total[:, None, :] + 1)
    return Classifier(np.log(smooth[..., 0] / smooth[..., 1]), np.log((total[:, 0] + 1) / (total[:, 1] + 1)))


def decided(found: list[dict], model: Classifier) -> list[tuple[int, int, int]]:
    return sorted((c["kind"], c["start"], c["end"]) for c in found if c["base"] or model.accepts(c["kind"], c["features"]))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are replaced as one, by the first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[kind].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_list, spans`` for each row of ``docs(doc_id, text)``.

    Counts and ``base_list`` are of base spans, ``spans`` of all, as ``kind:start:end`` in code points by kind, then start.
    A null text counts as empty. Repeated rows stay repeated; other columns aren't read; an empty table gives an empty
    result. The classifier is fitted on all candidates of the table.
    """
    small_batches(docs.sparkSession)
    found = materialize(docs.select("doc_id", scan_udf(F.col("text")).alias("found")), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(train(found))  # len(KINDS) * BUCKETS numbers

    @F.arrow_udf(T.StringType())
    def spans(rows: pa.Array) -> pa.Array:
        return pa.array([span_list(decided(r, shared.value)) for r in rows.to_pylist()], pa.string())

    base = F.filter("found", lambda c: c["base"])
    names = F.array(*map(F.lit, KINDS))
    coded = F.transform(base, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string")))
    count = lambda k: F.size(F.filter(base, lambda c: c["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)], F.array_join(coded, ",").alias("base_list"), spans("found").alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each personal span of ``text`` replaced by its kind, and ``n_chars`` counted again if there is one."""
    small_batches(docs.sparkSession)
    found = materialize(docs.select(scan_udf(F.col("text")).alias("found")), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(train(found))  # len(KINDS) * BUCKETS numbers

    @F.arrow_udf(T.StringType())
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None else redact(t, decided(scan(t), shared.value)) for t in texts.to_pylist()], pa.string())

    done = docs.withColumn("text", cleaned("text"))
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def query(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    digest: Column = F.sha2(F.col("base_list").cast("binary"), 256)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest.alias("base_sha256"), "spans")
