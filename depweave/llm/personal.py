"""Personal data spans by weak supervision.

Base spans follow fixed rules (``base_spans``) and always stay. Looser patterns give candidates:
broken or unusual e-mail addresses, addresses, card and phone numbers. Labelers vote on each
candidate and base span: personal, not personal, or no vote.

* rule (regex): the base rule accepts the span;
* check: checksum, part sizes or number of digits are in order, or not;
* shape: grouping of the usual form;
* list (gazetteer): top-level domain, card issuer digit, country code, first address part;
* context: cue words before the span;
* apart: the span stands alone, or touches letters or digits.

Votes are counted per kind and vote pattern over the whole corpus. Expectation-maximisation
over the patterns estimates each labeler's reliability (its vote rates for personal and other
spans, per kind) and each pattern's probability. A logistic classifier, trained on the patterns
with these probabilities as soft labels, decides on the candidates. The number of patterns does
not depend on the corpus, so only a small table reaches the driver.

Defined results: a NULL text is empty and has no spans; repeated rows are judged each by itself;
positions are code points, the end is exclusive; a candidate that overlaps a base span or an
earlier candidate is left out; without candidates there is no classifier and only base spans remain.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from depweave.llm import chars
from depweave.llm.common import tidied

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("rule", "check", "shape", "list", "context", "apart")
NO_VOTE, AGAINST, FOR = 0, 1, 2

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive repeats: the same matches, in linear time on long runs of digits.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
LOOSE_EMAIL = re.compile(r"(?<![\w.])[\w.+-]{1,64} ?(?:\[at\]|\(at\)|＠) ?[\w-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[\w-]{1,63})++")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
GROUPED_CARD = re.compile(r"[0-9]{12,19}|[0-9]{4}(?:([\x20-])[0-9]{4})(?:\1[0-9]{4})\1[0-9]{1,7}")
GROUPED_PHONE = re.compile(r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{3,4}")
CUES = {
    "email": ({"mail", "email", "e-mail", "contact", "write", "correo", "courriel"}, {"token", "key", "user"}),
    "ip": ({"ip", "host", "server", "address", "addr", "from"}, {"version", "release", "section", "chapter"}),
    "card": ({"card", "visa", "mastercard", "amex", "credit", "debit", "account"}, {"isbn", "order", "invoice", "token", "key", "id"}),
    "phone": ({"phone", "tel", "call", "mobile", "fax", "telephone"}, {"isbn", "order", "invoice", "version", "id"}),
}
TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "us", "ca", "au", "jp", "cn", "ru", "br"}
COUNTRY_CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "98"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text):
    return "".join(DIGITS.findall(text))


def _valid(kind, found):
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in found.split("."))
    if kind == "card":
        digits = _digits(found)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(_digits(found)) <= 15
    return True


def _emails(text):
    """Leftmost matches of EMAIL, found from their @ so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            done = found.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def all_matches(text):
    """(start, kind number, end, valid) of every match of the base patterns, ordered."""
    found = [(start, 0, end, True) for start, end in _emails(text)] if "@" in text else []
    if DIGITS.search(text):
        for number, pattern in ((1, IP), (2, CARD), (3, PHONE)):
            found += [(m.start(), number, m.end(), _valid(KINDS[number], m.group())) for m in pattern.finditer(text)]
    found.sort()
    return found


def base_spans(text):
    """(start, kind number, end) of the base spans, by start, then kind."""
    return [(start, kind, end) for start, kind, end, valid in all_matches(text) if valid]


def spans_and_candidates(text):
    """Base spans, and looser spans that overlap none of them nor each other."""
    matches = all_matches(text)
    base = [(start, kind, end) for start, kind, end, valid in matches if valid]
    loose = [(start, kind, end) for start, kind, end, valid in matches if not valid and (kind != 2 or end - start >= 12)]
    if "at" in text or "＠" in text:
        if "(at)" in text or "[at]" in text or "＠" in text:
            loose += [(m.start(), 0, m.end()) for m in LOOSE_EMAIL.finditer(text)]
    if loose or base or DIGITS.search(text):
        loose += [(m.start(), 3, m.end()) for m in LOOSE_PHONE.finditer(text)]
    taken, kept = sorted((start, end) for start, _, end in base), []
    loose.sort(key=lambda s: (s[0], s[1] != 3, s[1]))
    i, reach = 0, 0
    for start, kind, end in loose:
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][1])
            i += 1
        if start >= reach:
            kept.append((start, kind, end))
            reach = max(reach, end)
    return base, kept


def votes(text, start, kind, end, is_base):
    """One vote per labeler."""
    name, found = KINDS[kind], text[start:end]
    digits = _digits(found)
    rule = FOR if is_base else NO_VOTE
    if name == "email":
        domain = re.split(r"@|＠|at[\])]", found)[-1]
        labels = [p for p in re.split(r"[^\w-]+|dot", domain) if p]
        check = FOR if len(labels) >= 2 else AGAINST
        shape = FOR if labels and labels[-1].isalpha() and 2 <= len(labels[-1]) <= 24 else AGAINST
        listed = FOR if labels and labels[-1].lower() in TOP_DOMAINS else NO_VOTE
    elif name == "ip":
        check = FOR if _valid("ip", found) else AGAINST
        shape = FOR if all(len(p) <= 3 and (p == "0" or p[0] != "0") for p in found.split(".")) else AGAINST
        listed = FOR if 1 <= int(found.split(".")[0][:9]) <= 254 else AGAINST
    elif name == "card":
        check = FOR if 12 <= len(digits) <= 19 and luhn(digits) else AGAINST
        shape = FOR if GROUPED_CARD.fullmatch(found) and 13 <= len(digits) <= 19 else AGAINST
        listed = FOR if digits[0] in "3456" else NO_VOTE
    else:
        check = FOR if 9 <= len(digits) <= 15 else AGAINST
        shape = FOR if GROUPED_PHONE.fullmatch(found) else AGAINST
        listed = FOR if found[0] == "+" and any(digits[:n] in COUNTRY_CODES for n in (1, 2)) else NO_VOTE
    before = text[max(0, start - 40) : start].lower().split()[-3:]
    good, bad = CUES[name]
    cues = {w.strip(".,:;()#") for w in before}
    context = FOR if cues & good else AGAINST if cues & bad else NO_VOTE
    edges = text[start - 1 : start] + text[end : end + 1]
    apart = AGAINST if any(c.isalnum() or c in '"_@' for c in edges) else FOR
    return rule, check, shape, listed, context, apart


def _size(kind, start, end):
    return min((end - start) // 4, 7)


def _patterns(batches):
    counts = {}
    for batch in batches:
        for _, texts in chars.column_slabs(batch.column("text")):
            for text in filter(None, texts):
                base, loose = spans_and_candidates(text)
                for group, is_base in ((base, True), (loose, False)):
                    for start, kind, end in group:
                        key = (kind, *votes(text, start, kind, end, is_base), _size(kind, start, end))
                        counts[key] = counts.get(key, 0) + 1
    columns = np.array(list(counts), dtype=np.int32).reshape(-1, 2 + len(LABELERS))
    yield pa.record_batch(
        {"pattern": pa.FixedSizeListArray.from_arrays(pa.array(columns.ravel()), columns.shape[1]).cast(pa.list_(pa.int32())), "n": pa.array(list(counts.values()), pa.int64())}
    )


def _parts(batches, text):
    """Slices of the batches with their texts, so that a batch's texts and results are never held at once."""
    for batch in batches:
        for first, texts in chars.column_slabs(batch.column(text)):
            yield batch.slice(first, len(texts)), texts


class SpanClassifier:
    """Labeler reliabilities and the classifier trained on what they say together."""

    def __init__(self, patterns, counts, rounds=60):
        patterns = np.asarray(patterns, dtype=int).reshape(-1, 2 + len(LABELERS))
        self.weights, self.reliability = None, {}
        if not len(patterns):
            return
        counts = np.asarray(counts, dtype=float)
        said = patterns[:, 1:-1]
        truth = np.zeros(len(patterns))
        for kind in range(len(KINDS)):
            rows = patterns[:, 0] == kind
            if rows.any():
                truth[rows], self.reliability[KINDS[kind]] = reliabilities(said[rows], counts[rows], rounds)
        self.weights = self._train(self._rows(patterns), truth, counts)

    @staticmethod
    def _rows(patterns):
        """Kind, vote and size indicators, votes also within each kind."""
        kinds = np.eye(len(KINDS))[patterns[:, 0]]
        cast = np.concatenate([(patterns[:, 1:-1] == v).astype(float) for v in (AGAINST, FOR)], axis=1)
        within = (kinds[:, :, None] * cast[:, None, :]).reshape(len(patterns), -1)
        return np.concatenate([kinds, cast, within, np.eye(8)[patterns[:, -1]]], axis=1)

    @staticmethod
    def _train(rows, truth, counts, ridge=1.0):
        weights = np.zeros(rows.shape[1])
        for _ in range(50):
            chance = 1 / (1 + np.exp(-np.clip(rows @ weights, -30, 30)))
            slope = rows.T @ (counts * (truth - chance)) - ridge * weights
            curve = (rows * (counts * chance * (1 - chance))[:, None]).T @ rows + ridge * np.eye(len(weights))
            step = np.linalg.solve(curve, slope)
            weights += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        return weights

    def accepts(self, patterns):
        if self.weights is None:
            return np.zeros(len(patterns), dtype=bool)
        return self._rows(np.asarray(patterns, dtype=int)) @ self.weights >= 0


def reliabilities(said, counts, rounds=60):
    """Probability of each vote pattern, and the vote rates of each labeler for both classes.

    Starts from the majority vote. Rates are smoothed, and a labeler's vote for a span is never
    taken as a sign against it, so the two classes keep their meaning.
    """
    for_, against = (said == FOR).sum(axis=1), (said == AGAINST).sum(axis=1)
    truth = (for_ + 0.5) / (for_ + against + 1)
    for _ in range(rounds):
        prior = np.clip((counts * truth).sum() / counts.sum(), 0.01, 0.99)
        logs, rates = np.log(prior / (1 - prior)), {}
        odds = np.full(len(said), logs)
        for j, name in enumerate(LABELERS):
            seen = np.stack([[(counts * w * (said[:, j] == v)).sum() + 1 for v in (NO_VOTE, AGAINST, FOR)] for w in (1 - truth, truth)])
            seen /= seen.sum(axis=1, keepdims=True)
            shift = np.log(seen[1] / seen[0])
            shift[FOR], shift[AGAINST] = max(shift[FOR], 0), min(shift[AGAINST], 0)
            odds += shift[said[:, j]]
            rates[name] = seen.tolist()
        truth = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return truth, rates


def learn(docs):
    """Count the vote patterns of all texts and train the classifier."""
    counted = docs.select("text").mapInArrow(tidied(_patterns), "pattern array<int>, n long")
    table = counted.groupBy("pattern").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    table.sort(key=lambda r: r["pattern"])
    return SpanClassifier([r["pattern"] for r in table], [r["n"] for r in table])


def accepted_spans(text, model):
    """(base spans, all spans) of one text."""
    base, loose = spans_and_candidates(text)
    if loose:
        seen = [(kind, *votes(text, start, kind, end, False), _size(kind, start, end)) for start, kind, end in loose]
        loose = [span for span, ok in zip(loose, model.accepts(seen)) if ok]
    return base, sorted(base + loose)


def spelled(spans):
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find(docs, model, keep=("doc_id",)):
    """Columns ``keep``, counts of base spans by kind, base_sha256 and spans (all spans, spelled)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(batches):
        for part, texts in _parts(batches, "_whole"):
            both = [accepted_spans(t, shared.value) if t else ([], []) for t in texts]
            out = {name: part.column(name) for name in keep}
            for number, name in enumerate(KINDS):
                out[f"n_{name}"] = pa.array([sum(k == number for _, k, _ in base) for base, _ in both], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(spelled(base).encode()).hexdigest() for base, _ in both])
            out["spans"] = pa.array([spelled(spans) for _, spans in both])
            yield pa.record_batch(out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    numbers = ", ".join(f"n_{name} long" for name in KINDS)
    return docs.select(*keep, F.col("text").alias("_whole")).mapInArrow(tidied(found), f"{kinds}, {numbers}, base_sha256 string, spans string")


def mask(docs, model):
    """``docs`` with every span replaced by its kind in brackets; n_chars follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def masked(batches):
        for part, whole in _parts(batches, "text"):
            texts = []
            for text in whole:
                parts, done = [], 0
                for start, kind, end in accepted_spans(text, shared.value)[1] if text else ():
                    if start >= done:
                        parts += [text[done:start], f"[{KINDS[kind]}]"]
                    done = max(done, end)
                texts.append("".join([*parts, text[done:]]) if parts else text)
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, part.schema.field("text").type))

    out = docs.mapInArrow(tidied(masked), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
