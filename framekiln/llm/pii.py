"""Personal data: generators propose spans, boosted trees weigh them, calibrated thresholds select.

Base spans follow exact patterns (e-mail, IP address, card number, phone number) with their
checks, and always stay. Wider generators propose further spans that overlap each other and the
base: addresses spelt with "at" and "dot", phone numbers without a plus sign, numbers with other
separators. Trees tell personal data in such forms from what only looks like it. Their positive examples are the base spans and
*variants* of them, rewritten where they stand as people write them (sign dropped, separators changed, spelt
out) and found again by the generators; negative examples are all other candidates, such as card-like
numbers with a wrong check digit (but for addresses and card numbers in other forms that pass the checks, which may be
right). Features are format, context and checksum.

Every second form of a kind, and half of the negative examples, are kept from the trees to calibrate their scores by kind:
the threshold is the lowest score from which at least ``PRECISION`` of the kept candidates of the kind
were right, also of the ``SUPPORT`` lowest ones alone, and one half at least, if each form were as frequent as the base; a kind with fewer than ``SUPPORT`` of them adds none. Of
overlapping candidates the best is selected, and none that overlaps a base span.

Trees and thresholds come from all examples of all rows. Features are binned at quantiles of their values, rounded
down to eight significant bits, and equal binned examples are one row with a number. Up to ``HELD`` such rows are fitted on the driver; of
more, each level of a tree is a sum of histograms over their table, in whole numbers, so both give the same
trees. Thresholds come from counts per kind and score, in steps of 1 / ``SCORES``. The fit reads tables of examples without texts, and
selection reads all whole texts in one pass without a shuffle. All patterns take linear time.

Cases: null and empty texts have no spans; a null ``doc_id`` is returned as it is; repeated rows get
equal spans; without candidates nothing is added; places count code points, and bytes that are not
UTF-8 count as replacement characters.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framekiln.llm.boosting import BINS, Trees
from framekiln.llm.common import chunks, texts_of
from framekiln.session import written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
SUPPORT = 20
HELD = 1 << 18
SCORES = 1 << 16

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of the pattern without the look-behind can't begin inside a run of digits either.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

_WIDE_MAIL = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64}(?: ?(?:@|\(at\)|\[at\]|<at>) ?| at )[\w-]{1,63}(?:(?: ?(?:\.|\(dot\)|\[dot\]|<dot>) ?| dot )[\w-]{2,63}){1,4}",
    re.IGNORECASE,
)
_WIDE_NUMBER = re.compile(r"(?<![0-9])\+?\(?[0-9](?:[ ().\-/:]{0,2}[0-9]){6,40}(?![0-9])")
_WORD = re.compile(r"\w+")
# Words that go with personal data, in a few languages.
_CUES = {
    "email": frozenset("mail email e-mail address adresse correo contact write".split()),
    "ip": frozenset("ip host server address adresse from login client".split()),
    "card": frozenset("card visa mastercard credit karte carte tarjeta payment number".split()),
    "phone": frozenset("phone tel telephone call mobile fax telefon téléphone teléfono ring".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact patterns, by start and then kind."""
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of everything that might be personal data; spans may overlap."""
    out = set()
    low = text.lower()
    if "@" in text or " at " in low or "at)" in low or "at]" in low or "at>" in low:
        out.update((m.start(), 0, m.end()) for m in _WIDE_MAIL.finditer(text))
    if _DIGIT.search(text):
        for m in _WIDE_NUMBER.finditer(text):
            digits = len(_DIGIT.findall(m[0]))
            if m[0].count(".") >= 3:
                out.add((m.start(), 1, m.end()))
            if 13 <= digits <= 19:
                out.add((m.start(), 2, m.end()))
            if 8 <= digits <= 15:
                out.add((m.start(), 3, m.end()))
    return sorted(out)


_PAIRS = re.compile(r"[0-9]{2,4}")


def variants(kind: int, own: str) -> list[str]:
    """Other ways to write a base span, none of which matches its exact pattern."""
    if kind == 0:
        name, _, domain = own.partition("@")
        dotted = domain.split(".")
        return [
            f"{name} at {' dot '.join(dotted)}",
            f"{name}(at){'(dot)'.join(dotted)}",
            f"{name} [at] {' [dot] '.join(dotted)}",
            f"{name} @ {'.'.join(dotted)}",
            f"{name}[at]{domain}",
            f"{name} at {domain}",
        ]
    digits = "".join(_DIGIT.findall(own))
    if kind == 1:
        return [own.replace(".", x) for x in (". ", " .")]
    if kind == 2:
        fours = _PAIRS.findall(" ".join(digits[i : i + 4] for i in range(0, len(digits), 4)))
        return [x.join(fours) for x in (".", "/", ". ", ":", "--", "  ")]
    bare = own.lstrip("+")
    groups = re.findall(r"[0-9]+", bare)
    return [bare, *(x.join(groups) for x in ("-", ".", " ", "/")), "00" + bare, "".join(groups)]


def _kind_of_char(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?" else 5


def described(text: str, span: tuple[int, int, int]) -> list[float]:
    """Format, context and checksum of a candidate."""
    start, kind, end = span
    own = text[start:end].lstrip("+")
    groups_text = re.findall(r"[0-9]+", own)
    groups = [len(g) for g in groups_text]
    separators = re.findall(r"[^0-9A-Za-z]+", own)
    before, after = text[max(0, start - 48) : start], text[end : end + 48]
    near = _WORD.findall(before.lower())[-4:]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        float(len(own)),
        float(sum(groups)),
        float(len(groups)),
        float(max(groups, default=0)),
        float(min(groups, default=0)),
        float(groups[0] if groups else 0),
        float(groups[-1] if groups else 0),
        float(sum(c.isalpha() for c in own)),
        float(len(separators)),
        float(len(set(separators))),
        float(own.count(".")),
        float(own.count("-")),
        float(own.count(" ")),
        float(own.count("@")),
        float("(" in own),
        float(int(groups_text[0][0]) if groups_text else -1),
        float(_kind_of_char(text, start - 1)),
        float(_kind_of_char(text, end)),
        float(sum(c.isdigit() for c in before)),
        float(sum(c.isdigit() for c in after)),
        float(len(near[-1]) if near else 0),
        float(any(w in _CUES[KINDS[kind]] for w in near)),
        float("=" in before[-4:]),
        float(kind == 2 and luhn("".join(groups_text))),
        float(max((int(g[:4]) for g in groups_text), default=0) <= 255),
        float(" at " in own.lower() or " dot " in own.lower()),
        float(bool(re.search(r"[.] [A-Z]", own))),
    ]


def _passes(kind: int, own: str) -> bool:
    """Whether the digits of a candidate are an IP address or a card number, whatever stands between them."""
    groups = re.findall(r"[0-9]+", own)
    if kind == 1:
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    digits = "".join(groups)
    return kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)


def made_examples(text: str, span: tuple[int, int, int]) -> Iterator[tuple[int, int, bool, list[float]]]:
    """(form, kind, right, features) of the candidates that the generators find over each variant of a base span."""
    start, kind, end = span
    before, after = text[max(0, start - 64) : start], text[end : end + 64]
    for form, variant in enumerate(variants(kind, text[start:end])):
        whole = before + variant + after
        low, high = len(before), len(before) + len(variant)
        for s, k, e in candidates(whole):
            if s < high and low < e:
                # A sign before the number or a full stop after it may belong to the candidate.
                yield form, k, k == kind and s >= low - 1 and e <= high + 1 and s <= low + 3 and e >= high - 1, described(whole, (s, k, e))


_SPAN = "struct<start:int,kind:int,end:int>"
_EXAMPLE = "struct<form:int,kind:int,right:boolean,x:array<float>>"
_FOUND = f"base array<{_SPAN}>, wide array<struct<start:int,kind:int,end:int,x:array<float>>>, examples array<{_EXAMPLE}>"


def _wide(text: str, exact: list[tuple[int, int, int]]) -> list[dict]:
    """Candidates other than the base spans, with features."""
    own = set(exact)
    return [{"start": s, "kind": k, "end": e, "x": described(text, (s, k, e))} for s, k, e in candidates(text) if (s, k, e) not in own]


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, wide, examples) of every row: exact spans, other candidates with features, and examples to learn from."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    wide = pa.struct([*span, pa.field("x", pa.list_(pa.float32()))])
    example = pa.struct([("form", pa.int32()), ("kind", pa.int32()), ("right", pa.bool_()), ("x", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            base, more, examples = [], [], []
            for raw in texts:
                text = raw.decode("utf-8", "replace")
                exact = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in exact])
                more.append(_wide(text, exact))
                own = [{"form": -1, "kind": x["kind"], "right": False, "x": x["x"]} for x in more[-1] if not _passes(x["kind"], text[x["start"] : x["end"]])]
                for s, k, e in exact:
                    own.append({"form": -1, "kind": k, "right": True, "x": described(text, (s, k, e))})
                    own += [{"form": f, "kind": c, "right": r, "x": x} for f, c, r, x in made_examples(text, (s, k, e))]
                examples.append(own)
            columns = {"base": pa.array(base, pa.list_(span)), "wide": pa.array(more, pa.list_(wide)), "examples": pa.array(examples, pa.list_(example))}
            yield pa.record_batch({"doc_id": rows.column("doc_id"), **columns})

    picked = texts_of(docs)
    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, {_FOUND}")


class Selector:
    """Trees and the threshold of each kind; without trees nothing is added."""

    def __init__(self, trees: Trees | None = None, least: list[float] | None = None) -> None:
        self.trees, self.least = trees, least

    def __call__(self, base: list, wide: list) -> list[tuple[int, int, int]]:
        """All selected spans of one text, by start and kind."""
        out = [(b["start"], b["kind"], b["end"]) for b in base]
        if self.trees is None or not wide:
            return sorted(out)
        score = self.trees.predict(np.array([w["x"] for w in wide], np.float32).astype(float))
        for s, w in sorted(zip(score.tolist(), wide), key=lambda p: (-p[0], p[1]["start"], p[1]["kind"], p[1]["end"])):
            if s >= self.least[w["kind"]] and not any(w["start"] < e and b < w["end"] for b, _, e in out):
                out.append((w["start"], w["kind"], w["end"]))
        return sorted(out)


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    """Features of the examples of a batch."""
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _quantiles(each: DataFrame) -> list[np.ndarray]:
    """Cuts between bins of each feature: quantiles of all values, rounded down to eight significant bits (the upper half of a float).

    No more than 65,536 values of a feature are told apart, so their counts fit the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in enumerate(_columns(batch).T):
                upper, count = np.unique(np.ascontiguousarray(own).view(np.uint32) >> 16, return_counts=True)
                yield pa.record_batch({"feature": pa.array(np.full(len(upper), i, np.int32)), "upper": pa.array(upper.astype(np.int32)), "n": pa.array(count)})

    held = each.select("x").mapInArrow(run, "feature int, upper int, n long").groupBy("feature", "upper").agg(F.sum("n").alias("n")).toArrow()
    feature, n = held.column("feature").to_numpy(), held.column("n").to_numpy()
    value = (held.column("upper").to_numpy().astype(np.uint32) << 16).view(np.float32).astype(float)
    cuts = []
    for i in range(int(feature.max()) + 1):
        own = np.flatnonzero(feature == i)
        own = own[np.argsort(value[own])]
        ends = np.cumsum(n[own])
        ranks = np.linspace(0, 1, BINS + 1)[1:-1] * (ends[-1] - 1)
        cuts.append(np.unique(value[own][np.searchsorted(ends, np.floor(ranks), side="right")]))
    return cuts


def _bins(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, whether they are right, and the number of equal ones, of binned examples."""
    bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
    return bins.astype(np.int64), rows.column("right").to_numpy(zero_copy_only=False).astype(float), rows.column("times").to_numpy()


def _grown(trees: Trees, learn: DataFrame, size: int, ones: int) -> Trees:
    """Trees whose levels are sums over the table ``learn``."""
    features = len(trees.cuts)

    def histograms(feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        shape = (2, 1 << level, features, BINS + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape, np.int64)
            for rows in batches:
                total += trees.histogram(*_bins(rows), feature, cut, level)
            yield pa.record_batch({"sums": pa.array([total.tobytes()], pa.binary())})

        parts = learn.mapInArrow(run, "sums binary").toArrow().column("sums").to_pylist()
        return sum((np.frombuffer(x, np.int64).reshape(shape) for x in parts), np.zeros(shape, np.int64))

    return trees.grow(size, ones, histograms)


def _thresholds(kind: np.ndarray, score: np.ndarray, n: np.ndarray, hits: np.ndarray, precision: float) -> list[float]:
    """Least score of each kind, from numbers of kept examples and of right ones per score."""
    least = [2.0] * len(KINDS)
    for k in range(len(KINDS)):
        own = np.flatnonzero(kind == k)
        own = own[np.argsort(-score[own])]
        size, right = np.append(0, np.cumsum(n[own])), np.append(0, np.cumsum(hits[own]))
        # The lowest scores that have SUPPORT examples together; equal scores are selected together.
        first = np.searchsorted(size, size[1:] - SUPPORT, side="right") - 1
        enough = size[1:] >= SUPPORT
        first = np.maximum(first, 0)
        lowest = right[1:] - right[first] >= precision * (size[1:] - size[first])
        good = np.flatnonzero(enough & lowest & (right[1:] >= precision * size[1:]))
        if len(good):
            least[k] = max(0.5, float(score[own[good[-1]]]) / SCORES)
    return least


def fit(found: DataFrame, precision: float = PRECISION) -> Selector:
    """Trees and thresholds from all examples of all rows."""
    each = found.select("doc_id", F.explode("examples").alias("w")).select("doc_id", "w.*")
    half = F.pmod(F.xxhash64("doc_id", "form", "kind", "x"), F.lit(2)) == 1
    kept = F.when(F.col("right"), (F.col("form") >= 0) & (F.col("form") % 2 == 1)).otherwise(half)
    each = each.select("kind", "right", "x", kept.alias("kept"))
    size, ones = each.filter("NOT kept").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("right").cast("long")), F.lit(0))).first()
    if size < SUPPORT or ones in (0, size):
        return Selector()
    trees = Trees()
    trees.cuts = _quantiles(each.filter("NOT kept"))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            bins = trees.binned(_columns(rows)).astype(np.uint8)
            yield pa.record_batch({"bins": pa.array([x.tobytes() for x in bins], pa.binary()), **{c: rows.column(c) for c in ("kind", "right", "kept")}})

    rows = each.mapInArrow(binned, "bins binary, kind int, right boolean, kept boolean")
    rows = written(rows.groupBy("bins", "kind", "right", "kept").agg(F.count(F.lit(1)).alias("times")), "pii-binned")
    learn = rows.filter("NOT kept").select("bins", "right", "times")
    if learn.count() <= HELD:
        # Sorted, so that nothing depends on the order of files.
        trees.fit_binned(*_bins(learn.orderBy("bins", "right").toArrow()))
    else:
        _grown(trees, learn, size, ones)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            bins, right, times = _bins(rows)
            score = np.minimum((trees.predict_binned(bins) * SCORES).astype(np.int64), SCORES - 1)
            yield pa.record_batch({"kind": rows.column("kind"), "score": pa.array(score), "n": pa.array(times), "hits": pa.array((times * right).astype(np.int64))})

    counts = rows.filter("kept").select("bins", "kind", "right", "times").mapInArrow(scored, "kind int, score long, n long, hits long")
    counts = counts.groupBy("kind", "score").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).toArrow()  # SCORES for each kind at most
    return Selector(trees, _thresholds(*(counts.column(c).to_numpy() for c in ("kind", "score", "n", "hits")), precision))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of base spans, their digest, and all spans as text."""
    found = written(found_spans(docs), "pii-spans")
    selector = fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            base = rows.column("base").to_pylist()
            chosen = [selector(b, w) for b, w in zip(base, rows.column("wide").to_pylist())]
            exact = [[(x["start"], x["kind"], x["end"]) for x in b] for b in base]
            counts = {f"n_{name}": pa.array([sum(x[1] == k for x in b) for b in exact], pa.int64()) for k, name in enumerate(KINDS)}
            yield pa.record_batch(
                {
                    "doc_id": rows.column("doc_id"),
                    **counts,
                    "base_sha256": pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in exact], pa.string()),
                    "spans": pa.array([_joined(c) for c in chosen], pa.string()),
                    "n_added": pa.array([len(c) - len(b) for c, b in zip(chosen, exact)], pa.int64()),
                }
            )

    kind = found.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{name} long" for name in KINDS)
    return found.drop("examples").mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added long")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every selected span of ``text`` replaced by its kind in brackets; other columns stay."""
    selector = fit(written(found_spans(docs).select("doc_id", "examples").filter(F.size("examples") > 0), "pii-examples"))
    columns = docs.columns
    cleared = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            out = []
            for raw in texts:
                text, parts, done = raw.decode("utf-8", "replace"), [], 0
                exact = base_spans(text)
                base = [{"start": s, "kind": k, "end": e} for s, k, e in exact]
                for start, kind, end in selector(base, _wide(text, exact)):
                    if end <= done:
                        continue
                    parts += [text[done : max(start, done)], f"[{KINDS[kind].upper()}]"]
                    done = end
                out.append("".join([*parts, text[done:]]))
            kept = {c: rows.column(c) for c in columns}
            yield pa.record_batch({**kept, "text": pa.array(out, rows.column("text").type)})

    fields = ", ".join(f"`{c}` {cleared.schema[c].dataType.simpleString()}" for c in columns)
    return cleared.mapInArrow(run, fields)
