"""Personal data by candidate gradient boosting, in DataFrame functions throughout.

Base rules find e-mail addresses, IPv4 addresses, card and phone numbers. High-recall
generators propose further spans, which may overlap those and each other. Boosted trees
score each candidate by format and context; a threshold per kind, calibrated on documents
the trees have not seen, selects. Spans never leave their row: no shuffle but the count
of feature cells for the fit.

Patterns use possessive loops and begin at the edge of a run of their first class (or
where the last match ended), so that long runs cost linear time; they match the same
spans as the plain forms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from musterroll.llm.boosting import Boosted, boost, threshold_for
from musterroll.llm.common import free_name

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: the kind that they propose, and their pattern.
_PROPOSED = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?+(?:@|\[at\]|\(at\))\x20?+[A-Za-z0-9-]++(?:(?:\.|\x20?+(?:\[dot\]|\(dot\))\x20?+)[A-Za-z0-9-]++)*+",
    "phone": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?+[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+",
}
_CUE = r"(?i)(?:password|passwd|pwd|token|secret|key|mail|phone|tel|call|contact)[^A-Za-z0-9]{0,5}$"
_SECRET_CUE = r"(?i)(?:password|passwd|pwd|token|secret|key)\s*[=:]\s*[\"']?$"
_SECRET_FORM = r"^(?:AKIA|ASIA)[0-9A-Z]{16}$"
#: Signs that do not rest on the base rules: a usual last part of a host, announced numbers, codes
#: that the numbering plan allows for area and exchange.
_USUAL_END = r"(?i)(?:\.|(?:\[dot\]|\(dot\))\x20?)(?:com|org|net|edu|gov|info|io|example|[a-z]{2})$"
_PHONE_CUE = r"(?i)(?:phone|tel|call|fax|mobile|contact)[^A-Za-z0-9]{0,5}$"
_PHONE_CODES = r"^\(?[2-9][0-8][0-9]\)?[\x20.-]?(?![2-9]11)[2-9][0-9]{2}"
FEATURES = ["kind", "digits", "seps", "case", "size", "cue", "joined", "usual"]
BASE_SCORE = 2.0
_SPAN_TYPE = "array<struct<kind: string, start: int, end: int, hit: string, before: string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of each block of an array, as an array. A block has 64 items, up to 512 of long arrays.

    Every step of ``aggregate`` copies its state, so a state that collects what it finds is
    kept to one block.
    """
    size = F.least(F.greatest(F.floor(F.size(items) / 1000).cast("int"), F.lit(64)), F.lit(512))
    return F.transform(F.sequence(F.lit(0), F.size(items) - 1, size), lambda at: _let(F.slice(items, at + 1, size), use))


def _scanned(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], found: str) -> Column:
    """Struct of the last ``state`` and all that was ``found``, in order.

    ``step`` gives the next state and an array of what the item adds.
    """
    none = F.array().cast(f"array<{found}>")

    def one(done: Column, item: Column) -> Column:
        after, more = step(done["state"], item)
        return F.struct(after.alias("state"), F.concat(done["found"], more).alias("found"))

    def block(done: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(done["state"].alias("state"), none.alias("found")), one)
        return _let(inner, lambda r: F.struct(
            r["state"].alias("state"), F.concat(done["found"], F.array(r["found"])).alias("found")))

    def all_blocks(whole: Column) -> Column:
        zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{found}>>").alias("found"))
        return F.aggregate(_blocks(whole, lambda own: own), zero, block, lambda d: F.struct(
            d["state"].alias("state"), F.flatten(d["found"]).alias("found")))

    return _let(items, lambda whole: F.when(F.size(whole) > 0, all_blocks(whole)).otherwise(
        F.struct(state.alias("state"), none.alias("found"))))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches with code-point positions and the text just before them, in order."""
    none = F.array().cast(_SPAN_TYPE)

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        found = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), pair["hit"].alias("hit"),
            F.right(pair["gap"], F.lit(32)).alias("before"),
        )
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(found)).alias("found"))

    def measured(own: Column) -> Column:
        width = F.aggregate(own, F.lit(0), lambda n, pair: n + F.length(pair["gap"]) + F.length(pair["hit"]))
        return F.struct(width.alias("width"), own.alias("own"))

    def block(placed: Column) -> Column:
        zero = F.struct(placed["at"].alias("at"), none.alias("found"))
        return F.aggregate(placed["own"], zero, step, lambda done: done["found"])

    def all_blocks(blocks: Column) -> Column:
        """Where each block starts, and then the spans of each on their own."""
        starts = F.aggregate(blocks["width"], F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        placed = F.arrays_zip(blocks["own"].alias("own"), F.slice(starts, F.lit(1), F.size(blocks)).alias("at"))
        return F.flatten(F.transform(placed, block))

    def found(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        steps = F.arrays_zip(gaps.alias("gap"), matches.alias("hit"))
        return F.when(F.size(matches) > 0, _let(steps, lambda s: _let(_blocks(s, measured), all_blocks))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    """Every second digit from the right counts twice, less nine if that exceeds nine."""
    digits = F.split(F.reverse(_digits(hit)), "")

    def weigh(digit: Column, place: Column) -> Column:
        value = digit.cast("int")
        twice = 2 * value
        return F.when(place % 2 == 0, value).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _octets(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))


def _card_number(hit: Column) -> Column:
    fits = F.length(_digits(hit)).between(16, 19)
    return F.when(fits, _luhn(hit)).otherwise(False)


#: What a match of the kind has to fulfil.
_VALID = {
    "email": lambda hit: F.lit(True),
    "ip": _octets,
    "card": _card_number,
    "phone": lambda hit: F.length(_digits(hit)).between(8, 15),
}


def base_spans(text: Column) -> Column:
    """The validated spans of the base rules, by kind as in ``BASE`` and then by start."""
    found = []
    for kind in BASE:
        needed = text.contains("@") if kind == "email" else text.rlike("[0-9]")
        check = _VALID[kind]
        spans = F.filter(_spans(text, kind, _PATTERN[kind]), lambda s: check(s["hit"]))
        found.append(F.when(needed, spans).otherwise(F.array().cast(_SPAN_TYPE)))
    return F.concat(*found)


def proposed_needed(text: Column) -> Column:
    """A quick test that most texts fail."""
    return text.rlike("[0-9@]") | text.contains("at]") | text.contains("at)")


def proposed_spans(text: Column) -> Column:
    found = F.concat(*[_spans(text, kind, pattern) for kind, pattern in _PROPOSED.items()])
    return F.when(proposed_needed(text), found).otherwise(F.array().cast(_SPAN_TYPE))


def features(span: Column) -> list[Column]:
    """Small integers, as named in ``FEATURES``."""
    hit, before = span["hit"], span["before"]
    lower, upper = hit.rlike("[a-z]").cast("int"), hit.rlike("[A-Z]").cast("int")
    kind = F.when(span["kind"] == "email", 0).when(span["kind"] == "phone", 1).otherwise(2)
    return [
        kind,
        F.least(F.length(_digits(hit)), F.lit(20)),
        F.least(F.length(F.regexp_replace(hit, r"[A-Za-z0-9]", "")), F.lit(8)),
        lower + 2 * upper,
        F.least(F.floor(F.length(hit) / 4), F.lit(12)).cast("int"),
        before.rlike(_CUE).cast("int"),
        before.rlike(r"[\p{L}0-9]$").cast("int"),
        F.when(span["kind"] == "email", hit.rlike(_USUAL_END)).when(span["kind"] == "phone", hit.rlike(_PHONE_CODES))
        .otherwise(hit.rlike(_SECRET_FORM)).cast("int"),
    ]


def _silver(span: Column) -> Column:
    """1 or 0 by signs that do not rest on the base rules, null without a sign.

    Mail: whether the host has an end, and a usual one. Phone: announced with codes of the
    numbering plan, or with others. Secret: announced or of a known form, or neither.
    """
    hit, before = span["hit"], span["before"]
    dotted = hit.rlike(r"\.|\[dot\]|\(dot\)")
    mail = F.when(hit.rlike(_USUAL_END), 1).when(~dotted, 0)
    codes = hit.rlike(_PHONE_CODES)
    phone = F.when(before.rlike(_PHONE_CUE) & codes, 1).when(~codes, 0)
    secret = before.rlike(_SECRET_CUE) | hit.rlike(_SECRET_FORM)
    return F.when(span["kind"] == "email", mail).when(span["kind"] == "phone", phone).otherwise(secret.cast("int"))


@dataclass(frozen=True)
class Selector:
    """Boosted trees and the probability from which on each kind is selected."""

    model: Boosted
    thresholds: dict[str, float]

    def selected_score(self, span: Column) -> Column:
        """The score of a span that is selected, null for others; features are computed once."""
        least = F.lit(1.5)
        for kind, value in self.thresholds.items():
            least = F.when(span["kind"] == kind, F.lit(value)).otherwise(least)
        named = F.struct(*[f.alias(n) for f, n in zip(features(span), FEATURES, strict=True)])
        score = _let(named, lambda f: self.model.column([f[n] for n in FEATURES]))
        return _let(score, lambda value: F.when(value >= least, value))


def fit(docs: DataFrame, text: str = "text", precision: float = 0.95, **options) -> Selector:
    """Fit on all candidates of ``docs``, counted in feature cells.

    Labels are silver, by signs in the candidate and before it (see ``_silver``), not by the
    base rules; candidates without a sign take no part. Half the texts (by a hash) fit the
    trees, the others calibrate, per kind, the threshold that reaches ``precision``. Without
    candidates nothing is added to the base spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(body.alias("text")).where(proposed_needed(F.col("text")))
    rows = rows.select(F.xxhash64("text").alias("h"), proposed_spans(F.col("text")).alias("spans"))
    rows = rows.select("h", F.explode(F.transform("spans", lambda s: F.struct(
        *[f.cast("int").alias(n) for f, n in zip(features(s), FEATURES, strict=True)],
        _silver(s).alias("label")))).alias("cell")).where("cell.label IS NOT NULL")
    counted = rows.groupBy((F.pmod("h", F.lit(2))).alias("fold"), *[F.col(f"cell.{n}") for n in FEATURES]).agg(
        F.sum("cell.label").alias("positive"), F.count(F.lit(1)).alias("total"))
    cells = np.array([tuple(r) for r in counted.collect()], dtype=np.float64).reshape(-1, len(FEATURES) + 3)
    cells = cells[np.lexsort(cells.T[::-1])] if len(cells) else cells
    own, other = cells[cells[:, 0] == 0], cells[cells[:, 0] == 1]
    model = boost(own[:, 1:-2], own[:, -2], own[:, -1], **options)
    probability = model.probability(other[:, 1:-2])
    thresholds = {}
    for code, kind in enumerate(_PROPOSED):
        mine = other[:, 1] == code
        thresholds[kind] = threshold_for(probability[mine], other[mine, -2], other[mine, -1], precision)
    return Selector(model, thresholds)


def added_spans(text: Column, base: Column, selector: Selector) -> Column:
    """Selected candidates that overlap neither a base span nor a better candidate.

    Of candidates that overlap, the higher score stays, then the earlier one.
    """
    scored_type = "struct<start: int, end: int, score: double, kind: string>"
    scored = F.transform(proposed_spans(text), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        selector.selected_score(s).alias("score"), s["kind"].alias("kind")))
    fixed = F.transform(base, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(BASE_SCORE).alias("score"), s["kind"].alias("kind")))
    ordered = F.array_sort(F.concat(F.filter(scored, lambda s: s["score"].isNotNull()), fixed))
    none = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(BASE_SCORE).alias("score"), F.lit("").alias("kind"))

    def step(last: Column, span: Column) -> tuple[Column, Column]:
        apart = span["start"] >= last["end"]
        both_base = (span["score"] == BASE_SCORE) & (last["score"] == BASE_SCORE)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
                         last["score"].alias("score"), last["kind"].alias("kind"))
        current = F.when(apart | (span["score"] > last["score"]), span).when(both_base, wider).otherwise(last)
        closed = F.when(apart & (last["score"] < BASE_SCORE), F.array(last)).otherwise(nothing)
        return current.cast(scored_type), closed

    nothing = F.array().cast(f"array<{scored_type}>")
    done = _scanned(ordered, none.cast(scored_type), step, scored_type)
    return _let(done, lambda d: F.concat(d["found"], F.when(d["state"]["score"] < BASE_SCORE, F.array(d["state"])).otherwise(nothing)))


def find_spans(docs: DataFrame, selector: Selector, text: str, base: str, spans: str) -> DataFrame:
    """``docs`` with two arrays of ``kind``, ``start``, ``end``: base spans, and all spans.

    Positions count code points, ``end`` is exclusive. Both are ordered by kind (as in
    ``KINDS``) and start. A null or empty text has none. Row by row, so repeated rows and
    null ids are no matter; the other columns are passed on.
    """
    plain = "array<struct<kind: string, start: int, end: int>>"

    def narrow(array: Column) -> Column:
        return F.transform(array, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    body = F.coalesce(F.col(text), F.lit(""))
    whole, added = (free_name(docs, c, base, spans) for c in ("base_with_hits", "added"))
    rows = docs.withColumn(whole, F.when(proposed_needed(body), base_spans(body)).otherwise(F.array().cast(_SPAN_TYPE)))
    rows = rows.withColumn(added, F.when(proposed_needed(body), added_spans(body, F.col(whole), selector)))
    more = narrow(F.coalesce(added, F.array().cast("array<struct<start: int, end: int, score: double, kind: string>>"))).cast(plain)
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    own = narrow(F.col(whole)).cast(plain)
    both = F.transform(F.concat(own, more), lambda s: F.struct(
        F.element_at(rank, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.withColumns({base: own, spans: narrow(F.array_sort(both)).cast(plain)}).drop(whole, added)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, selector: Selector, text: str = "text") -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets.

    Spans that overlap become one, named after the first. A text without any is unchanged,
    a null stays null; all rows and columns stay.
    """
    base, every, apart = free_name(docs, "base_spans"), free_name(docs, "all_spans"), free_name(docs, "apart_spans")
    found = find_spans(docs, selector, text, base, every).withColumn(apart, _apart(F.col(every)))
    clean = F.when(F.size(apart) > 0, _replaced(F.col(text), F.col(apart))).otherwise(F.col(text))
    return found.withColumn(text, clean).select([F.col(f"`{c}`") for c in docs.columns])


def _apart(spans: Column) -> Column:
    """The spans by start, those that overlap as one, named after the first."""
    kind = "struct<start: int, end: int, kind: string>"
    none = F.array().cast(f"array<{kind}>")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(last: Column, span: Column) -> tuple[Column, Column]:
        apart = last["start"].isNull() | (span["start"] >= last["end"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"), last["kind"].alias("kind"))
        closed = F.when(last["start"].isNotNull() & apart, F.array(last)).otherwise(none)
        return F.when(apart, span).otherwise(wider).cast(kind), closed

    first = F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("end", "int"), ("kind", "string"))])
    done = _scanned(ordered, first, step, kind)
    return _let(done, lambda d: F.concat(d["found"], F.when(d["state"]["start"].isNotNull(), F.array(d["state"])).otherwise(none)))


def _replaced(text: Column, spans: Column) -> Column:
    """The text with each of the spans, which do not overlap, replaced.

    Spans go in blocks, each with its stretch of the text, so that positions are counted
    from the start of a stretch and not from that of the text.
    """
    size = F.size(spans)
    nexts = F.concat(F.slice(spans["start"], F.lit(2), size), F.array(F.length(text)))
    zipped = F.arrays_zip(spans["start"].alias("start"), spans["end"].alias("end"), spans["kind"].alias("kind"), nexts.alias("next"))

    def pieces(own: Column) -> Column:
        first, last = own[0]["start"], F.element_at(own, -1)["next"]
        return _let(F.substring(text, first + 1, last - first), lambda stretch: F.array_join(F.transform(own, lambda s: F.concat(
            F.lit("["), F.upper(s["kind"]), F.lit("]"), F.substring(stretch, s["end"] - first + 1, s["next"] - s["end"]))), ""))

    return F.concat(F.substring(text, F.lit(1), spans[0]["start"]), _let(zipped, lambda z: F.array_join(_blocks(z, pieces), "")))
