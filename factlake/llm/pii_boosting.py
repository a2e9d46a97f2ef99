"""Personal data: candidates from loose patterns, selected by gradient-boosted trees.

Strict patterns with checks give the base spans, which always stay. Loose
patterns propose further, overlapping spans; one that lies exactly where a base
span does adds nothing and takes no part. The others are described by a cell of
discrete features of their format and of the mark before them.

There are no labels, so the trees learn from evidence that the features don't
hold. It is certain where the value, written plainly, also occurs as a base span
anywhere in the corpus, where a mail address is spelled out at both places, or
where 13 to 19 digits pass the card check. It is incomplete where a word such as
"phone" stands before the span: most personal data are not announced. As usual
for positive and unlabelled examples, the announced ones are divided by the share
of base spans that are announced (at most MOST_WEIGHT fold), so that a format that is
announced as often as the base spans are counts as personal data also where no
word says so. The trees fit these counts outside the held-out fold; the held-out
counts calibrate the score from which a candidate is selected.

Only counts per cell of features reach the driver: at most 2 * MOST_CELLS rows
whatever the data. The trees are fitted there on these counts, which are exact
sufficient statistics for discrete features, and come back as a list of cells.

Null texts count as empty; every row gives one row. Rows that repeat, null ids
and extra columns need no care: nothing is joined or grouped by document. Very
long texts are matched whole, with possessive patterns that need no deep stack.
Without any candidates no tree is fitted and only (no) base spans come out.

Built-in functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import held_out
from factlake.llm.native import joined, matches, running, spans
from factlake.session import materialize

BASE = ("email", "ip", "card", "phone")
# The base patterns. A look behind keeps a match from being tried
# at every character of a run; \G lets one begin where the last one ended.
EMAIL = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A chain of 13 to 19 digits, nothing shorter or longer.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose patterns: spelled-out mail addresses, and digits grouped in any usual way.
SPELLED = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?"
    r"[A-Za-z0-9-]{2,63}+\x20?(?:\(dot\)|\[dot\]|\{dot\}|\.)\x20?[A-Za-z]{2,24}"
)
DIGITS = r"(?<![0-9A-Za-z])\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,22}+(?![0-9A-Za-z])"
LOOSE = ("spelled", "digits")
KINDS = BASE + LOOSE
FLAGS = 8
MOST_CELLS = 8 << FLAGS
MOST_WEIGHT = 5.0
# Words that announce personal data, in the languages of the corpora.
_ANNOUNCE = r"(?i)(?:mail|phone|tel|call|card|karte|tarjeta|carte|contact|kontakt|contacto|address|ip|ssn|fax|mobil)\W*+$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a card number fits."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weight(i):
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        doubled = F.when(digit >= 5, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(F.transform(places, weight), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(
            F.split(value, r"\."), lambda part: F.coalesce(part.try_cast("int"), F.lit(999)) <= 255
        )
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _plain(kind: str, value: Column) -> Column:
    """A value without the ways to write it: mail addresses in lower case, numbers as digits."""
    if kind == "spelled":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(
            F.lower(value), r"\x20", ""), r"[(\[{]at[)\]}]", "@"), r"[(\[{]dot[)\]}]", ".")
    return F.lower(value) if kind == "email" else _digits(value)


def _certain(kind: str, value: Column) -> Column:
    """Whether a loose span's own form leaves no doubt."""
    if kind == "spelled":
        return value.rlike(r"[(\[{]at[)\]}].*[(\[{]dot[)\]}]")
    if kind == "digits":
        return F.length(_digits(value)).between(13, 19) & _luhn(_digits(value))
    return F.lit(False)


def _described(found: Column, kind: str) -> Column:
    """Spans with rank, kind, validity, evidence and the cell of their features."""
    rank = KINDS.index(kind)

    def describe(span):
        value, digits, before = span["value"], F.length(_digits(span["value"])), span["before"]
        size = (
            F.when(digits < 4, 0).when(digits < 9, 1).when(digits < 11, 2).when(digits < 13, 3)
            .when(digits < 16, 4).when(digits == 16, 5).when(digits < 20, 6).otherwise(7)
        )
        flags = [
            F.lit(kind == "spelled"), value.startswith("+"), value.rlike(r"[\x20()]"), value.rlike("-"),
            value.rlike(r"\."), value.rlike("^0") | before.rlike(r"[(]$"), value.rlike(r"[0-9][0-9]{3}-|\.[0-9]{4}"),
            before.rlike(r"[:=]\x20*+$"),
        ]
        cell = size
        for flag in flags:
            cell = cell * 2 + flag.cast("int")
        return F.struct(
            F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), span["start"].alias("start"),
            span["end"].alias("end"), _valid(kind, span).alias("valid"), cell.alias("cell"),
            before.rlike(_ANNOUNCE).alias("announced"), _certain(kind, value).alias("certain"),
            F.xxhash64(_plain(kind, value)).alias("key"),
        )

    return F.transform(found, describe)


def _place(span: Column) -> Column:
    return span["start"].cast("long") * F.lit(1 << 31) + span["end"]


def _base(span: Column) -> Column:
    return (span["rank"] < len(BASE)) & span["valid"]


def _with_addable(spans_: Column) -> Column:
    """The spans by place, each with whether it is a loose one where no base span lies exactly.

    Base spans come first at their place, so the greatest base place so far tells.
    """
    ordered = F.array_sort(F.transform(spans_, lambda s: F.struct(
        _place(s).alias("place"), (~_base(s)).alias("other"), s.alias("span")
    )))
    return F.transform(F.array(ordered), lambda listed: F.zip_with(
        listed, running(
            F.transform(listed, lambda s: F.when(s["other"], F.lit(-1)).otherwise(s["place"])),
            lambda one, other: F.greatest(one, other),
        ),
        lambda s, last: s["span"].withField(
            "addable", (s["span"]["rank"] >= len(BASE)) & (last != s["place"])
        ),
    ))[0]


def candidates(documents: DataFrame) -> DataFrame:
    """``doc_id, fold, spans``: all strict and loose matches of each document."""
    texts = documents.select(
        F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        held_out(F.col("doc_id")).alias("fold"),
    )
    digit_run = F.col("text").rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}")
    patterns = {
        "email": (EMAIL, F.contains("text", F.lit("@"))), "ip": (IP, F.col("text").rlike(IP)),
        "card": (CARD, digit_run), "phone": (PHONE, F.contains("text", F.lit("+"))),
        "spelled": (SPELLED, F.col("text").rlike(r"[(\[{]at[)\]}]")), "digits": (DIGITS, digit_run),
    }
    listed = texts.select("doc_id", "fold", "text", *(
        matches("text", pattern, possible).alias(f"m_{kind}") for kind, (pattern, possible) in patterns.items()
    ))
    located = listed.select("doc_id", "fold", "text", *(
        spans("text", patterns[kind][0], f"m_{kind}").alias(f"s_{kind}") for kind in KINDS
    ))
    return located.select("doc_id", "fold", F.concat(*(
        _described(F.col(f"s_{kind}"), kind) for kind in KINDS
    )).alias("spans")).withColumn("spans", _with_addable(F.col("spans")))


def _accepted(cells: DataFrame) -> dict:
    """Per fold and cell how many addable spans there are and how many count as personal data.

    Cell -1 holds the base spans: how many of them are announced says how much an
    announced candidate stands for.
    """
    rows = cells.collect()  # at most two folds times MOST_CELLS + 1 rows
    base = [r for r in rows if r["cell"] < 0 and not r["fold"]]
    share = sum(r["announced"] for r in base) / max(1, sum(r["n"] for r in base))
    weight = min(MOST_WEIGHT, 1 / share) if share else 1.0
    counted: dict = {}
    for r in rows:
        if r["cell"] >= 0:
            good = min(float(r["n"]), r["certain"] + weight * r["announced"])
            counted.setdefault(bool(r["fold"]), {})[r["cell"]] = (r["n"], good)
    return counted


@dataclass
class BoostedCells:
    """Depth-two regression trees on the bits of a cell, boosted on the logistic loss."""

    rounds: int = 30
    rate: float = 0.3
    trees: list = field(default_factory=list)
    start: float = 0.0

    @staticmethod
    def features(cell: int) -> tuple:
        """The flags of the cell and, bit by bit, whether its size class is reached."""
        flags = tuple((cell >> k) & 1 for k in range(FLAGS))
        return flags + tuple(int((cell >> FLAGS) >= k) for k in range(1, 8))

    def fit(self, counts: dict[int, tuple[int, float]]) -> BoostedCells:
        rows = [(self.features(c), n, good) for c, (n, good) in sorted(counts.items())]
        total, valid = sum(r[1] for r in rows), sum(r[2] for r in rows)
        if not total:
            return self
        self.start = math.log((valid + 0.5) / (total - valid + 0.5))
        scores = [self.start] * len(rows)
        for _ in range(self.rounds):
            chance = [1 / (1 + math.exp(-s)) for s in scores]
            gradient = [good - n * p for (_, n, good), p in zip(rows, chance, strict=True)]
            curve = [n * p * (1 - p) for (_, n, _), p in zip(rows, chance, strict=True)]
            tree = self._split([r[0] for r in rows], gradient, curve, list(range(len(rows))), 2)
            self.trees.append(tree)
            scores = [s + self.rate * self._leaf(tree, r[0]) for s, r in zip(scores, rows, strict=True)]
        return self

    def _split(self, x, gradient, curve, members, depth):
        g, h = sum(gradient[i] for i in members), sum(curve[i] for i in members)
        best = None
        if depth:
            for f in range(len(x[0])):
                right = [i for i in members if x[i][f]]
                if 0 < len(right) < len(members):
                    gr, hr = sum(gradient[i] for i in right), sum(curve[i] for i in right)
                    gain = gr * gr / (hr + 1) + (g - gr) ** 2 / (h - hr + 1) - g * g / (h + 1)
                    if best is None or gain > best[0] + 1e-12:
                        best = (gain, f, right)
        if best is None or best[0] <= 1e-9:
            return g / (h + 1)
        left = [i for i in members if not x[i][best[1]]]
        return (best[1], self._split(x, gradient, curve, left, depth - 1),
                self._split(x, gradient, curve, best[2], depth - 1))

    @staticmethod
    def _leaf(tree, x) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] else tree[1]
        return tree

    def score(self, cell: int) -> float:
        x = self.features(cell)
        total = self.start + self.rate * sum(self._leaf(tree, x) for tree in self.trees)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def calibrated(model: BoostedCells, counts: dict[int, tuple[int, float]], precision: float) -> float:
    """The lowest score from which the held-out candidates are as precise as asked.

    One right and one wrong candidate are added to them, so that a few prove nothing.
    """
    kept = good = 0
    threshold = 2.0
    by_score: dict[float, list[float]] = {}
    for cell, (n, valid) in counts.items():
        held = by_score.setdefault(round(model.score(cell), 12), [0, 0])
        held[0] += n
        held[1] += valid
    for score, (n, valid) in sorted(by_score.items(), reverse=True):
        kept, good = kept + n, good + valid
        if good + 1 < precision * (kept + 2):
            break
        threshold = score
    return threshold


def find_personal_data(documents: DataFrame, precision: float = 0.9) -> DataFrame:
    """``doc_id, base, found``: the base spans, and all selected ones."""
    proposed = materialize(candidates(documents), "pii-candidates")
    return _selected(proposed, _accepted(_taught(proposed)), precision)


def _taught(proposed: DataFrame) -> DataFrame:
    """Counts per fold and cell of the addable spans, and of the base spans as cell -1.

    ``certain`` counts the spans with certain evidence, ``announced`` those of the others
    that a word announces. Spans are counted per value before values meet, so that
    one value in a third of all rows is few rows.
    """
    span = F.col("span")
    of_values = materialize(
        proposed.select("fold", F.explode("spans").alias("span")).filter(_base(span) | span["addable"])
        .groupBy("fold", F.when(span["addable"], span["cell"]).otherwise(F.lit(-1)).alias("cell"),
                 span["announced"].alias("announced"), span["certain"].alias("certain"), span["key"].alias("key"))
        .agg(F.count(F.lit(1)).alias("n")), "pii-values"
    )
    known = of_values.filter("cell < 0").select("key", F.lit(True).alias("known")).distinct()
    certain = F.col("certain") | F.coalesce("known", F.lit(False))
    return of_values.join(known, "key", "left").groupBy("fold", "cell").agg(
        F.sum("n").alias("n"),
        F.sum(F.when((F.col("cell") >= 0) & certain, F.col("n")).otherwise(0)).alias("certain"),
        F.sum(F.when(F.col("announced") & ((F.col("cell") < 0) | ~certain), F.col("n")).otherwise(0))
        .alias("announced"),
    )


def _selected(proposed: DataFrame, counted: dict, precision: float) -> DataFrame:
    model = BoostedCells().fit(counted.get(False, {}))
    threshold = calibrated(model, counted.get(True, {}), precision)
    cells = {c for fold in counted.values() for c in fold}
    good = sorted(c for c in cells if round(model.score(c), 12) >= threshold)
    base = F.filter("spans", _base)
    further = F.filter("spans", lambda s: s["addable"] & (s["cell"].isin(good) if good else F.lit(False)))
    return proposed.select("doc_id", base.alias("base"), F.concat(base, further).alias("found"))


def _listed(found: Column) -> Column:
    """By kind as listed, then by start."""
    return F.array_sort(F.transform(found, lambda s: F.struct(
        s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
    )))


def pii_digest(selected: DataFrame) -> DataFrame:
    """The contract's columns from the spans of ``find_personal_data``."""
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return selected.select(
        "doc_id", *(of(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(joined(_listed(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        joined(_listed(F.col("found"))).alias("spans"),
    )
