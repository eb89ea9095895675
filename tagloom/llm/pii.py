"""Personal data by candidate gradient boosting, with DataFrame functions only.

Strict patterns with checks (the base) give spans that always stay. Looser generators propose further, overlapping
candidates: forms that a base pattern swallows in a longer match and then drops, or misses for want of a sign. The teacher
is not the base but a check of each kind, which what is no personal data fails now and then: Luhn, octets, an area code that
no plan gives, a domain that ends in no letters. Real items always pass. Boosted trees of its kind learn, from all candidates of
the corpus and without seeing the check, how likely a candidate of such a format in such a context is to pass; a threshold of its
kind, calibrated on candidates of another fold, selects the formats and contexts in which PRECISION of the candidates pass. So
among numbers of a form that pass by chance none is taken, and whether the base finds a form says nothing for or against it. A selected candidate that passes
its check is added unless it overlaps a base span or one that was added before it (higher scores first, then earlier and longer ones).

Training sees a table of counts by feature values (a few thousand cells at most, whatever the input), summed over all
candidates of the corpus; the trees become one SQL expression. Texts are read once.

Edge cases: null counts as empty and has no spans; rows without id are scored as others; repeated rows get a row each;
equal scores go to the earlier and then the longer candidate; a kind of which the held-out fold has fewer than LEAST candidates gets nothing added; texts of any length are processed whole (patterns cannot backtrack past a run).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import crc_mod, materialize, table

KINDS = ["email", "ip", "card", "phone"]
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: The base, in forms that take the same matches in linear time: runs are possessive, and a run is entered at its start only.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, each with its kind.
GENERATORS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20\.\x20?|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)++"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
]
#: A text without a match of these has none of the kind: a quick test.
MAY_HAVE = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20.-]?[0-9]){12}", "phone": r"\+[0-9]|[0-9]{3}[)\x20.-]"}
#: Words shortly before a candidate that speak of its kind.
WORDS = {"email": "mail|contact|write", "ip": r"\bip\b|addr|host|server", "card": "card|visa|account|pay", "phone": "tel|phone|call|fax|mobil"}
FEATURES = ["kind", "digits", "letters", "paren", "dash", "dot", "space", "before", "after", "word", "other"]
FIELDS = ["kind", "start", "end", "ok", *FEATURES[1:]]
FOLDS, HELD_OUT = 4, 0
TREES, RATE, LEAST, PRECISION, SURE = 24, 0.3, 4, 0.95, 0.9


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, text), in code points, end exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, x: F.struct(F.length(g).alias("gap"), x.alias("text")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["text"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), s["text"].alias("text")))).alias("out"))

    return F.aggregate(steps, zero, add, lambda acc: acc["out"])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    d = F.reverse(digits(x))

    def value(i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, v: a + v)
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def octets(x: Column) -> Column:
    return x.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")


def plausible(kind: str, x: Column) -> Column:
    """The check that teaches: that of the base, and for kinds whose generators cannot fail it one of their own."""
    if kind == "email":
        return x.rlike(r"[A-Za-z]{2,}$")
    return valid(kind, x) & ~digits(x).rlike("^[01]") if kind == "phone" else valid(kind, x)


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return octets(x)
    if kind == "card":
        return luhn(x)
    return F.length(digits(x)).between(9, 15) if kind == "phone" else F.lit(True)


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda m: valid(kind, m["text"])


def _place(k: int) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end), kind as its place in KINDS, by kind and start."""
    out = []
    for k, kind in enumerate(KINDS):
        found = F.transform(F.filter(matches(text, BASE[kind]), _valid(kind)), _place(k))
        out.append(F.when(text.rlike(MAY_HAVE[kind]), found).otherwise(_none("struct<kind:int,start:int,end:int>")))
    return F.concat(*out)


def _char(x: Column) -> Column:
    """Class of a neighbouring character: 0 none or space, 1 letter, 2 digit, 3 other."""
    return F.when(x.rlike(r"^(?:\s|\z)"), 0).when(x.rlike(r"^\p{L}"), 1).when(x.rlike("^[0-9]"), 2).otherwise(3)


def _describe(text: Column, k: int) -> Callable[[Column], Column]:
    def describe(m: Column) -> Column:
        x = m["text"]
        ahead = F.lower(F.substring(text, F.greatest(m["start"] - 23, F.lit(1)), F.least(m["start"], F.lit(24))))
        others = "|".join(w for kind, w in WORDS.items() if kind != KINDS[k])
        values = {
            "kind": F.lit(k), "start": m["start"], "end": m["end"], "digits": F.least(F.length(digits(x)), F.lit(20)),
            "ok": plausible(KINDS[k], x), "letters": x.rlike("[A-Za-z]"), "paren": F.contains(x, F.lit("(")), "dash": F.contains(x, F.lit("-")), "dot": F.contains(x, F.lit(".")), "space": F.contains(x, F.lit(" ")),
            "before": _char(F.when(m["start"] > 0, F.substring(text, m["start"], F.lit(1))).otherwise("")), "after": _char(F.substring(text, m["end"] + 1, F.lit(1))), "word": ahead.rlike(WORDS[KINDS[k]]), "other": ahead.rlike(others),
        }
        return F.struct(*(values[x].cast("int").alias(x) for x in FIELDS))

    return describe


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, ok: passes the check of its kind, and the other FEATURES) by generator."""
    empty = "struct<" + ",".join(f"{x}:int" for x in FIELDS) + ">"
    return F.array_distinct(F.concat(*(
        F.when(text.rlike(MAY_HAVE[kind]), F.transform(matches(text, pattern), _describe(text, KINDS.index(kind)))).otherwise(_none(empty))
        for kind, pattern in GENERATORS)))


@dataclass
class Leaf:
    value: float


@dataclass
class Split:
    """Left: feature <= at."""

    feature: int
    at: int
    left: Split | Leaf
    right: Split | Leaf

    def sql(self, prefix: str) -> str:
        sides = [x.sql(prefix) if isinstance(x, Split) else f"{x.value:.6f}D" for x in (self.left, self.right)]
        return f"CASE WHEN {prefix}.{FEATURES[self.feature]} <= {self.at} THEN {sides[0]} ELSE {sides[1]} END"

    def of(self, x: tuple[int, ...]) -> float:
        side = self.left if x[self.feature] <= self.at else self.right
        return side.of(x) if isinstance(side, Split) else side.value


Cell = tuple[tuple[int, ...], int, int]  # feature values, candidates, those that pass


def _grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int) -> Split | Leaf:
    """A tree on (values, gradient, curvature) by Newton gain."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-6, None)
    if depth:
        for f in range(len(FEATURES)):
            sums: dict[int, list[float]] = {}
            for x, a, b in rows:
                s = sums.setdefault(x[f], [0.0, 0.0])
                s[0] += a
                s[1] += b
            a = b = 0.0
            for v in sorted(sums)[:-1]:
                a, b = a + sums[v][0], b + sums[v][1]
                gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, v))
    if best[1] is None:
        return Leaf(-RATE * g / (h + 1))
    f, v = best[1]
    return Split(f, v, _grow([r for r in rows if r[0][f] <= v], depth - 1), _grow([r for r in rows if r[0][f] > v], depth - 1))


@dataclass
class Model:
    """Boosted trees of depth three for the logistic loss, from the log-odds of all examples (one more of each class) on."""

    start: float
    trees: list[Split]

    def of(self, x: tuple[int, ...]) -> float:
        return self.start + sum(t.of(x) for t in self.trees)

    def sql(self) -> str:
        return " + ".join([f"{self.start:.6f}D", *(t.sql("c") for t in self.trees)])


def boost(cells: list[Cell]) -> Model | None:
    """None if no candidate passes; if all do, no trees."""
    total, right = sum(n for _, n, _ in cells), sum(y for _, _, y in cells)
    if not right:
        return None
    model = Model(math.log((right + 1) / (total - right + 1)), [])
    if right == total:
        return model
    scores = [model.start] * len(cells)
    for _ in range(TREES):
        rows = []
        for (x, n, y), s in zip(cells, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            rows.append((x, n * p - y, n * p * (1 - p)))
        tree = _grow(rows, 3)
        if isinstance(tree, Leaf):
            break
        model.trees.append(tree)
        scores = [s + tree.of(c[0]) for s, c in zip(scores, cells, strict=True)]
    return model


def calibrate(models: list[Model | None], cells: list[Cell]) -> list[float]:
    """For each kind the least score, of probability SURE or more, from which on PRECISION of the candidates pass; infinite if none is. models: by kind."""
    out = []
    for k, model in enumerate(models):
        scored = sorted(((model.of(x), n, y) for x, n, y in cells if x[0] == k), reverse=True) if model else []
        least, total, right = math.inf, 0, 0
        for i, (s, n, y) in enumerate(scored):
            total, right = total + n, right + y
            if s >= math.log(SURE / (1 - SURE)) and right >= PRECISION * total and total >= LEAST and (i + 1 == len(scored) or scored[i + 1][0] < s):
                least = s
        out.append(least)
    return out


def _learn(found: DataFrame) -> tuple[str, str] | None:
    """SQL for the score of a candidate `c` and for whether it is selected; None if nothing is."""
    rows = found.select("fold", F.explode("candidates").alias("c")).select((F.col("fold") == HELD_OUT).alias("held"), *(F.col(f"c.{x}") for x in FEATURES), F.col("c.ok").cast("long").alias("y"))
    cells = rows.groupBy("held", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()  # bounded by the features' values
    by = {held: sorted((tuple(r[x] for x in FEATURES), r["n"], r["y"]) for r in cells if r["held"] == held) for held in (False, True)}
    models = [boost([c for c in by[False] if c[0][0] == k]) for k in range(len(KINDS))]  # what fails a check of one kind says nothing of another
    chosen = [(k, x) for k, x in enumerate(calibrate(models, by[True])) if x < math.inf]
    if not chosen:
        return None
    score = "CASE c.kind " + " ".join(f"WHEN {k} THEN {models[k].sql()}" for k, _ in chosen) + " ELSE double('-Infinity') END"
    return score, f"c.ok = 1 AND {score} >= CASE c.kind " + " ".join(f"WHEN {k} THEN {x - 1e-4:.6f}D" for k, x in chosen) + " ELSE double('Infinity') END"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans of every row of docs: arrays of (kind, start, end), kind as its place in KINDS, by kind and start."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), crc_mod(id_col, FOLDS).alias("fold"), base_spans(text).alias("base"), candidates(text).alias("candidates")), "candidates")
    learnt, spans = _learn(found), F.col("base")
    if learnt:
        score, selected = learnt
        more = F.expr(f"array_sort(transform(filter(candidates, c -> {selected}), c -> struct(-({score}) AS neg, c.start AS start, -c.end AS longest, c.kind AS kind, c.end AS end)))")

        def clash(xs: Column, c: Column) -> Column:
            return F.exists(xs, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

        def add(acc: Column, c: Column) -> Column:
            own = F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
            return F.when(clash(acc, c) | clash(F.col("base"), c), acc).otherwise(F.concat(acc, own))

        spans = F.array_sort(F.concat("base", F.aggregate(more, _none("struct<kind:int,start:int,end:int>"), add)))
    return found.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together, by the first one's kind."""
    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    return F.aggregate(by_place, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def _named(spans: str) -> Column:
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({kinds}, s.kind + 1), ':', s.start, ':', s.end)), ',')")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the personal data of every text of `documents`. The counts by kind are of base spans; n_spans counts the added ones, too."""
    out = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(_named("base").cast("binary"), 256).alias("base_sha256"), _named("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
