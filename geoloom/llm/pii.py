"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators with high recall propose overlapping spans: the four base patterns without their checks, loose numbers and
spelt-out addresses. Each candidate becomes a few small integers of format and context; the checks of the base rules (parts of
an address, Luhn) are not among them. They only label: a candidate of a base pattern is personal data if it passes and is not
if it has the right number of digits and fails; a loose number or address takes the label of the base candidate that it
overlaps, and one glued to letters is part of a word. What no rule labels counts little, as a negative (UNLABELLED). The table
of candidates is reduced to counts for each combination of features, which is bounded, and gradient-boosted trees are fitted
to it on four of five folds of documents. The threshold is the least score whose precision over the labelled candidates of the
fifth fold reaches PRECISION; unlabelled candidates at or over it are added, unless a base span overlaps them. Base spans
always stay.

Patterns are written so that they take time in proportion to the text: possessive repeats, and a start only where no longer
match could have started (a look-behind, or the end of the match before).

Defined results: a null text is empty; an empty text has no spans; texts are read whole; rows that share doc_id and text get
equal results; a text of any length is read whole; without labelled candidates of both kinds in the larger part, or of a good
one in the fifth fold, no span is added; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoloom.llm.common import id_text, materialize

LOCAL = "A-Za-z0-9._%+-"
KINDS = ("email", "ip", "card", "phone", "number", "address")
BASE = KINDS[:4]
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"\(?[0-9][\x20().0-9-]{5,}[0-9]",
    "address": r"(?:\G|(?<![A-Za-z0-9._-]))[A-Za-z0-9._-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z0-9-]++)++",
}
FEATURES = ("at", "dots", "digits", "seps", "groups", "cue", "left", "right")
#: What a candidate without a label weighs as a negative.
UNLABELLED = 0.05
#: One of so many folds of documents sets the threshold.
FOLDS = 5
#: Precision over the labelled candidates of the held-out fold that a score must reach for its candidates to be added.
PRECISION = 0.95
CONTEXT = 24


def may_match(kind: str, text: Column) -> Column:
    """A cheap test without which the pattern needn't run."""
    if kind == "email":
        return text.contains("@")
    if kind == "phone":
        return text.contains("+")
    if kind == "address":
        return text.contains("(at)") | text.contains("[at]")
    return text.rlike("[0-9][0-9.\\x20()-]" if kind != "ip" else r"[0-9]\.[0-9]")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, h, kind, i, gap, match, left, right): the i-th match of a pattern and what stands around it."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", F.xxhash64("text").alias("h"), text.alias("text"))

    def matches(kind: str) -> Column:
        between, match = F.split("text", PATTERNS[kind], -1), F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))
        both = F.struct(between.alias("b"), match.alias("m"))
        each = F.transform(  # the one-element array gives the two lists a name, so that each is made once
            F.array(both),
            lambda x: F.transform(
                x["m"],
                lambda m, i: F.struct(
                    F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(x["b"], i)).alias("gap"), m.alias("match"), F.right(F.get(x["b"], i), F.lit(CONTEXT)).alias("left"), F.left(F.get(x["b"], i + 1), F.lit(1)).alias("right")
                ),
            ),
        )
        return F.when(may_match(kind, F.col("text")), F.get(each, F.lit(0)))

    none = F.array().cast("array<struct<kind:string,i:int,gap:int,match:string,left:string,right:string>>")
    every = F.concat(*(F.coalesce(matches(k), none) for k in KINDS))
    return found.select("doc_id", "h", F.explode(every).alias("c")).select("doc_id", "h", "c.*")


def luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        v = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return v - F.when(v > 9, 9).otherwise(0)

    values = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def small_parts(match: Column) -> Column:
    """Whether all parts between full stops are at most 255."""
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(bare(p)) < 3) | ((F.length(bare(p)) == 3) & (bare(p) <= "255")))


def described(rows: DataFrame) -> DataFrame:
    """Candidates with their place, their features, and whether the base rules take them (null: no base kind)."""
    before = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.dropDuplicates(["doc_id", "h", "kind", "i"])  # repeated rows of documents propose the same
    digits, kind = F.regexp_replace("match", "[^0-9]", ""), F.col("kind")
    spelt = F.regexp_replace(F.regexp_replace("match", r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?[\[(]dot[\])]\x20?", ".")
    match = F.when(kind == "address", spelt).otherwise(F.col("match"))  # an address has the features of what it spells out
    rows = rows.withColumns({"end": F.sum(F.col("gap") + F.length("match")).over(before), "d": digits})
    n = F.length("d")
    ok_luhn, ok_parts = n.between(12, 19) & luhn(F.substring("d", 1, 20)), (kind == "ip") & small_parts(match)
    base = F.when(kind == "email", True).when(kind == "ip", ok_parts).when(kind == "card", ok_luhn).when(kind == "phone", n.between(9, 15))
    left = F.lower("left")
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    features = {
        "at": flag(match.contains("@")),
        "dots": flag(match.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$")),
        "digits": F.when(n == 0, 0).when(n < 7, 1).when(n < 9, 2).when(n < 12, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),
        "seps": flag(match.rlike(r"[\x20-]")) + 2 * flag(match.contains("(")),
        "groups": F.when(match.rlike(r"\(?\b[0-9]{3}\)?[\x20.-]+[0-9]{3}[\x20.-][0-9]{4}$"), 1).when(match.rlike(r"^[0-9]{4}([\x20-]?[0-9]{4}){3}$"), 2).otherwise(0),
        "cue": F.when(left.rlike(r"mail|contact|reach|write"), 1).when(left.rlike(r"tel|phone|call|fax|mobile"), 2).when(left.rlike(r"card|visa|account|iban|ssn|server|host|\bip\b"), 3).otherwise(0),
        "left": flag(F.right("left", F.lit(1)).rlike(r"[A-Za-z0-9_.@/]")),
        "right": flag(F.col("right").rlike(r"[A-Za-z0-9_@/]")),
    }
    fails = F.when(kind == "ip", ~ok_parts).when(kind == "card", n.between(12, 19) & ~ok_luhn).when(kind == "phone", ~n.between(9, 15))
    rows = rows.select(
        "doc_id", "h", "kind", (F.col("end") - F.length("match")).cast("long").alias("start"), F.col("end").cast("long").alias("end"), base.alias("base"),
        F.when(base, True).when(fails, False).alias("sure"), *(v.cast("int").alias(f"f_{k}") for k, v in features.items()),
    )
    return rows.withColumn("label", F.when(F.col("base").isNotNull(), F.col("sure")).otherwise(overlapped())).drop("sure")


def overlapped() -> Column:
    """What the base candidates that a span overlaps say of it: true before false; glued to letters: false; else null.

    Spans of a document stand in the order of their starts, so an earlier one overlaps if the greatest end so far lies
    beyond the start, and a later one if the next start lies before the end.
    """
    order = Window.partitionBy("doc_id", "h").orderBy("start", "end", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)

    def meets(sure: Column) -> Column:
        ends, starts = F.max(F.when(sure, F.col("end"))).over(before), F.min(F.when(sure, F.col("start"))).over(after)
        return F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("end"), F.lit(False))

    return F.when(meets(F.col("sure")), True).when(meets(~F.col("sure")) | ((F.col("f_left") + F.col("f_right")) > 0), False)


def fit_boosting(x: np.ndarray, good: np.ndarray, bad: np.ndarray, rounds: int = 40, depth: int = 2, rate: float = 0.3) -> np.ndarray:
    """Log-odds of each row of x: trees of second-order boosting on the counts of good and bad candidates with those features."""
    n = good + bad
    out = np.full(len(x), np.log((good.sum() + 1) / (bad.sum() + 1)))

    def grow(rows: np.ndarray, left: int, g: np.ndarray, h: np.ndarray, step: np.ndarray) -> None:
        best = (1e-9, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1)
        for f in range(x.shape[1] if left else 0):
            for cut in np.unique(x[rows, f])[:-1]:
                a = rows[x[rows, f] <= cut]
                b = rows[x[rows, f] > cut]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1) + g[b].sum() ** 2 / (h[b].sum() + 1) - total
                if gain > best[0]:
                    best = (gain, (a, b))
        if best[1] is None:
            step[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        else:
            for part in best[1]:
                grow(part, left - 1, g, h, step)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-out))
        step = np.zeros(len(x))
        grow(np.arange(len(x)), depth, p * n - good, p * (1 - p) * n, step)
        out = out + rate * step
    return out


def threshold(score: np.ndarray, good: np.ndarray, bad: np.ndarray, precision: float) -> float:
    """The least score down to which the labelled candidates have the wanted precision; infinity if none has."""
    order = np.argsort(-score, kind="stable")
    g, b = np.cumsum(good[order]), np.cumsum(bad[order])
    last = np.append(np.diff(score[order]) != 0, True)  # equal scores stand or fall together
    fine = np.flatnonzero(last & (g >= precision * (g + b)) & (g > 0))
    return float(score[order][fine[-1]]) if len(fine) else float("inf")


def chosen(rows: DataFrame, precision: float = PRECISION) -> DataFrame:
    """Candidates that stay, with their score: base spans, and others that the trees take for personal data."""
    names = [f"f_{k}" for k in FEATURES]
    held = F.pmod(F.xxhash64("h"), F.lit(FOLDS)) == 0
    counts = {"good": F.col("label"), "bad": ~F.col("label"), "open": F.col("label").isNull() & F.col("base").isNull()}
    seen = rows.groupBy(*names).agg(*(F.count_if(c & f).alias(f"{k}_{part}") for k, c in counts.items() for part, f in (("fit", ~held), ("held", held)))).collect()  # a row for each combination of features, at most 2 * 2 * 7 * 4 * 3 * 4 * 2 * 2
    base = rows.where("base").withColumn("score", F.lit(1.0))
    of = {k: np.array([r[k] for r in seen], float) for k in ("good_fit", "bad_fit", "open_fit", "good_held", "bad_held")}
    if not of["good_fit"].sum() or not of["bad_fit"].sum():
        return base.drop(*names, "label")
    x = np.array([[r[k] for k in names] for r in seen], int)
    logit = fit_boosting(x, of["good_fit"], of["bad_fit"] + UNLABELLED * of["open_fit"])
    marked = of["good_held"] + of["bad_held"] > 0
    least = threshold(logit[marked], of["good_held"][marked], of["bad_held"][marked], precision)
    kept = [(*map(int, f), float(1 / (1 + np.exp(-s)))) for f, s in zip(x, logit, strict=True) if s >= least]
    table = rows.sparkSession.createDataFrame(kept, ", ".join(f"{k} int" for k in names) + ", score double")
    more = rows.where(F.col("base").isNull() & F.col("label").isNull()).join(F.broadcast(table), names)
    return base.unionByName(more).drop(*names, "label")


def find_pii(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and findings for each row of docs."""
    docs = id_text(docs)
    rows = materialize(described(candidates(docs)), "pii-candidates")
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", place.alias("place"), "kind", "end", "score")
    per_doc = chosen(rows, precision).groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("own"),
        F.array_sort(F.collect_list(F.when(F.col("base").isNull(), span))).alias("more"),
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE),
    )
    free = F.filter("more", lambda m: ~F.exists("own", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    per_doc = per_doc.withColumn("findings", F.array_sort(F.concat("own", free)))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), "h", *(f"n_{k}" for k in BASE), text("own").alias("_own"), text("findings").alias("_all"), "findings")
    keys = docs.select("doc_id", F.xxhash64("text").alias("_h"))
    out = keys.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("h")), "left")
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in BASE), F.sha2(F.coalesce("_own", F.lit("")), 256).alias("base_sha256"), F.coalesce("_all", F.lit("")).alias("spans"), F.coalesce("findings", F.array().cast(out.schema["findings"].dataType)).alias("findings"))
