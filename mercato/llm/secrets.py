"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

DataFrame expressions only. One scan of the texts keeps, per document and kind, the lengths of the gaps
between matches and the matches themselves; offsets are running sums over them. A candidate string is
one row per character; the entropy of the window ending there follows from incremental counts: a
character that enters raises its count from c - 1 to c and so the sum of c * log2(c) by f(c) - f(c - 1),
and one that leaves lowers it likewise. Running counts of digits, cases and marks say which character class
the window is of, and so which entropy is suspicious. Suspicious windows that touch make a stretch, and the
allow-list is held against the stretch, not against what stands around it. Long candidates are dealt out in
pieces that overlap by a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import materialise, text_or_empty

# FIXED VALUES: the base kinds: pattern, group that must have a least length, that length. A run of
# the access and hex kinds that is too short holds no other match, so the least length stands in the
# pattern; a dropped assignment still covers its text, so that one is matched first and then judged.
_KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32))

#: candidate strings, the sliding window, and bits a character that make a window suspicious
WINDOW = 24
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: windows of a candidate that are counted together
PIECE = 4096
#: character classes of a window, the narrowest first: what it may hold, what it must hold, and bits
CLASSES = (
    ("hex", "^[0-9A-Fa-f]+$", ("[0-9]", "[A-Fa-f]"), 3.2),
    ("lower", "^[0-9a-z]+$", ("[0-9].*[0-9].*[0-9]", "[a-z]"), 3.8),
    ("upper", "^[0-9A-Z]+$", ("[0-9].*[0-9].*[0-9]", "[A-Z]"), 3.8),
    ("alnum", "^[0-9A-Za-z]+$", ("[0-9]", "[A-Z]", "[a-z]"), 3.9),
    ("base64", "^[A-Za-z0-9+/_=-]+$", ("[0-9]", "[A-Z]", "[a-z]"), 4.05),
)
#: harmless stretches: placeholders, alphabets, UUIDs, dates in names
ALLOW = (
    r"(?i)example|sample|placeholder|dummy|changeme|your_|xxxx",
    r"(?i)abcdefgh|01234567|12345678",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(19|20)[0-9][0-9]-[01][0-9]-[0-3][0-9]",
)
#: names before a stretch's first other character, as in a path or an assignment, aren't held against the allow-list
LEADING = "^([a-z_-]*[/=])+"
ENTROPY = "entropy"


#: what a character counts as, by pattern
_COUNTED = {"digit": "[0-9]", "lower": "[a-z]", "upper": "[A-Z]", "hexletter": "[A-Fa-f]"}


def _bits() -> Column:
    """The least entropy that makes a window suspicious, by its counts of _COUNTED; null: never."""
    digit, lower, upper, letter = (F.col(f"n_{c}") for c in _COUNTED)
    bits = {name: b for name, _, _, b in CLASSES}
    return (
        F.when(digit + letter == WINDOW, F.when((digit > 0) & (letter > 0), bits["hex"]))
        .when(digit + lower == WINDOW, F.when((digit > 2) & (lower > 0), bits["lower"]))
        .when(digit + upper == WINDOW, F.when((digit > 2) & (upper > 0), bits["upper"]))
        .when((digit > 0) & (lower > 0) & (upper > 0), F.when(digit + lower + upper == WINDOW, bits["alnum"]).otherwise(bits["base64"]))
    )


def _harmless(text: Column) -> Column:
    judged = F.regexp_replace(text, LEADING, "")
    out = judged.rlike(ALLOW[0])
    for pattern in ALLOW[1:]:
        out = out | judged.rlike(pattern)
    return out


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Per match: the characters between it and the one before, its own, and the judged group."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # the gap after the last match has no match: arrays_zip gives it nulls
    return F.when(text.rlike(pattern), F.arrays_zip(gaps.alias("gap"), found.alias("found"), judged.alias("judged")))


def _located(hits: DataFrame, kind: str, kept: list[Column]) -> DataFrame:
    """Rows (uid, nth, start, end and ``kept``) of the matches of a kind."""
    rows = hits.where(F.col(kind).isNotNull()).select("uid", F.posexplode(kind).alias("nth", "m")).where("m.found is not null")
    upto = Window.partitionBy("uid").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.char_length("m.found")).over(upto)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.char_length("m.found")).select(
        "uid", "nth", "start", "end", *kept
    )


def _entropy_spans(hits: DataFrame) -> DataFrame:
    """Stretches (uid, start, end) of suspicious windows that touch or overlap, those on the allow-list left out."""
    found = _located(hits, ENTROPY, [F.col("m.found").alias("text")])
    last = F.floor((F.char_length("text") - WINDOW) / PIECE).cast("int")
    pieces = found.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).withColumn("from", F.col("piece") * PIECE)
    part = F.substring(F.col("text"), F.col("from") + 1, F.lit(PIECE + WINDOW - 1))
    chars = pieces.select("uid", "nth", "piece", "from", F.posexplode(F.split(part, "")).alias("i", "ch")).where("ch <> ''")
    same = Window.partitionBy("uid", "nth", "piece", "ch").orderBy("i")
    f = lambda c: c * F.log2(c)
    raised = lambda c: f(c) - F.when(c > 1, f(c - 1)).otherwise(0.0)
    entering = F.count(F.lit(1)).over(same.rangeBetween(1 - WINDOW, 0))
    leaving = F.count(F.lit(1)).over(same.rangeBetween(0, WINDOW - 1))
    steps = chars.withColumn("up", raised(entering.cast("double"))).withColumn("down", raised(leaving.cast("double")))
    run = Window.partitionBy("uid", "nth", "piece").orderBy("i")
    upto, past = run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, -WINDOW)
    total = F.sum("up").over(upto) - F.coalesce(F.sum("down").over(past), F.lit(0.0))
    counts = {}
    for name, pattern in _COUNTED.items():
        one = F.col("ch").rlike(pattern).cast("int")
        counts[f"n_{name}"] = F.sum(one).over(upto) - F.coalesce(F.sum(one).over(past), F.lit(0))
    windows = steps.withColumns({"h": F.lit(math.log2(WINDOW)) - total / WINDOW, **counts}).where(F.col("i") >= WINDOW - 1)
    hot = windows.where(F.col("h") >= _bits()).select("uid", "nth", "piece", (F.col("from") + F.col("i") - (WINDOW - 1)).alias("a"))

    def joined(rows: DataFrame, keys: list[str]) -> DataFrame:
        """Stretches (a to b, first window to last) of which those that touch become one."""
        order = Window.partitionBy(*keys).orderBy("a")
        fresh = F.coalesce(F.col("a") - F.lag("b").over(order) > WINDOW, F.lit(True)).cast("int")
        island = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("fresh", fresh).withColumn("island", island)
        return rows.groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")

    # in its piece first, so that a candidate's pieces meet as a few stretches each
    stretches = joined(joined(hot.withColumn("b", F.col("a")), ["uid", "nth", "piece"]), ["uid", "nth"])
    placed = stretches.join(found.select("uid", "nth", "start", "text"), ["uid", "nth"])
    length = F.col("b") - F.col("a") + WINDOW
    placed = placed.where(~_harmless(F.substring(F.col("text"), F.col("a").cast("int") + 1, length.cast("int"))))
    return placed.select("uid", (F.col("start") + F.col("a")).alias("start"), (F.col("start") + F.col("a") + length).alias("end"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Scan every text of ``docs`` (doc_id, text) for secrets.

    Returns a row per row: doc_id and spans, an array of (start, kind_ix, kind, end) by start, then
    kind: assign, access, hex (the fixed patterns) and entropy. A candidate of any length is scanned whole, in
    pieces; its suspicious stretches are spans of their own. Offsets are code points, the end is
    exclusive. Null and empty texts, and texts without a match, have no spans; repeated rows are
    scanned each. An empty table gives no rows. Other columns are ignored.
    """
    text = text_or_empty(docs)
    scans = [_matches(text, pattern, group).alias(kind) for kind, pattern, group, _ in BASE] + [_matches(text, CANDIDATE, 0).alias(ENTROPY)]
    scanned = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), *scans), "secret-hits"
    )
    kinds = [kind for kind, *_ in BASE] + [ENTROPY]
    spans = _entropy_spans(scanned).select("uid", "start", "end", F.lit(len(BASE)).alias("kind_ix"))
    for ix, (kind, _, _, least) in enumerate(BASE):
        fit = _located(scanned, kind, [F.char_length("m.judged").alias("judged")]).where(F.col("judged") >= least)
        spans = spans.unionByName(fit.select("uid", "start", "end", F.lit(ix).alias("kind_ix")))
    by_doc = spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "kind_ix", "end"))).alias("spans"))
    names = F.array(*[F.lit(k) for k in kinds])
    named = F.transform(
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind_ix:int,end:bigint>>")),
        lambda s: F.struct(s["start"].alias("start"), s["kind_ix"].alias("kind_ix"), F.element_at(names, s["kind_ix"] + 1).alias("kind"), s["end"].alias("end")),
    )
    return scanned.select("uid", "doc_id").join(by_doc, "uid", "left").select("doc_id", named.alias("spans"))


def span_digests(scanned: DataFrame) -> DataFrame:
    """Counts and digests of :func:`scan_secrets`'s spans."""
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind_ix"] < len(BASE))
    counts = [
        F.size(F.filter("spans", lambda s: s["kind_ix"] == ix)).cast("long").alias(f"n_{kind}") for ix, (kind, *_) in enumerate(BASE)
    ]
    return scanned.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
