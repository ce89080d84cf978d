r"""Operator 10: secret scans with multipart credential linking.

DataFrame functions only.  Base findings, per kind the leftmost
non-overlapping matches over the whole text:

* ``assign``  a secret-like name, ``:`` or ``=``, and a value of 8 or more characters
* ``access``  an access identifier, ``AKIA`` and upper-case letters or digits, 16 or more in all
* ``hex``     a run of 32 or more lower-case hexadecimal digits

Some parts are too weak to report alone.  They are linked by an interval join:
parts of one row whose gap is at most ``reach`` code points are in one scope.

* ``secret``    a run of exactly 40 letters, digits, ``/`` or ``+``: reported when an access identifier is in scope
* ``endpoint``  ``http(s)://host``: reported when an access identifier and a secret (a 40-character run or an assigned value) are in scope

The scan is one pass per pattern without a shuffle; the extraction runs on
rows that hold a match.  What leaves the text is a short written table of gap
and match lengths, so the text is read once.  Start positions are running sums
over those rows (streamed by a window).  The interval join is an equi-join on
(row, stretch of the text) with one side placed in the neighbouring stretches
too: parts do not overlap within a kind, so a stretch of fixed width holds a
bounded number of them, and a text with very many parts spreads over many keys.

Defined cases: a null or empty text has no findings; offsets are code points,
end exclusive; rows that repeat an id are separate rows with their own
findings; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import stage


def either_case(word: str) -> str:
    """Pattern for an ASCII word in any mix of cases."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join([either_case("password"), either_case("passwd"), either_case("secret"), either_case("token"),
                  either_case("api") + "_?" + either_case("key")])
ASSIGN = f"({NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
VALUE_LENGTH = 8
# A maximal run of n or more is the greedy leftmost match cut off below n.
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
    "secret": "[A-Za-z0-9/+]{40,}",
    "endpoint": "https?://[A-Za-z0-9.-]+",
}
BASE = ("assign", "access", "hex")
SECRET_LENGTH = 40
#: Order of kinds that start at the same position.
ORDER = {"assign": 0, "access": 1, "hex": 2, "secret": 3, "endpoint": 4}
REACH = 400


def matches(text: Column, kind: str) -> Column:
    """Array of (gap before the match, match length, reported) of a kind."""
    p = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, p, F.lit(0))
    if kind == "assign":
        ok = F.transform(F.regexp_extract_all(text, p, F.lit(2)), lambda v: F.length(v) >= VALUE_LENGTH)
    elif kind == "secret":
        ok = F.transform(found, lambda v: F.length(v) == SECRET_LENGTH)
    else:
        ok = F.transform(found, lambda v: F.lit(True))
    gaps = F.split(text, PATTERNS[kind], -1)
    zipped = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m"), ok.alias("ok")), lambda z: F.struct(
        F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("len"), z["ok"].alias("ok"), F.lit(kind).alias("kind")))
    return F.when(text.rlike(PATTERNS[kind]), F.filter(zipped, lambda z: z["len"].isNotNull()))


def find_parts(hits: DataFrame) -> DataFrame:
    """Spans (row, kind, start, end) of every kind from the gap lengths."""
    kinds = [hits.where(F.col(k).isNotNull()).select("row", F.posexplode(k).alias("pos", "h")) for k in PATTERNS]
    rows = kinds[0]
    for k in kinds[1:]:
        rows = rows.unionByName(k)
    w = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("row", "pos", "h.*")
    end = F.sum(F.col("gap") + F.col("len")).over(w)
    return (rows.withColumn("end", end).where("ok")
            .select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end"))


def link_weak(parts: DataFrame, reach: int) -> DataFrame:
    """Weak parts (row, kind, start, end) whose complement is in scope."""
    weak = parts.where(F.col("kind").isin("secret", "endpoint"))
    strong = parts.where(F.col("kind").isin("access", "secret", "assign")).select(
        F.col("row"), F.col("kind").alias("of"), F.col("start").alias("s"), F.col("end").alias("e"))
    # parts in one scope share a stretch: a weak part lies in all that it touches,
    # a strong one in all that it touches when widened by the reach
    touched = lambda lo, hi: F.explode(F.sequence(F.floor(F.greatest(lo, F.lit(0)) / reach), F.floor(hi / reach)))
    near = strong.withColumn("stretch", touched(F.col("s") - reach, F.col("e") + reach))
    placed = weak.withColumn("stretch", touched(F.col("start"), F.col("end")))
    gap = F.greatest(F.col("start") - F.col("e"), F.col("s") - F.col("end"))
    scope = (placed.join(near, ["row", "stretch"])
             .where((gap <= reach) & ~((F.col("of") == F.col("kind")) & (F.col("s") == F.col("start"))))
             .groupBy("row", "kind", "start", "end")
             .agg(F.max(F.col("of") == "access").alias("has_access"),
                  F.max(F.col("of").isin("secret", "assign")).alias("has_secret")))
    return scope.where(F.col("has_access") & ((F.col("kind") == "secret") | F.col("has_secret"))).select(
        "row", "kind", "start", "end")


def joined(spans: Column) -> Column:
    """``kind:start:end`` comma-joined, by start, then kind."""
    s = F.array_sort(spans)
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hits = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                             *(matches(text, k).alias(k) for k in PATTERNS)), "secret-hits")
    # found once, then linked: a small written table (rows without a match are not in it)
    parts = stage(find_parts(hits), "secret-parts")
    spans = (parts.where(F.col("kind").isin(*BASE)).withColumn("base", F.lit(True))
             .unionByName(link_weak(parts, reach).withColumn("base", F.lit(False))))
    order = F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv))
    one = F.struct("start", order[F.col("kind")].alias("o"), "kind", "end")
    found = spans.groupBy("row").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE),
        joined(F.collect_list(F.when(F.col("base"), one))).alias("base"), joined(F.collect_list(one)).alias("spans"))
    return (hits.select("doc_id", "row").join(found, "row", "left")
            .select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
                    F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
                    F.coalesce("spans", F.lit("")).alias("spans")))
