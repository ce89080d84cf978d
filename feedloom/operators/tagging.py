"""Tag articles from a closed vocabulary.

The reference asks a language model to pick one or more tags out of a
closed list and to drop articles that fit none.  Here the tagger is a rule
table ``(id, name, phrase)`` matched natively on the normalised text (title
and summary in lower case, runs of anything but letters and digits as one
space, a space at both ends): the rules ride in the projection, so tagging is
a map-only step with no join and no Python.  The text is normalised once per
article.  A few rules are one ``contains`` each; more are hashed by the first
two words of their phrase (by the first, if it has no second whole word): the
words of an article are looked up in the set of those, and only the rules that
begin with words at hand are tested, so the cost does not grow with the rules.  An external model can be plugged in through
``model_tagger`` (``mapInPandas``), with the batch size and tries as
parameters.
"""

from __future__ import annotations

import json
from typing import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.text import once

# The closed tag vocabulary of the reference, in its order.
VOCABULARY = ("Artificial Intelligence", "Technology", "Startups")

# The test rule table (id, name, phrase).  'Unused' never
# matches, so it is the zero-count tag.
FIXTURE_RULES = (
    (1, "Artificial Intelligence", "license"),
    (2, "Startups", " and "),
    (3, "Technology", " the "),
    (4, "Unused", "no such phrase"),
)

# Our default phrases for the vocabulary (not from the reference).
DEFAULT_RULES = (
    (1, "Artificial Intelligence", " artificial intelligence "),
    (1, "Artificial Intelligence", " machine learning "),
    (1, "Artificial Intelligence", " ai "),
    (1, "Artificial Intelligence", " llm "),
    (2, "Startups", " startup "),
    (2, "Startups", " startups "),
    (2, "Startups", " venture capital "),
    (2, "Startups", " seed round "),
    (3, "Technology", " technology "),
    (3, "Technology", " software "),
    (3, "Technology", " tech "),
)

RULE_TYPE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("phrase", T.StringType(), False),
])


def rules_frame(spark: SparkSession, rules: Sequence[tuple] = DEFAULT_RULES) -> DataFrame:
    """Distinct (id, name) of a rule table as a tag dimension source."""
    return spark.createDataFrame(list(rules), RULE_TYPE).dropDuplicates(["id", "name"])


#: Up to this many rules are tested one by one.
FEW_RULES = 24
RULE = "struct<pos:int,id:bigint,name:string,phrase:string>"


def _rule(pos: int, rule: tuple) -> Column:
    i, name, phrase = rule
    return F.struct(F.lit(pos).alias("pos"), F.lit(int(i)).cast("long").alias("id"), F.lit(name).alias("name"), F.lit(phrase).alias("phrase"))


def first_word(phrase: str) -> str | None:
    """The word that a text must have to hold ``phrase``; None for a phrase that
    may begin inside a word or end inside its first."""
    parts = phrase.split(" ")
    return parts[1] if len(parts) > 2 and parts[0] == "" and parts[1] else None


def first_pair(phrase: str) -> str | None:
    """The two words that a text must have next to each other to hold
    ``phrase``; None if its second word may be a part of one."""
    parts = phrase.split(" ")
    return f"{parts[1]} {parts[2]}" if first_word(phrase) is not None and len(parts) > 3 and parts[2] else None


def _hits(text: Column, rules: Sequence[tuple]) -> Column:
    """The rules whose phrase the text holds, in rule order."""
    rules = list(enumerate(rules))
    by_word: dict[str, list] = {}
    by_pair: dict[str, list] = {}
    if len(rules) > FEW_RULES:
        for pos, rule in rules:
            if (w := first_word(rule[2])) is not None:
                p = first_pair(rule[2])
                (by_word if p is None else by_pair).setdefault(p or w, []).append(dict(zip(("pos", "id", "name", "phrase"), (pos, *rule))))
    tested = [(pos, rule) for pos, rule in rules if not (by_word or by_pair) or first_word(rule[2]) is None]
    hits = (F.array_compact(F.array(*[F.when(F.contains(text, F.lit(r[2])), _rule(pos, r)) for pos, r in tested]))
            if tested else F.array().cast(f"array<{RULE}>"))

    def begun(present: Column, rules_of: dict) -> Column:
        # one literal, read once while planning
        table = F.from_json(F.lit(json.dumps(rules_of)), f"map<string,array<{RULE}>>")
        found = F.flatten(F.transform(F.filter(present, lambda w: w.isin(*rules_of)), lambda w: F.element_at(table, w)))
        return F.filter(found, lambda r: F.contains(text, r["phrase"]))

    looked_up = []
    if by_word:
        looked_up.append(begun(F.array_distinct(F.split(text, " ")), by_word))
    if by_pair:
        heads = sorted({p.split(" ")[0] for p in by_pair})
        looked_up.append(begun(once(F.split(text, " "), lambda words: F.array_distinct(F.array_compact(F.transform(
            words, lambda w, i: F.when(w.isin(*heads), F.concat(w, F.lit(" "), F.get(words, i + 1))))))), by_pair))
    return F.array_sort(F.concat(hits, *looked_up)) if looked_up else hits


def tag_text(title: Column, summary: Column) -> Column:
    """Normalised text the rules match against (padded so ' the ' can hit both ends)."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def tag_articles(df: DataFrame, rules: Sequence[tuple] | None = None,
                 with_ids: bool = False, title: str = "title",
                 summary: str = "summary") -> DataFrame:
    """Add ``tags array<string>`` (distinct, rule order); optionally ``tag_ids``.
    ``rules`` default to ``DEFAULT_RULES``."""
    rules = DEFAULT_RULES if rules is None else rules
    free = [c for c in ("_tag_text", "_tag_hits", "_tag_text_", "_tag_hits_", "_tag_text__", "_tag_hits__") if c not in df.columns]
    text_col, hits_col = free[:2]
    out = df.withColumn(text_col, tag_text(F.col(title), F.col(summary)))
    out = out.withColumn(hits_col, _hits(F.col(text_col), rules)).drop(text_col)
    out = out.withColumn("tags", F.array_distinct(F.transform(hits_col, lambda r: r["name"])))
    if with_ids:
        out = out.withColumn("tag_ids", F.array_distinct(F.transform(hits_col, lambda r: r["id"])))
    return out.drop(hits_col)


def discard_untagged(df: DataFrame, tags: str = "tags") -> DataFrame:
    """An article no vocabulary tag applies to is dropped."""
    return df.where(F.size(F.col(tags)) > 0)


def clean_tag_names(tags: Column) -> Column:
    """strip every name, drop null/blank ones, keep first occurrence."""
    from feedloom.functions.text import strip_ws
    stripped = F.transform(tags, lambda t: strip_ws(t))
    return F.array_distinct(F.filter(stripped, lambda t: t.isNotNull() & (t != F.lit(""))))


def model_tagger(df: DataFrame, call: Callable[[list[dict]], list[list[str]] | None],
                 batch_size: int = 10, tries: int = 3) -> DataFrame:
    """Optional adaptor for an external tagger (X1 with a model).

    ``call`` gets up to ``batch_size`` article dicts and returns one tag list
    per article, or None on failure.  A batch that fails ``tries`` times
    yields no rows (U2): its articles stay untagged and out of the store, so
    the next poll brings them back.
    """
    fields = [f.name for f in df.schema.fields]
    out_schema = T.StructType(df.schema.fields + [T.StructField("tags", T.ArrayType(T.StringType()))])

    def run(batches: Iterable):
        import pandas as pd
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                records = chunk[fields].to_dict("records")
                result = None
                for _ in range(tries):
                    try:
                        result = call(records)
                    except Exception:  # noqa: BLE001 - a failed try is retried
                        result = None
                    if result is not None and len(result) == len(records):
                        break
                    result = None
                if result is None:
                    continue
                yield chunk.assign(tags=pd.Series(result, index=chunk.index))

    return df.mapInPandas(run, out_schema)


# The article fields sent to the tagger, in order, and the batch size.
REQUEST_FIELDS = ("title", "summary", "link", "published", "updated", "source", "og_image")
TAG_BATCH = 10


def request_bodies(articles: DataFrame, order_col: str = "id", batch_size: int = TAG_BATCH) -> DataFrame:
    """F13 + F14: articles cut into batches of ``batch_size`` in ``order_col``
    order (the last one short), each as one JSON array of the request fields
    (dates as text).  ``order_col`` must be dense from 1 (as store ids and
    arrival positions are); each group holds at most ``batch_size`` rows."""
    batch_no = F.floor((F.col(order_col) - F.lit(1)) / F.lit(batch_size)).cast("long")
    item = F.struct(F.col(order_col).alias("_o"), *[F.col(c) for c in REQUEST_FIELDS])
    grouped = (articles.select(batch_no.alias("batch_no"), item.alias("_item"))
               .groupBy("batch_no").agg(F.array_sort(F.collect_list("_item")).alias("_items")))
    body = F.to_json(F.transform("_items", lambda x: x.dropFields("_o")))
    return grouped.select("batch_no", F.size("_items").alias("n_articles"), body.alias("body"))
