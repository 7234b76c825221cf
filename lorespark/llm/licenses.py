"""License scans: ordered signature rules behind a keyword prefilter, with priority and containment suppression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, fresh, table
from .license_rules import DENIED, NAMED, UNNAMED, spdx_rules, written_rules

#: What separates words: ASCII other than digits and letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases.
BASE = [("mit", 0.5, "mit license"), ("apache", 0.5, "apache license"), ("gpl", 0.5, "general public license")]
#: Words before a place that a rule may look back at.
BEHIND = 32


@dataclass(frozen=True)
class Rule:
    """A signature that starts at a word equal to keyword; pattern is matched at the words from there on, each with a
    space after it, and before, if there is one, at the end of the words that come before."""

    number: int
    keyword: str
    pattern: str
    before: str
    label: str
    priority: int
    confidence: float
    base: bool

    @property
    def scope(self) -> str:
        """What the signature says of other versions: only, or-later, or nothing."""
        return next((x for x in SCOPES if self.pattern.endswith(SCOPES[x])), "")


def cue_of(before: str) -> str:
    """A word that must be among those before, if there is a pattern for them: the longest one outside of all groups."""
    plain, depth = "", 0
    for c in before:
        depth += (c == "(") - (c == ")")
        plain += c if depth == 0 and c.isalnum() else " "
    return max(plain.split(), key=len, default="")


# How a signature's pattern ends that speaks of other versions.
SCOPES = {"only": " only ", "or-later": (" or later ", " or (?:any )?(?:later|newer) ", " any later version ")}


def words_of(pattern: str) -> int:
    """So many words a match of the pattern has at most, all its alternatives counted, repeats as often as they may occur."""
    repeats = sum(int(n) for n in re.findall(r"\{\d+,(\d+)\}", pattern))
    return pattern.count(" ") + repeats + 1


def signature_rules() -> list[Rule]:
    """Base phrases, what names no license, names and grants, denials, and identifiers in tags, in rising priority."""
    found = [(label, confidence, pattern, "", 1, True) for label, confidence, pattern in BASE]
    for priority, own in ((1, written_rules(UNNAMED)), (2, written_rules(NAMED)), (3, written_rules(DENIED)), (3, spdx_rules())):
        found += [(*rule, priority, False) for rule in own]
    return [Rule(i, re.match("[a-z0-9]+", pattern)[0], f"^{pattern} ", before and f" {before}$", label, priority, confidence, base) for i, (label, confidence, pattern, before, priority, base) in enumerate(found)]


RULES = signature_rules()


def _rule_map(rules: list[Rule]) -> Column:
    """Keyword to the array of its rules."""
    by: dict[str, list[Rule]] = {}
    for r in rules:
        by.setdefault(r.keyword, []).append(r)
    entries = []
    for keyword, own in by.items():
        structs = [F.struct(F.lit(r.number).alias("number"), F.lit(r.pattern).alias("pattern"), F.lit(r.before).alias("before"), F.lit(f" {cue_of(r.before)} ").alias("cue"), F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"), F.lit(r.base).alias("base"), F.lit(r.scope).alias("scope")) for r in own]
        entries += [F.lit(keyword), F.array(*structs)]
    return F.create_map(*entries)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def license_detections(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """docs with n_words, detections and licenses.

    detections: all matches as (start, end, priority, number, label, confidence, base, scope) in word positions from 0,
    end exclusive, ordered by start, longer and higher priority first. licenses: what is left of them as
    (labels, score, n_kept) after suppression: a match falls away if an interval that contains its own, of the
    same or a higher priority, comes before it in that order; a denial ("not under the GPL") suppresses the name in it and
    shows the label none. Rules run only in texts that have one of their keywords, and there only at the keyword; how
    many words they see follows from the longest rule. Null and empty texts have no words and no detections; repeated
    rows get equal results; an empty table gives no rows. Columns of docs that have one of the three names are replaced.
    """
    rules = rules or RULES
    docs = docs.drop("n_words", "detections", "licenses")
    padded, words = fresh(docs, "__padded", "__words")
    keywords = sorted({r.keyword for r in rules})
    named = docs.withColumn(padded, F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), GAP, " ")), F.lit(" ")))
    gate = F.lit(False)
    for k in keywords:
        gate = gate | F.contains(F.col(padded), F.lit(f" {k} "))
    rows = named.withColumn("n_words", F.when(F.length(padded) == 2, F.lit(0)).otherwise(_spaces(F.col(padded)) - 1).cast("long"))
    rows = rows.withColumn(words, F.when(gate, F.split(F.trim(padded), " ")).otherwise(F.array().cast("array<string>")))
    by_keyword, known, most = _rule_map(rules), F.array(*map(F.lit, keywords)), max((words_of(r.pattern) for r in rules), default=1)

    def at(i: Column) -> Column:
        window = F.concat(F.array_join(F.slice(F.col(words), i + 1, most), " "), F.lit(" "))
        begin = F.greatest(F.lit(0), i - BEHIND)
        behind = F.concat(F.lit(" "), F.array_join(F.slice(F.col(words), begin + 1, i - begin), " "), F.lit(" "))
        # A pattern is compiled for each try, a cue is not.
        fits = lambda r: (r["before"] == "") | (F.contains(behind, r["cue"]) & F.regexp_like(behind, r["before"]))
        tried = F.transform(F.element_at(by_keyword, F.get(F.col(words), i)), lambda r: F.struct(r.alias("rule"), F.when(fits(r), F.regexp_substr(window, r["pattern"])).alias("match")))
        hits = F.filter(tried, lambda x: x["match"].isNotNull())
        return F.transform(hits, lambda x: F.struct(i.alias("start"), (-(i + _spaces(x["match"]))).alias("minus_end"), (-x["rule"]["priority"]).alias("minus_priority"), x["rule"]["number"].alias("number"), x["rule"]["label"].alias("label"), x["rule"]["confidence"].alias("confidence"), x["rule"]["base"].alias("base"), x["rule"]["scope"].alias("scope")))

    anchors = F.filter(F.transform(F.col(words), lambda w, i: F.when(F.array_contains(known, w), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    ordered = F.sort_array(F.flatten(F.transform(anchors, at)))
    rows = rows.withColumn("detections", ordered)
    never = F.lit(-1)
    start = F.struct(never.alias("e1"), never.alias("e2"), never.alias("e3"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"), F.lit(0).alias("n_kept"))

    def take(acc: Column, x: Column) -> Column:
        end, p = -x["minus_end"], -x["minus_priority"]
        before = F.greatest(acc["e3"], F.when(p <= 2, acc["e2"]).otherwise(never), F.when(p <= 1, acc["e1"]).otherwise(never))
        kept = before < end
        label = F.when(kept, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"])
        ends = [F.when(p == level, F.greatest(acc[f"e{level}"], end)).otherwise(acc[f"e{level}"]).alias(f"e{level}") for level in (1, 2, 3)]
        return F.struct(*ends, label.alias("labels"), F.when(kept, F.greatest(acc["score"], x["confidence"])).otherwise(acc["score"]).alias("score"), (acc["n_kept"] + kept.cast("int")).alias("n_kept"))

    final = F.aggregate("detections", start, take)
    rows = rows.withColumn("licenses", F.struct(final["labels"].alias("labels"), final["score"].alias("score"), final["n_kept"].alias("n_kept")))
    shown = F.transform("detections", lambda x: F.struct(x["start"].alias("start"), (-x["minus_end"]).alias("end"), (-x["minus_priority"]).alias("priority"), x["number"].alias("number"), x["label"].alias("label"), x["confidence"].alias("confidence"), x["base"].alias("base"), x["scope"].alias("scope")))
    return rows.withColumn("detections", shown).drop(padded, words)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    found = license_detections(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda x: x["base"])
    base_labels = F.transform(base, lambda x: x["label"])
    joined = lambda a: F.array_join(F.sort_array(F.array_distinct(a)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(F.concat(base_labels, "licenses.labels")).alias("labels"),
        F.col("licenses.score").alias("score"),
    )


def op2_sql(rules: list[Rule] | None = None) -> str:
    """The same result by joins and windows in SQL; the rules are the common input."""
    values = ",\n".join(f"({r.number}, '{r.keyword}', '{r.pattern}', '{r.before}', '{r.label}', {r.priority}, {r.confidence}, {r.base})" for r in rules or RULES)
    before = ", ".join(f"max(CASE WHEN priority >= {p} THEN ends END) OVER o AS before{p}" for p in (1, 2, 3))
    return f"""
WITH rules(number, keyword, pattern, before, label, priority, confidence, base) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT doc_id, words, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
m AS (
  SELECT w.doc_id, w.i AS starts, r.*, regexp_extract(array_to_string(w.words[w.i + 1 : w.i + {max(words_of(r.pattern) for r in rules or RULES)}], ' ') || ' ', r.pattern) AS found
  FROM w JOIN rules r ON w.word = r.keyword AND (r.before = '' OR regexp_matches(' ' || array_to_string(w.words[greatest(1, w.i - {BEHIND - 1}) : w.i], ' ') || ' ', r.before))),
h AS (SELECT *, starts + length(found) - length(replace(found, ' ', '')) AS ends FROM m WHERE found <> ''),
s AS (
  SELECT *, {before} FROM h
  WINDOW o AS (PARTITION BY doc_id ORDER BY starts, ends DESC, priority DESC, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, coalesce(CASE priority WHEN 1 THEN before1 WHEN 2 THEN before2 ELSE before3 END, -1) < ends AS kept FROM s),
a AS (
  SELECT doc_id, sum(CASE WHEN base THEN 1 ELSE 0 END) AS n_base, min(CASE WHEN base THEN starts END) AS first_word, max(CASE WHEN base THEN starts END) AS last_word,
         coalesce(string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END), '') AS base_labels,
         coalesce(string_agg(DISTINCT CASE WHEN base OR kept THEN label END, ',' ORDER BY CASE WHEN base OR kept THEN label END), '') AS labels,
         max(CASE WHEN kept THEN confidence ELSE 0 END) AS score
  FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (doc_id)
"""
