"""License notices in documents, by ordered signature rules.

A text is reduced to its words in lower case with one space between. A rule is a signature (a
regular expression over these words), two keywords, a label and a priority. Rules are gated twice: a text
without the words that some rule needs is passed over before anything is made of it, and a rule
runs only on texts with both its keywords. What the
rules find are intervals of the text. They are put in order of place, longest first, then by
priority; an interval that lies within an earlier one is suppressed, so "cc by nc 4 0" is not also
a "cc by". The labels of what remains, and the base labels, are the document's.

The rules are a table of license names, versions and ways to put them, from which the signatures
are made. Names that are ordinary words or products, too (general public, python, apache), count
only beside the word license, after "licensed under" or in an SPDX line, so that prose about them
has no label. Everything is built from DataFrame functions.

Base labels are those of three phrases and always stay. Null or empty text has no words, no labels
and a score of 0. Null ids, repeated ids and equal rows each give a row with their own result; other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallylog.functions.binding import computed_once
from tallylog.llm.shared import row_key, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything that is not in a word, before and after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Names of licenses as label, the words of the name, versions, and the keyword.
NAMED = (
    ("mit", "mit", "", "mit"),
    ("mit", "expat", "", "expat"),
    ("apache", "apache(?: software)?", "1.0 1.1 2.0", "apache"),
    ("gpl", "(?:gnu )?general public", "1 2 3", "general public"),
    ("gpl", "(?:gnu )?gpl", "1 2 3", "gpl"),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "2 2.1 3", "general public"),
    ("lgpl", "(?:gnu )?lgpl", "2 2.1 3", "lgpl"),
    ("agpl", "(?:gnu )?affero general public", "1 3", "affero"),
    ("agpl", "(?:gnu )?agpl", "1 3", "agpl"),
    ("gfdl", "(?:gnu )?free documentation", "1.1 1.2 1.3", "free documentation"),
    ("bsd", "(?:berkeley software distribution|bsd)", "", "bsd"),
    ("bsd", "(?:bsd [0-4] clause|[0-4] clause bsd)", "", "clause"),
    ("mpl", "mozilla public", "1.0 1.1 2.0", "mozilla"),
    ("mpl", "mpl", "1.0 1.1 2.0", "mpl"),
    ("epl", "eclipse public", "1.0 2.0", "eclipse"),
    ("cddl", "common development and distribution", "1.0 1.1", "common development"),
    ("cpl", "common public", "1.0", "common public"),
    ("eupl", "european union public", "1.0 1.1 1.2", "european union"),
    ("eupl", "eupl", "1.0 1.1 1.2", "eupl"),
    ("isc", "isc", "", "isc"),
    ("zlib", "zlib(?: libpng)?", "", "zlib"),
    ("bsl", "boost software", "1.0", "boost"),
    ("artistic", "artistic", "1.0 2.0", "artistic"),
    ("osl", "open software", "1.0 2.0 2.1 3.0", "open software"),
    ("afl", "academic free", "1.2 2.0 2.1 3.0", "academic free"),
    ("ofl", "(?:sil )?open font", "1.0 1.1", "open font"),
    ("ncsa", "(?:university of illinois )?ncsa", "", "ncsa"),
    ("php", "php", "3.0 3.01", "php"),
    ("python", "python(?: software foundation)?", "2.0", "python"),
    ("postgresql", "postgresql", "", "postgresql"),
    ("ruby", "ruby", "", "ruby"),
    ("openssl", "openssl", "", "openssl"),
    ("wtfpl", "wtfpl", "", "wtfpl"),
    ("wtfpl", "do what the fuck you want to public", "", "do what"),
    ("unlicense", "unlicense", "", "unlicense"),
    ("ms-pl", "microsoft public", "", "microsoft"),
    ("ms-rl", "microsoft reciprocal", "", "microsoft"),
    ("cecill", "cecill", "1.0 2.0 2.1", "cecill"),
    ("odbl", "open (?:data commons open )?database", "1.0", "database"),
    ("ecl", "educational community", "1.0 2.0", "educational community"),
    ("upl", "universal permissive", "1.0", "universal permissive"),
    ("bsl-source", "business source", "1.0 1.1", "business source"),
    ("sspl", "server side public", "1", "server side"),
    ("elastic", "elastic", "2.0", "elastic"),
    ("vim", "vim", "", "vim"),
    ("x11", "x11", "", "x11"),
    ("beerware", "beerware", "", "beerware"),
    ("blue-oak", "blue oak model", "1.0.0", "blue oak"),
    ("mulan", "mulan (?:psl|permissive software)", "1 2", "mulan"),
)
#: Names above that mean nothing but a license. The others are words or products, too, and count only
#: with the word license beside them.
OWN_NAMES = {
    "(?:gnu )?gpl", "(?:gnu )?lgpl", "(?:gnu )?agpl", "mpl", "eupl", "cecill", "wtfpl", "unlicense", "(?:sil )?open font",
    "(?:bsd [0-4] clause|[0-4] clause bsd)", "do what the fuck you want to public", "common development and distribution",
    "(?:gnu )?affero general public", "(?:gnu )?(?:lesser|library) general public",
}
# Creative Commons terms, as label and words, and their versions.
COMMONS = (("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("by-nc", "by nc", "attribution non ?commercial"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("by", "by", "attribution"))
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
# Sentences from license texts, as label, signature and keyword.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "with or without fee"),
    ("bsd", "redistributions? and use in source and binary forms", "source and binary"),
    ("apache", "you may not use this file except in compliance with the license", "in compliance with"),
    ("gpl", "you can redistribute it and or modify it under the terms", "redistribute it"),
    ("cc0", "cc0", "cc0"),
    ("cc0", "no rights reserved", "rights reserved"),
    ("cc0", "creative commons zero", "creative commons"),
    ("public-domain", "(?:released into|dedicated to|in) the public domain", "public domain"),
    ("all-rights-reserved", "all rights reserved", "rights reserved"),
    ("unlicense", "this is free and unencumbered software", "unencumbered"),
    ("zlib", "this software is provided as is without any express or implied warranty", "express or implied"),
    ("boost", "permission is hereby granted free of charge to any person or organization", "hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public", "source code form"),
)

LICENSE = "licen[cs]e"
#: How sure each kind of signature is; also the order among intervals with the same bounds.
SENTENCE, VERSIONED, PLAIN, LOOSE = 0.95, 0.9, 0.8, 0.6


@dataclass(frozen=True)
class Rule:
    """`signature` matches whole words; `keyword` at the start of a word and `form` anywhere are
    text without which it cannot match."""

    label: str
    signature: str
    keyword: str
    weight: float
    form: str = ""


def signature_rules() -> list[Rule]:
    """All rules, from the surest to the loosest."""
    rules = [Rule(label, words, keyword, SENTENCE) for label, words, keyword in SENTENCES]
    for label, name, versions, keyword in NAMED:
        own = name in OWN_NAMES
        under = rf"(?:{LICENSE}d|released|distributed|available|published)" if own else rf"{LICENSE}d"
        for version in versions.split():
            number = version.replace(".", " ")
            tail = rf"(?: version| v)? ?{number}(?: or (?:any )?later(?: version)?)?"
            said = f"{name}(?: {LICENSE})?" if own else f"{name} {LICENSE}"
            rules.append(Rule(f"{label}-{version}", said + tail, keyword, VERSIONED, "" if own else "licen"))
            if not own:
                rules.append(Rule(f"{label}-{version}", rf"{under}(?: \S+)? under (?:the |an )?{name}{tail}", keyword, VERSIONED, "under"))
        rules += [
            Rule(label, rf"{name} (?:public )?{LICENSE}", keyword, PLAIN, "licen"),
            Rule(label, rf"spdx {LICENSE} identifier {name}", keyword, PLAIN, "spdx"),
            Rule(label, rf"{under}(?: \S+)? under (?:the |an )?{name}", keyword, LOOSE, "under"),
        ]
        if own:
            rules.append(Rule(label, rf"under the terms of (?:the |an )?{name}", keyword, LOOSE, "under"))
    for label, short, full in COMMONS:
        for version in COMMONS_VERSIONS.split():
            number = version.replace(".", " ")
            rules.append(Rule(f"cc-{label}-{version}", rf"cc {short} {number}", "cc by", VERSIONED))
            rules.append(Rule(f"cc-{label}-{version}", rf"creative commons {full}(?: {number}| (?:international|unported)(?: {LICENSE})?(?: version)? {number})", "creative commons", VERSIONED))
        rules.append(Rule(f"cc-{label}", rf"cc {short}", "cc by", PLAIN))
        rules.append(Rule(f"cc-{label}", rf"creative commons {full}", "creative commons", PLAIN))
    return sorted(rules, key=lambda r: -r.weight)


RULES = signature_rules()


def _any_of(words: set[str]) -> str:
    """A pattern that matches any of the words, shared beginnings being tried once. A space
    matches whatever stands between two words."""
    if "" in words:
        return ""
    by_first: dict[str, set[str]] = {}
    for word in words:
        by_first.setdefault(word[0], set()).add(word[1:])
    ways = [("[^a-z0-9]+" if c == " " else c) + _any_of(rest) for c, rest in sorted(by_first.items())]
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


#: Forms (each the beginning of a word in its signatures), and keywords of rules without a form.
#: A text in lower case without any of these matches no rule and no base phrase.
GATE = "(?<![a-z0-9])" + _any_of({r.form or r.keyword for r in RULES})


def _phrase(words: str) -> str:
    return f"(?<= )(?:{words})(?= )"


def _gated(text: Column) -> Column:
    return F.lower(text).rlike(GATE)  # beyond A-Z, lower can only let more through


def _spaced(text: Column) -> Column:
    """The words of a text in lower case with a space around each."""
    words = F.trim(F.regexp_replace(text, BETWEEN, " "))
    return F.translate(F.concat(F.lit(" "), words, F.lit(" ")), UPPER, LOWER)


def detections(docs: DataFrame) -> DataFrame:
    """What the rules find and containment does not suppress: doc_id, the row's key, label, weight,
    found (the words), start and end (characters in the spaced words)."""
    text = whole_text()
    gated = docs.where(_gated(text)).select(
        F.col("doc_id").cast("long").alias("doc_id"), *row_key(), _spaced(text).alias("low")
    )
    gated = computed_once(gated).withColumn("row", F.monotonically_increasing_id())
    by_keyword: dict[str, list[Column]] = {}
    for rank, r in enumerate(RULES):
        rule = F.struct(
            F.lit(r.label).alias("label"),
            F.lit(_phrase(r.signature)).alias("signature"),
            F.lit(" " + r.form if r.form else "").alias("form"),
            F.lit(r.weight).alias("weight"),
            F.lit(rank).alias("rank"),
        )
        by_keyword.setdefault(r.keyword, []).append(rule)
    table = F.array(
        *[F.struct(F.lit(" " + k).alias("keyword"), F.array(*v).alias("rules")) for k, v in by_keyword.items()]
    )
    low = F.col("low")
    active = F.flatten(
        F.transform(
            F.filter(table, lambda g: low.contains(g["keyword"])),
            lambda g: F.filter(g["rules"], lambda r: low.contains(r["form"])),
        )
    )
    with_rules = computed_once(gated.withColumn("active", active))
    runs = with_rules.select("doc_id", "k_id", "k_th", "row", "low", F.explode("active").alias("rule"))
    matched = computed_once(
        runs.select(
            "doc_id", "k_id", "k_th", "row", "rule",
            F.regexp_extract_all("low", F.col("rule.signature"), F.lit(0)).alias("found"),
            F.transform(F.split(low, F.col("rule.signature")), lambda x: F.length(x)).alias("gaps"),
        )
    )
    places = matched.where(F.size("found") > 0).select(
        "doc_id", "k_id", "k_th", "row",
        *[F.col(f"rule.{c}").alias(c) for c in ("label", "weight", "rank")],
        F.posexplode(F.arrays_zip(F.col("found"), F.slice("gaps", F.lit(1), F.size("found")).alias("gaps"))).alias("nth", "place"),
    )
    # the k-th match starts behind the first k gaps and the matches in front of it
    in_rule = Window.partitionBy("row", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("place.gaps") + F.length("place.found")).over(in_rule)
    spans = places.withColumn("end", end).withColumn("start", F.col("end") - F.length("place.found"))
    in_row = Window.partitionBy("row").orderBy("start", F.col("end").desc(), "rank")
    reached = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    kept = spans.withColumn("reached", reached).where(F.col("reached").isNull() | (F.col("reached") < F.col("end")))
    return kept.select("doc_id", "k_id", "k_th", "label", "weight", F.col("place.found").alias("found"), "start", "end")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels and score (how sure the surest remaining rule is, 0 without one)."""
    text = whole_text()
    parts = F.split(text, BETWEEN)
    first, last = F.get(parts, F.lit(0)) == "", F.element_at(parts, -1) == ""
    n_words = F.size(parts) - first.cast("int") - (last & (F.size(parts) > 1)).cast("int")
    low = F.when(_gated(text), _spaced(text)).otherwise(" ")
    rows = computed_once(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), *row_key(), n_words.cast("long").alias("n_words"), low.alias("low")
        )
    )
    found = rows.select(
        "doc_id", "k_id", "k_th", "n_words",
        *[F.split("low", _phrase(phrase)).alias(f"_{label}") for phrase, label in BASE],
    )
    found = computed_once(found)

    def times(label: str) -> Column:
        return (F.size(f"_{label}") - 1).cast("long")

    def words_in(part: Column) -> Column:
        """Words of a part that begins and ends with a space."""
        return F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit(""))) - 1

    firsts, lasts = [], []
    for phrase, label in BASE:
        parts = F.col(f"_{label}")
        firsts.append(F.when(times(label) > 0, words_in(F.get(parts, F.lit(0)))))
        after = words_in(F.element_at(parts, -1)) + len(phrase.split())
        lasts.append(F.when(times(label) > 0, F.col("n_words") - after))
    base_labels = F.array_compact(F.array(*[F.when(times(label) > 0, label) for _, label in BASE]))
    base = found.select(
        "doc_id", "k_id", "k_th", "n_words",
        (times("mit") + times("apache") + times("gpl")).alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.sort_array(base_labels).alias("_base"),
    )
    # one row per text; labels are no more than the rules have
    per_text = detections(docs).groupBy("k_id", "k_th").agg(
        F.collect_set("label").alias("_labels"), F.max("weight").alias("_weight")
    )
    labels = F.array_union("_base", F.coalesce("_labels", F.array().cast("array<string>")))
    return base.join(per_text, ["k_id", "k_th"], "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.sort_array(labels), ",").alias("labels"),
        F.greatest(F.coalesce("_weight", F.lit(0.0)), F.when(F.size("_base") > 0, PLAIN).otherwise(0.0)).alias("score"),
    )
