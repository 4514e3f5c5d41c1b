"""Licence scan by a positional index of rare tokens (operator 4), in DataFrame functions only.

Each licence template is a word sequence with mandatory key phrases. Corpus document frequencies give
every template word an IDF; a template's RARE highest-IDF words are its postings. A file's words are
looked up in the postings, and hits of one template that agree on the relative position (place in the
file minus place in the template) are added up. A place whose IDF weight reaches LEAST_SHARE of the
template's posting weight, and which holds a whole key phrase inside the template's span, gives the
template's label; the weight's share is its score. Base phrases are counted wherever their words stand
consecutively.

Defined results: a null or empty text has no words and no labels, score 0 and null first and last word;
repeated rows are scanned one by one; a tie between words of equal IDF goes to the earlier template
word; very long files and files with many hits are scanned whole; an empty table gives an empty result; other columns are
not read and may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twofold.llm.common import id_text, written

# Base phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Opening words of public licence notices, by label, with their mandatory key phrase.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted free of charge"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2", "general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "public domain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("proprietary", "copyright c all rights reserved no part of this may be reproduced without written permission", "all rights reserved"),
]
RARE = 6
LEAST_SHARE = 0.75

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary() -> list[str]:
    """All words that a template or base phrase holds; its size is that of the fixed tables above."""
    texts = [t for _, t, _ in TEMPLATES] + [k for _, _, k in TEMPLATES] + list(BASE)
    return sorted({w for t in texts for w in t.split()})


def posting_rows() -> list[tuple[int, str, int, str, int]]:
    """(template, kind, start offset, word, words in all): t for template words, k for key-phrase words."""
    rows = []
    for n, (_, text, key) in enumerate(TEMPLATES):
        for kind, part in (("t", text), ("k", key)):
            words = part.split()
            rows += [(n, kind, i, w, len(words)) for i, w in enumerate(words)]
    return rows


def scanned(docs: DataFrame, **cols: str) -> DataFrame:
    """One row per file: word count, its template words with their places, and the base places."""
    words = id_text(docs, **cols).select(
        "doc_id", F.split(F.translate("text", UPPER, LOWER), BREAK).alias("parts")
    )
    words = words.select("doc_id", F.filter("parts", lambda w: w != "").alias("words"))
    known = [F.lit(w) for w in vocabulary()]
    held = words.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(
            F.transform("words", lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("p"))), lambda x: x["w"].isin(*known)
        ).alias("hits"),
    )

    def starts(words: list[str]):
        def test(x: F.Column, i: F.Column) -> F.Column:
            found = x["w"] == words[0]
            for k, word in enumerate(words[1:], 1):
                nxt = F.get("hits", i + k)
                found = found & F.coalesce((nxt["w"] == word) & (nxt["p"] == x["p"] + k), F.lit(False))
            return found

        return test

    for n, phrase in enumerate(BASE):
        held = held.withColumn(f"base{n}", F.transform(F.filter("hits", starts(phrase.split())), lambda x: x["p"]))
    return held


def license_scan(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every file."""
    spark: SparkSession = docs.sparkSession
    files = written(scanned(docs, **cols), "licence-hits")
    places = files.select("row", F.explode("hits").alias("x")).select("row", F.col("x.w").alias("word"), F.col("x.p").alias("p"))
    found_in = places.groupBy("row", "word").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count("*").alias("df"))
    schema = T.StructType.fromDDL("template int, kind string, off long, word string, size long")
    postings = spark.createDataFrame(posting_rows(), schema)
    total = files.agg(F.count("*").alias("n_files"))
    weighed = (  # a few hundred rows: the fixed templates
        postings.join(F.broadcast(found_in), "word", "left").crossJoin(F.broadcast(total))
        .withColumn("idf", F.log((F.col("n_files") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0)
        .withColumn(
            "rank",
            F.row_number().over(_by("template", "kind").orderBy(F.desc("idf"), "off")),
        )
        .where((F.col("kind") == "k") | (F.col("rank") <= RARE))
        .withColumn("whole", F.sum("idf").over(_by("template", "kind")))
        .select("template", "kind", "off", "word", "size", "idf", "whole", F.count("*").over(_by("template", "kind")).alias("n_postings"))
    )
    aligned = (
        places.join(F.broadcast(weighed), "word")
        .groupBy("row", "template", "kind", (F.col("p") - F.col("off")).alias("at"))
        .agg(
            F.sum("idf").alias("weight"), F.count("*").alias("n"), F.first("whole").alias("whole"),
            F.first("size").alias("size"), F.first("n_postings").alias("n_postings"),
        )
        .withColumn("share", F.least(F.col("weight") / F.col("whole"), F.lit(1.0)))
        .where(F.when(F.col("kind") == "k", F.col("n") == F.col("n_postings")).otherwise(F.col("share") >= LEAST_SHARE))
    )
    sizes = {n: len(t.split()) for n, (_, t, _) in enumerate(TEMPLATES)}
    key_len = {n: len(k.split()) for n, (_, _, k) in enumerate(TEMPLATES)}
    label_of = F.create_map(*[F.lit(v) for n, (label, _, _) in enumerate(TEMPLATES) for v in (n, label)])
    room = F.create_map(*[F.lit(v) for n in sizes for v in (n, sizes[n] - key_len[n])])
    per_file = aligned.groupBy("row").agg(
        F.collect_list(F.when(F.col("kind") == "t", F.struct("template", "at", "share"))).alias("ts"),
        F.collect_list(F.when(F.col("kind") == "k", F.struct("template", "at"))).alias("ks"),
    )
    verified = per_file.select(
        "row",
        F.filter(
            "ts",
            lambda t: F.exists(
                "ks",
                lambda k: (k["template"] == t["template"]) & k["at"].between(t["at"], t["at"] + room[t["template"]]),
            ),
        ).alias("ts"),
    ).select(
        "row",
        F.transform("ts", lambda t: label_of[t["template"]]).alias("named"),
        F.array_max(F.transform("ts", lambda t: t["share"])).alias("share"),
    )
    base = [f"base{n}" for n in range(len(BASE))]
    all_places = F.concat(*base)
    base_labels = F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(base, BASE.values(), strict=True)])
    base_labels = F.array_sort(F.array_distinct(F.array_compact(base_labels)))
    out = files.select("row", "doc_id", "n_words", all_places.alias("places"), base_labels.alias("base"))
    return out.join(verified, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("named", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.round(F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce("share", F.lit(0.0))), 6).alias("score"),
    )


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def license_sql() -> str:
    """The same scan in DuckDB SQL."""
    rows = ", ".join(f"({n}, '{k}', {i}, '{w}', {s})" for n, k, i, w, s in posting_rows())
    names = ", ".join(f"({n}, '{label}', {len(t.split()) - len(key.split())})" for n, (label, t, key) in enumerate(TEMPLATES))
    base = " union all ".join(
        "select a.row, a.p, '{0}' as label from hits a {1} where a.word = '{2}'".format(
            label,
            " ".join(f"join hits h{i} on h{i}.row = a.row and h{i}.p = a.p + {i} and h{i}.word = '{w}'" for i, w in enumerate(phrase.split()[1:], 1)),
            phrase.split()[0],
        )
        for phrase, label in BASE.items()
    )
    known = ", ".join(f"'{w}'" for w in vocabulary())
    return f"""
with files as (
  select row_number() over () as row, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), lambda w: w <> '') as words
  from documents),
places as (select row, unnest(words) as word, unnest(range(len(words))) as p from files),
hits as (select * from places where word in ({known})),
postings(template, kind, off, word, size) as (values {rows}),
named(template, label, room) as (values {names}),
df as (select word, count(distinct row) as df from hits group by 1),
weighed as (
  select template, kind, off, p.word, ln(((select count(*) from files) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 as idf
  from postings p left join df on df.word = p.word),
ranked as (select *, row_number() over (partition by template, kind order by idf desc, off) as rank from weighed),
picked as (
  select *, sum(idf) over (partition by template, kind) as whole, count(*) over (partition by template, kind) as n_postings
  from ranked where kind = 'k' or rank <= {RARE}),
aligned as (
  select row, template, kind, p - off as at, least(sum(idf) / any_value(whole), 1.0) as share, count(*) as n, any_value(n_postings) as n_postings
  from hits join picked using (word) group by all
  having (kind = 'k' and count(*) = any_value(n_postings)) or (kind = 't' and sum(idf) / any_value(whole) >= {LEAST_SHARE})),
verified as (
  select distinct t.row, label, t.share from aligned t join named using (template)
  join aligned k on k.row = t.row and k.template = t.template and k.kind = 'k' and k.at between t.at and t.at + room
  where t.kind = 't'),
based as ({base}),
b as (select row, count(*) as n_base, min(p) as first_word, max(p) as last_word, string_agg(distinct label, ',' order by label) as base_labels from based group by 1),
l as (select row, string_agg(distinct label, ',' order by label) as labels, from (select row, label from verified union select row, label from based) group by 1),
s as (select row, max(share) as share from verified group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       round(greatest(case when n_base > 0 then 1.0 else 0.0 end, coalesce(share, 0.0)), 6)::double as score
from files left join b using (row) left join l using (row) left join s using (row)
"""
