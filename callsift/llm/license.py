"""Licence scan by a positional rare-token index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsift.llm.tables import stored, whole_text

# Everything that separates words: all ASCII but digits and letters (fixed value).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases and labels of the contract (fixed values): every place counts.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

# Further templates (fixed wordings of public licences): label, wording, and the key phrase that must be there whole.
TEMPLATES = (
    (
        "apache-2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org"
        " licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is"
        " distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "http www apache org licenses license 2 0",
    ),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
        " disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation",
        "gnu general public license as published by the free software foundation",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files the software to deal in the software without restriction including without limitation the rights to use copy modify"
        " merge publish distribute sublicense and or sell copies of the software",
        "to deal in the software without restriction",
    ),
    ("agpl-3.0", "gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    ("bsd", "licensed under the bsd license", "bsd license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
)

# Least share of a template's weight that has to be in place.
MIN_SHARE = 0.5


def _postings() -> list[tuple[int, str, str, bool, int, bool]]:
    """(template, label, word, is base, offset, belongs to the key phrase) of every template word."""
    listed = [(label, phrase, phrase, True) for label, phrase in BASE.items()]
    listed += [(label, wording, key, False) for label, wording, key in TEMPLATES]
    rows = []
    for at, (label, wording, key, base) in enumerate(listed):
        words, keys = wording.split(), key.split()
        first = next(i for i in range(len(words)) if words[i : i + len(keys)] == keys)
        for offset, word in enumerate(words):
            rows.append((at, label, word, base, offset, first <= offset < first + len(keys)))
    return rows


def lower_ascii(column: Column | str) -> Column:
    """A-Z in lower case, all other characters as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(column, upper, upper.lower())


def positional_index(spark: SparkSession, idf: DataFrame) -> DataFrame:
    """Template postings with integer IDF weights and totals, as large as the templates.

    ``rank`` orders the words of each key phrase by falling IDF, on a tie by offset
    (a base phrase is its own key phrase); it is null for the other words.
    """
    schema = "template int, label string, word string, base boolean, offset int, key boolean"
    postings = spark.createDataFrame(_postings(), schema).join(F.broadcast(idf), "word")
    whole = Window.partitionBy("template")
    ranked = Window.partitionBy("template").orderBy(F.desc("key"), F.desc("weight"), "offset")
    return postings.select(
        "*",
        F.when(F.col("key"), F.row_number().over(ranked)).alias("rank"),
        F.sum("weight").over(whole).alias("total"),
        F.count("*").over(whole).alias("n_template"),
        F.sum(F.col("key").cast("int")).over(whole).alias("n_key"),
    )


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find licence notices in whole texts.

    1. Each text is split once; the positions of its licence words are kept.
    2. The IDF of each licence word comes from all documents.
    3. A template is looked for in the files that have all words of its key phrase,
       from the rarest of them on: that word's places in the file, less its offset,
       are the template's possible starts.  Every accepted notice has its whole key
       phrase, so none is missed whatever other words were changed or cut.
    4. The postings of the file's other licence words are intersected with these
       starts by relative position (position less offset).  Words farther from a
       rarest word than a template is long take no part.
    5. A base phrase counts where all its words are in place.  A template adds
       its label where its key phrase is whole and at least :data:`MIN_SHARE` of
       its IDF weight is in place.

    Returns one row per input row: ``doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score``; score is the largest share of an
    accepted template's weight in place (1 for a whole one), 0 without any.
    Null counts as the empty text: no words, empty labels, null positions.
    Repeated rows are separate rows.  Other columns are ignored.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    vocabulary = sorted({word for _, _, word, *_ in _postings()})
    words = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.filter(F.split(whole_text(text_col), SEPARATORS), lambda w: w != "").alias("words"),
    )

    def licensed(word: Column) -> Column:
        # lower() also folds letters outside ASCII; the second test undoes that.
        return F.lower(word).isin(vocabulary) & lower_ascii(word).isin(vocabulary)

    spots = F.filter(
        F.transform("words", lambda w, i: F.when(licensed(w), F.struct(i.alias("at"), lower_ascii(w).alias("word")))),
        lambda spot: spot.isNotNull(),
    )
    found = words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), spots.alias("spots"))

    files = stored(
        found.select(
            "row",
            "doc_id",
            "n_words",
            F.array_distinct(F.transform("spots", lambda s: s["word"])).alias("seen"),
            "spots",
        ),
        "license-words",
    )

    n = files.agg(F.count("*")).scalar()
    frequency = files.select(F.explode("seen").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    all_words = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    idf = all_words.join(frequency, "word", "left").select(
        "word",
        F.round(1000 * F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).cast("long").alias("weight"),
    )
    index = positional_index(spark, idf)

    # One word and the key phrase of each template.
    rarest = {r["template"]: r["word"] for r in index.where("rank = 1").select("template", "word").collect()}
    keys: dict[int, set[str]] = {}
    for template, _, word, base, _, key in _postings():
        if base or key:
            keys.setdefault(template, set()).add(word)
    reach = max(offset for *_, offset, _ in _postings())

    keyed = F.array(
        *[
            F.struct(
                F.lit(t).alias("template"),
                F.array(*[F.lit(w) for w in sorted(keys[t], key=lambda w: (w != rarest[t], w))]).alias("words"),
            )
            for t in sorted(keys)
        ]
    )
    whole_key = F.filter(keyed, lambda t: F.forall(t["words"], lambda w: F.array_contains(F.col("seen"), w)))
    templates = F.transform(whole_key, lambda t: t["template"])
    held = files.select("row", "spots", templates.alias("templates")).where(F.size("templates") > 0)
    anchors = sorted(set(rarest.values()))

    def near_anchor(spot: Column, i: Column) -> Column:
        # Spots stand in order, so those within reach are at most as many places away.
        around = F.slice("spots", F.greatest(i + 1 - reach, F.lit(1)), F.lit(2 * reach + 1))
        return F.exists(around, lambda s: s["word"].isin(anchors) & (F.abs(s["at"] - spot["at"]) <= reach))

    kept = held.select("row", "templates", F.filter("spots", near_anchor).alias("spots"))
    spots = kept.select("row", "templates", F.explode("spots").alias("spot")).select("row", "templates", "spot.at", "spot.word")
    hits = (
        spots.join(F.broadcast(index), "word")
        .where(F.array_contains(F.col("templates"), F.col("template")))
        .withColumn("start", F.col("at") - F.col("offset"))
    )
    starts = hits.groupBy("row", "template", "start").agg(
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.max(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("anchored"),
        F.count("*").alias("n"),
        F.first("n_template").alias("n_template"),
        F.sum(F.col("key").cast("int")).alias("in_key"),
        F.first("n_key").alias("n_key"),
        (F.sum("weight") / F.first("total")).alias("share"),
    )
    whole_base = F.col("base") & (F.col("n") == F.col("n_template"))
    accepted = starts.where(
        F.col("anchored")
        & (whole_base | (~F.col("base") & (F.col("in_key") == F.col("n_key")) & (F.col("share") >= MIN_SHARE)))
    )
    base_start = F.when(F.col("base"), F.col("start").cast("long"))

    def listed(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(labels)), ",")

    notices = accepted.groupBy("row").agg(
        F.count(base_start).alias("n_base"),
        F.min(base_start).alias("first_word"),
        F.max(base_start).alias("last_word"),
        listed(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        listed(F.col("label")).alias("labels"),
        F.max("share").alias("score"),
    )
    none = F.lit("")
    return files.select("row", "doc_id", "n_words").join(notices, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def oracle(table: str = "documents") -> str:
    """The same result as DuckDB SQL: every start of every template is judged, without any rarest word."""
    rows = ", ".join(
        f"({t}, '{label}', '{word}', {base}, {offset}, {key})" for t, label, word, base, offset, key in _postings()
    )
    return rf"""
with postings(template, label, word, base, ofs, iskey) as (values {rows}),
docs as (select row_number() over () as r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '{SEPARATORS}'), lambda w: w <> '') as ws from documents),
words as (
  select r, i - 1 as pos,
    translate(ws[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as word
  from docs, unnest(range(1, len(ws) + 1)) as u(i)),
spots as (select * from words where word in (select word from postings)),
weights as (
  select v.word, cast(round(1000 * ln(((select count(*) from docs) + 1) / (count(distinct s.r) + 1)) + 1) as bigint) as weight
  from (select distinct word from postings) v left join spots s on s.word = v.word group by v.word),
idx as (
  select p.*, w.weight,
    sum(weight) over (partition by template) as total, count(*) over (partition by template) as nt,
    sum(iskey::int) over (partition by template) as nk
  from postings p join weights w on w.word = p.word),
starts as (
  select r, template, pos - ofs as start, any_value(label) as label, any_value(base) as base,
    count(*) as n, any_value(nt) as nt, sum(iskey::int) as ik, any_value(nk) as nk,
    sum(weight)::double / any_value(total)::double as share
  from spots join idx on idx.word = spots.word group by r, template, pos - ofs),
accepted as (
  select * from starts where (base and n = nt) or (not base and ik = nk and share >= {MIN_SHARE})),
notices as (
  select r, sum(base::int) as n_base, min(case when base then start end) as first_word,
    max(case when base then start end) as last_word,
    coalesce(string_agg(distinct case when base then label end, ',' order by case when base then label end), '') as base_labels,
    string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from accepted group by r)
select doc_id, len(ws) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from docs left join notices on notices.r = docs.r"""
