"""Licences of files: TF-IDF cosine of notices to templates, and inheritance from the nearest directory above with a licence file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeolis.llm.common import stage, without

# Licence names (SPDX) and their usual short notices; a name may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("all-rights-reserved", "All rights reserved."),
)
#: A line that holds one of these is a notice; a file of such a name is a licence file and counts as a whole as well.
ANCHOR = "licen[cs]e|copyright|rights reserved|hereby granted|permitted"
LICENCE_FILE = "(^|/)(LICEN[CS]E|COPYING|NOTICE)[^/]*$"
LEAST = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != "")


def template_terms(spark: SparkSession) -> DataFrame:
    rows = [(name, nth, text) for nth, (name, text) in enumerate(TEMPLATES)]
    words = spark.createDataFrame(rows, "license string, template int, text string").select("license", "template", F.explode(terms(F.col("text"))).alias("term"))
    return words.groupBy("license", "template", "term").agg(F.count("*").alias("tf"))


def scan(files: DataFrame, least: float = LEAST) -> DataFrame:
    """``files`` with license, score, origin and inherited_from.

    Every line of the whole text that holds an anchor word is a notice; so is a whole licence file. A notice and a template
    are vectors of term counts times ln((files + 1) / (files with the term + 1)) + 1; terms that no template has weigh as if no
    file had them. A file's own licence is the template of the largest cosine, if that is ``least`` or more (ties: the first name);
    score is that cosine (NULL without a notice). A file without one inherits from the licence files with a licence in the nearest
    directory above it, its own included: there the largest score decides, then the first path. origin is own, inherited or NULL.

    NULL text counts as empty; a NULL path has no directory and inherits nothing. Repeated rows are files of their own. Other
    columns are kept, except those of these names. An empty table gives an empty result.
    """
    spark = files.sparkSession
    base = without(files, ["license", "score", "origin", "inherited_from", "_fid"]).withColumn("_fid", F.monotonically_increasing_id())
    text = F.coalesce("text", F.lit(""))
    shapes = template_terms(spark)
    vocabulary = [r["term"] for r in shapes.select("term").distinct().collect()]  # terms of the fixed templates
    total = base.count()
    present = F.array_intersect(terms(text), F.array(*map(F.lit, vocabulary)))
    df = base.select(F.explode(present).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = shapes.select("term").distinct().join(df, "term", "left")
    idf = stage(idf.select("term", (F.log(F.lit(total + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).alias("idf")), "license-idf")
    unseen = F.log(F.lit(total + 1.0)) + 1.0

    licence_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, UPPER, LOWER).rlike(ANCHOR))
    notices = base.select("_fid", F.explode(F.when(licence_file, F.concat(lines, F.array(text))).otherwise(lines)).alias("notice"))
    notices = stage(notices.distinct().withColumn("nid", F.monotonically_increasing_id()), "license-notices")
    counted = notices.select("nid", F.explode(terms(F.col("notice"))).alias("term")).groupBy("nid", "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(idf, "term", "left").select("nid", "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    model = shapes.join(idf, "term").select("license", "template", "term", (F.col("tf") * F.col("idf")).alias("v"))
    norms = weighed.groupBy("nid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    lengths = model.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    dots = weighed.join(model, "term").groupBy("nid", "license", "template").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosines = dots.join(norms, "nid").join(lengths, "template").select("nid", "license", F.round(F.col("dot") / F.col("norm") / F.col("length"), 9).alias("score"))
    best = cosines.join(notices.select("nid", "_fid"), "nid").groupBy("_fid", "license").agg(F.max("score").alias("score"))
    best = best.groupBy("_fid").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    own = base.select("_fid", "path").join(best, "_fid", "left").select("_fid", "path", F.when(-F.col("b.s") >= least, F.col("b.license")).alias("license"), (-F.col("b.s")).alias("score"))
    own = stage(own, "license-own")

    # The directories above every file, nearest last; the root is the empty path.
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    above = F.transform(F.sequence(F.lit(0), F.size(folders)), lambda n: F.array_join(F.slice(folders, F.lit(1), n), "/"))
    given = own.where(F.col("license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).withColumn("dir", F.element_at(above, -1))
    given = given.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", F.col("license").alias("l"))).alias("g"))
    given = stage(given.select(F.col("dir").alias("inherited_from"), F.col("g.l").alias("given")), "license-given")
    open_ = own.where(F.col("license").isNull() & F.col("path").isNotNull())
    met = open_.select(F.col("_fid").alias("of"), F.posexplode(above).alias("depth", "dir")).join(given, F.col("dir") == F.col("inherited_from"))
    near = met.groupBy("of").agg(F.max(F.struct("depth", "inherited_from", "given")).alias("m"))
    out = base.join(own.select(F.col("_fid").alias("f"), F.col("license").alias("mine"), "score"), F.col("_fid") == F.col("f")).join(near, F.col("_fid") == F.col("of"), "left")
    origin = F.when(F.col("mine").isNotNull(), "own").when(F.col("m").isNotNull(), "inherited")
    named = out.withColumn("license", F.coalesce("mine", "m.given")).withColumn("origin", origin).withColumn("inherited_from", F.col("m.inherited_from"))
    return without(named, ["_fid", "f", "of", "m", "mine"])


def documents_as_files(docs: DataFrame) -> DataFrame:
    """doc_id, path, text: documents laid out as source/lang/hundred/id; those that open with a notice stand for licence files, put
    at one of the three levels by their id."""
    opens = F.coalesce(F.translate(F.split(F.col("text"), "\n")[0], UPPER, LOWER).rlike(ANCHOR), F.lit(False))
    levels = F.array(F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("-")))
    depth = F.when(opens, F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)) + 1).otherwise(3).cast("int")
    name = F.concat(F.when(opens, "LICENSE.").otherwise("text."), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    return docs.select("doc_id", "text", F.concat_ws("/", F.slice(levels, F.lit(1), depth), name).alias("path"))


def scanned_documents(docs: DataFrame) -> DataFrame:
    return scan(documents_as_files(docs)).select("doc_id", "path", "license", F.round("score", 6).alias("score"), "origin", "inherited_from")


def oracle(least: float = LEAST) -> str:
    values = ", ".join(f"({n}, '{name}', '{text}')" for n, (name, text) in enumerate(TEMPLATES))
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    words = lambda x: f"list_filter(regexp_split_to_array({low(x)}, '[^a-z0-9]+'), lambda t: t <> '')"
    return f"""
WITH t AS (SELECT * FROM (VALUES {values}) v(template, license, text)),
tt AS (SELECT license, template, term, count(*) AS tf FROM (SELECT license, template, unnest({words("text")}) AS term FROM t) GROUP BY ALL),
d0 AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '-') AS s, coalesce(lang, '-') AS l, coalesce(CAST(floor(doc_id / 100.0) AS BIGINT)::VARCHAR, '-') AS h,
       coalesce(regexp_matches({low("string_split(text, chr(10))[1]")}, '{ANCHOR}'), false) AS opens FROM documents),
f AS (SELECT row_number() OVER () AS fid, doc_id, text,
      CASE WHEN NOT opens THEN s || '/' || l || '/' || h WHEN coalesce(doc_id % 3, 0) = 0 THEN s WHEN doc_id % 3 = 1 THEN s || '/' || l ELSE s || '/' || l || '/' || h END AS dir,
      CASE WHEN opens THEN 'LICENSE.' ELSE 'text.' END || coalesce(doc_id::VARCHAR, '-') AS name, opens FROM d0),
n AS (SELECT count(*) AS n FROM f),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_intersect(list_distinct({words("text")}), (SELECT list(DISTINCT term) FROM tt))) AS term FROM f) GROUP BY term),
idf AS (SELECT term, ln(((SELECT n FROM n) + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term)),
c0 AS (SELECT DISTINCT fid, unnest(list_concat(list_filter(string_split(text, chr(10)), lambda x: regexp_matches({low("x")}, '{ANCHOR}')), CASE WHEN opens THEN [text] ELSE [] END)) AS notice FROM f),
c AS (SELECT row_number() OVER () AS nid, * FROM c0),
ct AS (SELECT nid, term, count(*) AS tf FROM (SELECT nid, unnest({words("notice")}) AS term FROM c) GROUP BY ALL),
w AS (SELECT nid, term, tf * coalesce(idf, ln((SELECT n FROM n) + 1.0) + 1.0) AS w FROM ct LEFT JOIN idf USING (term)),
m AS (SELECT license, template, term, tf * idf AS v FROM tt JOIN idf USING (term)),
nn AS (SELECT nid, sqrt(sum(w * w)) AS norm FROM w GROUP BY nid),
ll AS (SELECT template, sqrt(sum(v * v)) AS len FROM m GROUP BY template),
dd AS (SELECT nid, license, template, sum(w * v) AS dot FROM w JOIN m USING (term) GROUP BY ALL),
cc AS (SELECT fid, license, max(round(dot / norm / len, 9)) AS score FROM dd JOIN nn USING (nid) JOIN ll USING (template) JOIN c USING (nid) GROUP BY fid, license),
b AS (SELECT fid, max(score) AS score, first(license ORDER BY score DESC, license) AS license FROM cc GROUP BY fid),
o AS (SELECT f.*, score, CASE WHEN score >= {least} THEN license END AS mine FROM f LEFT JOIN b USING (fid)),
g AS (SELECT dir AS place, first(mine ORDER BY score DESC, dir || '/' || name) AS given FROM o WHERE mine IS NOT NULL AND opens GROUP BY dir),
a AS (SELECT fid, unnest(range(1, len(string_split(dir, '/')) + 1)) AS depth, dir FROM o WHERE mine IS NULL),
x AS (SELECT fid, first(place ORDER BY depth DESC) AS place, first(given ORDER BY depth DESC) AS given
      FROM a JOIN g ON g.place = array_to_string(string_split(a.dir, '/')[1:depth], '/') GROUP BY fid)
SELECT doc_id, dir || '/' || name AS path, coalesce(mine, given) AS license, round(score, 6) AS score,
       CASE WHEN mine IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' END AS origin, place AS inherited_from
FROM o LEFT JOIN x USING (fid)"""
