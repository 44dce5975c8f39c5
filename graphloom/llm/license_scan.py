"""License scans: sparse TF-IDF cosine to templates, and inheritance along paths.

Sentences of a file that name a licence are compared with short licence templates
by the cosine of their TF-IDF vectors; words that no template has get the highest
weight.  So are blocks, whatever words they have: the whole file, each run of up
to `RUN` paragraphs, and each longer run whose paragraphs are mostly words of one long
licence, without comment marks and copyright lines, with full licence
texts, standard headers and titles, counts taken by their logarithms.  A match that
names none of the versions that its template names is none.  An SPDX-License-Identifier line is
taken at its word with score 1, as written but for the case of known ids.  A file's
own licence is its best match at `least` (blocks: `LEAST_BLOCK`) or more.  A directory
has the licence of its licence files (those whose name begins with LICENSE or
COPYING); other files without a licence of their own inherit from the nearest
directory above them that has one.  Everything is DataFrame work: vectors are
rows, the cosine is a join and a sum.

Rules: very long texts are rows of paragraphs, so the work is linear in them; a null or empty text has no licence of its own; a null path has no
directory and inherits nothing; of equal scores the smaller name wins, of several
licence files in one directory the best score, then the smaller path; repeated
rows come back once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import license_texts, sparkkit

#: Identifiers and the sentences that licences ask files to carry.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LEAST = 0.6
#: Least cosine of blocks, and the paragraphs of a run up to which each run is a block.
LEAST_BLOCK, RUN = 0.75, 8
#: Of a longer run: paragraphs in a row that may be other text, and the least share of a licence's words, by weight, in the others.
GAP, SHARE = 2, 0.6
#: Paragraphs of a text that are looked at in one row.
STRETCH = 64
_PARAGRAPH = r"\n[ \t\r]*\n\s*"
_NAMES = r"licen[sc]e|copyright|public domain|spdx"
_SENTENCE = r"[\n\r]+|(?<=[.!?])[ \t]+"
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_VERSION = r"\b(?:version|v\.?|by(?:-[a-z]+)*|attribution(?:-[a-z]+)*|cc0|(?:[al]?gpl|mpl)(?:v| v\.?|-)?)\s*(\d+(?:\.\d+)*)"
_SPDX = r"(?i)spdx-license-identifier:[ \t]*(\(*[a-z0-9][a-z0-9.+:-]*\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9][a-z0-9.+:-]*\)*)*)"
_SPDX_IDS = "Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause 0BSD CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC0-1.0 ISC MIT MIT-0 MPL-1.1 MPL-2.0 Unlicense Zlib Artistic-1.0 Artistic-2.0 BSL-1.0 EPL-1.0 EPL-2.0".split() + [
    f"{name}{end}" for name in "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0".split() for end in ("", "+", "-only", "-or-later")
]
_COMMENT_END = r"(?m)^([ \t]*(?:#|//|;|--).*)\n(?![ \t]*(?:#|//|;|--))"
_CLOSE = r"\*/|-->"
_MARKS = r"(?m)^[ \t]*(?://+!?|/\*+!?|\*+|#+|--+|;+|<!--+)?[ \t\r]*"
_RIGHTS = r"(?im)^[ \t]*(?:portions )?copyright (?:\(c\)|©|\d|<).*$|^[ \t]*all rights reserved\.?[ \t]*$"

#: Where the query supposes the documents: sources and languages are folders, every 16th file is a licence file.
DOCUMENT_PATH = "concat(source, '/', if(doc_id % 160 = 0, '', concat(lang, '/', doc_id % 8, '/')), if(doc_id % 16 = 0, 'LICENSE-', 'doc-'), doc_id, '.txt')"


def _tokens(text):
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _vectors(rows: DataFrame, key: list[str], idf: DataFrame, unseen) -> DataFrame:
    """(key, token, w) of rows (key, text); unseen is the weight of words without one in idf."""
    tf = rows.select(*key, F.explode(_tokens(F.col("text"))).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("tf"))
    return tf.join(F.broadcast(idf), "token", "left").select(*key, "token", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))


def _versions(text):
    """The version numbers that a text names, 2.0 as 2."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(_VERSION), F.lit(1)), lambda v: F.regexp_replace(v, r"(\.0)+$", "")))


def _same_versions(said, template):
    return (F.size(template) == 0) | F.arrays_overlap(said, template)


def _best(scores: DataFrame) -> DataFrame:
    best = scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("id", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _table(templates: list[tuple[str, str]], least: float) -> tuple[list, dict, float, list]:
    """Rows (template, license, token, tw, tn), weights of tokens, of all others, and words one of which any match has.

    A block without the words of a template that make more than 1 - least ** 2 of its
    squared length has a cosine under least, so asking for one of them loses nothing.
    Short words are taken last, as other texts have them most.
    """
    counts = [Counter(re.findall(_TOKEN, re.sub(_RIGHTS, "", text).lower())) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    rows, words = [], set()
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        w = {t: (1 + math.log(m)) * idf[t] for t, m in c.items()}
        square, held = sum(x * x for x in w.values()), 0.0
        rows += [(k, name, t, x, math.sqrt(square)) for t, x in w.items()]
        for t in sorted(w, key=lambda t: (len(t) < 5, -w[t], t)):
            if held > (1 - least**2) * square * (1 + 1e-5):
                break
            words.add(t)
            held += w[t] ** 2
    return rows, idf, math.log(1 + n) + 1, sorted(words)


def _reachable(text, idf: dict, unseen: float, least: float):
    """False only where a text has too many words of no template for a cosine of least with any.

    Its squared length over other words is unseen ** 2 for each at least; that over known
    words is greatest when their counts are even, taken apart for common and rare ones.
    """
    groups = [F.array(*[F.lit(t) for t, x in idf.items() if (x > 2) == rare]) for rare in (False, True)]
    most = lambda own, rest, n, top: own * top**2 * F.pow(1 + F.log(F.greatest(F.lit(1.0), (n - rest) / F.greatest(F.lit(1.0), own))), 2)

    def judged(x):
        other = x['words'] - x['common'] - x['rare']
        return most(x['common'], other + x['rare'], x['n'], 2.0) + most(x['rare'], other + x['common'], x['n'], max(idf.values())) >= other * (unseen**2 * least**2 / (1 - least**2))

    def counted(tokens):
        words = F.array_distinct(tokens)
        sizes = {"n": F.size(tokens), "words": F.size(words), "common": F.size(F.array_intersect(words, groups[0])), "rare": F.size(F.array_intersect(words, groups[1]))}
        return F.struct(*[x.cast("double").alias(c) for c, x in sizes.items()])

    return F.exists(F.transform(F.array(_tokens(text)), counted), judged)  # each part is worked out once


def block_matches(files: DataFrame, least: float = LEAST_BLOCK) -> DataFrame:
    """(id, license, score): the best full text, header or title in a block of each file (id, text), where it reaches least."""
    spark, templates = files.sparkSession, license_texts.templates()
    rows, idf, unseen, words = _table(templates, least - 1e-6)
    table = spark.createDataFrame(rows, "template int, license string, token string, tw double, tn double")
    versions = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(templates)], "template int, text string").select("template", _versions(F.col("text")).alias("tv"))
    weights = spark.createDataFrame(list(idf.items()), "token string, idf double")
    gate = lambda text: F.arrays_overlap(_tokens(text), F.array(*map(F.lit, words)))

    text = F.regexp_replace(F.regexp_replace("text", _COMMENT_END, "$1\n\n"), _CLOSE, "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, _MARKS, ""), _RIGHTS, "")
    parts = files.where(gate(F.col("text"))).select("id", F.xxhash64("text").alias("row"), F.filter(F.split(text, _PARAGRAPH), lambda p: F.trim(p) != "").alias("parts"))
    parts = sparkkit.stored(parts).where("size(parts) > 0")  # texts are searched and taken apart once
    key = ["id", "row", "at", "n"]
    # runs: stretches of a text, each in a row of its own, then the paragraphs from each one on, joined to texts of one, two and more
    stretches = F.transform(F.sequence(F.lit(0), F.expr(f"(size(parts) - 1) div {STRETCH}")), lambda k: F.slice("parts", k * STRETCH + 1, STRETCH + RUN - 1))
    stretched = lambda df: df.select("id", "row", F.posexplode(stretches).alias("k", "some"))
    apart = stretched(parts.where(f"size(parts) > {8 * STRETCH}")).repartition("id", "row", "k")  # a long text's are dealt to many tasks
    some = stretched(parts.where(f"size(parts) <= {8 * STRETCH}")).union(apart)
    ahead = F.transform(F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.size("some"))), lambda k: F.slice("some", k, RUN))
    some = some.select("id", "row", "k", F.posexplode(ahead).alias("i", "some"))
    runs = some.select("id", "row", F.expr(f"{STRETCH} * k + i").alias("at"), F.posexplode(F.transform("some", lambda _, k: F.array_join(F.slice("some", 1, k + 1), "\n"))).alias("n", "text"))
    full = parts.where(f"size(parts) > {RUN}").select("id", "row", F.lit(-1).alias("at"), F.lit(-1).alias("n"), F.array_join("parts", "\n").alias("text"))
    blocks = runs.union(full)
    blocks = sparkkit.cut(blocks.where(gate(F.col("text"))).where(_reachable(F.col("text"), idf, unseen, least - 1e-6))).distinct()
    counts = blocks.select(*key, F.explode(_tokens(F.col("text"))).alias("token")).groupBy(*key, "token").agg(F.count("*").alias("n_token"))
    said = blocks.select(*key, _versions(F.col("text")).alias("v"))
    long_counts, long_said = _long_runs(parts, rows, weights, unseen, least - 1e-6)
    tf = counts.union(long_counts).select(*key, "token", (F.log(F.col("n_token").cast("double")) + 1).alias("tf"))
    vectors = sparkkit.cut(tf.join(F.broadcast(weights), "token", "left").select(*key, "token", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("w")))
    norms = vectors.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vectors.join(F.broadcast(table), "token").groupBy(*key, "template", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.max("tn").alias("tn"))
    scores = dots.join(norms, key).select(*key, "template", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tn")), 6).alias("score")).where(F.col("score") >= least)
    scores = scores.join(said.union(long_said), key).join(F.broadcast(versions), "template")
    return _best(scores.where(_same_versions(F.col("v"), F.col("tv"))))


def _long_runs(parts: DataFrame, rows: list[tuple], weights: DataFrame, unseen: float, least: float) -> tuple[DataFrame, DataFrame]:
    """Runs of more than RUN paragraphs, of any length: those in which all but up to `GAP` paragraphs in a row are mostly
    words of one long template.  (id, row, at, n, token, n_token), and (id, row, at, n, v).

    Only texts with as many words of a long template as a match at `least` must have are looked at.
    Words are counted by paragraph; a run's counts are the sums of its paragraphs'.
    """
    spark, key, run = parts.sparkSession, ["id", "row"], ["id", "row", "at", "n"]
    long = [k for k, (_, text) in enumerate(license_texts.templates()) if len([p for p in re.split(_PARAGRAPH, text) if p.strip()]) > RUN]
    table = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] in long], "template int, token string")
    tokens, enough = F.array_distinct(_tokens(F.array_join("parts", "\n"))), []
    for k in long:
        own = sorted(((x, t) for template, _, t, x, _ in rows if template == k), reverse=True)
        square, held, needed = sum(x * x for x, _ in own), 0.0, 0
        while held < least**2 * square:  # no fewer words make that much of the template
            held += own[needed][0] ** 2
            needed += 1
        enough.append((F.array(*[F.lit(t) for _, t in own]), needed))
    able = F.exists(F.array(tokens), lambda t: reduce(or_, [F.size(F.array_intersect(t, own)) >= needed for own, needed in enough]))  # words are found once
    texts = parts.where(f"size(parts) > {RUN}").where(able).select(*key, "parts").dropDuplicates(key)
    pieces = sparkkit.cut(texts.select(*key, F.posexplode("parts").alias("at", "text")))
    words = pieces.select(*key, "at", F.explode(_tokens(F.col("text"))).alias("token")).groupBy(*key, "at", "token").agg(F.count("*").alias("n_token"))
    heavy = words.join(F.broadcast(weights), "token", "left").groupBy(*key, "at").agg(F.sum(F.coalesce("idf", F.lit(unseen))).alias("all"))
    known = table.join(weights, "token")
    own = words.join(F.broadcast(known), "token").groupBy(*key, "at", "template").agg(F.sum("idf").alias("own"))
    near = own.join(heavy, [*key, "at"]).where(F.col("own") >= SHARE * F.col("all"))
    w = Window.partitionBy(*key, "template").orderBy("at")
    near = near.withColumn("fresh", (F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(GAP + 2)) > GAP + 1).cast("int")).withColumn("k", F.sum("fresh").over(w))
    found = near.groupBy(*key, "template", "k").agg(F.min("at").alias("first"), F.max("at").alias("last")).where(f"last - first >= {RUN}")
    found = sparkkit.cut(found.select(*key, F.col("first").alias("at"), (F.col("last") - F.col("first")).alias("n")).distinct())
    each = found.select(*key, "at", "n", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n"))).alias("place"))
    place = lambda df: df.withColumnRenamed("at", "place")
    counts = each.join(place(words), [*key, "place"]).groupBy(*run, "token").agg(F.sum("n_token").alias("n_token"))
    said = each.join(place(pieces.select(*key, "at", F.explode(_versions(F.col("text"))).alias("v"))), [*key, "place"], "left").groupBy(*run).agg(F.collect_set("v").alias("v"))
    return counts.select(*run, "token", "n_token"), said.select(*run, "v")


def declared(files: DataFrame) -> DataFrame:
    """(id, license, score): what SPDX-License-Identifier lines declare; of several rows, the smallest."""
    said = files.select("id", F.regexp_replace(F.regexp_extract("text", _SPDX, 1), r"[ \t]+", " ").alias("license")).where("license <> ''")
    known = F.create_map(*[F.lit(x) for i in _SPDX_IDS for x in (i.lower(), i)])
    tidy = F.transform(F.split("license", " "), lambda p: F.when(F.lower(p).isin("and", "or", "with"), F.upper(p)).otherwise(F.coalesce(F.try_element_at(known, F.lower(p)), p)))
    return _best(said.select("id", F.array_join(tidy, " ").alias("license"), F.lit(1.0).alias("score")))


def matches(files: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, license, score): the best template of each file (id, text), where it reaches least.

    templates (license, text) are a short fixed list; they go to all executors.
    """
    n = F.lit(templates.count())
    words = templates.select("license", F.explode(F.array_distinct(_tokens(F.col("text")))).alias("token"))
    idf = words.groupBy("token").agg((F.log((1 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    unseen = F.log((1 + n) / F.lit(1)) + 1
    template = _vectors(templates, ["license"], idf, unseen)
    template = template.join(template.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "license").select("license", "token", F.col("w").alias("tw"), F.col("norm").alias("tn"))

    named = F.filter(F.split("text", _SENTENCE), lambda s: F.lower(s).rlike(_NAMES))
    said = sparkkit.cut(files.where(F.lower("text").rlike(_NAMES)).select("id", F.posexplode(named).alias("k", "text")))
    vectors = sparkkit.cut(_vectors(said, ["id", "k"], idf, unseen))
    norms = vectors.groupBy("id", "k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = vectors.join(F.broadcast(template), "token").groupBy("id", "k", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.max("tn").alias("tn"))
    scores = dots.join(norms, ["id", "k"]).select("id", "k", "license", F.round(F.col("dot") / (F.col("norm") * F.col("tn")), 6).alias("score")).where(F.col("score") >= least)
    scores = scores.join(said.select("id", "k", _versions(F.col("text")).alias("v")), ["id", "k"]).join(F.broadcast(templates.select("license", _versions(F.col("text")).alias("tv"))), "license")
    return _best(scores.where(_same_versions(F.col("v"), F.col("tv"))))


def inherited(files: DataFrame, owned: DataFrame) -> DataFrame:
    """(dir, from_dir, license): the licence that files in each directory inherit, nearest first.

    files has path; owned has path and license and score of those with a licence of their own.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    holds = owned.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike("^(LICENSE|COPYING)")).withColumn("dir", folder)
    w = Window.partitionBy("dir").orderBy(F.desc("score"), "path")
    holds = holds.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("dir").alias("from_dir"), F.col("license"))
    dirs = files.where("path is not null").select(folder.alias("dir")).distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("depth", "from_dir"))
    found = above.join(holds, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "license")).alias("m"))
    return found.select("dir", "m.from_dir", F.col("m.license").alias("inherited"))


def scan(files: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id_col, path, own_license, own_score, license, from_dir) for each row of files.

    from_dir is set where the licence is inherited from that directory.  Rows of one id share their matches.
    """
    given = templates is not None
    templates = templates if given else files.sparkSession.createDataFrame(list(TEMPLATES), "license string, text string")
    base = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("text"))
    known = base.where("id is not null")
    own = matches(known, templates, least)
    if not given:  # templates of one's own stand alone
        own, spdx = _best(own.union(block_matches(known.select("id", "text")))), declared(known)
        own = own.join(spdx, "id", "left_anti").union(spdx)
    own = sparkkit.cut(own)
    slim = base.select("id", "path").join(own, "id", "left")
    up = inherited(slim, slim.where("license is not null and path is not null"))
    out = slim.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).join(up, "dir", "left")
    return out.select(F.col("id").alias(id_col), "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.coalesce("license", "inherited").alias("license"), F.when(F.col("license").isNull(), F.col("from_dir")).alias("from_dir"))


def oracle() -> str:
    """DuckDB SQL for scan() over documents with DOCUMENT_PATH."""
    rows = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)
    n = len(TEMPLATES)
    path = DOCUMENT_PATH.replace("if(doc_id % 160 = 0, '', concat(lang, '/', doc_id % 8, '/'))", "CASE WHEN doc_id % 160 = 0 THEN '' ELSE concat(lang, '/', doc_id % 8, '/') END").replace("if(doc_id % 16 = 0, 'LICENSE-', 'doc-')", "CASE WHEN doc_id % 16 = 0 THEN 'LICENSE-' ELSE 'doc-' END")
    return f"""
WITH templates(license, text) AS (VALUES {rows}),
words AS (SELECT license, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS token FROM templates),
idf AS (SELECT token, ln((1 + {n}) / (1 + count(DISTINCT license))) + 1 AS idf FROM words GROUP BY token),
tv AS (SELECT license, token, count(*) * any_value(idf) AS tw FROM words JOIN idf USING (token) GROUP BY license, token),
tn AS (SELECT license, sqrt(sum(tw * tw)) AS tn FROM tv GROUP BY license),
files AS (SELECT doc_id, {path} AS path, text FROM documents),
lines AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), '[\\n\\r]+')) AS text FROM files),
said AS (SELECT doc_id, row_number() OVER () AS k, text FROM lines WHERE regexp_matches(lower(text), '{_NAMES}')),
tf AS (SELECT doc_id, k, token, count(*) AS tf FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) AS token FROM said) GROUP BY ALL),
v AS (SELECT doc_id, k, token, tf * coalesce(idf, ln(1 + {n}) + 1) AS w FROM tf LEFT JOIN idf USING (token)),
norms AS (SELECT doc_id, k, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id, k),
scores AS (SELECT doc_id, k, license, round(sum(w * tw) / (any_value(norm) * any_value(tn)), 6) AS score FROM v JOIN tv USING (token) JOIN tn USING (license) JOIN norms USING (doc_id, k) GROUP BY doc_id, k, license),
own AS (SELECT doc_id, license, score FROM scores WHERE score >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) = 1),
slim AS (SELECT doc_id, path, license, score, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM files LEFT JOIN own USING (doc_id)),
holds AS (SELECT dir AS from_dir, license AS inherited FROM slim WHERE license IS NOT NULL AND regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^(LICENSE|COPYING)') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path) = 1),
up AS (SELECT d.dir, h.from_dir, h.inherited FROM (SELECT DISTINCT dir FROM slim) d JOIN holds h ON d.dir = h.from_dir OR starts_with(d.dir, h.from_dir || '/') QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(h.from_dir) DESC) = 1)
SELECT doc_id, path, license AS own_license, score AS own_score, coalesce(license, inherited) AS license, CASE WHEN license IS NULL THEN from_dir END AS from_dir FROM slim LEFT JOIN up USING (dir)
"""
