"""Queries over dictionary entries and upkeep: cleaning, filters and scores of terms, small relational forms, gates.

Entries are the assistant's turns: the last word of a turn is the term, the turn its definition.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexigrid.functions import entries as e
from lexigrid.operators import analytics, maintenance
from lexigrid.operators.pairs import new_pairs as pairs_of_new
from lexigrid.plans.frames import ANSWERS, DAILY, NEW, OLD, _answers, _old_new
from lexigrid.sources.tables import table, tokens

LAST_WORD = r"(\p{L}+)[^\p{L}]*$"
THRESHOLD = 0.3


def _entries(spark: SparkSession, d: str) -> DataFrame:
    said = table(spark, d, "conversations").where("role = 'assistant'")
    return said.select("conv_id", "turn", F.lower(F.regexp_extract("text", LAST_WORD, 1)).alias("term"), F.col("text").alias("definition"))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens(table(spark, d, "documents"), "doc_id").groupBy(F.col("word").alias("term")).agg(F.count("*").alias("n"))


def clean_prose(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(e.clean_prose(F.col("text")), 256).alias("digest"))


def pos_prefix(spark, d):
    """Every turn behind an abbreviation or a bracket that its number gives."""
    mark = F.element_at(F.array(*(F.lit(x) for x in ("n. ", "(v) ", "adj: ", "adv, ", "see (noun) ", ""))), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)).cast("int") + 1)
    return _entries(spark, d).select("conv_id", "turn", e.pos_prefix(F.concat(mark, F.col("definition"))).alias("pos"))


def foreign_terms(spark, d):
    return _counts(spark, d).where(e.foreign_script(F.col("term"))).select("term", "n")


def excluded_pos(spark, d):
    tag = F.element_at(F.array(*(F.lit(x) for x in ("NOUN", "PUNCT", "PROPN", "NUM", ""))), F.pmod(F.length("term"), F.lit(5)) + 1)
    return _counts(spark, d).select("term", e.excluded_pos(F.col("term"), tag).alias("excluded"))


def derived_adverbs(spark, d):
    """Words in -ly whose root is a word of the documents as well: a semi join on the root."""
    c = _counts(spark, d)
    roots = c.select(F.col("term").alias("root"))
    return c.select("term", e.adverb_root(F.col("term")).alias("root")).where("root IS NOT NULL").join(roots, "root", "left_semi").select("term", "root")


def manner_definitions(spark, d):
    odd = F.when(F.pmod("conv_id", F.lit(3)) == 0, F.concat(F.lit("In a "), F.col("term"), F.lit(" manner; "), F.col("definition"))).otherwise(F.col("definition"))
    return _entries(spark, d).select("conv_id", "turn", e.adverb_of_manner(F.concat("term", F.lit("ly")), odd).alias("by_manner"))


def estimated_zipf(spark, d):
    return _counts(spark, d).select("term", F.round(e.estimated_zipf(F.col("term")), 6).alias("zipf"))


def suggested_definitions(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("NOUN", "ADJECTIVE", "ADVERB"))), F.pmod(F.length("term"), F.lit(3)) + 1)
    return _counts(spark, d).select("term", F.array_join(e.suggested_definitions(F.col("term"), kind), " | ").alias("suggested"))


def etymologies(spark, d):
    """The etymology and the quotes of every document."""
    quotes = e.examples(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce(e.etymology(F.col("text")), F.lit("-")), 256).alias("etymology"), F.size(quotes).cast("long").alias("quotes"))


def quality_score(spark, d):
    x = _entries(spark, d)
    score = e.quality_score(F.col("term"), F.col("definition"), e.etymology(F.col("definition")).isNotNull(), F.size(e.examples(F.col("definition"))) > 0)
    return x.select("conv_id", "turn", F.round(score, 6).alias("score"))


def utility_score(spark, d):
    x = _entries(spark, d)
    labels = F.array_compact(F.array(*(F.when(F.contains("definition", F.lit(t)), t) for t, _ in e.LABEL_SCORES)))
    part = F.element_at(F.array(F.lit("noun"), F.lit("name"), F.lit("verb")), F.pmod(F.length("term"), F.lit(3)) + 1)
    score = e.utility_score(F.col("term"), F.col("definition"), part, labels, e.etymology(F.col("definition")), F.col("turn") > 1, F.col("term").rlike("^(un|re|pre)|(ness|ful|less)$"))
    return x.select("conv_id", "turn", F.round(score, 6).alias("score"))


def book_text(spark, d):
    """Documents as books: their own text behind a licence, between marks."""
    mark = F.when(F.pmod("doc_id", F.lit(2)) == 0, e.BOOK_STARTS[0]).otherwise(e.BOOK_STARTS[4])
    book = F.concat(F.lit("Free text.\n"), mark, F.lit(" ***\n\nby\n\n"), F.col("text"), F.lit("\n_____\n"), F.lit(e.BOOK_ENDS[0]), F.lit(" ***\nmore"))
    return table(spark, d, "documents").select("doc_id", F.sha2(e.book_text(book), 256).alias("digest"))


def quarantine(spark, d):
    """Turns without a long text go to a table of their own, which has some of them already; both tables, marked."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    bad, good = maintenance.move(c, F.length(F.trim("text")) < 80)
    before = bad.where("conv_id % 2 = 0").withColumn("text", F.lit("earlier"))
    held = maintenance.insert_ignore(before, bad, ["conv_id", "turn"], [F.col("text").asc()])
    mark = lambda x, name: x.select("conv_id", "turn", F.sha2("text", 256).alias("digest"), F.lit(name).alias("place"))
    return mark(held, "quarantine").union(mark(good, "stays"))


def like_patterns(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(*(F.count_if(F.col("p_name").like(x)).alias(n) for n, x in (("spaced", "% %"), ("final", "%e"), ("initial", "P%"), ("one", "_art%"))))


def mastery_by_domain(spark, d):
    """Accuracy by domain, from a table of words and their domains: whether a word's values are above the mean of all; words without one are left out."""
    answers = _answers(spark, d)
    a = analytics.accuracy_by(answers, "user_id", "word")
    mean = F.broadcast(answers.agg(F.avg("value").alias("mean")))  # one row
    means = answers.where("word <> 'search'").groupBy("word").agg(F.avg("value").alias("own")).join(mean, F.lit(True))
    domains = means.select("word", F.when(F.col("own") >= F.col("mean"), "high").otherwise("low").alias("domain"))
    return a.join(domains, "word").groupBy("domain").agg(F.count("*").alias("items"), F.round(F.avg("accuracy"), 6).alias("accuracy"))


def items_with_domain(spark, d):
    """Orders with their customers, and the nation where there is one in the region asked for: inner and left joins."""
    nation = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, "c_nationkey", "left").select("o_orderkey", "c_name", "n_name")


def left_join_on(spark, d):
    """Each part with its lines of 49 pieces and more; the condition is part of the join, so all parts stay."""
    p, li = table(spark, d, "part"), table(spark, d, "lineitem")
    return p.join(li, (F.col("p_partkey") == F.col("l_partkey")) & (F.col("l_quantity") >= 49), "left").select("p_partkey", "l_orderkey", "l_linenumber")


def version_difference(spark, d):
    old, new = _old_new(spark, d)
    gap = F.abs(F.col("n") - F.col("o_totalprice"))
    return old.join(new.select("o_orderkey", F.col("o_totalprice").alias("n")), "o_orderkey").agg(F.count("*").alias("both"), F.round(F.max(gap), 6).alias("largest"), F.round(F.avg(gap), 6).alias("mean"))


def last_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("day").desc())
    return analytics.daily(_answers(spark, d)).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("user_id", "day", "total", "place")


SORTS = {"alpha": ("term",), "rare": ("n", "term"), "frequent": ("-n", "term"), "frequent_z": ("-n", "-term"), "long": ("-size", "term")}


def sort_options(spark, d):
    """The first twenty words by each order of the list."""
    c, out = _counts(spark, d).withColumn("size", F.length("term")), None
    for name, keys in SORTS.items():
        order = [F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]
        part = c.orderBy(*order).limit(20).select(F.lit(name).alias("sort"), "term", "n")
        out = part if out is None else out.union(part)
    return out


def random_row_of_set(spark, d):
    """One part of each brand, by a seeded hash."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("5"))).alias("key"))
    return p.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("key", "p_partkey")).alias("p_partkey"))


def question_mix(spark, d):
    """Of each user five right and five wrong answers, in a seeded order without repeats."""
    a = _answers(spark, d).withColumn("key", F.md5(F.concat(F.col("event_id").cast("string"), F.lit("9"))))
    w = Window.partitionBy("user_id", "correct").orderBy("key", "event_id")
    return a.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("user_id", "event_id", "correct", "place")


def outliers(spark, d):
    """Rare, frequent, long rare and short rare words, by quantiles of their counts; thirty each."""
    c = _counts(spark, d).withColumn("size", F.length("term"))
    low, mid, high = c.agg(F.percentile("n", F.array(F.lit(0.01), F.lit(0.05), F.lit(0.999)))).first()[0]
    lists = (("rare", F.col("n") <= low, [F.col("n"), F.col("term")]), ("frequent", F.col("n") >= high, [-F.col("n"), F.col("term")]), ("long_rare", (F.col("size") >= 12) & (F.col("n") <= mid), [-F.col("size"), F.col("n"), F.col("term")]), ("short_rare", F.col("size").between(3, 5) & (F.col("n") <= low), [F.col("n"), F.col("term")]))
    out = None
    for name, where, order in lists:
        part = c.where(where).orderBy(*order).limit(30).select(F.lit(name).alias("list"), "term", "n")
        out = part if out is None else out.union(part)
    return out


def json_source_means(spark, d):
    """Means by source of values kept as JSON maps: written, read again, exploded; corpus, nulls and what isn't positive don't count."""
    kept = table(spark, d, "events").select("user_id", F.to_json(F.create_map(F.col("event_type"), F.col("value"), F.lit("corpus"), F.lit(1.0), F.lit("none"), F.lit(0.0))).alias("scores"))
    each = kept.select(F.pmod("user_id", F.lit(10)).alias("domain"), F.explode(F.from_json("scores", "map<string,double>")).alias("source", "value"))
    return each.where("source <> 'corpus' AND value > 0").groupBy("domain", "source").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def new_pairs(spark, d):
    """Pairs of new vectors (one in ten) with all others: each pair once, the lesser id first."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return pairs_of_new(v.where("vec_id % 10 = 0"), v, "vec_id", "embedding", THRESHOLD).withColumn("score", F.round("score", 6))


def due_sources(spark, d):
    """Sources whose latest run failed, or lies an hour back at the time asked for; never run ones as well."""
    runs = table(spark, d, "events").select(F.concat_ws("-", "event_type", F.pmod("user_id", F.lit(20)).cast("string")).alias("source"), "ts", "event_id", (F.col("value") < 5).alias("failed"))
    known = runs.select("source").distinct().union(spark.createDataFrame([("never run",)], "source string"))
    return maintenance.due_sources(known, runs, "source", F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0]), hours=1)


def session_counters(spark, d):
    """Counters of sources over all sessions, and where each goes on: five before its last place."""
    runs = table(spark, d, "events").select("event_type", "event_id", F.floor("value").alias("found"))
    return runs.groupBy("event_type").agg(F.count("*").alias("visits"), F.sum("found").alias("found"), F.greatest(F.max("event_id") - 5, F.lit(0)).alias("resume_at"))


QUERIES = {f.__name__: f for f in (clean_prose, pos_prefix, foreign_terms, excluded_pos, derived_adverbs, manner_definitions, estimated_zipf, suggested_definitions, etymologies, quality_score, utility_score, book_text, quarantine, like_patterns, mastery_by_domain, items_with_domain, left_join_on, version_difference, last_sessions, sort_options, random_row_of_set, question_mix, outliers, json_source_means, new_pairs, due_sources, session_counters)}

ENTRIES = rf"SELECT conv_id, turn, lower(regexp_extract(text, '{LAST_WORD}', 1)) AS term, text AS definition FROM conversations WHERE role = 'assistant'"
COUNTS = r"SELECT term, count(*) AS n FROM (SELECT regexp_replace(unnest(string_split_regex(lower(text), '[ \t\n\r\f]+')), '[^\p{L}]', '', 'g') AS term FROM documents) WHERE length(term) > 1 GROUP BY 1"
_SPACED = r"[ \t\n\r\f]"
_DECOMPOSED = "x"
for _c in map(chr, [*range(0xAA, 0x180)]):
    if (_d := unicodedata.normalize("NFKD", _c)) != _c:
        _DECOMPOSED = f"replace({_DECOMPOSED}, chr({ord(_c)}), {' || '.join(f'chr({ord(x)})' for x in _d)})"
_ETYM = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({{}}, '{p}', 1), chr(32) || chr(9) || chr(10) || chr(13) || chr(12)), '')" for p in e.ETYMOLOGY) + ")"
_etymology = lambda column: _ETYM.replace("{}", column)
_QUOTES = "len(regexp_extract_all({}, '\"([^\"]+)\"', 1))"
_PREFIXED = "CASE " + " ".join(rf"WHEN regexp_matches(t, '^\(?{s}\.?\)?[ \t\n\r\f,:]') THEN '{n}'" for n, s in e.POS_PREFIXES) + r" ELSE upper(nullif(regexp_extract(t, '\((noun|verb|adjective|adverb)\)', 1), '')) END"
_SCRIPTS = "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in e.OTHER_SCRIPTS)
_SIGNS = " + ".join(f"CAST(({c}) AS INT)" for c in ("regexp_matches(term, '[aeiou]')", "len(regexp_extract_all(term, '[bcdfghjklmnpqrstvwxz]')) <= length(term) * 0.8", f"regexp_matches(term, '({'|'.join(e.WORD_ENDINGS)})$')", f"regexp_matches(term, '^({'|'.join(e.WORD_BEGINNINGS)})')", "true", "length(term) BETWEEN 3 AND 20"))
_SPECIAL = " ".join(f"WHEN suffix(term, '{end}'){f''' AND kind = '{kind}' ''' if kind else ''} THEN replace('{says}', '{{}}', left(term, length(term) - {len(end)}))" for end, kind, says in e.SUGGESTED)
_ALWAYS = ", ".join(f"'{s}'" for s in e.SUGGESTED_ALWAYS)
_SORTED = " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, term, n FROM c ORDER BY {', '.join(f'{k[1:]} DESC' if k.startswith('-') else k for k in keys)} LIMIT 20)".replace("size", "length(term)") for name, keys in SORTS.items())
_BOOK = "regexp_replace(substring(x, instr(x, s), instr(x, 'END OF THE PROJECT GUTENBERG EBOOK') - 4 - instr(x, s)), '^[^\\n]*(\\n[^\\n]*){0,3}', '')"
for _p, _n in ((r"\r\n", "chr(10)"), (r"\n\s*\n\s*\n+", "chr(10) || chr(10)"), (r"[ \t]+", "' '"), (r"_{5,}|-{5,}", "''"), (r"\n\s*[0-9]+\s*\n", "chr(10) || chr(10)")):
    _BOOK = f"regexp_replace({_BOOK}, '{_p}', {_n}, 'g')"

ORACLES = {
    "clean_prose": rf"SELECT doc_id, sha256(trim(regexp_replace({_DECOMPOSED}, '{_SPACED}+', ' ', 'g'), ' ')) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '{e.CITATIONS}', '', 'g'), '{e.KEPT_CHARACTERS.replace(chr(39), chr(39) * 2)}', ' ', 'g') AS x FROM documents)",
    "pos_prefix": f"SELECT conv_id, turn, {_PREFIXED} AS pos FROM (SELECT conv_id, turn, lower(concat(['n. ', '(v) ', 'adj: ', 'adv, ', 'see (noun) ', ''][(conv_id + turn) % 6 + 1], definition)) AS t FROM ({ENTRIES}))",
    "foreign_terms": f"SELECT term, n FROM ({COUNTS}) WHERE regexp_matches(term, '[{_SCRIPTS}]') OR regexp_matches(term, '{'|'.join(e.NOT_ENGLISH)}')",
    "excluded_pos": f"SELECT term, CASE WHEN p IN ('', 'PROPN', 'NUM') THEN true WHEN p = 'PUNCT' THEN NOT (length(term) >= 3 AND {_SIGNS} >= 3) ELSE false END AS excluded FROM (SELECT term, ['NOUN', 'PUNCT', 'PROPN', 'NUM', ''][length(term) % 5 + 1] AS p FROM ({COUNTS}))",
    "derived_adverbs": f"WITH c AS ({COUNTS}) SELECT term, root FROM (SELECT term, regexp_replace(left(term, length(term) - 2), 'i$', 'y') AS root FROM c WHERE suffix(term, 'ly') AND length(term) > 3) WHERE root IN (SELECT term FROM c)",
    "manner_definitions": rf"SELECT conv_id, turn, regexp_matches(lower(CASE WHEN conv_id % 3 = 0 THEN concat('In a ', term, ' manner; ', definition) ELSE definition END), '^in an? [\p{{L}}\p{{N}}_]+ (manner|way|fashion|form)') AS by_manner FROM ({ENTRIES})",
    "estimated_zipf": f"SELECT term, round(greatest(0.5, least(1.2, 0.8::DOUBLE + CASE WHEN length(term) <= 4 THEN 0.3 WHEN length(term) <= 8 THEN 0 WHEN length(term) <= 12 THEN -0.2 ELSE -0.4 END + CASE WHEN regexp_matches(term, '{'|'.join(e.TECHNICAL_PARTS)}') THEN -0.3 ELSE 0 END + CASE WHEN regexp_matches(term, '({'|'.join(e.COMMON_ENDS)})$') THEN 0.2 ELSE 0 END)), 6) AS zipf FROM ({COUNTS})",
    "suggested_definitions": f"SELECT term, array_to_string(list_filter([CASE {_SPECIAL} END, {_ALWAYS}], lambda x: x IS NOT NULL)[1:3], ' | ') AS suggested FROM (SELECT term, ['NOUN', 'ADJECTIVE', 'ADVERB'][length(term) % 3 + 1] AS kind FROM ({COUNTS}))",
    "etymologies": f"SELECT doc_id, sha256(coalesce({_etymology('text')}, '-')) AS etymology, least({_QUOTES.format('text')}, 3) AS quotes FROM documents",
    "quality_score": rf"SELECT conv_id, turn, round(greatest(0, least(10, 5.0::DOUBLE + CAST(length(term) BETWEEN 4 AND 15 AS INT) - CAST(NOT regexp_matches(term, '^\p{{L}}+$') AS INT) + CAST(n >= 30 AS INT) + CAST(n >= 100 AS INT) - 2 * CAST(n < 15 AS INT) + CAST({_etymology('definition')} IS NOT NULL AS INT) + CAST({_QUOTES.format('definition')} > 0 AS INT) + 0.5 * CAST(contains(definition, '.') AS INT))), 6) AS score FROM (SELECT *, length(definition) AS n FROM ({ENTRIES}))",
    "utility_score": f"SELECT conv_id, turn, round(greatest(0, least(10, 5.0::DOUBLE + CASE WHEN n BETWEEN 6 AND 12 THEN 1 WHEN n < 4 THEN -2 WHEN n > 15 THEN -1.5 ELSE 0 END + coalesce(CAST(length({_etymology('definition')}) > 50 AS INT), 0) + CAST(n % 3 <> 1 AS INT) + 0.5 * CAST(turn > 1 AS INT) + CAST(regexp_matches(term, '^(un|re|pre)|(ness|ful|less)$') AS INT) + {' + '.join(f'''{v} * CAST(contains(definition, '{t}') AS INT)''' for t, v in e.LABEL_SCORES)} + 0.5 * CAST(length(definition) > 30 AS INT) - 0.5 * CAST(regexp_matches(lower(definition), '{'|'.join(e.SCIENCES)}') AS INT))), 6) AS score FROM (SELECT *, length(term) AS n FROM ({ENTRIES}))",
    "book_text": f"SELECT doc_id, sha256(trim({_BOOK}, chr(32) || chr(9) || chr(10) || chr(13) || chr(12))) AS digest FROM (SELECT doc_id, s, concat('Free text.', chr(10), s, ' ***', chr(10), chr(10), 'by', chr(10), chr(10), text, chr(10), '_____', chr(10), '{e.BOOK_ENDS[0]}', ' ***', chr(10), 'more') AS x FROM (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN '{e.BOOK_STARTS[0]}' ELSE '{e.BOOK_STARTS[4]}' END AS s FROM documents))",
    "quarantine": "SELECT conv_id, turn, sha256(CASE WHEN bad AND conv_id % 2 = 0 THEN 'earlier' ELSE text END) AS digest, CASE WHEN bad THEN 'quarantine' ELSE 'stays' END AS place FROM (SELECT *, length(trim(text, ' ')) < 80 AS bad FROM conversations)",
    "like_patterns": "SELECT p_brand, count(*) FILTER (p_name LIKE '% %') AS spaced, count(*) FILTER (p_name LIKE '%e') AS final, count(*) FILTER (p_name LIKE 'P%') AS initial, count(*) FILTER (p_name LIKE '_art%') AS one FROM part GROUP BY 1",
    "mastery_by_domain": f"WITH d AS (SELECT word, CASE WHEN avg(value) >= (SELECT avg(value) FROM ({ANSWERS})) THEN 'high' ELSE 'low' END AS domain FROM ({ANSWERS}) WHERE word <> 'search' GROUP BY 1) SELECT domain, count(*) AS items, round(avg(a), 6) AS accuracy FROM (SELECT user_id, word, count(*) FILTER (correct) * 100.0::DOUBLE / count(*) AS a FROM ({ANSWERS}) GROUP BY 1, 2) JOIN d USING (word) GROUP BY 1",
    "items_with_domain": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON n_nationkey = c_nationkey",
    "left_join_on": "SELECT p_partkey, l_orderkey, l_linenumber FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity >= 49",
    "version_difference": f"SELECT count(*) AS both, round(max(abs(n.o_totalprice - o.o_totalprice)), 6) AS largest, round(avg(abs(n.o_totalprice - o.o_totalprice)), 6) AS mean FROM ({OLD}) o JOIN ({NEW}) n ON n.o_orderkey = o.o_orderkey",
    "last_sessions": f"SELECT user_id, day, total, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) AS place FROM ({DAILY})) WHERE place <= 10",
    "sort_options": f"WITH c AS ({COUNTS}) {_SORTED}",
    "random_row_of_set": "SELECT p_brand, arg_min(p_partkey, md5(concat(p_partkey, '5'))) AS p_partkey FROM part GROUP BY 1",
    "question_mix": f"SELECT user_id, event_id, correct, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, correct ORDER BY md5(concat(event_id, '9')), event_id) AS place FROM ({ANSWERS})) WHERE place <= 5",
    "outliers": f"WITH c AS ({COUNTS}), q AS (SELECT quantile_cont(n, [0.01, 0.05, 0.999]) AS q FROM c) SELECT * FROM (SELECT 'rare' AS list, term, n FROM c, q WHERE n <= q[1] ORDER BY n, term LIMIT 30) UNION ALL SELECT * FROM (SELECT 'frequent' AS list, term, n FROM c, q WHERE n >= q[3] ORDER BY n DESC, term LIMIT 30) UNION ALL SELECT * FROM (SELECT 'long_rare' AS list, term, n FROM c, q WHERE length(term) >= 12 AND n <= q[2] ORDER BY length(term) DESC, n, term LIMIT 30) UNION ALL SELECT * FROM (SELECT 'short_rare' AS list, term, n FROM c, q WHERE length(term) BETWEEN 3 AND 5 AND n <= q[1] ORDER BY n, term LIMIT 30)",
    "json_source_means": "SELECT user_id % 10 AS domain, event_type AS source, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value > 0 GROUP BY 1, 2",
    "new_pairs": f"SELECT a, b, round(s, 6) AS score FROM (SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id AND (x.vec_id % 10 = 0 OR y.vec_id % 10 = 0)) WHERE s >= {THRESHOLD}",
    "due_sources": "WITH r AS (SELECT concat(event_type, '-', user_id % 20) AS source, arg_max(value < 5, (ts, event_id)) AS failed, max(ts) AS last FROM events GROUP BY 1) SELECT source, CASE WHEN failed THEN 'failed' ELSE 'old' END AS why FROM r WHERE failed OR last <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) UNION ALL SELECT 'never run', 'new'",
    "session_counters": "SELECT event_type, count(*) AS visits, CAST(sum(floor(value)) AS BIGINT) AS found, greatest(max(event_id) - 5, 0) AS resume_at FROM events GROUP BY 1",
}
