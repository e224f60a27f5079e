"""Queries over terms of the documents: frequencies, rarity, search, forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexigrid.functions import scores, text
from lexigrid.operators import pairs, rarity, search
from lexigrid.operators.ranks import with_rank, with_row_number
from lexigrid.sources.tables import lexicon, table, tokens, written

TOKENS = r"""
  SELECT doc_id, source, lang, word FROM (
    SELECT doc_id, source, lang, regexp_replace(unnest(string_split_regex(lower(text), '[ \t\n\r\f]+')), '[^\p{L}]', '', 'g') AS word FROM documents
  ) WHERE length(word) > 1
"""
LEXICON = f"""
  SELECT word AS term, count(*) AS total,
    CASE WHEN count(*) FILTER (c = 0) > 0 THEN CAST(count(*) FILTER (c = 0) AS DOUBLE) ELSE -999.0 END AS freq_a,
    CASE WHEN count(*) FILTER (c = 1) > 0 THEN CAST(count(*) FILTER (c = 1) AS DOUBLE) ELSE -999.0 END AS freq_b,
    CASE WHEN length(word) > 14 THEN NULL WHEN count(*) FILTER (c = 2) > 0 THEN CAST(count(*) FILTER (c = 2) AS DOUBLE) ELSE -999.0 END AS freq_c
  FROM (SELECT word, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) % 3 AS c FROM ({TOKENS})) GROUP BY word
"""
BLEND = f"""
  SELECT *, CASE WHEN ra IS NULL AND rb IS NULL AND rc IS NULL THEN NULL ELSE
      (coalesce(ra * 0.45::DOUBLE, 0) + coalesce(rb * 0.35::DOUBLE, 0) + coalesce(rc * 0.20::DOUBLE, 0))
      / (CASE WHEN ra IS NOT NULL THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN rb IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN rc IS NOT NULL THEN 0.20::DOUBLE ELSE 0 END) END AS final_rarity,
    CAST(ra IS NOT NULL AS INT) + CAST(rb IS NOT NULL AS INT) + CAST(rc IS NOT NULL AS INT) AS num_sources
  FROM (
    SELECT *, CASE WHEN freq_a <> -999 THEN 1.0::DOUBLE - pa END AS ra, CASE WHEN freq_b <> -999 THEN 1.0::DOUBLE - pb END AS rb, CASE WHEN freq_c <> -999 THEN 1.0::DOUBLE - pc END AS rc
    FROM (SELECT *, percent_rank() OVER (ORDER BY freq_a NULLS LAST) AS pa, percent_rank() OVER (ORDER BY freq_b NULLS LAST) AS pb, percent_rank() OVER (ORDER BY freq_c NULLS LAST) AS pc FROM ({LEXICON}))
  )
"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return written(lexicon(_docs(spark, d)), "lexicon")


def _blend(spark: SparkSession, d: str) -> DataFrame:
    return rarity.blend(_terms(spark, d))


def token_counts(spark, d):
    return tokens(_docs(spark, d)).groupBy("word").agg(F.count("*").alias("n"))


def zipf(spark, d):
    counts = written(token_counts(spark, d), "counts")
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(total).select("word", "n", F.round(scores.zipf(F.col("n"), F.col("total")), 9).alias("zipf_per_million"))  # one row


def rarity_blend(spark, d):
    r = lambda c: F.round(c, 9).alias(c)
    return _blend(spark, d).select("term", *(r(f"{c}_rarity") for c in ("freq_a", "freq_b", "freq_c")), r("final_rarity"), "num_sources")


def rarity_category(spark, d):
    return _blend(spark, d).groupBy(rarity.band(F.round("final_rarity", 9)).alias("category")).agg(F.count("*").alias("n"))


def rarity_histogram(spark, d):
    return rarity.histogram(_blend(spark, d).withColumn("final_rarity", F.round("final_rarity", 9)), "final_rarity", 20)


def source_coverage(spark, d):
    return rarity.coverage(_blend(spark, d))


def letter_counts(spark, d):
    return search.letter_counts(_terms(spark, d))


def next_letters(spark, d):
    return search.next_letters(_terms(spark, d), "th")


def search_prefix(spark, d):
    return search.ranked_search(_terms(spark, d), "total", search.conditions(prefix="an")).select("term", "total", "rank")


def search_substring(spark, d):
    return search.ranked_search(_terms(spark, d), "total", search.conditions(text="tion", ranges={"total": (2, 500)})).select("term", "total", "rank")


def search_paged(spark, d):
    return search.page(_terms(spark, d).select("term", "total"), [F.lower("term").asc(), F.col("term").asc()], 3, 50)


def frequency_rank_percentile(spark, d):
    terms = _terms(spark, d).select("term", "total")
    n = terms.count()
    placed = with_row_number(terms, [F.col("total").desc(), F.col("term").asc()], "frequency_rank")
    return placed.select("term", "frequency_rank", F.round((n - F.col("frequency_rank") + 1) * 100.0 / n, 6).alias("common_percentile"), F.round(F.col("frequency_rank") * 100.0 / n, 6).alias("rare_percentile"))


def rank_score(spark, d):
    """Ranks as scores: log10 of the share that is no more frequent, per 10^9; the last have none left."""
    ranked = with_rank(_terms(spark, d).select("term", "total"), "total", "rank", descending=True)
    n = ranked.agg(F.max("rank").alias("n"))
    share = (F.col("n") - F.col("rank") + 1) / F.col("n") * 1e9
    return ranked.crossJoin(n).select("term", "rank", F.round(F.when(share > 0, F.log10(share)).otherwise(-999.0), 9).alias("score"))


def ecdf(spark, d):
    values = _terms(spark, d).groupBy("total").agg(F.count("*").alias("n"))
    upto = with_rank(_terms(spark, d).select("total"), "total", "rank").groupBy("total").agg(F.min("rank").alias("rank"), F.count("*").alias("n"))
    return upto.crossJoin(values.agg(F.sum("n").alias("all"))).select("total", F.round((F.col("rank") - 1 + F.col("n")) / F.col("all"), 9).alias("share"))


def zipf_class(spark, d):
    z = F.coalesce(F.col("zipf_per_million"), F.lit(0.0))
    return zipf(spark, d).select("word", scores.zipf_class(z).alias("class"), scores.zipf_utility(z).alias("utility"), scores.reading_level(z).alias("level"))


def length_frequency(spark, d):
    return _terms(spark, d).select("term", F.round(scores.length_frequency(F.col("term")), 6).alias("guess"))


def syllables(spark, d):
    return _terms(spark, d).select("term", scores.syllables(F.col("term")).cast("long").alias("syllables"))


def morphology(spark, d):
    return _terms(spark, d).select("term", F.array_join(scores.morphology(F.col("term")), ",").alias("forms"), scores.unusual(F.col("term")).alias("unusual"))


def interestingness(spark, d):
    return zipf(spark, d).select("word", scores.interest(F.col("word"), F.col("zipf_per_million")).cast("long").alias("points"))


def validate_word(spark, d):
    """Known words: those in the benchmark."""
    known = tokens(table(spark, d, "benchmark"), "item_id").select(F.col("word").alias("term"), F.lit(True).alias("known")).distinct()
    joined = _terms(spark, d).select("term").join(known, "term", "left")
    ok, why = text.is_english(F.col("term"), F.coalesce("known", F.lit(False)))
    return joined.select("term", ok.alias("is_english"), why.alias("reason"))


def _benchmark_terms(spark, d):
    return tokens(table(spark, d, "benchmark"), "item_id").select(F.col("word").alias("term")).distinct()


def existing_anti(spark, d):
    return _terms(spark, d).select("term").join(_benchmark_terms(spark, d), "term", "left_anti")


def prefix_dup(spark, d):
    return pairs.prefix_duplicates(_benchmark_terms(spark, d), _terms(spark, d).select("term"))


def close_spellings(spark, d):
    return pairs.close_spellings(_benchmark_terms(spark, d))


def first_seen(spark, d):
    """Each term once, where it is first seen."""
    seen = tokens(_docs(spark, d), "doc_id").groupBy(F.col("word").alias("term")).agg(F.min("doc_id").alias("doc_id"))
    return seen


def circular_terms(spark, d):
    """Terms of the benchmark against the item that they are from, without the term itself."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("definition"))
    each = tokens(table(spark, d, "benchmark"), "item_id").distinct().join(items, "item_id")
    others = F.array_except(text.circular(F.col("word"), F.col("definition")), F.array("word"))
    return each.select("item_id", "word", F.array_join(F.sort_array(others), ",").alias("found"))


def issue_flags(spark, d):
    t = _terms(spark, d)
    return t.select("term", text.issue_flags(F.col("term"), F.col("term"), F.col("total").cast("double"), F.greatest(F.col("freq_a"), F.lit(0.0))).alias("issues"))


def composite_frequency(spark, d):
    """Weighted Zipf over the corpora that know the term; agreement lifts the confidence."""
    t = _terms(spark, d)
    z = [F.when(F.col(c) > 0, F.log10(F.col(c) + 9)) for c in ("freq_a", "freq_b", "freq_c")]
    return t.select("term", *(x.alias(f"z{i}") for i, x in enumerate(z))).select("term", *_composite([F.col(f"z{i}") for i in range(3)], (0.4, 0.2, 0.1), (0.95, 0.8, 0.7)))


def _composite(zs, weights, trusts):
    mean = F.coalesce(rarity.renormalised(list(zip(zs, weights, strict=True))), F.lit(0.0))
    trust = F.coalesce(rarity.renormalised([(F.when(z.isNotNull(), c), w) for z, w, c in zip(zs, weights, trusts, strict=True)]), F.lit(0.0))
    count = sum((z.isNotNull().cast("int") for z in zs[1:]), zs[0].isNotNull().cast("int"))
    spread = sum((F.coalesce((z - mean) * (z - mean), F.lit(0.0)) for z in zs[1:]), F.coalesce((zs[0] - mean) * (zs[0] - mean), F.lit(0.0)))
    boosted = F.when((count > 1) & (spread < 1.0), F.least(F.lit(1.0), trust * 1.2)).otherwise(trust)
    return F.round(mean, 8).alias("zipf"), F.round(boosted, 8).alias("confidence")


def reweighted(spark, d):
    """Frequencies in a map, the positive ones weighed anew."""
    t = _terms(spark, d)
    m = F.map_filter(F.create_map(F.lit("a"), F.col("freq_a"), F.lit("b"), F.col("freq_b"), F.lit("c"), F.coalesce("freq_c", F.lit(0.0))), lambda k, v: v > 0)
    w = F.create_map(F.lit("a"), F.lit(0.7), F.lit("b"), F.lit(0.2), F.lit("c"), F.lit(0.1))
    add = lambda f: F.aggregate(F.map_entries("m"), F.lit(0.0), lambda s, e: s + f(e))
    top, bottom = add(lambda e: e["value"] * F.element_at(w, e["key"])), add(lambda e: F.element_at(w, e["key"]))
    return t.select("term", m.alias("m")).select("term", F.round(F.when(F.size("m") > 0, top / bottom), 8).alias("frequency"))


def upper_words(spark, d):
    """Cardinality of terms by length: how many, how often, longest."""
    t = _terms(spark, d)
    return t.groupBy(F.length("term").cast("long").alias("length")).agg(F.count("*").alias("terms"), F.sum("total").alias("uses"), F.max("total").alias("most"))


def freq_stats(spark, d):
    t = _terms(spark, d).select(F.col("total").cast("double").alias("x"))
    q = F.percentile("x", F.array(*(F.lit(p) for p in (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95))))
    return t.agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("sd"), F.round(F.stddev_pop("x"), 6).alias("sd_pop"), F.min("x").alias("low"), F.max("x").alias("high"), q.alias("q")).select("n", "mean", "sd", "sd_pop", "low", "high", *(F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(8)))


def quantile_class(spark, d):
    t = _terms(spark, d).select("term", F.greatest(F.col("freq_a"), F.lit(0.0)).alias("x"))
    cuts = t.agg(F.percentile("x", F.array(*(F.lit(p) for p in (0.01, 0.05, 0.10, 0.25, 0.75, 0.95)))).alias("q"))
    return t.crossJoin(cuts).select("term", scores.quantile_class(F.col("x"), [F.col("q")[i] for i in range(6)]).alias("class"))


QUERIES = {f.__name__: f for f in (token_counts, zipf, rarity_blend, rarity_category, rarity_histogram, source_coverage, letter_counts, next_letters, search_prefix, search_substring, search_paged, frequency_rank_percentile, rank_score, ecdf, zipf_class, length_frequency, syllables, morphology, interestingness, validate_word, existing_anti, prefix_dup, close_spellings, first_seen, circular_terms, issue_flags, composite_frequency, reweighted, upper_words, freq_stats, quantile_class)}

ZIPF = f"SELECT word, n, CASE WHEN n > 0 THEN round(log10(n / sum(n) OVER () * 1e6), 9) END AS zipf_per_million FROM (SELECT word, count(*) AS n FROM ({TOKENS}) GROUP BY word)"
BENCHMARK_TERMS = r"SELECT DISTINCT word AS term FROM (SELECT regexp_replace(unnest(string_split_regex(lower(text), '[ \t\n\r\f]+')), '[^\p{L}]', '', 'g') AS word FROM benchmark) WHERE length(word) > 1"
FORMS = " || ".join(f"CASE WHEN regexp_matches(term, '(?i){p}') THEN '{n},' ELSE '' END" for n, p in scores.MORPHOLOGY)
COUNTS = " + ".join(f"CAST(regexp_matches(word, '(?i){p}') AS INT)" for _, p in scores.MORPHOLOGY)
_M = {n: f"regexp_matches(word, '(?i){p}')" for n, p in scores.MORPHOLOGY}
SYLLABLES = "greatest(len(regexp_extract_all(lower(term), '[aeiouy]+')) - CASE WHEN suffix(lower(term), 'e') AND len(regexp_extract_all(lower(term), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(term), '[^aeiouy]le$') THEN 1 ELSE 0 END, 1)"
FOREIGN = ", ".join(f"'{w}'" for w in sorted(set(text.FOREIGN)))
#: DuckDB's levenshtein counts bytes
_ASCII = "translate({}, 'äöüßéèêçíóñáúàâîôûëïœ', '0123456789!#$%&()*+-/')"
COMPOSITE_Z = "CASE WHEN {c} > 0 THEN log10({c} + 9) END"

ORACLES = {
    "token_counts": f"SELECT word, count(*) AS n FROM ({TOKENS}) GROUP BY word",
    "zipf": ZIPF,
    "rarity_blend": f"SELECT term, round(ra, 9) AS freq_a_rarity, round(rb, 9) AS freq_b_rarity, round(rc, 9) AS freq_c_rarity, round(final_rarity, 9) AS final_rarity, num_sources FROM ({BLEND})",
    "rarity_category": f"SELECT CASE WHEN r < 0.2 THEN 'common' WHEN r < 0.4 THEN 'somewhat common' WHEN r < 0.6 THEN 'somewhat rare' WHEN r < 0.8 THEN 'rare' WHEN r IS NOT NULL THEN 'ultra-rare' END AS category, count(*) AS n FROM (SELECT round(final_rarity, 9) AS r FROM ({BLEND})) GROUP BY 1",
    "rarity_histogram": f"SELECT CAST(b.i AS INT) AS bucket, coalesce(n, 0) AS n FROM range(20) b(i) LEFT JOIN (SELECT CAST(floor(least(greatest(r, 0), 0.999999) * 20) AS INT) AS k, count(*) AS n FROM (SELECT round(final_rarity, 9) AS r FROM ({BLEND})) WHERE r IS NOT NULL GROUP BY 1) ON i = k",
    "source_coverage": f"SELECT num_sources, count(*) AS n FROM ({BLEND}) GROUP BY 1",
    "letter_counts": f"SELECT CASE substring(term, 1, 1) WHEN 'ß' THEN 'ß' ELSE upper(substring(term, 1, 1)) END AS letter, count(DISTINCT term) AS n FROM ({LEXICON}) GROUP BY 1",
    "next_letters": f"SELECT DISTINCT substring(term, 1, 3) AS prefix FROM ({LEXICON}) WHERE starts_with(term, 'th') AND length(term) > 2",
    "search_prefix": f"SELECT term, total, rank FROM (SELECT term, total, rank() OVER (ORDER BY total) AS rank FROM ({LEXICON})) WHERE starts_with(term, 'an')",
    "search_substring": f"SELECT term, total, rank FROM (SELECT term, total, rank() OVER (ORDER BY total) AS rank FROM ({LEXICON})) WHERE contains(term, 'tion') AND total BETWEEN 2 AND 500",
    "search_paged": f"SELECT term, total FROM ({LEXICON}) ORDER BY term LIMIT 50 OFFSET 100",
    "frequency_rank_percentile": f"SELECT term, r AS frequency_rank, round((n - r + 1) * 100.0::DOUBLE / n, 6) AS common_percentile, round(r * 100.0::DOUBLE / n, 6) AS rare_percentile FROM (SELECT term, row_number() OVER (ORDER BY total DESC, term) AS r, count(*) OVER () AS n FROM ({LEXICON}))",
    "rank_score": f"SELECT term, r AS rank, round(CASE WHEN n - r + 1 > 0 THEN log10((n - r + 1) / n * 1e9) ELSE -999 END, 9) AS score FROM (SELECT *, max(r) OVER () AS n FROM (SELECT term, rank() OVER (ORDER BY total DESC) AS r FROM ({LEXICON})))",
    "ecdf": f"SELECT DISTINCT total, round(cume_dist() OVER (ORDER BY total), 9) AS share FROM ({LEXICON})",
    "zipf_class": f"SELECT word, CASE WHEN z = 0 THEN 'unknown' WHEN z < 1 THEN 'extremely_rare' WHEN z < 2 THEN 'very_rare' WHEN z < 3 THEN 'rare' WHEN z < 4 THEN 'uncommon' WHEN z < 5 THEN 'common' ELSE 'very_common' END AS class, CAST(CASE WHEN z = 0 THEN 3.0 WHEN z < 1 THEN 4.0 WHEN z < 2 THEN 3.5 WHEN z < 3 THEN 3.0 WHEN z < 4 THEN 2.5 WHEN z < 5 THEN 1.5 ELSE 0.5 END AS DOUBLE) AS utility, CASE WHEN z < 2 THEN 'Graduate/Professional' WHEN z < 3 THEN 'Undergraduate/Advanced' WHEN z < 4 THEN 'High School/College' WHEN z < 5 THEN 'Middle School/High School' ELSE 'Elementary/Common' END AS level FROM (SELECT word, coalesce(zipf_per_million, 0) AS z FROM ({ZIPF}))",
    "length_frequency": f"SELECT term, round(CASE WHEN length(term) <= 3 THEN 1.0 WHEN length(term) <= 5 THEN 0.5 WHEN length(term) <= 8 THEN 0.2 WHEN length(term) <= 12 THEN 0.05 ELSE 0.01 END::DOUBLE + ({' + '.join(f'''CAST(contains(term, '{p}') AS INT)''' for p in scores.PATTERNS)}) * 0.1::DOUBLE + CASE WHEN len(regexp_extract_all(term, '[aeiou]')) / length(term) BETWEEN 0.3 AND 0.5 THEN 0.2 ELSE 0 END::DOUBLE, 6) AS guess FROM ({LEXICON})",
    "syllables": f"SELECT term, CAST({SYLLABLES} AS BIGINT) AS syllables FROM ({LEXICON})",
    "morphology": f"SELECT term, CASE WHEN f = '' THEN 'standard' ELSE rtrim(f, ',') END AS forms, unusual FROM (SELECT term, {FORMS} AS f, regexp_matches(term, '(?i){scores.UNUSUAL}') AS unusual FROM ({LEXICON}))",
    "interestingness": f"SELECT word, CAST(CASE WHEN length(word) BETWEEN 8 AND 15 THEN 3 WHEN length(word) BETWEEN 6 AND 7 THEN 2 WHEN length(word) > 15 THEN 1 ELSE 0 END + greatest({COUNTS}, 1) + CASE WHEN {_M['greek_root']} OR {_M['latin_root']} THEN 3 ELSE 0 END + CASE WHEN {_M['academic_noun']} OR {_M['academic_adjective']} THEN 2 ELSE 0 END + CASE WHEN {_M['technical_prefix']} THEN 2 ELSE 0 END + CASE WHEN {_M['medical_legal']} THEN 2 ELSE 0 END + CASE WHEN {_M['archaic_literary']} THEN 1 ELSE 0 END + CASE WHEN {SYLLABLES.replace('term', 'word')} >= 4 THEN 1 ELSE 0 END + CASE WHEN zipf_per_million IS NULL THEN 3 WHEN zipf_per_million < 2 THEN 2 WHEN zipf_per_million < 3 THEN 1 WHEN zipf_per_million > 5 THEN -2 ELSE 0 END AS BIGINT) AS points FROM ({ZIPF})",
    "validate_word": f"""SELECT term, reason IN ('in_dictionary', 'english_pattern') AS is_english, reason FROM (SELECT term, CASE WHEN length(term) < 3 THEN 'too_short'
        WHEN {' OR '.join(f"regexp_matches(term, '{p}')" for p in text.REJECTED)} OR term IN ({FOREIGN}) THEN 'non_english_pattern' WHEN term IN ({BENCHMARK_TERMS}) THEN 'in_dictionary'
        WHEN regexp_matches(term, '^[a-z]*[aeiou][a-z]*$') AND (NOT regexp_matches(term, '[bcdfghjklmnpqrstvwxyz]{{4,}}') OR regexp_matches(term, '{text.CONSONANTS_OK}')) AND (NOT regexp_matches(term, '[aeiou]{{3,}}') OR regexp_matches(term, '{text.VOWELS_OK}')) THEN 'english_pattern'
        ELSE 'not_english' END AS reason FROM ({LEXICON}))""",
    "existing_anti": f"SELECT term FROM ({LEXICON}) WHERE term NOT IN ({BENCHMARK_TERMS})",
    "prefix_dup": f"SELECT a.term, b.term AS known FROM ({BENCHMARK_TERMS}) a JOIN ({LEXICON}) b ON substring(a.term, 1, 6) = substring(b.term, 1, 6) AND abs(length(a.term) - length(b.term)) <= 3 AND a.term <> b.term WHERE length(a.term) >= 4 AND length(b.term) >= 4",
    "close_spellings": f"WITH t AS ({BENCHMARK_TERMS}), n AS (SELECT term, length(term) AS l FROM t) SELECT a.term AS a, b.term AS b FROM n a JOIN n b ON a.term < b.term AND abs(a.l - b.l) <= 1 WHERE levenshtein({_ASCII.format('a.term')}, {_ASCII.format('b.term')}) = 1",
    "first_seen": f"SELECT word AS term, min(doc_id) AS doc_id FROM ({TOKENS}) GROUP BY word",
    "issue_flags": f"SELECT term, CASE WHEN f = '' THEN 'Appears legitimate' ELSE rtrim(f, '; ') END AS issues FROM (SELECT term, CASE WHEN length(term) < 3 THEN 'Very short; ' ELSE '' END || CASE WHEN length(term) < 10 THEN 'Poor or missing definition; ' ELSE '' END || CASE WHEN freq_a > 0 AND (total / freq_a > 100 OR total / freq_a < 0.01) THEN 'Frequency data inconsistent; ' ELSE '' END AS f FROM ({LEXICON}))",
    "composite_frequency": f"""SELECT term, round(m, 8) AS zipf, round(CASE WHEN k > 1 AND coalesce((z0 - m) * (z0 - m), 0) + coalesce((z1 - m) * (z1 - m), 0) + coalesce((z2 - m) * (z2 - m), 0) < 1 THEN least(1.0, t * 1.2) ELSE t END, 8) AS confidence FROM (
        SELECT *, CASE WHEN w > 0 THEN (coalesce(z0 * 0.4::DOUBLE, 0) + coalesce(z1 * 0.2::DOUBLE, 0) + coalesce(z2 * 0.1::DOUBLE, 0)) / w ELSE 0 END AS m, CASE WHEN w > 0 THEN (CASE WHEN z0 IS NOT NULL THEN 0.95::DOUBLE * 0.4 ELSE 0 END + CASE WHEN z1 IS NOT NULL THEN 0.8::DOUBLE * 0.2 ELSE 0 END + CASE WHEN z2 IS NOT NULL THEN 0.7::DOUBLE * 0.1 ELSE 0 END) / w ELSE 0 END AS t FROM (
        SELECT *, CASE WHEN z0 IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN z1 IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN z2 IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END AS w, CAST(z0 IS NOT NULL AS INT) + CAST(z1 IS NOT NULL AS INT) + CAST(z2 IS NOT NULL AS INT) AS k FROM (
        SELECT term, {COMPOSITE_Z.format(c='freq_a')} AS z0, {COMPOSITE_Z.format(c='freq_b')} AS z1, {COMPOSITE_Z.format(c='freq_c')} AS z2 FROM ({LEXICON}))))""",
    "reweighted": f"SELECT term, round((CASE WHEN freq_a > 0 THEN freq_a * 0.7::DOUBLE ELSE 0 END + CASE WHEN freq_b > 0 THEN freq_b * 0.2::DOUBLE ELSE 0 END + CASE WHEN freq_c > 0 THEN freq_c * 0.1::DOUBLE ELSE 0 END) / nullif(CASE WHEN freq_a > 0 THEN 0.7::DOUBLE ELSE 0 END + CASE WHEN freq_b > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN freq_c > 0 THEN 0.1::DOUBLE ELSE 0 END, 0), 8) AS frequency FROM ({LEXICON})",
    "upper_words": f"SELECT length(term) AS length, count(*) AS terms, CAST(sum(total) AS BIGINT) AS uses, max(total) AS most FROM ({LEXICON}) GROUP BY 1",
    "freq_stats": f"SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(stddev_pop(x), 6) AS sd_pop, min(x) AS low, max(x) AS high, {', '.join(f'round(quantile_cont(x, {p}), 6) AS q{i}' for i, p in enumerate((0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)))} FROM (SELECT CAST(total AS DOUBLE) AS x FROM ({LEXICON}))",
    "quantile_class": f"WITH t AS (SELECT term, greatest(freq_a, 0) AS x FROM ({LEXICON})), q AS (SELECT quantile_cont(x, [0.01, 0.05, 0.10, 0.25, 0.75, 0.95]) AS q FROM t) SELECT term, CASE WHEN x = 0 THEN 'No Data' WHEN x <= q[1] THEN 'Ultra-Rare' WHEN x <= q[2] THEN 'Very Rare' WHEN x <= q[3] THEN 'Rare' WHEN x <= q[4] THEN 'Uncommon' WHEN x <= q[5] THEN 'Moderate' WHEN x <= q[6] THEN 'Common' ELSE 'Very Common' END AS class FROM t, q",
}
