"""Scores and bands of words, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Zipf bands (upper bound, class, utility, level).
ZIPF_BANDS = ((1.0, "extremely_rare", 4.0), (2.0, "very_rare", 3.5), (3.0, "rare", 3.0), (4.0, "uncommon", 2.5), (5.0, "common", 1.5), (6.0, "very_common", 0.5))
ZIPF_LEVELS = ((2.0, "Graduate/Professional"), (3.0, "Undergraduate/Advanced"), (4.0, "High School/College"), (5.0, "Middle School/High School"))
#: What a word of up to so many letters is worth, and endings that raise it.
LENGTH_STEPS = ((3, 1.0), (5, 0.5), (8, 0.2), (12, 0.05))
PATTERNS = ("tion", "ing", "ed", "er", "ly", "un", "re")
#: Families of word forms.
MORPHOLOGY = (
    ("greek_root", r"(?:phil|phob|graph|log|chron|geo|bio|psych|path|morph|anthropo|demo|theo)"),
    ("latin_root", r"(?:aqua|terra|flora|fauna|corpus|opus|genus|species|vit|mort|anim|spir)"),
    ("academic_noun", r"(?:tion|sion|ment|ness|ity|acy|ism|ology|ography)$"),
    ("academic_adjective", r"(?:ous|eous|ious|uous|ent|ant|ive|ary|ory|al|ic|ical|istic)$"),
    ("technical_prefix", r"^(?:proto|pseudo|quasi|meta|hyper|super|ultra|micro|macro|multi)"),
    ("medical_legal", r"(?:pathic|genic|iatry|ectomy|osis|itis|emia|uria|cidal|therapy)$"),
    ("archaic_literary", r"(?:eth|est)$|^(?:whence|whither|wherefore|whilst|amongst|betwixt)$"),
)
#: Letter groups that sophisticated words tend to have.
UNUSUAL = r"[qx]|ph|gh|sch|tch|dge|ch|sh|th|ough|augh|eigh|tion|sion|eur|eau|ae|oe|ue|gue|que|psy|rhy|rrh"


def zipf(count: Column, total: Column, per: float = 1e6) -> Column:
    """log10 of the frequency in `per` words; null for none."""
    return F.when(count > 0, F.log10(count / total * per))


def zipf_class(value: Column) -> Column:
    out = F.when(value == 0, "unknown")
    for bound, label, _ in ZIPF_BANDS:
        out = out.when(value < bound, label)
    return out.when(value.isNotNull(), "very_common")


def zipf_utility(value: Column) -> Column:
    out = F.when(value == 0, 3.0)
    for bound, _, utility in ZIPF_BANDS:
        out = out.when(value < bound, utility)
    return out.when(value.isNotNull(), 0.5)


def reading_level(value: Column) -> Column:
    out = F.when(value == 0, ZIPF_LEVELS[0][1])
    for bound, label in ZIPF_LEVELS:
        out = out.when(value < bound, label)
    return out.when(value.isNotNull(), "Elementary/Common")


def quantile_class(value: Column, cuts: list[Column]) -> Column:
    """From seven names by six cuts; zero has no data."""
    names = ("Ultra-Rare", "Very Rare", "Rare", "Uncommon", "Moderate", "Common")
    out = F.when(value == 0, "No Data")
    for cut, name in zip(cuts, names, strict=True):
        out = out.when(value <= cut, name)
    return out.otherwise("Very Common")


def length_frequency(word: Column) -> Column:
    """A guess of how frequent a word is, from its length, patterns and share of vowels."""
    low, size = F.lower(word), F.length(word)
    base = None
    for most, value in LENGTH_STEPS:
        base = F.when(size <= most, value) if base is None else base.when(size <= most, value)
    bonus = reduce(lambda a, p: a + F.contains(low, F.lit(p)).cast("int"), PATTERNS, F.lit(0)) * 0.1
    ratio = F.when(size > 0, F.regexp_count(low, F.lit("[aeiou]")) / size).otherwise(0.0)
    return base.otherwise(0.01) + bonus + F.when(ratio.between(0.3, 0.5), 0.2).otherwise(0.0)


def syllables(word: Column) -> Column:
    """Groups of vowels; a final e is silent after another group; a final consonant + le adds one."""
    low = F.lower(word)
    groups = F.regexp_count(low, F.lit("[aeiouy]+"))
    groups = groups - F.when(low.endswith("e") & (groups > 1), 1).otherwise(0)
    groups = groups + F.when(low.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.greatest(groups, F.lit(1))


def morphology(word: Column) -> Column:
    """Sorted names of the families that the word belongs to; else the standard one."""
    found = F.array_compact(F.array(*(F.when(word.rlike(f"(?i){p}"), F.lit(n)) for n, p in MORPHOLOGY)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("standard")))


def interest(word: Column, zipf_value: Column) -> Column:
    """How interesting a candidate word is: length, forms, syllables, rarity."""
    size, forms = F.length(word), morphology(word)
    has = lambda *names: reduce(lambda a, n: a | F.array_contains(forms, n), names, F.lit(False))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    rare = F.when(zipf_value.isNull(), 3).when(zipf_value < 2.0, 2).when(zipf_value < 3.0, 1).when(zipf_value > 5.0, -2).otherwise(0)
    return (
        F.when(size.between(8, 15), 3).when(size.between(6, 7), 2).when(size > 15, 1).otherwise(0)
        + F.size(forms)
        + points(has("greek_root", "latin_root"), 3)
        + points(has("academic_noun", "academic_adjective"), 2)
        + points(has("technical_prefix"), 2)
        + points(has("medical_legal"), 2)
        + points(has("archaic_literary"), 1)
        + points(syllables(word) >= 4, 1)
        + rare
    )


def unusual(word: Column) -> Column:
    return word.rlike(f"(?i){UNUSUAL}")


def rule_score(raw: Column) -> Column:
    """Evidence to a score below 1."""
    return 1.0 - F.exp(-F.greatest(raw, F.lit(0.0)))


def next_review(ease: Column, interval: Column, quality: Column) -> tuple[Column, Column]:
    """Interval in days and ease after a review, by the SM-2 rule; ease is never below 1.3."""
    failed = quality < 3
    grown = F.when(interval == 1, 6).when(interval == 6, 14).otherwise(F.floor(interval * ease))
    eased = F.when(failed, ease - 0.2).otherwise(ease + 0.1 - (5 - quality) * (0.08 + (5 - quality) * 0.02))
    return F.when(failed, 1).otherwise(grown).cast("int"), F.greatest(eased, F.lit(1.3))
