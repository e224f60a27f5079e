"""Sizes, names and shapes of input that once made operators fail or forget."""

import glob
import gzip
import io
import os
import random
import re
import time

from pyspark.sql import functions as F

from lexigrid.llm import licenses, sharding, urls, warc


def test_archives_roll_by_bytes(spark, monkeypatch, tmp_path):
    """Large pages among many small ones: no archive is much larger than asked for, and each begins with warcinfo."""
    monkeypatch.setattr(warc, "ROLL_BYTES", 200_000)
    monkeypatch.setattr(warc, "LINE_BYTES", 20_000)
    rng = random.Random(1)
    pages = [(i, f"http://x/{i}", "".join(rng.choices("abcdefghijklmnop", k=60_000 if i % 50 == 0 else 20))) for i in range(2_000)]
    pages.sort(key=lambda p: -len(p[2]))  # all large ones in one task
    path = f"{tmp_path}/warc"
    monkeypatch.setattr(warc, "with_revisits", lambda df, **_: df.select(F.col("page_id").alias("id"), "url", F.col("html").cast("binary").alias("payload"), F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("revisit")))
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2), f"file://{path}")
    files = glob.glob(f"{path}/part-*")
    assert len(files) > 5 and max(map(os.path.getsize, files)) < 200_000 + 10 * 60_000
    for f in files:
        assert gzip.GzipFile(fileobj=io.BytesIO(open(f, "rb").read())).read(200).split(b"\r\n")[1] == b"WARC-Type: warcinfo"
    got = {r["page_id"]: r["payload_bytes"] for r in warc.page_records(warc.read_warc(spark, f"file://{path}")).collect()}
    assert got == {i: len(h) for i, _, h in pages}


def test_sharding_keeps_any_columns(spark):
    names = ["doc_id", "text", "p", "bounds", "__key", "__sub", "__place", "__row", "__offset", "__in", "shard", "size"]
    docs = spark.createDataFrame([tuple([i, f"t{i % 7}", *([i] * (len(names) - 2))]) for i in range(60)], ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    got = sharding.shuffle_into_shards(docs.repartition(3), shards=4)
    assert got.columns == [*names[:-2], "size", "text_crc32", "shard", "slot"]
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(60)) and all(r[n] == r["doc_id"] for r in rows for n in names[2:-2])
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(4) for k in range(15)]


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.scan_licenses(docs, keep=["doc_id"]).collect()}


def plain(pattern):
    """A text that fits a pattern, from its first alternatives."""
    out = re.sub(r"\.\{1,80\}\?", "acme", pattern)
    while (new := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", out)) != out:
        out = new
    return re.sub(r"\[1-4\] ?\\d|\\d", "4 0", out).replace("[sc]", "s").replace("[01]", "0").replace(" ?", " ").replace("s?", "s")


def test_all_rules_are_let_through(spark):
    """Each rule finds a text made of its own pattern, alone, whatever other names the pattern holds."""
    rules = licenses.signature_rules()
    texts = [f"x {plain(r.pattern)} y" for r in rules]
    fitting = [k for k, (r, t) in enumerate(zip(rules, texts, strict=True)) if re.search(rf"(?<= )(?:{r.pattern})(?= )", t) and f" {r.keyword}" in t]
    assert len(fitting) > 0.95 * len(rules)
    got = scanned(spark, texts)
    assert [k for k in fitting if not got[k]["detections"]] == []
    disclaimer = scanned(spark, ["The author disclaims all warranties with regard to this software."])[0]
    assert (disclaimer["labels"], disclaimer["score"]) == ("isc", 0.9)


def contained(found):
    """Detections that no stronger one contains, compared pair by pair."""
    key = lambda d: (d["priority"], d["stop"] - d["start"], d["rank"])
    return [d for d in found if not any(e["start"] <= d["start"] and e["stop"] >= d["stop"] and key(e) > key(d) for e in found)]


def test_suppression_in_parts(spark):
    rng = random.Random(2)
    cases = []
    for n, span in ((5, 50), (300, 3_000), (2_000, 200_000), (400, 100)):
        found = []
        for rank in range(n):
            start = rng.randrange(span)
            found.append({"start": start, "stop": start + rng.choice([3, 10, 40, 300]), "priority": rng.randrange(4) * 10, "rank": -rank, "label": "x", "confidence": 0.5})
        cases.append(found)
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, found {licenses.INTERVALS}")
    for r in df.select("k", licenses.unsuppressed(F.col("found")).alias("u")).collect():
        assert sorted(map(str, ({**x.asDict()} for x in r["u"]))) == sorted(map(str, contained(cases[r["k"]])))


def test_thousands_of_mentions_in_one_text(spark):
    text = "licensed under the mit license. " * 4_000
    began = time.time()
    got = scanned(spark, [text, "nothing"])[0]
    assert got["n_base"] == 4_000 and got["labels"] == "mit" and time.time() - began < 60


def witten_bell(texts):
    """Counts of bytes after contexts of up to five, a text beginning with zeros."""
    counts = [{} for _ in range(urls.ORDER + 1)]
    for t in texts:
        data = t.encode() + b"\n"
        for k in range(urls.ORDER + 1):
            padded = b"\0" * k + data
            for i, byte in enumerate(data):
                after = counts[k].setdefault(padded[i : i + k], {})
                after[byte] = after.get(byte, 0) + 1
    return counts


def score(counts, text):
    import math

    data, total = text.encode() + b"\n", 0.0
    for i, byte in enumerate(data):
        p = 1 / 256
        for k in range(urls.ORDER + 1):
            after = counts[k].get((b"\0" * k + data)[i : i + k])
            if after:
                n, kinds = sum(after.values()), len(after)
                p = (after.get(byte, 0) + kinds * p) / (n + kinds)
        total += math.log(p)
    return total


def test_url_models_against_plain_counts(spark):
    """The whole query by dictionaries: folds by hash, counts, smoothing, ratio, threshold, ties and long URLs."""
    rng = random.Random(5)
    hosts, words = ["a.org", "b.com", "example.org", "c.net"], ["es", "en", "fr", "de", "shop", "news", "x"]
    rows = [(i, f"https://{rng.choice(hosts)}/{rng.choice(words)}/{rng.randrange(30)}/{rng.choice(words)}") for i in range(400)]
    rows += [(400, None), (401, ""), (402, "no scheme"), (403, "http://d.net/" + "x" * 20_000), (404, "http://e.org/" + "y" * 10_000), rows[0], (405, "http://é.net/ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = sorted(urls.filter_urls(pages, keep=["page_id"]).collect(), key=lambda r: (r["page_id"], r["host"]))
    ruled = {u: v for _, u in rows if u is not None and (v := next((r["verdict"] for r in got if r["rule"] and r["page_id"] == dict((b, a) for a, b in rows)[u]), None)) and len(u.encode()) <= urls.LONGEST_TRAINED}
    folds = {r["u"]: r["f"] for r in spark.createDataFrame([(u,) for u in ruled], "u string").select("u", F.pmod(F.xxhash64(F.lit(43), "u"), F.lit(5)).alias("f")).collect()}
    allow, block = (witten_bell([u for u, v in ruled.items() if v == kind and folds[u]]) for kind in ("allow", "block"))
    ratio = lambda u: (score(allow, u) - score(block, u)) / len(u.encode()) if u else 0.0
    threshold = urls.calibrate([(ratio(u), v == "allow") for u, v in ruled.items() if not folds[u]])
    for r, (_, url) in zip(got, sorted(rows, key=lambda x: (x[0], "")), strict=True):
        if r["rule"] is None:
            mine = ratio(url or "")
            assert abs(r["ratio"] - mine) < 1e-9 and r["verdict"] == ("allow" if r["ratio"] >= threshold or abs(mine - threshold) < 1e-9 else "block")
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}
    assert urls.filter_urls(pages.where("false")).count() == 0
