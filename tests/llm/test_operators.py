"""The corpus operators against plain Python versions, on small tables with all the odd cases."""

import base64
import hashlib
import time
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigrid.llm import chat, components, decontaminate, katz, licenses, mixing, quality, sharding, simhash, urls, warc
from lexigrid.llm.common import scratch, written


def same(got, expected):
    assert sorted(map(str, got)) == sorted(map(str, expected))


# 1: WARC


def pages(spark):
    rows = [(3, "http://a/", "<p>x</p>", 1), (1, None, "<p>x</p>", 1), (2, "http://b/ c", "", 1), (5, "http://c", None, 1), (7, "", "é" * 50_000, 1), (1, None, "<p>x</p>", 1), (None, "http://n", "<p>x</p>", 1)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    read = warc.read_warc(spark, warc.write_warc(df, scratch(spark, "t")))
    assert read.where("kind = 'gap'").count() == 0
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_records(read).collect()]
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h, _ in rows:
        b, f = (h or "").encode(), first[h or ""]
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        expected.append((i, len(b), digest, "response", None) if i == f else (i, len(b), digest, "revisit", f))
    same(got, expected)
    bodies = {r["record_id"]: bytes(r["payload"]) for r in read.where("warc_type = 'response'").collect()}
    assert bodies["urn:lexigrid:page:7"] == ("é" * 50_000).encode()


def test_warc_small_payloads_stay_responses(spark):
    _, df = pages(spark)
    read = warc.page_records(warc.read_warc(spark, warc.write_warc(df, scratch(spark, "t"), min_revisit_bytes=5)))
    assert read.where("payload_bytes = 0 AND record_type <> 'response'").count() == 0 and read.where("record_type = 'revisit'").count() == 2


def test_warc_of_nothing(spark):
    _, df = pages(spark)
    assert warc.read_warc(spark, warc.write_warc(df.where("false"), scratch(spark, "t"))).count() == 0


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    made = [warc.page_record(i, "http://x", f"<p>{i} WARC/1.1 {'y' * i}</p>".encode(), None, False) for i in range(8)]
    made = [warc.gzip_member(m) for m in made] if zipped else made
    ends = np.cumsum([len(m) for m in made])
    whole = b"".join(made)
    found = list(warc.salvage(whole))
    assert [k for k, *_ in found] == ["record"] * 8 and sum(n for _, _, n, *_ in found) == len(whole)
    broken = bytearray(whole)
    broken[ends[3] - 12] ^= 0xFF  # in the block of record 3
    broken[ends[6] - 12] ^= 0xFF  # in that of record 6
    found = list(warc.salvage(bytes(broken)))
    assert sum(k == "record" for k, *_ in found) == 6 and [(a, n) for k, a, n, *_ in found if k == "gap"] == [(ends[2], len(made[3])), (ends[5], len(made[6]))]
    cut = whole[: ends[6] + 20]
    found = list(warc.salvage(b"junk" + cut))
    assert [(a, n) for k, a, n, *_ in found if k == "gap"] == [(0, 4), (ends[6] + 4, 20)] and sum(k == "record" for k, *_ in found) == 7
    assert list(warc.salvage(b"")) == [] and [k for k, *_ in warc.salvage(b"nothing here")] == ["gap"]


def test_salvage_is_linear():
    made = [warc.gzip_member(warc.page_record(i, None, bytes(np.random.default_rng(i).integers(0, 256, 6000, np.uint8)), None, False)) for i in range(400)]
    took = []
    for times in (1, 10):
        data = b"".join(made) * 10 * times
        began = time.process_time()
        assert sum(k == "record" for k, *_ in warc.salvage(data)) == 4000 * times
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0]
    began = time.process_time()
    assert len(list(warc.salvage(b"\x1f\x8b\x08 WARC/1.1\r\nx " * 200_000))) == 1 and time.process_time() - began < 60


def test_salvage_bounds(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 10_000)
    made = [warc.gzip_member(warc.page_record(i, None, b"y" * n, None, False)) for i, n in enumerate((10, 50_000, 20))]
    assert [k for k, *_ in warc.salvage(b"".join(made))] == ["record", "gap", "record"]


def test_rolled_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL_BYTES", 2_000)
    monkeypatch.setattr(warc, "LINE_BYTES", 500)
    df = spark.range(100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 100).alias("html"))
    path = warc.write_warc(df.coalesce(1), scratch(spark, "t"))
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() > 10
    assert warc.page_records(warc.read_warc(spark, path)).where("record_type = 'response'").count() == 100


# 2: mixing


def test_mixing(docs, rows):
    got = mixing.mix_to_targets(docs, keep=["doc_id", "source"]).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    expected = brute.targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]]) and 0 <= r["copies"] <= 2
    same(got, mixing.mix_to_targets(docs.repartition(5), keep=["doc_id", "source"]).collect())
    emitted = mixing.emit(mixing.mix_to_targets(docs))
    assert emitted.count() == sum(r["copies"] for r in got) and set(emitted.columns) <= set(docs.columns)


def test_mixing_comes_near_targets(spark):
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws("", F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 9 + 1).cast("int")).alias("text"))
    got = mixing.mix_to_targets(many).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.05 for r in got) and sum(r["target"] for r in got) == pytest.approx(1.5 * 20_000 * 5, rel=0.01)


def test_mixing_nothing(nothing):
    assert mixing.emit(mixing.mix_to_targets(nothing)).count() == 0


# 3: quality


def test_quality_signals(docs, rows):
    got = quality.judge(docs, keep=["doc_id"]).collect()
    assert not any(r["kept"] and r["base_failed"] for r in got)
    same([(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got], [(i, *brute.quality(t)) for i, t, _ in rows])
    verdict = {r["doc_id"]: r["kept"] for r in got}
    assert verdict[1] and verdict[8] and not verdict[13]
    whole = quality.judge(docs)
    assert whole.where("kept").count() == sum(r["kept"] for r in got) and "text" in whole.columns


def test_quality_em(spark):
    """EM by plain Python gives the same posteriors, and turns a verdict that the rules' first accuracies give."""
    rng = np.random.default_rng(8)
    rules = tuple(quality.Rule(n, "false", f"{n} = 1", a) for n, a in (("a", 0.95), ("b", 0.7), ("c", 0.7), ("d", 0.7)))
    bad = rng.random(4000) < 0.3
    # a is thought to be right and votes at random; the other three tell the classes apart
    votes = np.stack([rng.random(4000) < 0.3, *(rng.random(4000) < np.where(bad, 0.8, 0.05) for _ in range(3))], axis=1)
    counts = Counter(tuple(0 if x else None for x in v) for v in votes.tolist())
    patterns = spark.createDataFrame([(*v, n) for v, n in counts.items()], "v0 int, v1 int, v2 int, v3 int, n long")
    fitted = quality.fit(patterns, rules, 0.6)
    expected = brute.answers(counts, [r.accuracy for r in rules], 0.6, quality.PRIOR)
    assert fitted.good == pytest.approx(expected[0], abs=1e-4) and np.allclose(np.array([fitted.on_good, fitted.on_bad]), np.array(expected[1:]), atol=1e-4)
    assert abs(fitted.good - 0.7) < 0.05 and fitted.accuracy(0) < 0.5 < fitted.accuracy(1)
    before = quality.start([(float(votes[:, j].sum()), 0.0) for j in range(4)], 4000.0, rules, 0.6)
    alone = patterns.where("v0 = 0 AND v1 IS NULL AND v2 IS NULL AND v3 IS NULL")
    columns = [F.col(f"v{j}") for j in range(4)]
    said = alone.select(quality.posterior(columns, before).alias("x"), quality.posterior(columns, fitted).alias("y")).first()
    assert said["x"] < 0.5 < said["y"]


def test_quality_of_nothing(nothing):
    assert quality.judge(nothing, keep=["doc_id"]).count() == 0 and quality.judge(nothing).count() == 0


# 4: SimHash


def test_fingerprints_and_components(docs, rows):
    fps = [brute.fingerprint(t) for _, t, _ in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    comp, least = brute.components(len(fps), links), defaultdict(list)
    for (i, _, _), c in zip(rows, comp):
        least[c].append(i)
    expected = [(i, f"{f:016x}", min((x for x in least[c] if x is not None), default=None)) for (i, _, _), f, c in zip(rows, fps, comp)]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    same([tuple(r) for r in got], expected)


@pytest.mark.parametrize("bucket", [2, 32])
def test_links_of_crowds(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base for x, y in rng.integers(0, 62, (25, 2))]
    fps = sorted({int(x) for x in [*base, *near]})
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    df = written(spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long"), "t")
    roots = {r["node"]: r["root"] for r in components.connected_components(simhash.links(df)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    mine, theirs = [roots.get(x, x) for x in signed], brute.components(len(fps), pairs)
    assert len(set(mine)) == len(set(theirs)) == len(set(zip(mine, theirs)))


def test_thresholds_add_up():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (500, 64)).astype(float)
    for tau in (2, 3):
        plan = simhash.allocate(500, x.T @ x, tau)
        groups = {tuple(b) for b, _ in plan}
        assert len(groups) == len(plan) and sum(t + 1 for _, t in plan) == tau + 1


def test_components_of_a_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components.connected_components(edges).collect()
    assert len(got) == 299 and {r["root"] for r in got} == {0}
    assert components.connected_components(edges.where("false")).count() == 0


def test_near_copies(spark):
    words = [f"w{int(i)}" for i in np.random.default_rng(4).zipf(1.4, 400) % 5000]  # some words are common, as in prose
    near = words.copy()
    near[50] = near[120] = "changed"
    far = words.copy()
    far[::6] = ["changed"] * len(far[::6])
    rows = [(9, " ".join(words)), (4, " ".join(words).upper()), (7, " ".join(near)), (2, " ".join(far)), (5, None), (6, ""), (3, "clean text")]
    got = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {4, 2, 5, 3}


def test_simhash_of_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_copies(nothing).count() == 0


# 5: decontamination


def test_leaks(spark):
    rng = np.random.default_rng(5)
    vocab = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in "bcdfglmnprst"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, say(int(rng.integers(15, 58)))) for i in range(20)] + [(98, None), (99, "")]
    rows, expected = [], set()
    for i in range(300):
        text = say(int(rng.integers(5, 400)))
        if i % 10 == 0:
            k = int(rng.integers(0, 20))
            cut = text.split()
            at = int(rng.integers(0, len(cut) + 1))
            leak = items[k][1].split()
            if i % 20 == 0:  # one word in ten is another
                leak = [w if j % 10 else "other" for j, w in enumerate(leak, 1)]
            text = " ".join(cut[:at] + leak + cut[at:]).upper()
            expected.add((i, k))
        rows.append((i, text, "x"))
    rows += [(1000, None, "x"), (1001, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], i) for r in decontaminate.find_leaks(docs, bench).collect() for i in r["__items"]}
    assert len(got & expected) >= 0.95 * len(expected) and not got - expected
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).where("size(__items) > 0").count() == 0


def test_common_subsequence():
    import random

    random.seed(2)
    for _ in range(200):
        a, b = ([random.randrange(5) for _ in range(random.randrange(1, 20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = defaultdict(int)
        for k, w in enumerate(a):
            masks[w] |= 1 << k
        assert decontaminate.common_subsequence(masks, len(a), b) == table[-1][-1]


# 6: URLs


def test_url_rules(spark):
    urls_ = ["http://A.example.org/es/1?q", "https://example.org/es/", "http://example.org/en/12", "http://x.org", "http://x.org/", "http://b.com/fr/1#x", "http://b.com/de/", "http://notorg/", "nothing", None, "", "http://h.net/a?b/c", "ftp://U.Com/FR/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls_)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, keep=["page_id"]).collect()}
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][:3] == ("x.org", "", None) and got[4] == ("x.org", "/", "org/", "allow") and got[5][2:] == ("com/fr/", "allow") and got[6][2:] == ("com/de/", "block")
    assert got[7][2] is None and got[8][:3] == ("", "", None) and got[9][:3] == ("", "", None) and got[11][:2] == ("h.net", "/a") and got[12][:3] == ("u.com", "/FR/", None)
    assert all(v[3] in ("allow", "block") for v in got.values())
    assert urls.filter_urls(df.where("false")).count() == 0


def test_url_models_tell_classes_apart(spark):
    made = [(i, f"http://h{i % 7}.{'org' if i % 2 else 'com'}/{'articles/story' if i % 2 else 'de/cheap-pills'}-{i * 37 % 1000}") for i in range(600)]
    asked = [(10_000 + i, f"http://z{i}.net/{'articles/story' if i % 2 else 'de/cheap-pills'}-{i}") for i in range(100)]
    got = urls.filter_urls(spark.createDataFrame(made + asked, "page_id long, url string")).where("page_id >= 10000").collect()
    assert sum((r["verdict"] == "allow") == (r["page_id"] % 2 == 1) for r in got) >= 95


def test_url_model_is_normalised(spark):
    """After any beginning, the probabilities of all next bytes and of the end sum to 1 or, of bytes that were never seen, less."""
    rows = [(f"http://{h}/{p}{i}", int(h == "a")) for h in "ab" for p in ("x/", "y-") for i in range(30)]
    models = urls.fit(spark.createDataFrame(rows, "url string, allowed int"))
    for orders in models:
        for begin in (b"", b"http://a/", b"zzz", b"http://b/y-1"):
            whole = [urls.log_likelihoods(orders, [begin + bytes([b]) for b in range(256)]), urls.log_likelihoods(orders, [begin])]
            # less the end of each longer text, by the share that it has after that text
            p = urls.next_probabilities(orders, begin)
            assert len(p) == 256 and sum(p) == pytest.approx(1.0, abs=1e-9) and all(x > 0 for x in p)
            assert np.isfinite(whole[0]).all() and whole[1][0] == pytest.approx(np.log(p[10]) + sum(np.log(urls.next_probabilities(orders, begin[:k])[c]) for k, c in enumerate(begin)))


# 7: licenses


def test_license_words(docs, rows):
    got = licenses.scan_licenses(docs, keep=["doc_id"]).collect()
    same([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], [(i, *brute.licenses(t)) for i, t, _ in rows])
    found = {r["doc_id"]: r for r in got}
    assert found[14]["labels"] == "apache-2,cc-by-nc,gpl-3,mit" and found[14]["score"] >= 0.95 and found[1]["labels"] == "" and found[1]["score"] == 0.0
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_suppression(spark):
    text = "This is CC BY NC SA 4.0 work, licensed under the GNU Lesser General Public License v3."
    r = licenses.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert "cc-by-nc-sa" in r["labels"].split(",") and "lgpl-3" in r["labels"].split(",") and "cc-by" not in r["labels"].split(",")
    assert 200 <= len(licenses.signature_rules()) <= 400


def test_license_gate_misses_nothing(spark):
    """The one expression before the rules changes no result; labels are those of all rules tried one by one."""
    import re

    rules = licenses.signature_rules()
    said = ["this source code form is subject to the terms of the mozilla public license v. 2.0", "Released under GPL v2", "http://www.apache.org/licenses/LICENSE-2.0", "Permission is hereby granted, free of charge, to any person obtaining a copy", "in the public domain", "https://creativecommons.org/licenses/by-nc-sa/4.0/", "All rights reserved. 3-clause BSD", "mitigation of apachean boosters", "SPDX-License-Identifier: MIT", "ISC"]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()}
    for i, text in enumerate(said):
        joined = " ".join(brute.LICENSE_WORD.findall(text.translate(brute.LOWER)))
        found = [(r.priority, m.end() - m.start(), -k, m.start(), m.end(), r.label) for k, r in enumerate(rules) if f" {r.keyword}" in f" {joined} " for m in re.finditer(rf"(?:(?<=^)|(?<= ))(?:{r.pattern})(?= |$)", joined)]
        left = {d[5] for d in found if not any(e[3] <= d[3] and e[4] >= d[4] and e[:3] > d[:3] for e in found)}
        assert got[i] == ",".join(sorted(left)), text
    assert got[7] == "" and got[0] == "mpl-2" and got[5] == "cc-by-nc-sa" and got[8] == "mit"


def test_licenses_of_nothing(nothing):
    assert licenses.scan_licenses(nothing).count() == 0


# 8: chat


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>x<|im_end|>", "a\\b\\\\", "<\\|", "<|", "", None, "é\n日", "<<SYS>><s>", "[[INST]", "\\n"]
    rows = []
    for c in range(40):
        rows.append((c, 0, "user" if c % 3 else "system", nasty[c % len(nasty)], 1))
        rows += [(c, 1 + t, ("assistant", "user")[(t + (c % 3 == 0)) % 2], nasty[(c * 7 + t) % len(nasty)], 1) for t in range(c % 6)]
    rows += [(None, 0, "user", "x", 1), (50, None, None, "x", 1), (51, 0, "assistant", "y" * 200_000, 1), (51, 0, "assistant", "y", 1), (51, 0, "assistant", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    formed = chat.format_conversations(df)
    back = formed.select("conv_id", "valid", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "wrong_turn", "formatted").collect()
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert len(back) == len(by)
    for r in back:
        turns = [(b, x) for _, b, x in sorted(by[r["conv_id"]])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == "".join(x for b, x in turns if b == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(turns) and "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]
    valid = {r["conv_id"]: r["valid"] for r in back}
    assert valid[1] and not valid[51] and not valid[None]
    wrong = {r["conv_id"]: r["wrong_turn"] for r in back}
    assert wrong[51] == 0 and wrong[50] == 0 and wrong[None] is None and all(wrong[c] is None for c in valid if valid[c])
    assert chat.format_conversations(df.where("false")).count() == 0


# 9: sharding


def test_sharding(docs, rows):
    got = sharding.shuffle_into_shards(docs, shards=16, keep=["doc_id"]).collect()
    counts = Counter(r["shard"] for r in got)
    assert len(got) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows])


def test_sharding_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 40)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")).repartition(9)
    got = sharding.shuffle_into_shards(df, shards=7).toPandas()
    assert set(got.groupby("shard").size()) <= {714, 715}
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    low = (got["doc_id"] < 2500).groupby(got["shard"]).mean()
    assert low.between(0.4, 0.6).all()  # shuffled, not dealt in order


def test_few_rows_and_none(spark, nothing):
    few = sharding.shuffle_into_shards(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")).collect()
    assert len(few) == 2 and {r["slot"] for r in few} == {0}
    assert sharding.shuffle_into_shards(nothing).count() == 0


def test_matrix():
    m = np.array(sharding.communication_matrix([10, 0, 33, 7, 51], 4, 1))
    assert m.sum(axis=1).tolist() == [10, 0, 33, 7, 51] and sorted(m.sum(axis=0).tolist()) == [25, 25, 25, 26]
    rng = np.random.default_rng(0)
    draws = [sharding._draw(rng, 2_000_000_000, 6_000_000_000, 1000) for _ in range(200)]
    assert abs(np.mean(draws) - 250) < 4 and 10 < np.std(draws) < 18


# 10: Katz


@pytest.mark.parametrize("chunk", [1 << 10, 8 << 20])
def test_katz(docs, rows, monkeypatch, chunk):
    expected, sums = brute.katz([(i, t) for i, t, _ in rows])
    assert all(abs(v - 1) < 1e-9 for v in sums.values())
    got = katz.score_texts(docs).collect()
    shape = lambda i, h, n, k, t, b, s: (i, h, n, k, t, round(b, 5), round(s, 5))
    same([shape(*r) for r in got], [shape(i, brute.held_out(i), *e) for (i, _, _), e in zip(rows, expected)])


def test_katz_without_training(spark, nothing):
    held = next(i for i in range(100) if brute.held_out(i))
    got = katz.score_texts(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0]["train_tokens"] == 0 and got[0]["score"] == 0.0
    assert katz.score_texts(nothing).count() == 0


def test_pack():
    for x in (np.array([], np.int64), np.array([0, 255, 256, 70_000]), np.array([1 << 40, 3]), np.array([0.5, -2.0])):
        assert np.array_equal(katz.unpack(katz.pack(x)), x)
    h = np.array([1 << 63, 5], np.uint64)
    assert np.array_equal(katz.unpack(katz.pack(h)).view(np.uint64), h)
